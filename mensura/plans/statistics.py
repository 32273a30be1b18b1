"""Queries for frames, statistics, information, validation and updates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators import causal, descriptive, frame, inference, information, validation
from mensura.plans.common import Registry, load, rounded

R = Registry()


@R.add("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000""")
def frame_filter_select(spark: SparkSession, sf: str) -> DataFrame:
    return frame.select(frame.filter_rows(load(spark, sf, "orders"), "o_orderstatus = 'F' and o_totalprice > 100000"), "o_orderkey", "o_totalprice")


@R.add("""SELECT o_orderstatus, round(coalesce(avg(o_totalprice), 0.0), 4) AS mean FROM orders GROUP BY 1""")
def frame_group_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frame.group_mean(load(spark, sf, "orders"), "o_orderstatus", "o_totalprice"), 4)


@R.add("""SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1""")
def frame_group_count(spark: SparkSession, sf: str) -> DataFrame:
    return frame.group_count(load(spark, sf, "orders"), "o_orderpriority")


@R.add("""SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 5""")
def frame_head(spark: SparkSession, sf: str) -> DataFrame:
    return frame.head(load(spark, sf, "events"), ["ts", "event_id"]).select("event_id", "user_id")


@R.add("""SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5""")
def frame_tail(spark: SparkSession, sf: str) -> DataFrame:
    return frame.tail(load(spark, sf, "events"), ["ts", "event_id"]).select("event_id", "user_id")


@R.add("""
WITH l AS (SELECT 'p_size' AS c, p_size::DOUBLE AS x FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part)
SELECT c AS "column", count(*) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, round(quantile_cont(x, 0.5), 6) AS median, max(x) AS max FROM l GROUP BY c""")
def describe_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frame.describe(load(spark, sf, "part"), "p_name", "p_size", "p_retailprice"), 6, "min", "max")


@R.add("""SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS normalized FROM part""")
def normalize_price(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frame.normalize(load(spark, sf, "part"), "p_retailprice").select("p_partkey", "normalized"))


@R.add("""SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand)) / stddev_samp(p_retailprice) OVER (PARTITION BY p_brand), 5) AS z_score FROM part""")
def z_score_by_brand(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frame.z_score(load(spark, sf, "part"), "p_retailprice", "p_brand").select("p_partkey", "z_score"), 5)


FLAGSHIP = """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd,
round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(quantile_cont(l_quantity, 0.75), 6) AS p75,
round(corr(l_extendedprice, l_quantity), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1, 2"""


@R.add(FLAGSHIP)
def flagship_moments(spark: SparkSession, sf: str) -> DataFrame:
    """All from one pass: moments, quartiles, guarded correlation, slope."""
    q, p = "l_quantity", "l_extendedprice"
    out = load(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.avg(q).alias("mean"), F.stddev_samp(q).alias("sd"), *[F.percentile(q, x).alias(n) for n, x in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))], descriptive.pearson(p, q).alias("r"), F.try_divide(F.covar_pop(p, q), F.var_pop(q)).alias("slope")
    )
    return rounded(rounded(out, 6, "slope"), 4, "mean", "sd", "median", "p25", "p75", "r")


@R.add("""SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem GROUP BY 1""")
def corr_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(descriptive.correlation(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"))


@R.add("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared FROM lineitem GROUP BY 1""")
def linear_fit_by_group(spark: SparkSession, sf: str) -> DataFrame:
    out = descriptive.linear_regression(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return rounded(rounded(rounded(out, 6, "slope", "intercept"), 4, "intercept", "r_squared"), 3, "slope", "r_squared")


@R.add("""SELECT l_linestatus, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1""")
def median_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(descriptive.median(load(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus"), 4)


@R.add("""SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.9), 4) AS percentile FROM lineitem GROUP BY 1""")
def percentile_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(descriptive.percentile(load(spark, sf, "lineitem"), "l_extendedprice", 90, "l_linestatus"), 4)


@R.add("""SELECT user_id, count(*) AS count, round(avg(value), 9) AS mean, round(var_samp(value), 4) AS variance FROM events GROUP BY 1""")
def moments_merge(spark: SparkSession, sf: str) -> DataFrame:
    parts = descriptive.moments(load(spark, sf, "events"), "value", ["user_id", "event_type"])
    out = descriptive.finish_moments(descriptive.merge_moments(parts, "user_id")).select("user_id", "count", "mean", "variance")
    return rounded(rounded(out, 9, "variance"), 4, "mean")


@R.add("""SELECT count(*) AS n, round(sum(l_quantity), 2) AS sx, round(sum(l_quantity * l_quantity), 2) AS sxx, round(sum(l_extendedprice), 0) AS sy, round(sum(l_quantity * l_extendedprice) / 1e6, 3) AS sxy FROM lineitem""")
def stream_ols_gram(spark: SparkSession, sf: str) -> DataFrame:
    g = descriptive.gram(load(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return g.select("n", F.round("xx_0_1", 2).alias("sx"), F.round("xx_1_1", 2).alias("sxx"), F.round("xy_0", 0).alias("sy"), F.round(F.col("xy_1") / 1e6, 3).alias("sxy"))


@R.add("""SELECT s_suppkey, rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2.0::DOUBLE AS rank FROM supplier""")
def midranks(spark: SparkSession, sf: str) -> DataFrame:
    return descriptive.average_ranks(load(spark, sf, "supplier"), "s_nationkey").select("s_suppkey", "rank")


@R.add("""
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0::DOUBLE AS b FROM part)
SELECT round(corr(a, b), 6) AS spearman FROM r""")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(descriptive.spearman_correlation(load(spark, sf, "part"), "p_size", "p_retailprice"))


@R.add("""
WITH s AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), a AS (SELECT * FROM s WHERE g = 'click'), b AS (SELECT * FROM s WHERE g = 'view')
SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS statistic, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4) AS df FROM a, b""")
def ttest_welch_stat(spark: SparkSession, sf: str) -> DataFrame:
    t = inference.two_sample_ttest(load(spark, sf, "events"), "value", "event_type", "click", "view", equal_var=False)
    return t.select(F.round("statistic", 6).alias("statistic"), F.round("df", 4).alias("df"))


@R.add("""SELECT round((avg(value) - 50) / sqrt(var_samp(value) / count(*)), 6) AS statistic, count(*) - 1.0::DOUBLE AS df FROM events""")
def ttest_one_sample_stat(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.one_sample_ttest(load(spark, sf, "events"), "value", 50.0).select("statistic", "df"))


@R.add("""SELECT round(avg(l_tax - l_discount) / sqrt(var_samp(l_tax - l_discount) / count(*)), 5) AS statistic, count(*) - 1.0::DOUBLE AS df FROM lineitem""")
def paired_t_stat(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.paired_ttest(load(spark, sf, "lineitem"), "l_tax", "l_discount").select("statistic", "df"), 5)


@R.add("""
WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM events GROUP BY 1),
t AS (SELECT sum(n * m) / sum(n) AS gm FROM g)
SELECT round((sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 6) AS statistic, count(*) - 1.0::DOUBLE AS df, (sum(n) - count(*))::DOUBLE AS df_within FROM g, t""")
def anova_f(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.one_way_anova(load(spark, sf, "events"), "value", "event_type").select("statistic", "df", "df_within"))


CHI2 = """
WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2),
e AS (SELECT o, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER ()::DOUBLE AS e, a, b, sum(o) OVER () AS n FROM c),
s AS (SELECT sum(pow(o - e, 2) / e) AS x, count(DISTINCT a) AS r, count(DISTINCT b) AS k, max(n) AS n FROM e)
"""


@R.add(CHI2 + "SELECT round(x, 6) AS statistic, ((r - 1) * (k - 1))::DOUBLE AS df, round(exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6), 6) AS p_value FROM s")
def chi2_indep(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.chi_square_independence(load(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select("statistic", "df", "p_value"))


@R.add(CHI2 + "SELECT round(sqrt(x / (n * (least(r, k) - 1))), 6) AS cramers_v FROM s")
def cramers_v(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.cramers_v(load(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


@R.add("""
WITH o AS (SELECT o_orderpriority, count(*) AS o FROM orders GROUP BY 1), e AS (SELECT o, sum(o) OVER () / count(*) OVER ()::DOUBLE AS e FROM o)
SELECT round(sum(pow(o - e, 2) / e), 6) AS statistic, count(*) - 1.0::DOUBLE AS df FROM e""")
def chi2_gof(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("o"))
    cells = n.crossJoin(F.broadcast(n.agg(F.avg("o").alias("e"))))
    return rounded(inference.chi_square_gof(cells, "o", "e").select("statistic", "df"))


@R.add("""
WITH s AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), a AS (SELECT * FROM s WHERE g = 'purchase'), b AS (SELECT * FROM s WHERE g = 'error')
SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS cohens_d FROM a, b""")
def cohens_d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.cohens_d(load(spark, sf, "events"), "value", "event_type", "purchase", "error"))


@R.add("""
WITH e AS (SELECT event_type AS g, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r FROM events WHERE event_type IN ('click', 'view')),
s AS (SELECT sum(CASE WHEN g = 'click' THEN r END) AS ra, count_if(g = 'click') AS na, count_if(g = 'view') AS nb FROM e)
SELECT least(ra - na * (na + 1) / 2.0::DOUBLE, na * nb - (ra - na * (na + 1) / 2.0::DOUBLE)) AS statistic, (na + nb)::BIGINT AS n_effective FROM s""")
def mwu_u(spark: SparkSession, sf: str) -> DataFrame:
    return inference.mann_whitney_u(load(spark, sf, "events"), "value", "event_type", "click", "view").select("statistic", "n_effective")


@R.add("""
WITH d AS (SELECT value - 50 AS d FROM events WHERE value <> 50), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d)
SELECT sum(CASE WHEN d > 0 THEN r END) AS statistic, count(*) AS n_effective FROM r""")
def wilcoxon_w(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "events").select((F.col("value") - 50).alias("d"))
    return inference.wilcoxon_signed_rank(d, "d").select("statistic", "n_effective")


def _p(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", (((F.col("p_partkey") * 7919) % 1009 + 1) / 20000.0).alias("p"))


P = "WITH p AS (SELECT p_partkey, ((p_partkey * 7919) % 1009 + 1) / 20000.0::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS k, count(*) OVER () AS m FROM p)"
UP = "rows between current row and unbounded following"


@R.add(P + " SELECT p_partkey, round(least(1.0, p * m), 8) AS adjusted, least(1.0, p * m) <= 0.05 AS rejected FROM r")
def bonferroni_adjust(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.bonferroni(_p(spark, sf), "p").drop("p"), 8)


@R.add(P + ", a AS (SELECT p_partkey, least(1.0, max(p * (m - k + 1)) OVER (ORDER BY k)) AS adjusted FROM r) SELECT p_partkey, round(adjusted, 8) AS adjusted, adjusted <= 0.05 AS rejected FROM a")
def holm_adjust(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.holm(_p(spark, sf), "p", "p_partkey").drop("p"), 8)


@R.add(P + f", a AS (SELECT p_partkey, least(1.0, min(p * m / k) OVER (ORDER BY k {UP})) AS adjusted FROM r) SELECT p_partkey, round(adjusted, 8) AS adjusted, adjusted <= 0.05 AS rejected FROM a")
def bh_adjust(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.benjamini_hochberg(_p(spark, sf), "p", "p_partkey").drop("p"), 8)


@R.add(P + f", h AS (SELECT sum(1.0::DOUBLE / k) AS h FROM r), a AS (SELECT p_partkey, least(1.0, min(p * m / k * h) OVER (ORDER BY k {UP})) AS adjusted FROM r, h) SELECT p_partkey, round(adjusted, 8) AS adjusted, adjusted <= 0.05 AS rejected FROM a")
def by_adjust(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.adjust_p_values(_p(spark, sf), "p", "p_partkey", "benjamini-yekutieli").drop("p"), 8)


def _poisson_sql(rows: str, value: str, seed: int, n: int) -> str:
    """CTEs r0 to r3 and drawn (b, x, w): the weights of inference.with_poisson_weight."""
    steps = [f"r0 AS (SELECT b, {value} AS x, (k % {inference.PRIME} * 48271 + b * 69621 + {seed}) % {inference.PRIME} AS z FROM ({rows}) s, range({n}) t(b) WHERE {value} IS NOT NULL)"]
    steps += [f"r{i} AS (SELECT b, x, (z * z % {inference.PRIME} + z * 16807 + 12345) % {inference.PRIME} AS z FROM r{i - 1})" for i in (1, 2, 3)]
    below = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]
    return ", ".join(steps) + ", drawn AS (SELECT b, x, " + " + ".join(f"(z >= {math.ceil(p * inference.PRIME)})::INT" for p in below) + " AS w FROM r3)"


@R.add(f"""WITH {_poisson_sql("SELECT s_suppkey AS k, s_acctbal FROM supplier", "s_acctbal", 0, 500)}, m AS (SELECT b, sum(w * x) / sum(w) AS s FROM drawn GROUP BY b)
SELECT round((SELECT avg(s_acctbal) FROM supplier), 6) AS estimate, round(quantile_cont(s, 0.025), 6) AS lower, round(quantile_cont(s, 0.975), 6) AS upper, 500 AS n_resamples, 0.95::DOUBLE AS confidence, round(stddev_pop(s), 6) AS se FROM m""")
def bootstrap_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.bootstrap_ci(load(spark, sf, "supplier"), "s_acctbal", n_resamples=500, key="s_suppkey"))


@R.add()
def t_tail_p(spark: SparkSession, sf: str) -> DataFrame:
    return inference.two_sample_ttest(load(spark, sf, "events"), "value", "event_type", "click", "view")


# ---- information -------------------------------------------------------------------------

DIST = "SELECT o_orderpriority AS c, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM orders"


@R.add(f"WITH d AS ({DIST} GROUP BY 1) SELECT round(-sum(p * log2(p)), 6) AS entropy FROM d")
def entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(information.entropy(information.distribution(load(spark, sf, "orders"), "o_orderpriority")))


def _pq(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = load(spark, sf, "orders")
    return tuple(information.distribution(o.where(F.col("o_orderstatus") == s), "o_orderpriority") for s in ("F", "O"))


PQ = f"WITH a AS ({DIST} WHERE o_orderstatus = 'F' GROUP BY 1), b AS ({DIST} WHERE o_orderstatus = 'O' GROUP BY 1), j AS (SELECT a.p AS p, b.p AS q FROM a JOIN b USING (c))"


@R.add(PQ + " SELECT round(sum(p * log2(p / q)), 8) AS kl FROM j")
def kl(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(information.kl_divergence(*_pq(spark, sf), "o_orderpriority"), 8)


@R.add(PQ + " SELECT round(-sum(p * log2(q)), 8) AS cross_entropy FROM j")
def cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(information.cross_entropy(*_pq(spark, sf), "o_orderpriority"), 8)


@R.add(PQ + " SELECT round(sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) / 2, 8) AS js FROM j")
def js(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(information.js_divergence(*_pq(spark, sf), "o_orderpriority"), 8)


@R.add("""
WITH j AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM orders GROUP BY 1, 2), m AS (SELECT p, sum(p) OVER (PARTITION BY a) AS x, sum(p) OVER (PARTITION BY b) AS y FROM j)
SELECT round(sum(p * log2(p / (x * y))), 8) AS mutual_information FROM m""")
def mutual_info(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(information.mutual_information(load(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"), 8)


# ---- validation --------------------------------------------------------------------------


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = load(spark, sf, "lineitem")
    return li.where("l_shipdate < timestamp'1998-01-01'"), li.where("l_shipdate >= timestamp'1998-01-01'")


KS = """
WITH l AS (SELECT l_shipdate < TIMESTAMP '1998-01-01' AS r, unnest([{'feature': 'l_quantity', 'x': l_quantity}, {'feature': 'l_discount', 'x': l_discount}], recursive := true) FROM lineitem),
c AS (SELECT feature, x, count_if(r) AS a, count_if(NOT r) AS b FROM l GROUP BY 1, 2),
g AS (SELECT feature, abs(sum(a) OVER (PARTITION BY feature ORDER BY x) / sum(a) OVER (PARTITION BY feature)::DOUBLE - sum(b) OVER (PARTITION BY feature ORDER BY x) / sum(b) OVER (PARTITION BY feature)::DOUBLE) AS d FROM c)
"""


@R.add(KS + "SELECT round(max(d), 8) AS ks_distance FROM g WHERE feature = 'l_quantity'")
def ks_distance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(validation.empirical_ks_distance(*_halves(spark, sf), "l_quantity"), 8)


@R.add(KS + "SELECT feature, round(max(d), 8) AS ks_distance, max(d) > 0.2 AS drifted FROM g GROUP BY 1")
def feature_drift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(validation.feature_drift(*_halves(spark, sf), ["l_quantity", "l_discount"]), 8)


@R.add("""
WITH r AS (SELECT avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'), c AS (SELECT avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
SELECT round(abs(c.m - r.m) / sqrt(r.v), 6) AS shift, round(greatest(r.v, c.v) / least(r.v, c.v), 6) AS variance_ratio FROM r, c""")
def moment_drift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(validation.drift_of_moments(*_halves(spark, sf), "l_extendedprice"))


@R.add("""
WITH r AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS b, avg(p_retailprice) AS c, stddev_pop(p_retailprice) AS d FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, round(greatest(abs((p_size - a) / b), abs((p_retailprice - c) / d)), 6) AS max_abs_z, greatest(abs((p_size - a) / b), abs((p_retailprice - c) / d)) > 1.7 AS out_of_distribution FROM part, r WHERE p_partkey % 2 = 1""")
def ood_z(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    out = validation.screen_ood(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), ["p_size", "p_retailprice"], 1.7)
    return rounded(out.select("p_partkey", "max_abs_z", "out_of_distribution"))


@R.add("""
WITH r AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)
SELECT c_custkey, NOT (c_acctbal BETWEEN lo + 0.1 * (hi - lo) AND hi - 0.1 * (hi - lo)) AS outside FROM customer, r""")
def ood_range(spark: SparkSession, sf: str) -> DataFrame:
    s, c = (load(spark, sf, t).withColumnRenamed(k, "acctbal") for t, k in (("supplier", "s_acctbal"), ("customer", "c_acctbal")))
    return validation.ood_ranges(s, c, ["acctbal"], -0.1).select("c_custkey", "outside")


@R.add("""SELECT doc_id FROM documents t WHERE doc_id % 2 = 1 AND EXISTS (SELECT 1 FROM documents r WHERE r.doc_id % 2 = 0 AND r.text = t.text)""")
def leak_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    return validation.duplicate_rows(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "text").select("doc_id")


@R.add("""SELECT source FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT source FROM documents WHERE doc_id % 2 = 1""")
def leak_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    return validation.shared_groups(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "source")


@R.add("""SELECT 'data-adequacy:observations' AS name, CASE WHEN count(*) >= 100 THEN 'pass' ELSE 'fail' END AS status FROM orders UNION ALL SELECT 'data-adequacy:missing', 'pass' UNION ALL SELECT 'data-adequacy:parameters', CASE WHEN count(*) / 10 >= 50 THEN 'pass' ELSE 'fail' END FROM orders UNION ALL SELECT 'positive-domain', CASE WHEN count_if(o_totalprice <= 0) = 0 THEN 'pass' ELSE 'fail' END FROM orders""")
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return validation.report(validation.assess_data_adequacy(validation.data_profile(o, 10), 100, 0.01, 50), validation.check_positive(o, "o_totalprice", "o_orderkey")).select("name", "status")


@R.add("""
WITH d AS (SELECT date_trunc('day', ts) AS day, avg(value) - 50 AS r FROM events GROUP BY 1), i AS (SELECT r, row_number() OVER (ORDER BY day) - 1 AS i, avg(r) OVER () AS m, count(*) OVER () AS n FROM d), l AS (SELECT *, (r - m) * lag(r - m) OVER (ORDER BY i) AS p FROM i)
SELECT round(abs(max(m)) / sqrt(var_samp(r) / max(n)), 5) AS bias_z, round(abs(sum(p) / sum(pow(r - m, 2))), 5) AS lag1, round(greatest(var_pop(r) FILTER (i < n // 2), var_pop(r) FILTER (i >= n // 2)) / least(var_pop(r) FILTER (i < n // 2), var_pop(r) FILTER (i >= n // 2)), 5) AS variance_ratio FROM l""")
def residual_check(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg((F.avg("value") - 50).alias("r"))
    return rounded(validation.residual_diagnostics(d, "r", "day"), 5)


# ---- effects, mining, updates ------------------------------------------------------------


@R.add("""SELECT round(avg(value) FILTER (user_id % 2 = 0) - avg(value) FILTER (user_id % 2 = 1), 6) AS effect, 'randomized-mean' AS method, count(*) AS n_observations FROM events""")
def randomized_effect(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").withColumn("t", F.col("user_id") % 2 == 0)
    return rounded(causal.randomized_mean_effect(e, "value", "t", True))


@R.add("""
WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_quantity, l_tax) AS xz, covar_pop(l_tax, l_extendedprice) AS zy, var_pop(l_quantity) AS xx, var_pop(l_tax) AS zz, count(*) AS n FROM lineitem)
SELECT round((xy * zz - xz * zy) / (xx * zz - xz * xz), 3) AS effect, n AS n_observations FROM s""")
def backdoor_effect(spark: SparkSession, sf: str) -> DataFrame:
    ok = causal.CausalAssumptions(True, True, True, True)
    out = causal.linear_backdoor_effect(load(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_tax"], ok)
    return out.select(F.round("effect", 3).alias("effect"), "n_observations")


@R.add("""
WITH s AS (SELECT corr(l_quantity, l_extendedprice) AS qe, corr(l_quantity, l_discount) AS qd, corr(l_quantity, l_tax) AS qt, corr(l_extendedprice, l_discount) AS ed, corr(l_extendedprice, l_tax) AS et, corr(l_discount, l_tax) AS dt FROM lineitem),
p AS (SELECT unnest([{'feature_a': 'l_quantity', 'feature_b': 'l_extendedprice', 'r': qe}, {'feature_a': 'l_quantity', 'feature_b': 'l_discount', 'r': qd}, {'feature_a': 'l_quantity', 'feature_b': 'l_tax', 'r': qt}, {'feature_a': 'l_extendedprice', 'feature_b': 'l_discount', 'r': ed}, {'feature_a': 'l_extendedprice', 'feature_b': 'l_tax', 'r': et}, {'feature_a': 'l_discount', 'feature_b': 'l_tax', 'r': dt}], recursive := true) FROM s)
SELECT feature_a, feature_b, round(r, 6) AS correlation, CASE WHEN abs(r) < 0.2 THEN 'weak' WHEN abs(r) < 0.5 THEN 'moderate' ELSE 'strong' END AS strength FROM p""")
def mine_correlations_stat(spark: SparkSession, sf: str) -> DataFrame:
    out = causal.mine_correlations(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], alpha=1.1, min_abs_r=0.0)
    return rounded(out.drop("p_value"))


@R.add("""SELECT toxic, 1 + sum(quality)::DOUBLE AS alpha, 1 + count(*) - sum(quality)::DOUBLE AS beta, round((1 + sum(quality)) / (2 + count(*))::DOUBLE, 6) AS mean FROM labels GROUP BY 1""")
def beta_binomial(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(causal.beta_binomial_update(load(spark, sf, "labels"), "quality", "toxic").drop("variance"))


@R.add("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT 1.0::DOUBLE + sum(n)::DOUBLE AS alpha, 1.0::DOUBLE + count(*) AS beta, round((1 + sum(n)) / (1 + count(*))::DOUBLE, 6) AS mean FROM c""")
def gamma_poisson(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "events").groupBy("user_id").count()
    return rounded(causal.gamma_poisson_update(c, "count").drop("variance"))


@R.add("""SELECT event_type, round((50 / 100.0::DOUBLE + sum(value) / 900.0::DOUBLE) / (1 / 100.0::DOUBLE + count(*) / 900.0::DOUBLE), 6) AS mean, round(sqrt(1 / (1 / 100.0::DOUBLE + count(*) / 900.0::DOUBLE)), 6) AS sd, count(*) AS n FROM events GROUP BY 1""")
def normal_normal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(causal.normal_normal_update(load(spark, sf, "events"), "value", 50.0, 10.0, 30.0, "event_type"))


@R.add(f"""WITH {_poisson_sql("SELECT event_id AS k, value FROM events WHERE event_type = 'click'", "value", 3, 200)}, ca AS (SELECT b, quantile_cont(x, 0.5) AS s FROM (SELECT b, x, unnest(range(w)) FROM drawn) GROUP BY b),
other AS (WITH {_poisson_sql("SELECT event_id AS k, value FROM events WHERE event_type = 'view'", "value", 4, 200)} SELECT b, quantile_cont(x, 0.5) AS s FROM (SELECT b, x, unnest(range(w)) FROM drawn) GROUP BY b), m AS (SELECT ca.s - other.s AS s FROM ca JOIN other USING (b))
SELECT round((SELECT quantile_cont(value, 0.5) FROM events WHERE event_type = 'click') - (SELECT quantile_cont(value, 0.5) FROM events WHERE event_type = 'view'), 6) AS estimate,
round(quantile_cont(s, 0.05), 6) AS lower, round(quantile_cont(s, 0.95), 6) AS upper, 200 AS n_resamples, 0.9::DOUBLE AS confidence, round(stddev_pop(s), 6) AS se FROM m""")
def bootstrap_median_gap(spark: SparkSession, sf: str) -> DataFrame:
    """The difference of two medians, over 200 resamples of all clicks and views."""
    return rounded(inference.bootstrap_diff_ci(load(spark, sf, "events"), "value", "event_type", "click", "view", inference.Quantile(0.5), 200, 0.9, 3, "event_id"))
