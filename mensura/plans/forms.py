"""Queries whose SQL is a closed form: distributions, p-values, checks, factorisations, transforms, solvers, registers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions import distributions, science, special
from mensura.operators import calculus, causal, descriptive, graph, inference, learning, linalg, metrics, ordering, signals, simulation, validation
from mensura.operators.text import KnowledgeGraph
from mensura.plans.common import Registry, load, rounded
from mensura.plans.text import EDGES, G, H, _moments, _whole, all_hours, even_hours, places

R = Registry()


def named(spark: SparkSession, values: dict[str, float], digits: int = 6) -> DataFrame:
    """(name, value) rows of results that are numbers."""
    return spark.createDataFrame([(k, round(float(v), digits) + 0.0) for k, v in values.items()], "name string, value double")


def named_sql(values: dict[str, str], digits: int = 6, before: str = "", source: str = "") -> str:
    """The same rows in SQL, of expressions over an optional one-row source."""
    return before + " UNION ALL ".join(f"SELECT '{k}' AS name, round(({v})::DOUBLE, {digits}) + 0.0::DOUBLE AS value {source}" for k, v in values.items())


def area(f: Callable[[str], str], x: str, n: int = 400) -> str:
    """SQL for the integral of f from 0 to x by Simpson's rule."""
    at = f"({x} * j / {n}.0::DOUBLE)"
    return f"(list_sum([(CASE WHEN j IN (0, {n}) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * {f(at)} for j in range(0, {n + 1})]) * {x} / {3 * n}.0::DOUBLE)"


def phi(z: str) -> str:
    """SQL for the normal distribution function."""
    return f"(0.5::DOUBLE + {area(lambda v: f'exp(-{v} * {v} / 2)', z)} / sqrt(2 * pi()))"


def t_two_sided(t: str, df: str) -> str:
    """SQL for the two-sided p of Student's t."""
    inside = area(lambda v: f"pow(1 + {v} * {v} / ({df}), -(({df}) + 1) / 2.0::DOUBLE)", f"abs({t})")
    return f"(1 - 2 * exp(lgamma((({df}) + 1) / 2.0::DOUBLE) - lgamma(({df}) / 2.0::DOUBLE)) / sqrt(({df}) * pi()) * {inside})"


# ---- distributions -----------------------------------------------------------------------


@R.add(f"""
WITH g AS (SELECT p_partkey, p_size / 8.1::DOUBLE AS x, p_size / 51.0::DOUBLE AS p FROM part)
SELECT p_partkey, round(exp(1.5 * ln(x) - x / 2 - 2.5 * ln(2) - lgamma(2.5)), 8) AS chi2_pdf, round(1 - exp(-x / 2) * (1 + x / 2), 8) AS chi2_cdf, round(exp(-x / 2) * (1 + x / 2), 8) AS chi2_sf, round(-2 * ln(1 - p), 7) AS chi2_ppf,
round(exp(lgamma(4) - lgamma(3.5)) / sqrt(7 * pi()) * pow(1 + x * x / 7, -4), 8) AS t_pdf, round(0.5 + x / (2 * sqrt(2 + x * x)), 8) AS t_cdf, round(1 - x / sqrt(2 + x * x), 8) AS t_sf, round((2 * p - 1) / sqrt(2 * p * (1 - p)), 7) AS t_ppf,
round(pow(1 + x / 3, -3), 8) AS f_sf, round(x * x * exp(-x / 2) / 16, 8) AS gamma_pdf, round(12 * p * pow(1 - p, 2), 8) AS beta_pdf, round({phi('x')}, 8) AS normal_cdf,
round(lgamma(x), 7) AS gammln, round(1 - exp(-x) * (1 + x), 8) AS gammp, round(exp(-x) * (1 + x), 8) AS gammq, round(6 * p * p - 8 * pow(p, 3) + 3 * pow(p, 4), 8) AS betai FROM g""")
def special_values(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous distributions and the functions under them, at the sizes of all parts (1 to 50)."""
    f, d = special.column_function, distributions
    g = load(spark, sf, "part").select("p_partkey", (F.col("p_size") / 8.1).alias("x"), (F.col("p_size") / 51).alias("p"))
    out = g.select(
        "p_partkey", d.chi2_pdf("x", 5.0).alias("chi2_pdf"), d.chi2_cdf("x", 4.0).alias("chi2_cdf"), special.chi2_sf("x", 4.0).alias("chi2_sf"), F.round(d.chi2_ppf("p", 2.0), 7).alias("chi2_ppf"),
        d.t_pdf("x", 7.0).alias("t_pdf"), d.t_cdf("x", 2.0).alias("t_cdf"), special.t_sf("x", 2.0).alias("t_sf"), F.round(d.t_ppf("p", 2.0), 7).alias("t_ppf"),
        special.f_sf("x", 2.0, 6.0).alias("f_sf"), d.gamma_pdf("x", 3.0, 2.0).alias("gamma_pdf"), d.beta_pdf("p", 2.0, 3.0).alias("beta_pdf"), d.gaussian_cdf("x").alias("normal_cdf"),
        F.round(f(special.gammln)("x"), 7).alias("gammln"), f(special.gammp)(F.lit(2.0), "x").alias("gammp"), f(special.gammq)(F.lit(2.0), "x").alias("gammq"), f(special.betai)(F.lit(2.0), F.lit(3.0), "p").alias("betai"),
    )
    return rounded(out, 8)


@R.add("""
WITH p AS (SELECT p_partkey, p_retailprice / 1000 AS x FROM part)
SELECT p_partkey, CASE WHEN x BETWEEN 1 AND 1.5 THEN 2.0 ELSE 0.0 END::DOUBLE AS uniform_pdf, round(least(1.0, greatest(0.0, (x - 1) / 0.5)), 8) AS uniform_cdf, round(2 * exp(-2 * x), 8) AS exponential_pdf, round(1 - exp(-2 * x), 8) AS exponential_cdf FROM p""")
def simple_densities(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("x"))
    d = distributions
    return rounded(p.select("p_partkey", d.uniform_pdf("x", 1.0, 1.5).alias("uniform_pdf"), d.uniform_cdf("x", 1.0, 1.5).alias("uniform_cdf"), d.exponential_pdf("x", 2.0).alias("exponential_pdf"), d.exponential_cdf("x", 2.0).alias("exponential_cdf")), 8)


def _choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


@R.add(f"""
WITH g AS (SELECT k::INT AS k, CASE WHEN k >= 1 THEN pow(0.7::DOUBLE, k - 1) * 0.3 ELSE 0.0 END::DOUBLE AS geo, CASE WHEN k <= 7 THEN exp({_choose('7', 'k')} + {_choose('13', '(8 - k)')} - {_choose('20', '8')}) ELSE 0.0 END::DOUBLE AS hyper, exp({_choose('(k + 2)', 'k')} + 3 * ln(0.4) + k * ln(0.6)) AS neg FROM range(0, 9) r(k))
, v AS (SELECT k, round(geo, 8) AS geometric_pmf, round(sum(geo) OVER (ORDER BY k), 8) AS geometric_cdf, round(hyper, 8) AS hypergeometric_pmf, round(sum(hyper) OVER (ORDER BY k), 8) AS hypergeometric_cdf, round(neg, 8) AS negative_binomial_pmf, round(sum(neg) OVER (ORDER BY k), 8) AS negative_binomial_cdf FROM g)
SELECT p_partkey, v.* FROM part JOIN v ON k = p_size % 9""")
def discrete_values(spark: SparkSession, sf: str) -> DataFrame:
    d, k = distributions, load(spark, sf, "part").select("p_partkey", (F.col("p_size") % 9).cast("int").alias("k"))
    return rounded(k.select("p_partkey", "k", d.geometric_pmf("k", 0.3).alias("geometric_pmf"), d.geometric_cdf("k", 0.3).alias("geometric_cdf"), d.hypergeometric_pmf("k", 7.0, 13.0, 8.0).alias("hypergeometric_pmf"), d.hypergeometric_cdf("k", 7.0, 13.0, 8.0).alias("hypergeometric_cdf"), d.negative_binomial_pmf("k", 3.0, 0.4).alias("negative_binomial_pmf"), d.negative_binomial_cdf("k", 3.0, 0.4).alias("negative_binomial_cdf")), 8)


_Z = 1.959963984540054


@R.add(f"""WITH b AS (SELECT p_brand, count(*) AS n, count_if(p_size > 25) AS k, avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part GROUP BY 1)
SELECT p_brand, round(pow(0.025::DOUBLE, 1.0::DOUBLE / n), 6) AS beta_lower, round(pow(0.975::DOUBLE, 1.0::DOUBLE / n), 6) AS beta_upper, round(-ln(0.975) / (n / 40.0::DOUBLE), 6) AS gamma_lower, round(-ln(0.025) / (n / 40.0::DOUBLE), 6) AS gamma_upper,
round(m - {_Z} * s, 5) AS normal_lower, round(m + {_Z} * s, 5) AS normal_upper, round(lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 2) - n * ln(0.5), 6) AS log_bayes_factor FROM b""")
def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Credible intervals and the evidence against an even share of large parts, by brand; a row a brand is worked on."""
    b = load(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 25).alias("k"), F.avg("p_retailprice").alias("m"), F.stddev_samp("p_retailprice").alias("s"))

    @F.udf("array<double>")
    def ends(n: int, k: int, m: float, s: float) -> list[float]:
        pairs = (causal.beta_credible_interval(float(n), 1.0), causal.gamma_credible_interval(1.0, n / 40), causal.normal_credible_interval(m, s))
        return [*(float(v) for pair in pairs for v in pair), math.log(causal.bayes_factor(k, n, 0.5))]

    v = b.select("p_brand", ends("n", "k", "m", "s").alias("v"))
    digits = {"beta_lower": 6, "beta_upper": 6, "gamma_lower": 6, "gamma_upper": 6, "normal_lower": 5, "normal_upper": 5, "log_bayes_factor": 6}
    return v.select("p_brand", *[F.round(F.col("v")[i], d).alias(c) for i, (c, d) in enumerate(digits.items())])


# ---- inference ---------------------------------------------------------------------------

_W = "w AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), c AS (SELECT a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.v AS va, b.v AS vb FROM w a, w b WHERE a.g = 'click' AND b.g = 'view'), t AS (SELECT (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0::DOUBLE / na + 1.0::DOUBLE / nb)) AS t, na + nb - 2.0::DOUBLE AS df FROM c)"


@R.add(f"WITH {_W} SELECT round(t, 6) AS statistic, df, round({t_two_sided('t', 'df')}, 6) AS p_value FROM t")
def ttest_p(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.two_sample_ttest(load(spark, sf, "events"), "value", "event_type", "click", "view"))


@R.add(f"""
WITH s AS (SELECT event_type, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM events GROUP BY 1), t AS (SELECT event_type, (m - 50) / sqrt(v / n) AS t, n - 1.0::DOUBLE AS df FROM s)
SELECT event_type, round(t, 6) AS statistic, df, round({t_two_sided('t', 'df')}, 6) AS p_value FROM t""")
def ttest_one_sample_p(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.one_sample_ttest(load(spark, sf, "events"), "value", 50.0, "event_type"))


@R.add(f"""
WITH s AS (SELECT l_returnflag, avg(l_tax - l_discount / 1.25) AS m, var_samp(l_tax - l_discount / 1.25) AS v, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT l_returnflag, m / sqrt(v / n) AS t, n - 1.0::DOUBLE AS df, m / sqrt(v) AS d FROM s)
SELECT l_returnflag, round(t, 5) AS statistic, df, round({t_two_sided('t', 'df')}, 6) AS p_value, round(d, 6) AS cohens_d FROM t""")
def paired_p(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").withColumn("d", F.col("l_discount") / 1.25)
    t = inference.paired_ttest(li, "l_tax", "d", "l_returnflag").join(inference.paired_cohens_d(li, "l_tax", "d", "l_returnflag"), "l_returnflag")
    return t.select("l_returnflag", F.round("statistic", 5).alias("statistic"), "df", F.round("p_value", 6).alias("p_value"), F.round("cohens_d", 6).alias("cohens_d"))


@R.add("""
WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM events GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS gm FROM g),
f AS (SELECT (sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f, (sum(n) - count(*))::DOUBLE AS d FROM g, t), z AS (SELECT f, d, d / (d + 4 * f) AS z, d / 2 AS a FROM f)
SELECT round(f, 6) AS statistic, round(pow(z, a) * ((a + 1) - a * z), 6) AS p_value, round(4 * f / (4 * f + d), 8) AS eta_squared FROM z""")
def anova_p(spark: SparkSession, sf: str) -> DataFrame:
    """Five groups, so the p-value has a closed form."""
    a = inference.one_way_anova(load(spark, sf, "events"), "value", "event_type")
    eta = inference.eta_squared_from_f(F.col("statistic"), F.col("df"), F.col("df_within"))
    return a.select(F.round("statistic", 6).alias("statistic"), F.round("p_value", 6).alias("p_value"), F.round(eta, 8).alias("eta_squared"))


@R.add(f"""
WITH r AS (SELECT event_type AS g, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r FROM events WHERE event_type IN ('click', 'view')),
t AS (SELECT sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT count(*) AS t FROM r GROUP BY value)), s AS (SELECT count_if(g = 'click') AS a, count_if(g = 'view') AS b, sum(r) FILTER (g = 'click') AS ra FROM r),
u AS (SELECT least(ra - a * (a + 1) / 2.0::DOUBLE, a * b - (ra - a * (a + 1) / 2.0::DOUBLE)) AS u, a * b * 1.0::DOUBLE AS ab, a + b AS n, ties FROM s, t), z AS (SELECT u, (u - ab / 2) / sqrt(ab / 12 * (n + 1 - ties / (n * (n - 1.0::DOUBLE)))) AS z FROM u)
SELECT u AS statistic, round(z, 6) AS z, round(2 * (1 - {phi('abs(z)')}), 6) AS p_value FROM z""")
def mann_whitney_p(spark: SparkSession, sf: str) -> DataFrame:
    m = inference.mann_whitney_u(load(spark, sf, "events"), "value", "event_type", "click", "view")
    return m.select("statistic", F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value"))


@R.add(f"""
WITH d AS (SELECT c_acctbal - 4500 AS d FROM customer WHERE c_acctbal <> 4500), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d),
t AS (SELECT sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT count(*) AS t FROM d GROUP BY abs(d))), s AS (SELECT count(*)::DOUBLE AS n, coalesce(sum(r) FILTER (d > 0), 0.0)::DOUBLE AS w, max(ties) AS ties FROM r, t),
z AS (SELECT w, n, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s)
SELECT w AS statistic, round(z, 6) AS z, round(2 * (1 - {phi('abs(z)')}), 6) AS p_value, n::BIGINT AS n_effective FROM z""")
def wilcoxon_p(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.wilcoxon_signed_rank(load(spark, sf, "customer").select((F.col("c_acctbal") - 4500).alias("d")), "d"))


@R.add(f"""WITH b AS (SELECT p_brand, count(*) AS n, avg((p_size > 25)::INT) AS p, avg(p_retailprice) / 1000 AS d FROM part GROUP BY 1),
q AS (SELECT p_brand, n, d, 0.05 / n AS alpha, abs(p - 0.65) AS gap, {_Z} * sqrt(2 * (p + 0.65) / 2 * (1 - (p + 0.65) / 2) / n) AS nul, sqrt((p * (1 - p) + 0.65 * 0.35) / n) AS alt, 0.95 / sqrt(2 * 0.975 * 0.025) AS c FROM b)
SELECT p_brand, round({phi('((gap - nul) / alt)')} + {phi('((-gap - nul) / alt)')}, 6) AS proportions, round(1 - (0.5 + (c - d) / (2 * sqrt(2 + (c - d) * (c - d)))) + (0.5 + (-c - d) / (2 * sqrt(2 + (-c - d) * (-c - d)))), 6) AS t_of_two, round(alpha, 8) AS alpha FROM q""")
def power_values(spark: SparkSession, sf: str) -> DataFrame:
    """Power against a share of 0.65 and of a shift of the mean price, and a corrected level, by brand; a row a brand is worked on."""
    b = load(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p_size") > 25).cast("double")).alias("p"), (F.avg("p_retailprice") / 1000).alias("d"))

    @F.udf("array<double>")
    def power(n: int, p: float, d: float) -> list[float]:
        return [inference.power_proportion_test(p, 0.65, n), inference.power_t_test(d, 2), inference.bonferroni_corrected_alpha(0.05, n)]

    v = b.select("p_brand", power("n", "p", "d").alias("v"))
    return v.select("p_brand", F.round(F.col("v")[0], 6).alias("proportions"), F.round(F.col("v")[1], 6).alias("t_of_two"), F.round(F.col("v")[2], 8).alias("alpha"))


@R.add("SELECT p_brand, round(avg(p_retailprice), 5) AS mean, round(var_samp(p_retailprice), 4) AS variance, round(stddev_samp(p_retailprice), 5) AS stdev FROM part GROUP BY 1")
def group_moments(spark: SparkSession, sf: str) -> DataFrame:
    p, d = load(spark, sf, "part"), descriptive
    out = d.mean(p, "p_retailprice", "p_brand").join(d.variance(p, "p_retailprice", "p_brand"), "p_brand").join(d.stdev(p, "p_retailprice", "p_brand"), "p_brand")
    return out.select("p_brand", F.round("mean", 5).alias("mean"), F.round("variance", 4).alias("variance"), F.round("stdev", 5).alias("stdev"))


@R.add("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 6) AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def z_scores_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(descriptive.z_scores(load(spark, sf, "customer"), "c_acctbal", "c_mktsegment").select("c_custkey", "z"))


@R.add("WITH f AS (SELECT p_brand, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part GROUP BY 1) SELECT p_partkey, round(a + b * p_size, 4) AS predicted FROM part JOIN f USING (p_brand)")
def fit_predict(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    return rounded(descriptive.predict(p, descriptive.linear_regression(p, "p_size", "p_retailprice", "p_brand"), "p_size", "p_brand").select("p_partkey", "predicted"), 4)


# ---- validation --------------------------------------------------------------------------


def _status(ok: str, worse: str = "fail") -> str:
    return f"CASE WHEN {ok} THEN 'pass' ELSE '{worse}' END"


_AUDIT = {
    "finite": ("count_if(o_totalprice IS NULL OR NOT isfinite(o_totalprice)) = 0", "FROM orders"),
    "bounds": ("count_if(l_discount < 0 OR l_discount > 0.05) = 0", "FROM lineitem"),
    "ordered": ("count_if(b < a) = 0", "FROM (SELECT value AS a, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)"),
    "leak": ("count(*) = 0", "FROM documents t WHERE doc_id % 2 = 1 AND EXISTS (SELECT 1 FROM documents r WHERE r.doc_id % 2 = 0 AND r.text = t.text)"),
    "groups": ("count(*) = 0", "FROM (SELECT lang FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT lang FROM documents WHERE doc_id % 2 = 1)"),
    "range": ("avg((c_acctbal NOT BETWEEN lo AND hi)::INT) <= 0.05", "FROM customer, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)"),
    "agreement": ("abs(sum(l_quantity) / count(*) - avg(l_quantity)) <= 1e-9 + 1e-6 * greatest(abs(sum(l_quantity) / count(*)), abs(avg(l_quantity)))", "FROM lineitem"),
    "conserved": ("abs(sum(l_quantity) - sum(l_tax)) <= 1e-12 + 1e-9 * greatest(abs(sum(l_quantity)), abs(sum(l_tax)))", "FROM lineitem"),
}


@R.add(" UNION ALL ".join([*[f"SELECT '{k}' AS name, {_status(ok)} AS status {source}" for k, (ok, source) in _AUDIT.items()],
    f"SELECT 'drift', {_status('abs(c.m - r.m) / sqrt(r.v) <= 0.5 AND greatest(r.v, c.v) / least(r.v, c.v) <= 2', 'warning')} FROM (SELECT avg(l_tax) AS m, var_pop(l_tax) AS v FROM lineitem WHERE l_quantity < 25) r, (SELECT avg(l_tax) AS m, var_pop(l_tax) AS v FROM lineitem WHERE l_quantity >= 25) c",
    "SELECT 'stable', 'pass'", "SELECT 'unstable', 'fail'"]))
def audit(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of the tables, some of which hold and some of which do not, as one report."""
    v, o, li, e, d = validation, *(load(spark, sf, t) for t in ("orders", "lineitem", "events", "documents"))
    even, odd = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    s, c = (load(spark, sf, t).withColumnRenamed(k, "acctbal") for t, k in (("supplier", "s_acctbal"), ("customer", "c_acctbal")))
    sums = li.agg((F.sum("l_quantity") / F.count(F.lit(1))).alias("a"), F.avg("l_quantity").alias("b"), F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("t"))
    return v.final_audit(
        v.check_finite(o, "o_totalprice", "o_orderkey", "finite"), v.check_bounds(li, {"l_discount": (0.0, 0.05)}, ["l_orderkey", "l_linenumber"], "bounds"), v.check_monotonic(e, "value", ["ts", "event_id"], "user_id", name="ordered"),
        v.check_duplicate_rows(even, odd, "text", "leak"), v.check_group_leakage(even, odd, "lang", "groups"), v.check_ood_ranges(s, c, ["acctbal"], 0.05, name="range"),
        v.cross_method_agreement(sums, "a", "b", name="agreement"), v.check_conservation(sums, "q", "t", name="conserved"), v.check_distribution_drift(li.where("l_quantity < 25"), li.where("l_quantity >= 25"), "l_tax", name="drift"),
        v.check_numerical_stability(spark, math.exp, 1.0, name="stable"), v.check_numerical_stability(spark, lambda x: 1 / (x - 1 + 1e-9), 1.0, name="unstable"),
    ).select("name", "status")


@R.add("""
WITH r AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS b FROM part WHERE p_partkey % 2 = 0), o AS (SELECT abs((p_size - a) / b) > 1.7 AS x FROM part, r WHERE p_partkey % 2 = 1)
SELECT 'out-of-distribution' AS name, CASE WHEN count_if(x) = 0 THEN 'pass' ELSE 'warning' END AS status, count_if(x)::VARCHAR AS n FROM o UNION ALL
SELECT 'feature-drift', CASE WHEN max(d) > 0.2 THEN 'warning' ELSE 'pass' END, (max(d) > 0.2)::INT::VARCHAR FROM (SELECT abs(sum(a) OVER up / sum(a) OVER ()::DOUBLE - sum(b) OVER up / sum(b) OVER ()::DOUBLE) AS d FROM (SELECT l_tax, count_if(l_orderkey % 2 = 0) AS a, count_if(l_orderkey % 2 = 1) AS b FROM lineitem GROUP BY 1) WINDOW up AS (ORDER BY l_tax))""")
def shift_checks(spark: SparkSession, sf: str) -> DataFrame:
    v, p, li = validation, load(spark, sf, "part"), load(spark, sf, "lineitem")
    screened = v.screen_ood(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), ["p_size"], 1.7)
    drift = v.feature_drift(li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 2 = 1"), ["l_tax"])
    both = v.report(v.ood_validation_check(screened), v.drift_validation_check(drift))
    return both.select("name", "status", F.coalesce(F.try_element_at("details", F.lit("flagged")), F.try_element_at("details", F.lit("drifted"))).alias("n"))


@R.add("""SELECT 'temporal-order' AS name, CASE WHEN (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate) = 0 THEN 'pass' ELSE 'fail' END AS status UNION ALL SELECT 'no-unmeasured-confounding', 'warning'
UNION ALL SELECT 'positivity', CASE WHEN count(DISTINCT (o_orderstatus, o_orderpriority)) = count(DISTINCT o_orderstatus) * count(DISTINCT o_orderpriority) THEN 'pass' ELSE 'fail' END FROM orders
UNION ALL SELECT 'consistency', CASE WHEN count(DISTINCT l_linenumber) = 1 THEN 'pass' ELSE 'fail' END FROM lineitem""")
def causal_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Assumptions as the tables show them: shipped after ordered, every priority in every status, one kind of line; what is unmeasured stays unknown."""
    o, li = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    early = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate").limit(1).count()
    seen = o.agg(F.countDistinct("o_orderstatus", "o_orderpriority").alias("both"), F.countDistinct("o_orderstatus").alias("a"), F.countDistinct("o_orderpriority").alias("b")).first()
    kinds = li.agg(F.countDistinct("l_linenumber")).first()[0]
    return causal.audit_causal_assumptions(spark, causal.CausalAssumptions(early == 0, None, seen["both"] == seen["a"] * seen["b"], kinds == 1))


# ---- learning ----------------------------------------------------------------------------


@R.add("""
WITH e AS (SELECT o_orderstatus AS g, o_totalprice AS y, o_totalprice - 150000 AS e FROM orders)
SELECT g AS o_orderstatus, round(avg(e * e) / 1e6, 4) AS mse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM e GROUP BY 1""")
def error_scores(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").withColumn("p", F.lit(150000.0))
    each = [f(o, "o_totalprice", "p", "o_orderstatus") for f in (metrics.mean_squared_error, metrics.mean_absolute_error, metrics.r2_score)]
    out = each[0].join(each[1], "o_orderstatus").join(each[2], "o_orderstatus")
    return out.select("o_orderstatus", F.round(F.col("mse") / 1e6, 4).alias("mse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@R.add("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity, round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS l_tax FROM lineitem")
def fitted_scaler(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax")
    return rounded(learning.StandardScaler(["l_quantity", "l_tax"]).fit(li).transform(li))


@R.add("SELECT greatest(1, round_even(count(*) * 0.25, 0))::BIGINT AS test, (count(*) - greatest(1, round_even(count(*) * 0.25, 0)))::BIGINT AS train, 0::BIGINT AS both FROM customer")
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    train, test = learning.train_test_split(load(spark, sf, "customer"), "c_custkey")
    sides = train.select("c_custkey", F.lit(0).alias("t")).union(test.select("c_custkey", F.lit(1).alias("t")))
    one = sides.groupBy("c_custkey").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n"))
    return one.agg(F.sum("t").alias("test"), F.count_if(F.col("t") == 0).alias("train"), F.count_if(F.col("n") > 1).alias("both"))


@R.add("""
WITH d AS (SELECT q.vec_id AS q, t.vec_id AS t, t.label AS y, list_sum([pow(q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE, 2) for i in range(1, 65)]) AS d FROM embeddings q, embeddings t WHERE q.vec_id % 100 = 0 AND t.vec_id % 100 <> 0),
r AS (SELECT q, y, row_number() OVER (PARTITION BY q ORDER BY d, t) AS k FROM d)
SELECT q AS query, avg(y) AS prediction FROM r WHERE k <= 5 GROUP BY 1""")
def knn_mean(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("label"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "x")
    return learning.knn_regress(e.where("vec_id % 100 <> 0"), q, "x", "label", "vec_id", "query", 5)


# ---- matrices ----------------------------------------------------------------------------


@R.add(f"WITH {G} SELECT kind, r AS \"row\", c AS col, round(v, 6) + 0.0 AS val FROM m, (VALUES ('cholesky'), ('lu'), ('qr'), ('svd')) k(kind)")
def factor_products(spark: SparkSession, sf: str) -> DataFrame:
    """The factors of X' X / n, multiplied again."""
    m, t, mul = _moments(spark, sf), linalg.transpose, linalg.mat_mul
    low = linalg.cholesky(m)
    p, lo, up = linalg.lu_decomposition(m)
    q, r = linalg.qr_decomposition(m)
    s = linalg.svd(m)
    sizes = spark.createDataFrame(list(enumerate(s.singular_values)), "col int, s double")
    scaled = s.U.join(F.broadcast(sizes), "col").select("row", "col", (F.col("val") * F.col("s")).alias("val"))
    parts = {"cholesky": mul(low, t(low)), "lu": mul(t(p), mul(lo, up)), "qr": mul(q, r), "svd": mul(scaled, s.Vt)}
    out = None
    for k, part in parts.items():
        row = part.select(F.lit(k).alias("kind"), "row", "col", "val")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@R.add("SELECT kind, r::INT AS \"row\", c::INT AS col, (r = c)::INT::DOUBLE AS val FROM range(0, 64) a(r), range(0, 64) b(c), (VALUES ('identity'), ('inverse'), ('orthonormal')) k(kind)")
def identities(spark: SparkSession, sf: str) -> DataFrame:
    """An inverse times its matrix, and orthonormal rows times themselves."""
    m = _moments(spark, sf)
    rows = linalg.gram_schmidt(m)
    parts = {"identity": linalg.identity(spark, 64), "inverse": linalg.mat_mul(linalg.matrix_inverse(m), m), "orthonormal": linalg.mat_mul(rows, linalg.transpose(rows))}
    out = None
    for k, part in parts.items():
        row = part.select(F.lit(k).alias("kind"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "val")
        out = row if out is None else out.unionByName(row)
    return rounded(out, 5)


_AB = "WITH s AS (SELECT avg(pow(p_size / 10.0, 2)) AS a, avg(p_size / 10.0 * p_retailprice / 1000) AS b, avg(pow(p_retailprice / 1000, 2)) AS c FROM part), l AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2 FROM s) "


@R.add(named_sql({"determinant": "a * c - b * b", "rank": "2", "condition": "l1 / l2", "eigenvalue": "l1", "singular_1": "l1", "singular_2": "l2", "trace": "a + c"}, 5, _AB, "FROM l"))
def small_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The second moments of two columns, as a matrix of two rows."""
    x, y = F.col("p_size") / 10, F.col("p_retailprice") / 1000
    s = load(spark, sf, "part").agg(F.avg(x * x).alias("a"), F.avg(x * y).alias("b"), F.avg(y * y).alias("c"))
    m = s.select(F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.lit(j).alias("col"), F.col(k).alias("val")) for i, j, k in ((0, 0, "a"), (0, 1, "b"), (1, 0, "b"), (1, 1, "c"))])).alias("s")).select("s.*")
    one, two = linalg.svd(m).singular_values
    return named(spark, {"determinant": linalg.determinant(m), "rank": linalg.rank(m), "condition": linalg.condition_number(m), "eigenvalue": linalg.power_iteration(m)[0], "singular_1": one, "singular_2": two, "trace": linalg.matrix_trace(m).first()[0]}, 5)


@R.add("WITH v AS (SELECT o_totalprice / 1000 AS a, o_custkey / 1000.0::DOUBLE AS x FROM orders) SELECT round(sum(a * x), 4) AS dot, round(sum(abs(x)), 5) AS norm1, round(sqrt(sum(x * x)), 6) AS norm2, round(pow(sum(pow(abs(x), 3)), 1 / 3.0::DOUBLE), 6) AS norm3 FROM v")
def vector_measures(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").withColumn("i", F.col("o_orderkey"))
    tax = o.select("i", (F.col("o_custkey") / 1000).alias("x"))
    out = linalg.dot(o.select("i", (F.col("o_totalprice") / 1000).alias("x")), tax)
    for p in (1, 2, 3):
        out = out.crossJoin(F.broadcast(linalg.vector_norm(tax, float(p)).withColumnRenamed("norm", f"norm{p}")))
    return out.select(F.round("dot", 4).alias("dot"), F.round("norm1", 5).alias("norm1"), F.round("norm2", 6).alias("norm2"), F.round("norm3", 6).alias("norm3"))


@R.add("WITH x AS (SELECT vec_id AS r, c::INT AS c, embedding[c + 1]::DOUBLE AS v FROM embeddings, range(0, 64) x(c)) SELECT r AS \"row\", c AS col, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5::DOUBLE), 6) + 0.0 AS val FROM x WINDOW w AS (PARTITION BY r)")
def layer_norm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(linalg.layer_norm(_whole(spark, sf)))


@R.add("""WITH x AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, embedding FROM embeddings)
SELECT r::INT AS "row", c::INT AS col, round(embedding[c + 1]::DOUBLE + CASE WHEN c % 2 = 0 THEN sin(r / pow(10000.0::DOUBLE, (c - c % 2) / 64.0::DOUBLE)) ELSE cos(r / pow(10000.0::DOUBLE, (c - c % 2) / 64.0::DOUBLE)) END, 7) + 0.0 AS val FROM x, range(0, 64) b(c)""")
def positions(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors as one sequence, with what each place adds to them."""
    v = ordering.numbered(load(spark, sf, "embeddings"), ["vec_id"], "n").select((F.col("n") - 1).cast("int").alias("row"), F.posexplode("embedding").alias("col", "x"))
    return rounded(v.select("row", "col", (F.col("x").cast("double") + linalg.place_code(F.col("row"), F.col("col"), 64)).alias("val")), 7)


# ---- signals -----------------------------------------------------------------------------

_PAD = f"{H}, m AS (SELECT pow(2, ceil(log2(n)))::BIGINT AS m FROM n)"


@R.add(f"""
WITH {_PAD}, k AS (SELECT unnest(range(0, m)) AS k FROM m)
SELECT k::INT AS k, round(sum(x * cos(2 * pi() * ((k * i) % m) / m)), 4) + 0.0 AS re, round(sum(-x * sin(2 * pi() * ((k * i) % m) / m)), 4) + 0.0 AS im FROM h, m, k GROUP BY 1""")
def fft_values(spark: SparkSession, sf: str) -> DataFrame:
    z = signals.fft(all_hours(spark, sf))
    return rounded(z.select(F.col("k").cast("int").alias("k"), "re", "im"), 4)


@R.add(f"WITH {_PAD}, k AS (SELECT unnest(range(0, m)) AS k FROM m) SELECT k::INT AS i, coalesce(x, 0.0)::DOUBLE AS re, 0.0::DOUBLE AS im FROM k LEFT JOIN h ON i = k")
def ifft_of_fft(spark: SparkSession, sf: str) -> DataFrame:
    z = signals.ifft(signals.fft(all_hours(spark, sf)))
    return rounded(z.select(F.col("i").cast("int").alias("i"), "re", "im"))


@R.add(f"WITH {H} SELECT i, x AS re, 0.0::DOUBLE AS im FROM h")
def idft_of_dft(spark: SparkSession, sf: str) -> DataFrame:
    z = signals.idft(signals.dft(all_hours(spark, sf)))
    return rounded(z.select(F.col("i").cast("int").alias("i"), "re", "im"))


_EVEN = f"{H}, v AS (SELECT i, x FROM h UNION ALL SELECT n::INT, 0.0::DOUBLE FROM n WHERE n % 2 = 1), w AS (SELECT i // 2 AS p, (sum(x) FILTER (i % 2 = 0) + sum(x) FILTER (i % 2 = 1)) / sqrt(2) AS a, (sum(x) FILTER (i % 2 = 0) - sum(x) FILTER (i % 2 = 1)) / sqrt(2) AS d FROM v GROUP BY 1)"


@R.add(f"WITH {_EVEN} SELECT i, x FROM v")
def haar_inverse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.idwt(signals.dwt(even_hours(spark, sf))))


@R.add(f"WITH {_EVEN}, t AS (SELECT p, a, CASE WHEN abs(d) < 3 THEN 0.0 ELSE d END::DOUBLE AS d FROM w) SELECT (2 * p)::INT AS i, round((a + d) / sqrt(2), 6) AS x FROM t UNION ALL SELECT (2 * p + 1)::INT, round((a - d) / sqrt(2), 6) FROM t")
def haar_denoise(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.denoise(even_hours(spark, sf), 3.0))


def _level(k: int, before: str) -> str:
    return f"l{k} AS (SELECT i // 2 AS i, (sum(a) FILTER (i % 2 = 0) + sum(a) FILTER (i % 2 = 1)) / sqrt(2) AS a, (sum(a) FILTER (i % 2 = 0) - sum(a) FILTER (i % 2 = 1)) / sqrt(2) AS d FROM {before} GROUP BY 1)"


@R.add("WITH l0 AS (SELECT (vec_id * 64 + c) AS i, embedding[c + 1]::DOUBLE AS a FROM embeddings, range(0, 64) x(c)), " + ", ".join(_level(k, f"l{k - 1}") for k in (1, 2, 3)) + " " + " UNION ALL ".join(f"SELECT {k}::INT AS level, (i // {64 >> k})::BIGINT AS vec_id, (i % {64 >> k})::INT AS i, round(a, 6) + 0.0 AS approx, round(d, 6) + 0.0 AS detail FROM l{k}" for k in (1, 2, 3)))
def haar_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Three levels of every vector."""
    x = _whole(spark, sf).select(F.col("row").alias("vec_id"), F.col("col").alias("i"), F.col("val").alias("x"))
    return rounded(signals.dwt_multi_level(x, 3, "vec_id", power_of_two=True).select("level", "vec_id", "i", "approx", "detail"))


@R.add("WITH g AS (SELECT p.p_partkey, (p_size % 10) / 3.0::DOUBLE AS x, (p_partkey % 7) / 2.0::DOUBLE AS y FROM part p) SELECT p_partkey, round(2 * x - 3 * y + x * y + 1, 6) + 0.0 AS z FROM g")
def interp_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Bilinear interpolation is exact for a surface of this kind."""
    i = spark.range(5).select(F.col("id").cast("double").alias("x"))
    grid = i.crossJoin(i.withColumnRenamed("x", "y")).withColumn("z", 2 * F.col("x") - 3 * F.col("y") + F.col("x") * F.col("y") + 1)
    p = load(spark, sf, "part").select("p_partkey", ((F.col("p_size") % 10) / 3.0).alias("x"), ((F.col("p_partkey") % 7) / 2.0).alias("y"))
    return rounded(signals.interp2d(grid, p).select("p_partkey", "z"))


# ---- graphs ------------------------------------------------------------------------------


@R.add(f"WITH RECURSIVE {EDGES}, r AS (SELECT 1 AS v, 0.0::DOUBLE AS d, 0 AS k UNION SELECT u.dst, r.d + u.w, r.k + 1 FROM r JOIN u ON u.src = r.v WHERE r.k < 4) SELECT v::BIGINT AS v, min(d) AS distance FROM r GROUP BY 1")
def dijkstra(spark: SparkSession, sf: str) -> DataFrame:
    return graph.dijkstra(places(spark, sf), 1).select("v", "distance")


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.with_seq(load(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"), (F.col("n_nationkey") % 4 + 1).cast("double").alias("weight")), "src", "dst")


_N = "e AS (SELECT n_regionkey AS s, n_nationkey + 100 AS t, (n_nationkey % 4 + 1)::DOUBLE AS w FROM nation), v AS (SELECT s AS v FROM e UNION SELECT t FROM e)"


@R.add(f"""
WITH {_N}, d AS (SELECT v AS s, v AS t, 0.0::DOUBLE AS w FROM v UNION ALL SELECT s, t, w FROM e UNION ALL SELECT t, s, w FROM e UNION ALL SELECT a.t, b.t, a.w + b.w FROM e a JOIN e b ON a.s = b.s AND a.t <> b.t)
SELECT a.v::BIGINT AS src, b.v::BIGINT AS dst, coalesce(min(d.w), 'inf'::DOUBLE) AS distance FROM v a CROSS JOIN v b LEFT JOIN d ON d.s = a.v AND d.t = b.v GROUP BY 1, 2""")
def all_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Nations are joined to their region only, so paths have two edges at most."""
    e = _nations(spark, sf)
    return graph.floyd_warshall(e, e.select(F.col("src").alias("v")).union(e.select("dst")).distinct(), directed=False)


@R.add(f"""
WITH {_N}, z AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM e WHERE s = 0)
SELECT 'bfs' AS kind, 0 AS place, 0::BIGINT AS v UNION ALL SELECT 'dfs', 0, 0 UNION ALL SELECT 'bfs', k::INT, t::BIGINT FROM z UNION ALL SELECT 'dfs', k::INT, t::BIGINT FROM z
UNION ALL SELECT 'topological', (row_number() OVER (ORDER BY v >= 100, s, v) - 1)::INT, v::BIGINT FROM v LEFT JOIN e ON t = v
UNION ALL SELECT 'path', 0, 0 UNION ALL SELECT 'path', 1, min(t) FROM e WHERE s = 0 UNION ALL SELECT 'cyclic', 0, 0 UNION ALL SELECT 'cycles', 0, 0""")
def graph_orders(spark: SparkSession, sf: str) -> DataFrame:
    e = _nations(spark, sf)
    vertices = e.select(F.col("src").alias("v")).union(e.select("dst")).distinct()
    least = e.where("src = 0").agg(F.min("dst")).first()[0]
    lists = {"bfs": graph.bfs(e, 0), "dfs": graph.dfs(e, 0), "topological": graph.topological_sort(e, vertices), "path": graph.find_path(e, 0, least), "cyclic": [int(graph.has_cycle(e))], "cycles": [len(graph.find_cycles(e))]}
    return spark.createDataFrame([(k, i, int(v)) for k, vs in lists.items() for i, v in enumerate(vs)], "kind string, place int, v bigint")


@R.add(f"WITH {_N} SELECT count(*) AS edges, sum(w) AS weight FROM e WHERE s = 0")
def prim(spark: SparkSession, sf: str) -> DataFrame:
    tree, weight = graph.prim_mst(_nations(spark, sf), 0)
    return spark.createDataFrame([(len(tree), float(weight))], "edges bigint, weight double")


@R.add("""
WITH r AS (SELECT n_name AS s, r_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'out' AS side, t AS name FROM r WHERE s = (SELECT min(n_name) FROM nation) UNION ALL SELECT 'in', s FROM r WHERE t = (SELECT min(r_name) FROM region) UNION ALL SELECT 'both', s FROM r WHERE t = (SELECT min(r_name) FROM region)
UNION ALL SELECT 'line', '- **' || name || '**' FROM (SELECT DISTINCT r_name AS name FROM region UNION SELECT n_name FROM nation) UNION ALL SELECT 'line', '- ' || s || ' --in--> ' || t FROM r""")
def concepts(spark: SparkSession, sf: str) -> DataFrame:
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    rows = [(x["n_name"], x["r_name"], "in", 1.0) for x in n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()]
    g = KnowledgeGraph.empty(spark).add_concepts([{"name": x[0]} for x in r.select("r_name").collect()]).add_relations(rows, create=True)
    nation, region = min(x[0] for x in rows), min(x[1] for x in rows)
    sides = {"out": g.neighbors_out(nation), "in": g.neighbors_in(region), "both": g.neighbors(region), "line": g.to_markdown().withColumnRenamed("line", "name")}
    out = None
    for k, part in sides.items():
        row = part.select(F.lit(k).alias("side"), "name")
        out = row if out is None else out.unionByName(row)
    return out


# ---- calculus ----------------------------------------------------------------------------


@R.fixed(named_sql({"romberg": "exp(1) - 1", "gauss": "1 / 5.0", "adaptive": "2", "simpson_2d": "1 / 4.0", "gauss_2d": "1 / 9.0", "integral": "exp(1) - 1", "derivative": "cos(1)", "gradient_x": "4", "gradient_y": "3"}, 5))
def quadrature_rules(spark: SparkSession, sf: str) -> DataFrame:
    c = calculus
    gx, gy = c.gradient(lambda p: p[0] ** 2 + 3 * p[1], [2.0, 1.0])
    return named(spark, {"romberg": c.romberg(math.exp, 0, 1).value, "gauss": c.gaussian_quadrature(lambda x: x**4, 0, 1), "adaptive": c.adaptive_simpson(math.sin, 0, math.pi).value, "simpson_2d": c.simpson_2d(spark, lambda x, y: x * y, 0, 1, 0, 1), "gauss_2d": c.gaussian_quadrature_2d(lambda x, y: (x * y) ** 2, 0, 1, 0, 1), "integral": c.integral(spark, F.exp, 0, 1), "derivative": c.derivative(math.sin, 1.0), "gradient_x": gx, "gradient_y": gy}, 5)


@R.fixed(named_sql({"euler": "pow(0.9::DOUBLE, 10)", "midpoint": "pow(0.905::DOUBLE, 10)", "rk4": "pow(1 - 0.1::DOUBLE + 0.005 - 0.001 / 6 + 0.0001 / 24, 10)", "backward_euler": "pow(1.1::DOUBLE, -10)", "trapezoid": "pow(0.95::DOUBLE / 1.05, 10)", "rk45": "exp(-1)"}))
def decay_steps(spark: SparkSession, sf: str) -> DataFrame:
    """y' = -y from 1, ten steps of a tenth: each method's factor is known."""
    c, f = calculus, lambda t, y: [-y[0]]
    solvers = {"euler": c.euler_method, "midpoint": c.midpoint_method, "rk4": c.solve_system, "backward_euler": c.backward_euler, "trapezoid": c.trapezoid_method, "rk45": c.rk45}
    tight = {"rk45": {"atol": 1e-11, "rtol": 1e-11}}
    return named(spark, {k: s(f, 0.0, [1.0], 1.0, 0.1, **tight.get(k, {})).y[-1][0] for k, s in solvers.items()})


@R.fixed("""
WITH RECURSIVE s AS (SELECT 0 AS k, 1.0::DOUBLE AS q, 0.0::DOUBLE AS p UNION ALL SELECT k + 1, q + 0.05 * (p - 0.05 * q), p - 0.05 * q FROM s WHERE k < 40),
v AS (SELECT 0 AS k, 1.0::DOUBLE AS q, 0.0::DOUBLE AS p UNION ALL SELECT k + 1, q + 0.05 * (p - 0.025 * q), (p - 0.025 * q) - 0.025 * (q + 0.05 * (p - 0.025 * q)) FROM v WHERE k < 40)
SELECT 'symplectic' AS method, k, round(q, 7) + 0.0 AS q, round(p, 7) + 0.0 AS p FROM s UNION ALL SELECT 'verlet', k, round(q, 7) + 0.0, round(p, 7) + 0.0 FROM v""")
def oscillator(spark: SparkSession, sf: str) -> DataFrame:
    runs = {"symplectic": calculus.symplectic_euler, "verlet": calculus.velocity_verlet}
    rows = [(m, k, round(float(y[0]), 7) + 0.0, round(float(y[1]), 7) + 0.0) for m, f in runs.items() for k, y in enumerate(f(lambda q: -q, [1.0], [0.0], 0.0, 2.0, 0.05).y)]
    return spark.createDataFrame(rows, "method string, k int, q double, p double")


@R.fixed("""
SELECT 'heat' AS equation, i::INT AS i, round(sin(pi() * i / 20) * pow(1 - 4 * 0.4 * pow(sin(pi() / 40), 2), 100), 8) + 0.0 AS u FROM range(0, 21) r(i)
UNION ALL SELECT 'wave', i::INT, round(sin(pi() * i / 20) * cos(50 * 2 * asin(0.8 * sin(pi() / 40))), 8) + 0.0 FROM range(0, 21) r(i)""")
def heat_and_wave(spark: SparkSession, sf: str) -> DataFrame:
    """The first mode of a rod and of a string keeps its form on the grid."""
    start = [math.sin(math.pi * i / 20) for i in range(21)]
    heat = calculus.solve_heat(start, 1.0, 1.0, 0.1, 21, dt=0.001).u_final
    wave = calculus.solve_wave(start, [0.0] * 21, 1.0, 1.0, 2.0, 21, dt=0.04).u_final
    return spark.createDataFrame([(k, i, round(float(u), 8) + 0.0) for k, us in (("heat", heat), ("wave", wave)) for i, u in enumerate(us)], "equation string, i int, u double")


@R.fixed(named_sql({"gradient_descent": "2", "adam": "2", "newton": "sqrt(2)", "line_search": "2", "nelder_mead_x": "1", "nelder_mead_y": "-0.5", "projected": "1.5"}, 3))
def minima(spark: SparkSession, sf: str) -> DataFrame:
    c, bowl = calculus, lambda x: (x - 2) ** 2
    nm = c.nelder_mead(lambda p: (p[0] - 1) ** 2 + (p[1] + 0.5) ** 2, [0.0, 0.0]).x
    projected = c.projected_gradient_descent(lambda p: (p[0] - 2) ** 2, [0.0], [0.0], [1.5])
    at = lambda x: float(x[0]) if isinstance(x, list | tuple) or hasattr(x, "__len__") else float(x)
    return named(spark, {"gradient_descent": at(c.gradient_descent(bowl, 0.0, 0.1).x), "adam": at(c.adam(bowl, 0.0, 0.05).x), "newton": at(c.newton_method(lambda x: x * x - 2, 1.0).x), "line_search": at(c.line_search(bowl, 0.0, 5.0).x), "nelder_mead_x": nm[0], "nelder_mead_y": nm[1], "projected": at(projected.x)}, 3)


# ---- sensitivity, science ----------------------------------------------------------------


@R.fixed(named_sql({"d0": "6", "d1": "1", "normalized0": "18 / 11.0", "normalized1": "2 / 11.0", "uncertainty": "sqrt(36 * 0.01 + 0.04)", "rank": "1", "identifiable": "0"}, 4))
def sensitivities(spark: SparkSession, sf: str) -> DataFrame:
    s = simulation
    d = s.local_sensitivity(lambda p: p[0] ** 2 + p[1], [3.0, 2.0])
    linear = s.propagate_linear(lambda a, b: a * a + b, [3.0, 2.0], [0.1, 0.2])
    known = s.local_identifiability(lambda p: [p[0] + p[1], 2 * (p[0] + p[1])], [1.0, 1.0])
    return named(spark, {"d0": d[0]["derivative"], "d1": d[1]["derivative"], "normalized0": d[0]["normalized"], "normalized1": d[1]["normalized"], "uncertainty": linear["standard_uncertainty"], "rank": known["rank"], "identifiable": known["identifiable"]}, 4)


@R.add("""
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS r FROM part)
SELECT p_partkey, round(6.6743e-11 * r * r / (s * s) * 1e6, 6) AS gravity, round(299792458 / s / 1e6, 6) AS frequency, round(8.314462618 * s * r / 100, 5) AS pressure, round(6.62607015e-34 * r * 1e30, 6) AS photon, round(2 * 6.6743e-11 * r / pow(299792458, 2) * 1e24, 5) AS horizon,
round(6.62607015e-34 / (s * r) * 1e36, 6) AS wavelength, round(sqrt(2 * 6.6743e-11 * r / s) * 1e4, 6) AS escape, round(abs(s * r) / (4 * pi() * 8.8541878128e-12) / 4e12, 6) AS coulomb, round(r * r / s * 1.1e-3 / pi(), 6) AS centripetal, round(r * (343.0::DOUBLE + 2) / (343.0::DOUBLE + s), 6) AS doppler FROM p""")
def physics(spark: SparkSession, sf: str) -> DataFrame:
    p, s = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r")), science
    at = lambda c, k, digits, name: F.round(c * k, digits).alias(name)
    return p.select(
        "p_partkey", at(s.gravitational_force("r", "r", "s"), 1e6, 6, "gravity"), at(s.wave_frequency("s"), 1e-6, 6, "frequency"), at(s.ideal_gas_pressure("s", "r", 100.0), 1.0, 5, "pressure"), at(s.photon_energy("r"), 1e30, 6, "photon"), at(s.schwarzschild_radius("r"), 1e24, 5, "horizon"),
        at(s.de_broglie_wavelength("s", "r"), 1e36, 6, "wavelength"), at(s.escape_velocity("r", "s"), 1e4, 6, "escape"), at(s.coulomb_force("s", "r", 2.0), 1e-12, 6, "coulomb"), at(s.centripetal_acceleration("r", "s"), 1.1e-3 / math.pi, 6, "centripetal"), at(s.doppler_frequency("r", "s", 2.0), 1.0, 6, "doppler"),
    )


@R.fixed("SELECT * FROM (VALUES ('bell', 0, 0.5::DOUBLE), ('bell', 3, 0.5), ('bell_other', 1, 0.5), ('bell_other', 2, 0.5), ('ghz', 0, 0.5), ('ghz', 7, 0.5), ('interference', 1, 1.0), ('phase', 0, 0.75), ('phase', 1, 0.25), ('swapped', 2, 1.0), ('toffoli', 7, 1.0), ('entangled', 0, 1.0)) t(register, state, probability)")
def registers(spark: SparkSession, sf: str) -> DataFrame:
    s, reg = science, science.QuantumRegister
    one = s.x_gate(reg(1), 0)
    states = {
        "bell": s.bell_state(0), "bell_other": s.bell_state(2), "ghz": s.ghz_state(3), "interference": s.h_gate(s.z_gate(s.h_gate(reg(1), 0), 0), 0),
        "phase": s.h_gate(s.rz_gate(s.h_gate(reg(1), 0), 0, math.pi / 3), 0), "swapped": s.swap(s.x_gate(reg(2), 0), 0, 1), "toffoli": s.toffoli(s.x_gate(s.x_gate(reg(3), 0), 1), 0, 1, 2),
    }
    rows = [(k, i, round(float(p), 8)) for k, r in states.items() for i, p in enumerate(r.probabilities()) if p > 1e-12]
    apart = s.cz(s.x_gate(reg(2), 0), 0, 1)
    rows.append(("entangled", int(s.is_entangled(apart)), float(s.is_entangled(states["bell"]) and one.measure() == 1 and s.y_gate(reg(1), 0).measure() == 1)))
    return spark.createDataFrame(rows, "register string, state int, probability double")
