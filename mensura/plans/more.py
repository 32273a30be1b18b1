"""Queries of operators that others leave out: filters, transforms of matrices, files, hypotheses, notes, models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions import symbolic
from mensura.operators import linalg, signals, text, validation
from mensura.plans.common import Registry, load, rounded
from mensura.plans.text import H, all_hours
from mensura.plans.workflow import Domain, Hypothesis, HypothesisEvaluator
from mensura.sources import files
from mensura.sources.tables import shared_dir
from mensura.streaming import accumulators

R = Registry()

# ---- filters -----------------------------------------------------------------------------


def _response(name: str, c: signals.FilterCoefficients, n: int = 200) -> str:
    """A recursive CTE (k, h, h1): the response of a second order section to a single one."""
    return f"""{name} AS (SELECT 0 AS k, {c.b[0]!r}::DOUBLE AS h, 0.0::DOUBLE AS h1 UNION ALL
SELECT k + 1, CASE k + 1 WHEN 1 THEN {c.b[1]!r} WHEN 2 THEN {c.b[2]!r} ELSE 0 END::DOUBLE - {c.a[1]!r}::DOUBLE * h - {c.a[2]!r}::DOUBLE * h1, h FROM {name} WHERE k < {n})"""


def _folded(name: str, source: str, response: str, n: int = 200) -> str:
    return f"{name} AS (SELECT a.i, sum(z.h * b.x) AS x FROM {source} a JOIN {source} b ON b.i BETWEEN a.i - {n} AND a.i JOIN {response} z ON z.k = a.i - b.i GROUP BY a.i)"


_HIGH, _PASS, _STOP = signals.butter_highpass(2, 0.3), signals.butter_bandpass(2, 0.1, 0.4), signals.butter_bandstop(2, 0.1, 0.4)


@R.add(f"""WITH RECURSIVE {H}, {_response("hi", _HIGH)}, {_response("p1", _PASS.section1)}, {_response("p2", _PASS.section2)}, {_response("s1", _STOP.section1)}, {_response("s2", _STOP.section2)},
{_folded("high", "h", "hi")}, {_folded("f1", "h", "p1")}, {_folded("band", "f1", "p2")}, {_folded("g1", "h", "s1")}, {_folded("g2", "h", "s2")}
SELECT i, round(high.x, 6) + 0.0 AS high, round(band.x, 6) + 0.0 AS band, round(g1.x + g2.x, 6) + 0.0 AS stopped FROM high JOIN band USING (i) JOIN g1 USING (i) JOIN g2 USING (i)""")
def band_filters(spark: SparkSession, sf: str) -> DataFrame:
    """High pass, band pass (both sections in turn) and band stop (their sum) over all hours."""
    h = all_hours(spark, sf)
    each = {k: signals.apply_filter(h, c).withColumnRenamed("y", k) for k, c in (("high", _HIGH), ("band", _PASS), ("stopped", _STOP))}
    return rounded(each["high"].join(each["band"], "i").join(each["stopped"], "i"))


@R.add(f"""WITH {H}, k AS (SELECT unnest(range(0, n)) AS k FROM n), f AS (SELECT k, sum(x * cos(2 * pi() * ((k * i) % n) / n)) AS re, sum(-x * sin(2 * pi() * ((k * i) % n) / n)) AS im FROM h, n, k WHERE k < 20 OR k > n - 20 GROUP BY 1)
SELECT h.i, round(sum(re * cos(2 * pi() * ((k * h.i) % n) / n) - im * sin(2 * pi() * ((k * h.i) % n) / n)) / max(n), 6) + 0.0 AS re FROM f, h, n GROUP BY 1""")
def frequency_cut(spark: SparkSession, sf: str) -> DataFrame:
    """All hours without the frequencies from 20 to n - 20."""
    return rounded(signals.low_pass_filter(all_hours(spark, sf), 20).select(F.col("i").cast("int").alias("i"), "re"))


_PRODUCTS = "p AS (SELECT r, c, sum(embedding[r + 1]::DOUBLE * embedding[c + 1]::DOUBLE) AS v FROM embeddings, range(64) a(r), range(64) b(c) GROUP BY ALL)"


def _products(spark: SparkSession, sf: str) -> DataFrame:
    """X'X of all vectors as (row, col, val)."""
    cells = load(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("col", "val")).withColumnRenamed("vec_id", "row")
    return linalg.mat_mul(cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), cells)


@R.add(f"""WITH {_PRODUCTS}, one AS (SELECT r, k, sum(v * cos(2 * pi() * ((k * c) % 64) / 64)) AS re, sum(-v * sin(2 * pi() * ((k * c) % 64) / 64)) AS im FROM p, range(64) z(k) GROUP BY ALL)
SELECT q AS "row", k AS col, round(sum(re * cos(2 * pi() * ((q * r) % 64) / 64) + im * sin(2 * pi() * ((q * r) % 64) / 64)), 4) + 0.0 AS re, round(sum(im * cos(2 * pi() * ((q * r) % 64) / 64) - re * sin(2 * pi() * ((q * r) % 64) / 64)), 4) + 0.0 AS im FROM one, range(64) z(q) GROUP BY ALL""")
def matrix_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Both passes of the transform of all vectors' products."""
    z = signals.fft2(_products(spark, sf))
    return rounded(z.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "re", "im"), 4)


# ---- files -------------------------------------------------------------------------------


def _written_csv(spark: SparkSession, df: DataFrame) -> str:
    at = f"{shared_dir(spark)}/mensura/csv-{uuid.uuid4().hex}"
    df.write.option("header", True).option("sep", ";").csv(at)
    return at


@R.add("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last FROM orders GROUP BY ALL""")
def csv_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as CSV files, read again as text cells."""
    at = _written_csv(spark, load(spark, sf, "orders").drop("o_orderdate"))
    cells = files.load_csv(spark, at, ";")
    return cells.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"), F.max(F.col("o_orderkey").cast("long")).alias("last"))


@R.add("""WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity) AS rest, count(*) AS n FROM lineitem)
SELECT round(a, 5) AS intercept, round(b, 6) AS slope, n AS rows_seen, round(sqrt(rest / n), 4) AS rmse FROM r""")
def csv_linear_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A fit of lineitem's CSV cells in one pass."""
    at = _written_csv(spark, load(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"))
    fit = accumulators.fit_linear_csv_streaming(spark, at, ["l_quantity"], "l_extendedprice", ";")
    return spark.createDataFrame([(round(fit.intercept, 5), round(fit.coefficients[0], 6), fit.rows_seen, round(fit.rmse, 4))], "intercept double, slope double, rows_seen long, rmse double")


# ---- checks and hypotheses ---------------------------------------------------------------


@R.add("""WITH s AS (SELECT value - 50 AS r, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n, avg(value - 50) OVER () AS m FROM events), d AS (SELECT *, (r - m) * (lag(r) OVER (ORDER BY i) - m) AS p FROM s),
a AS (SELECT abs(avg(r)) / sqrt(var_samp(r) / count(*)) AS bias, abs(sum(p) / sum((r - m) ** 2)) AS lag1, var_pop(r) FILTER (i <= n // 2) AS v1, var_pop(r) FILTER (i > n // 2) AS v2 FROM d)
SELECT round(bias, 6) AS bias_z, round(lag1, 8) AS lag1, round(greatest(v1, v2) / least(v1, v2), 6) AS variance_ratio, CASE WHEN bias <= 2 AND lag1 <= 0.3 AND greatest(v1, v2) / least(v1, v2) <= 2 THEN 'pass' ELSE 'warning' END AS status FROM a""")
def residual_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Values of all events less 50 as residuals in the order of time."""
    e = load(spark, sf, "events").withColumn("r", F.col("value") - 50)
    found = validation.residual_diagnostics(e, "r", ["ts", "event_id"])
    status = validation.check_residual_diagnostics(e, "r", ["ts", "event_id"]).select("status")
    return found.select(F.round("bias_z", 6).alias("bias_z"), F.round("lag1", 8).alias("lag1"), F.round("variance_ratio", 6).alias("variance_ratio")).crossJoin(F.broadcast(status))


_T = "(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2))"


@R.add(f"""WITH g AS (SELECT avg(value) FILTER (event_type = 'click') AS m1, avg(value) FILTER (event_type = 'view') AS m2, var_samp(value) FILTER (event_type = 'click') AS v1, var_samp(value) FILTER (event_type = 'view') AS v2, count(*) FILTER (event_type = 'click') AS n1, count(*) FILTER (event_type = 'view') AS n2 FROM events),
f AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), w AS (SELECT sum(n * m) / sum(n) AS m FROM f),
p AS (SELECT avg(l_discount - l_tax) / sqrt(var_samp(l_discount - l_tax) / count(*)) AS t FROM lineitem), o AS (SELECT (avg(c_acctbal) - 4500) / sqrt(var_samp(c_acctbal) / count(*)) AS t FROM customer),
q AS (SELECT sum((n - e) ** 2 / e) AS x FROM (SELECT count(*)::DOUBLE AS n, avg(count(*)) OVER () AS e FROM orders GROUP BY o_orderpriority)),
c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), i AS (SELECT sum((coalesce(c.n, 0) - x.n * y.n / z.n) ** 2 / (x.n * y.n / z.n)) AS x FROM (SELECT a, sum(n) AS n FROM c GROUP BY 1) x, (SELECT b, sum(n) AS n FROM c GROUP BY 1) y, (SELECT sum(n) AS n FROM c) z LEFT JOIN c ON c.a = x.a AND c.b = y.b)
SELECT 'two' AS hypothesis_id, 'two-sample-t' AS test_name, round({_T}, 5) AS statistic FROM g UNION ALL
SELECT 'several', 'anova', round(sum(n * (f.m - w.m) ** 2) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*))), 5) FROM f, w UNION ALL
SELECT 'one', 'one-sample-t', round(t, 5) FROM o UNION ALL SELECT 'paired', 'paired-t', round(t, 5) FROM p UNION ALL SELECT 'fit', 'chi-square-gof', round(x, 5) FROM q UNION ALL SELECT 'independent', 'chi-square-independence', round(x, 5) FROM i""")
def hypothesis_tests(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of hypotheses, one of each kind of data."""
    e, li, o, c = (load(spark, sf, t) for t in ("events", "lineitem", "orders", "customer"))
    two = e.where(F.col("event_type").isin("click", "view"))
    data = {
        "two": {"groups": {"df": two, "value": "value", "group": "event_type"}}, "several": {"groups": {"df": e, "value": "value", "group": "event_type"}}, "one": {"one_sample": {"df": c, "value": "c_acctbal", "popmean": 4500.0}},
        "paired": {"paired": {"df": li, "first": "l_discount", "second": "l_tax"}}, "fit": {"chi_square_gof": {"df": o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("n")), "observed": "n"}},
        "independent": {"chi_square_independence": {"df": o, "a": "o_orderstatus", "b": "o_orderpriority"}},
    }
    made = [Hypothesis(f"{k} differ", Domain.GENERAL_SCIENCE, id=k) for k in data]
    found = HypothesisEvaluator(0.05).evaluate_batch(made, list(data.values()))
    return found.select("hypothesis_id", "test_name", F.round("statistic", 5).alias("statistic"))


# ---- notes, models -----------------------------------------------------------------------


@R.add("""SELECT 'tag' AS found, doc_id::VARCHAR AS id FROM documents WHERE lang = 'en' UNION ALL SELECT 'concept', doc_id::VARCHAR FROM documents WHERE source IN ('src0', 'src1') UNION ALL SELECT 'id', doc_id::VARCHAR FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)""")
def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as notes: by tag, by linked concept and by id."""
    d = load(spark, sf, "documents")
    n = d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("body"), F.array("lang").alias("tags"), F.array("source").alias("linked_concepts"))
    first = str(d.agg(F.min("doc_id")).first()[0])
    sides = {"tag": text.notes_by_tag(n, "en"), "id": text.get_note(n, first)}
    linked = text.notes_for_concept(n, "src0").unionByName(text.notes_for_concept(n, "src1"))
    out = linked.select(F.lit("concept").alias("found"), "id")
    for k, part in sides.items():
        out = out.unionByName(part.select(F.lit(k).alias("found"), "id"))
    return out


@R.add("""SELECT n_name AS id, CASE WHEN lower(n_name) = 'nation_1' THEN 1.0 ELSE 0.5 END::DOUBLE AS score, 'concept' AS kind FROM nation WHERE contains(lower(n_name), 'nation_1')
UNION ALL SELECT p_partkey::VARCHAR, CASE WHEN lower(p_name) = 'nation_1' THEN 1.0 ELSE 0.5 END::DOUBLE, 'note' FROM part WHERE contains(lower(p_name), 'nation_1') OR contains(lower(p_type), 'nation_1')""")
def concept_search(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as concepts and parts as notes."""
    concepts = load(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("").alias("description"), F.array().cast("array<string>").alias("tags"))
    parts = load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("body"), F.array().cast("array<string>").alias("tags"))
    return text.search(concepts, parts, "nation_1").select("id", "score", "kind")


@R.add("""SELECT p_partkey, round(sqrt(r) + sin(s) * cos(s) - exp(-s) / (1 + s) + ln(r) ** 2, 8) AS value, round(cos(s) ** 2 - sin(s) ** 2 + exp(-s) / (1 + s) + exp(-s) / (1 + s) ** 2, 8) + 0.0 AS slope, round(2 * sqrt(r) - 1, 8) AS scaled FROM (SELECT p_partkey, p_retailprice AS r, p_size::DOUBLE AS s FROM part)""")
def symbolic_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every kind of node, its derivative, and a model with a parameter, compiled to columns."""
    s, r = symbolic.Variable("s"), symbolic.Variable("r")
    value = symbolic.Sqrt(r) + symbolic.Sin(s) * symbolic.Cos(s) - symbolic.Exp(-s) / (symbolic.Constant(1.0) + s) + symbolic.Log(r) ** 2
    model = symbolic.MathModel("scaled", [("scaled", symbolic.Variable("k") * symbolic.Sqrt(r) - 1)], {"k": 2.0})
    p = load(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("r"), F.col("p_size").cast("double").alias("s"))
    return rounded(model.columns(p.withColumns({"value": value.column(), "slope": value.diff("s").column()})).select("p_partkey", "value", "slope", "scaled"), 8)
