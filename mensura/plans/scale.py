"""Queries of operators that take one long series, one stream or one large file in many tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators import frame, ordering, retrieval, signals, spectral, tall
from mensura.plans.common import Registry, load, rounded
from mensura.plans import text as plans_text
from mensura.plans.text import H, QUERY, all_hours
from mensura.sources import ranges
from mensura.sources.tables import shared_dir
from mensura.streaming import fits

R = Registry()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/mensura/{name}-{uuid.uuid4().hex}"


# ---- streams and files -------------------------------------------------------------------


@R.add("""SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 5) AS intercept,
round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity)) / count(*)), 4) AS rmse, count(*) AS rows_seen FROM lineitem GROUP BY ALL""")
def csv_stream_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem as CSV files, streamed in several batches; half of the files come after the stream has stopped, and it goes on from its checkpoint."""
    at = _folder(spark, "csv-stream")
    rows = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    half = F.pmod(F.xxhash64("l_extendedprice", "l_quantity"), F.lit(2))
    state = fits.FitState(spark, f"{at}/state", ["l_quantity"], "l_extendedprice", ["l_returnflag", "l_linestatus"])
    for i in (0, 1):
        rows.where(half == i).repartition(4).write.mode("append").option("header", True).csv(f"{at}/files")
        stream = fits.csv_stream(spark, f"{at}/files", "l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double", files_per_batch=2)
        fits.run_fit(stream, state, f"{at}/checkpoint")
    fit = state.fit()
    return fit.select("l_returnflag", "l_linestatus", F.round(F.col("coefficients")[0], 6).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("rmse", 4).alias("rmse"), "rows_seen")


@R.add("""WITH f AS (SELECT left(o_orderpriority, 1) AS part, string_agg(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || chr(10), '' ORDER BY o_orderkey) AS t FROM orders GROUP BY 1),
b AS (SELECT part, unnest(range((len(t) + 16383) // 16384)) AS block, t FROM f)
SELECT part, block, len(t[block * 16384 + 1 : (block + 1) * 16384]) AS n_bytes, sha256(t[block * 16384 + 1 : (block + 1) * 16384]) AS sha256 FROM b""")
def file_block_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as one text file a priority, read again in blocks of 16 KiB by ranges of two blocks."""
    at = _folder(spark, "blocks")
    lines = load(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).alias("part"), "o_orderkey", F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus").alias("line"))
    lines.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "line").write.partitionBy("part").text(at)
    blocks = ranges.byte_blocks(spark, at, 16384, 32768)
    return blocks.select(F.regexp_extract("path", "part=([^/]+)/", 1).alias("part"), "block", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha256"))


@R.add("""WITH r AS (SELECT vec_id // 200 AS file, row_number() OVER (PARTITION BY vec_id // 200 ORDER BY vec_id) - 1 AS i, list_sum([x::DOUBLE FOR x IN embedding]) AS s, list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]) AS q, len(embedding) AS width FROM embeddings)
SELECT file, i // 32 * 32 AS start, (min(i) + count(*))::BIGINT AS stop, round(sum(s), 6) AS total, round(sum(q), 6) AS squares, max(width)::BIGINT AS width FROM r GROUP BY file, i // 32""")
def array_slab_sums(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings as .npy files of 200 rows, summed by slabs of 32 rows."""
    at = _folder(spark, "slabs")
    vectors = load(spark, sf, "embeddings").withColumn("file", F.expr("vec_id div 200"))
    ranges.save_arrays(vectors, at, "embedding", "vec_id", "file").count()
    slabs = ranges.array_slabs(spark, at, rows=32)
    sums = slabs.select(F.regexp_extract("path", r"rows-(\d+)\.npy", 1).cast("long").alias("file"), "start", "stop", F.aggregate("values", F.lit(0.0), lambda s, v: s + v).alias("total"), F.aggregate("values", F.lit(0.0), lambda s, v: s + v * v).alias("squares"), "width")
    return rounded(sums)


# ---- one long series ---------------------------------------------------------------------

EVENTS = "e AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS i FROM events)"


@R.add(f"""WITH {EVENTS} SELECT a.event_id, round(sum(CASE WHEN b.i = 1 THEN 0.7::DOUBLE ** (a.i - 1) ELSE 0.3 * 0.7::DOUBLE ** (a.i - b.i) END * b.value), 6) AS smoothed
FROM e a JOIN e b ON b.i BETWEEN a.i - 90 AND a.i GROUP BY a.event_id""")
def event_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """All events in time order as one series; the SQL adds up weights until they are under 1e-14."""
    return rounded(ordering.smoothed(load(spark, sf, "events").select("event_id", "ts", "value"), "value", ["ts", "event_id"], alpha=0.3).select("event_id", "smoothed"))


_LOW = signals.butter_lowpass(2, 0.2)


@R.add(f"""WITH RECURSIVE {EVENTS},
h AS (SELECT 0 AS k, {_LOW.b[0]!r}::DOUBLE AS h, 0.0::DOUBLE AS h1 UNION ALL
SELECT k + 1, CASE k + 1 WHEN 1 THEN {_LOW.b[1]!r} WHEN 2 THEN {_LOW.b[2]!r} ELSE 0 END::DOUBLE - {_LOW.a[1]!r}::DOUBLE * h - {_LOW.a[2]!r}::DOUBLE * h1, h FROM h WHERE k < 120)
SELECT a.event_id, round(sum(h.h * b.value), 6) AS filtered FROM e a JOIN e b ON b.i BETWEEN a.i - 120 AND a.i JOIN h ON h.k = a.i - b.i GROUP BY a.event_id""")
def event_low_pass(spark: SparkSession, sf: str) -> DataFrame:
    """A second order low pass over all events in time order; the SQL folds them with the impulse response."""
    return rounded(ordering.iir_filtered(load(spark, sf, "events").select("event_id", "ts", "value"), "value", ["ts", "event_id"], _LOW.b, _LOW.a).select("event_id", "filtered"))


@R.add(f"""WITH {H}, m AS (SELECT (2 ** ceil(log2(n)))::BIGINT AS m FROM n), k AS (SELECT unnest(range(0, m)) AS k FROM m)
SELECT k, round(sum(x * cos(2 * pi() * ((k * i) % m) / m)), 6) + 0.0 AS re, round(sum(-x * sin(2 * pi() * ((k * i) % m) / m)), 6) + 0.0 AS im FROM h, m, k GROUP BY 1""")
def hours_long_fft(spark: SparkSession, sf: str) -> DataFrame:
    """All hours as one series, in blocks of 256 numbers, so that both steps are spread over tasks."""
    return rounded(spectral.long_fft(all_hours(spark, sf), block=256))


# ---- tall matrices -----------------------------------------------------------------------


@R.add("""WITH RECURSIVE p AS (SELECT i, j, sum(embedding[i]::DOUBLE * embedding[j]::DOUBLE) AS v FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL),
g AS (SELECT list(r ORDER BY i) AS g FROM (SELECT i, list(v ORDER BY j) AS r FROM p GROUP BY i)),
c AS (SELECT 1 AS t, []::DOUBLE[][] AS r, g FROM g UNION ALL
SELECT t + 1, list_append(r, [CASE WHEN j < t THEN 0 ELSE (g[t][j] - coalesce(list_sum([r[k][t] * r[k][j] FOR k IN range(1, t)]), 0)) / sqrt(g[t][t] - coalesce(list_sum([r[k][t] * r[k][t] FOR k IN range(1, t)]), 0)) END FOR j IN range(1, 65)]), g FROM c WHERE t <= 64)
SELECT i, j, round(r[i + 1][j + 1], 5) + 0.0 AS r FROM c, range(64) a(i), range(64) b(j) WHERE t = 65 AND i <= j""")
def tall_triangle(spark: SparkSession, sf: str) -> DataFrame:
    """R of all embeddings by a tree of triangles; the SQL is the Cholesky factor of their products."""
    r = tall.triangle(load(spark, sf, "embeddings"), "embedding")
    n = len(r)
    return rounded(spark.createDataFrame([(i, j, float(r[i, j])) for i in range(n) for j in range(i, n)], "i long, j long, r double"), 5)


@R.add("""WITH p AS (SELECT i, j, sum(embedding[i]::DOUBLE * embedding[j]::DOUBLE) AS v FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL)
SELECT round(sum(v) FILTER (i = j), 4) AS squares, round(sum(v * v) / 1e6, 4) AS fourths FROM p""")
def singular_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the second and fourth powers of all singular values, which are those of the products' trace and squares."""
    s, _ = tall.singular_values(load(spark, sf, "embeddings"), "embedding")
    return rounded(spark.createDataFrame([(float((s**2).sum()), float((s**4).sum() / 1e6))], "squares double, fourths double"), 4)


# ---- a stored index ----------------------------------------------------------------------


def _index(spark: SparkSession, sf: str) -> retrieval.InvertedIndex:
    """All documents, in two deltas."""
    index = retrieval.InvertedIndex(spark, _folder(spark, "index"))
    docs = load(spark, sf, "documents").select("doc_id", "text")
    for half in (0, 1):
        index.append(docs.where(F.col("doc_id") % 2 == half), "doc_id", "text")
    return index


@R.add(plans_text.R.sql["tfidf_rank"])
def index_search(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_index(spark, sf).search(QUERY).select(F.col("key").alias("doc_id"), "score"))


@R.add("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
i AS (SELECT term, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM f GROUP BY 1), n AS (SELECT doc_id, sqrt(sum((tf * idf) ** 2)) AS norm FROM f JOIN i USING (term) GROUP BY 1),
q AS (SELECT w AS term, m * idf AS q FROM (SELECT unnest(['the', 'of', 'and', 'thing']) AS w, unnest([2, 1, 1, 1]) AS m) JOIN i ON w = term), l AS (SELECT sqrt(sum(q * q)) AS l FROM q),
d AS (SELECT doc_id, sum(tf * idf * q) AS dot FROM f JOIN i USING (term) JOIN q USING (term) GROUP BY 1)
SELECT doc_id, round(dot / norm / l, 6) AS cosine FROM d JOIN n USING (doc_id), l WHERE dot > 0""")
def index_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_index(spark, sf).cosine(QUERY).select(F.col("key").alias("doc_id"), "cosine"))


@R.add("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), f AS (SELECT DISTINCT doc_id, term FROM t)
SELECT term, count(*) AS documents, round(ln((SELECT count(*) FROM documents)::DOUBLE / count(*)), 6) AS idf FROM f GROUP BY 1""")
def index_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_index(spark, sf).vocabulary())


# ---- grouping sets and sketches ----------------------------------------------------------


@R.add("""SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return frame.rollup(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@R.add("""SELECT o_orderstatus, o_orderpriority, year(o_orderdate)::INT AS year, grouping_id(o_orderstatus, o_orderpriority, year(o_orderdate))::BIGINT AS level, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority, year(o_orderdate))""")
def cube_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return rounded(frame.cube(orders, ["o_orderstatus", "o_orderpriority", "year"], F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")), 4)


@R.add("""SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS near FROM lineitem GROUP BY 1""")
def sketch_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct parts by a sketch with a relative standard error of 0.02: near where within 0.08 of their number."""
    items = load(spark, sf, "lineitem")
    exact = items.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("exact"))
    both = frame.approximate_distinct(items, "l_partkey", ["l_returnflag"], 0.02).join(exact, "l_returnflag")
    return both.select("l_returnflag", "exact", (F.abs(F.col("distinct") - F.col("exact")) <= 0.08 * F.col("exact")).alias("near"))
