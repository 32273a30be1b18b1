"""Queries over texts, sequences, signals, matrices, graphs and simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions import distributions
from mensura.operators import graph, linalg, signals, simulation, text
from mensura.plans.common import Registry, load, rounded

R = Registry()

QUERY = "the of and thing the"


@R.add("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), q AS (SELECT unnest(['the', 'of', 'and', 'thing']) AS w, unnest([2, 1, 1, 1]) AS m),
n AS (SELECT count(*)::DOUBLE AS n FROM t), f AS (SELECT doc_id, w, m, len(list_filter(t, lambda x: x = w)) AS f FROM t, q), d AS (SELECT w, count_if(f > 0) AS d FROM f GROUP BY 1),
s AS (SELECT doc_id, sum(CASE WHEN f > 0 THEN f * m * ln(n / d) ELSE 0 END) / sqrt(greatest(1, sum(CASE WHEN f > 0 THEN m ELSE 0 END))) AS score FROM f JOIN d USING (w), n GROUP BY 1)
SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0""")
def tfidf_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(text.rank_tfidf(load(spark, sf, "documents"), "doc_id", "text", QUERY))


@R.add("""SELECT doc_id, 0.5::DOUBLE AS score, CASE WHEN contains(lower(source), 'thand') THEN 'title' ELSE 'body' END AS matched_on FROM documents WHERE contains(lower(source), 'thand') OR contains(lower(text), 'thand')""")
def substring_search(spark: SparkSession, sf: str) -> DataFrame:
    return text.search_fields(load(spark, sf, "documents"), "doc_id", "source", "text", "Thand")


@R.add("""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) SELECT token, count(*) AS n FROM t GROUP BY 1""")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return text.token_counts(load(spark, sf, "documents"), "text")


def _dna(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").select("item_id", F.translate(F.regexp_replace(F.lower("text"), "[^adehinorst]", ""), "adehinorst", "ACGTACGTAC").alias("seq"))


DNA = "WITH d AS (SELECT item_id, translate(regexp_replace(lower(text), '[^adehinorst]', '', 'g'), 'adehinorst', 'ACGTACGTAC') AS s FROM benchmark)"


@R.add(DNA + " SELECT item_id, round((length(s) - length(replace(replace(s, 'G', ''), 'C', '')))::DOUBLE / length(s), 8) AS gc FROM d")
def gc_content(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(text.gc_content(_dna(spark, sf), "seq").select("item_id", "gc"), 8)


@R.add(DNA + " SELECT item_id, reverse(translate(s, 'ACGT', 'TGCA')) AS reverse_complement FROM d")
def revcomp(spark: SparkSession, sf: str) -> DataFrame:
    return text.reverse_complement(_dna(spark, sf), "seq").select("item_id", "reverse_complement")


@R.add(DNA + ", p AS (SELECT item_id, s, unnest(range(1, length(s) - 2)) AS place FROM d) SELECT item_id, place::INT AS place, substr(s, place::INT, 4) AS k_mer FROM p")
def kmers(spark: SparkSession, sf: str) -> DataFrame:
    return text.k_mers(_dna(spark, sf), "seq", 4)


@R.add()
def needleman_wunsch(spark: SparkSession, sf: str) -> DataFrame:
    d = text.reverse_complement(_dna(spark, sf), "seq")
    return text.needleman_wunsch(d, "seq", "reverse_complement").select("item_id", "alignment.*")


@R.add()
def bpe_encode(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    return text.encode_pairs(d.select("doc_id", "text"), "text", text.train_pairs(d, "text", 120)).select("doc_id", "ids")


# ---- signals -----------------------------------------------------------------------------


def all_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Events in each hour from the first to the last, none included; i counts from the first."""
    n = load(spark, sf, "events").where("ts is not null").groupBy(F.expr("unix_timestamp(ts) div 3600").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    ends = n.agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo is not null")
    hours = ends.select("lo", F.explode(F.sequence("lo", "hi")).alias("h"))
    return hours.join(n, "h", "left").select((F.col("h") - F.col("lo")).cast("int").alias("i"), F.coalesce("n", F.lit(0)).cast("double").alias("x"))


def even_hours(spark: SparkSession, sf: str) -> DataFrame:
    """all_hours, and an hour without events after the last one where their number is odd."""
    h = all_hours(spark, sf)
    n = h.agg(F.count(F.lit(1)).cast("int").alias("i"))
    return h.union(n.where("i % 2 = 1").select("i", F.lit(0.0).alias("x")))


H = """e AS (SELECT floor(epoch(ts))::BIGINT // 3600 AS h, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1), b AS (SELECT min(h) AS lo, max(h) AS hi FROM e),
r AS (SELECT lo, unnest(range(lo, hi + 1)) AS h FROM b), h AS (SELECT (r.h - lo)::INT AS i, coalesce(n, 0)::DOUBLE AS x FROM r LEFT JOIN e USING (h)), n AS (SELECT count(*) AS n FROM h)"""


@R.add(f"""
WITH {H}, k AS (SELECT unnest(range(0, n)) AS k FROM n), f AS (SELECT k, sum(x * cos(2 * pi() * ((k * i) % n) / n)) AS re, sum(-x * sin(2 * pi() * ((k * i) % n) / n)) AS im FROM h, n, k GROUP BY 1)
SELECT k::INT AS k, round((re * re + im * im) / n, 4) AS power FROM f, n""")
def dft_power(spark: SparkSession, sf: str) -> DataFrame:
    h = all_hours(spark, sf)
    z = signals.dft(h).crossJoin(F.broadcast(h.agg(F.count(F.lit(1)).alias("n"))))
    return rounded(z.select(F.col("k").cast("int").alias("k"), ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")).alias("power")), 4)


@R.add(f"WITH {H}, k AS (SELECT * FROM h WHERE i < 5) SELECT (h.i + k.i)::INT AS i, sum(h.x * k.x) AS x FROM h, k GROUP BY 1")
def convolve(spark: SparkSession, sf: str) -> DataFrame:
    h = all_hours(spark, sf)
    return signals.convolve(h, h.where("i < 5"))


@R.add(f"WITH {H} SELECT (i // 2)::INT AS i, round((sum(x) FILTER (i % 2 = 0) + coalesce(sum(x) FILTER (i % 2 = 1), 0)) / sqrt(2), 6) AS approx, round((sum(x) FILTER (i % 2 = 0) - coalesce(sum(x) FILTER (i % 2 = 1), 0)) / sqrt(2), 6) AS detail FROM h GROUP BY 1")
def haar_dwt(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.dwt(even_hours(spark, sf)))


@R.add(f"WITH {H}, f AS (SELECT unnest(range(0, greatest(0, ceil((n - 16) / 16.0))::BIGINT + 1)) AS f FROM n), g AS (SELECT f::INT AS frame, j::INT AS j FROM f, range(0, 16) b(j)) SELECT frame, j, coalesce(x, 0.0) AS x FROM g LEFT JOIN h ON i = frame * 16 + j")
def stft_frames(spark: SparkSession, sf: str) -> DataFrame:
    return signals.frame_signal(all_hours(spark, sf), 16, 16)


@R.add(f"""
WITH {H}, f AS (SELECT unnest(range(0, greatest(0, ceil((n - 32) / 8.0))::BIGINT + 1)) AS f FROM n), g AS (SELECT f, j, coalesce(x, 0.0)::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * j / 32)) AS y FROM f CROSS JOIN range(0, 32) b(j) LEFT JOIN h ON i = f * 8 + j),
z AS (SELECT f, k, sum(y * cos(2 * pi() * k * j / 32)) AS re, sum(-y * sin(2 * pi() * k * j / 32)) AS im FROM g, range(0, 17) c(k) GROUP BY 1, 2)
SELECT f::INT AS frame, k::INT AS k, round(sqrt(re * re + im * im), 5) AS magnitude FROM z""")
def stft_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    z = signals.stft(all_hours(spark, sf), 32)
    return rounded(z.select(F.col("frame").cast("int").alias("frame"), F.col("k").cast("int").alias("k"), "magnitude"), 5)


@R.add(f"""
WITH {H}, k AS (SELECT unnest(range(0, n)) AS k FROM n), f AS (SELECT k, sum(x * cos(2 * pi() * ((k * i) % n) / n)) AS re, sum(-x * sin(2 * pi() * ((k * i) % n) / n)) AS im FROM h, n, k GROUP BY 1)
SELECT k::INT AS k, round((re * re + im * im) / n, 4) AS power FROM f, n""")
def fft_power(spark: SparkSession, sf: str) -> DataFrame:
    z = signals.power_spectrum(all_hours(spark, sf))
    return rounded(z.select(F.col("k").cast("int").alias("k"), "power"), 4)


@R.add("SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))[len(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) // 2 + 1] AS moving_median FROM events")
def moving_median(spark: SparkSession, sf: str) -> DataFrame:
    return signals.moving_median(load(spark, sf, "events"), "value", ["ts", "event_id"], 5, "user_id").select("event_id", "moving_median")


_LOW = signals.butter_lowpass(2, 0.2)


@R.add(f"""WITH RECURSIVE {H}, z AS (SELECT 0 AS k, {_LOW.b[0]!r}::DOUBLE AS h, 0.0::DOUBLE AS h1 UNION ALL
SELECT k + 1, CASE k + 1 WHEN 1 THEN {_LOW.b[1]!r} WHEN 2 THEN {_LOW.b[2]!r} ELSE 0 END::DOUBLE - {_LOW.a[1]!r}::DOUBLE * h - {_LOW.a[2]!r}::DOUBLE * h1, h FROM z WHERE k < 150)
SELECT a.i, round(sum(z.h * b.x), 8) + 0.0 AS y FROM h a JOIN h b ON b.i BETWEEN a.i - 150 AND a.i JOIN z ON z.k = a.i - b.i GROUP BY a.i""")
def butter_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The SQL folds the hours with the filter's response to a single one."""
    return rounded(signals.apply_filter(all_hours(spark, sf), _LOW), 8)


@R.add(f"""
WITH {H}, k AS (SELECT i::DOUBLE AS x, x AS y FROM h WHERE i % 8 = 0), s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM k), p AS (SELECT i::DOUBLE AS x FROM h, n WHERE i <= (n - 1) // 8 * 8)
SELECT p.x, round(CASE WHEN p.x = s.x THEN s.y ELSE s.y + (y1 - s.y) * (p.x - s.x) / (x1 - s.x) END, 6) AS y FROM p JOIN s ON p.x >= s.x AND (p.x < x1 OR (x1 IS NULL AND p.x = s.x))""")
def interp_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Every eighth hour is a knot; all hours up to the last knot are points, as none may be outside."""
    h = all_hours(spark, sf)
    knots = h.where("i % 8 = 0").select(F.col("i").cast("double").alias("x"), F.col("x").alias("y"))
    inside = h.crossJoin(F.broadcast(h.agg(F.expr("max(i) div 8 * 8").alias("last")))).where("i <= last")
    return rounded(signals.interp1d(knots, inside.select(F.col("i").cast("double").alias("x"))))


# ---- matrices ----------------------------------------------------------------------------


def _whole(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors in all dimensions."""
    e = load(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "val")).withColumn("val", F.col("val").cast("double"))


def _gram(spark: SparkSession, sf: str) -> DataFrame:
    """X' X of all vectors X: square, of as many rows as dimensions."""
    x = _whole(spark, sf)
    return linalg.mat_mul(linalg.transpose(x), x)


def _moments(spark: SparkSession, sf: str) -> DataFrame:
    """_gram by the number of vectors, its coordinates as integers."""
    n = load(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    return _gram(spark, sf).crossJoin(F.broadcast(n)).select("row", "col", (F.col("val") / F.col("n")).alias("val"))


X = "x AS (SELECT vec_id AS r, c::INT AS c, embedding[c + 1]::DOUBLE AS v FROM embeddings, range(0, 64) x(c))"
G = X + ", n AS (SELECT count(*) AS n FROM embeddings), g AS (SELECT a.c AS r, b.c AS c, sum(a.v * b.v) AS v FROM x a JOIN x b ON a.r = b.r GROUP BY 1, 2), m AS (SELECT r, c, v / n AS v FROM g, n)"


@R.add(f"WITH {G} SELECT r AS \"row\", c AS col, round(v, 6) AS val FROM g")
def matmul(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_gram(spark, sf))


@R.add(f"WITH {X} SELECT round(sqrt(sum(v * v)), 6) AS norm FROM x")
def frobenius(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(linalg.frobenius_norm(_whole(spark, sf)))


@R.add(f"WITH {G} SELECT round(sum(v), 6) AS trace FROM g WHERE r = c")
def trace(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(linalg.matrix_trace(_gram(spark, sf)))


@R.add(f"WITH {X}, s AS (SELECT r, c, exp(v - max(v) OVER (PARTITION BY r)) AS e FROM x) SELECT r AS \"row\", c AS col, round(e / sum(e) OVER (PARTITION BY r), 8) AS val FROM s")
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(linalg.softmax_rows(_whole(spark, sf)), 8)


@R.add(f"""
WITH {G}, s AS (SELECT a.r AS r, b.r AS k, sum(a.v * b.v) / 8.0::DOUBLE AS s FROM m a JOIN m b ON a.c = b.c GROUP BY 1, 2), e AS (SELECT r, k, exp(s - max(s) OVER (PARTITION BY r)) AS e FROM s WHERE k <= r), w AS (SELECT r, k, e / sum(e) OVER (PARTITION BY r) AS w FROM e)
SELECT w.r AS "row", m.c AS col, round(sum(w * v), 6) AS val FROM w JOIN m ON m.r = w.k GROUP BY 1, 2""")
def attention(spark: SparkSession, sf: str) -> DataFrame:
    m = _moments(spark, sf)
    return rounded(linalg.scaled_dot_product_attention(m, m, m, 64, causal=True))


@R.add()
def lu_factors(spark: SparkSession, sf: str) -> DataFrame:
    p, low, up = linalg.lu_decomposition(_gram(spark, sf))
    return linalg.mat_mul(low, up)


@R.add()
def solve(spark: SparkSession, sf: str) -> DataFrame:
    x = _whole(spark, sf)
    y = load(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), F.col("label").cast("double").alias("y"))
    right = x.join(y, "row").groupBy(F.col("col").alias("i")).agg(F.sum(F.col("val") * F.col("y")).alias("x"))
    return linalg.solve_linear(linalg.mat_mul(linalg.transpose(x), x), right)


# ---- graphs ------------------------------------------------------------------------------


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Regions (0-4), nations (100 on) and suppliers (1000 on) as edges."""
    n = load(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"), F.lit(1.0).alias("weight"))
    s = load(spark, sf, "supplier").select((F.col("s_suppkey") + 1000).cast("long").alias("src"), (F.col("s_nationkey") + 100).cast("long").alias("dst"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("weight"))
    return graph.with_seq(n.union(s), "src", "dst")


EDGES = "e AS (SELECT n_nationkey + 100 AS src, n_regionkey AS dst, 1.0::DOUBLE AS w FROM nation UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100, (s_suppkey % 7 + 1)::DOUBLE FROM supplier), u AS (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e)"


@R.add(f"WITH RECURSIVE {EDGES}, r AS (SELECT src AS v, src AS s FROM u UNION SELECT u.dst, r.s FROM r JOIN u ON u.src = r.v) SELECT v::BIGINT AS v, min(s)::BIGINT AS component FROM r GROUP BY 1")
def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    e = places(spark, sf)
    return graph.connected_components(e, e.select(F.col("src").alias("v")).union(e.select("dst")).distinct())


@R.add(f"WITH RECURSIVE {EDGES}, r AS (SELECT 0 AS v, 0 AS h UNION SELECT u.dst, r.h + 1 FROM r JOIN u ON u.src = r.v WHERE r.h < 6) SELECT v::BIGINT AS v, min(h)::INT AS hops FROM r GROUP BY 1")
def graph_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.hops(places(spark, sf), 0)


@R.add(f"WITH RECURSIVE {EDGES}, r AS (SELECT 0 AS v UNION SELECT u.dst FROM r JOIN u ON u.src = r.v) SELECT v::BIGINT AS v FROM r")
def reachable(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reachable(places(spark, sf), 0)


@R.add(f"WITH RECURSIVE {EDGES}, r AS (SELECT 0 AS v, 0.0::DOUBLE AS d, 0 AS k UNION SELECT u.dst, r.d + u.w, r.k + 1 FROM r JOIN u ON u.src = r.v WHERE r.k < 4) SELECT v::BIGINT AS v, min(d) AS distance FROM r GROUP BY 1")
def bellman_ford(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bellman_ford(places(spark, sf), 0, directed=False).select("v", "distance")


@R.add(f"WITH {EDGES} SELECT src::BIGINT AS v, count(*) AS degree FROM u GROUP BY 1")
def graph_degree(spark: SparkSession, sf: str) -> DataFrame:
    e = places(spark, sf)
    return graph.degree(e, e.select(F.col("src").alias("v")).union(e.select("dst")).distinct())


@R.add(f"WITH {EDGES} SELECT count(*) AS edges, sum(w) AS weight FROM e")
def spanning_forest(spark: SparkSession, sf: str) -> DataFrame:
    return graph.kruskal_mst(places(spark, sf)).agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))


# ---- distributions and simulation --------------------------------------------------------


@R.add("SELECT event_id, round(exp(-pow((value - 50) / 20, 2) / 2) / (20 * sqrt(2 * pi())), 8) AS pdf, round(1 - exp(-value / 50), 8) AS exp_cdf FROM events")
def pdf_values(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return rounded(e.select("event_id", distributions.gaussian_pdf("value", 50.0, 20.0).alias("pdf"), distributions.exponential_cdf("value", 0.02).alias("exp_cdf")), 8)


@R.add("WITH p AS (SELECT p_partkey, p_size % 21 AS k FROM part) SELECT p_partkey, k::INT AS k, round(exp(lgamma(21) - lgamma(k + 1) - lgamma(21 - k) + k * ln(0.3) + (20 - k) * ln(0.7)), 8) AS binomial, round(exp(k * ln(4) - 4 - lgamma(k + 1)), 8) AS poisson FROM p")
def pmf_values(spark: SparkSession, sf: str) -> DataFrame:
    k = load(spark, sf, "part").select("p_partkey", (F.col("p_size") % 21).cast("int").alias("k"))
    return rounded(k.select("p_partkey", "k", distributions.binomial_pmf("k", 20.0, 0.3).alias("binomial"), distributions.poisson_pmf("k", 4.0).alias("poisson")), 8)


@R.fixed()
def mc_pi(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.estimate_pi(spark, 100_000, 42)


@R.fixed()
def random_walk(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.random_walk_2d(spark, 100, walks=4)


@R.fixed()
def sobol(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.variance_global_sensitivity(spark, lambda a, b: a + 2 * b, [(0.0, 1.0), (0.0, 1.0)])


@R.fixed()
def metropolis(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.metropolis_hastings(spark, lambda x: -x * x / 2, 0.0, 500, 100, chains=2)
