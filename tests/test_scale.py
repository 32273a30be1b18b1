"""Operators that spread over tasks: transforms, neighbours, trees, resamples, factorisations, the stored index, grids."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.operators import frame, inference, learning, retrieval, signals, spectral, tall
from mensura.operators.text import rank_tfidf


@pytest.mark.parametrize("n, block", [(1, 4), (2, 1), (7, 8), (1000, 64), (1000, 1 << 18)])
def test_long_fft_and_its_inverse(spark, n, block):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").repartition(3)
    size = 1 << (n - 1).bit_length()
    z = spectral.long_fft(df, block=block)
    got = {r["k"]: complex(r["re"], r["im"]) for r in z.collect()}
    assert sorted(got) == list(range(size)) and np.allclose([got[k] for k in range(size)], np.fft.fft(x, size))
    back = {r["k"]: r["re"] for r in spectral.long_fft(z, index="k", inverse=True, block=block).collect()}
    assert np.allclose([back[i] for i in range(n)], x)


def test_long_fft_of_gaps_and_of_nothing(spark):
    df = spark.createDataFrame([(5, 2.0), (12, 1.0)], "i long, x double")
    x = np.zeros(16)
    x[5], x[12] = 2, 1
    got = {r["k"]: complex(r["re"], r["im"]) for r in spectral.long_fft(df, block=4).collect()}
    assert np.allclose([got[k] for k in range(16)], np.fft.fft(x))
    assert spectral.long_fft(df.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [6, 100, 1 << 20])
def test_nearest_in_blocks_equals_brute_force_with_ties(spark, cells):
    rng = random.Random(4)
    point = lambda: [float(rng.randrange(4)) for _ in range(3)]
    train, queries = [(i, point()) for i in range(80)], [(i, point()) for i in range(30)]
    frames = [spark.createDataFrame(r, "id long, x array<double>").repartition(3) for r in (train, queries)]
    got = learning.nearest(*frames, "x", "id", "id", 7, cells)
    by = {}
    for r in got.collect():
        by.setdefault(r["query"], []).append((r["rank"], r["d2"], r["key"]))
    for q, v in queries:
        want = sorted((sum((a - b) ** 2 for a, b in zip(v, t)), k) for k, t in train)[:7]
        assert sorted(by[q]) == [(i + 1, d, k) for i, (d, k) in enumerate(want)]
    assert learning.nearest(frames[0].limit(3), frames[1], "x", "id", "id", 7, cells).count() == 90
    assert learning.nearest(frames[0].limit(0), frames[1], "x", "id", "id", 7, cells).count() == 0


def gini_tree(rows, depth):
    """Predicted share of 1 for each row, by trying every cut."""
    out = {}

    def score(side):
        p = sum(y for _, y in side) / len(side)
        return len(side) * (1 - p * p - (1 - p) * (1 - p))

    def split(part, left):
        best = None
        for f in range(len(part[0][0][1])):
            values = sorted({x[f] for (_, x), _ in part})
            for a, b in zip(values, values[1:]):
                cut = (a + b) / 2
                s = round(score([r for r in part if r[0][1][f] <= cut]) + score([r for r in part if r[0][1][f] > cut]), 10)
                if best is None or (s, f, cut) < best:
                    best = (s, f, cut)
        if not left or best is None:
            for (i, _), _ in part:
                out[i] = sum(y for _, y in part) / len(part)
            return
        _, f, cut = best
        split([r for r in part if r[0][1][f] <= cut], left - 1)
        split([r for r in part if r[0][1][f] > cut], left - 1)

    split([((i, x), y) for i, x, y in rows], depth)
    return out


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_tree_equals_brute_force(spark, depth):
    rng = random.Random(depth)
    rows = [(i, [rng.choice([0.0, 1.0, 2.5]), rng.random(), float(rng.randrange(9))], int(rng.random() < 0.5)) for i in range(70)]
    df = spark.createDataFrame([(i, *x, y) for i, x, y in rows], "i long, a double, b double, c double, y int").repartition(4)
    model = learning.DecisionTreeClassifier(["a", "b", "c"], "y", depth).fit(df)
    got = {r["i"]: r["probabilities"][1] for r in model.predict(df).collect()}
    want = gini_tree(rows, depth)
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_bins_hold_all_values_or_quantiles(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(v), float(i % 7), None if i % 2 else 1.0, None) for i, v in enumerate(rng.normal(size=3000))], "a double, b double, c double, d double").repartition(5)
    a, b, c, d = learning.bin_edges(df, ["a", "b", "c", "d"], 50)
    assert len(a) <= 50 and b == [float(i) for i in range(7)] and c == [1.0] and d == []
    counts = Counter(r["_bins"][0] for r in learning.with_bins(df, ["a", "b", "c", "d"], [a, b, c, d]).collect())
    assert max(counts.values()) <= 3000 / 50 * 1.5
    assert all(r["_bins"][1:] == [int(r["b"]), -1 if r["c"] is None else 0, -1] for r in learning.with_bins(df, ["a", "b", "c", "d"], [a, b, c, d]).collect())


def test_coarse_bins_still_find_a_good_cut(spark):
    rng = np.random.default_rng(2)
    x = rng.random(4000)
    df = spark.createDataFrame([(float(v), int(v > 0.37)) for v in x], "x double, y int")
    model = learning.DecisionTreeClassifier(["x"], "y", 1).fit(df, edges=learning.bin_edges(df, ["x"], 64))
    assert abs(model.tree.cut - 0.37) < 1 / 32


def test_poisson_weights_are_poisson(spark):
    n = 20_000
    df = inference.with_poisson_weight(spark.range(n).withColumn("b", F.col("id") % 3), "id", "b", 5)
    counts = Counter(r["_w"] for r in df.collect())
    assert all(abs(counts[k] / n - math.exp(-1) / math.factorial(k)) < 0.015 for k in range(5))
    pair = spark.range(5000)
    weights = [[r["_w"] for r in inference.with_poisson_weight(pair.withColumn("b", F.lit(b).cast("long")), "id", "b", 5).orderBy("id").collect()] for b in (0, 1)]
    assert abs(np.corrcoef(weights)[0, 1]) < 0.05


def test_bootstrap_covers_and_repeats(spark):
    x = np.random.default_rng(7).normal(10, 2, 400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(1000, None)], "i long, x double")
    for stat, want, width in ((F.avg, x.mean(), 2 * 1.96 * x.std() / 20), (lambda c: F.percentile(c, 0.5), np.median(x), None)):
        got = inference.bootstrap_ci(df, "x", stat, 400, key="i").first()
        assert got["lower"] < want < got["upper"]
        for key in ("i", None):
            one, other = (inference.bootstrap_ci(d, "x", stat, 100, key=key).first() for d in (df, df.repartition(7)))
            assert np.allclose(one, other, rtol=1e-12)
        assert width is None or abs(got["upper"] - got["lower"] - width) < 0.3 * width
    with pytest.raises(ValueError):
        inference.bootstrap_ci(df.where("i = 1000"), "x")


@pytest.mark.parametrize("n, width", [(3, 5), (500, 6), (1, 1)])
def test_triangles_and_singular_values(spark, n, width):
    a = np.random.default_rng(n).normal(size=(n, width))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)] + [(n, None)], "i long, v array<double>").repartition(20)
    r = tall.triangle(df, "v")
    assert np.allclose(r.T @ r, a.T @ a) and np.allclose(r, np.triu(r))
    s, v = tall.singular_values(df, "v")
    assert np.allclose(s[: min(n, width)], np.linalg.svd(a, compute_uv=False)) and np.allclose(v @ v.T, np.eye(width))
    if n >= width:
        q = np.array([x["q"] for x in tall.orthonormal(df, "v").orderBy("i").collect()])
        assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(width))
        u = np.array([x["u"] for x in tall.left_vectors(df, "v", 1).orderBy("i").collect()])
        assert np.allclose((u * s[:1]) @ v[:1], a @ v[:1].T @ v[:1])
    else:
        with pytest.raises(ValueError):
            tall.orthonormal(df, "v")


def test_index_grows_by_deltas_and_equals_a_scan(spark, tmp_path):
    rng = random.Random(6)
    say = ["alpha", "beta", "gamma", "delta", "x1", "the", "of"]
    rows = [(i, " ".join(rng.choice(say) for _ in range(rng.randrange(0, 12)))) for i in range(90)] + [(100, None), (101, ""), (102, "Alpha ALPHA the")]
    df = spark.createDataFrame(rows, "id long, text string")
    index = retrieval.InvertedIndex(spark, f"file://{tmp_path}/index", buckets=4)
    assert index.batches() == [] and index.search("alpha").count() == 0
    index.append(df.where("id < 50"), "id", "text")
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    index.append(df.where("id >= 50"), "id", "text")
    assert all(p.stat().st_mtime_ns == t for p, t in before.items()) and len(index.batches()) == 2
    (tmp_path / "index" / "documents" / "batch=half").mkdir()  # an append that failed
    for query in ("alpha the the", "x1", "none such", "", "of beta gamma delta alpha the x1"):
        got = {r["key"]: r["score"] for r in index.search(query).collect()}
        want = {r["id"]: r["score"] for r in rank_tfidf(df, "id", "text", query).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    bags = {i: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in rows}
    idf = {w: math.log(len(rows) / sum(w in b for b in bags.values())) for w in say}
    norm = lambda b: math.sqrt(sum((n * idf[w]) ** 2 for w, n in b.items()))
    q = Counter(["alpha", "the", "the"])
    got = {r["key"]: r["cosine"] for r in index.cosine("alpha the the").collect()}
    want = {i: sum(b[w] * q[w] * idf[w] ** 2 for w in q) / norm(b) / norm(q) for i, b in bags.items() if set(b) & set(q)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plan = index.postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "term" in plan.split("PushedFilters")[1] and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_grid_points_meet_their_cell_in_an_equi_join(spark):
    rng = random.Random(5)
    xs, ys = sorted({0.0, *(rng.random() * 10 for _ in range(6))}), [0.0, 0.1, 5.0, 5.5, 20.0]
    z = {(x, y): rng.random() for x in xs for y in ys}
    grid = spark.createDataFrame([(x, y, v) for (x, y), v in z.items()], "x double, y double, z double")
    points = [(rng.uniform(0, xs[-1]), rng.uniform(0, 20)) for _ in range(60)] + [(x, y) for x in xs for y in ys] + [(-1.0, 3.0), (3.0, 21.0)]
    got = signals.interp2d(grid, spark.createDataFrame([(x, y, i) for i, (x, y) in enumerate(points)], "x double, y double, i int"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    by = {r["i"]: r["z"] for r in got.collect()}
    assert len(by) == len(points) - 2
    for i, (x, y) in enumerate(points[:-2]):
        a = max(0, sum(v < x for v in xs) - 1)
        b = max(0, sum(v < y for v in ys) - 1)
        u, v = (x - xs[a]) / (xs[a + 1] - xs[a]), (y - ys[b]) / (ys[b + 1] - ys[b])
        want = (1 - u) * (1 - v) * z[xs[a], ys[b]] + u * (1 - v) * z[xs[a + 1], ys[b]] + (1 - u) * v * z[xs[a], ys[b + 1]] + u * v * z[xs[a + 1], ys[b + 1]]
        assert abs(by[i] - want) < 1e-9


def test_grouping_sets_and_sketch(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", None, 4), ("b", "x", 8)], "g string, h string, v long")
    rolled = {(r["g"], r["h"], r["level"]): r["s"] for r in frame.rollup(df, ["g", "h"], F.sum("v").alias("s")).collect()}
    assert rolled == {("a", "x", 0): 1, ("a", "y", 0): 2, ("b", None, 0): 4, ("b", "x", 0): 8, ("a", None, 1): 3, ("b", None, 1): 12, (None, None, 3): 15}
    cubed = {(r["g"], r["h"], r["level"]): r["s"] for r in frame.cube(df, ["g", "h"], F.sum("v").alias("s")).collect()}
    assert cubed == rolled | {(None, "x", 2): 9, (None, "y", 2): 2, (None, None, 2): 4}
    many = spark.range(20_000).selectExpr("id % 5000 as v", "id % 2 as g")
    assert all(abs(r["distinct"] - 2500) <= 0.08 * 2500 for r in frame.approximate_distinct(many, "v", ["g"]).collect())
