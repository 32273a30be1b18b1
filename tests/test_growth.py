"""Steps whose memory, time or shuffle must not outgrow the rows."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scale import gini_tree

from mensura.functions import special
from mensura.operators import inference, learning, retrieval, signals, text
from mensura.plans import registry


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_positions_join_no_generated_places(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(30, 64)).astype(np.float32)
    ids = [7 * i + 3 for i in range(30)]
    spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = registry.queries()["positions"](spark, str(tmp_path))
    assert "Range (" not in plan_of(out)  # Spark takes such a table for a small one and broadcasts all of it
    got = {(r["row"], r["col"]): r["val"] for r in out.collect()}
    row, col = np.mgrid[:30, :64]
    angle = row / 10000.0 ** ((col - col % 2) / 64)
    want = x + np.where(col % 2 == 0, np.sin(angle), np.cos(angle))
    assert len(got) == want.size and np.allclose([got[r, c] for r in range(30) for c in range(64)], want.ravel(), atol=1e-7)


@pytest.mark.parametrize("spread", [1, 40])
def test_trees_try_cuts_inside_bins(spark, spread):
    rng = np.random.default_rng(spread)
    a, b = rng.integers(0, 2000 * spread, 600) / 8.0, np.where(rng.random(600) < 0.6, 2.5, rng.random(600) * 5)
    y = ((a > np.quantile(a, 0.613)) ^ (rng.random(600) < 0.1)).astype(int)
    rows = [(i, float(u), float(v), int(k)) for i, (u, v, k) in enumerate(zip(a, b, y))]
    df = spark.createDataFrame(rows, "i long, a double, b double, y int").repartition(3)
    edges = learning.bin_edges(df, ["a", "b"], 8)
    assert max(map(len, edges)) <= 8  # bins hold some 75 rows
    want = gini_tree([(i, [u, v], k) for i, u, v, k in rows], 2)
    got = {r["i"]: r["probabilities"][1] for r in (learning.DecisionTreeClassifier(["a", "b"], "y", 2).fit(df, edges=edges).predict(df)).collect()}
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_special_functions_work_once_on_equal_arguments(spark):
    calls = spark.sparkContext.accumulator(0)

    def f(a, b):
        calls.add(1)
        return None if a == 3 else special.betai(2.0, 3.0, a / 10) + b

    df = spark.range(6000).coalesce(1).select("id", F.when(F.col("id") % 8 < 7, F.col("id") % 8).cast("double").alias("a"))
    got = {r["id"]: r["v"] for r in df.select("id", special.column_function(f)("a", F.lit(1.0)).alias("v")).collect()}
    want = {a: None if a in (3, 7) else special.betai(2.0, 3.0, a / 10) + 1 for a in range(8)}
    assert len(got) == 6000 and all(v == want[i % 8] for i, v in got.items())
    assert calls.value == 7


def test_encoded_pairs_leave_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abc d,é"), 4000)) for _ in range(40)] + [None, "", "abcab " * 3000]
    tokenizer = text.PairTokenizer({t: i for i, t in enumerate([*text.SPECIALS, *"abcd,", "ab", "abc</w>", "</w>"])})
    monkeypatch.setattr(text, "PIECE", 20_000)
    monkeypatch.setattr(text, "WORDS", 50)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    out = text.encode_pairs(df, "text", tokenizer)
    assert {r["id"]: r["ids"] for r in out.collect()} == {i: None if t is None else tokenizer.encode(t) for i, t in enumerate(texts)}
    assert "MapInArrow" in plan_of(out)  # a function of whole columns has all ids of 10,000 documents in memory


def test_levels_of_wavelets_are_worked_out_once(spark):
    df = spark.createDataFrame([(k, i, float(i * i % 7 + k)) for k in range(3) for i in range(8)], "k int, i int, x double")
    out = signals.dwt_multi_level(df, 3, "k", power_of_two=True)
    assert "Window" not in plan_of(out)
    assert out.groupBy("level").count().orderBy("level").collect() == [(1, 12), (2, 6), (3, 3)]
    last = {r["k"]: r["approx"] for r in out.where("level = 3").collect()}
    assert all(abs(last[k] - sum(i * i % 7 + k for i in range(8)) / 8**0.5) < 1e-12 for k in range(3))


def test_index_cuts_texts_once_and_deals_out_blocks(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(t):
        calls.add(1)
        return t

    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "Beta", "x1", "the", "of"], 30)) for _ in range(200)] + [None, "", "--", "ALPHA alpha"]
    docs = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "id string, text string").coalesce(1)
    index = retrieval.InvertedIndex(spark, f"file://{tmp_path}/index")
    index.append(docs.select("id", F.udf(seen, "string")("text").alias("text")), "id", "text")
    assert calls.value == len(texts)
    bags = [Counter(re.findall("[a-z0-9]+", (t or "").lower())) for t in texts]
    assert {(r["term"], r["key"]): r["tf"] for r in index.postings().collect()} == {(w, f"k{i}"): n for i, b in enumerate(bags) for w, n in b.items()}
    assert spark.read.parquet(f"file://{tmp_path}/index/postings").count() == 5  # a row a term, not one a term and document
    assert {r["key"]: r["length"] for r in index.documents().collect()} == {f"k{i}": b.total() for i, b in enumerate(bags)}
    assert {r["term"]: r["documents"] for r in index.vocabulary().collect()} == Counter(w for b in bags for w in b)
    assert not [p for p in (tmp_path / "index" / "staged").rglob("*") if p.is_file()]


@pytest.mark.parametrize("piece", [1, 4, 1000])
def test_blocks_of_pieces_hold_all_words(spark, piece):
    texts = ["a b a", None, "c", "", "b b b b c", "A"]
    rows = retrieval.blocks(spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1), "id", "text", piece).collect()
    assert all(r["n"] == len(r["keys"]) == len(r["tfs"]) for r in rows)
    got = sorted(((r["term"] or "", k, n) for r in rows for k, n in zip(r["keys"], r["tfs"])))
    words = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    assert got == sorted([("", i, len(w)) for i, w in enumerate(words)] + [(x, i, n) for i, w in enumerate(words) for x, n in Counter(w).items()])
    assert len([r for r in rows if r["term"] is None]) == {1: 4, 4: 3, 1000: 1}[piece]


def test_index_without_words(spark, tmp_path):
    index = retrieval.InvertedIndex(spark, f"file://{tmp_path}/index")
    docs = spark.createDataFrame([(1, None), (2, "--")], "id long, text string")
    index.append(docs, "id", "text")
    index.append(docs.limit(0), "id", "text")
    assert index.search("alpha").count() == index.cosine("alpha").count() == index.vocabulary().count() == 0
    assert sorted(map(tuple, index.documents().collect())) == [(1, 0), (2, 0)] and {r["norm"] for r in index.norms().collect()} == {0.0}


@pytest.mark.parametrize("p", [0.0, 0.5, 0.83, 1.0])
@pytest.mark.parametrize("kind", ["ties", "spread", "odd", "few"])
def test_quantiles_of_resamples_equal_those_of_all_draws(spark, kind, p, monkeypatch):
    rng = np.random.default_rng(8)
    x = {"ties": rng.integers(0, 4, 900).astype(float), "spread": rng.exponential(50, 900), "odd": np.r_[rng.normal(size=300), [np.inf] * 3, -0.0, 0.0], "few": np.r_[1.5, 2.5]}[kind]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(5000, None)], "i long, x double").repartition(3)
    plain = inference._resampled(df, "x", "i", 60, 3, lambda c: F.percentile(c, p), "s")
    want = {r["b"]: r["s"] for r in plain.collect()} | {-1: df.agg(F.percentile("x", p)).first()[0]}
    for parting in (None, lambda rows, p: [], lambda rows, p: [-9.0, 2.0, 70.0]):  # wherever the ranges lie
        if parting:
            monkeypatch.setattr(inference, "_parting", parting)
        got = {r["b"]: r["s"] for r in inference._resampled_quantile(df, "x", "i", 60, 3, p, "s").collect()}
        assert got.keys() == want.keys() and all(got[b] == want[b] or abs(got[b] - want[b]) < 1e-12 for b in want)


def test_resampled_medians_shuffle_counts_not_values(spark):
    n = 40_000
    df = spark.createDataFrame([(i, float(v), "ab"[i % 2]) for i, v in enumerate(np.random.default_rng(4).normal(size=n))], "i long, x double, g string")
    got, want = (inference.bootstrap_diff_ci(df, "x", "g", "a", "b", stat, 150, 0.9, 3, "i") for stat in (inference.Quantile(0.5), lambda c: F.percentile(c, 0.5)))
    assert np.allclose(got.first(), want.first(), rtol=1e-12, atol=1e-12)
    plan = plan_of(inference._resampled_quantile(df, "x", "i", 150, 3, 0.5, "s"))
    assert "percentile" not in plan and "array_repeat" not in plan  # those of 150 resamples are sorted, with all draws
    parting = inference._parting(df.select("x"), 0.5)
    inside = df.where(F.col("x").between(parting[0], parting[-1])).count()
    assert len(parting) <= inference.RANGES + 1 and inside < n * (16 * 0.5 / n**0.5 + 10 / inference.ACCURACY)


def test_bootstrap_median_gap_counts_draws(spark):
    plan = registry.queries()["bootstrap_median_gap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat" not in plan
