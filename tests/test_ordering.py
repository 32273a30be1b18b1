"""Ranks, running values and recurrences along one order of all rows, against brute force and against one task's window."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.operators import descriptive, inference, metrics, ordering, validation

ROWS = [(i, random.Random(i).choice(["a", "b", None]) if i % 3 else "a", random.Random(i + 1).randrange(30), random.Random(i + 2).random()) for i in range(500)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "i long, g string, v long, x double").repartition(7)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by", [None, "g"])
@pytest.mark.parametrize("kind", ["sum", "max", "min", "lag"])
@pytest.mark.parametrize("backwards", [False, True])
def test_running_equals_one_window(rows, by, kind, backwards):
    df = rows.withColumn("y", F.when(F.col("v") % 3 != 0, F.col("v")))
    got = ordering.running(df, kind, "y", ["i"], "o", by, backwards)
    window = f"over ({f'partition by {by}' if by else ''} order by i {'desc' if backwards else ''})"
    want = df.selectExpr("i", f"{kind}(y) {window} as o")
    assert {r["i"]: r["o"] for r in got.collect()} == {r["i"]: r["o"] for r in want.collect()}
    assert "SinglePartition" not in plan_of(got)


def test_ranks_numbers_and_tiles(spark, rows):
    values = sorted(r[2] for r in ROWS)
    ranked = ordering.midranks(rows, "v")
    assert all(r["rank"] == values.index(r["v"]) + (values.count(r["v"]) + 1) / 2 for r in ranked.collect()) and ranked.count() == 500
    assert "SinglePartition" not in plan_of(ranked)
    nulls = descriptive.average_ranks(spark.createDataFrame([(None,), (None,), (3.0,)], "v double"), "v").collect()
    assert sorted(r["rank"] for r in nulls) == [1.5, 1.5, 3.0]
    got = sorted(ordering.numbered(rows, ["v", "i"]).collect(), key=lambda r: r["number"])
    assert [r["i"] for r in got] == [i for _, i in sorted((r[2], r[0]) for r in ROWS)]
    for k in (1, 7, 500, 600):
        want = rows.selectExpr("i", f"ntile({k}) over (order by v, i) - 1 as w")
        assert {r["i"]: r["tile"] for r in ordering.tiles(rows, k, ["v", "i"]).collect()} == {r["i"]: r["w"] for r in want.collect()}
    assert ordering.midranks(rows.limit(0), "v").count() == ordering.numbered(rows.limit(0), ["v"]).count() == 0


def test_no_rank_statistic_orders_a_table_in_one_task(rows):
    p = rows.select("i", (F.col("x")).alias("p"))
    for df in (inference.holm(p, "p", "i"), inference.benjamini_hochberg(p, "p", "i"), inference.benjamini_yekutieli(p, "p", "i"), validation.ks_distances(rows, rows.where("i % 2 = 0"), ["x", "v"])):
        assert df.count() and "SinglePartition" not in plan_of(df)
    auc = metrics.roc_auc(rows.withColumn("y", F.col("v") % 2), "y", "x", 1).first()["auc"]
    pos, neg = [r[3] for r in ROWS if r[2] % 2], [r[3] for r in ROWS if not r[2] % 2]
    assert abs(auc - np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])) < 1e-12


@pytest.mark.parametrize("method", ["holm", "benjamini-hochberg", "benjamini-yekutieli"])
def test_adjustments_equal_those_within_a_group(spark, method):
    rng = random.Random(8)
    p = spark.createDataFrame([(i, rng.choice([0.01, 0.02, rng.random()]), "one") for i in range(120)], "i long, p double, g string").repartition(5)
    whole = {r["i"]: r["adjusted"] for r in inference.adjust_p_values(p, "p", "i", method).collect()}
    grouped = {r["i"]: r["adjusted"] for r in inference.adjust_p_values(p, "p", "i", method, by="g").collect()}
    assert whole.keys() == grouped.keys() and all(abs(whole[i] - grouped[i]) < 1e-12 for i in whole)


def test_harmonic_numbers_meet():
    n = 10_000_001
    assert abs(inference.harmonic_number(n) - (inference.harmonic_number(n - 1) + 1 / n)) < 1e-12


@pytest.mark.parametrize("chunk", [3, 64, 1 << 16])
@pytest.mark.parametrize("by", [None, "g"])
def test_recurrence_is_cut_anywhere(rows, by, chunk):
    want, last = {}, {}
    for i, g, _, x in ROWS:
        k = g if by else 0
        last[k] = want[i] = x if k not in last else 0.3 * x + 0.7 * last[k]
    got = ordering.linear_recurrence(rows, ["i"], [[0.7]], [0.3 * F.col("x")], by, first=["x"], chunk=chunk).collect()
    assert len(got) == 500 and all(abs(r["state"][0] - want[r["i"]]) < 1e-12 for r in got)


@pytest.mark.parametrize("b, a", [([0.2, 0.3, 0.1], [2.0, -1.0, 0.5, 0.1]), ([1.0, 2.0, 3.0, 4.0], [1.0]), ([0.5], [1.0, -0.9]), ([3.0], [2.0])])
def test_filter_is_the_recurrence(rows, b, a):
    x, y = [r[3] for r in ROWS], []
    for t in range(len(x)):
        y.append((sum(c * x[t - i] for i, c in enumerate(b) if t >= i) - sum(c * y[t - j] for j, c in enumerate(a) if t >= j > 0)) / a[0])
    got = {r["i"]: r["filtered"] for r in ordering.iir_filtered(rows, "x", ["i"], b, a).collect()}
    assert np.allclose([got[i] for i in range(500)], y, rtol=1e-12)


def test_recurrence_of_nulls_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "i long, x double")
    with pytest.raises(Exception, match="values in every row"):
        ordering.smoothed(df, "x", ["i"]).collect()
    assert ordering.smoothed(df.limit(0), "x", ["i"]).count() == 0
    with pytest.raises(ValueError):
        ordering.iir_filtered(df, "x", ["i"], [1.0], [0.0])


def test_residuals_lag_across_ranges(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(size=300)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "i long, r double").repartition(6)
    got = validation.residual_diagnostics(df, "r", "i").first()
    d = r - r.mean()
    assert abs(got["lag1"] - abs((d[1:] * d[:-1]).sum() / (d * d).sum())) < 1e-12
    a, b = r[:150].var(), r[150:].var()
    assert abs(got["variance_ratio"] - max(a, b) / min(a, b)) < 1e-9
