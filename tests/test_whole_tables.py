"""Registered queries over whole tables, against brute force on small ones."""

import datetime as dt

import numpy as np

from mensura.operators import signals, text
from mensura.plans import registry
from mensura.plans import text as plans_text


def test_series_have_all_hours(spark, tmp_path):
    hours = [3, 3, 4, 130, 131, 131, 131, 260, 302, 302]
    first = dt.datetime(2024, 1, 1)
    rows = [(i, first + dt.timedelta(hours=h, minutes=7 * i % 60)) for i, h in enumerate(hours)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    x = np.bincount(np.array(hours) - 3).astype(float)
    run = registry.queries()
    power = sorted(run["fft_power"](spark, str(tmp_path)).collect(), key=lambda r: r["k"])
    assert [r["k"] for r in power] == list(range(300))
    assert np.allclose([r["power"] for r in power], np.round(np.abs(np.fft.fft(x)) ** 2 / 300, 4), rtol=0, atol=1.01e-4)  # the query rounds to four digits
    exact = sorted(signals.power_spectrum(plans_text.all_hours(spark, str(tmp_path))).collect(), key=lambda r: r["k"])
    assert np.allclose([r["power"] for r in exact], np.abs(np.fft.fft(x)) ** 2 / 300)
    y = sorted(run["butter_filter"](spark, str(tmp_path)).collect(), key=lambda r: r["i"])
    assert np.allclose([r["y"] for r in y], signals.iir(x, signals.butter_lowpass(2, 0.2)))
    frames = run["stft_magnitude"](spark, str(tmp_path)).collect()
    assert max(r["frame"] for r in frames) == -(-(300 - 32) // 8)


def test_matrices_and_models_see_all_vectors_and_dimensions(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(90, 64)), np.arange(90) % 10
    x[:, 40] = np.where(y < 5, -9.0, 9.0)
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    run = registry.queries()
    got = {r["i"]: r["x"] for r in run["solve"](spark, str(tmp_path)).collect()}
    assert np.allclose([got[i] for i in range(64)], np.linalg.lstsq(x, y.astype(float), rcond=None)[0])
    lu = {(r["row"], r["col"]): r["val"] for r in run["lu_factors"](spark, str(tmp_path)).collect()}
    assert np.allclose(sorted(lu.values()), sorted((x.T @ x).ravel()), atol=1e-6)
    for name in ("tree_fit", "logistic_fit"):
        assert all(r["prediction"] == r["y"] for r in run[name](spark, str(tmp_path)).collect()), name


def test_whole_sequences_are_aligned(spark, tmp_path):
    rows = [(1, "the hidden road to the old north shore " * 4), (2, "a short one")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["item_id"]: r for r in registry.queries()["needleman_wunsch"](spark, str(tmp_path)).collect()}
    dna = {i: "".join(c for c in t if c in "adehinorst").translate(str.maketrans("adehinorst", "ACGTACGTAC")) for i, t in rows}
    for i, s in dna.items():
        other = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert got[i]["a"].replace("-", "") == s and got[i]["b"].replace("-", "") == other
        assert got[i]["score"] == text.align(s, other, 1, -1, -1)[0]
    assert len(dna[1]) > 40


def test_byte_pairs_are_trained_as_by_brute_force(spark):
    rows = ["low lower lowest low", "new newer wide wider, low!", "the lower the newer"]
    got = text.train_pairs(spark.createDataFrame([(r,) for r in rows], "text string"), "text", 30)
    import re
    from collections import Counter

    words = Counter(w for r in rows for w in re.findall(r"\w+|[^\w\s]", r))
    parts = {w: [*w, "</w>"] for w in words}
    merges, vocab = [], {*text.SPECIALS, *(c for w in words for c in w)}
    while len(vocab) < 30:
        pairs = Counter()
        for w, p in parts.items():
            for a, b in zip(p, p[1:]):
                pairs[a, b] += words[w]
        best = min(pairs, key=lambda x: (-pairs[x], x))
        if pairs[best] < 2:
            break
        merges.append(best)
        vocab.add("".join(best))
        for p in parts.values():
            i = 0
            while i < len(p) - 1:
                if (p[i], p[i + 1]) == best:
                    p[i : i + 2] = ["".join(best)]
                i += 1
    assert got.merges == merges and len(merges) > 5 and set(got.vocab) == vocab


def test_step_up_and_interpolation_are_brute_force(spark):
    from mensura.operators import inference

    rng = np.random.default_rng(3)
    p = np.round(rng.uniform(size=300) ** 3, 3)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, p double")
    got = {r["i"]: r["adjusted"] for r in inference.benjamini_hochberg(df, "p", "i").collect()}
    order = np.lexsort((np.arange(300), p))
    want = np.minimum(1, np.minimum.accumulate((p[order] * 300 / np.arange(1, 301))[::-1])[::-1])
    assert np.allclose([got[i] for i in order], want)
    knots = spark.createDataFrame([(float(x), float(x * x)) for x in range(0, 50, 5)], "x double, y double")
    points = np.round(rng.uniform(0, 45, 100), 1)
    back = signals.interp1d(knots, spark.createDataFrame([(float(x), i) for i, x in enumerate(points)], "x double, i int")).collect()
    assert np.allclose([r["y"] for r in back], np.interp([r["x"] for r in back], np.arange(0, 50, 5), np.arange(0, 50, 5) ** 2))
