"""Resampling, periodic runs and mixing against brute force, and over odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.llm import common, mixing, periodic_runs, queries, resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(7, None, None), (8, "", "b"), (9, " \n\t ", "b"), (10, "Ä1 ß-ß", "b"), (10, "Ä1 ß-ß", "b"), (None, "one two", "a"), (None, "one two", "a"), (11, "tab\x0bfeed\x0cend\x1fx", None), (12, "w" * 700 + " " + "v" * 300, "c")]


def frame(spark, rows, cols="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, cols)


def lower(text):
    return (text or "").translate(str.maketrans(common.UPPER, common.LOWER))


def bag(text, longest=3, buckets=10_000):
    w = WORDS.findall(lower(text))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def resampled(rows, target, per_cent=5, min_words=20, seed=42, buckets=10_000):
    bags = [bag(t, buckets=buckets) for _, t, *_ in rows]
    s, t = Counter(b for _, x in bags for b in x), Counter(b for x in target for b in bag(x, buckets=buckets)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for (key, *_), (n, x) in zip(rows, bags):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in x)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: len(fit) * per_cent // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


def test_resample_equals_brute_force(spark):
    rng = random.Random(3)
    say = ["Alpha", "beta", "gämma", "x1", "of", "and", "the", "word" * 90]
    rows = [(i, " ".join(rng.choice(say[: rng.randrange(2, 9)]) for _ in range(rng.randrange(0, 60))), "s") for i in range(150)] + ODD
    target = ["the gämma of x1 and the", None, "", "beta beta beta"]
    for buckets, per_cent in ((10_000, 5), (65_536, 50), (7, 100)):
        got = resampling.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), per_cent=per_cent, buckets=buckets)
        got = sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)
        assert got == resampled(rows, target, per_cent, buckets=buckets)


def test_resample_ties_go_by_key_and_every_place_is_given_once(spark):
    rows = [(k, "same words " * 15, "s") for k in [None] * 40 + [5] * 40 + list(range(20))]
    got = resampling.resample(frame(spark, rows), spark.createDataFrame([("other",)], "text string"), per_cent=100)
    got = sorted(got.where("rank is not null").collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 101))
    key = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got]
    assert key == sorted(key)


def test_resample_keeps_other_columns_and_answers_empty_tables(spark):
    docs = frame(spark, ODD).withColumn("Rank", F.lit("x")).withColumn("rid", F.lit(1)).withColumn("stream", F.lit(2)).withColumn("place", F.lit(3)).withColumn("part", F.lit(4))
    got = resampling.resample(docs, docs.limit(0))
    assert got.columns == ["doc_id", "source", "rid", "stream", "place", "part", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(r["n_words"] for r in got.collect()) == [0, 0, 0, 2, 2, 2, 3, 3, 4]
    assert {(r["rid"], r["stream"], r["place"], r["part"]) for r in got.collect()} == {(1, 2, 3, 4)}
    assert resampling.resample(docs.limit(0), docs).count() == 0


def test_features_of_long_words_and_long_texts():
    rng = np.random.default_rng(1)
    words = ["a" * int(n) for n in rng.integers(1, 4, 1_200_000)] + ["b" * 70_000, "c" * 256, "d" * 255, "é" * 300]
    n, stream = resampling.bucket_stream(resampling.Hashes(), [" ".join(words), "", "one"], 3, 10_000)
    assert n.tolist() == [len(words), 0, 1] and len(stream) == 3 * len(words) - 3 + 1
    want = Counter(bag(" ".join(words))[1] + bag("one")[1])
    assert Counter(stream.tolist()) == want


def test_words_beyond_the_cache_are_hashed_alike(monkeypatch):
    monkeypatch.setattr(resampling, "CACHE_WORDS", 3)
    hashes = resampling.Hashes()
    for text in ("a b c d e", "f g h", "a z", ""):
        assert Counter(resampling.bucket_stream(hashes, [text], 2, 10_000)[1].tolist()) == Counter(bag(text, 2)[1])


def runs_of(words, least=24):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            a = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - a >= max(least, 3 * q):
                found.setdefault((a, i + q - a), q)
            i += 1
    return sorted((a, n, q) for (a, n), q in found.items())


@pytest.mark.parametrize("least", [3, 6, 24, 60])
def test_runs_equal_brute_force(monkeypatch, least):
    rng = random.Random(least)
    for _ in range(250):
        n, kinds, words = rng.randrange(0, 300), rng.choice([1, 2, 3, 5, 50]), []
        while len(words) < n:
            if rng.random() < 0.5:
                words += ([rng.randrange(kinds) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 31, 40]))] * rng.randrange(1, 12))[: rng.randrange(1, 150)]
            elif words and rng.random() < 0.5:
                a = rng.randrange(len(words))
                words += words[a : a + rng.randrange(1, 100)]
            else:
                words += [rng.randrange(kinds) for _ in range(rng.randrange(1, 9))]
        monkeypatch.setattr(periodic_runs, "SPAN", rng.choice([8, 64, 1 << 20]))
        assert periodic_runs.find_runs(np.array(words[:n], np.int64), least) == runs_of(words[:n], least)


def test_runs_of_very_long_texts():
    n = 400_000
    for words, want in (([0] * n, [(0, n, 1)]), ([0] * n + [1] + [0] * n, [(0, n, 1), (n + 1, n, 1)]), (list(range(n // 4)) * 4, [(0, n, n // 4)])):
        assert periodic_runs.find_runs(np.array(words, np.int64)) == want
    text = "one two\tthree\n" * 700_000
    words, known = periodic_runs.numbered(text)
    assert len(words) == 2_100_000 and known == [b"one", b"two", b"three"]
    assert periodic_runs.collapsed(words, known, periodic_runs.kept_words(len(words), periodic_runs.find_runs(words))) == "one two three"


def test_collapse_and_digest(spark):
    rows = [(1, "x " + "a b c " * 9 + "y", "s"), (2, "lone word\x1f here", "s"), *ODD]
    docs = frame(spark, rows).withColumn("N_runs", F.lit("clash")).withColumn("own_text", F.lit("o"))
    got = periodic_runs.collapse_runs(docs)
    assert got.columns == ["doc_id", "text", "source", "own_text", "n_words", "n_runs", "runs"]
    by = {(r["doc_id"], r["source"]): r for r in got.collect()}
    assert by[1, "s"]["text"] == "x a b c y" and [tuple(r) for r in by[1, "s"]["runs"]] == [(1, 27, 3)]
    assert by[2, "s"]["text"] == "lone word\x1f here" and by[2, "s"]["n_words"] == 2
    assert by[7, None]["text"] is None and by[7, None]["n_words"] == 0 and by[9, "b"]["text"] == ""
    assert by[11, None]["text"] == "tab feed end\x1fx" and got.count() == len(rows)
    first = {r["doc_id"]: r for r in periodic_runs.digest(got).collect()}
    assert tuple(first[1])[:6] == (1, 1, 1, 27, 3, 9000) and first[1]["runs_sha256"] == hashlib.sha256(b"1,27,3\n").hexdigest()
    assert tuple(first[7])[1:6] == (0, None, None, None, None) and first[7]["runs_sha256"] == first[7]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert periodic_runs.digest(periodic_runs.collapse_runs(docs.limit(0))).count() == 0


def test_best_run_by_exact_exponent_then_start(spark):
    rows = [(1, "a " * 24 + "x " + "b " * 24 + "y " + "c d " * 40, "s"), (2, "a b " * 15 + "x " + "c d e " * 11 + "q", "s")]
    got = {r["doc_id"]: tuple(r)[1:6] for r in periodic_runs.digest(periodic_runs.collapse_runs(frame(spark, rows))).collect()}
    assert got == {1: (3, 50, 80, 2, 40000), 2: (2, 0, 30, 2, 15000)}


def test_made_periodic_follows_its_contract():
    for key in range(200):
        words, h = np.arange(40), zlib.crc32(str(key).encode())
        got = queries.made_periodic(key, words).tolist()
        a, p = h // 10 % 40, 1 + (40 - h // 10 % 40) // (3 + h // 10 % 8)
        assert got == ([i if i < a else a + (i - a) % p for i in range(40)] if h % 10 == 0 else list(range(40)))
    assert queries.made_periodic(None, np.arange(3)).tolist() == [0, 1, 2] and len(queries.made_periodic(19, np.arange(0))) == 0


def aims_of(sizes, weights, share=1.5, most=2.0):
    """Targets by source, shared again and again."""
    target, left, free = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while left > 1e-9 and free:
        w = sum(weights[s] for s in free)
        for s in free:
            target[s] += left * weights[s] / w
        left = sum(max(0, target[s] - most * sizes[s]) for s in free)
        over = {s for s in free if target[s] >= most * sizes[s]}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def test_mix_reaches_targets_and_takes_no_document_thrice(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 3, 40, 900]))), rng.choice(["b", "b", "b", "a", "Z", "é", None, "zz"] if i % 50 else ["tiny"])) for i in range(600)]
    rows += [(1000, None, "none"), (1001, " ", "none")] + ODD
    made = mixing.mix(frame(spark, rows), block=64)
    docs = mixing.taken_words(made).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^ \t-\r]+", t or ""))
    weights = {s: [3, 1, 2][i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    want = aims_of(sizes, weights)
    taken = Counter()
    for r in docs:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        taken[r["source"]] += r["taken"]
    assert len(docs) == len(rows) and all(taken[s] == math.floor(want[s] + 1e-6) for s in sizes)
    # slots: each once, each of a block's words but for the last of a source; any stretch is mixed
    slots = {}
    for r in made.schedule.collect():
        slots.setdefault((r["slot"], r["source_number"], r["rank"]), []).append(r["words"])
    assert len({s for s, _, _ in slots}) == len(slots)
    by = {}
    for (slot, n, rank), words in sorted(slots.items()):
        by.setdefault(n, []).append((rank, sum(words)))
    for ranks in by.values():
        assert [r for r, _ in ranks] == list(range(len(ranks))) and all(w == 64 for _, w in ranks[:-1])
    order = [n for _, n, _ in sorted(slots)]
    most = max(by, key=lambda n: len(by[n]))
    share = len(by[most]) / len(order)
    assert all(abs(order[a : a + 64].count(most) - 64 * share) <= 8 for a in range(0, len(order) - 64, 16))
    again = mixing.taken_words(mixing.mix(frame(spark, rows[::-1]).repartition(5), block=64)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, docs))


def test_mix_of_one_source_empty_tables_and_clashing_names(spark):
    docs = frame(spark, [(i, "a b c", "s") for i in range(5)] + [(9, None, "s")]).withColumn("Size", F.lit(1)).withColumn("hashed", F.lit("h")).withColumn("part", F.lit("p"))
    got = mixing.taken_words(mixing.mix(docs, block=2)).collect()
    assert sum(r["taken"] for r in got) == 22 and {r["target"] for r in got} == {22.5} and {r["hashed"] for r in got} == {"h"} and {r["part"] for r in got} == {"p"}
    assert mixing.taken_words(mixing.mix(docs.limit(0))).count() == 0
    assert [tuple(r)[-1] for r in mixing.taken_words(mixing.mix(docs.where("text is null"))).collect()] == [0]


def test_mix_sizes_of_odd_texts(spark):
    rows = [(i, t, "s") for i, t in enumerate([None, "", " ", "a", " a\x0bb\x0c", "a\x1cb c\x85d e", "\r\n" + "xx " * 700_000])]
    got = {r[0]: r[1] for r in frame(spark, rows).select("doc_id", mixing.size_in_words(F.col("text"))).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 1, 6: 700_000}


def test_ranks_of_equal_rows(spark):
    df = spark.createDataFrame([(i % 3, "x") for i in range(100)], "v long, rank0 string").repartition(7)
    got = sorted(common.ranked(df, [F.col("v").desc()]).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 101)) and [r["v"] for r in got] == sorted((i % 3 for i in range(100)), reverse=True)
