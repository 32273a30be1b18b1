"""Exact, near and line deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from mensura.llm import exact_dedup, line_dedup, near_dedup
from mensura.llm.decontaminate import words_of

UP = str.maketrans({i: i + 32 for i in range(65, 91)})


def exact_brute(rows):
    groups = {}
    for i, (k, t) in enumerate(rows):
        groups.setdefault((t or "").translate(UP), []).append((k is not None, k, i))
    out = []
    for t, g in groups.items():
        keep = max(g, key=lambda x: (x[0], x[1] or 0))
        out += [(k, keep[1], len(g), hashlib.sha256(t.encode()).hexdigest()) for _, k, i in g]
    return Counter(out)


def test_exact_dedup_is_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("aAbB") for _ in range(rng.randint(0, 14)))) for i in range(600)]
    rows += [(1000 + i, "Same text, a third of all") for i in range(400)] + [(None, "É"), (None, "é"), (None, "é"), (7, "abab"), (7, "abab"), (8, None), (9, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rid string")
    for block in (4, 4096):
        got = exact_dedup.deduplicate(docs, block=block).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == exact_brute(rows), block
        assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
        assert all(r["keep_id"] == r["doc_id"] for r in got if r["kept"])


@pytest.mark.parametrize("key, text", [("doc_id", "__key"), ("__key", "rid"), ("__text", "name"), ("level", "__text")])
def test_exact_dedup_whatever_columns_are_called(spark, key, text):
    docs = spark.createDataFrame([(1, "Same"), (2, "sAME"), (3, None), (4, "")], f"{key} long, {text} string")
    got = exact_dedup.deduplicate(docs, text, key).collect()
    assert sorted((r[key], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True)]


def test_exact_dedup_of_nothing_and_of_long_texts(spark):
    docs = spark.createDataFrame([(1, "ab" * 60_000), (2, "AB" * 60_000), (3, "ab" * 60_000 + "c"), (4, "ba" * 60_000)], "doc_id long, text string")
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.deduplicate(docs).collect()} == {1: 2, 2: 2, 3: 3, 4: 4}


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]


def near_brute(rows, least=0.8):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if words_of(a) and words_of(b) and near_dedup.similarity(a, b) >= least:
                parent[find(i)] = find(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), set()).add(rows[i][0])
    return {k: min(c) for c in classes.values() for k in c}


def near_corpus():
    rng, rows = random.Random(11), []
    for g in range(40):
        base = words(rng, rng.randint(3, 150))
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = "new" + str(rng.random())[2:8]
            rows.append((len(rows), rng.choice([" ", "  ", "\n"]).join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["one two", "One, two!", "", None, "...", "", "w " * 300, "w " * 301])]
    return rows


def test_near_classes_are_brute_force(spark):
    rows = near_corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["class_id"] for r in got} == near_brute(rows)
    sizes = Counter(r["class_id"] for r in got)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
    assert all((r["n_links"] > 0) <= (r["class_size"] > 1) for r in got)


def template_group(rng, n, pairs):
    """n texts of one template that are under 0.8 alike, but for `pairs` pairs, the last of them with the next, that are a little over."""
    base, rows = words(rng, 400), []

    def changed(w, spots, name):
        for j in spots:
            w[5 * j] = f"{name}x{j}"
        return w

    for i in range(n - 2 * pairs):
        rows.append(changed(list(base), rng.sample(range(80), 7), f"own{i}"))
    for i in range(pairs):
        spots = rng.sample(range(80), 12)
        both = changed(list(base), spots[:4], f"both{i}")
        rows += [changed(list(both), spots[4:8], f"left{i}"), changed(list(both), spots[8:], f"right{i}")]
    return [" ".join(w) for w in rows]


def apart(spark, n, pairs):
    """How many of the pairs of a template group aren't in one class of two."""
    docs = spark.createDataFrame(list(enumerate(template_group(random.Random(5), n, pairs))), "doc_id long, text string")
    of = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_dedup.near_duplicates(docs).collect()}
    return sum(not of[i] == of[i + 1] == (i, 2) for i in range(n - 2 * pairs, n, 2))


def test_last_links_of_a_large_table_are_found(spark):
    assert apart(spark, 2000, 10) == 0


def test_all_links_of_a_template_group_are_found(spark, monkeypatch):
    assert apart(spark, 2400, 200) == 0
    monkeypatch.setattr(near_dedup._links, "__defaults__", (7,))  # buckets in many parts
    assert apart(spark, 300, 50) == 0


def test_near_dedup_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["class_size"], r["kept"]) for r in got) == [(0, 3, 3, False), (0, 3, 3, False), (3, 3, 3, True), (4, 4, 1, True)]


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        n = 400
        h = rng.integers(1, 1 << 62, n).astype(np.uint64)
        a, b = rng.uniform(0, 5, n), rng.uniform(0, 5, n)
        b[: int(n * share)] = a[: int(n * share)]
        s = near_dedup.signatures([near_dedup.cells(h, a), near_dedup.cells(h, b)], 1500)
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - exact) < 0.05


def test_lone_shingles_and_counts():
    assert near_dedup.similarity("a b c", "A, b c!") == 1.0 and near_dedup.similarity("a b", "a c") == 0.0
    c, part = near_dedup.cells(near_dedup.shingles([b"w"] * 9))
    assert len(set(c.tolist())) == 5 and part.sum() == 5


def line_docs():
    rng = random.Random(2)
    line = lambda n: " ".join(words(rng, n))
    passages = ["\n".join(line(n) for n in sizes) for sizes in ([60], [30, 30], [20, 20, 20], [13] * 8, [90, 4, 8])]
    rows = []
    for i in range(60):
        own = [line(rng.randint(2, 30)) for _ in range(rng.randint(1, 6))]
        if i % 2:
            own.insert(rng.randint(0, len(own)), passages[i // 2 % len(passages)])
        rows.append((i, "\n".join(own)))
    return rows, passages


def test_repeated_passages_go_and_the_first_stays(spark):
    rows, passages = line_docs()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rid string")
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        if i % 2 == 0:
            assert got[i]["text"] == t and got[i]["lines_removed"] == 0 and got[i]["removed_spans"] == []
    for p in passages:
        holders = [i for i, t in rows if p in t]
        assert p in got[min(holders)]["text"]
        assert not any(p in got[i]["text"] for i in holders[1:])
        assert all(got[i]["words_removed"] >= 25 for i in holders[1:])
    for i, t in rows:  # what is left are lines of the text, in order
        left = iter(t.split("\n"))
        assert all(x in left for x in got[i]["text"].split("\n")) or got[i]["text"] == ""


def left_of(spark, passage_of, n=20, own=lambda rng: rng.randint(4, 14)):
    """Lines with words of repeated passages that stay in second documents."""
    rng, rows, left = random.Random(6), [], 0
    line = lambda k: " ".join(words(rng, k))
    passages = [passage_of(line) for _ in range(n)]
    for i, p in enumerate(passages * 2):
        rows.append((i, "\n".join([*(line(own(rng)) for _ in range(3)), p, *(line(own(rng)) for _ in range(3))])))
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, p in enumerate(passages):
        assert got[i]["text"] == rows[i][1]
        left += sum(x in got[n + i]["text"].split("\n") for x in p.split("\n") if x)
        assert all(x in got[n + i]["text"].split("\n") for k, x in enumerate(rows[n + i][1].split("\n")) if k < 3)
    return left


def test_blank_lines_break_no_passage(spark):
    for sizes in ([20] * 4, [18] * 6, [24] * 10):
        assert left_of(spark, lambda line: "\n\n".join(line(k) for k in sizes)) == 0


def test_whole_passages_of_short_lines_go(spark):
    for sizes in ([6] * 10, [5] * 12, [12] * 5, [10] * 6, [8] * 8, [3] * 17, [1] * 71, [24, 24, 3], [2, 2, 24, 22, 1]):
        assert left_of(spark, lambda line: "\n".join(line(k) for k in sizes)) == 0, sizes


def test_passages_are_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(words(rng, n)) for n in (1, 2, 3, 5, 8, 13, 30)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool[:7] if i % 3 else pool) for _ in range(rng.randint(1, 25)))) for i in range(40)]
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen: dict = {}
    for i, t in rows:
        lines, must, may = t.split("\n"), set(), set()
        full = [k for k, x in enumerate(lines) if x.split()]
        for a in range(len(full)):
            for b in range(a, len(full)):
                body, own = tuple(lines[k] for k in full[a : b + 1]), set(full[a : b + 1])
                if sum(len(x.split()) for x in body) >= 25:
                    doc, start, end = seen.setdefault(body, (i, full[a], full[b] + 1))
                    if (doc, start) != (i, full[a]):
                        may |= own
                        must |= own if doc != i or full[a] >= end else set()
        gone = {k for s in got[i]["removed_spans"] for k in range(s["first_line"], s["first_line"] + s["lines"])}
        assert must <= gone and gone & set(full) <= may, i
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(lines) if k not in gone)


def test_line_dedup_of_odd_tables(spark):
    long = " ".join(["word%d" % i for i in range(40)])
    rows = [(1, long), (1, long), (None, long), (3, None), (4, ""), (5, "a\n\nb\n"), (6, long + "\n" + long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.remove_repeated(docs.limit(0)).count() == 0
    got = line_dedup.remove_repeated(docs).collect()
    assert sum((r["text"] or "").count(long) for r in got) == 1 and len(got) == 7
    by = {r["doc_id"]: r for r in got}
    assert by[None]["text"] == long and by[3]["text"] is None and by[3]["n_lines"] == 0
    assert by[4]["text"] == "" and by[4]["n_lines"] == 1 and by[5]["text"] == "a\n\nb\n" and by[6]["text"] == ""


@pytest.mark.parametrize("sizes", [(13, 13), (4, 40), (41, 41), (1, 3), (100, 200)])
def test_boundaries_are_a_share_of_rows_and_resist_shifts(sizes):
    rng = random.Random(8)
    lines = [" ".join(words(rng, rng.randint(*sizes))).encode() for _ in range(300)]
    n, found = line_dedup.boundaries(lines)
    assert 0.25 * n <= len(found) <= 0.55 * n  # whatever the lengths of lines; rows of chunks are 2 to 4 then
    gaps = np.diff(found)
    assert gaps.max() <= line_dedup.REACH and np.mean(gaps) >= 1.8
    more, shifted = line_dedup.boundaries([b"an inserted line of words", *lines])
    moved = {i - (more - n) for i in shifted}
    assert len({i for i in found if i > 40} - moved) <= 0.02 * len(found)


def test_each_passage_has_a_chunk_that_its_rows_alone_decide():
    rng = random.Random(13)
    line = lambda: " ".join(words(rng, rng.choice([1, 1, 2, 3, 4, 5, 9, 16, 30, 80]))).encode()
    for _ in range(400):
        least = rng.choice([9, 16, 25, 25, 50])
        passage = [line() for _ in range(rng.randint(1, 20))]
        inside = {(a, n) for _, _, around in line_dedup.chunks_of(passage, least) for a, n, *_ in around}
        seen = []
        for _ in range(2):
            before, after = [line() for _ in range(rng.randint(0, 9))], [line() for _ in range(rng.randint(0, 9))]
            found = {}
            for name, at, around in line_dedup.chunks_of([*before, *passage, *after], least):
                for a, n, h1, h2 in around:
                    assert a <= at < a + n
                    found[a - len(before), n] = (name, at - len(before), h1, h2)
            assert found.keys() >= inside
            seen.append([found[x] for x in sorted(inside)])
        assert seen[0] == seen[1]
    with pytest.raises(ValueError):
        line_dedup.row_words(8)


def test_next_boundaries_are_least_of_the_rows_that_follow():
    rng = random.Random(14)
    for _ in range(200):
        values = [rng.randint(0, 5) for _ in range(rng.randint(0, 15))]  # of rows 1, 2 and so on
        for row in range(len(values)):
            after = values[row : row + line_dedup.REACH]
            want = row + 1 + after.index(min(after)) if len(after) == line_dedup.REACH else None
            assert line_dedup.next_boundary(values, row) == want
    assert line_dedup.rolling([1, 1 << 63, 5]) == [2 ^ 1 << 63, 1 ^ 5] and line_dedup.rolling([7]) == []


def test_similarity_is_brute_force():
    rng = random.Random(15)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        x, y = (Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else Counter([tuple(w)]) for w in (a, b))
        want = sum((x & y).values()) / sum((x | y).values())
        assert near_dedup.similarity(" ".join(a), " ".join(b), 3) == want
    many = [f"w{i}" for i in range(20_000)]  # so many words that shingles are named step by step
    assert near_dedup.similarity(" ".join(many), " ".join(many[:-1]), 5) == 19_995 / 19_996


def test_operators_of_very_long_texts(spark):
    rng = random.Random(16)
    lines = [" ".join(words(rng, 12)) for _ in range(25_000)]
    long = "\n".join(lines)  # 1.8 MB
    docs = spark.createDataFrame([(1, long), (2, long.replace(lines[7], "another line")), (3, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert (got[1]["class_id"], got[2]["class_id"], got[3]["class_id"]) == (1, 1, 3)
    kept = {r["doc_id"]: r for r in line_dedup.remove_repeated(docs).collect()}
    assert kept[1]["text"] == long and kept[2]["text"] == "another line"
