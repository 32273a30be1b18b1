"""Decontamination, language, quality, URL filters and sharding against brute force or held-out rows."""

import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from mensura.llm import decontaminate, language, quality, sharding, url_filters
from mensura.llm.queries import RULES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans({i: i + 32 for i in range(65, 91)})


def brute(text, items, size=10):
    words = WORD.findall((text or "").translate(UP))
    hit, found = [False] * len(words), set()
    for item, t in items:
        w = WORD.findall((t or "").translate(UP))
        if item is None or not w:
            continue
        for i in range(max(1, len(w) - size + 1)):
            win = w[i : i + size]
            for j in range(len(words) - len(win) + 1):
                if words[j : j + len(win)] == win:
                    found.add(str(item))
                    hit[j : j + len(win)] = [True] * len(win)
    return len(words), sum(hit), sorted(found)


def contaminated(rng):
    pick = lambda n: " ".join(rng.choice(["la", "Le", "été", "x1", "da", "do"]) for _ in range(n))
    items = [(i, pick(rng.choice([0, 1, 3, 9, 10, 14, 40]))) for i in range(25)] + [(None, pick(12)), (3, pick(12)), (99, None)]
    docs = []
    for i in range(80):
        parts = [pick(rng.randint(0, 30))]
        if i % 3 == 0:
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 10))
            parts += [", ".join(w[a : a + rng.randint(8, 14)]), pick(5)]
        docs.append((i, rng.choice([" ", "... ", "\n"]).join(parts)))
    return items, [*docs, (200, None), (201, ""), (201, ""), (202, "!!")]


@pytest.mark.parametrize("pass_bytes", [1 << 20, 150])
def test_decontamination_is_brute_force(spark, pass_bytes):
    items, rows = contaminated(random.Random(4))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, pass_bytes=pass_bytes).collect()
    want = {r[0]: brute(r[1], items) for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == want[r["doc_id"]] and r["contaminated"] == (r["n_hit"] > 0)
        assert sum(s["words"] for s in r["hit_spans"]) == r["n_hit"]
    assert decontaminate.find_contamination(docs.limit(0), bench, pass_bytes=pass_bytes).count() == 0
    none = decontaminate.find_contamination(docs, bench.limit(0), pass_bytes=pass_bytes).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] for r in none)


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where(language.remainder("doc_id") != 2), per_language=60)
    held = docs.where(language.remainder("doc_id") == 2)
    got = language.identify(held, model).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got) and model.families == ["germanic", "romance"]


def test_language_of_odd_rows(spark):
    rows = [(i, t, x) for i in range(30) for t, x in ((f"the cat of the house number{i}", "en"), (f"le chat de la maison{i}", "fr"), (f"привет мир как дела{i}", "ru"), (f"kotek{i} xyz", "xx"))]
    model = language.train(spark.createDataFrame([*rows, (None, "x", None), (5, None, "en")], "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "123 !!", "s"), (4, "the cat of the house", "s"), (5, "привет мир", "s"), (5, "привет мир", "s"), (6, "the house " * 20_000, "s")], "doc_id long, text string, score string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language.identify(odd, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "ru"), (5, "ru"), (6, "en")]
    empty = language.train(odd.limit(0).withColumn("lang", F.lit("en")))
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0


def test_toxic_documents_are_caught_and_clean_ones_kept(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "pages"))
    planted = spark.createDataFrame([(10_000 + i, f"{t.rstrip('.')} {'stupid worthless idiot scum ' if bad else ''}and more", "en", "src1", 9) for i, (t, bad) in enumerate((r["text"], b) for r in docs.where("lang = 'en'").orderBy("doc_id").limit(20).collect() for b in (0, 1))], docs.schema)
    got = {r["doc_id"]: r for r in quality.judge(docs.unionByName(planted), labels, pages).collect()}
    assert sum(got[10_000 + i]["toxic"] for i in range(1, 40, 2)) >= 19
    clean = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    assert sum(got[i]["kept"] for i in clean) / len(clean) > 0.97
    assert len(got) == docs.count() + 40 and all(0 <= r["p_toxic"] <= 1 and 0 <= r["p_low"] <= 1 for r in got.values())


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "fine words", None), (3, "fine words", "a"), (3, "fine words", "a")], "doc_id long, text string, host string")
    labels = spark.createDataFrame([(3, 1, 0), (3, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(3, "http://a.b/c/d"), (3, None), (None, "x")], "page_id long, url string")
    got = quality.judge(docs, labels, pages).collect()
    assert len(got) == 4 and {r["host"] for r in got} == {"", "a.b"}
    assert quality.judge(docs, labels.limit(0), None).count() == 4
    assert quality.judge(docs.limit(0), labels, pages).count() == 0


def rule_brute(host, path):
    best = None
    for r in RULES:
        h, p = r[: r.index("/")], r[r.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(r) > len(best)):
            best = r
    return best


def test_rules_and_parts_of_urls(spark):
    urls = ["http://EXAMPLE.com/en/1?x#y", "https://www.example.com/en/", "https://a.www.example.com/en/é", "http://xexample.com/en/1", "http://a.net/es/1", "http://a.net/fr", "http://net/fr/", "nothing", None, "", "http://com", "a://b://c/d", "http://h?x/y", "http://h#f", "http:///p", "http://a.com/\nx"]
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)] + [(0, urls[0], "t"), (None, urls[1], "t")], "page_id long, url string, template string")
    got = url_filters.judge(pages, None, RULES).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        u = urls[r["page_id"]] if r["page_id"] is not None else urls[1]
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(UP), m[2]) if m else ("", "")
        rule = rule_brute(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (RULES[rule] if rule else "allow")
    assert url_filters.judge(pages.limit(0), None, RULES).count() == 0


def test_impure_templates_are_rejected(spark):
    rows = [(i, f"http://h.org/{'spam' if i % 2 else 'good'}/{i}") for i in range(200)] + [(500 + i, f"http://few.org/a{i}/x") for i in range(20)]
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), labels, {}).collect()}
    assert all(got[i]["verdict"] == ("block" if i % 2 else "allow") for i in range(200))
    assert {got[i]["template"] for i in range(200)} == {"h.org/spam/*", "h.org/good/*"}
    assert {got[500 + i]["template"] for i in range(20)} == {"few.org/*/x"}


def test_branches_deep_in_a_path_are_told_apart(spark):
    rows = [(i, f"http://h.org/a/b/c/d/{'spam' if i % 2 else 'good'}/{i}") for i in range(200)] + [(300, "http://h.org/" + "x/" * 12)]
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), labels, {}).collect()}
    assert all(got[i]["verdict"] == ("block" if i % 2 else "allow") for i in range(200))
    assert len({got[i]["template"] for i in range(200)}) == 2 and got[300]["template"].count("/") == 12


def tree_of(rows, children=8, rare=0.5, z=1.96, least=5, merges=3):
    """Template of each (host, segments, good or None), by recursion over lists."""
    out = {}

    def step(node, members, merged):
        left = []
        for i, rest in members:
            if rest:
                left.append((i, rest))
            else:
                out[i] = node
        if not left:
            return
        chain = 0
        while all(len(r) > chain for _, r in left) and len({r[chain] for _, r in left}) == 1:
            chain += 1
        node = "/".join([node, *left[0][1][:chain]])
        going = []
        for i, r in left:
            if len(r) > chain:
                going.append((i, r[chain:]))
            else:
                out[i] = node
        kinds = {}
        for i, r in going:
            kinds.setdefault(r[0], []).append((i, r))
        bad = lambda m: [1 - rows[i][2] for i, _ in m if rows[i][2] is not None]
        groups = {}
        every = bad(going)
        for seg, m in kinds.items():
            own = bad(m)
            l, o = len(own), len(every) - len(own)
            pooled = (sum(every) + 1) / (len(every) + 2)
            error = math.sqrt(pooled * (1 - pooled) * (1 / max(l, 1) + 1 / max(o, 1)))
            apart = abs(sum(own) / max(l, 1) - (sum(every) - sum(own)) / max(o, 1)) / error
            many = len(kinds) >= children and len(kinds) >= rare * len(going)
            alike = len(kinds) > 1 and (l < least or o < least or apart < z)
            joined = many or alike or seg.startswith("*")
            name = seg if seg.startswith("*") else "*" if joined else seg
            groups.setdefault(name, []).extend((i, r, merged + 1 if joined else 0) for i, r in m)
        for name, m in groups.items():
            ends = [(i, r) for i, r, k in m if k >= merges and len(r) > 1]
            for i, _ in ends:
                out[i] = f"{node}/{name}/**"
            for k in {k for _, _, k in m}:
                step(f"{node}/{name}", [(i, r[1:]) for i, r, c in m if c == k and (c < merges or len(r) == 1)], k)

    hosts = {}
    for i, (host, rest, _) in enumerate(rows):
        hosts.setdefault(host, []).append((i, [re.sub(r"^[0-9]+$", "*", x) for x in rest]))
    for host, members in hosts.items():
        step(host, members, 0)
    return out


def test_templates_and_purity_are_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        host = rng.choice(["a.org", "b.org", "c.org"])
        rest = [rng.choice([["x", "y"], ["p", "q", "r"], [str(rng.randrange(99)), "n"], [f"s{rng.randrange(40)}"]][k % 4 if host != "b.org" else 0]) for k in range(rng.randrange(0, 7))]
        good = None if rng.random() < 0.3 else int(rng.random() < (0.15 if "y" in rest[:1] else 0.9))
        rows.append((host, rest, good))
    df = spark.createDataFrame([(i, h, "/" + "/".join(r), g) for i, (h, r, g) in enumerate(rows)], "page long, host string, path string, good int")
    got = {r["page"]: r for r in url_filters.templates(df, merges=2).collect()}
    want = tree_of(rows, merges=2)
    assert {i: got[i]["template"] for i in want} == want and len(got) == len(rows) and len(set(want.values())) > 20
    marks = [r[2] for r in rows if r[2] is not None]
    prior = (sum(marks) + 1) / (len(marks) + 2)
    for i, (host, _, _) in enumerate(rows):
        site = [r[2] for r in rows if r[0] == host and r[2] is not None]
        own = [rows[j][2] for j in want if want[j] == want[i] and rows[j][2] is not None]
        base = (sum(site) + 8 * prior) / (len(site) + 8)
        assert abs(got[i]["purity"] - (sum(own) + 8 * base) / (len(own) + 8)) < 1e-12


def test_a_very_long_path_is_a_few_steps(spark):
    rows = [(i, f"http://h.org/{'spam' if i % 2 else 'good'}/{i}") for i in range(60)] + [(100, "http://h.org/" + "x/" * 5000), (101, "http://h.org/spam/" + "".join(f"a{i}/" for i in range(5000))), *[(200 + i, f"http://deep.org/{'/'.join(f'{i}v{k}' for k in range(900))}") for i in range(12)]]
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), labels, {}, merges=3).collect()}
    assert len(got) == len(rows) and all(got[i]["verdict"] == ("block" if i % 2 else "allow") for i in range(60))
    assert {got[200 + i]["template"] for i in range(12)} == {"deep.org/*/*/*/**"}


def check_shards(got, rows, shards):
    sizes = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= 3 * max(r["size"] for r in got)
    want = sorted((r[0] or -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_shards_have_near_equal_bytes(spark):
    rng = random.Random(6)
    rows = [(i + 1, "é" * rng.randint(0, 300), rng.choice(["en", "de", None])) for i in range(900)] + [(2000 + i, "the same text " * 9, "en") for i in range(700)] + [(None, None, None), (7, "again", "en"), (7, "again", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sharding.assign(docs, 24).collect()
    check_shards(got, rows, 24)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_shards_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    got = sharding.assign(docs, 24).collect()
    assert len(got) == 3 and all(r["slot"] == 0 for r in got)
    assert sharding.assign(docs.limit(0), 24).count() == 0
    many = sharding.assign(spark.range(500).selectExpr("id as doc_id", "repeat('x', 92) as text"), None, target_bytes=5000).collect()
    assert len({r["shard"] for r in many}) == 10


def test_language_of_very_long_texts_takes_little_memory():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(2)
    model = language.Model(["a", "b"], {"a": ["a"], "b": ["b"]}, [], rng.normal(size=(language.SIZE, 2)).astype(np.float32), np.zeros(2))
    long = "some words of a long text " * 300_000
    tracemalloc.start()
    langs, scores = model.predict(["x", long, "y z"])
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
    raw = np.frombuffer(b" " + long.encode() + b"   ", np.uint8)
    margins = model.weights[language.features(raw)].mean(axis=0, dtype=np.float64)
    assert langs[1] == "ab"[int(margins.argmax())] and abs(scores[1] - language._logistic(margins.max())) < 1e-6
    at, share = language.shares(long)
    assert np.array_equal(at, np.unique(language.features(raw))) and abs(share.sum() - 1) < 1e-4


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i % 70) * 5} {chr(0x4E00 + i % 70) * 3}", f"l{i % 70}") for i in range(210)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sum(map(len, model.langs.values())) == 70 and model.predict([rows[65][1]])[0] == ["l65"]


def test_language_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "abc", "x", "y")], "doc_id long, text string, __text string, own_text string")
    model = language.train(docs.withColumn("lang", docs["__text"]))
    assert language.identify(docs, model).columns == ["doc_id", "text", "__text", "own_text", "lang_pred", "score"]
    assert language.identify(docs, model).first()["lang_pred"] == "x"


def test_cuts_are_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, "x" * rng.choice([3, 3, 3, 50, rng.randint(0, 400)])) for i in range(500)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    left = sorted((r["size"] for r in got if r["shard"] == 0))
    right = sorted((r["size"] for r in got if r["shard"] == 1))
    assert left[-1] <= right[0] or sorted(r["text_crc32"] for r in got if r["shard"] == 0)[-1] <= min(r["text_crc32"] for r in got if r["shard"] == 1)
    whole, best, total = sum(left) + sum(right), None, 0
    for s in [0, *sorted(left + right)]:
        total += s
        best = min(x for x in (best, abs(whole / 2 - total)) if x is not None)
    assert abs(whole / 2 - sum(left)) <= max(best, max(left + right) / 2)
