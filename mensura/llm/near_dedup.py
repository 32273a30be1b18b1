"""Near-duplicate classes by DartMinHash.

A document is a weighted set: its shingles of SHINGLE words with their frequencies.  Over the
weighted region of each shingle hashed darts are thrown, a Poisson process of rank and place that
is the same in every document; a document looks only at ranks low enough to hold a fixed expected
number of darts for its total weight, and keeps for each coordinate the dart of lowest rank.  Two
documents keep the same dart with a chance that equals their weighted Jaccard similarity.

Bands of coordinates name buckets.  Documents with equal words are one representative from the
start.  Within a bucket each representative is compared with a leader, exactly, on whole texts; links
join representatives into classes.  In buckets that still hold several classes every two
representatives of different classes are compared by their shingles' hashes, many at a time as a
product of matrices; of the links between two classes one is checked on whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import free_name, lean, scratch, slices, with_row_ids, written
from mensura.llm.decontaminate import words_of

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5

#: Columns of a product of matrices; representatives of a bucket's part at most, or bytes of their texts, on average.
WIDTH, PART, PART_BYTES = 2048, 1024, 32_000_000

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters its input."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hashes of all windows of size words in their order; of all words where these are fewer."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    h = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for j in range(min(size, len(w))):
        h = _mixed(h * _U(0x9E3779B97F4A7C15) + w[j : j + n])
    return h


def cells(hashes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of a weighted set's region, and the part of each that the weight covers.

    Without weights an element weighs as often as it occurs.
    """
    if weights is None:
        h = np.sort(hashes)
        start = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1)) if len(h) else np.zeros(0, int)
        copy = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
        return _mixed(h + copy.astype(np.uint64) * _U(0xD1342543DE82EF95)), np.ones(len(h))
    n = np.ceil(weights).astype(int)
    copy = np.concatenate([np.arange(k) for k in n]) if len(n) else np.zeros(0, int)
    part = np.minimum(1.0, np.repeat(weights, n) - copy)
    return _mixed(np.repeat(hashes, n) + copy.astype(np.uint64) * _U(0xD1342543DE82EF95)), part


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = BANDS * ROWS) -> np.ndarray:
    """The darts kept by each of some weighted sets (cells), len(sets) x k; 0 throughout for an empty set."""
    best = np.full(len(sets) * k, np.inf)
    kept = np.zeros(len(sets) * k, np.uint64)
    left = np.array([i for i, (c, _) in enumerate(sets) if len(c)], int)
    darts = k * math.log(k) + 2 * k
    while len(left):
        cell = np.concatenate([sets[i][0] for i in left])
        part = np.concatenate([sets[i][1] for i in left])
        size = np.array([len(sets[i][0]) for i in left])
        total = np.array([sets[i][1].sum() for i in left])
        owner, ranks = np.repeat(left, size), np.repeat(darts / total, size)
        rank, throw = np.zeros(len(cell)), 0
        while len(cell):
            throw += 1
            dart = _mixed(cell + _U(throw * 0x2545F4914F6CDD1D & (1 << 64) - 1))
            rank = rank - np.log(((dart >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            on = rank < ranks
            cell, part, owner, ranks, rank, dart = (x[on] for x in (cell, part, owner, ranks, rank, dart))
            dart = _mixed(dart)
            hit = (dart & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < part  # the dart's place within its cell
            slot = owner[hit] * k + ((dart[hit] >> _U(32)) % _U(k)).astype(int)
            np.minimum.at(best, slot, rank[hit])
            won = rank[hit] == best[slot]
            kept[slot[won]] = dart[hit][won]
        bare = np.isinf(best.reshape(len(sets), k)).any(axis=1)
        left = left[bare[left]]
        darts *= 2  # some coordinate got no dart: these sets look at more ranks
    return kept.reshape(len(sets), k)


def band_names(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.shape[1] // bands
    h = np.zeros((len(signature), bands), np.uint64)
    for j in range(rows):
        h = _mixed(h * _U(0x9E3779B97F4A7C15) + signature[:, j : rows * bands : rows])
    return h.view(np.int64)


def _signed(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """(key, rid, h1, h2, bands) for rows (key, rid, text) with a word: the hash of all words, and the bands' names."""
    kind, place = (docs.schema[c].dataType.simpleString() for c in ("key", "rid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "rid", "h1", "h2", "bands"]
        for batch in batches:
            for texts, part in slices(batch):
                words = [words_of(t) for t in texts]
                have = [i for i, w in enumerate(words) if w]
                own = part.select([0, 1]).take(pa.array(have, pa.int64()))
                digests = [blake2b(b" ".join(words[i]), digest_size=16).digest() for i in have]
                halves = [pa.array([int.from_bytes(d[a : a + 8], "little", signed=True) for d in digests], pa.int64()) for a in (0, 8)]
                named = band_names(signatures([cells(shingles(words[i], size)) for i in have], bands * rows), bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1, dtype=np.int32) * bands), pa.array(named.ravel()))
                yield pa.RecordBatch.from_arrays([*own.columns, *halves, lists], names)

    return docs.mapInArrow(lean(run), f"key {kind}, rid {place}, h1 bigint, h2 bigint, bands array<bigint>")


def similarity(a: str, b: str, size: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of two texts' shingles, by words and not by hashes; 8 bytes a word and step are held."""
    x, y = words_of(a), words_of(b)
    if len(x) < size or len(y) < size:
        return float(x == y)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in (*x, *y)), np.int64, len(x) + len(y))
    code, most = ids, len(number)
    for j in range(1, size):  # a shingle of j + 1 words is named by the one of its first j and the next word
        if most * len(number) >= 1 << 62:
            named, code = np.unique(code, return_inverse=True)
            most = len(named)
        code = code[:-1] * len(number) + ids[j:]
        most *= len(number)
    n, m = len(x) - size + 1, len(y) - size + 1
    mine, often = np.unique(code[:n], return_counts=True)
    other, there = np.unique(code[len(x) :], return_counts=True)
    _, i, j = np.intersect1d(mine, other, assume_unique=True, return_indices=True)
    both = int(np.minimum(often[i], there[j]).sum())
    return both / (n + m - both)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough.  Texts are brought to each pair; an `a` with very many pairs is split."""
    first = texts.select(F.col("rid").alias("a"), F.col("text").alias("ta"))
    second = texts.select(F.col("rid").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(first, "a").select("a", "b", "ta").join(second, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            ok = pa.array([similarity(a[i].as_py(), b[i].as_py(), size) >= least for i in range(batch.num_rows)], pa.bool_())
            yield batch.select([0, 1]).filter(ok)

    return both.mapInArrow(lean(run), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for all ends of edges (a, b): the smallest v of each connected component.

    Each step takes the least of a vertex's label, its neighbours' and its label's own, and is written
    out; steps are few as labels jump.  Nothing of the graph reaches the driver but one sum.
    """
    sides = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(sides.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("label")).select("v", "label"), "labels")
    while True:
        near = sides.join(labels, F.col("b") == F.col("v")).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        top = labels.select(F.col("v").alias("label"), F.col("label").alias("top"))
        least = labels.join(top, "label").join(near, "v")
        new = written(least.select("v", F.least("label", "near", "top").alias("label"), (F.least("near", "top") < F.col("label")).alias("moved")), "labels")
        labels = new.select("v", "label")
        if not new.where("moved").limit(1).count():
            return labels


def _shared_buckets(reps: DataFrame, bands: int) -> DataFrame:
    """(band, name, rid) for buckets with more than one representative (rid, bands)."""
    names = reps.select("rid", F.posexplode("bands").alias("band", "name"))
    many = written(names.groupBy("band", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "many")
    return written(names.join(many, ["band", "name"]), "shared")


def _led(buckets: DataFrame) -> DataFrame:
    """Pairs of a bucket's leader, its smallest rid, with each other representative, for rows (band, name, rid)."""
    leaders = written(buckets.groupBy("band", "name").agg(F.min("rid").alias("a")), "leaders")
    return buckets.join(leaders, ["band", "name"]).where("a < rid").select("a", F.col("rid").alias("b")).distinct()


def _celled(texts: DataFrame, size: int) -> DataFrame:
    """(rid, cells) for rows (rid, text): the cells as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, part in slices(batch):
                got = [cells(shingles(words_of(t), size))[0].tobytes() for t in some]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], ["rid", "cells"])

    return texts.select("rid", "text").mapInArrow(lean(run), "rid bigint, cells binary")


def alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Whether each of the sets `left` has a similarity of `least` or more with each of `right`; sets are unit cells."""
    sizes = np.array([len(x) for x in sets])
    _, cell, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[cell]  # a cell of one set is in no intersection
    owner = np.repeat(np.arange(len(sets)), sizes)[column >= 0]
    column = column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        lo, hi = np.searchsorted(column, [start, start + WIDTH])
        has = np.zeros((len(sets), int(column[hi - 1]) - start + 1), np.float32)
        has[owner[lo:hi], column[lo:hi] - start] = 1
        both += has[left] @ has[right].T
    return both / (sizes[left][:, None] + sizes[right][None, :] - both) >= least


def joining(rids: list[int], labels: list[int], sets: list[np.ndarray], sides: list[int], least: float, refused: frozenset = frozenset()) -> list[tuple[int, int, int, int]]:
    """(la, lb, a, b): links enough to join all labels that any link joins, among all pairs of a set of side 0 with one of side 1, or of all where no side is 1."""
    lab = np.unique(labels, return_inverse=True)[1]
    if lab.max(initial=0) == 0:
        return []
    left = np.flatnonzero(np.array(sides) == 0)
    right = np.flatnonzero(np.array(sides) == 1) if any(sides) else left
    ok = np.zeros((len(sets), len(sets)), bool)
    ok[np.ix_(left, right)] = alike(sets, left, right, least)
    ok |= ok.T
    place = {r: i for i, r in enumerate(rids)}
    for a, b in refused:
        if a in place and b in place:
            ok[place[a], place[b]] = ok[place[b], place[a]] = False
    members = np.split(np.argsort(lab, kind="stable"), np.cumsum(np.bincount(lab))[:-1])
    unseen, out = np.ones(len(members), bool), []
    for first in range(len(members)):
        stack = [first] if unseen[first] else []
        unseen[first] = False
        while stack:
            for d in members[stack.pop()]:
                to = np.flatnonzero(ok[d] & unseen[lab])
                for k, i in zip(*np.unique(lab[to], return_index=True)):
                    unseen[k] = False
                    stack.append(int(k))
                    a, b = sorted((int(d), int(to[i])), key=lambda x: rids[x])
                    out.append((*sorted((labels[a], labels[b])), rids[a], rids[b]))
    return out


def _unsettled(buckets: DataFrame, labels: DataFrame, words: DataFrame, part: int) -> DataFrame:
    """(band, name, part, other, side, rid, label) for buckets of more than two representatives (a leader has met the other of two) and of several classes.

    A large bucket is dealt into parts by hash, and each two of them are a group of their own; of these the rows of `other` have side 1.
    """
    labelled = written(buckets.join(labels, "rid").join(words, "rid"), "labelled")
    several = labelled.groupBy("band", "name").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"))
    parts = F.ceil(F.greatest(F.col("n") / part, F.col("n_bytes") / PART_BYTES)).cast("int")
    several = written(several.where("lo < hi and n > 2").select("band", "name", parts.alias("parts")), "several")
    mine = labelled.join(several, ["band", "name"]).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    each = mine.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select("band", "name", F.least("own", "x").alias("part"), F.greatest("own", "x").alias("other"), (F.col("own") > F.col("x")).cast("int").alias("side"), "rid", "label")


def _joined(unsettled: DataFrame, sets: DataFrame, least: float, refused: frozenset) -> DataFrame:
    """(la, lb, a, b): one link for two labels, enough to join all classes that a link within a bucket joins."""
    key = ["band", "name", "part", "other"]
    rows = unsettled.join(sets, "rid").select(*key, "side", "rid", "label", "cells").repartition(*key).sortWithinPartitions(*key)

    def found(group: list[tuple]) -> list[tuple[int, int, int, int]]:
        side, rid, label, held = zip(*group)
        return joining(list(rid), list(label), [np.frombuffer(x, np.uint64) for x in held], list(side), least, refused)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None
        names = ["la", "lb", "a", "b"]
        for batch in batches:
            out = []
            for *k, side, rid, label, held in zip(*(c.to_pylist() for c in batch.columns)):
                if k != at:
                    out += found(group) if group else []
                    group, at = [], k
                group.append((side, rid, label, held))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names)
        out = found(group) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names)

    got = rows.mapInArrow(lean(run), "la bigint, lb bigint, a bigint, b bigint")
    return got.groupBy("la", "lb").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b").distinct()


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (rid, label) once links (a, b) have joined classes: only the graph of their labels is searched for components."""
    ends = links.join(labels.select(F.col("rid").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("rid").alias("b"), F.col("label").alias("lb")), "b")
    joined = components(written(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct(), "joined"))
    return written(labels.join(joined.select(F.col("v").alias("label"), F.col("label").alias("to")), "label", "left").select("rid", F.coalesce("to", "label").alias("label")), "labels")


def _links(reps: DataFrame, same: DataFrame, base: DataFrame, least: float, size: int, bands: int, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between representatives (rid, bands), whose rows of base `same` names, enough for their classes though not all pairs of a class; labels (rid, label) of those in shared buckets.

    First leaders are compared with their buckets; then all pairs of different classes in buckets of several.
    That is done once, and again only where texts refuse a pair whose hashes agree.
    """
    buckets = _shared_buckets(reps, bands)
    wanted = written(same.select("rid", "rep").join(buckets.select("rid").distinct(), "rid"), "wanted")
    # merge, here and where texts meet classes: such tables grow with the corpus, so they are not broadcast at any size
    texts = written(base.select(F.col("rid").alias("rep"), "text").join(wanted.hint("merge"), "rep").select("rid", "text"), "texts")
    links = written(_verified(written(_led(buckets), "pairs"), texts, size, least), "links")
    labels = _relabelled(texts.select("rid", F.col("rid").alias("label")), links)
    words = texts.select("rid", F.length(F.col("text").cast("binary")).alias("n_bytes"))  # as many as cells take, nearly
    unsettled = written(_unsettled(buckets, labels, words, part), "unsettled")
    sets = written(_celled(texts.join(unsettled.select("rid").distinct(), "rid", "left_semi"), size), "cells")
    refused: frozenset = frozenset()
    while True:
        pairs = written(_joined(unsettled, sets, least, refused), "pairs")
        new = written(_verified(pairs, texts, size, least), "links")
        if new.limit(1).count():
            links = links.union(new)
            labels = _relabelled(labels, new)
        wrong = [tuple(r) for r in pairs.join(new, ["a", "b"], "left_anti").collect()]
        if not wrong:
            return links, labels
        refused |= frozenset(wrong)
        unsettled = written(_unsettled(buckets, labels, words, part), "unsettled")


def classes(base: DataFrame, least: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, rid, class_rid, n_links) for each row (key, rid, text) with a word."""
    signed = written(_signed(base, bands, rows, size), "signed")
    # rep: the row that stands for equal words; rid, from here on, its number
    same = written(signed.groupBy("h1", "h2").agg(F.min("rid").alias("rep")).withColumn("rid", F.monotonically_increasing_id()), "same")
    reps = written(signed.select(F.col("rid").alias("rep"), "bands").join(same.select("rep", "rid"), "rep").select("rid", "bands"), "reps")
    links, labels = _links(reps, same, base, least, size, bands)
    ends = links.select(F.col("a").alias("rid")).union(links.select("b")).groupBy("rid").agg(F.count(F.lit(1)).alias("n_links"))
    of_rep = same.join(labels, "rid", "left").join(ends, "rid", "left")
    of_rep = of_rep.select("h1", "h2", F.coalesce("label", "rid").alias("class_rid"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return signed.select("key", "rid", "h1", "h2").join(written(of_rep, "classes"), ["h1", "h2"]).select("key", "rid", "class_rid", "n_links")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs, with docs' columns and class_id, class_size, n_links, kept.

    Words are runs of digits, letters (A-Z lower-cased) and non-ASCII characters; a text of fewer
    words than a shingle has the one shingle of all its words.  Classes are the connected
    components of links: weighted Jaccard similarity of shingle frequencies of `least` or more,
    checked on whole texts.  class_id is the smallest key of the class (null only where all keys
    are), n_links the number of links that were
    found for the row's words, 0 where only equal words or none are in its class.  Of
    a class the row with the smallest key stays, a null key after all others, and of equal keys one.
    Null texts and texts without words are classes of their own and stay.
    """
    new = ["class_id", "class_size", "n_links", "kept"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    own = free_name(docs, "rid")
    with scratch(docs.sparkSession):
        placed = with_row_ids(docs, own, keep=True)
        base = placed.select(F.col(f"`{key}`").alias("key"), F.col(own).alias("rid"), F.col(f"`{text}`").cast("string").alias("text"))
        found = written(classes(base, least, size, bands, rows), "members")
        first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "rid")).alias("first")
        groups = written(found.groupBy("class_rid").agg(first, F.count(F.lit(1)).alias("class_size")), "groups")
        members = found.join(groups, "class_rid").select(F.col("rid").alias(own), F.col("first.key").alias("class_id"), "class_size", "n_links", (F.col("rid") == F.col("first.rid")).alias("kept"))
        members = written(members, "members", keep=True)
    out = placed.join(members.hint("merge"), own, "left")
    alone = F.col("kept").isNull()
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(alone, F.col(f"`{key}`")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("kept", F.lit(True)).alias("kept"))
