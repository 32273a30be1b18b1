"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become lower-case words between single spaces, and each window of consecutive item words is
a pattern with a space at both ends, so a match in bytes is a match in words.  Tables over blocks
of bytes say how far the search may skip; a block that ends some pattern's prefix names a bucket
of patterns, and these are compared with the text directly.  Patterns are searched by classes of
length, so that short items don't shorten the skips of the rest.

A pass holds the patterns of so many bytes of items at most; more items take more passes.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import free_name, held, lean, slices, with_row_ids

#: Bytes of item texts whose windows one pass holds.
PASS_BYTES = 128 * 1024

#: A byte of a word becomes itself in lower case, any other byte a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def as_words(text: str, most: int = 1 << 22) -> Iterator[bytes]:
    """A text's words between spaces, in pieces of some `most` bytes that divide no word."""
    flat = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    start = 0
    while start < len(flat):
        end = flat.find(b" ", start + most) if len(flat) - start > most else -1
        yield flat[start : end if end >= 0 else len(flat)]
        start = end if end >= 0 else len(flat)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: runs of digits, letters a-z (A-Z lower-cased) and all that is not ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def windows_of(text: str | None, size: int) -> list[bytes]:
    """All windows of size words, or the one of all words where these are fewer but some."""
    words = words_of(text)
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Search for many byte strings of similar length at once."""

    def __init__(self, patterns: list[bytes]):
        self.least = m = min(map(len, patterns))
        #: Blocks long enough that few blocks of a text occur in any pattern by chance.
        self.block = k = max(1, min(m, math.ceil(math.log(2 * m * len(patterns) + 1, 6))))
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(k, m + 1):
                b = p[end - k : end]
                far = self.shift.get(b, m)
                if m - end < far:
                    self.shift[b] = m - end
            self.bucket[p[m - k : m]].append(p)

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(place, pattern) of every occurrence, places in rising order."""
        m, k, get = self.least, self.block, self.shift.get
        far, end, n = m - k + 1, m, len(text)
        while end <= n:
            skip = get(text[end - k : end], far)
            if skip:
                end += skip
                continue
            for p in self.bucket[text[end - k : end]]:
                if text.startswith(p, end - m):
                    yield end - m, p
            end += 1


class Windows:
    """The windows of some items, and where they occur in a text."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            for w in windows_of(text, size):
                self.items[w].add(item)
        classes = defaultdict(list)
        for w in self.items:
            classes[len(w).bit_length()].append(w)
        self.searches = [WuManber(c) for c in classes.values()]

    def find(self, text: str) -> tuple[int, set[str], list[tuple[int, int]]]:
        """Number of words, items found, and the maximal runs of hit words as (first word, words)."""
        words = words_of(text)
        if not words:
            return 0, set(), []
        flat = b" " + b" ".join(words) + b" "
        found = [(at, p) for s in self.searches for at, p in s.search(flat)]
        if not found:
            return len(words), set(), []
        found.sort()
        runs: list[list[int]] = []
        for at, p in found:
            if runs and at < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], at + len(p))
            else:
                runs.append([at, at + len(p)])
        spans, place, before = [], 0, 0
        for lo, hi in runs:
            before += flat.count(b" ", place, lo)
            inside = flat.count(b" ", lo, hi)
            spans.append((before, inside - 1))
            before += inside
            place = hi
        return len(words), set().union(*(self.items[p] for _, p in found)), spans


SPAN = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType())]))


def _search(docs: DataFrame, text: str, items: list[tuple[str, str | None]], size: int) -> DataFrame:
    given = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.col(f"`{text}`").cast("string"))
    new = [("n_words", T.LongType()), ("items", T.ArrayType(T.StringType())), ("hit_spans", SPAN)]
    schema = T.StructType([*given.schema.fields, *[T.StructField(n, t) for n, t in new]])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = held(("windows", size, tuple(items)), lambda: Windows(items, size))
        span = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64())]))
        for batch in batches:
            for texts, part in slices(batch):
                got = [windows.find(t) for t in texts]
                done = [
                    pa.array([n for n, _, _ in got], pa.int64()),
                    pa.array([sorted(i) for _, i, _ in got], pa.list_(pa.string())),
                    pa.array([[{"first_word": a, "words": w} for a, w in s] for _, _, s in got], span),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *done], names)

    return given.mapInArrow(lean(run), schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items, hit_spans and contaminated.

    A window is size consecutive words of an item, or all of a shorter item.  items: sorted distinct
    ids (as strings) of items with a window in the document; hit_spans: maximal runs of words inside
    occurrences.  Null and wordless texts have no words and no hits; items without words or without
    an id give nothing.  Rows are answered one by one, repeated ones too.  Result columns replace
    columns of the same names.  If the items need more than one pass, docs is written out first where it
    isn't a table of files, and passes are brought together by files and places in them.
    """
    new = {"n_words", "n_hit", "items", "hit_spans", "contaminated"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new or c == text])
    chosen = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("i is not null and t is not null").distinct()
    passes: list[list[tuple[str, str]]] = [[]]
    held = 0
    for i, t in chosen.orderBy("i", "t").toLocalIterator():  # one pass's worth at a time leaves the list
        if passes[-1] and held + len(t) > pass_bytes:
            passes.append([])
            held = 0
        passes[-1].append((i, t))
        held += len(t)
    if len(passes) == 1:
        found = _search(docs, text, passes[0], size)
    else:
        rid = free_name(docs, "rid")
        docs = with_row_ids(docs, rid, keep=True)
        each = [_search(docs.select(rid, text), text, p, size).drop(text) for p in passes]
        both = each[0]
        for e in each[1:]:
            both = both.unionByName(e)
        both = both.groupBy(rid).agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("hit_spans"))
        found = docs.join(both, rid).drop(rid).withColumn("hit_spans", _merged())
    return found.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])).withColumn("contaminated", F.col("n_hit") > 0)


def _merged():
    """hit_spans, sorted, with runs that touch or overlap made one."""
    return F.expr(
        """aggregate(hit_spans, cast(array() as array<struct<first_word:bigint,words:bigint>>), (a, s) ->
        case when size(a) > 0 and s.first_word <= element_at(a, -1).first_word + element_at(a, -1).words
        then concat(slice(a, 1, size(a) - 1), array(named_struct('first_word', element_at(a, -1).first_word,
        'words', greatest(element_at(a, -1).words, s.first_word + s.words - element_at(a, -1).first_word))))
        else concat(a, array(s)) end)"""
    )


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The query's columns from find_contamination's result."""
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
