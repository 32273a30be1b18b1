"""Line deduplication by content-defined chunks of lines.

Lines are often whole paragraphs, so each is first wrapped into rows of a few words, anew from its start; a short
line is one row.  A rolling hash runs over the hashes of rows, two at a time.  From any row on, the
next boundary is the row of least rolling hash among the next REACH rows, whatever the lengths of lines: so boundaries are where the content
says, and come again after whatever was inserted before.  A chunk reaches from one boundary to the next and holds
several rows.

Chunks are counted over the whole table, a row each.  Around those that occur again grow the passages that are
removed, line by line: as few whole lines as have MIN_WORDS words together.  A longer passage is covered by such least
passages to both ends, wherever it stands, and each of them has a chunk that its own rows alone decide, so
none is missed.  Least passages that occur again are compared byte by byte; then the lines of
every occurrence but the first go.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from mensura.llm.common import free_name, lean, scratch, slices, with_row_ids, written

#: Rows among which the next boundary is, words of a passage that is removed.
REACH, MIN_WORDS = 4, 25

#: Rows that decide a chunk: the one that the first rolling hash sees before its own, and those of two boundaries.
DECIDE = 2 * REACH + 1

_MASK = (1 << 64) - 1


def rolling(hashes: list[int]) -> list[int]:
    """The rolling hash of each two rows in turn: the older one's bits go round by one place, the newer one's come on top."""
    return [((a << 1 | a >> 63) & _MASK) ^ b for a, b in zip(hashes, hashes[1:])]


def row_words(min_words: int) -> int:
    """Words of a row, such that a passage of min_words has the rows that decide a chunk."""
    if min_words < DECIDE:
        raise ValueError(f"min_words must be {DECIDE} or more")
    return (min_words - 1) // (DECIDE - 1)


def next_boundary(values: list[int], row: int) -> int | None:
    """The first row of least rolling hash among the REACH rows after a row; None where there are fewer.  values[i] is that of row i + 1."""
    near = values[row : row + REACH]
    return row + 1 + near.index(min(near)) if len(near) == REACH else None


class Cut:
    """Lines with words of a text (numbers in the text, words of each), wrapped into rows where a passage needs them."""

    def __init__(self, lines: list[bytes], size: int):
        counted = [(i, w) for i, x in enumerate(lines) if (w := x.split())]
        self.at = [i for i, _ in counted]
        self.split = [w for _, w in counted]
        self.words = [len(w) for w in self.split]
        self.size = size
        self.known: dict[int, list[int]] = {}

    def rows(self, k: int) -> list[int]:
        """Hashes of a line's first rows, DECIDE at most."""
        if k not in self.known:
            w, n = self.split[k], self.size
            self.known[k] = [xxh3_64_intdigest(b" ".join(w[i : i + n])) for i in range(0, min(len(w), DECIDE * n), n)]
        return self.known[k]

    def passages(self, least: int) -> list[tuple[int, int]]:
        """(first, last) of the fewest lines of `least` words that start, or that end, with each line."""
        ends, a, n = set(), 0, 0
        for b, w in enumerate(self.words):
            n += w
            if n < least:
                continue
            if not ends:
                ends.add((a, b))
            while n - self.words[a] >= least:
                n -= self.words[a]
                a += 1
                ends.add((a, b))  # b is the first end for this start
            ends.add((a, b))  # a is the last start for this end
        return sorted(ends)

    def chunk(self, first: int) -> tuple[int, int]:
        """(name, line where it starts) of the chunk between the first two boundaries after the first row of a line."""
        hashes, lines, k = self.rows(first), [], first
        if len(hashes) < DECIDE:
            lines = [first] * len(hashes)
            hashes = list(hashes)
            while len(hashes) < DECIDE:  # a passage has as many
                k += 1
                hashes += self.rows(k)
                lines += [k] * len(self.rows(k))
        values = rolling(hashes)
        start = next_boundary(values, 0)
        end = next_boundary(values, start)
        body = struct.pack(f"<{end + 1 - start}Q", *hashes[start : end + 1])
        return xxh3_64_intdigest(body) - (1 << 63), lines[start] if lines else first


def boundaries(lines: list[bytes], min_words: int = MIN_WORDS) -> tuple[int, list[int]]:
    """Rows of a text, and those that are boundaries, each the next one of that before it."""
    n = row_words(min_words)
    hashes = [xxh3_64_intdigest(b" ".join(w[i : i + n])) for x in lines if (w := x.split()) for i in range(0, len(w), n)]
    values, out, at = rolling(hashes), [], 0
    while (at := next_boundary(values, at)) is not None:
        out.append(at)
    return len(hashes), out


def _lines(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n")


def _name(passage: bytes) -> tuple[int, int]:
    d = blake2b(passage, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


#: A least passage around a chunk: first line, lines, and its name.
AROUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("lines", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))


def chunks_of(lines: list[bytes], min_words: int) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """(name, line, least passages that grow around it) of each chunk."""
    cut, around, place = Cut(lines, row_words(min_words)), {}, {}
    for a, b in cut.passages(min_words):
        if a not in place:
            place[a] = cut.chunk(a)
        body = b"\n".join([lines[i] for i in cut.at[a : b + 1]])
        around.setdefault(place[a], []).append((cut.at[a], cut.at[b] + 1 - cut.at[a], *_name(body)))
    for (name, line), passages in around.items():
        yield name, cut.at[line], passages


def _chunk_table(rows: DataFrame, min_words: int) -> DataFrame:
    """(key, rid, chunk, chunk_at, around) for each chunk of rows (key, rid, text)."""
    new = [T.StructField("chunk", T.LongType()), T.StructField("chunk_at", T.IntegerType()), T.StructField("around", AROUND)]
    schema = T.StructType([*rows.schema.fields[:2], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, part in slices(batch):
                at, names, places, ends = [], [], [], [0]
                flat: list[list[int]] = [[], [], [], []]
                for i, t in enumerate(texts):
                    for name, line, passages in chunks_of(_lines(t), min_words):
                        at.append(i)
                        names.append(name)
                        places.append(line)
                        for p in passages:
                            for col, v in zip(flat, p):
                                col.append(v)
                        ends.append(len(flat[0]))
                own = part.select([0, 1]).take(pa.array(at, pa.int64()))
                each = pa.StructArray.from_arrays([pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.int32()), pa.array(flat[2], pa.int64()), pa.array(flat[3], pa.int64())], ["start", "lines", "h1", "h2"])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names, pa.int64()), pa.array(places, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], schema.names)

    return rows.mapInArrow(lean(run), schema)


def _spans(found: list[dict] | None) -> list[tuple[int, int]]:
    """(first line, lines) to remove: what occurrences after the first cover, but not of the first occurrence itself where they overlap it."""
    out: list[tuple[int, int]] = []
    ends: list[tuple[int, int]] = []
    for c in found or []:
        start, end = c["start"], c["start"] + c["lines"]
        if not c["first"]:
            ends.append((max(start, c["kept_to"] or 0), end))
    for start, end in sorted(x for x in ends if x[0] < x[1]):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end - out[-1][0]))
        else:
            out.append((start, end - start))
    return out


def _texts_of(rows: DataFrame) -> DataFrame:
    """(h1, h2, body) of each repeated passage of rows (found, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, part in slices(batch):
                h1, h2, body = [], [], []
                for t, found in zip(texts, part.column(0).to_pylist()):
                    lines = _lines(t)
                    for c in found:
                        h1.append(c["h1"])
                        h2.append(c["h2"])
                        body.append(b"\n".join([x for x in lines[c["start"] : c["start"] + c["lines"]] if x.split()]))
                yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(body, pa.binary())], ["h1", "h2", "body"])

    return rows.mapInArrow(lean(run), "h1 bigint, h2 bigint, body binary")


def remove_repeated(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with its text without repeated passages of min_words (9 at least) words or more, and n_lines, lines_removed, words_removed, removed_spans.

    Lines end with a line feed.  The first occurrence, by key (null first), file and place in it,
    stays; occurrences within one document count too.  removed_spans: (first_line, lines) of the
    given text.  A null text stays null and has no lines; an empty text has one, empty line.  A text
    all of whose lines go becomes empty; its row stays.  Result columns replace columns of the
    same names; every other column comes through.
    """
    new = ["n_lines", "lines_removed", "words_removed", "removed_spans"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    rid, found = free_name(docs, "rid"), free_name(docs, "found")
    with scratch(docs.sparkSession):
        rows = with_row_ids(docs, rid)
        table = written(_chunk_table(rows.select(F.col(f"`{key}`").alias("key"), F.col(rid).alias("rid"), F.col(f"`{text}`").cast("string").alias("text")), min_words), "chunks")
        where = F.struct("rid", "chunk_at")
        common = written(table.groupBy("chunk").agg(F.min(where).alias("lo"), F.max(where).alias("hi")).where("lo <> hi").select("chunk"), "repeated")
        # here and below both sides are read anew, so that the join splits what has very many occurrences
        grown = written(table.join(common, "chunk", "left_semi").select("key", "rid", F.inline("around")), "grown")
        place = F.struct("key", "rid", "start", "lines")
        again = written(grown.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")).where("n > 1").drop("n"), "passages")
        hits = grown.join(again, ["h1", "h2"]).withColumn("first", (F.col("rid") == F.col("at.rid")) & (F.col("start") == F.col("at.start")))
        hits = hits.withColumn("kept_to", F.when(F.col("rid") == F.col("at.rid"), F.col("at.start") + F.col("at.lines")))

        def attached(hits: DataFrame) -> DataFrame:
            each = F.collect_list(F.struct("start", "lines", "h1", "h2", "first", "kept_to"))  # at most two a line of the document
            mine = hits.groupBy(F.col("rid").alias(rid)).agg(each.alias(found))
            return written(rows.join(mine, rid, "left"), "attached", keep=True)

        joined = attached(hits)
        bodies = _texts_of(joined.where(F.col(found).isNotNull()).select(F.col(found), F.col(f"`{text}`").cast("string").alias("text")))
        # equal hashes with unequal bytes: such passages stay
        unequal = written(bodies.groupBy("h1", "h2", "body").count().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "unequal")
        if unequal.limit(1).count():
            joined = attached(hits.join(unequal, ["h1", "h2"], "left_anti"))
    return _cleaned(joined.drop(rid), docs, found, text)


def _cleaned(joined: DataFrame, docs: DataFrame, found: str, text: str) -> DataFrame:
    own = free_name(docs, "own_text")
    given = joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.col(found), F.col(f"`{text}`").cast("string").alias(own))
    span = T.ArrayType(T.StructType([T.StructField("first_line", T.IntegerType()), T.StructField("lines", T.IntegerType())]))
    tail = [(text, T.StringType()), ("n_lines", T.LongType()), ("lines_removed", T.LongType()), ("words_removed", T.LongType()), ("removed_spans", span)]
    schema = T.StructType([*given.schema.fields[:-2], *[T.StructField(n, t) for n, t in tail]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.list_(pa.struct([("first_line", pa.int32()), ("lines", pa.int32())]))
        for batch in batches:
            for texts, part in slices(batch):
                out: list[list] = [[] for _ in tail]
                there = part.column(part.num_columns - 1).is_valid().to_pylist()
                for t, ok, got in zip(texts, there, part.column(part.num_columns - 2).to_pylist()):
                    spans = _spans(got)
                    n, words = t.count("\n") + 1 if ok else 0, 0
                    if spans:
                        lines = t.split("\n")
                        for start, size in reversed(spans):
                            words += sum(len(x.encode("utf-8", "surrogatepass").split()) for x in lines[start : start + size])
                            del lines[start : start + size]
                        t = "\n".join(lines)
                    for col, v in zip(out, (t if ok else None, n, sum(s[1] for s in spans), words, [{"first_line": a, "lines": b} for a, b in spans])):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(out[0], pa.string()), *[pa.array(c, pa.int64()) for c in out[1:4]], pa.array(out[4], arrow)], schema.names)

    order = [*docs.columns, *[n for n, _ in tail[1:]]]
    return given.mapInArrow(lean(run), schema).select(*[F.col(f"`{c}`") for c in order])
