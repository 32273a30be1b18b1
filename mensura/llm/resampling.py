"""Importance resampling towards a target distribution, by external sort-count.

Every text becomes a packed stream of uint16 feature buckets, which is written once; the offsets of
the binary column say where a document's stream starts.  Streams are sorted in runs of bounded size
and run-length encoded into counts, corpus and target are compared bucket by bucket, and a second scan of the
streams gathers each document's gains and adds them up between its offsets.

A feature is a run of words, its bucket the crc32 of its bytes.  The crc32 of a run follows from those
of its words: crc(a + b) is crc(a) moved over len(b) zero bytes, xor crc(b).  Each distinct word is
hashed once, and runs are hashed as arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import free_name, held, lean, ranked, slices, with_row_ids, written
from mensura.llm.decontaminate import as_words

#: Words (and their bytes) that a worker remembers at most; words of a text hashed at once; buckets sorted at once.
CACHE_WORDS, CACHE_BYTES, BLOCK, RUN = 1_000_000, 64_000_000, 1 << 19, 1 << 23

#: Fixed value: the polynomial of crc32, its lowest power first.
_POLYNOMIAL = 0xEDB88320


def _move(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """crc32 registers after the zero bytes that tables[byte of register, its value] stand for."""
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


@cache
def _zeros() -> np.ndarray:
    """Tables over the bytes of a register for 0 to 255 zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(_POLYNOMIAL), step >> 1)
    out = np.empty((256, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(255):
        out[n + 1] = step[out[n] & 255] ^ out[n] >> 8
    return out


@cache
def _many_zeros(k: int) -> np.ndarray:
    """The tables for 256 * 2**k zero bytes."""
    half = _zeros()[128] if k == 0 else _many_zeros(k - 1)
    return _move(half, half)


def moved(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each crc32 register after so many zero bytes."""
    low, tables = sizes & 255, _zeros()
    out = tables[low, 0, crc & 255] ^ tables[low, 1, crc >> 8 & 255] ^ tables[low, 2, crc >> 16 & 255] ^ tables[low, 3, crc >> 24]
    rest, k = sizes >> 8, 0
    while rest.any():
        odd = (rest & 1).astype(bool)
        out[odd] = _move(_many_zeros(k), out[odd])
        rest, k = rest >> 1, k + 1
    return out


class Hashes:
    """The crc32 of distinct words, alone and after a space, and their sizes with that space."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.bytes = 0
        self.table = np.empty((3, 0), np.int64)

    def of(self, words: list[bytes]) -> np.ndarray:
        """Three rows for each word: crc32, crc32 after a space, size with the space."""
        if len(self.at) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.clear()
        new = list(set(words).difference(self.at))
        if new:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            more = np.array([[zlib.crc32(w) for w in new], [zlib.crc32(b" " + w) for w in new], [len(w) + 1 for w in new]], np.int64)
            self.bytes += int(more[2].sum())
            self.table = np.concatenate([self.table, more], axis=1)
        return self.table[:, np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def bucket_stream(hashes: Hashes, texts: list[str], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the buckets of all features, text after text.  A feature is a run of up to `longest` words."""
    counts, parts, words = [], [], []
    for text in texts:
        n = 0
        for piece in as_words(text):
            got = piece.split()
            n += len(got)
            words += got
            if len(words) >= BLOCK:
                parts.append(hashes.of(words))
                words = []
        counts.append(n)
    parts.append(hashes.of(words))
    own, after, size = parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)
    own, after = own.astype(np.uint32), after.astype(np.uint32)
    n_words = np.array(counts, np.int64)
    left = np.repeat(np.cumsum(n_words), n_words) - np.arange(len(own))  # words of the text from each one on
    out = []
    for a in range(0, len(own), BLOCK):
        b = min(a + BLOCK, len(own))
        crc, grown = own[a:b], np.zeros((b - a, longest), np.uint16)
        grown[:, 0] = crc % buckets
        for k in range(1, longest):
            crc = crc[: len(own) - k - a]
            crc = moved(crc, size[a + k : a + k + len(crc)]) ^ after[a + k : a + k + len(crc)]
            grown[: len(crc), k] = crc % buckets
        out.append(grown[np.arange(longest) < left[a:b, None]])
    return n_words, np.concatenate(out) if out else np.empty(0, np.uint16)


def feature_streams(docs: DataFrame, text: str, longest: int, buckets: int, names: tuple[str, str, str]) -> DataFrame:
    """docs without the text, with three columns: words, features, and the buckets of features as packed uint16 (low byte first)."""
    given = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.col(f"`{text}`").cast("string").alias(free_name(docs, "own_text")))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("feature hashes", Hashes)
        for batch in batches:
            for texts, part in slices(batch):
                n_words, stream = bucket_stream(hashes, texts, longest, buckets)
                n = sum(np.maximum(n_words - k, 0) for k in range(longest))
                ends = np.concatenate([[0], np.cumsum(n)]) * 2
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(stream.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n_words), pa.array(n), packed], schema.names)

    return given.mapInArrow(lean(run), schema)


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The stream of a batch, and its offsets by row, with the end."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    stream = np.frombuffer(data, "<u2") if data else np.empty(0, "<u2")
    return stream[ends[0] // 2 : ends[-1] // 2], (ends - ends[0]) // 2


def bucket_counts(streams: DataFrame, stream: str, buckets: int) -> np.ndarray:
    """Occurrences of each bucket.  A task sorts runs of bounded size and sends one count a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)

        def count(waiting: list[np.ndarray]) -> None:
            run = np.sort(np.concatenate(waiting), kind="stable")  # by radix
            starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            total[run[starts]] += np.diff(starts, append=len(run))

        waiting: list[np.ndarray] = []
        for batch in batches:
            some = _unpacked(batch.column(0))[0]
            for a in range(0, len(some), RUN):
                waiting.append(some[a : a + RUN])
                if sum(map(len, waiting)) >= RUN:
                    count(waiting)
                    waiting = []
            waiting = [w.copy() for w in waiting]  # batches aren't kept
        if waiting:
            count(waiting)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = streams.select(F.col(f"`{stream}`")).mapInArrow(lean(run), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # one row a bucket at most
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in the corpus, rounded down."""
    n = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weighed(streams: DataFrame, stream: str, gain: np.ndarray, name: str) -> DataFrame:
    given = streams.select(*[F.col(f"`{c}`") for c in streams.columns if c != stream], F.col(f"`{stream}`"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, ends = _unpacked(batch.column(batch.num_columns - 1))
            sums, some = np.zeros(batch.num_rows, np.int64), np.flatnonzero(np.diff(ends))  # reduceat adds nothing for no features
            if len(some):
                sums[some] = np.add.reduceat(gain[packed], ends[some])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums)], schema.names)

    return given.mapInArrow(lean(run), schema)


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", key: str = "doc_id", per_cent: int = 5, min_words: int = 20, seed: int = 42, longest: int = 3, buckets: int = 10_000) -> DataFrame:
    """docs, without the text, with n_words, n_features, weight, score and rank.

    Words are runs of digits, letters (A-Z lower-cased) and all that is not ASCII; features are the runs of
    1 to `longest` words, repeats counted; a feature's bucket is its crc32 modulo `buckets` (65,536 at most).
    weight adds up the gains of a document's features, score adds a Gumbel draw from seed and key, so the
    highest scores are a weighted draw without replacement.  per_cent of the documents with min_words words or more are
    drawn; rank counts them from 1 by falling score, then by key (null last), then by place in the table.

    A null or wordless text has no features and weight 0; a null key draws as an empty one.  Rows are weighed one by
    one, repeated ones too, and all of them count in the corpus.  An empty target gives gains of an empty sample, an
    empty table no rows.  Result columns replace columns of the same names.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    new = ["n_words", "n_features", "weight", "score", "rank"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() not in new])
    stream, rid = free_name(docs, "stream"), free_name(docs, "rid")
    streams = written(feature_streams(docs, text, longest, buckets, ("n_words", "n_features", stream)), "streams", keep=True)
    aims = feature_streams(target.select(F.col(f"`{target_text}`").alias("text")), "text", longest, buckets, ("n_words", "n_features", "stream"))
    gain = gains(bucket_counts(streams, stream, buckets), bucket_counts(aims, "stream", buckets))
    weighed = _weighed(with_row_ids(streams, rid), stream, gain, "weight")
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296)))
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel), "scored", keep=True)
    fit = F.col("n_words") >= min_words
    n = scored.where(fit).count() * per_cent // 100
    place = ranked(scored.where(fit), [F.col("score").desc(), F.col(f"`{key}`").asc_nulls_last(), F.col(rid).asc()], "rank", keep=True)
    place = place.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return place.unionByName(rest).drop(rid)
