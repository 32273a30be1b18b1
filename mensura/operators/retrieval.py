"""A stored inverted index: postings by term, kept as tables that grow by deltas.

The folder has postings (term, n, keys, tfs) and documents (key, length), partitioned by the batch that brought them, and
postings besides by a bucket of the term.  A row of postings is a block: n documents of one piece of the table that have the term, and
how often.  A query reads the buckets of its terms with the terms pushed down, counts how many documents have each, and
scores.  Adding documents writes a new batch and reads none of the old ones.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of a piece, and documents of a batch that share the files of a bucket.
PIECE, PART = 1 << 21, 50_000

_TERM = re.compile("[a-z0-9]+")


def _block_schema(key: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(key)), T.StructField("tfs", T.ArrayType(T.IntegerType()))])


def _inverted(keys: pa.Array, lengths: list[int], ids: array, terms: list[str]) -> pa.RecordBatch:
    """A block for each term of a piece; before them, without a term, all documents with their lengths."""
    docs = len(lengths)
    found, tfs = np.unique(np.asarray(ids, np.int64) * docs + np.repeat(np.arange(docs), lengths), return_counts=True)
    term, doc = np.divmod(found, docs)
    ends = np.concatenate([[0], docs + np.searchsorted(term, np.arange(len(terms) + 1))])
    lists = lambda v: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v)
    at, times = np.concatenate([np.arange(docs), doc]), np.concatenate([lengths, tfs])
    columns = [pa.array([None, *terms], pa.string()), pa.array(np.diff(ends), pa.int64()), lists(keys.take(pa.array(at))), lists(pa.array(times, pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, ["term", "n", "keys", "tfs"])


def blocks(docs: DataFrame, key: str, text: str, piece: int = PIECE) -> DataFrame:
    """(term, n, keys, tfs) of documents a piece at a time.  Texts are cut once, where they are, and what is dealt out later has a row a block, not a word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.columns
            first, lengths, ids, number = 0, [], array("i"), defaultdict(count().__next__)
            for i, t in enumerate(texts, 1):
                words = _TERM.findall(t.as_py() or "")
                lengths.append(len(words))
                ids.extend(map(number.__getitem__, words))
                if len(ids) >= piece or i == len(texts):
                    yield _inverted(keys.slice(first, i - first), lengths, ids, list(number))
                    first, lengths, ids, number = i, [], array("i"), defaultdict(count().__next__)

    return docs.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).mapInArrow(cut, _block_schema(docs.schema[key].dataType))


class InvertedIndex:
    """Postings in a folder.  buckets: into how many folders the terms of a batch are dealt."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, term):
        return F.pmod(F.crc32(F.encode(term, "utf-8")), F.lit(self.buckets)).cast("int")

    def append(self, docs: DataFrame, key: str, text: str) -> str:
        """Adds documents, whose keys must be new, and names their batch.  A batch counts once its documents are written, which is last; an append that failed is not seen."""
        batch = uuid.uuid4().hex
        cut, staged = blocks(docs, key, text).withColumn("whole", F.col("term").isNull()), f"{self.path}/staged/batch={batch}"
        cut.write.partitionBy("whole").parquet(staged)
        found = self.spark.read.schema(cut.schema).parquet(staged)
        each = found.where("whole").select(F.explode(F.arrays_zip("keys", "tfs")).alias("d")).select(F.col("d.keys").alias("key"), F.col("d.tfs").cast("long").alias("length"))
        parts = max(8, -(-each.count() // PART))
        # terms are sorted within their files, so that row groups can be skipped
        postings = found.where("not whole").drop("whole").withColumn("bucket", self._bucket(F.col("term")))
        bucketed = postings.repartition("bucket", F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(parts))).sortWithinPartitions("bucket", "term")
        bucketed.write.partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        each.write.parquet(f"{self.path}/documents/batch={batch}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return batch

    def batches(self) -> list[str]:
        """Whole batches."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/documents")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        done = [s.getPath() for s in fs.listStatus(at)]
        return sorted(p.getName()[6:] for p in done if p.getName().startswith("batch=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/documents/batch={b}" for b in self.batches()])

    def _blocks(self, terms: list[str] | None = None) -> DataFrame:
        """(term, n, keys, tfs), of some terms or all.  Terms choose folders first, then row groups within their files."""
        schema = _block_schema(self.documents().schema["key"].dataType).add("bucket", T.IntegerType())
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/postings").parquet(*[f"{self.path}/postings/batch={b}" for b in self.batches()])
        if terms is not None:
            import zlib

            found = found.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})) & F.col("term").isin(terms))
        return found.select("term", "n", "keys", "tfs")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, key, tf), of some terms or all."""
        each = self._blocks(terms).select("term", F.explode(F.arrays_zip("keys", "tfs")).alias("p"))
        return each.select("term", F.col("p.keys").alias("key"), F.col("p.tfs").cast("long").alias("tf"))

    def vocabulary(self, terms: list[str] | None = None) -> DataFrame:
        """(term, documents, idf) with idf = ln(N / documents), of some terms or all."""
        n = self.documents().count()
        return self._blocks(terms).groupBy("term").agg(F.sum("n").alias("documents")).withColumn("idf", F.log(F.lit(float(n)) / F.col("documents")))

    def norms(self) -> DataFrame:
        """(key, norm): the root of the sum of a document's squared weights tf idf; documents without words have 0."""
        each = self._blocks().drop("n").join(self.vocabulary(), "term").select("idf", F.explode(F.arrays_zip("keys", "tfs")).alias("p"))
        weighed = each.select(F.col("p.keys").alias("key"), (F.col("p.tfs") * F.col("idf")).alias("w"))
        return self.documents().join(weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "key", "left").select("key", F.coalesce("norm", F.lit(0.0)).alias("norm"))

    def _wanted(self, query: str) -> tuple[Counter, DataFrame]:
        wanted = Counter(re.findall("[a-z0-9]+", query.lower()))
        return wanted, self.spark.createDataFrame(sorted(wanted.items()), T.StructType([T.StructField("term", T.StringType()), T.StructField("times", T.LongType())]))

    def search(self, query: str) -> DataFrame:
        """(key, score) with score > 0: sum of tf idf over the query's tokens, repeated ones too, by the root of how many of them occur."""
        wanted, terms = self._wanted(query)
        n = self.documents().count() if self.batches() else 0
        if not wanted or not n:
            return self.spark.createDataFrame([], "key string, score double")
        hits = self.postings(list(wanted)).join(F.broadcast(terms), "term")  # the query's terms
        counts = self._blocks(list(wanted)).groupBy("term").agg(F.sum("n").alias("documents"))
        scored = hits.join(F.broadcast(counts), "term").withColumn("w", F.col("tf") * F.col("times") * F.log(F.lit(float(n)) / F.col("documents")))
        return scored.groupBy("key").agg((F.sum("w") / F.sqrt(F.sum("times"))).alias("score")).where("score > 0")

    def cosine(self, query: str) -> DataFrame:
        """(key, cosine) of documents that share a weighty term with the query."""
        wanted, terms = self._wanted(query)
        if not wanted or not self.batches():
            return self.spark.createDataFrame([], "key string, cosine double")
        idf = self.vocabulary(list(wanted)).join(F.broadcast(terms), "term").select("term", "idf", (F.col("times") * F.col("idf")).alias("q"))
        length = idf.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))
        dot = self.postings(list(wanted)).join(F.broadcast(idf), "term").groupBy("key").agg(F.sum(F.col("tf") * F.col("idf") * F.col("q")).alias("dot"))
        return dot.join(self.norms(), "key").crossJoin(F.broadcast(length)).where("dot > 0 and norm > 0 and length > 0").select("key", (F.col("dot") / F.col("norm") / F.col("length")).alias("cosine"))
