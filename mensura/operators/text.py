"""Retrieval, tokenising, knowledge graphs, notes, and biological sequences."""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.sources.tables import checkpointed

# ---- retrieval ---------------------------------------------------------------------------


def tokens(text: str) -> Column:
    """Array column of runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), 0)


def _occurrences(word: str) -> Column:
    return F.size(F.filter("_t", lambda x: x == word))


def rank_tfidf(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, score) of documents with score > 0: sum of tf ln(N / df) over the query's tokens, repeated ones too,
    by the root of the number of query tokens that occur.  Only counts of the query's tokens leave the scan."""
    wanted = Counter(re.findall("[a-z0-9]+", query.lower()))
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    words = sorted(wanted)
    # counted within each row: nothing is exploded
    each = docs.select(key, tokens(text).alias("_t")).select(key, *[_occurrences(w).alias(f"_f{i}") for i, w in enumerate(words)])
    stats = docs.select(tokens(text).alias("_t")).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.array_contains("_t", w)).alias(f"_d{i}") for i, w in enumerate(words)])
    joined = each.crossJoin(F.broadcast(stats))
    idf = [F.when(F.col(f"_d{i}") > 0, F.log(F.try_divide(F.col("_n"), F.col(f"_d{i}")))).otherwise(0.0) for i in range(len(words))]
    total = sum((F.col(f"_f{i}") * idf[i] * wanted[w] for i, w in enumerate(words)), F.lit(0.0))
    matched = sum((F.when(F.col(f"_f{i}") > 0, wanted[w]).otherwise(0) for i, w in enumerate(words)), F.lit(0))
    return joined.select(key, F.when(matched > 0, total / F.sqrt(F.greatest(matched, F.lit(1)))).otherwise(0.0).alias("score")).where("score > 0")


def token_counts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def search_fields(rows: DataFrame, key: str, title: str, body: str, query: str, tag: str | None = None, tags: str = "tags") -> DataFrame:
    """(key, score, matched_on): 1.0 for an equal title without regard to case, 0.5 where title or body has the query."""
    q = F.lit(query.lower())
    t, b = F.lower(F.col(title)), F.lower(F.coalesce(F.col(body), F.lit("")))
    on = F.when(t == q, "exact").when(F.contains(t, q), "title").when(F.contains(b, q), "body")
    found = rows if tag is None else rows.where(F.array_contains(tags, tag))
    return found.select(F.col(key), F.when(t == q, 1.0).otherwise(0.5).alias("score"), on.alias("matched_on")).where("matched_on is not null")


def search(concepts: DataFrame, notes: DataFrame, query: str, tag: str | None = None) -> DataFrame:
    """Hits of concepts (name, description, tags) and notes (id, title, body, tags), best first."""
    a = search_fields(concepts, "name", "name", "description", query, tag).withColumnRenamed("name", "id").withColumn("kind", F.lit("concept"))
    b = search_fields(notes, "id", "title", "body", query, tag).withColumn("kind", F.lit("note"))
    return a.unionByName(b).orderBy(F.desc("score"), "id")


# ---- trained byte pairs ------------------------------------------------------------------


#: A word, or a sign by itself.
WORD = r"\w+|[^\w\s]"


@dataclass
class PairTokenizer:
    """Merged character pairs; words end with a mark.  Encoding takes the longest vocabulary entry at each place."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]] = field(default_factory=list)
    end: str = "</w>"

    def encode(self, text: str, add_specials: bool = False) -> list[int]:
        out, longest = [], max(map(len, self.vocab))
        for word in re.findall(WORD, text):
            s, i = word + self.end, 0
            while i < len(s):
                step = next((n for n in range(min(longest, len(s) - i), 0, -1) if s[i : i + n] in self.vocab), 0)
                if not step:
                    step = len(self.end) if s[i:] == self.end else 1
                    out.append(self.vocab["<unk>"])
                else:
                    out.append(self.vocab[s[i : i + step]])
                i += step
        return [self.vocab["<bos>"], *out, self.vocab["<eos>"]] if add_specials else out

    def decode(self, ids: list[int], strip_eow: bool = True) -> str:
        back = {i: t for t, i in self.vocab.items()}
        s = "".join(back.get(i, "<unk>") for i in ids)
        return s.replace(self.end, " ").strip() if strip_eow else s

    def dumps(self) -> str:
        return json.dumps({"vocab": self.vocab, "merges": self.merges, "eow": self.end}, ensure_ascii=False)

    @classmethod
    def loads(cls, text: str) -> PairTokenizer:
        d = json.loads(text)
        return cls(d["vocab"], [tuple(m) for m in d["merges"]], d["eow"])


#: Entries that every trained vocabulary begins with.
SPECIALS = ["<unk>", "<pad>", "<bos>", "<eos>"]


def train_pairs(docs: DataFrame, text: str, vocab_size: int = 1000, min_frequency: int = 2) -> PairTokenizer:
    """Merges the most frequent adjacent pair until the vocabulary is full or pairs are rare.

    Words are counted over the whole table by Spark; each step counts pairs over distinct words in
    Spark and brings one pair to the driver.  Equal counts: the smaller pair.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?U)\w+|[^\w\s]"), 0)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    # parts stand between spaces, which no word holds: a step names the column once, so that plans grow evenly with steps
    parts = words.select(F.concat(F.lit(" "), F.array_join(F.split("w", ""), " "), F.lit(" </w> ")).alias("p"), "n").persist()
    try:
        letters = [r[0] for r in parts.select(F.explode(F.split(F.trim("p"), " ")).alias("c")).where("c <> '</w>'").distinct().orderBy("c").collect()]
        vocab = {t: i for i, t in enumerate([*SPECIALS, *letters])}
        merges: list[tuple[str, str]] = []
        now = parts
        while len(vocab) < vocab_size:
            each = F.split(F.trim("p"), " ")
            pairs = now.select("n", F.explode(F.arrays_zip(F.slice(each, 1, F.size(each) - 1).alias("a"), F.slice(each, 2, F.size(each) - 1).alias("b"))).alias("x"))
            best = pairs.groupBy("x.a", "x.b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").first()
            if best is None or best["n"] < min_frequency:
                break
            merges.append((best["a"], best["b"]))
            vocab.setdefault(best["a"] + best["b"], len(vocab))
            now = _merged(now, best["a"], best["b"])
            if len(merges) % 10 == 0:  # lineage ends here
                now = checkpointed(now)
        return PairTokenizer(vocab, merges)
    finally:
        parts.unpersist()


def _merged(words: DataFrame, a: str, b: str) -> DataFrame:
    """Every a that b follows, from the left, made one part with it."""
    whole = (a + b).replace("\\", "\\\\").replace("$", "\\$")
    return words.select(F.regexp_replace("p", rf"(?<= )\Q{a}\E \Q{b}\E(?= )", whole).alias("p"), "n")


#: Characters of text, and distinct words, that encode_pairs holds as token ids at once.
PIECE, WORDS = 1 << 20, 1 << 16


def encode_pairs(docs: DataFrame, text: str, tokenizer: PairTokenizer, out: str = "ids") -> DataFrame:
    """docs with token ids.  Documents of an Arrow batch are encoded and handed on a few at a time, as arrays of integers, so that memory follows the longest document and not the batch."""
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != out], T.StructField(out, T.ArrayType(T.IntegerType()))])
    columns = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, array] = {}

        def one(document: str) -> array:
            ids = array("i")
            for word in re.finditer(WORD, document):
                w = word[0]
                got = words.get(w)
                if got is None:
                    if len(words) >= WORDS:
                        words.clear()
                    got = words[w] = array("i", tokenizer.encode(w))
                ids.extend(got)
            return ids

        def handed(rows: pa.RecordBatch, lists: list[array | None]) -> pa.RecordBatch:
            ends = np.cumsum([0, *[0 if x is None else len(x) for x in lists]], dtype=np.int64)
            values = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(x, np.int32) for x in lists if x]])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=pa.array([x is None for x in lists]))
            return pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in columns], ids], [*columns, out])

        for batch in batches:
            texts, start, held, lists = batch.column(batch.schema.get_field_index(text)), 0, 0, []
            for i in range(len(batch)):
                document = texts[i].as_py()
                lists.append(None if document is None else one(document))
                held += len(document or "")
                if held >= PIECE:
                    yield handed(batch.slice(start, i + 1 - start), lists)
                    start, held, lists = i + 1, 0, []
            if lists:
                yield handed(batch.slice(start), lists)

    return docs.mapInArrow(run, schema)


#: Fixed value: the alphabet of character ids.
ALPHABET = "\n !'(),-.0123456789:;?ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def char_ids(docs: DataFrame, text: str, alphabet: str = ALPHABET, out: str = "ids") -> DataFrame:
    """docs with the place of each known character in the alphabet, in order; unknown ones are left out."""
    places = F.transform(F.split(F.col(text), ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return docs.withColumn(out, F.filter(places, lambda i: i >= 0))


# ---- knowledge graph ---------------------------------------------------------------------


@dataclass
class KnowledgeGraph:
    """Concepts (name, description, tags, metadata) and relations (seq, source, target, kind, weight) as DataFrames."""

    concepts: DataFrame
    relations: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> KnowledgeGraph:
        return cls(spark.createDataFrame([], "name string, description string, tags array<string>, metadata map<string,string>"), spark.createDataFrame([], "seq bigint, source string, target string, kind string, weight double"))

    def add_concepts(self, rows: list[dict]) -> KnowledgeGraph:
        new = self.concepts.sparkSession.createDataFrame([(r["name"], r.get("description"), r.get("tags", []), r.get("metadata", {})) for r in rows], self.concepts.schema)
        if new.join(self.concepts, "name", "left_semi").limit(1).count() or new.groupBy("name").count().where("count > 1").limit(1).count():
            raise ValueError("concept exists already")
        return KnowledgeGraph(self.concepts.union(new), self.relations)

    def add_relations(self, rows: list[tuple[str, str, str, float]], create: bool = False) -> KnowledgeGraph:
        """Relations (source, target, kind, weight); missing ends are an error unless they are to be created."""
        spark, start = self.concepts.sparkSession, self.relations.count()
        new = spark.createDataFrame([(start + i, *r) for i, r in enumerate(rows)], self.relations.schema)
        ends = new.select(F.col("source").alias("name")).union(new.select("target")).distinct().join(self.concepts, "name", "left_anti")
        graph = self
        if missing := [r[0] for r in ends.orderBy("name").collect()]:
            if not create:
                raise ValueError(f"unknown concepts: {missing}")
            graph = self.add_concepts([{"name": m} for m in missing])
        return KnowledgeGraph(graph.concepts, self.relations.union(new))

    def _sides(self, kind: str | None) -> DataFrame:
        return self.relations if kind is None else self.relations.where(F.col("kind") == kind)

    def neighbors_out(self, name: str, kind: str | None = None) -> DataFrame:
        return self._sides(kind).where(F.col("source") == name).select(F.col("target").alias("name"), "seq")

    def neighbors_in(self, name: str, kind: str | None = None) -> DataFrame:
        return self._sides(kind).where(F.col("target") == name).select(F.col("source").alias("name"), "seq")

    def neighbors(self, name: str, kind: str | None = None) -> DataFrame:
        both = self.neighbors_out(name, kind).union(self.neighbors_in(name, kind))
        return both.groupBy("name").agg(F.min("seq").alias("seq")).orderBy("seq")

    def edges(self) -> DataFrame:
        return self.relations.select("seq", F.col("source").alias("src"), F.col("target").alias("dst"), "weight")

    def save(self, path: str) -> None:
        self.concepts.write.mode("overwrite").json(f"{path}/concepts")
        self.relations.write.mode("overwrite").json(f"{path}/relations")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KnowledgeGraph:
        blank = cls.empty(spark)
        return cls(spark.read.schema(blank.concepts.schema).json(f"{path}/concepts"), spark.read.schema(blank.relations.schema).json(f"{path}/relations"))

    def to_markdown(self) -> DataFrame:
        """One line a row, concepts first."""
        c = self.concepts.select(F.lit(0).alias("part"), F.col("name").alias("at"), F.concat(F.lit("- **"), F.col("name"), F.lit("**"), F.coalesce(F.concat(F.lit(": "), "description"), F.lit(""))).alias("line"))
        r = self.relations.select(F.lit(1).alias("part"), F.format_string("%012d", "seq").alias("at"), F.concat_ws(" ", F.lit("-"), "source", F.concat(F.lit("--"), "kind", F.lit("-->")), "target").alias("line"))
        return c.union(r).orderBy("part", "at").select("line")


def notes_for_concept(notes: DataFrame, concept: str) -> DataFrame:
    return notes.where(F.array_contains("linked_concepts", concept))


def notes_by_tag(notes: DataFrame, tag: str) -> DataFrame:
    return notes.where(F.array_contains("tags", tag))


def get_note(notes: DataFrame, note_id: str) -> DataFrame:
    return notes.where(F.col("id") == note_id)


# ---- sequences ---------------------------------------------------------------------------


def _bases(seq: str):
    up = F.upper(F.col(seq))
    return F.when(up.rlike("^[ACGTN]*$"), up).otherwise(F.raise_error(F.lit("a sequence has letters other than ACGTN")))


def gc_content(df: DataFrame, seq: str, out: str = "gc") -> DataFrame:
    """Share of G and C among letters that aren't N; 0.0 without any."""
    s = _bases(seq)
    known = F.length(F.translate(s, "N", ""))
    return df.withColumn(out, F.when(known > 0, F.try_divide(F.length(F.translate(s, "ATN", "")), known)).otherwise(0.0))


def reverse_complement(df: DataFrame, seq: str, out: str = "reverse_complement") -> DataFrame:
    return df.withColumn(out, F.reverse(F.translate(_bases(seq), "ACGT", "TGCA")))


def k_mers(df: DataFrame, seq: str, k: int) -> DataFrame:
    """df's other columns with place and k_mer, for all overlapping substrings."""
    n = F.length(seq) - k + 1
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("place", F.explode(places)).withColumn("k_mer", F.upper(F.substring(F.col(seq), F.col("place"), F.lit(k)))).drop(seq)


def align(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1) -> tuple[int, str, str]:
    """Global alignment; of equal ways the diagonal, then a gap in b."""
    rows = [[j * gap for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [i * gap]
        for j, y in enumerate(b, 1):
            row.append(max(rows[-1][j - 1] + (match if x == y else mismatch), rows[-1][j] + gap, row[-1] + gap))
        rows.append(row)
    i, j, p, q = len(a), len(b), [], []
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            p.append(a[i])
            q.append(b[j])
        elif i and rows[i][j] == rows[i - 1][j] + gap:
            i -= 1
            p.append(a[i])
            q.append("-")
        else:
            j -= 1
            p.append("-")
            q.append(b[j])
    return rows[-1][-1], "".join(reversed(p)), "".join(reversed(q))


def needleman_wunsch(df: DataFrame, a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1) -> DataFrame:
    """df with alignment (score, a, b) of two sequence columns."""
    f: Callable = F.udf(lambda x, y: align(x, y, match, mismatch, gap), "score int, a string, b string")
    return df.withColumn("alignment", f(a, b))
