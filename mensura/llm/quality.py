"""Quality and toxicity by hierarchical empirical Bayes.

A document's own evidence is a log likelihood ratio from a small logistic model over telling words
and the text's shape.  Its site's evidence is a posterior rate: labelled rates of hosts shrink
toward the global rate and rates of paths toward their host's, each by a strength that the spread
of the rates themselves gives.  Both are combined by Bayes' rule, for each of two faults: toxic
text and low quality.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import column_or_null, lean, slices, written
from mensura.llm.decontaminate import words_of
from mensura.llm.url_filters import split_url

FAULTS = ("toxic", "low")

_DIGITS = b"0123456789"
_PLAIN = bytes([*range(33), *range(65, 91), *range(97, 123), *range(128, 256)]) + b".,;:!?'\"-()" + _DIGITS


def shape(text: str, words: list[bytes]) -> list[str]:
    """The form of a text as a few words of its own."""
    raw = text.encode("utf-8", "surrogatepass")
    n, tokens, lines = max(1, len(raw)), raw.split(), raw.split(b"\n")
    odd = len(raw.translate(None, _PLAIN))
    digits = n - len(raw.translate(None, _DIGITS))
    return [
        f"#odd{min(20, int(100 * odd / n))}",
        f"#bars{min(9, int(10 * raw.count(b'|') / max(1, len(tokens))))}",
        f"#digits{min(9, int(50 * digits / n))}",
        f"#words{len(words).bit_length()}",
        f"#fresh{int(10 * len(set(tokens)) / max(1, len(tokens)))}",
        f"#lines{int(10 * (1 - len(set(lines)) / len(lines)))}",
    ]


def features(text: str) -> set[str]:
    words = words_of(text)
    return {w.decode("utf-8", "replace") for w in set(words)}.union(shape(text, words))


@dataclass
class Evidence:
    """Logistic weights of features for each fault, and the logit of its rate among the rows it was fitted on."""

    number: dict[str, int]
    weights: np.ndarray  # features x faults
    bias: np.ndarray

    def ratios(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(FAULTS)))
        for i, t in enumerate(texts):
            own = [self.number[f] for f in features(t) if f in self.number]
            out[i] = self.weights[own].sum(axis=0) + self.bias
        return out


def _logistic(rows: list[list[int]], y: np.ndarray, size: int, penalty: float = 0.5, steps: int = 12) -> tuple[np.ndarray, float]:
    """Penalised logistic regression over sets of features, by Newton's method; the result is relative to the base rate."""
    x = np.zeros((len(rows), size + 1))
    x[:, size] = 1
    for i, r in enumerate(rows):
        x[i, r] = 1
    w = np.zeros(size + 1)
    ridge = np.full(size + 1, penalty)
    ridge[size] = 1e-6
    rate = (y.sum() + 1) / (len(y) + 2)
    w[size] = base = math.log(rate / (1 - rate))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * (w - base * (ridge < 1e-3)))
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w[:size], w[size] - base


def fit_evidence(labelled: DataFrame, sample_rows: int = 12_000, size: int = 400, least: int = 5, z: float = 6.0) -> Evidence:
    """Evidence from rows (text, toxic, low: 0 or 1), of which about sample_rows are drawn by a hash of the text.

    Equal texts count once.  Features: the `size` of either fault with the largest |z| that occur in
    `least` drawn texts or more.
    """
    hashed = labelled.withColumn("draw", F.shiftrightunsigned(F.xxhash64("text", F.lit(7)), 11) / float(1 << 53))
    n = labelled.count()
    drawn = hashed.where(F.col("draw") < min(1.0, sample_rows / max(1, n))).groupBy("text").agg(F.max("toxic").alias("toxic"), F.max("low").alias("low")).limit(2 * sample_rows)
    drawn = written(drawn.select("toxic", "low", "text"), "drawn")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, part in slices(batch):
                each, marked = Counter(), (Counter(), Counter())
                for t, *marks in zip(texts, part.column(0).to_pylist(), part.column(1).to_pylist()):
                    f = features(t)
                    each.update(f)
                    for c, m in zip(marked, marks):
                        if m:
                            c.update(f)
                names = list(each)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[x] for x in names], pa.int64()) for c in (each, *marked)]], ["feature", "n", *FAULTS])

    counts = drawn.mapInArrow(lean(count), "feature string, n bigint, toxic bigint, low bigint").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *FAULTS)]).where(F.col("n") >= least)
    counts = written(counts, "features")
    total = drawn.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FAULTS]).first()
    number: dict[str, int] = {}
    for c in FAULTS:
        p = (total[c] + 1) / (total["n"] + 2)
        score = F.abs(F.col(c) - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
        for r in counts.where(score > z).orderBy(F.desc(score), "feature").limit(size).collect():
            number.setdefault(r["feature"], len(number))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, part in slices(batch):
                own = [sorted(number[f] for f in features(t) if f in number) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(own, pa.list_(pa.int32()))], [*FAULTS, "own"])

    got = drawn.mapInArrow(lean(rows), "toxic int, low int, own array<int>").collect()
    got.sort(key=lambda r: (r["own"], r["toxic"], r["low"]))
    weights, bias = np.zeros((len(number), len(FAULTS))), np.zeros(len(FAULTS))
    for k, c in enumerate(FAULTS):
        if got:
            weights[:, k], bias[k] = _logistic([r["own"] for r in got], np.array([float(r[c]) for r in got]), len(number))
    return Evidence(number, weights, bias)


def _strength(groups: DataFrame, n: str, bad: str, mean: Column) -> float:
    """How many labelled rows a prior counts for, from the spread of groups' rates around `mean` beyond chance."""
    rate = F.col(bad) / F.col(n)
    r = groups.where(F.col(n) > 0).agg(
        F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.count(F.lit(1)).alias("k"), F.sum(F.col(n) * (rate - mean) * (rate - mean)).alias("s"), F.sum(F.col(n) * mean * (1 - mean)).alias("v")
    ).first()
    if not r["n"] or r["k"] < 2 or r["n"] ** 2 <= r["nn"]:
        return 20.0
    chance = r["v"] / r["n"]
    between = (r["s"] - (r["k"] - 1) * chance) / (r["n"] - r["nn"] / r["n"])
    return float(min(1000.0, max(2.0, chance / between - 1))) if between > 0 else 1000.0


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def judge(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, text: str = "text", key: str = "doc_id", page_key: str = "page_id", site: str = "source", evidence: Evidence | None = None) -> DataFrame:
    """One row per row of docs: key, host, path, p_toxic, p_low, toxic, low, kept.

    labels: rows (key, quality, toxic); several rows of a key count as one, with any fault of theirs.
    A document's site is its page's host and first path segment, where pages has its key, else its
    `site` column and an empty path.  A row's own label is left out of its site's rates.  Faults are
    those of probability 0.5 or more; a document without faults is kept.  Null texts count as empty,
    null keys have neither label nor page, and without labels all rates are one half.
    """
    low = F.when(F.col("quality") == 0, 1).otherwise(0)
    marks = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"), F.max(low).alias("low"))
    marks = written(marks, "marks")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{key}`").alias("key"), column_or_null(docs, site, "string").alias("site"), body.alias("text"))
    if evidence is None:
        n, m = marks.count(), 12_000
        # keys are drawn before the texts are fetched, so that the join brings a bounded sample of texts
        some = written(marks.where(F.shiftrightunsigned(F.xxhash64("key", F.lit(5)), 11) / float(1 << 53) < min(1.0, m / max(1, n))).limit(2 * m), "some")
        evidence = fit_evidence(base.join(F.broadcast(some), "key").select("toxic", "low", "text"), m)
    shared = docs.sparkSession.sparkContext.broadcast(evidence)  # features are bounded by fit_evidence's size
    kind = base.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, part in slices(batch):
                r = shared.value.ratios(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(r[:, 0]), pa.array(r[:, 1])], ["key", "site", "r_toxic", "r_low"])

    rows = written(base.mapInArrow(lean(run), f"key {kind}, site string, r_toxic double, r_low double"), "ratios")
    if pages is not None:
        host, path = split_url(F.col("url"))
        of = pages.where(F.col(f"`{page_key}`").isNotNull()).groupBy(F.col(f"`{page_key}`").alias("key")).agg(F.min("url").alias("url"))
        of = written(of.select("key", host.alias("host"), F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(2)), F.lit("")).alias("path")), "sites")
        rows = rows.join(of, "key", "left")
    else:
        rows = rows.withColumn("host", F.lit(None).cast("string")).withColumn("path", F.lit(None).cast("string"))
    rows = rows.join(marks, "key", "left").withColumn("labelled", F.col("toxic").isNotNull().cast("int"))
    rows = written(rows.select("key", F.coalesce("host", "site", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "r_toxic", "r_low", "labelled", *[F.coalesce(c, F.lit(0)).alias(c) for c in FAULTS]), "sited")
    sums = [F.sum("labelled").alias("n"), *[F.sum(c).alias(c) for c in FAULTS]]
    paths = written(rows.groupBy("host", "path").agg(*sums), "paths")
    hosts = written(paths.groupBy("host").agg(*[F.sum(c).alias(f"h_{c}") for c in ("n", *FAULTS)]), "hosts")
    whole = hosts.agg(*[F.coalesce(F.sum(f"h_{c}"), F.lit(0)).alias(c) for c in ("n", *FAULTS)]).first()
    both = written(paths.join(hosts, "host"), "totals")
    out = rows.join(both.select("host", "path", "n", "h_n", *[F.col(c).alias(f"s_{c}") for c in FAULTS], *[f"h_{c}" for c in FAULTS]), ["host", "path"])
    for c in FAULTS:
        mean = (whole[c] + 1) / (whole["n"] + 2)
        of_host = _strength(hosts, "h_n", f"h_{c}", F.lit(mean))
        of_path = _strength(both, "n", c, (F.col(f"h_{c}") + of_host * mean) / (F.col("h_n") + of_host))
        host_rate = (F.col(f"h_{c}") - F.col(c) + of_host * mean) / (F.col("h_n") - F.col("labelled") + of_host)
        path_rate = (F.col(f"s_{c}") - F.col(c) + of_path * host_rate) / (F.col("n") - F.col("labelled") + of_path)
        out = out.withColumn(f"p_{c}", 1 / (1 + F.exp(-(F.col(f"r_{c}") + _logit(path_rate)))))
    return out.select(F.col("key").alias(key), "host", "path", "p_toxic", "p_low", (F.col("p_toxic") >= 0.5).alias("toxic"), (F.col("p_low") >= 0.5).alias("low"), ((F.col("p_toxic") < 0.5) & (F.col("p_low") < 0.5)).alias("kept"))
