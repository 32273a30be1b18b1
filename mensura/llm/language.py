"""Language identification by hierarchical discrimination.

A linear support vector machine per family (one against the rest) chooses the family; within it
one-versus-one linear support vector machines vote between its languages.  Features are hashed
byte trigrams, bigrams and the first three bytes of words, over the whole lower-cased text, as
shares of their number.  Training reads a bounded sample of labelled rows whose features are
computed where the rows are; prediction is one table look-up for each feature, without a shuffle.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import free_name, lean, slices

#: Families of languages by ISO 639-1 code.  A language that is not here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["ar", "he", "mt"],
}

UNDETERMINED = "und"
BITS = 16
SIZE = 1 << BITS
_LETTER = re.compile(r"[^\W\d_]").search

#: Bytes of text whose features are held at once.
PIECE = 1 << 16


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower() in langs), lang)


def features(raw: np.ndarray) -> np.ndarray:
    """Feature numbers of the trigrams and bigrams that start with each byte but the last two."""
    a, b, c = (raw[i : len(raw) - 2 + i].astype(np.uint32) for i in range(3))
    three = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
    two = (a * np.uint32(0x27D4EB2F) + b * np.uint32(0x165667B1) + np.uint32(77)) >> np.uint32(32 - BITS)
    return np.column_stack((three, two)).ravel().astype(np.int32)


def pieces(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(texts, their features in a row, where each one's begin), PIECE bytes or so at a time; a longer text comes in several."""
    some: list[tuple[int, bytes]] = []
    size = 0

    def joined() -> tuple[list[int], np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *(len(p) for _, p in some[:-1])]) * 2
        return [i for i, _ in some], features(np.frombuffer(b"".join(p for _, p in some) + b"  ", np.uint8)), starts

    for i, t in enumerate(texts):
        raw = b" %b " % t.lower().encode("utf-8", "replace")
        if some and size + len(raw) > PIECE:
            yield joined()
            some, size = [], 0
        if len(raw) > PIECE:
            padded = np.frombuffer(raw + b"  ", np.uint8)
            for at in range(0, len(raw), PIECE):
                yield [i], features(padded[at : at + PIECE + 2]), np.zeros(1, int)
        else:
            some.append((i, raw))
            size += len(raw)
    if some:
        yield joined()


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and their shares of all its features."""
    counts = np.zeros(SIZE, np.int64)
    for _, at, _ in pieces([text]):
        counts += np.bincount(at, minlength=SIZE)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / counts.sum()).astype(np.float32)


@dataclass
class Model:
    """Weights of every machine, one column each, and what the columns mean."""

    families: list[str]
    langs: dict[str, list[str]]  # of each family
    pairs: list[tuple[str, str]]  # one machine each, after the families' machines
    weights: np.ndarray  # SIZE x machines
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.families or not texts:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        margins, n = np.zeros((len(texts), len(self.bias))), np.zeros(len(texts), int)
        for which, at, starts in pieces([t or "" for t in texts]):
            margins[which] += np.add.reduceat(self.weights[at], starts, axis=0, dtype=np.float64)
            n[which] += np.diff(np.append(starts, len(at)))
        margins = margins / n[:, None] + self.bias
        column = {p: len(self.families) + i for i, p in enumerate(self.pairs)}
        langs, scores = [], []
        for t, m in zip(texts, margins):
            if not t or not _LETTER(t):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            f = int(np.argmax(m[: len(self.families)]))
            sure = _logistic(m[f]) if len(self.families) > 1 else 1.0
            votes: dict[str, list[float]] = {x: [0, 0.0] for x in self.langs[self.families[f]]}
            for x, y in itertools.combinations(self.langs[self.families[f]], 2):
                v = m[column[x, y]]
                won = x if v > 0 else y
                votes[won][0] += 1
                votes[won][1] += abs(v)
            best = max(votes, key=lambda x: (votes[x], x))
            if len(votes) > 1:
                sure *= _logistic(votes[best][1] / max(1, votes[best][0]))
            langs.append(best)
            scores.append(float(sure))
        return langs, scores


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(x, -30, 30))))


def _machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, scale: float, rounds: int, cost: float) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss) by dual coordinate descent over sparse rows."""
    rng = np.random.default_rng(7)
    w, bias = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) * scale * scale + 1 for _, v in rows]) + 0.5 / cost
    share = np.where(y > 0, 0.5 * len(y) / max(1, (y > 0).sum()), 0.5 * len(y) / max(1, (y < 0).sum()))
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            slack = 0.5 / (cost * share[i])
            g = y[i] * (scale * float(w[at] @ v) + bias) - 1 + alpha[i] * slack
            new = max(0.0, alpha[i] - g / (square[i] + slack))
            if step := (new - alpha[i]) * y[i]:
                w[at] += step * scale * v
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w * scale, bias


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400, cost: float = 10.0) -> Model:
    """A model from rows with a text that has letters and a language.

    At most about per_language rows of each language are drawn, by hashes of key and text, and at most
    2 x per_language for each language are ever held; rows of one key and text are drawn together.
    Every language is learned; the driver holds one row of weights for each family and each pair
    of a family's languages.  Without rows the model knows no language.
    """
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit(9)).alias("draw")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().orderBy("lang").collect()  # as many as there are languages
    if not counts:
        return Model([], {}, [], np.zeros((SIZE, 0), np.float32), np.zeros(0))
    chance = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], float(min(1.0, per_language / r["count"])))])
    place = (F.shiftrightunsigned("draw", 11) / float(1 << 53)).cast("double")
    drawn = rows.where(place < chance[F.col("lang")])
    schema = "lang string, draw bigint, at array<int>, share array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, part in slices(batch):
                got = [shares(t) if _LETTER(t) else None for t in texts]
                have = pa.array([g is not None for g in got])
                some = [g for g in got if g is not None]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).filter(have) for c in ("lang", "draw")], pa.array([g[0] for g in some], pa.list_(pa.int32())), pa.array([g[1] for g in some], pa.list_(pa.float32()))],
                    ["lang", "draw", "at", "share"],
                )

    most = 2 * per_language * len(counts)
    sample = sorted(drawn.select("lang", "draw", "text").mapInArrow(lean(run), schema).orderBy("draw", "lang").limit(most).collect(), key=lambda r: (r["draw"], r["lang"], r["at"]))
    by = defaultdict(list)
    for r in sample:
        by[r["lang"]].append((np.array(r["at"]), np.array(r["share"], np.float64)))
    return fit(by, cost)


def fit(by: dict[str, list[tuple[np.ndarray, np.ndarray]]], cost: float = 10.0) -> Model:
    """All machines, from sparse feature shares of each language's rows."""
    langs: dict[str, list[str]] = defaultdict(list)
    for x in sorted(by):
        langs[family_of(x)].append(x)
    families = sorted(langs)
    jobs = [({x for x in langs[f]}, {x for g in families if g != f for x in langs[g]}) for f in families]
    pairs = [p for f in families for p in itertools.combinations(langs[f], 2)]
    jobs += [({x}, {y}) for x, y in pairs]
    weights, bias = np.zeros((SIZE, len(jobs)), np.float32), np.zeros(len(jobs))
    for k, (yes, no) in enumerate(jobs):
        if no:
            rows = [(r, 1.0) for x in sorted(yes) for r in by[x]] + [(r, -1.0) for x in sorted(no) for r in by[x]]
            weights[:, k], bias[k] = _machine([r for r, _ in rows], np.array([y for _, y in rows]), 20.0, 12, cost)
    return Model(families, dict(langs), pairs, weights, bias)


def identify(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs, with or without the text, with lang_pred and score from whole texts.

    A null text, one without a letter, and any text where the model knows no language are `und`
    with score 0.  Rows are answered one by one; result columns replace columns of the same names.
    """
    names = ["lang_pred", "score"]
    given = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names and (keep_text or c != text)], F.col(f"`{text}`").cast("string").alias(free_name(docs, "own_text")))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE floats for each machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, part in slices(batch):
                langs, scores = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return given.mapInArrow(lean(run), schema)


def remainder(key: str) -> Column:
    """crc32 of the key as text, modulo 4; null for a null key."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4
