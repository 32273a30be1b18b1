"""Online accumulators: mergeable states on the driver, and the same sums as streaming aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators.common import Names, names
from mensura.operators.descriptive import gram, moments, solve_gram
from mensura.sources.files import load_csv


@dataclass
class OnlineMoments:
    """Count, mean and sum of squares around it; finite values only."""

    count: int = 0
    mean: float = 0.0
    m2: float = 0.0

    def update(self, x: float) -> None:
        if not math.isfinite(x):
            raise ValueError("values must be finite")
        self.merge(OnlineMoments(1, float(x), 0.0))

    def merge(self, other: OnlineMoments) -> None:
        n = self.count + other.count
        if n and other.count:
            gap, share = other.mean - self.mean, other.count / n
            self.m2 += other.m2 + gap * gap * self.count * share
            self.mean += gap * share
            self.count = n

    @property
    def variance(self) -> float | None:
        return self.m2 / (self.count - 1) if self.count > 1 else None


@dataclass(frozen=True)
class StreamingLinearFit:
    intercept: float
    coefficients: tuple[float, ...]
    rows_seen: int
    rmse: float


@dataclass
class StreamingLinearAccumulator:
    """Sums of products of a least squares fit, batch by batch; states merge by addition."""

    max_features: int = 128
    rows_seen: int = 0
    xtx: np.ndarray | None = field(default=None, repr=False)
    xty: np.ndarray | None = field(default=None, repr=False)
    yty: float = 0.0

    def update(self, features: Sequence[Sequence[float]], y: Sequence[float]) -> None:
        x = np.column_stack((np.ones(len(y)), np.asarray(features, float)))
        t = np.asarray(y, float)
        if x.shape[1] - 1 > self.max_features or not (np.isfinite(x).all() and np.isfinite(t).all()):
            raise ValueError("too many features, or values that are not finite")
        other = StreamingLinearAccumulator(self.max_features, len(t), x.T @ x, x.T @ t, float(t @ t))
        self.merge(other)

    def merge(self, other: StreamingLinearAccumulator) -> None:
        if other.xtx is None:
            return
        if self.xtx is None:
            self.xtx, self.xty = np.zeros_like(other.xtx), np.zeros_like(other.xty)
        if self.xtx.shape != other.xtx.shape:
            raise ValueError("states have different features")
        self.xtx, self.xty = self.xtx + other.xtx, self.xty + other.xty
        self.rows_seen, self.yty = self.rows_seen + other.rows_seen, self.yty + other.yty

    def fit(self) -> StreamingLinearFit:
        if self.xtx is None or np.linalg.matrix_rank(self.xtx) < len(self.xtx):
            raise ValueError("the system is singular")
        b = np.linalg.solve(self.xtx, self.xty)
        return StreamingLinearFit(float(b[0]), tuple(map(float, b[1:])), self.rows_seen, math.sqrt(max(0.0, self.yty - float(b @ self.xty)) / self.rows_seen))


def linear_fit(df: DataFrame, features: list[str], y: str) -> StreamingLinearFit:
    """The same fit from one distributed pass."""
    s = gram(df, features, y).first().asDict()
    b = solve_gram(s, len(features))
    explained = sum(v * s[f"xy_{i}"] for i, v in enumerate(b))
    return StreamingLinearFit(b[0], tuple(b[1:]), s["n"], math.sqrt(max(0.0, s["yy"] - explained) / s["n"]))


def fit_linear_csv_streaming(spark: SparkSession, path: str, feature_columns: Sequence[str], target_column: str, delimiter: str = ",", encoding: str = "utf-8") -> StreamingLinearFit:
    """A CSV file's fit in one pass; a missing column or a cell that is no number is an error."""
    df = load_csv(spark, path, delimiter, encoding)
    if missing := [c for c in (*feature_columns, target_column) if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    cell = lambda c: F.coalesce(F.col(c).cast("double"), F.raise_error(F.lit(f"an empty cell in {c}"))).alias(c)
    return linear_fit(df.select(*[cell(c) for c in (*feature_columns, target_column)]), list(feature_columns), target_column)


# ---- structured streaming ----------------------------------------------------------------


def streaming_moments(stream: DataFrame, value: str, by: Names = None) -> DataFrame:
    """Moments of everything seen so far; for output modes complete and update."""
    return moments(stream, value, by)


def streaming_gram(stream: DataFrame, features: list[str], y: str, by: Names = None) -> DataFrame:
    """Sums of a least squares fit so far; solve each row with solve_gram in foreachBatch."""
    return gram(stream, features, y, by)


def windowed_moments(stream: DataFrame, time: str, value: str, length: str, lateness: str, by: Names = None) -> DataFrame:
    """Moments by tumbling windows; rows later than lateness are dropped and their state forgotten."""
    w = stream.withWatermark(time, lateness).groupBy(F.window(time, length), *names(by))
    return w.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def sessions(stream: DataFrame, time: str, gap: str, lateness: str, by: str) -> DataFrame:
    return stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n"))


def streaming_smoothing(stream: DataFrame, key: str, time: str, value: str, alpha: float = 0.5) -> DataFrame:
    """(key, time, smoothed): the exponential recurrence with a state of one number for each key across batches.

    Rows of a batch are taken in the order of time; batches follow each other as they come.
    """
    k, t = stream.schema[key].dataType.simpleString(), stream.schema[time].dataType.simpleString()

    def run(who: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(time)
        out = []
        for x in rows[value].astype(float):
            last = x if last is None else alpha * x + (1 - alpha) * last
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({key: who[0], time: rows[time], "smoothed": out})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {k}, {time} {t}, smoothed double", "last double", "append", "NoTimeout")


def moments_of(values: Iterable[float]) -> OnlineMoments:
    out = OnlineMoments()
    for v in values:
        out.update(v)
    return out
