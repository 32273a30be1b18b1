"""Factorisations of tall matrices: rows in a table, columns few.

Each task reduces its rows to a triangle of as many rows as columns, triangles are stacked and reduced again, a few
at a time, until one is left.  No task holds more than FAN triangles, and only the last one comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.sources.tables import checkpointed

#: Triangles that one task stacks, and rows that are stacked at once.
FAN, ROWS = 16, 4096


def _triangle(a: np.ndarray) -> np.ndarray:
    """R of a = QR with a diagonal that isn't negative, as many rows as columns."""
    r = np.linalg.qr(a, mode="r")
    r = r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] if len(r) == a.shape[1] else r
    return np.vstack([r, np.zeros((a.shape[1] - len(r), a.shape[1]))]) if len(r) < a.shape[1] else r


def triangle(df: DataFrame, values: str) -> np.ndarray:
    """R with R'R = A'A, for the rows that an array column holds; null rows are left out, an empty table has none."""
    first = df.where(F.col(values).isNotNull()).select(F.size(values)).first()
    if first is None:
        raise ValueError("no rows")
    width = first[0]

    def reduced(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, width))
        for p in parts:
            for i in range(0, len(p), ROWS):
                r = _triangle(np.vstack([r, np.stack(p["v"].to_numpy()[i : i + ROWS]).astype(float)]))
        if len(r):
            yield pd.DataFrame({"r": [r.ravel()]})

    def stacked(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [_triangle(np.vstack([np.array(v).reshape(width, width) for v in p["r"]])).ravel()]})

    rows = df.where(F.col(values).isNotNull()).select(F.col(values).cast("array<double>").alias("v"))
    level = checkpointed(rows.mapInPandas(reduced, "r array<double>"))
    while (n := level.count()) > 1:
        groups = -(-n // FAN)
        level = checkpointed(level.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(groups))).groupBy("g").applyInPandas(stacked, "r array<double>"))
    return _triangle(np.array(level.first()["r"]).reshape(width, width))


def orthonormal(df: DataFrame, values: str, out: str = "q") -> DataFrame:
    """df with the rows of Q of A = QR; the columns must be independent."""
    r = triangle(df, values)
    if np.min(np.abs(np.diag(r))) <= 1e-12 * max(1.0, np.abs(r).max()):
        raise ValueError("the columns are linearly dependent")
    inverse = np.linalg.inv(r)
    return _times(df, values, inverse, out)


def _times(df: DataFrame, values: str, matrix: np.ndarray, out: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def product(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()).astype(float) @ matrix)) if len(v) else pd.Series([], dtype=object)

    return df.where(F.col(values).isNotNull()).withColumn(out, product(F.col(values)))


def singular_values(df: DataFrame, values: str) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, largest first, and the right vectors as rows, each with its largest entry positive."""
    _, s, v = np.linalg.svd(triangle(df, values))
    at = np.argmax(np.abs(v), axis=1)
    return s, v * np.sign(v[np.arange(len(v)), at])[:, None]


def left_vectors(df: DataFrame, values: str, k: int, out: str = "u") -> DataFrame:
    """df with each row's entries in the first k left singular vectors, whose values must not be 0."""
    s, v = singular_values(df, values)
    if k > len(s) or s[k - 1] <= 1e-12 * s[0]:
        raise ValueError("there are fewer singular vectors")
    return _times(df, values, v[:k].T / s[:k], out)
