"""Fourier transforms of one long series, spread over tasks by the four-step method.

With n = rows * columns, place i is (i div columns, i mod columns).  Columns are transformed, every number is
turned by its twiddle factor, and rows are transformed; both passes are grouped by blocks of whole columns or
rows, so a task holds a block of about BLOCK numbers and never the series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a block; a single row or column may be more, which is the root of the series' length.
BLOCK = 1 << 18


def _pass(df: DataFrame, along: str, across: str, n: int, sign: int, twiddle: int, block: int) -> DataFrame:
    """Transforms of n numbers along one index for each value of the other; twiddle: the whole length by which numbers are turned, 0 for none."""
    width = max(1, block // n)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        lines, at = np.unique(part[across].to_numpy(), return_inverse=True)
        z = np.zeros((len(lines), n), complex)
        z[at, part[along].to_numpy()] = part["re"].to_numpy() + 1j * part["im"].to_numpy()
        z = np.fft.fft(z, axis=1) if sign < 0 else np.fft.ifft(z, axis=1) * n
        k = np.arange(n)
        if twiddle:
            z *= np.exp(sign * 2j * math.pi * (np.outer(lines, k) % twiddle) / twiddle)
        return pd.DataFrame({across: np.repeat(lines, n), along: np.tile(k, len(lines)), "re": z.real.ravel(), "im": z.imag.ravel()})

    grouped = df.withColumn("_b", F.expr(f"`{across}` div {width}")).groupBy("_b")
    return grouped.applyInPandas(run, f"`{across}` long, `{along}` long, re double, im double")


def padded_length(df: DataFrame, index: str) -> int:
    """The power of two that holds all places from 0 to the largest."""
    last = df.agg(F.max(index)).first()[0]
    return 0 if last is None else 1 << int(last).bit_length()


def long_fft(df: DataFrame, value: str = "x", index: str = "i", inverse: bool = False, block: int = BLOCK) -> DataFrame:
    """(k, re, im) of one series (index, value), or of a spectrum (index, re, im), zero-padded to a power of two.

    Places that no row has are zeros, and a place may have one row only.  inverse divides by the length.
    """
    n = padded_length(df, index)
    if not n:
        return df.sparkSession.createDataFrame([], "k long, re double, im double")
    bits = n.bit_length() - 1
    columns = 1 << bits // 2
    rows, sign = n // columns, 1 if inverse else -1
    parts = [F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im")] if value in df.columns else [F.col("re"), F.col("im")]
    placed = df.select(F.expr(f"`{index}` div {columns}").alias("a"), F.expr(f"cast(`{index}` % {columns} as long)").alias("c"), *parts)
    turned = _pass(placed, "a", "c", rows, sign, n, block)  # a becomes the low part of the frequency
    out = _pass(turned, "c", "a", columns, sign, 0, block)
    share = 1.0 / n if inverse else 1.0
    return out.select((F.col("a") + rows * F.col("c")).alias("k"), (F.col("re") * share).alias("re"), (F.col("im") * share).alias("im"))
