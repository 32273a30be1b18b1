"""Transforms, filters, wavelets and interpolation over series (i, x), one for each by.

Short series can use joins of the index with itself; long ones go to NumPy, a series a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.operators.common import Names, names, ordered
from mensura.sources.tables import checkpointed


def per_series(df: DataFrame, by: Names, function: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, index: str = "i", value: str = "x") -> DataFrame:
    """function over each series' values in the order of index; by columns come through."""
    keys = names(by)
    new = T.StructType.fromDDL(schema)
    full = T.StructType([*[df.schema[k] for k in keys], *new.fields])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(index)
        out = pd.DataFrame(function(part[value].to_numpy()))
        for k in reversed(keys):
            out.insert(0, k, part[k].iloc[0])
        return out[[f.name for f in full.fields]]

    return df.groupBy(*keys).applyInPandas(run, full)


def dft(df: DataFrame, by: Names = None) -> DataFrame:
    """(by, k, re, im) by a join of times with frequencies; for series whose square is small."""
    keys = names(by)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ks = n.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    pairs = df.join(ks, keys) if keys else df.crossJoin(F.broadcast(ks))
    angle = -2 * math.pi * ((F.col("k") * F.col("i")) % F.col("n")) / F.col("n")
    return pairs.groupBy(*keys, "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))


def idft(spectrum: DataFrame, by: Names = None) -> DataFrame:
    """(by, i, re, im) from (by, k, re, im)."""
    keys = names(by)
    n = spectrum.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ts = n.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    pairs = spectrum.join(ts, keys) if keys else spectrum.crossJoin(F.broadcast(ts))
    a = 2 * math.pi * ((F.col("k") * F.col("i")) % F.col("n")) / F.col("n")
    return pairs.groupBy(*keys, "i").agg((F.sum(F.col("re") * F.cos(a) - F.col("im") * F.sin(a)) / F.max("n")).alias("re"), (F.sum(F.col("re") * F.sin(a) + F.col("im") * F.cos(a)) / F.max("n")).alias("im"))


def _padded(x: np.ndarray) -> np.ndarray:
    n = 1 << max(0, (len(x) - 1).bit_length())
    return np.concatenate((x, np.zeros(n - len(x), x.dtype)))


def _complex(z: np.ndarray, name: str = "k") -> dict[str, np.ndarray]:
    return {name: np.arange(len(z)), "re": z.real, "im": z.imag}


def fft(df: DataFrame, by: Names = None, strict: bool = False) -> DataFrame:
    """(by, k, re, im), zero-padded to a power of two; strict refuses other lengths."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        if strict and len(x) & (len(x) - 1):
            raise ValueError("the length is no power of two")
        return _complex(np.fft.fft(_padded(x)))

    return per_series(df, by, run, "k int, re double, im double")


def fft_radix2(df: DataFrame, by: Names = None) -> DataFrame:
    return fft(df, by, strict=True)


def ifft(spectrum: DataFrame, by: Names = None) -> DataFrame:
    z = spectrum.select(*names(by), F.col("k").alias("i"), F.array("re", "im").alias("x"))

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        v = np.array([complex(*p) for p in x])
        return _complex(np.fft.ifft(_padded(v)), "i")

    return per_series(z, by, run, "i int, re double, im double")


def power_spectrum(df: DataFrame, by: Names = None) -> DataFrame:
    """(by, k, power): |X|^2 / N at the series' own length."""
    return per_series(df, by, lambda x: {"k": np.arange(len(x)), "power": np.abs(np.fft.fft(x)) ** 2 / len(x)}, "k int, power double")


def low_pass_filter(df: DataFrame, cutoff: int, by: Names = None) -> DataFrame:
    """(by, i, re, im) without the frequencies from cutoff to n - cutoff."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        z = np.fft.fft(x)
        z[cutoff : len(x) - cutoff + 1] = 0
        return _complex(np.fft.ifft(z), "i")

    return per_series(df, by, run, "i int, re double, im double")


def fft2(df: DataFrame, inverse: bool = False) -> DataFrame:
    """(row, col, re, im) of a matrix (row, col, val) or of a spectrum: rows, then columns, each padded and in parallel."""
    first = df.select(F.col("row").alias("g"), F.col("col").alias("i"), F.array(F.col("val").cast("double"), F.lit(0.0)).alias("x") if "val" in df.columns else F.array("re", "im").alias("x"))
    f = np.fft.ifft if inverse else np.fft.fft

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        return _complex(f(_padded(np.array([complex(*p) for p in x]))))

    once = per_series(first, "g", run, "k int, re double, im double")
    twice = per_series(once.select(F.col("k").alias("g"), F.col("g").alias("i"), F.array("re", "im").alias("x")), "g", run, "k int, re double, im double")
    return twice.select(F.col("k").alias("row"), F.col("g").alias("col"), "re", "im")


def ifft2(spectrum: DataFrame) -> DataFrame:
    return fft2(spectrum, inverse=True)


def convolve(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, x) of length na + nb - 1: pairs of places, of which the shorter series is sent around, summed by their sum."""
    pairs = a.select(F.col("i").alias("ia"), F.col("x").alias("xa")).crossJoin(b.select(F.col("i").alias("ib"), F.col("x").alias("xb")))
    return pairs.groupBy((F.col("ia") + F.col("ib")).alias("i")).agg(F.sum(F.col("xa") * F.col("xb")).alias("x"))


# ---- filters -----------------------------------------------------------------------------


@dataclass
class FilterCoefficients:
    b: list[float]
    a: list[float]


@dataclass
class BandFilterCoefficients:
    low: float
    high: float
    kind: str
    section1: FilterCoefficients
    section2: FilterCoefficients


def _butter(order: int, cutoff: float, high: bool) -> FilterCoefficients:
    """Bilinear transform of the analogue prototype; cutoff is a share of the Nyquist frequency."""
    if order < 1 or not 0 < cutoff < 1:
        raise ValueError("order from 1, cutoff between 0 and 1")
    w = 2 * math.tan(math.pi * cutoff / 2)
    poles = np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    poles = w / poles if high else w * poles
    z = (2 + poles) / (2 - poles)
    a = np.real(np.poly(z))
    b = np.real(np.poly(np.full(order, 1.0 if high else -1.0)))
    at = -1.0 if high else 1.0
    b = b * (np.polyval(a, at) / np.polyval(b, at))
    return FilterCoefficients((b / a[0]).tolist(), (a / a[0]).tolist())


def butter_lowpass(order: int, cutoff: float) -> FilterCoefficients:
    return _butter(order, cutoff, False)


def butter_highpass(order: int, cutoff: float) -> FilterCoefficients:
    return _butter(order, cutoff, True)


def butter_bandpass(order: int, low: float, high: float) -> BandFilterCoefficients:
    if low >= high:
        raise ValueError("low must be under high")
    return BandFilterCoefficients(low, high, "bandpass", butter_highpass(order, low), butter_lowpass(order, high))


def butter_bandstop(order: int, low: float, high: float) -> BandFilterCoefficients:
    if low >= high:
        raise ValueError("low must be under high")
    return BandFilterCoefficients(low, high, "bandstop", butter_lowpass(order, low), butter_highpass(order, high))


def iir(x: np.ndarray, c: FilterCoefficients) -> np.ndarray:
    """The recurrence of a rational filter, with a state as long as its coefficients."""
    n = max(len(c.a), len(c.b))
    a, b = np.pad(c.a, (0, n - len(c.a))), np.pad(c.b, (0, n - len(c.b)))
    state, out = np.zeros(n), np.empty(len(x))
    for i, v in enumerate(x):
        out[i] = y = b[0] * v + state[0]
        state[:-1] = state[1:] + b[1:] * v - a[1:] * y
    return out


def apply_filter(df: DataFrame, coefficients: FilterCoefficients | BandFilterCoefficients, by: Names = None) -> DataFrame:
    """(by, i, y): a band pass runs both sections in turn, a band stop adds them."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        c = coefficients
        if isinstance(c, FilterCoefficients):
            y = iir(x, c)
        elif c.kind == "bandpass":
            y = iir(iir(x, c.section1), c.section2)
        else:
            y = iir(x, c.section1) + iir(x, c.section2)
        return {"i": np.arange(len(x)), "y": y}

    return per_series(df, by, run, "i int, y double")


def moving_median(df: DataFrame, value: str, order_by: Names, window: int, by: Names = None, out: str = "moving_median") -> DataFrame:
    """Element len // 2 of the sorted centred window, clipped at the ends."""
    if window < 1 or window % 2 == 0:
        raise ValueError("the window must be odd")
    h = window // 2
    near = F.array_sort(F.collect_list(value).over(ordered(by, order_by).rowsBetween(-h, h)))
    return df.withColumn("_m", near).withColumn(out, F.element_at("_m", (F.floor(F.size("_m") / 2) + 1).cast("int"))).drop("_m")


# ---- frames ------------------------------------------------------------------------------


def window(kind: str, n: int) -> list[float]:
    """A periodic window."""
    a = {"hann": 0.5, "hamming": 0.54}[kind]
    return [a - (1 - a) * math.cos(2 * math.pi * i / n) for i in range(n)]


def frame_signal(df: DataFrame, n_fft: int, hop: int, by: Names = None) -> DataFrame:
    """(by, frame, j, x) of overlapping frames; the last is padded with zeros.  Each sample names its own frames."""
    keys = names(by)
    size = df.groupBy(*keys).agg((F.max("i") + 1).alias("n"))
    rows = df.join(size, keys) if keys else df.crossJoin(F.broadcast(size))
    last = F.when(F.col("n") > n_fft, F.ceil((F.col("n") - n_fft) / hop)).otherwise(0).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - n_fft + 1) / hop)).cast("int")
    end = F.least(last, F.floor(F.col("i") / hop).cast("int"))
    own = rows.where(first <= end).select(*keys, "i", "x", F.explode(F.sequence(first, end)).alias("frame")).select(*keys, "frame", (F.col("i") - F.col("frame") * hop).cast("int").alias("j"), "x")
    grid = size.select(*keys, F.explode(F.sequence(F.lit(0), last)).alias("frame")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_fft - 1))))
    return grid.join(own, [*keys, "frame", "j"], "left").select(*keys, "frame", "j", F.coalesce("x", F.lit(0.0)).alias("x"))


def stft(df: DataFrame, n_fft: int = 256, hop: int | None = None, window_kind: str = "hann", by: Names = None) -> DataFrame:
    """(by, frame, k, magnitude) for n_fft / 2 + 1 frequencies; frames are transformed side by side."""
    w = np.array(window(window_kind, n_fft))
    frames = frame_signal(df, n_fft, hop or n_fft // 4, by).withColumnRenamed("j", "i")

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        m = np.abs(np.fft.fft(x * w))[: n_fft // 2 + 1]
        return {"k": np.arange(len(m)), "magnitude": m}

    return per_series(frames, [*names(by), "frame"], run, "k int, magnitude double")


# ---- wavelets ----------------------------------------------------------------------------


def _even(df: DataFrame, by: Names, power: bool) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*names(by)))
    ok = (n.bitwiseAND(n - 1) == 0) if power else (n % 2 == 0)
    return df.withColumn("x", F.when(ok & (n >= 2), F.col("x").cast("double")).otherwise(F.raise_error(F.lit("the length does not allow this transform"))))


def dwt(df: DataFrame, by: Names = None, power_of_two: bool = False) -> DataFrame:
    """(by, i, approx, detail) of the Haar transform: sums and differences of neighbours over the root of 2."""
    even = F.col("i") % 2 == 0
    s = _even(df, by, power_of_two).groupBy(*names(by), F.floor(F.col("i") / 2).cast("int").alias("i")).agg(F.sum(F.when(even, F.col("x"))).alias("a"), F.sum(F.when(~even, F.col("x"))).alias("b"))
    return s.select(*names(by), "i", ((F.col("a") + F.col("b")) / math.sqrt(2)).alias("approx"), ((F.col("a") - F.col("b")) / math.sqrt(2)).alias("detail"))


def idwt(coefficients: DataFrame, by: Names = None) -> DataFrame:
    """(by, i, x) from (by, i, approx, detail)."""
    a, d = F.col("approx"), F.col("detail")
    both = F.explode(F.array(F.struct((F.col("i") * 2).alias("i"), ((a + d) / math.sqrt(2)).alias("x")), F.struct((F.col("i") * 2 + 1).alias("i"), ((a - d) / math.sqrt(2)).alias("x"))))
    return coefficients.select(*names(by), both.alias("s")).select(*names(by), "s.*")


def dwt_multi_level(df: DataFrame, levels: int, by: Names = None, power_of_two: bool = False) -> DataFrame:
    """(by, level, i, approx, detail), each level over the approximation of the one before."""
    out, now = None, df
    for k in range(1, levels + 1):
        c = checkpointed(dwt(now, by, power_of_two))  # else a task of the last level sorts and adds up all levels at once, and each is worked out again
        row = c.withColumn("level", F.lit(k))
        out = row if out is None else out.unionByName(row)
        now = c.select(*names(by), "i", F.col("approx").alias("x"))
    return out


def denoise(df: DataFrame, threshold: float, by: Names = None) -> DataFrame:
    """One level, with details under the threshold set to 0."""
    c = dwt(df, by)
    return idwt(c.withColumn("detail", F.when(F.abs("detail") < threshold, 0.0).otherwise(F.col("detail"))), by)


# ---- interpolation -----------------------------------------------------------------------


def interp1d(knots: DataFrame, points: DataFrame, kind: str = "linear", by: Names = None) -> DataFrame:
    """points (by, x, ...) with y from knots (by, x, y); outside the knots is an error.

    Knots and points are put in one order and each point looks back and ahead for its knots, so no
    range join is needed.  A knot's x must be unique.
    """
    keys = names(by)
    extra = [c for c in points.columns if c not in (*keys, "x")]
    k = knots.select(*keys, "x", F.lit(0).alias("_p"), "y", *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra])
    p = points.select(*keys, "x", F.lit(1).alias("_p"), F.lit(None).cast("double").alias("y"), *extra)
    w = Window.partitionBy(*keys).orderBy("x", "_p")
    knot = F.when(F.col("_p") == 0, F.struct("x", "y"))
    both = k.unionByName(p).withColumn("_k", knot)
    back = F.last("_k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    from_end = Window.partitionBy(*keys).orderBy(F.desc("x"), F.desc("_p"))
    ahead = F.last("_k", ignorenulls=True).over(from_end.rowsBetween(Window.unboundedPreceding, 0))
    s = both.withColumn("_a", back).withColumn("_b", ahead).where("_p = 1")
    x, a, b = F.col("x"), F.col("_a"), F.col("_b")
    if kind == "linear":
        y = F.when(a["x"] == x, a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * F.try_divide(x - a["x"], b["x"] - a["x"]))
    elif kind == "nearest":
        y = F.when((a["x"] == x) | (x - a["x"] <= b["x"] - x), a["y"]).otherwise(b["y"])
    else:
        raise ValueError(f"unknown kind: {kind}")
    inside = a.isNotNull() & ((a["x"] == x) | b.isNotNull())
    return s.select(*keys, "x", *extra, F.when(inside, y).otherwise(F.raise_error(F.lit("a point is outside the knots"))).alias("y"))


def interp2d(grid: DataFrame, points: DataFrame) -> DataFrame:
    """points (x, y, ...) with z, bilinear over a rectangular grid (x, y, z); the first cell on shared edges, and none outside.

    Cells come from the grid's neighbours by two windows.  Each is listed under the buckets that it reaches into, as wide
    as a cell is on average, and a point looks in its own bucket only: an equi-join, whatever the sizes of both sides.
    """
    gx = grid.withColumn("x1", F.lead("x").over(Window.partitionBy("y").orderBy("x"))).withColumn("z10", F.lead("z").over(Window.partitionBy("y").orderBy("x")))
    up = Window.partitionBy("x").orderBy("y")
    cells = gx.withColumn("y1", F.lead("y").over(up)).withColumn("z01", F.lead("z").over(up)).withColumn("z11", F.lead("z10").over(up)).where("x1 is not null and y1 is not null").select(F.col("x").alias("x0"), "x1", F.col("y").alias("y0"), "y1", F.col("z").alias("z00"), "z10", "z01", "z11")
    of = cells.agg(F.min("x0"), F.min("y0"), F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0")), F.max("x1"), F.max("y1")).first()
    if of[0] is None:
        return points.limit(0).withColumn("z", F.lit(None).cast("double"))
    lx, ly, wx, wy, hx, hy = map(float, of)
    bucket = lambda c, low, wide: F.floor((F.col(c) - low) / wide).cast("long")
    cells = cells.withColumn("_bx", F.explode(F.sequence(bucket("x0", lx, wx), bucket("x1", lx, wx)))).withColumn("_by", F.explode(F.sequence(bucket("y0", ly, wy), bucket("y1", ly, wy))))
    p = points.where(F.col("x").between(lx, hx) & F.col("y").between(ly, hy)).withColumn("_bx", bucket("x", lx, wx)).withColumn("_by", bucket("y", ly, wy))
    inside = ((F.col("x") > F.col("x0")) | ((F.col("x") == lx) & (F.col("x0") == lx))) & (F.col("x") <= F.col("x1")) & ((F.col("y") > F.col("y0")) | ((F.col("y") == ly) & (F.col("y0") == ly))) & (F.col("y") <= F.col("y1"))
    u, v = (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")), (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0"))
    z = (1 - u) * (1 - v) * F.col("z00") + u * (1 - v) * F.col("z10") + (1 - u) * v * F.col("z01") + u * v * F.col("z11")
    return p.join(cells, ["_bx", "_by"]).where(inside).select(*points.columns, z.alias("z"))
