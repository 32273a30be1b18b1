"""Charts of aggregated results, drawn on the driver with matplotlib where it is installed."""

from __future__ import annotations

import importlib
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_matplotlib() -> Any:
    try:
        return importlib.import_module("matplotlib.pyplot")
    except ModuleNotFoundError as e:
        raise ModuleNotFoundError("matplotlib is needed for charts and is not installed") from e


def thinned(df: DataFrame, x: str, y: str, points: int = 1000) -> list[tuple[float, float]]:
    """At most about so many (x, mean y) of a large table, by equal parts of x's range."""
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return []
    part = F.floor((F.col(x) - lo) / ((hi - lo) or 1) * points)
    return [(r[0], r[1]) for r in df.groupBy(part.alias("_p")).agg(F.avg(x), F.avg(y)).orderBy("_p").drop("_p").collect()]


def histogram(df: DataFrame, value: str, bins: int = 20) -> list[tuple[float, float, int]]:
    """(from, to, count) of equal bins, counted by Spark."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return []
    width = ((hi - lo) or 1) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / width).cast("int"))
    n = {r[0]: r[1] for r in df.where(F.col(value).isNotNull()).groupBy(at.alias("b")).count().collect()}
    return [(lo + i * width, lo + (i + 1) * width, n.get(i, 0)) for i in range(bins)]


def _axes(title: str, xlabel: str, ylabel: str) -> tuple[Any, Any]:
    fig, ax = require_matplotlib().subplots()
    ax.set(title=title, xlabel=xlabel, ylabel=ylabel)
    return fig, ax


def plot_series(y: Sequence[float], x: Sequence[float] | None = None, title: str = "Series", xlabel: str = "index", ylabel: str = "value") -> Any:
    fig, ax = _axes(title, xlabel, ylabel)
    ax.plot(range(len(y)) if x is None else x, y)
    return fig


def plot_multi_series(series: Mapping[str, Sequence[float]], title: str = "Series", xlabel: str = "index", ylabel: str = "value") -> Any:
    fig, ax = _axes(title, xlabel, ylabel)
    for k, v in series.items():
        ax.plot(v, label=k)
    ax.legend()
    return fig


def plot_scatter(x: Sequence[float], y: Sequence[float], title: str = "Scatter", xlabel: str = "x", ylabel: str = "y") -> Any:
    fig, ax = _axes(title, xlabel, ylabel)
    ax.scatter(x, y)
    return fig


def plot_regression(x: Sequence[float], y: Sequence[float], title: str = "Linear regression") -> Any:
    fig = plot_scatter(x, y, title)
    b, a = np.polyfit(x, y, 1)
    fig.axes[0].plot([min(x), max(x)], [a + b * min(x), a + b * max(x)])
    return fig


def plot_histogram(bins: Sequence[tuple[float, float, int]], title: str = "Histogram") -> Any:
    fig, ax = _axes(title, "value", "count")
    ax.bar([(a + b) / 2 for a, b, _ in bins], [n for _, _, n in bins], [b - a for a, b, _ in bins])
    return fig


def plot_waveform(signal: Sequence[float], sample_rate: float | None = None, title: str = "Waveform") -> Any:
    return plot_series(signal, [i / (sample_rate or 1) for i in range(len(signal))], title, "time")


def plot_spectrum(magnitudes: Sequence[float], sample_rate: float | None = None, title: str = "Spectrum") -> Any:
    return plot_series(magnitudes, [i * (sample_rate or 1) / max(1, 2 * len(magnitudes)) for i in range(len(magnitudes))], title, "frequency", "magnitude")


def plot_power_spectrum(power: Sequence[float], half: bool = True, title: str = "Power spectrum") -> Any:
    return plot_spectrum(power[: len(power) // 2 + 1] if half else power, title=title)


def plot_acf(r: Sequence[float], title: str = "Autocorrelation") -> Any:
    fig, ax = _axes(title, "lag", "r")
    ax.stem(range(len(r)), r)
    return fig


def plot_seasonal_decompose(parts: Mapping[str, Sequence[float]], title: str = "Seasonal decomposition") -> Any:
    fig, axes = require_matplotlib().subplots(len(parts), 1, sharex=True)
    for ax, (k, v) in zip(np.atleast_1d(axes), parts.items()):
        ax.plot(v)
        ax.set_ylabel(k)
    fig.suptitle(title)
    return fig


def plot_heatmap(matrix: Sequence[Sequence[float]], title: str = "Heatmap") -> Any:
    fig, ax = _axes(title, "column", "row")
    fig.colorbar(ax.imshow(matrix, aspect="auto"))
    return fig


def plot_loss(values: Sequence[float], title: str = "Loss curve") -> Any:
    return plot_series(values, title=title, xlabel="iteration", ylabel="loss")


def plot_optimization_path(history: Sequence[Sequence[float]], title: str = "Optimization trajectory") -> Any:
    return plot_series([p[1] for p in history], [p[0] for p in history], title, "x0", "x1")


def save_figure(fig: Any, path: str, dpi: int = 120) -> str:
    fig.savefig(path, dpi=dpi)
    return path
