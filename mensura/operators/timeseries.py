"""Operators over equally spaced series: rows in the order of order_by, one series for each by."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.functions.special import chi2_sf
from mensura.operators.common import TINY, Names, names, ordered, ratio, whole


def indexed(df: DataFrame, value: str, order_by: Names, by: Names = None) -> DataFrame:
    """by, i (from 0), x, n and the deviation d from the series' mean."""
    w = whole(by)
    return df.select(*names(by), (F.row_number().over(ordered(by, order_by)) - 1).alias("i"), F.col(value).cast("double").alias("x"), F.count(F.lit(1)).over(w).alias("n"), (F.col(value) - F.avg(value).over(w)).cast("double").alias("d"))


def autocorrelation(df: DataFrame, value: str, order_by: Names, by: Names = None, lag: int = 1) -> DataFrame:
    """Biased autocorrelation at one lag, within -1 and 1; 0.0 for a constant series."""
    w = Window.partitionBy(*names(by)).orderBy("i")
    s = indexed(df, value, order_by, by).withColumn("p", F.col("d") * F.lag("d", lag).over(w))
    r = ratio(F.coalesce(F.sum("p"), F.lit(0.0)), F.sum(F.col("d") * F.col("d")))
    return s.groupBy(*names(by)).agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("autocorrelation"))


def autocorrelation_function(df: DataFrame, value: str, order_by: Names, by: Names = None, max_lag: int | None = None) -> DataFrame:
    """(by, lag, r) for lags from 0 to max_lag, n - 1 by default.

    Each row meets the rows up to max_lag before it in one window of its own series.
    """
    s = indexed(df, value, order_by, by)
    if max_lag is None:
        max_lag = (s.agg(F.max("n")).first()[0] or 1) - 1
    w = Window.partitionBy(*names(by)).orderBy("i").rowsBetween(-max_lag, 0)
    pairs = s.withColumn("back", F.reverse(F.collect_list("d").over(w))).select(*names(by), "n", "d", F.posexplode("back").alias("lag", "e"))
    var = s.groupBy(*names(by)).agg(F.sum(F.col("d") * F.col("d")).alias("v"))
    sums = pairs.groupBy(*names(by), "lag").agg(F.sum(F.col("d") * F.col("e")).alias("c"))
    both = sums.join(var, names(by)) if names(by) else sums.crossJoin(F.broadcast(var))
    return both.select(*names(by), "lag", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.col("c"), F.col("v")))).alias("r"))


def partial_autocorrelations(r: list[float]) -> list[float]:
    """Durbin-Levinson recursion over autocorrelations from lag 0 on."""
    out, phi = [1.0], []
    for k in range(1, len(r)):
        bottom = 1 - sum(p * r[j + 1] for j, p in enumerate(phi))
        top = r[k] - sum(p * r[k - 1 - j] for j, p in enumerate(phi))
        a = top / bottom if abs(bottom) > TINY else 0.0
        phi = [p - a * q for p, q in zip(phi, reversed(phi))] + [a]
        out.append(a)
    return out


def partial_autocorrelation(df: DataFrame, value: str, order_by: Names, by: Names = None, max_lag: int | None = None) -> DataFrame:
    """(by, lag, pacf) for lags from 0 to max_lag, n // 2 by default; the recursion runs per series on its few lags."""
    if max_lag is None:
        n = indexed(df, value, order_by, by).agg(F.max("n")).first()[0] or 0
        max_lag = n // 2
    acf = autocorrelation_function(df, value, order_by, by, max_lag)
    rows = acf.groupBy(*names(by)).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "r"))), lambda s: s["r"]).alias("rs"))
    pacf = F.udf(partial_autocorrelations, T.ArrayType(T.DoubleType()))
    return rows.select(*names(by), F.posexplode(pacf("rs")).alias("lag", "pacf"))


def moving_average(df: DataFrame, value: str, order_by: Names, by: Names = None, window: int = 3, out: str = "moving_average") -> DataFrame:
    """Mean of the rows from window - 1 before to window - 1 after."""
    return df.withColumn(out, F.avg(value).over(ordered(by, order_by).rowsBetween(-(window - 1), window - 1)))


def exponential_smoothing(df: DataFrame, value: str, order_by: Names, by: Names = None, alpha: float = 0.5) -> DataFrame:
    """s = alpha x + (1 - alpha) s of the row before.  A recurrence: one task for a series, series side by side."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    keys = names(by)
    schema = T.StructType([*[df.schema[c] for c in [*keys, *names(order_by)]], T.StructField("smoothed", T.DoubleType())])

    def smooth(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(names(order_by))
        part["smoothed"] = part[value].astype(float).ewm(alpha=alpha, adjust=False).mean()
        return part[[f.name for f in schema.fields]]

    return df.select(*dict.fromkeys([*keys, *names(order_by), value])).groupBy(*keys).applyInPandas(smooth, schema)


def difference(df: DataFrame, value: str, order_by: Names, by: Names = None, lag: int = 1, order: int = 1) -> DataFrame:
    """x minus x of lag rows before, `order` times; the first lag * order rows of a series go."""
    w = ordered(by, order_by)
    out = df.withColumn("difference", F.col(value).cast("double")).withColumn("_i", F.row_number().over(w))
    for _ in range(order):
        out = out.withColumn("difference", F.col("difference") - F.lag("difference", lag).over(w))
    return out.where(F.col("_i") > lag * order).drop("_i")


def kpss_statistic(df: DataFrame, value: str, order_by: Names, by: Names = None, lags: int | None = None) -> DataFrame:
    """statistic, lags and is_stationary (under 0.463) of the level test with Bartlett weights."""
    keys = names(by)
    s = indexed(df, value, order_by, by).withColumn("c", F.sum("d").over(Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    rule = F.lit(lags) if lags is not None else F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100.0, 0.25)).cast("int"))
    top = lags
    if top is None:
        n = s.agg(F.max("n")).first()[0] or 1
        top = max(1, int(4 * (n / 100) ** 0.25))
    w = Window.partitionBy(*keys).orderBy("i")
    long = sum(((1 - F.lit(k) / (F.col("lags") + 1)) * F.when(F.col("lags") >= k, F.col(f"g{k}")).otherwise(0.0) for k in range(1, top + 1)), F.lit(0.0))
    for k in range(1, top + 1):
        s = s.withColumn(f"p{k}", F.col("d") * F.lag("d", k).over(w))
    agg = s.withColumn("lags", rule).groupBy(*keys).agg(F.first("n").alias("n"), F.first("lags").alias("lags"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("d") * F.col("d")).alias("g0"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(1, top + 1)])
    variance = (F.col("g0") + 2 * long) / F.col("n")
    out = agg.withColumn("statistic", ratio(F.col("cc"), F.col("n") * F.col("n") * variance))
    return out.select(*keys, "statistic", "lags", (F.col("statistic") < 0.463).alias("is_stationary"))


def seasonal_decompose(df: DataFrame, value: str, order_by: Names, period: int, by: Names = None) -> DataFrame:
    """df's series as i, x, trend, seasonal, residual.

    trend: mean of the rows within max(1, period // 2) - 1; seasonal: means of x - trend by phase, centred at 0.
    """
    keys, w = names(by), max(1, period // 2)
    s = indexed(df, value, order_by, by).withColumn("trend", F.avg("x").over(Window.partitionBy(*keys).orderBy("i").rowsBetween(-(w - 1), w - 1)))
    s = s.withColumn("phase", F.col("i") % period)
    means = s.groupBy(*keys, "phase").agg(F.avg(F.col("x") - F.col("trend")).alias("raw"))
    means = means.withColumn("seasonal", F.col("raw") - F.avg("raw").over(whole(by))).drop("raw")
    return s.join(means, [*keys, "phase"]).select(*keys, "i", "x", "trend", "seasonal", (F.col("x") - F.col("trend") - F.col("seasonal")).alias("residual"))


def ljung_box(df: DataFrame, value: str, order_by: Names, by: Names = None, lags: int = 10) -> DataFrame:
    """statistic, df, p_value and has_autocorrelation (p < 0.05)."""
    keys = names(by)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    acf = autocorrelation_function(df, value, order_by, by, lags).where(F.col("lag") > 0)
    acf = acf.join(n, keys) if keys else acf.crossJoin(F.broadcast(n))
    q = acf.groupBy(*keys).agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag")))).alias("statistic"))
    out = q.withColumn("df", F.lit(lags)).withColumn("p_value", chi2_sf(F.col("statistic"), F.lit(float(lags))))
    return out.withColumn("has_autocorrelation", F.col("p_value") < 0.05)
