"""Descriptive statistics, ranks and regression, as native aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.operators import ordering
from mensura.operators.common import TINY, Names, names, ratio, required, whole


def _agg(df: DataFrame, by: Names, **out: Column) -> DataFrame:
    return df.groupBy(*names(by)).agg(*[c.alias(n) for n, c in out.items()])


def mean(df: DataFrame, value: str, by: Names = None) -> DataFrame:
    """An empty table is an error, as is a group without values."""
    return _agg(df, by, mean=required(F.count(value) > 0, "mean of no values", F.avg(value)))


def median(df: DataFrame, value: str, by: Names = None) -> DataFrame:
    """Exact median; 0.0 of no values."""
    return _agg(df, by, median=F.coalesce(F.percentile(value, 0.5), F.lit(0.0)))


def spread(value: str, ddof: int) -> Column:
    n = F.count(value)
    return required(n > ddof, "too few values", F.try_divide(F.var_pop(value) * n, n - ddof))


def variance(df: DataFrame, value: str, by: Names = None, ddof: int = 1) -> DataFrame:
    return _agg(df, by, variance=spread(value, ddof))


def stdev(df: DataFrame, value: str, by: Names = None, ddof: int = 1) -> DataFrame:
    return _agg(df, by, stdev=F.sqrt(spread(value, ddof)))


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate, 0.0 where either is constant."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return ratio(F.covar_pop(x, y) * n, F.sqrt(F.var_pop(x) * n * F.var_pop(y) * n))


def correlation(df: DataFrame, x: str, y: str, by: Names = None) -> DataFrame:
    return _agg(df, by, correlation=required(F.count(F.lit(1)) >= 2, "correlation needs two rows", pearson(x, y)))


def average_ranks(df: DataFrame, value: str, by: Names = None, out: str = "rank") -> DataFrame:
    """Ranks from 1; equal values get the mean of their ranks.  Over a whole table no task sees all rows."""
    if not names(by):
        return ordering.midranks(df, value, out)
    first = F.rank().over(Window.partitionBy(*names(by)).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*names(by), value))
    return df.withColumn(out, first + (ties - 1) / 2.0)


def spearman_correlation(df: DataFrame, x: str, y: str, by: Names = None) -> DataFrame:
    ranked = average_ranks(average_ranks(df, x, by, "_rx"), y, by, "_ry")
    return _agg(ranked, by, spearman=pearson("_rx", "_ry"))


def percentile(df: DataFrame, value: str, p: float, by: Names = None) -> DataFrame:
    """Linear interpolation at (n - 1) p / 100."""
    if not 0 <= p <= 100:
        raise ValueError("p must be from 0 to 100")
    return _agg(df, by, percentile=F.percentile(value, p / 100))


def z_scores(df: DataFrame, value: str, by: Names = None, ddof: int = 1, out: str = "z") -> DataFrame:
    """(x - mean) / deviation; a constant column is an error."""
    w = whole(by)
    n = F.count(value).over(w)
    sd = F.sqrt(F.try_divide(F.var_pop(value).over(w) * n, n - ddof))
    return df.withColumn(out, required(sd > TINY, "z scores of a constant column", F.try_divide(F.col(value) - F.avg(value).over(w), sd)))


def linear_regression(df: DataFrame, x: str, y: str, by: Names = None) -> DataFrame:
    """slope, intercept and r_squared of y on x; r_squared is 0.0 for a constant y, a constant x is an error."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count(F.lit(1))
    sxx, syy, sxy = F.var_pop(x) * n, F.var_pop(y) * n, F.covar_pop(x, y) * n
    parts = _agg(both, by, n=n, mx=F.avg(x), my=F.avg(y), sxx=sxx, syy=syy, sxy=sxy)
    slope = required((F.col("n") >= 2) & (F.col("sxx") > TINY), "x is constant", F.try_divide("sxy", "sxx"))
    fit = parts.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    return fit.withColumn("r_squared", ratio(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy"))).select(*names(by), "slope", "intercept", "r_squared")


def predict(df: DataFrame, fit: DataFrame, x: str, by: Names = None, out: str = "predicted") -> DataFrame:
    """df with intercept + slope x of its group's fit (one row a group)."""
    joined = df.join(fit, names(by)) if names(by) else df.crossJoin(F.broadcast(fit.limit(1)))
    return joined.withColumn(out, F.col("intercept") + F.col("slope") * F.col(x)).drop("slope", "intercept", "r_squared")


# ---- mergeable moments -------------------------------------------------------------------


def moments(df: DataFrame, value: str, by: Names = None) -> DataFrame:
    """(count, mean, m2): a state that states of other parts can be merged with."""
    return _agg(df, by, count=F.count(value), mean=F.avg(value), m2=F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)))


def merge_moments(states: DataFrame, by: Names = None) -> DataFrame:
    """One state a group from many: means weigh by counts, and m2 gains the spread between the means."""
    n = F.sum("count")
    total = F.try_divide(F.sum(F.col("count") * F.col("mean")), n)
    between = F.sum(F.col("count") * F.col("mean") * F.col("mean")) - n * total * total
    return states.groupBy(*names(by)).agg(n.alias("count"), total.alias("mean"), (F.sum("m2") + F.greatest(between, F.lit(0.0))).alias("m2"))


def finish_moments(states: DataFrame) -> DataFrame:
    """states with variance (sample, null under two rows) and stdev."""
    return states.withColumn("variance", F.when(F.col("count") > 1, F.try_divide("m2", F.col("count") - 1))).withColumn("stdev", F.sqrt("variance"))


def gram(df: DataFrame, features: list[str], y: str, by: Names = None) -> DataFrame:
    """n and all sums of products of (1, features) with each other and with y: the state of a least squares fit."""
    if len(features) > 128:
        raise ValueError("at most 128 features")
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    sums = [F.sum(x[i] * x[j]).alias(f"xx_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return df.groupBy(*names(by)).agg(F.count(F.lit(1)).alias("n"), *sums, *[F.sum(v * F.col(y)).alias(f"xy_{i}") for i, v in enumerate(x)], F.sum(F.col(y) * F.col(y)).alias("yy"))


def solve_gram(state: dict, k: int) -> list[float]:
    """Coefficients, the intercept first, of one gram row with k features."""
    import numpy as np

    a = np.array([[state[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    b = np.array([state[f"xy_{i}"] for i in range(k + 1)])
    if np.linalg.matrix_rank(a) < k + 1:
        raise ValueError("features are linearly dependent")
    return np.linalg.solve(a, b).tolist()
