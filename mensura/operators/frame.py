"""Selection, grouping, description and scaling of tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators.common import Names, names, ordered, ratio, whole


def columns(df: DataFrame) -> list[str]:
    return df.columns


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"unknown column: {name}")
    return df.select(name)


def column_as_float(df: DataFrame, name: str) -> DataFrame:
    """The column as doubles; a cell that is no number is an error under ANSI mode."""
    return column(df, name).select(F.col(name).cast("double").alias(name))


def select(df: DataFrame, *wanted: str) -> DataFrame:
    for n in wanted:
        column(df, n)
    return df.select(*wanted)


def filter_rows(df: DataFrame, predicate: Column | str | Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows that fit a Column or SQL predicate, which reaches the scan, or a function of pandas batches, which can't."""
    if isinstance(predicate, Column | str):
        return df.filter(predicate)
    return df.mapInPandas(lambda parts: (p[predicate(p)] for p in parts), df.schema)


def head(df: DataFrame, order_by: Names, n: int = 5) -> DataFrame:
    return df.orderBy(*names(order_by)).limit(n)


def tail(df: DataFrame, order_by: Names, n: int = 5) -> DataFrame:
    """The last n rows in order; all rows for n = 0."""
    if n == 0:
        return df.orderBy(*names(order_by))
    return df.orderBy(*[F.desc(c) for c in names(order_by)]).limit(n).orderBy(*names(order_by))


def group_mean(df: DataFrame, by: Names, value: str) -> DataFrame:
    """Mean of the cells that are numbers (booleans count as 0 and 1), 0.0 for a group without any."""
    return df.groupBy(*names(by)).agg(F.coalesce(F.avg(F.col(value).try_cast("double")), F.lit(0.0)).alias("mean"))


def group_count(df: DataFrame, by: Names) -> DataFrame:
    return df.groupBy(*names(by)).agg(F.count(F.lit(1)).alias("count"))


def to_list(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def to_pandas(df: DataFrame) -> pd.DataFrame:
    return df.toPandas()


def from_pandas(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    """A DataFrame with string column names, NaN as null."""
    return spark.createDataFrame(frame.rename(columns=str).astype(object).where(frame.notna().to_numpy(), None))


def describe(df: DataFrame, *wanted: str) -> DataFrame:
    """count, mean, std, min, median, max of each column all of whose cells are numbers and that has two or more."""
    cols = list(wanted) or df.columns
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "cell")
    x = F.col("cell").try_cast("double")
    out = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.percentile(x, 0.5).alias("median"), F.max(x).alias("max"), F.count_if(x.isNull()).alias("bad")
    )
    return out.where("bad = 0 and count >= 2").drop("bad")


def normalize(df: DataFrame, value: str, by: Names = None, out: str = "normalized") -> DataFrame:
    """(x - min) / (max - min), 0.0 where all are equal."""
    w = whole(by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(hi == lo, 0.0).otherwise(F.try_divide(F.col(value) - lo, hi - lo)))


def z_score(df: DataFrame, value: str, by: Names = None, out: str = "z_score") -> DataFrame:
    """(x - mean) / sample deviation, 0.0 throughout where the deviation is 0."""
    w = whole(by)
    return df.withColumn(out, ratio(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)))


def moving_average(df: DataFrame, value: str, order_by: Names, by: Names = None, window: int = 3, out: str = "moving_average") -> DataFrame:
    """Mean of the last `window` rows, of fewer at the start."""
    return df.withColumn(out, F.avg(value).over(ordered(by, order_by).rowsBetween(-(window - 1), 0)))


def plot_bar(data: dict[str, float], title: str = "Bar Chart", width: int = 50) -> str:
    """Bars of text for a small, already aggregated mapping."""
    top = max([abs(v) for v in data.values()], default=0) or 1
    pad = max([len(k) for k in data], default=0)
    return "\n".join([title, *[f"{k:<{pad}} | {'#' * round(abs(v) / top * width)} {v:g}" for k, v in data.items()]])


def plot_line(values: list[float], title: str = "Line Plot", height: int = 10, width: int = 60) -> str:
    """A line of text marks; longer series are thinned to the width."""
    if not values:
        return title
    ys = [values[i * len(values) // width] for i in range(width)] if len(values) > width else values
    lo, span = min(ys), (max(ys) - min(ys)) or 1
    rows = [[" "] * len(ys) for _ in range(height)]
    for x, y in enumerate(ys):
        rows[height - 1 - round((y - lo) / span * (height - 1))][x] = "*"
    return "\n".join([title, *["".join(r).rstrip() for r in rows]])


def rollup(df: DataFrame, columns: list[str], *measures: Column) -> DataFrame:
    """measures for columns, for all but the last, and so on to the whole table; level has a bit for each column that was left out."""
    return df.rollup(*columns).agg(F.grouping_id().cast("long").alias("level"), *measures)


def cube(df: DataFrame, columns: list[str], *measures: Column) -> DataFrame:
    """measures for each subset of columns; level has a bit for each column that was left out."""
    return df.cube(*columns).agg(F.grouping_id().cast("long").alias("level"), *measures)


def approximate_distinct(df: DataFrame, value: str, by: list[str] | None = None, error: float = 0.02) -> DataFrame:
    """Distinct non-null values by a sketch of bounded size, merged over tasks; error is its relative standard deviation."""
    return df.groupBy(*(by or [])).agg(F.approx_count_distinct(value, error).alias("distinct"))
