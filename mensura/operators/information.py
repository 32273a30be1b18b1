"""Entropies and divergences of discrete distributions, as joins on the category and sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.operators.common import Names, names, whole


def distribution(df: DataFrame, category: Names, by: Names = None) -> DataFrame:
    """(by, category, p) from rows."""
    n = df.groupBy(*names(by), *names(category)).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*names(by), *names(category), (F.col("n") / F.sum("n").over(whole(by))).alias("p"))


def _checked(total: Column, least: Column, value: Column) -> Column:
    return F.when((F.abs(total - 1) <= 1e-9) & (least >= 0), value).otherwise(F.raise_error(F.lit("probabilities must be 0 or more and sum to 1")))


def _plogq(p: Column, q: Column) -> Column:
    return F.when(p > 0, p * F.log(q)).otherwise(0.0)


def entropy(df: DataFrame, p: str = "p", by: Names = None, base: float = 2.0) -> DataFrame:
    c = F.col(p)
    return df.groupBy(*names(by)).agg(_checked(F.sum(c), F.min(c), -F.sum(_plogq(c, c)) / math.log(base)).alias("entropy"))


def _pair(p: DataFrame, q: DataFrame, category: Names) -> DataFrame:
    both = p.select(*names(category), F.col("p").alias("p")).join(q.select(*names(category), F.col("p").alias("q")), names(category), "full_outer")
    return both.select(*names(category), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def _relative(both: DataFrame, value: Column, name: str) -> DataFrame:
    impossible = F.max((F.col("p") > 0) & (F.col("q") == 0))
    return both.agg(F.when(impossible, F.lit(float("inf"))).otherwise(F.sum(value)).alias(name))


def kl_divergence(p: DataFrame, q: DataFrame, category: Names, base: float = 2.0) -> DataFrame:
    """Of tables (category, p); infinite where q is 0 under a positive p."""
    a, b = F.col("p"), F.col("q")
    return _relative(_pair(p, q, category), F.when((a > 0) & (b > 0), a * F.log(F.try_divide(a, b))).otherwise(0.0) / math.log(base), "kl")


def cross_entropy(p: DataFrame, q: DataFrame, category: Names, base: float = 2.0) -> DataFrame:
    a, b = F.col("p"), F.col("q")
    return _relative(_pair(p, q, category), F.when((a > 0) & (b > 0), -a * F.log(b)).otherwise(0.0) / math.log(base), "cross_entropy")


def js_divergence(p: DataFrame, q: DataFrame, category: Names, base: float = 2.0) -> DataFrame:
    a, b = F.col("p"), F.col("q")
    m = (a + b) / 2
    half = lambda x: F.when(x > 0, x * F.log(F.try_divide(x, m))).otherwise(0.0)
    return _pair(p, q, category).agg((F.sum(half(a) + half(b)) / 2 / math.log(base)).alias("js"))


def mutual_information(df: DataFrame, x: str, y: str, base: float = 2.0) -> DataFrame:
    """Of two columns of rows."""
    joint = distribution(df, [x, y])
    joint = joint.withColumn("px", F.sum("p").over(whole(x))).withColumn("py", F.sum("p").over(whole(y)))
    return joint.agg((F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))) / math.log(base)).alias("mutual_information"))
