"""Measures of predictions: native aggregates over rows of (truth, prediction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.operators import ordering
from mensura.operators.common import Names, names, ratio


def accuracy(df: DataFrame, y: str, predicted: str, by: Names = None) -> DataFrame:
    return df.groupBy(*names(by)).agg(F.avg((F.col(y) == F.col(predicted)).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) for every pair of labels seen on either side, empty pairs too; labels are few."""
    counts = df.groupBy(F.col(y).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.col("t").alias("label")).union(counts.select("p")).distinct()
    grid = labels.select(F.col("label").alias("truth")).crossJoin(F.broadcast(labels.select(F.col("label").alias("predicted"))))
    return grid.join(counts, (F.col("truth") == F.col("t")) & (F.col("predicted") == F.col("p")), "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def precision_recall_f1(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1) of each label; 0.0 for an empty denominator."""
    hit = (F.col(y) == F.col(predicted)).cast("int")
    sides = df.select(F.explode(F.array(F.struct(F.col(y).alias("label"), hit.alias("tp"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s")).select("s.*")
    s = sides.groupBy("label").agg(*[F.sum(c).cast("double").alias(c) for c in ("tp", "t", "p")])
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("p"))).withColumn("recall", ratio(F.col("tp"), F.col("t")))
    return s.select("label", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def macro_prf(df: DataFrame, y: str, predicted: str) -> DataFrame:
    return precision_recall_f1(df, y, predicted).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def regression_scores(df: DataFrame, y: str, predicted: str, by: Names = None) -> DataFrame:
    """mse, mae and r2; a constant target has r2 1.0 if it is met exactly, else 0.0."""
    e = F.col(y) - F.col(predicted)
    s = df.groupBy(*names(by)).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"))
    return s.select(*names(by), "mse", "mae", F.when(F.col("sst") > 1e-15, 1 - F.try_divide("sse", "sst")).when(F.col("sse") <= 1e-15, 1.0).otherwise(0.0).alias("r2"))


def mean_squared_error(df: DataFrame, y: str, predicted: str, by: Names = None) -> DataFrame:
    return regression_scores(df, y, predicted, by).select(*names(by), "mse")


def mean_absolute_error(df: DataFrame, y: str, predicted: str, by: Names = None) -> DataFrame:
    return regression_scores(df, y, predicted, by).select(*names(by), "mae")


def r2_score(df: DataFrame, y: str, predicted: str, by: Names = None) -> DataFrame:
    return regression_scores(df, y, predicted, by).select(*names(by), "r2")


def roc_auc(df: DataFrame, y: str, score: str, positive) -> DataFrame:
    """Chance that a positive row scores above a negative one, ties as half.

    Rows are counted by score first, so the ordered pass sees each distinct score once, in ranges of scores.
    """
    c = df.groupBy(score).agg(F.count_if(F.col(y) == positive).alias("p"), F.count_if(F.col(y) != positive).alias("n"))
    under = ordering.running(c, "sum", "n", [score], "upto")
    s = under.withColumn("u", F.col("p") * (F.col("upto") - F.col("n") / 2.0)).agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return s.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.try_divide("u", F.col("p") * F.col("n"))).otherwise(F.raise_error(F.lit("needs both classes"))).alias("auc"))


def positive_label(df: DataFrame, y: str, order_by: Names):
    """The second distinct label as they first appear, which counts as positive."""
    seen = df.groupBy(y).agg(F.min(F.struct(*names(order_by))).alias("at")).orderBy("at").limit(3).collect()
    if len(seen) != 2:
        raise ValueError("needs two classes")
    return seen[1][0]
