"""Least squares over a stream of files, with a state that is merged once for each micro-batch.

The state of a fit is its sums of products, a row a group.  A folder holds one table a batch, with all sums up to
that batch.  A batch that runs again starts from the table of the batch before and replaces its own, so each row counts once,
whenever a query stops and starts from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators.common import Names, names
from mensura.operators.descriptive import gram


def csv_stream(spark: SparkSession, path: str, columns: str, delimiter: str = ",", files_per_batch: int = 1000) -> DataFrame:
    """CSV files with a header as a stream; columns: names and types.  A file that comes later is read by a later batch."""
    return spark.readStream.schema(columns).option("header", True).option("sep", delimiter).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_batch).csv(path)


class FitState:
    """Sums of a linear fit in a folder, batch by batch."""

    def __init__(self, spark: SparkSession, path: str, features: Sequence[str], y: str, by: Names = None):
        self.spark, self.path, self.features, self.y, self.by = spark, path.rstrip("/"), list(features), y, names(by)

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def batches(self) -> list[int]:
        """Batches whose table is whole, in order."""
        fs, at = self._fs()
        if not fs.exists(at):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(at)]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[6:]) for n in found if n.startswith("batch-") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def _table(self, batch: int) -> str:
        return f"{self.path}/batch-{batch:012d}"

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Adds a batch's rows; for foreachBatch."""
        cell = lambda c: F.coalesce(F.col(c).cast("double"), F.raise_error(F.lit(f"an empty cell in {c}")).cast("double")).alias(c)
        sums = gram(rows.select(*self.by, *[cell(c) for c in (*self.features, self.y)]), self.features, self.y, self.by)
        earlier = [b for b in self.batches() if b < batch]
        if earlier:
            sums = self.spark.read.parquet(self._table(earlier[-1])).unionByName(sums)
        merged = sums.groupBy(*self.by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) for c, t in sums.dtypes if c not in self.by])
        merged.coalesce(1 if not self.by else merged.rdd.getNumPartitions()).write.mode("overwrite").parquet(self._table(batch))
        fs, _ = self._fs()
        for old in earlier[:-1]:  # the one before this batch is needed if it runs again
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._table(old)), True)

    def sums(self) -> DataFrame:
        done = self.batches()
        if not done:
            raise ValueError("no batch has run")
        return self.spark.read.parquet(self._table(done[-1]))

    def fit(self) -> DataFrame:
        """(by, intercept, coefficients, rows_seen, rmse), a row a group; a singular system is an error."""
        return solved(self.sums(), len(self.features), self.by)


def solved(sums: DataFrame, k: int, by: Names = None) -> DataFrame:
    """The fits of rows of sums, a batch of rows at a time."""

    def solve(parts):
        for p in parts:
            a, v = np.empty((len(p), k + 1, k + 1)), np.empty((len(p), k + 1))
            for r in range(k + 1):
                v[:, r] = p[f"xy_{r}"]
                for c in range(k + 1):
                    a[:, r, c] = p[f"xx_{min(r, c)}_{max(r, c)}"]
            if len(p) and (np.linalg.matrix_rank(a) <= k).any():
                raise ValueError("the system is singular")
            b = np.linalg.solve(a, v[:, :, None])[:, :, 0]
            rest = np.maximum(0.0, p["yy"].to_numpy() - (b * v).sum(axis=1))
            yield pd.DataFrame({**{c: p[c] for c in names(by)}, "intercept": b[:, 0], "coefficients": list(b[:, 1:]), "rows_seen": p["n"], "rmse": np.sqrt(rest / p["n"])})

    kinds = dict(sums.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names(by)), "intercept double, coefficients array<double>, rows_seen long, rmse double"])
    return sums.mapInPandas(solve, schema)


def run_fit(stream: DataFrame, state: FitState, checkpoint: str) -> None:
    """Takes what has come so far, in as many batches as the stream is cut into, and stops; called again, goes on behind it."""
    query = stream.writeStream.foreachBatch(state.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
