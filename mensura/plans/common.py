"""Helpers of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 6, *keep: str) -> DataFrame:
    """df with its double columns rounded, and -0.0 as 0.0, so that sums in another order compare equal."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


class Registry:
    """Queries by name, each with its SQL where it has one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        #: Queries of fixed inputs, which read no table: tests run them and hold them to their SQL, but they are not registered.
        self.aside: dict[str, tuple[Query, str | None]] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def note(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return note

    def fixed(self, sql: str | None = None) -> Callable[[Query], Query]:
        def note(f: Query) -> Query:
            self.aside[f.__name__] = (f, sql)
            return f

        return note
