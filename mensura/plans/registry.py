"""All registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mensura.plans import forms, learning, more, scale, science, statistics, text, timeseries
from mensura.plans.common import Query

_PARTS = (statistics, timeseries, learning, text, science, forms, scale, more)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.flagship_moments(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: q for p in _PARTS for k, q in p.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for p in _PARTS for k, q in p.R.sql.items()}


def aside() -> dict[str, tuple[Query, str | None]]:
    """What reads no table, with its SQL; for tests."""
    return {k: q for p in _PARTS for k, q in p.R.aside.items()}
