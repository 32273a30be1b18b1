"""Conventions of all operators.

Rows have no order in a DataFrame, so an operator over a sequence takes order_by, whose columns
must be unique within by.  by: grouping columns, none for the whole table.  A window over the whole
table runs in one task; give by for large ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Names = str | Sequence[str] | None

#: A denominator at or under this counts as zero.
TINY = 1e-15


def names(x: Names) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def ordered(by: Names, order_by: Names) -> WindowSpec:
    return Window.partitionBy(*names(by)).orderBy(*names(order_by))


def whole(by: Names) -> WindowSpec:
    return Window.partitionBy(*names(by))


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b, or a fixed value where |b| is tiny; never a division by zero."""
    return F.when(F.abs(b) > TINY, a / b).otherwise(F.lit(otherwise).cast("double"))


def first_seen(df: DataFrame, label: str, order_by: Names) -> DataFrame:
    """(label, place) of each distinct label, numbered from 0 as they first appear."""
    seen = df.groupBy(label).agg(F.min(F.struct(*names(order_by))).alias("at"))
    return seen.select(label, (F.row_number().over(Window.orderBy("at")) - 1).alias("place"))


def required(ok: Column, message: str, value: Column) -> Column:
    """value, with an error when it is asked for and ok is false."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))
