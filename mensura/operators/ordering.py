"""Numbers, sums, extremes and recurrences along one total order of all rows, in as many tasks as the rows need.

Rows are dealt out by ranges of the order.  Each range is worked on by itself, and one row a range says
what it hands on to the next ones; what the earlier ranges hand on is then added to each.  No window spans more than
one range, so a whole table is ordered without one task seeing all of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.operators.common import Names, names
from mensura.sources.tables import checkpointed

#: The range of a row in a table that was dealt out.
PART = "_range"

#: Rows of a range that a recurrence works on at once.
CHUNK = 1 << 16

_SUMMARY = {"sum": F.sum, "max": F.max, "min": F.min}
_TOGETHER = {"sum": lambda a, b: a + b, "max": max, "min": min}


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """df, written, with the number of each row's range; ranges follow the order.

    Rows that are equal in the order share a range, so the order should tell rows apart, or rows of equal values be
    counted first.
    """
    order = [_column(c) for c in order]
    return checkpointed(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def carried(dealt: DataFrame, kind: str, value: Column | str, out: str, order: Sequence[Column | str], by: Names = None, backwards: bool = False) -> DataFrame:
    """A table from ranges with out: the sum, max or min of value from the first row (of its `by`) to this one, or with lag the value of the row before.

    The order is that of ranges(), which has the columns of `by` first.  backwards: from the last row.  Null values count for nothing.
    """
    keys, value = names(by), _column(value)
    order = [_column(c) for c in order]
    along = [c.desc() if backwards else c for c in order]
    w = Window.partitionBy(*keys, PART).orderBy(*along)
    local = F.lag(value).over(w) if kind == "lag" else _SUMMARY[kind](value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    place = F.struct(*order)
    summary = (F.min_by if backwards else F.max_by)(value, place) if kind == "lag" else _SUMMARY[kind](value)
    parts = dealt.groupBy(*keys, PART).agg(summary.alias("_hands"))
    if keys:
        before = Window.partitionBy(*keys).orderBy(F.desc(PART) if backwards else F.col(PART))
        prior = F.lag("_hands").over(before) if kind == "lag" else _SUMMARY[kind]("_hands").over(before.rowsBetween(Window.unboundedPreceding, -1))
        handed = parts.select(*keys, PART, prior.alias("_before"))
        on = [dealt[c].eqNullSafe(handed[c]) for c in (*keys, PART)]
        joined = dealt.join(handed, on, "left").select(dealt["*"], "_before")
    else:
        rows, state = [], None
        for r in sorted(parts.collect(), key=lambda r: r[PART], reverse=backwards):  # one a range
            rows.append((r[PART], state))
            if kind == "lag":
                state = r["_hands"]
            elif r["_hands"] is not None:
                state = r["_hands"] if state is None else _TOGETHER[kind](state, r["_hands"])
        schema = T.StructType([T.StructField(PART, T.IntegerType()), T.StructField("_before", parts.schema["_hands"].dataType)])
        joined = dealt.join(F.broadcast(dealt.sparkSession.createDataFrame(rows, schema)), PART, "left").select(*dealt.columns, "_before")
    if kind == "lag":
        first = F.row_number().over(w) == 1
        got = F.when(first, F.col("_before")).otherwise(local)
    elif kind == "sum":
        got = F.when(local.isNull() & F.col("_before").isNull(), None).otherwise(F.coalesce(local, F.lit(0)) + F.coalesce("_before", F.lit(0)))
    else:
        got = (F.greatest if kind == "max" else F.least)(local, F.col("_before"))
    return joined.withColumn(out, got).drop("_before")


def numbered(df: DataFrame, order: Sequence[Column | str], out: str = "number", by: Names = None) -> DataFrame:
    """df with each row's number, from 1, in the order (within by)."""
    return carried(ranges(df, [*names(by), *order]), "sum", F.lit(1).cast("long"), out, order, by).drop(PART)


def running(df: DataFrame, kind: str, value: Column | str, order: Sequence[Column | str], out: str, by: Names = None, backwards: bool = False) -> DataFrame:
    """df with the running sum, max or min of value, or with lag the value before, along the order (within by)."""
    return carried(ranges(df, [*names(by), *order]), kind, value, out, order, by, backwards).drop(PART)


def midranks(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Ranks from 1, null first; equal values get the mean of their ranks.

    Values are counted first: the ordered part sees each of them once, however often one occurs.
    """
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_ties"))
    placed = running(counts, "sum", "_ties", ["_v"], "_up_to")
    ranked = placed.select("_v", (F.col("_up_to") - (F.col("_ties") - 1) / 2.0).alias("_mid"))
    joined = df.join(ranked, F.col(value).eqNullSafe(F.col("_v")))
    return joined.withColumn(out, F.col("_mid")).drop("_v", "_mid")


def tiles(df: DataFrame, k: int, order: Sequence[Column | str], out: str = "tile") -> DataFrame:
    """df with a tile from 0 to k - 1: contiguous in the order, the first n % k one row larger."""
    n = df.count()
    size, more = divmod(n, k)
    at = F.col(out) - 1
    cut = more * (size + 1)
    tile = F.when(at < cut, F.floor(at / (size + 1))).otherwise(more + F.floor((at - cut) / max(size, 1)))
    return numbered(df, order, out).withColumn(out, tile.cast("int"))


# ---- recurrences -------------------------------------------------------------------------


def _powers(a: np.ndarray, n: int) -> list[np.ndarray]:
    """a to the powers of two up to n."""
    out = [a]
    while 1 << len(out) <= n:
        out.append(out[-1] @ out[-1])
    return out


def _power(squares: list[np.ndarray], n: int) -> np.ndarray:
    out = np.eye(len(squares[0]))
    for i, s in enumerate(squares):
        if n >> i & 1:
            out = out @ s
    return out


def states_from_zero(a: np.ndarray, u: np.ndarray, squares: list[np.ndarray]) -> np.ndarray:
    """z[t] = a z[t - 1] + u[t] from z = 0: each step adds what lies twice as far back."""
    z, far = u.copy(), 1
    for square in squares:
        if far >= len(z):
            break
        z[far:] += z[:-far] @ square.T  # the right side is made before it is added
        far *= 2
    return z


def linear_recurrence(df: DataFrame, order: Sequence[str], transition: Sequence[Sequence[float]], inputs: Sequence[Column | str], by: Names = None, first: Sequence[Column | str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """df with arrays state and before: z[t] = A z[t - 1] + u[t] along the order, within by, and the state before each row.

    transition: A.  inputs: u, a column for each element.  A series starts from a state of zeros; first, where given, takes
    the place of u in its first row.  Null inputs are an error.

    A chunk of rows is an affine map of the state it starts with: rows give its part that does not depend on
    that state, powers of A the other.  The maps of all chunks, a row each, are followed in order,
    and each chunk runs again from the state that reaches it.  So a single long series takes as many tasks as chunks.
    """
    keys, order = names(by), list(order)
    a = np.array(transition, float)
    k = len(a)
    squares = _powers(a, 2 * chunk)
    cells = [F.coalesce(_column(c).cast("double"), F.raise_error(F.lit("a recurrence needs values in every row")).cast("double")) for c in inputs]
    starts = [F.coalesce(_column(c).cast("double"), F.raise_error(F.lit("a recurrence needs values in every row")).cast("double")) for c in (first or inputs)]
    along = [*keys, *order]
    placed = df.withColumns({"_u": F.array(*cells), "_v": F.array(*starts), "_series": F.to_json(F.struct(*keys)) if keys else F.lit("")})
    placed = placed.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("_place", F.monotonically_increasing_id())
    # the rows of a partition are numbered from its id times 2**33 on, so chunks follow each other by number
    placed = checkpointed(placed.withColumn("_chunk", F.expr(f"shiftright(_place, 33) * {1 << 33} + (_place & {(1 << 33) - 1}) div {chunk}")))
    places = [(c, placed.schema[c].dataType) for c in placed.columns]

    def pieces(part: pd.DataFrame) -> Iterator[tuple[str, slice]]:
        """(series, rows) of each series of a chunk."""
        s = part["_series"].to_numpy()
        cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1), len(s)]
        for lo, hi in zip(cuts, cuts[1:]):
            yield s[lo], slice(lo, hi)

    def begun(part: pd.DataFrame, at: slice) -> np.ndarray:
        u = np.stack(part["_u"].to_numpy()[at]).astype(float)
        u[0] = part["_v"].iloc[at.start]
        return states_from_zero(a, u, squares)

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place")
        runs = list(pieces(part))
        name, at = runs[-1]
        fresh = begun(part, at)[-1]
        if len(runs) == 1:  # if it goes on, its first row is no series' first
            goes_on = states_from_zero(a, np.stack(part["_u"].to_numpy()).astype(float), squares)[-1]
        else:
            goes_on = fresh
        return pd.DataFrame({"_chunk": [part["_chunk"].iloc[0]], "first": [runs[0][0]], "last": [name], "single": [len(runs) == 1], "n": [len(part)], "fresh": [fresh.tolist()], "goes_on": [goes_on.tolist()]})

    maps = checkpointed(placed.select("_chunk", "_place", "_series", "_u", "_v").groupBy("_chunk").applyInPandas(summary, "_chunk long, first string, last string, single boolean, n long, fresh array<double>, goes_on array<double>"))

    def follow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, z = None, np.zeros(k)
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                on = r.first == series
                out.append(z.tolist() if on else None)
                if on and r.single:
                    z = _power(squares, r.n) @ z + np.array(r.goes_on)
                else:
                    z = np.array(r.fresh)
                series = r.last
            yield pd.DataFrame({"_chunk": p["_chunk"], "_enters": pd.Series(out, dtype=object)})

    # one row a chunk, in order: the only part that is not side by side
    enters = checkpointed(maps.repartition(1).sortWithinPartitions("_chunk").mapInPandas(follow, "_chunk long, _enters array<double>"))
    schema = T.StructType([*[T.StructField(c, t) for c, t in places if c not in ("_u", "_v", "_series", "_place", "_chunk")], T.StructField("state", T.ArrayType(T.DoubleType())), T.StructField("before", T.ArrayType(T.DoubleType()))])
    kept = [f.name for f in schema.fields[:-2]]

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place")
        after, before = np.empty((len(part), k)), np.zeros((len(part), k))
        for i, (_, at) in enumerate(pieces(part)):
            enter = part["_enters"].iloc[0]
            if i == 0 and enter is not None:
                u = np.stack(part["_u"].to_numpy()[at]).astype(float)
                u[0] += a @ np.array(enter, float)
                after[at] = states_from_zero(a, u, squares)
                before[at.start] = enter
            else:
                after[at] = begun(part, at)
            before[at.start + 1 : at.stop] = after[at][:-1]
        return part[kept].assign(state=list(after), before=list(before))

    return placed.join(enters, "_chunk").groupBy("_chunk").applyInPandas(finish, schema)


def smoothed(df: DataFrame, value: str, order: Sequence[str], by: Names = None, alpha: float = 0.5, out: str = "smoothed") -> DataFrame:
    """df with s = alpha x + (1 - alpha) s of the row before, from s = x: linear_recurrence over one number."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    got = linear_recurrence(df, order, [[1 - alpha]], [alpha * F.col(value)], by, first=[value])
    return got.withColumn(out, F.col("state")[0]).drop("state", "before")


def iir_filtered(df: DataFrame, value: str, order: Sequence[str], b: Sequence[float], a: Sequence[float], by: Names = None, out: str = "filtered") -> DataFrame:
    """df with a[0] y[t] = sum of b[i] x[t - i] less sum of a[j] y[t - j], from rest.

    The delays of the transposed form are the state: each takes the next one's value, a share of x and a share of y.
    """
    if not a or abs(a[0]) < 1e-300:
        raise ValueError("a[0] must not be zero")
    k = max(len(a), len(b)) - 1
    nb, na = ([*(c / a[0] for c in v), *[0.0] * (k + 1 - len(v))] for v in (b, a))
    if not k:
        return df.withColumn(out, F.col(value) * nb[0])
    step = np.eye(k, k=1)
    step[:, 0] -= na[1:]
    got = linear_recurrence(df, order, step, [(nb[i] - na[i] * nb[0]) * F.col(value) for i in range(1, k + 1)], by)
    return got.withColumn(out, nb[0] * F.col(value) + F.col("before")[0]).drop("state", "before")
