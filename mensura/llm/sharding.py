"""K-d tree partitioning into shards of near-equal bytes.

Leaves of the tree are the shards.  A node that must give k shards is split along its widest
metadata dimension (relative to the whole table's range) at the weighted quantile that leaves
floor(k / 2) shards' bytes on the left.  Quantiles are found for all nodes of a level at once by
histograms that are narrowed around each cut, so only (node, bin) sums reach the driver: at most
SUMS a step, whatever the input.  Rows with the same value along the dimension are told apart by
hashes of their text and of the row, in a second search of the same kind, so that a value that a
third of all rows share is split where the bytes ask for it.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.common import free_name, scratch, with_numbers, written

#: Sums of a step that reach the driver at most, whatever the number of nodes, and bins of a node at most.
SUMS, BINS = 1 << 20, 4096

#: Bits of the tie that tell rows of one text apart.
ROW_BITS = 35

#: Rows of one shard that are numbered in one task, about.
SLOT_ROWS = 20_000


@dataclass
class Search:
    """Where a node's cut is looked for: values lo .. hi of a dimension, or ties lo .. hi of rows with the value `fixed`."""

    dimension: int
    lo: int
    hi: int
    need: float  # weight that is still wanted on the left
    fixed: int | None = None
    direct: bool = False  # so few rows are left that each (value, tie) is summed

    def width(self, bins: int) -> int:
        return -(-(self.hi - self.lo + 1) // bins)


def _narrowed(s: Search, sums: list[tuple[int, int, float, int]], bins: int) -> tuple[int, int] | None:
    """The cut (value, tie) if these sums (bin, 0 or value, tie; weight; rows) decide it, else None, and s is narrower.

    Rows up to the cut go to the left.  Of the cuts before and after the row that reaches the
    wanted weight the nearer one counts.
    """
    sums.sort()
    for k, (x, y, w, n) in enumerate(sums):
        if s.need <= w or k == len(sums) - 1:
            break
        s.need -= w
    if s.direct:
        return (x, y) if w - s.need <= s.need else (x, y - 1)
    width = s.width(bins)
    s.lo, s.hi = s.lo + x * width, min(s.hi, s.lo + (x + 1) * width - 1)
    if n <= bins:
        s.direct = True
    elif width == 1 and s.fixed is None:
        s.fixed, s.lo, s.hi = s.lo, 0, (1 << 63) - 1
    elif width == 1:
        return (s.fixed, s.lo) if w - s.need <= s.need else (s.fixed, s.lo - 1)
    return None


def _cuts(rows: DataFrame, searches: dict[int, Search]) -> dict[int, tuple[int, int]]:
    """The cut of each node.  Each step reads the rows once for all nodes and brings SUMS sums to the driver at most."""
    done: dict[int, tuple[int, int]] = {}
    while left := {n: s for n, s in searches.items() if n not in done}:
        bins = max(2, min(BINS, SUMS // len(left)))
        table = [(n, s.dimension, s.lo, s.hi, s.width(bins), s.fixed, s.direct) for n, s in left.items()]
        look = rows.sparkSession.createDataFrame(table, "node int, dimension int, lo long, hi long, width long, fixed long, direct boolean")
        value = F.element_at("at", F.col("dimension"))
        x = F.when(F.col("fixed").isNull(), value).otherwise(F.col("tie"))
        near = rows.join(F.broadcast(look), "node").where(x.between(F.col("lo"), F.col("hi")) & (F.col("fixed").isNull() | (value == F.col("fixed"))))
        near = near.withColumn("off", x - F.col("lo"))
        first = F.when(F.col("direct"), value).otherwise(F.expr("off div width"))
        near = near.select("node", first.alias("x"), F.when(F.col("direct"), F.col("tie")).otherwise(F.lit(0)).alias("y"), "size")
        by: dict[int, list] = defaultdict(list)
        for r in near.groupBy("node", "x", "y").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect():
            by[r["node"]].append((r["x"], r["y"], float(r["w"]), r["n"]))
        for n, s in left.items():
            if (cut := _narrowed(s, by[n], bins)) is not None:
                done[n] = cut
    return done


def grow(rows: DataFrame, dimensions: int, shards: int) -> DataFrame:
    """rows (size: weight, tie, at: array of longs, one for each dimension) with the leaf each falls into, as column node.

    A level reads the rows a few times and writes them once with their nodes; tables of nodes have
    fewer rows than there are shards.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("node", F.lit(0))
    nodes, whole = {0: shards}, []
    while open_ := {n: k for n, k in nodes.items() if k > 1}:
        stats = [f(F.element_at("at", d)).alias(f"{name}{d}") for d in range(1, dimensions + 1) for name, f in (("lo", F.min), ("hi", F.max))]
        seen = {r["node"]: r for r in rows.groupBy("node").agg(*stats, F.sum("size").alias("w")).collect()}
        whole = whole or [max(1, seen[0][f"hi{d}"] - seen[0][f"lo{d}"]) for d in range(1, dimensions + 1)]
        searches = {}
        for n, k in open_.items():
            if r := seen.get(n):  # else nothing falls here
                d = max(range(1, dimensions + 1), key=lambda d: ((r[f"hi{d}"] - r[f"lo{d}"]) / whole[d - 1], -d))
                searches[n] = Search(d, r[f"lo{d}"], r[f"hi{d}"], float(r["w"]) * (k // 2) / k)
        cuts = _cuts(rows, searches)
        table = [(n, searches[n].dimension, *cuts[n], n + open_[n] // 2) for n in searches]
        split = spark.createDataFrame(table, "node int, dimension int, value long, last long, right int")
        value = F.element_at("at", F.col("dimension"))
        goes = (value > F.col("value")) | ((value == F.col("value")) & (F.col("tie") > F.col("last")))
        rows = rows.join(F.broadcast(split), "node", "left").withColumn("node", F.when(goes, F.col("right")).otherwise(F.col("node")))
        rows = written(rows.drop("dimension", "value", "last", "right"), "level")
        nodes = {m: size for n, k in nodes.items() for m, size in ([(n, k // 2), (n + k // 2, k - k // 2)] if k > 1 else [(n, k)])}
    return rows


def assign(docs: DataFrame, shards: int | None = 24, target_bytes: int | None = None, text: str = "text", key: str = "doc_id", labels: tuple[str, ...] = ("lang",)) -> DataFrame:
    """One row per row of docs: key, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 8.  Dimensions of the tree: the size, the codes
    of the label columns that docs has (their hashes; null is a label), and the text's crc32; equal
    texts thus lie side by side unless a cut for equal bytes goes through them.  The number of
    shards is given, or follows from target_bytes.  law is `bytes`: shards have near-equal bytes,
    as near as a single row's size allows; grown_shard is null under it.  slot numbers a shard's
    rows from 0 without gaps, by hash, key and place.  An empty table gives no rows.
    """
    rid = free_name(docs, "rid")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    named = [c for c in labels if c in docs.columns]
    with scratch(docs.sparkSession):
        rows = with_numbers(docs.select(F.col(f"`{key}`").alias("key"), body.alias("t"), *[F.col(f"`{c}`").cast("string").alias(f"label{i}") for i, c in enumerate(named)]), rid)
        at = F.array((F.octet_length("t") + 8).cast("long"), *[F.pmod(F.xxhash64(f"label{i}"), F.lit(1024)) for i in range(len(named))], F.crc32(F.col("t").cast("binary")))
        # by text, then by row: 28 and 35 bits
        tie = F.shiftleft(F.xxhash64("t").bitwiseAND((1 << 28) - 1), ROW_BITS).bitwiseOR(F.xxhash64(rid).bitwiseAND((1 << ROW_BITS) - 1))
        rows = written(rows.select("key", F.col(rid).alias("rid"), at.alias("at"), F.element_at(at, 1).alias("size"), tie.alias("tie")), "sizes")
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if shards is None:
            shards = max(1, -(-total // (target_bytes or 1 << 30)))
        groups = max(1, -(-n // (shards * SLOT_ROWS)), min(16, n // 64))
        leaves = grow(rows, 2 + len(named), shards) if n else rows.withColumn("node", F.lit(0))
        placed = written(leaves.withColumn("group", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int")), "placed", keep=True)
        # shards x groups rows, one for each SLOT_ROWS rows of the input or so; joined, not broadcast
        counts = placed.groupBy("node", "group").agg(F.count(F.lit(1)).alias("n"))
        before = written(counts.withColumn("before", F.sum("n").over(Window.partitionBy("node").orderBy("group")) - F.col("n")).drop("n"), "before", keep=True)
    slot = F.row_number().over(Window.partitionBy("node", "group").orderBy("tie", "key", "rid")) - 1
    numbered = placed.withColumn("within", slot).join(before, ["node", "group"])
    return numbered.select(F.col("key").alias(key), "size", F.element_at("at", -1).alias("text_crc32"), F.lit("bytes").alias("law"), F.col("node").cast("int").alias("shard"), (F.col("before") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
