"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of bytes.  Blocks are sorted, and each run of equal
blocks gets an integer name, the smallest number among its occurrences; then adjacent pairs of
names are named in the same way, level by level, until each document has one name.  Equal names
mean equal bytes: no name rests on a hash.

A block may have a third of all occurrences.  Frequent blocks (told by counts of their hashes) are
sorted in several salted parts, whose names are brought together by a table of parts alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.common import LOWER, UPPER, with_numbers, written

#: Bytes of a block.  Most documents are one or two blocks.
BLOCK = 4096

#: A block with more than this share of all occurrences is sorted in parts of this share.
SHARE = 1 / 2000


def normalised(text: str):
    """The column with A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), UPPER, LOWER)


def _blocks(docs: DataFrame, rid: str, text: str, carry: list[str], block: int) -> DataFrame:
    rows = docs.select(F.col(rid).alias("rid"), *carry, normalised(text).cast("binary").alias("body"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("body", i * block + 1, F.lit(block)))
    rows = rows.select("rid", *carry, F.sha2("body", 256).alias("text_sha256"), count.alias("blocks"), F.posexplode(cut).alias("place", "block"))
    once = [F.when(F.col("place") == 0, F.col(c)).alias(c) for c in (*carry, "text_sha256")]
    return rows.select("rid", *once, "blocks", "place", "block", F.monotonically_increasing_id().alias("at"))


def _with_totals(rows: DataFrame, keys: list[str], totals: DataFrame, name: str) -> DataFrame:
    """rows with totals' columns for their keys.  totals goes through a table, so that both sides of the join are read anew and a key with very many rows is split."""
    return rows.join(written(totals, name), keys)


def name_documents(docs: DataFrame, rid: str, text: str, carry: list[str], block: int = BLOCK) -> DataFrame:
    """(rid, carry, text_sha256, level, name) of each row; equal (level, name) exactly for equal normalised texts."""
    occurrences = _blocks(docs, rid, text, carry, block)
    sizes = written(occurrences.select(F.xxhash64("block").alias("h")).groupBy("h").count(), "sizes")
    part = max(32, int((sizes.agg(F.sum("count")).first()[0] or 0) * SHARE))
    # at most 1 / SHARE hashes can pass, so this table has a fixed bound
    frequent = sizes.where(F.col("count") > part).select("h", F.ceil(F.col("count") / part).cast("long").alias("parts"))
    salted = occurrences.withColumn("h", F.xxhash64("block")).join(F.broadcast(frequent), "h", "left").withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("rid", "place"), F.col("parts"))).otherwise(F.lit(0)))
    run = Window.partitionBy("block", "salt").orderBy("at")
    named = salted.withColumn("name", F.first("at").over(run))
    first = F.col("parts").isNotNull() & (F.col("name") == F.col("at"))
    level = written(named.select("rid", *carry, "text_sha256", "blocks", "place", "name", F.col("parts").isNotNull().alias("salted"), F.when(first, F.col("block")).alias("block")), "named")
    # names of a salted block's parts become the smallest of them: at most 2 / SHARE rows
    parts = level.where("block is not null").groupBy("block").agg(F.min("name").alias("whole"), F.collect_set("name").alias("names")).select("whole", F.explode("names").alias("name"))
    parts = written(parts, "parts")
    level = level.drop("block").join(F.broadcast(parts), "name", "left").withColumn("name", F.coalesce("whole", "name")).drop("whole", "salted")

    heads = level.where("place = 0")
    done = [heads.where("blocks = 1").select("rid", *carry, "text_sha256", F.lit(0).alias("level"), "name")]
    longer = written(heads.where("blocks > 1").select("rid", *carry, "text_sha256"), "longer")
    rows = written(level.where("blocks > 1").select("rid", "blocks", "place", "name"), "level")
    k = 0
    while rows.limit(1).count():
        k += 1
        left = F.col("place") % 2 == 0
        pairs = rows.groupBy("rid", F.shiftright("place", 1).alias("place")).agg(
            F.ceil(F.first("blocks") / 2).cast("int").alias("blocks"), F.max(F.when(left, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(~left, F.col("name"))), F.lit(-1)).alias("r")
        )
        number = written(written(pairs, "pairs").withColumn("at", F.monotonically_increasing_id()), "numbered")
        rows = _with_totals(number.drop("at"), ["l", "r"], number.groupBy("l", "r").agg(F.min("at").alias("name")), "names").drop("l", "r")
        rows = written(rows, "level")
        done.append(longer.join(rows.where("blocks = 1").select("rid", "name"), "rid").select("rid", *carry, "text_sha256", F.lit(k).alias("level"), "name"))
        rows = rows.where("blocks > 1")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of equal texts the
    row with the largest key stays; a null key is smaller than any other, and of rows with the same
    key one stays.  docs may be empty and may have other columns, which are not read.
    """
    rows = with_numbers(docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")), "rid")  # only these, so no name clashes
    names = written(name_documents(rows, "rid", "__text", ["__key"], block), "identities")
    last = F.max(F.struct("__key", "rid"))
    groups = names.groupBy("level", "name").agg(last.alias("last"), F.count(F.lit(1)).alias("group_size"))
    joined = _with_totals(names, ["level", "name"], groups, "groups")
    return joined.select(F.col("__key").alias(key), F.col("last.__key").alias("keep_id"), "group_size", (F.col("rid") == F.col("last.rid")).alias("kept"), "text_sha256")
