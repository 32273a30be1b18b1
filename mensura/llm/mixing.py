"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources share so many words by weight; a target stops at a multiple of what its source has,
and what is left over is shared again among the rest.  The mix is a sequence of slots, each for one block
of equally many words.  Slot i of 2**k has the van der Corput point that its reversed bits give;
cumulative slot counts of the sources part the points among them, so that every source gets exactly its slots and
is spread evenly over any stretch of the mix.  A source's documents, in an order shuffled by hash, are one stream of words that
begins again at its end; the slots of a source are ranked, and the n-th takes the n-th block of the stream.

Nothing is numbered in one task: places in a stream come from sums over ranges of hashes, ranks from counts over
ranges of slots, and both are joined by keys of a few rows each, whatever share one source has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.common import free_name, ranked, written

#: Slots whose ranks one task counts, and points that one cell of the map from points to sources holds.
RANGE, CELL = 1 << 16, 1 << 8


class Mix(NamedTuple):
    """documents: all rows with size, source_size and target.  schedule: what each slot takes."""

    documents: DataFrame
    schedule: DataFrame


def size_in_words(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    marks = F.translate(F.regexp_replace(text, r"[^ \t-\r]+", "x"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def running_before(df: DataFrame, by: list[str], part: str, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of value over earlier rows of the same `by`: by part, then order.  Sums over parts come first, so a task holds the rows of one part."""
    parts = df.groupBy(*by, part).agg(F.sum(value).alias("in_part"))
    parts = parts.select(*by, part, (F.sum("in_part").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(part)) - F.col("in_part")).alias("before_part"))
    own = F.sum(value).over(Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("up_to", own).join(parts, [*by, part]).withColumn(name, F.col("before_part") + F.col("up_to") - F.col(value)).drop("up_to", "before_part")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (size, weight, ...) with target: a share of all sizes by weight, none above `most` times its size.

    The level that the rest share rises with each source that stops, until none more does.  Only totals reach the driver.
    """
    cap = most * F.col("size").cast("double")
    whole = sources.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).first()
    total, stopped = share * float(whole["size"] or 0), 0
    level = total / whole["weight"] if whole["n"] else 0.0
    while True:
        at = sources.where(cap <= level * F.col("weight")).agg(F.count(F.lit(1)).alias("n"), F.sum(cap).alias("size"), F.sum("weight").alias("weight")).first()
        if at["n"] == stopped:
            break
        stopped = at["n"]
        if stopped == whole["n"]:
            level = math.inf
            break
        level = (total - at["size"]) / (whole["weight"] - at["weight"])
    wanted = cap if math.isinf(level) else F.least(cap, F.lit(level) * F.col("weight"))
    return sources.withColumn("target", wanted)


def mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, block: int = 1024, seed: int = 42, key: str = "doc_id", source: str = "source", text: str = "text") -> Mix:
    """What a mix of docs takes.  weights go round over the sources, by code point, null last.

    documents: docs without the text, with size (words), source_size, target (words, not rounded), source_number
    and place, the words of its source before it in shuffled order.  schedule: one row for each piece of a document
    in a slot: slot (rising in the order of the mix), source_number, rank (of the slot in its source, from 0), round
    (0 the first time through the source), place (of the document), first_word, words.  A source takes floor(target)
    words: its last slot is cut there.  A document is taken `most` times at most.

    A null or wordless text has size 0 and is never taken; sources without words have target 0.  Rows with the same
    key, size and source are ordered as one, so that any of them may get either's place.  An empty table gives empty ones.
    Result columns replace columns of the same names.
    """
    new = ["size", "source_size", "target", "source_number", "place"]
    names = [c for c in docs.columns if c != text and (c in (key, source) or c.lower() not in new)]
    hashed, part = free_name(docs, "hashed"), free_name(docs, "part")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))))
    rows = written(docs.select(*[F.col(f"`{c}`") for c in names], size_in_words(F.col(f"`{text}`").cast("string")).alias("size"), order.alias(hashed)), "sizes", keep=True)
    totals = written(rows.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "totals", keep=True)
    numbered = ranked(totals, [F.col("source").asc_nulls_last()], "n", keep=True)
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    aims = targets(written(numbered.withColumn("weight", cycle), "sources", keep=True), share, most)
    aims = aims.withColumn("taken", F.floor("target").cast("long")).withColumn("slots", F.ceil(F.col("taken") / block).cast("long"))
    aims = written(running_before(aims.withColumn("part", F.shiftright("n", 12)), [], "part", [F.col("n")], "slots", "first_slot").drop("part"), "targets", keep=True)

    n_rows = totals.agg(F.sum("rows")).first()[0] or 0
    digits = max(1, round(math.log(n_rows + 1, 256)))  # about as many ranges of hashes as rows in each
    joined = rows.join(aims.select(F.col("source").alias("__source"), F.col("n").alias("source_number"), F.col("size").alias("source_size"), "target", "taken"), F.col(f"`{source}`").eqNullSafe(F.col("__source"))).drop("__source")
    joined = joined.withColumn(part, F.substring(F.col(hashed), 1, digits))
    placed = running_before(joined, ["source_number"], part, [F.col(hashed), F.col(f"`{key}`"), F.col("size")], "size", "place")
    placed = written(placed.drop(hashed, part), "placed", keep=True)

    stream = placed.where("size > 0").select("source_number", "place", "size", "taken", "source_size", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("round"))
    start = F.col("place") + F.col("round") * F.col("source_size")
    stream = stream.withColumn("start", start).withColumn("end", F.least(F.col("start") + F.col("size"), F.col("taken"))).where("start < end")
    pieces = stream.withColumn("rank", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})")))
    pieces = pieces.withColumn("from", F.greatest("start", F.col("rank") * block)).withColumn("words", F.least("end", (F.col("rank") + 1) * block) - F.col("from"))
    pieces = pieces.select("source_number", "rank", "round", "place", (F.col("from") - F.col("start")).alias("first_word"), "words")
    schedule = slots_of(aims).join(pieces, ["source_number", "rank"]).select("slot", "source_number", "rank", "round", "place", "first_word", "words")
    return Mix(placed.drop("taken"), schedule)


def slots_of(aims: DataFrame) -> DataFrame:
    """(slot, source_number, rank) from sources (n, slots, first_slot): van der Corput points mapped through cumulative slots, ranked within each source."""
    needed = aims.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, (needed - 1).bit_length()) if needed else 0
    point = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long") if bits else F.lit(0)
    points = aims.sparkSession.range(1 << bits if needed else 0).select(F.col("id").alias("slot"), point.alias("point")).where(F.col("point") < needed)
    parts = aims.where("slots > 0").select(F.col("n").alias("source_number"), "first_slot", (F.col("first_slot") + F.col("slots")).alias("after"), F.explode(F.expr(f"sequence(first_slot div {CELL}, (first_slot + slots - 1) div {CELL})")).alias("cell"))
    mapped = points.withColumn("cell", F.expr(f"point div {CELL}")).join(parts, "cell").where((F.col("point") >= F.col("first_slot")) & (F.col("point") < F.col("after")))
    mapped = mapped.select("slot", "source_number", F.expr(f"slot div {RANGE}").alias("part"), F.lit(1).cast("long").alias("one"))
    return running_before(mapped, ["source_number"], "part", [F.col("slot")], "one", "rank").select("slot", "source_number", "rank")


def taken_words(made: Mix) -> DataFrame:
    """documents with taken: the words of all their pieces."""
    each = made.schedule.groupBy("source_number", "place").agg(F.sum("words").alias("taken"))
    some = made.documents.where("size > 0").join(each, ["source_number", "place"], "left")
    both = some.unionByName(made.documents.where("size = 0").withColumn("taken", F.lit(None).cast("long")))
    return both.select(*made.documents.columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
