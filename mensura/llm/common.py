"""What the operators of this package share: written tables, row ids, lean workers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or where it is unset the warehouse, or in local mode a temporary folder.

    On a cluster a warehouse on a machine's own disk is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            local = spark.sparkContext.master.split("[")[0] == "local"
            found = "file://" + tempfile.mkdtemp(prefix="mensura-") if local else spark.conf.get("spark.sql.warehouse.dir")
            if not local and (found.startswith("file:") or "://" not in found):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            _OWN[app] = found
        where = _OWN[app]
    return where.rstrip("/")


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside, but for kept ones, are deleted at the end: all that is read from them must have run by then."""
    mine: list[str] = []
    _SCOPES.append(mine)
    try:
        yield
    finally:
        _SCOPES.remove(mine)
        for path in mine:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mensura/{name}-{uuid.uuid4().hex}"
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _is_scan(df: DataFrame) -> bool:
    """Whether df is one table of Parquet files of which rows and columns were chosen, and nothing else."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic():
        node = node.children().head()
    if node.nodeName() != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation" or node.relation().fileFormat().toString() != "Parquet":
        return False
    roots = sorted(r.rstrip("/") + "/" for r in node.relation().location().rootPaths().mkString("\n").split("\n"))
    return not any(b.startswith(a) for a, b in zip(roots, roots[1:]))  # no file is read twice


def with_row_ids(df: DataFrame, name: str = "rid", keep: bool = False) -> DataFrame:
    """df with a struct (file, row) per row: the hash of its file's path and its place in that file.

    These come again the same in every plan over the files, however these are split and whatever
    executors there are.  What isn't a table of Parquet files is written as one first (kept: see written).
    """
    if not _is_scan(df):
        df = written(df, "rows", keep)
    file, row = free_name(df, "file"), free_name(df, "row")
    got = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return got.select(*[F.col(f"`{c}`") for c in df.columns], F.struct(F.xxhash64(F.col(file)).alias("file"), F.col(row).alias("row")).alias(name))


def with_numbers(df: DataFrame, name: str = "rid") -> DataFrame:
    """df with a unique long per row, for plans that read it once; only tables of files give the same ones again in a task that runs anew, so others are written first."""
    return (df if _is_scan(df) else written(df, "rows")).withColumn(name, F.monotonically_increasing_id())


def ranked(df: DataFrame, order: list, name: str = "rank", keep: bool = False) -> DataFrame:
    """df with each row's place, from 1, in a total order of all rows.

    Rows are dealt out by ranges of the order and numbered in each range's own task; then every range
    moves up by the rows of those before it.  The driver sees one count a range.
    """
    place, part = free_name(df, "place"), free_name(df, "part")
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), "ranges", keep)
    at = F.shiftright(F.col(place), 33)
    before, starts = 0, []
    for row in sorted(dealt.groupBy(at.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((row["part"], before))
        before += row["n"]
    offsets = df.sparkSession.createDataFrame(starts, f"`{part}` long, `{name}` long")
    joined = dealt.withColumn(part, at).join(F.broadcast(offsets), part)  # a row a range
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(f"`{name}`") + F.col(place).bitwiseAND((1 << 33) - 1) + 1).alias(name))


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """make(), or what it gave before for the key.  A worker holds one such thing at a time, so that stages after each other don't add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives free memory back to the system: workers live on and would add up."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # other C libraries have no such function
            ctypes.CDLL(None).malloc_trim(0)

    return leaner


def column_or_null(df: DataFrame, name: str, kind: str):
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, so that it clashes with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[list[str], pa.RecordBatch]]:
    """A batch in parts whose last column, a text, holds at most so many bytes unless one row has more; the texts, null as empty."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate([*sizes, most + 1]):
        if i > start and total + n > most or i == len(sizes) > start:
            part = batch.slice(start, i - start)
            yield [t or "" for t in part.column(part.num_columns - 1).to_pylist()], part
            start, total = i, 0
        total += n
