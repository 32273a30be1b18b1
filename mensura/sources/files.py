"""Sources: CSV, blocks of bytes, profiles, arrays by slabs, optional array files."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any, Protocol, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1024 * 1024
State = TypeVar("State")


def resolve_within_root(path: str | os.PathLike[str], root: str | os.PathLike[str]) -> Path:
    """path, links followed, if it lies in root."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    if not full.is_relative_to(base):
        raise ValueError(f"{path} is outside {root}")
    return full


def resolve_target(path: str | os.PathLike[str], root: str | os.PathLike[str] | None = None) -> Path:
    return Path(path) if root is None else resolve_within_root(path, root)


def load_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """All columns as strings, named by the header; missing cells are null, surplus ones are dropped."""
    if len(delimiter) != 1:
        raise ValueError("the delimiter is one character")
    return spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)


def iter_csv_batches(spark: SparkSession, path: str, batch_size: int = 10_000, **options: Any) -> Iterator[list[dict[str, str]]]:
    """Rows in lists of a bounded size, a partition at a time on the driver."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    batch: list[dict[str, str]] = []
    for r in load_csv(spark, path, **options).toLocalIterator(prefetchPartitions=True):
        batch.append(r.asDict())
        if len(batch) == batch_size:
            yield batch
            batch = []
    if batch:
        yield batch


@dataclass(frozen=True)
class FileProfile:
    path: str
    size_bytes: int
    recommended_block_size: int


def profile_file(spark: SparkSession, path: str, memory_budget_bytes: int = 256 * MB, min_block_size: int = MB, max_block_size: int = 64 * MB) -> FileProfile:
    """Size of a file, and an eighth of the budget as a block size, within bounds and the file."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return FileProfile(path, size, max(1, min(max_block_size, max(min_block_size, memory_budget_bytes // 8), size or min_block_size)))


def file_blocks(spark: SparkSession, path: str, block_size: int = 8 * MB) -> DataFrame:
    """(path, block, bytes) of files, cut on the executors."""
    f = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    n = F.greatest(F.ceil(F.col("length") / block_size), F.lit(1)).cast("int")
    return f.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("content", i * block_size + 1, F.lit(block_size)))).alias("block", "bytes")).where("octet_length(bytes) > 0")


class SliceableArray(Protocol):
    shape: tuple[int, ...]
    dtype: Any

    def __getitem__(self, key: Any) -> Any: ...


@dataclass(frozen=True)
class ScientificArrayProfile:
    shape: tuple[int, ...]
    dtype: str
    itemsize: int | None
    total_elements: int
    estimated_bytes: int | None
    axis: int
    recommended_chunk_size: int


@dataclass(frozen=True)
class ArrayChunk:
    index: int
    start: int
    stop: int
    data: Any


def profile_scientific_array(array: SliceableArray, axis: int = 0, memory_budget_bytes: int = 256 * MB) -> ScientificArrayProfile:
    """As many slices as fit the budget, at 8 bytes an element where its size is unknown."""
    shape = tuple(array.shape)
    if not -len(shape) <= axis < len(shape):
        raise ValueError("no such axis")
    axis %= len(shape)
    item, total = getattr(array.dtype, "itemsize", None), 1
    for n in shape:
        total *= n
    per = max(1, total // max(1, shape[axis])) * (item or 8)
    return ScientificArrayProfile(shape, str(array.dtype), item, total, total * item if item else None, axis, max(1, memory_budget_bytes // per))


def iter_array_chunks(array: SliceableArray, axis: int = 0, chunk_size: int | None = None, memory_budget_bytes: int = 256 * MB) -> Iterator[ArrayChunk]:
    p = profile_scientific_array(array, axis, memory_budget_bytes)
    step = chunk_size or p.recommended_chunk_size
    for k, start in enumerate(range(0, p.shape[p.axis], step)):
        stop = min(start + step, p.shape[p.axis])
        yield ArrayChunk(k, start, stop, array[tuple(slice(start, stop) if i == p.axis else slice(None) for i in range(len(p.shape)))])


def reduce_chunks(chunks: Iterable[ArrayChunk], reducer: Callable[[State, Any], State], initial: State) -> State:
    for c in chunks:
        initial = reducer(initial, c.data)
    return initial


def array_frame(spark: SparkSession, opener: Callable[[], SliceableArray], axis: int = 0, chunk_size: int = 1024) -> DataFrame:
    """(start, stop, values) of an array's slabs, flattened; each task opens the array and reads its own slabs."""
    import pandas as pd

    n = opener().shape[axis]
    starts = spark.range(0, n, chunk_size)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        a = opener()
        for p in parts:
            for s in p["id"]:
                stop = min(s + chunk_size, a.shape[axis])
                slab = a[tuple(slice(s, stop) if i == axis else slice(None) for i in range(len(a.shape)))]
                yield pd.DataFrame({"start": [s], "stop": [stop], "values": [np.asarray(slab, float).ravel()]})

    return starts.mapInPandas(run, "start long, stop long, values array<double>")


def _optional(module: str) -> Any:
    try:
        return importlib.import_module(module)
    except ModuleNotFoundError as e:
        raise ModuleNotFoundError(f"{module} is needed for this format and is not installed") from e


def open_hdf5(path: str, mode: str = "r", **options: Any) -> Any:
    return _optional("h5py").File(path, mode, **options)


def open_netcdf(path: str, mode: str = "r", **options: Any) -> Any:
    return _optional("netCDF4").Dataset(path, mode, **options)


def iter_hdf5_chunks(path: str, dataset: str, axis: int = 0, chunk_size: int | None = None, memory_budget_bytes: int = 256 * MB, **options: Any) -> Iterator[ArrayChunk]:
    with open_hdf5(path, **options) as f:
        yield from iter_array_chunks(f[dataset], axis, chunk_size, memory_budget_bytes)


def iter_netcdf_chunks(path: str, variable: str, axis: int = 0, chunk_size: int | None = None, memory_budget_bytes: int = 256 * MB, **options: Any) -> Iterator[ArrayChunk]:
    with open_netcdf(path, **options) as f:
        yield from iter_array_chunks(f.variables[variable], axis, chunk_size, memory_budget_bytes)
