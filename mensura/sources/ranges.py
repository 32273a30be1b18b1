"""Sources read by ranges: blocks of bytes of files of any size, and slabs of arrays saved as .npy.

Both are Python data sources: the driver lists files and their sizes, a task gets a range, and reads it piece
by piece, so no row and no task holds more than it is allowed.  Paths go through Arrow's file systems, local or remote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mensura.operators.common import Names, names
from mensura.sources.files import MB


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_under(path: str, suffix: str = "") -> list[fs.FileInfo]:
    """The file at path, or the files under the folder at path, by name; hidden ones and those that begin with _ aren't data."""
    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.base_name.endswith(suffix)), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.start, self.stop))


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.block = int(options.get("block_size", 8 * MB))
        self.range = max(1, int(options.get("range_size", 128 * MB)) // self.block)
        if self.block < 1:
            raise ValueError("block_size must be positive")

    def partitions(self) -> list[Range]:
        out = []
        for f in files_under(self.root):
            blocks = -(-f.size // self.block)
            out += [Range(f.path, a, min(a + self.range, blocks)) for a in range(0, blocks, self.range)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.start == partition.stop:
            return
        with _opened(self.root)[0].open_input_file(partition.path) as f:
            f.seek(partition.start * self.block)
            for i in range(partition.start, partition.stop):
                yield partition.path, i, f.read(self.block)


class ByteBlocks(DataSource):
    """(path, block, bytes): options path, block_size, and range_size, the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "byte_blocks"

    def schema(self) -> str:
        return "path string, block long, bytes binary"

    def reader(self, schema: Any) -> DataSourceReader:
        return _BlockReader(self.options)


class _SlabReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.budget = int(options.get("memory_budget", 256 * MB))
        self.rows = int(options.get("rows", 0))

    def layout(self, path: str) -> tuple[int, tuple[int, ...], np.dtype]:
        """Where the numbers of a file begin, its shape and kind."""
        with _opened(self.root)[0].open_input_file(path) as f:
            version = np.lib.format.read_magic(f)
            shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if by_column or kind.hasobject or not shape:
                raise ValueError(f"{path}: rows of numbers are needed")
            return f.tell(), shape, kind

    def step(self, shape: tuple[int, ...], kind: np.dtype) -> int:
        """Rows of a slab: what the budget holds as doubles, at least one, at most what was asked for."""
        most = max(1, self.budget // max(1, 8 * int(np.prod(shape[1:], dtype=np.int64))))
        return min(most, self.rows) if self.rows else most

    def partitions(self) -> list[Range]:
        out = []
        for f in files_under(self.root, ".npy"):
            _, shape, kind = self.layout(f.path)
            step = self.step(shape, kind)
            out += [Range(f.path, a, min(a + step, shape[0])) for a in range(0, shape[0], step)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.start == partition.stop:
            return
        at, shape, kind = self.layout(partition.path)
        width = int(np.prod(shape[1:], dtype=np.int64))
        with _opened(self.root)[0].open_input_file(partition.path) as f:
            f.seek(at + partition.start * width * kind.itemsize)
            numbers = np.frombuffer(f.read((partition.stop - partition.start) * width * kind.itemsize), kind).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([partition.start]), pa.array([partition.stop]), pa.array([width]), pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), pa.array(numbers))], ["path", "start", "stop", "width", "values"])


class ArraySlabs(DataSource):
    """(path, start, stop, width, values): options path, memory_budget in bytes and rows, both limits of a slab."""

    @classmethod
    def name(cls) -> str:
        return "array_slabs"

    def schema(self) -> str:
        return "path string, start long, stop long, width long, values array<double>"

    def reader(self, schema: Any) -> DataSourceReader:
        return _SlabReader(self.options)


def byte_blocks(spark: SparkSession, path: str, block_size: int = 8 * MB, range_size: int = 128 * MB) -> DataFrame:
    """Blocks of a file, or of the files in a folder.  A block is the memory of a row, a range the work of a task; empty files have no block."""
    spark.dataSource.register(ByteBlocks)
    return spark.read.format("byte_blocks").option("path", path).option("block_size", block_size).option("range_size", range_size).load()


def array_slabs(spark: SparkSession, path: str, memory_budget: int = 256 * MB, rows: int = 0) -> DataFrame:
    """Slabs along the first axis of .npy files; a slab's numbers, as doubles, fit the budget unless one row doesn't."""
    spark.dataSource.register(ArraySlabs)
    return spark.read.format("array_slabs").option("path", path).option("memory_budget", memory_budget).option("rows", rows).load()


def save_arrays(df: DataFrame, path: str, values: str, order: Names, by: str, kind: str = "float32") -> DataFrame:
    """One .npy file of rows for each value of by (a number), written side by side; (file, rows).

    A file is written beside its place and then moved there, so a task that runs again leaves a whole one.
    """
    along = names(order)

    def save(part: pd.DataFrame) -> pd.DataFrame:
        system, root = _opened(path)
        system.create_dir(root, recursive=True)
        part = part.sort_values(along)
        n = int(part[by].iloc[0])
        at = f"{root}/rows-{n:08d}"
        with system.open_output_stream(at + ".part") as f:
            np.lib.format.write_array(_Sink(f), np.ascontiguousarray(np.stack(part[values].to_numpy()), dtype=kind), allow_pickle=False)
        system.move(at + ".part", at + ".npy")
        return pd.DataFrame({"file": [n], "rows": [len(part)]})

    return df.select(F.col(by).cast("long").alias(by), *along, values).groupBy(by).applyInPandas(save, "file long, rows long")


class _Sink:
    """A stream that takes bytes, for numpy's writer."""

    def __init__(self, stream: Any):
        self.stream = stream

    def write(self, data: Any) -> int:
        self.stream.write(bytes(data))
        return len(data)
