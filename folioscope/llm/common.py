"""What the operators of this subpackage share: tables, shared storage, Arrow columns."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table of the corpus; extra columns of the file stay unread."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset a local master, as in tests, gets
    a folder of its own; a cluster, whose machines share no such folder, gets an error."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    context = spark.sparkContext
    if (there := context._jsc.sc().getCheckpointDir()).isDefined():
        return there.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


class Workspace:
    """Written tables of one run, in the shared folder, so that no executor's loss costs them."""

    #: Every workspace of this driver whose tables haven't been deleted, in the order they were made.
    kept: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept.append(self)

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` once and returns it as read back: lineage ends here."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Deletes all tables, once what was made of them is written elsewhere."""
        self.drop("")
        self.kept.remove(self)


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: it keeps its own ways
        return None


def trim() -> None:
    """Gives the memory that a batch's arrays held back to the system, so that reused Python workers stay small."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


#: Bytes of text that a task works on at once.
SLICE = 1 << 23


def slices(batches: Iterator[pa.RecordBatch], text: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut, without copying, into runs of rows with at most ``size`` bytes in the column ``text``; a longer row comes alone.

    So that what an operator makes of a batch follows bytes, not rows.
    """
    for batch in batches:
        for start, n in parts(batch.column(text), size):
            yield batch.slice(start, n)


def parts(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, number) with at most ``size`` bytes; one of no rows for an empty column."""
    if not len(column):
        yield 0, 0
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = column.buffers()[1]
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if offsets is not None else np.zeros(len(column) + 1, np.int32)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, int(at[row]) + size, "right")) - 1)
        yield row, end - row
        row = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at
