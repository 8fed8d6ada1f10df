"""Helpers of all operators: cut lineage, checked broadcasts, Arrow text access."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.sources.scratch import shared_folder as cluster_folder

REPOSITORY = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: A side up to this many bytes, measured on the written rows, is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 8 << 20
#: Arrays over text are built for about this many bytes at a time.
BLOCK_BYTES = 1 << 19
#: A task holds what it gathers from about this many bytes of text before it hands it on.
FLUSH_BYTES = 12 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python workers get this repository on their path, wherever the driver was started."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if REPOSITORY not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([REPOSITORY, *filter(None, paths)])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of its own only in local mode, as in tests."""
    folder, context = cluster_folder(spark), spark.sparkContext  # there is none on a cluster that names none
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="barlake-", dir=folder))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints that nothing refers to any more. It does so when the
    driver collects garbage, which a driver that holds little seldom does, while rounds go on to write."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bytes_of(df: DataFrame) -> int:
    """Size of the rows of a written `df`: lengths of texts, binaries and arrays, 8 bytes for others."""
    sizes = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(column), F.lit(0)) + 8)
        elif kind == "array<binary>":
            sizes.append(F.aggregate(F.coalesce(column, F.array()), F.lit(0), lambda n, x: n + F.octet_length(x) + 8))
        elif kind.startswith("array"):
            sizes.append(F.greatest(F.size(column), F.lit(0)) * 8 + 16)
        else:
            sizes.append(F.lit(8))
    row = df.agg(F.sum(sum(sizes, F.lit(0)).cast("long"))).first()
    return int(row[0] or 0)


def small_side(side: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`side` marked for broadcast if its measured size allows; else left to shuffle. `side` is written."""
    return F.broadcast(side) if bytes_of(side) <= limit else side


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = int(offsets[0]) if len(offsets) else 0
    return flat[low:int(offsets[-1]) if len(offsets) else 0], offsets - low


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES, most_rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text is a range of its own."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), first + most_rows, count)
        yield first, last
        first = last


def small_batches(batches: Iterator[pa.RecordBatch], at: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut where the texts or binaries of column `at` have about `most` bytes."""
    for batch in batches:
        for first, last in blocks(utf8(batch.column(at))[1], most):
            yield batch.slice(first, last - first)


def flushes(batches: Iterator[pa.RecordBatch], at: int, most: int = FLUSH_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """The rows of all batches in groups whose texts, column `at`, have about `most` bytes."""
    group, size = [], 0
    for batch in batches:
        _, offsets = utf8(batch.column(at))
        for first, last in blocks(offsets, most):
            group.append(batch.slice(first, last - first))
            size += int(offsets[last] - offsets[first])
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


def tidy(task):
    """`task`, which at its end hands the memory it has freed back to the machine: workers live longer
    than tasks, and those of earlier stages would hold it while later stages run."""
    def run(batches):
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
        if trim:
            trim(0)
    return run


def ints(column: pa.Array, null: int) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] for each range, empty ranges included."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]
