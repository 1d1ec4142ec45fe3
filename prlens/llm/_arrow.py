"""Helpers shared by the operators that work on Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that the JVM hands to Python at once; a batch's memory is this many texts.
BATCH_ROWS = 512


#: Bytes of a batch; Spark closes a batch once it has this much.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of this session by ``rows`` and ``BATCH_BYTES`` (documents may be very long)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that the cluster shares (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine, as in tests, a local default is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a table in the shared folder, read again: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`written` made, once all that was derived from it is written itself."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a table of a few numbers each that is broadcast; about 64 MB.
FITTING_ROWS = 1_000_000


def fitting(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it is small; else the join shuffles."""
    return F.broadcast(table) if table.count() <= FITTING_ROWS else table


def clean_memory(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of queries that have ended: a first collection frees their plans, a second their shuffles."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or buffers[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def packs(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of the batch with at most ``limit`` bytes of text (or one longer row), with bytes and offsets."""
    data, offsets = texts_of(batch.column(text))
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield slice(i, j), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
