"""What the text operators share: sessions, shared storage and Arrow blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import shared_dir, spent, stored

__all__ = ["BATCH_BYTES", "BLOCK_BYTES", "blocks", "documents", "let", "shared_dir", "small_batches", "spent", "stored", "task_count", "utf8_rows"]

#: Bytes of text that one numpy pass works on; longer single texts form a block of their own.
BLOCK_BYTES = 1 << 18
#: Bytes of the Arrow batches that pass between executors and Python; both hold some at once, and as much again while they grow.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by ``BATCH_BYTES``: 10,000 whole texts are much more than a numpy pass needs."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    with_unit = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(name).lower())
    now = int(with_unit[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[with_unit[2]] if with_unit else 0
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def task_count(spark: SparkSession, size: int, task_bytes: int, most: int = 50_000) -> int:
    """Tasks for ``size`` bytes: one for each ``task_bytes``, but no fewer than there are cores, and ``most`` at most.

    A shuffle's blocks grow with the square of its tasks, so beyond ``most`` tasks grow instead; they stream their rows.
    """
    return max(1, min(most, max(spark.sparkContext.defaultParallelism, -(-size // task_bytes))))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf8_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    if not len(column):
        return
    data, offsets = utf8_rows(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
