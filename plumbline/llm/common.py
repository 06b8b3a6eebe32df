"""What the operators share: tables, and the memory of Python workers."""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.shared import discard, materialize  # noqa: F401  the operators take them from here

WHITE = " \t\n\x0b\x0c\r"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's Arrow batches, unless they were set: 10,000 whole texts are too much for a worker's and a JVM's buffers."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(rows))


def give_back() -> None:
    """Ends a task in a Python worker: the worker stays for the next one, and what the task has freed would stay with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bounded(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and, but for single rows, about `size` bytes; then `give_back`."""
    for batch in batches:
        least = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, least):
            yield batch.slice(at, least)
    give_back()
