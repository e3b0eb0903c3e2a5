"""Scratch tables in the shared folder, file access from executors, and bounded text batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shared import scratch, shared_root, written

__all__ = ["delete", "filesystem", "forget", "release", "scratch", "shared_root", "slices", "trim", "worker_memo", "written"]

#: Rows of text handed to Python code at a time; one row of any length still forms a batch.
SLICE_ROWS = 256

_MEMOS: list[dict] = []


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that nothing reads any more."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(table: DataFrame) -> None:
    """Remove a table that ``written`` gave and that nothing reads any more."""
    for path in {unquote(f).rpartition("/")[0] for f in table.inputFiles()}:
        delete(table.sparkSession, path)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI; works on the driver and on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def worker_memo(memo: dict) -> dict:
    """``memo``, which a worker keeps from task to task until it gets a task of an operator that doesn't use it."""
    _MEMOS.append(memo)
    return memo


def release(*used: dict) -> None:
    """Empty every memo but those in use: a worker serves one operator after another, and would hold what all of them keep."""
    others = [memo for memo in _MEMOS if memo and not any(memo is u for u in used)]
    for memo in others:
        memo.clear()
    if others:
        trim()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, memos: tuple[dict, ...] = ()) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows, so that Python holds few texts at a time; after the last, memory goes back.

    ``memos`` are the worker's memos that the task uses; all others go before the first batch.
    """
    release(*memos)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()


def trim() -> None:
    """Give freed memory back to the system: workers are reused, and what one task freed is no use to the next one's neighbours."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)
