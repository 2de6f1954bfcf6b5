"""Memory of Python workers, which outlive their tasks: what a task has freed goes back to the system when it ends."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
from pyspark.sql import SparkSession


#: Rows of an Arrow batch of texts, where the session keeps Spark's default of 10,000: rows here are whole documents.
BATCH_ROWS = 1_500


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def forget_encoders() -> None:
    """Drops the encoder that tokenizing tasks leave for the next ones."""
    if library := sys.modules.get("tokenizers"):
        vars(library).pop("_kept_encoders", None)


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def batches(run, keep_encoders: bool = False):
    """``run`` for mapInArrow, with a worker that is lean before and after."""

    def lean(it):
        if not keep_encoders:
            forget_encoders()
        try:
            yield from run(it)
        finally:
            release()

    return lean


def group(run):
    """The same for applyInArrow."""

    def lean(table: pa.Table) -> pa.Table:
        forget_encoders()
        try:
            return run(table)
        finally:
            release()

    return lean
