"""Statistics, moments and alerts kept up to date batch by batch.

Each micro-batch leaves its mergeable partials under its own ``batch_id``; replaying a batch overwrites the
same folder, so a restart neither loses nor doubles anything. Readers merge the partials.

Where a merge is given, finished batches are compacted into one folder ``upto=n`` now and then, so neither the folders nor the
work of a reader grow with the age of the stream. A batch is merged only after its successor has begun, when it can no longer
be replayed. Folders that were merged are removed one compaction later, so a reader that has listed them can finish.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shardloom.operators.moments import finalize_moments, gram_partials, vector_sums
from shardloom.operators.stats import finalize_channels, finalize_global, merge_stats, tensor_partials
from shardloom.session import require
from shardloom.sources.files import list_folders, remove_folder
from shardloom.spec import DatasetSpec

#: Finished batches that are left unmerged before a compaction.
COMPACT_EVERY = 32


def committed(path: str, kind: str) -> list[int]:
    """Numbers of the finished folders ``kind=n``."""
    return sorted(int(f.rsplit("=", 1)[1]) for f in list_folders(path, f"{kind}=*", holding="_SUCCESS"))


def read_partials(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Partials of all batches (up to number ``last``), each once, with the batch they stand at in ``at``."""
    path = path.rstrip("/")
    bases = [n for n in committed(path, "upto") if last is None or n <= last]
    batches = [n for n in committed(path, "batch_id") if n > (bases[-1] if bases else -1) and (last is None or n <= last)]
    require(bool(bases or batches), f"no finished batch in {path}")
    parts = [spark.read.parquet(f"{path}/upto={bases[-1]}").withColumn("at", F.lit(bases[-1]).cast("bigint"))] if bases else []
    if batches:
        rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch_id={n}" for n in batches])
        parts.append(rows.withColumn("at", F.col("batch_id").cast("bigint")).drop("batch_id"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact(spark: SparkSession, path: str, last: int, merge: Callable[[DataFrame, int], DataFrame]) -> None:
    """Merge the batches up to ``last`` into one folder and remove what the compaction before had merged."""
    path = path.rstrip("/")
    bases = committed(path, "upto")
    if last not in bases:
        merge(read_partials(spark, path, last), last).write.mode("overwrite").parquet(f"{path}/upto={last}")
    older = [n for n in bases if n < last]
    if older:
        for kind, gone in (("batch_id", [n for n in committed(path, "batch_id") if n <= older[-1]]), ("upto", older[:-1])):
            for n in gone:
                remove_folder(f"{path}/{kind}={n}")


def keep_partials(
    stream: DataFrame, fold: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
    trigger: dict | None = None, merge: Callable[[DataFrame, int], DataFrame] | None = None, every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Write ``fold(batch)`` to ``path/batch_id=n`` for every micro-batch.

    ``merge(partials, n)`` gives the partials that stand for all batches up to n; it is called after each ``every`` batches.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        base = max(committed(path, "upto"), default=-1) if merge else -1
        require(batch_id > base, f"batch {batch_id} was merged already: {path} belongs to another checkpoint")
        fold(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
        if merge and batch_id - base > every:
            compact(batch.sparkSession, path, batch_id - 1, merge)

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_stats(
    stream: DataFrame, spec: DatasetSpec, path: str, checkpoint: str, by: Sequence[str] = (), tensor: str = "tensor",
    trigger: dict | None = None, every: int = COMPACT_EVERY,
) -> StreamingQuery:
    def fold(batch: DataFrame) -> DataFrame:
        return merge_stats(tensor_partials(batch, spec, by, tensor), by)

    return keep_partials(stream, fold, path, checkpoint, trigger, lambda partials, _: merge_stats(partials, by), every)


def read_stats(spark: SparkSession, path: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Global and per-channel statistics over all batches so far."""
    merged = merge_stats(read_partials(spark, path), by)
    return finalize_global(merged, by), finalize_channels(merged, by)


def stream_moments(
    stream: DataFrame, width: int, path: str, checkpoint: str, by: Sequence[str] = (), features: str = "features",
    pilot: Sequence[float] | None = None, trigger: dict | None = None, every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Gram partials around a fixed ``pilot`` (zeros by default; pass the same one to ``read_moments``)."""
    shift = np.zeros(width) if pilot is None else np.asarray(pilot, dtype=np.float64)

    def fold(batch: DataFrame) -> DataFrame:
        return vector_sums(gram_partials(batch, features, width, by, shift), [*by, "chunk"], "cells")

    def merge(partials: DataFrame, _: int) -> DataFrame:
        return vector_sums(partials, [*by, "chunk"], "cells")

    return keep_partials(stream, fold, path, checkpoint, trigger, merge, every)


def read_moments(
    spark: SparkSession, path: str, width: int, by: Sequence[str] = (), pilot: Sequence[float] | None = None
) -> DataFrame:
    shift = np.zeros(width) if pilot is None else np.asarray(pilot, dtype=np.float64)
    sums = vector_sums(read_partials(spark, path), [*by, "chunk"], "cells")
    return finalize_moments(sums, by, shift)
