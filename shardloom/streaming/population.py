"""Moments of a generated population that is renewed batch by batch: decayed averages, or the newest N rows exactly.

Both follow a stream of feature rows and can be compared with a reference at any time (``distances.frechet``). A replayed batch
overwrites its own folder; merged or expired batches are removed, so what is kept does not grow with the age of the stream.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shardloom.functions.ordering import range_bucket, running_before
from shardloom.operators.moments import finalize_moments, gram_partials, vector_sums
from shardloom.session import require
from shardloom.sources.files import remove_folder
from shardloom.streaming.incremental import COMPACT_EVERY, committed, keep_partials, read_partials


def _shift(width: int, pilot: Sequence[float] | None) -> np.ndarray:
    return np.zeros(width) if pilot is None else np.asarray(pilot, dtype=np.float64)


def _decayed(partials: DataFrame, at: int, decay: float, by: Sequence[str]) -> DataFrame:
    """Sums of the partials with the weights they have at batch ``at``."""
    weight = F.pow(F.lit(decay), F.lit(at) - F.col("at"))
    scaled = partials.withColumn("cells", F.transform("cells", lambda c: c * weight))
    return vector_sums(scaled, [*by, "chunk"], "cells")


def stream_decayed(
    stream: DataFrame, width: int, path: str, checkpoint: str, decay: float, by: Sequence[str] = (), features: str = "features",
    pilot: Sequence[float] | None = None, trigger: dict | None = None, every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Keep what ``read_decayed`` needs; a batch's rows weigh ``decay`` times as much with every later batch."""
    require(0 < decay <= 1, "the decay must be above 0 and at most 1")
    shift = _shift(width, pilot)

    def fold(batch: DataFrame) -> DataFrame:
        return vector_sums(gram_partials(batch, features, width, by, shift), [*by, "chunk"], "cells")

    return keep_partials(stream, fold, path, checkpoint, trigger, lambda partials, at: _decayed(partials, at, decay, by), every)


def read_decayed(
    spark: SparkSession, path: str, width: int, decay: float, by: Sequence[str] = (), pilot: Sequence[float] | None = None
) -> DataFrame:
    """``by..., i, n, mu, sigma, weight``: weighted moments as of the newest batch, the covariance divided by the weight."""
    newest = max(committed(path, "batch_id") + committed(path, "upto"), default=None)
    require(newest is not None, f"no finished batch in {path}")
    sums = _decayed(read_partials(spark, path), newest, decay, by)
    return finalize_moments(sums, by, _shift(width, pilot), weighted=True)


def _window(sizes: list[tuple[int, int]], last: int) -> tuple[list[int], int | None, int]:
    """Batches that lie in the newest ``last`` rows as a whole, the one that does in part, and how many of its rows do."""
    whole, left = [], last
    for batch, n in sorted(sizes, reverse=True):
        if n > left:
            return whole, (batch if left else None), left
        whole.append(batch)
        left -= n
    return whole, None, 0


def _sizes(spark: SparkSession, path: str, width: int, batches: list[int]) -> list[tuple[int, int]]:
    """Rows of each batch, from the last cell of its sums."""
    if not batches:
        return []
    sums = spark.read.option("basePath", f"{path}/sums").parquet(*[f"{path}/sums/batch_id={b}" for b in batches])
    last = sums.groupBy("batch_id").agg(F.max_by(F.element_at("cells", -1), "chunk").alias("n"))
    counts = {r["batch_id"]: round(r["n"]) for r in last.collect()}  # one row per kept batch
    return [(b, counts.get(b, 0)) for b in batches]


def stream_newest(
    stream: DataFrame, width: int, path: str, checkpoint: str, last: int, index: str = "global_index", features: str = "features",
    pilot: Sequence[float] | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the rows and sums of the batches that hold the newest ``last`` rows, and of one batch more for running readers.

    Rows are as new as their batch, and within it by ``index``.
    """
    require(last >= 1, "at least one row must be kept")
    path, shift = path.rstrip("/"), _shift(width, pilot)

    def save(batch: DataFrame, batch_id: int) -> None:
        mine = f"batch_id={batch_id}"
        spark = batch.sparkSession
        batch.select(F.col(index).cast("bigint").alias("id"), F.col(features).alias("f")).write.mode("overwrite").parquet(f"{path}/rows/{mine}")
        rows = spark.read.parquet(f"{path}/rows/{mine}")
        sums = vector_sums(gram_partials(rows, "f", width, (), shift), ["chunk"], "cells")
        sums.write.mode("overwrite").parquet(f"{path}/sums/{mine}")  # the batch counts from here on
        before = [b for b in committed(f"{path}/sums", "batch_id") if b < batch_id]
        whole, part, _ = _window(_sizes(spark, path, width, before), last)
        kept = {*whole, part}
        for b in before:
            if b not in kept:
                remove_folder(f"{path}/sums/batch_id={b}")
                remove_folder(f"{path}/rows/batch_id={b}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_newest(
    spark: SparkSession, path: str, width: int, last: int, pilot: Sequence[float] | None = None, since: int = 0, strict: bool = True
) -> DataFrame:
    """``i, n, mu, sigma`` of exactly the newest ``last`` rows, or of all if there are fewer; batches before number ``since``
    are left out (a reset after a warm-up). Only the rows of the oldest batch needed are read again."""
    path, shift = path.rstrip("/"), _shift(width, pilot)
    batches = [b for b in committed(f"{path}/sums", "batch_id") if b >= since]
    whole, part, tail = _window(_sizes(spark, path, width, batches), last)
    require(bool(whole) or part is not None, f"no rows in {path}")
    parts = []
    if whole:
        parts.append(spark.read.parquet(*[f"{path}/sums/batch_id={b}" for b in whole]).select("chunk", "cells"))
    if part is not None:
        rows = spark.read.parquet(f"{path}/rows/batch_id={part}")
        placed = running_before(rows, ["id"], range_bucket(rows, "id"), name="__ahead")
        newest = placed.where(F.col("__ahead") >= rows.count() - tail)
        parts.append(gram_partials(newest, "f", width, (), shift))
    sums = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return finalize_moments(vector_sums(sums, ["chunk"], "cells"), (), shift, strict)
