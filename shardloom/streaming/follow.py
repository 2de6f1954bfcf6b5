"""Derived sets and evaluations that follow a source still growing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shardloom.operators.artifacts import eval_backlog
from shardloom.operators.trends import trend_table
from shardloom.operators.validation import resume_after_prefix
from shardloom.sources.files import list_folders


def _read_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    """Results of the batches that were committed; what a crashed batch has left is not looked at."""
    done = list_folders(path, "batch_id=*", holding="_SUCCESS")
    return spark.read.option("basePath", path).parquet(*done) if done else None


def derive_gap(
    source: DataFrame, derived: DataFrame | None, min_gap: int, source_complete: bool = False, key: str = "source_index"
) -> DataFrame | None:
    """What to derive now: the source rows without a result, once there are ``min_gap`` or the source is complete."""
    todo = source if derived is None else resume_after_prefix(source, derived, key)
    waiting = todo.count()
    return todo if waiting and (waiting >= min_gap or source_complete) else None


def follow_derive(
    source_stream: DataFrame, read_source: Callable[[], DataFrame], fn: Callable[[DataFrame], DataFrame], path: str,
    checkpoint: str, min_gap: int = 131_072, complete: Callable[[], bool] = lambda: False, key: str = "source_index",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run ``fn`` on the source rows not derived yet, whenever new source data leaves a large enough gap.

    The stream only wakes the job; what to do is decided from source and result, so a restart or a replayed
    batch continues where the finished results end. Each run writes its own folder under its batch id. A source can
    become complete without a new file: ``derive_rest`` then finishes what the gap left waiting.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = f"{path.rstrip('/')}/batch_id={batch_id}"
        done = _read_if_any(spark, path)
        if done is not None:
            # a replay must not count the rows it is about to overwrite
            done = done.where(F.col("batch_id") != batch_id)
        todo = derive_gap(read_source(), done, min_gap, complete(), key)
        if todo is not None:
            fn(todo).write.mode("overwrite").parquet(mine)

    writer = source_stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


#: Folder of what ``derive_rest`` writes; streams number their batches from 0.
REST_BATCH = -1


def derive_rest(
    read_source: Callable[[], DataFrame], fn: Callable[[DataFrame], DataFrame], path: str, key: str = "source_index"
) -> int:
    """Derive all rows of a complete source that no batch has derived yet; returns how many there were.

    Needs no arrival, so a poll or the end of a job can call it; a repeated call rewrites the same folder.
    """
    source = read_source()
    done = _read_if_any(source.sparkSession, path)
    if done is not None:
        done = done.where(F.col("batch_id") != REST_BATCH)
    todo = derive_gap(source, done, 1, True, key)
    if todo is None:
        return 0
    fn(todo).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={REST_BATCH}")
    return todo.count()


def follow_backlog(
    samples_stream: DataFrame, evaluate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, lo: int, hi: int,
    by: Sequence[str] = ("run",), trigger: dict | None = None, read_samples: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Evaluate every new sample set with a step in ``[lo, hi]``; the metrics table is the done marker.

    ``evaluate(samples)`` returns rows with the ``by`` columns, step, metrics_path, bytes and metrics. With
    ``read_samples``, each wake-up looks at all sets there are, so one whose evaluation failed (bytes 0) is tried again.
    """
    keys = [*by, "step"]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _read_if_any(spark, path)
        samples = batch if read_samples is None else read_samples()
        sets = samples.select(*keys).distinct()
        if done is None:
            todo = sets.where(F.col("step").between(lo, hi))
        else:
            done = done.where(F.col("batch_id") != batch_id)
            none_running = sets.limit(0)
            todo = eval_backlog(sets, done.select(*keys, "bytes"), none_running, lo, hi, by=by)
        evaluate(samples.join(todo, keys, "left_semi")).write.mode("overwrite").parquet(
            f"{path.rstrip('/')}/batch_id={batch_id}"
        )

    writer = samples_stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def backlog_trend(spark: SparkSession, path: str, by: Sequence[str] = ("run",)) -> DataFrame:
    """The trend over everything evaluated so far."""
    return trend_table(spark.read.parquet(path).drop("batch_id"), by)
