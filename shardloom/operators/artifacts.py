"""Checkpoints, pending evaluations and growing files. These report; nothing is deleted or run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shardloom.functions.ordering import last_before, last_rows, range_bucket
from shardloom.functions.parsing import checkpoint_step


def latest_checkpoint(files: DataFrame, by: Sequence[str] = (), name: str = "name") -> DataFrame:
    """Newest checkpoint by the step in its name; names without one count as -1."""
    stepped = files.withColumn("step", checkpoint_step(F.col(name)))
    return stepped.groupBy(*by).agg(
        F.max("step").alias("step"), F.max_by(name, F.struct("step", name)).alias(name)
    )


def retention(
    files: DataFrame, keep_last: int, archive_every: int | None = None, protect: Sequence[int] = (),
    by: Sequence[str] = (), name: str = "name",
) -> DataFrame:
    """Adds ``keep`` and ``reason``: newest k (all when k <= 0), archive multiples, protected steps."""
    stepped = files.withColumn("step", checkpoint_step(F.col(name)))
    if keep_last > 0:
        newest = last_rows(stepped, by, "step", keep_last, name).select(*by, name, F.lit(True).alias("__new"))
        stepped = stepped.join(newest, [*by, name], "left")
    else:
        stepped = stepped.withColumn("__new", F.lit(True))
    archived = F.lit(False) if not archive_every else (F.col("step") >= 0) & (F.col("step") % archive_every == 0)
    reason = (
        F.when(F.col("__new"), "newest")
        .when(F.col("step").isin([int(p) for p in protect]) if protect else F.lit(False), "protected")
        .when(archived, "archive")
    )
    return stepped.withColumn("reason", reason).withColumn("keep", F.col("reason").isNotNull()).drop("__new")


def eval_backlog(
    samples: DataFrame, metrics: DataFrame, running: DataFrame, lo: int, hi: int, done: DataFrame | None = None,
    by: Sequence[str] = ("run",),
) -> DataFrame:
    """Sample sets with a step in ``[lo, hi]`` and no non-empty metric file, done marker or running marker."""
    keys = [*by, "step"]
    left = samples.where(F.col("step").between(lo, hi))
    left = left.join(metrics.where(F.col("bytes") > 0).select(*keys), keys, "left_anti")
    left = left.join(running.select(*keys), keys, "left_anti")
    return left if done is None else left.join(done.select(*keys), keys, "left_anti")


def stable_files(
    observations: DataFrame, min_bytes: int = 10**9, by: Sequence[str] = ("cache", "name"), time: str = "observed_at",
    tmp_suffix: str = ".tmp",
) -> DataFrame:
    """Per observation ``ready``: same size as the one before, above ``min_bytes``, and no temporary twin."""
    by = list(by)
    plain = observations.where(~F.endswith(F.col("name"), F.lit(tmp_suffix)))
    rows = last_before(plain, [time], range_bucket(plain, time), F.col("bytes"), by, "previous_bytes")
    twins = (
        observations.where(F.endswith(F.col("name"), F.lit(tmp_suffix)))
        .withColumn("name", F.expr(f"substring(name, 1, length(name) - {len(tmp_suffix)})"))
        .select(*by).distinct().withColumn("__twin", F.lit(True))
    )
    ready = (F.col("previous_bytes") == F.col("bytes")) & (F.col("bytes") > min_bytes) & F.col("__twin").isNull()
    return rows.join(twins, by, "left").withColumn("ready", F.coalesce(ready, F.lit(False))).drop("__twin")
