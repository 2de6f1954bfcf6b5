"""Progress, metric trends and comparisons between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shardloom.functions.ordering import last_before, range_bucket
from shardloom.functions.parsing import compact_utc


def progress_eta(progress: DataFrame, by: Sequence[str] = ("job",), time: str = "time_utc") -> DataFrame:
    """Rates, remaining work and finish time at each progress row.

    ``progress``: by..., time_utc, done, target, elapsed_sec. The interval rate compares with the row before.
    """
    seconds = F.unix_micros(time) / 1e6
    rows = last_before(
        progress, [time, "done"], range_bucket(progress, time), F.struct(seconds.alias("t"), F.col("done").alias("d")),
        by, "__prev",
    )
    rows = rows.withColumn("remaining", F.greatest(F.col("target") - F.col("done"), F.lit(0)))
    rows = rows.withColumn("avg_rate", F.when(F.col("elapsed_sec") > 0, F.col("done") / F.col("elapsed_sec")))
    gap = seconds - F.col("__prev.t")
    rows = rows.withColumn("interval_rate", F.when(gap > 0, (F.col("done") - F.col("__prev.d")) / gap))
    eta = F.when(F.col("avg_rate") > 0, F.col("remaining") / F.col("avg_rate"))
    rows = rows.withColumn("eta_sec", eta).withColumn("eta_hms", hms(F.col("eta_sec")))
    finish = F.timestamp_micros(F.unix_micros(time) + (F.floor("eta_sec") * 1_000_000))
    return rows.withColumn("finish_utc", compact_utc(finish)).drop("__prev")


def hms(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.when(
        seconds.isNotNull(),
        F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor((whole % 3600) / 60), whole % 60),
    )


def trend_table(
    docs: DataFrame, by: Sequence[str] = (), canonical: str = "/inception_eval/", smoke: str = "smoke",
    path: str = "metrics_path",
) -> DataFrame:
    """One document per step: non-smoke before smoke, then the canonical folder, then path order."""
    preference = F.struct(
        F.contains(F.col(path), F.lit(smoke)).alias("smoke"), (~F.contains(F.col(path), F.lit(canonical))).alias("other"),
        F.col(path),
    )
    rest = [c for c in docs.columns if c not in (*by, "step")]
    best = docs.groupBy(*by, "step").agg(F.min_by(F.struct(*rest), preference).alias("__row"))
    return best.select(*by, "step", "__row.*")


def anchor_deltas(
    trend: DataFrame, anchors: Sequence[int], value: str = "fid", by: Sequence[str] = ("run",)
) -> DataFrame:
    """Change from the previous anchor that has a value; anchors without one stay as rows.

    A run has as many rows here as there are anchors.
    """
    by = list(by)
    wanted = trend.select(*by).distinct().withColumn("step", F.explode(F.array(*[F.lit(int(a)).cast("bigint") for a in anchors])))
    rows = wanted.join(trend.select(*by, "step", value), [*by, "step"], "left")
    w = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(value).isNotNull(), F.struct("step", value))
    rows = rows.withColumn("__prev", F.last(known, ignorenulls=True).over(w))
    before = F.col(f"__prev.{value}")
    delta = F.col(value) - before
    return rows.select(
        *by, "step", value, F.col("__prev.step").alias("previous_step"), delta.alias("delta"),
        F.when(before != 0, 100.0 * delta / before).alias("delta_pct"),
        (1000.0 * delta / (F.col("step") - F.col("__prev.step"))).alias("delta_per_1k_steps"),
        F.when(F.col(value).isNull(), "missing").otherwise("ok").alias("status"),
    )


def equal_budget_compare(
    a: DataFrame, b: DataFrame, batch_a: int, batch_b: int, dataset_size: int, value: str = "fid",
    by: Sequence[str] = (),
) -> DataFrame:
    """Every row of ``a`` against ``b`` at the same number of processed samples.

    An exact match is used where there is one, else the nearest ``b`` row below; ``match`` says which.
    """
    by = list(by)
    left = a.select(
        *by, F.col("step").cast("bigint"), F.col(value).cast("double").alias("__a"),
        (F.col("step") * batch_a).cast("bigint").alias("processed"), F.lit(1).alias("__side"),
        F.lit(None).cast("struct<at:bigint,step:bigint,v:double>").alias("__b"),
    )
    processed_b = (F.col("step") * batch_b).cast("bigint")
    right = b.select(
        *by, F.col("step").cast("bigint"), F.lit(None).cast("double").alias("__a"), processed_b.alias("processed"),
        F.lit(0).alias("__side"),
        F.struct(processed_b.alias("at"), F.col("step").cast("bigint").alias("step"), F.col(value).cast("double").alias("v")).alias("__b"),
    )
    both = left.unionByName(right)
    # b sorts before a at the same point, so an exact match is the nearest one
    matched = last_before(
        both, ["processed", "__side", "step"], range_bucket(both, "processed"), F.col("__b"), by, "__hit", inclusive=True
    ).where(F.col("__side") == 1)
    return matched.select(
        *by, "step", "processed", (F.col("processed") / F.lit(float(batch_b))).alias("equivalent_step"),
        (F.col("processed") / F.lit(float(dataset_size))).alias("epochs"), F.col("__a").alias("value_a"),
        F.col("__hit.v").alias("value_b"), F.col("__hit.step").alias("step_b"),
        (F.col("__a") - F.col("__hit.v")).alias("difference"),
        F.when(F.col("__hit").isNull(), "none").when(F.col("__hit.at") == F.col("processed"), "exact")
        .otherwise("nearest_below").alias("match"),
    )
