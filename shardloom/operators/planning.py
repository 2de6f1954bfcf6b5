"""Capacity, stage shares and configuration choice from benchmark rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from shardloom.functions.joins import join_groups


def capacity_plan(
    bench: DataFrame, targets: Mapping[str, int], bytes_per_sample: float, overhead_hours: float = 0.0,
    shard_size: int = 4096, rate: str = "total_rate",
) -> DataFrame:
    """Hours, storage and shard count of every target set under every benchmarked configuration."""
    options = F.array(*[F.struct(F.lit(k).alias("target"), F.lit(int(n)).cast("bigint").alias("samples")) for k, n in targets.items()])
    rows = bench.withColumn("__t", F.explode(options)).select("*", "__t.target", "__t.samples").drop("__t")
    size = F.col("samples") * F.lit(float(bytes_per_sample))
    return (
        rows.withColumn("hours", F.when(F.col(rate) > 0, F.col("samples") / F.col(rate) / 3600.0 + overhead_hours))
        .withColumn("gb", size / 1e9)
        .withColumn("gib", size / float(2**30))
        .withColumn("shards", F.ceil(F.col("samples") / shard_size))
    )


def stage_breakdown(runs: DataFrame, stages: Sequence[str] = ("encode_sec", "copy_sec", "save_sec")) -> DataFrame:
    """Share of wall time per stage and of the rest, encode-only rate, and what bounds the run."""
    wall = F.col("elapsed_sec")
    known = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages), F.lit(0.0))
    rows = runs.withColumn("rest_sec", F.greatest(wall - known, F.lit(0.0)))
    for s in [*stages, "rest_sec"]:
        rows = rows.withColumn(s.replace("_sec", "_share"), F.when(wall > 0, F.col(s) / wall))
    rows = rows.withColumn("encode_rate", F.when(F.col("encode_sec") > 0, F.col("encoded") / F.col("encode_sec")))
    bound = F.when(F.col("rest_share") > F.col("encode_share"), "input_preprocess_bound_not_gpu_bound")
    return rows.withColumn("bound_by", bound.otherwise("gpu_bound"))


def pick_config(bench: DataFrame, by: Sequence[str] = (), rate: str = "total_rate") -> DataFrame:
    """Marks the best throughput among PASS rows; failed rows stay in the table."""
    passed = F.upper("status") == "PASS"
    best = bench.where(passed).groupBy(*by).agg(
        F.max_by(F.struct("config", "batch"), F.struct(F.col(rate), -F.col("batch"), "config")).alias("__best")
    )
    joined = join_groups(bench, best, by, "left")
    chosen = passed & (F.struct("config", "batch") == F.col("__best"))
    return joined.withColumn("chosen", F.coalesce(chosen, F.lit(False))).drop("__best")
