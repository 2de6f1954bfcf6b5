"""Source parquet with a position, and feature banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shardloom.functions.ordering import ordered_bucket, running_before
from shardloom.session import broadcast_if_small


def read_source_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Rows of parquet files in name order with their position as ``source_index``.

    Rows per file come from a count over metadata; the prefix sum of those few rows gives each file's start.
    """
    rows = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias("__row")
    )
    per_file = rows.groupBy("source_file").agg(F.count("*").alias("__n"))
    starts = running_before(
        per_file, ["source_file"], ordered_bucket(per_file, "source_file"), F.col("__n"), name="__start"
    ).drop("__n")
    return rows.join(broadcast_if_small(starts), "source_file").withColumn("source_index", F.col("__start") + F.col("__row")).drop(
        "__start", "__row"
    )


def read_feature_table(spark: SparkSession, path: str, max_ref: int | None = None, index: str = "global_index") -> DataFrame:
    """A stored feature table (``global_index``, ``features`` and any further columns), cut as a bank if asked."""
    return feature_bank(spark.read.parquet(path), max_ref, index)


def feature_bank(df: DataFrame, max_ref: int | None = None, index: str = "global_index") -> DataFrame:
    """The first ``max_ref`` rows in index order; ``truncated_to_max_ref`` is set only when rows were left out.

    Indexes may have gaps; rows that share one with the last row kept come along.
    """
    if max_ref is None:
        return df.withColumn("truncated_to_max_ref", F.lit(None).cast("bigint"))
    # a top-n of the index column alone: tasks keep their own first rows before these meet
    last = df.select(index).orderBy(index).limit(max_ref).agg(F.max(index)).first()[0] if max_ref else None
    kept = df.where(F.col(index) <= F.lit(last)) if last is not None else df.limit(0)
    cut = last is not None and df.where(F.col(index) > F.lit(last)).limit(1).count() > 0
    return kept.withColumn(
        "truncated_to_max_ref", F.lit(max_ref if cut else None).cast("bigint")
    )
