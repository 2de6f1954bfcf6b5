"""Sharded parquet tables: staged, checked, then published by moving a pointer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shardloom.operators.validation import digest_columns, row_hash
from shardloom.session import require
from shardloom.sources.files import open_fs

POINTER = "_current"


def publish_table(
    df: DataFrame, path: str, check: Callable[[DataFrame], None], partition_by: str | None = None
) -> str:
    """Write a new version below ``path``, run ``check`` on what was written, then point readers to it."""
    version = f"v-{uuid.uuid4().hex}"
    target = f"{path.rstrip('/')}/{version}"
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(target)
    check(df.sparkSession.read.parquet(target))
    fs, root = open_fs(path.rstrip("/"))
    with fs.open_output_stream(f"{root}/{POINTER}.tmp") as out:
        out.write(version.encode())
    fs.move(f"{root}/{POINTER}.tmp", f"{root}/{POINTER}")
    return target


def current_version(path: str) -> str:
    fs, root = open_fs(path.rstrip("/"))
    with fs.open_input_stream(f"{root}/{POINTER}") as f:
        return f"{path.rstrip('/')}/{f.read().decode()}"


def read_published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current_version(path))


def write_sharded(df: DataFrame, path: str, shard_size: int = 4096, index: str = "global_index") -> str:
    """Rows into shards of ``shard_size`` by index, sorted inside; the last shard may be short.

    One shuffle on the shard number; every shard has at most ``shard_size`` rows, so no task can grow hot.
    Row-group statistics on the sorted index let slices skip files.
    """
    total, lo, hi = df.agg(F.count(index), F.min(index), F.max(index)).first()
    require(total > 0, "nothing to write")
    shards = hi // shard_size - lo // shard_size + 1
    sharded = (
        df.withColumn("shard", F.floor(F.col(index) / shard_size))
        .repartition(min(shards, 20_000), "shard")
        .sortWithinPartitions("shard", index)
    )

    def check(written: DataFrame) -> None:
        n, distinct, misplaced = written.agg(
            F.count("*"), F.count_distinct(index),
            F.count_if(F.floor(F.col(index) / shard_size) != F.col("shard")),
        ).first()
        require(n == total and distinct == total and misplaced == 0, f"written {n} of {total} rows, {distinct} distinct")

    return publish_table(sharded, path, check, "shard")


def build_manifest(df: DataFrame, index: str = "global_index", payload: str = "tensor", item_bytes: int = 4) -> DataFrame:
    """Per shard: rows, payload bytes, first and last index, label range, digest."""
    sized = df.withColumn("__bytes", F.size(payload).cast("bigint") * item_bytes).withColumn("__h", row_hash(df.columns))
    return sized.groupBy("shard").agg(
        F.count("*").alias("rows"), F.sum("__bytes").alias("bytes"), F.min(index).alias("first_index"),
        F.max(index).alias("last_index"), F.min("label").alias("label_min"), F.max("label").alias("label_max"),
        *digest_columns(F.col("__h")),
    )


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count("*").alias("shards"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"),
        F.min("first_index").alias("first_index"), F.max("last_index").alias("last_index"),
        F.min("label_min").alias("label_min"), F.max("label_max").alias("label_max"),
    )
