"""Session helpers: where shared scratch output goes, and small driver-side guards."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only when it was counted and found no longer than this; rows here are a few keys wide.
BROADCAST_ROWS = 200_000


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when that is unset (single-machine tests) does a local temporary folder stand in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shardloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a reused intermediate once to the shared scratch folder and read it back.

    Cuts the lineage: later passes and lost executors reread the table instead of recomputing it.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a count finds the (narrow) table short enough to broadcast."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a narrow side that a count shows to be small; otherwise leave the shuffle join."""
    return F.broadcast(df) if is_small(df, max_rows) else df
