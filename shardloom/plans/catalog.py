"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shardloom.plans.views import Tables, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` and its SQL twin."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *ctes)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, so both engines agree past their summation order."""
    return df.select(
        *[
            F.round(F.col(f.name).cast("double"), digits).alias(f.name)
            if f.dataType.typeName() in ("double", "float") else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def stamp(column: str):
    """Timestamp as text with microseconds."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def load() -> None:
    from shardloom.plans import (  # noqa: F401
        distance_queries, log_queries, quality_queries, sample_queries, source_queries, stat_queries, stream_queries,
    )
