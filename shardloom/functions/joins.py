"""Joins on group keys that keep groups with a null key, and one-row results set beside a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Equi-join where a null key meets a null key. ``small`` broadcasts a right side whose size was checked."""
    if not by:
        return with_row(left, right)
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in by else F.col(c) for c in right.columns])
    match = F.lit(True)
    for c in by:
        match = match & left[c].eqNullSafe(other[f"__r_{c}"])
    return left.join(F.broadcast(other) if small else other, match, how).drop(*[f"__r_{c}" for c in by])


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Every row of ``df`` with the columns of a one-row aggregate."""
    one = F.lit(1)
    return df.withColumn("__one", one).join(F.broadcast(row.withColumn("__one", one)), "__one").drop("__one")
