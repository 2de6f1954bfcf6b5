"""Average ranks over a whole table and scores that add them up."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from shardloom.functions.hot_joins import join_counted
from shardloom.functions.ordering import ordered_bucket, running_before
from shardloom.session import materialize, require


def average_ranks(df: DataFrame, column: str, name: str = "rank", descending: bool = False) -> DataFrame:
    """Adds the rank of each row's value, from 1; equal values share the mean of their ranks.

    NaN comes after all numbers (before them, if ``descending``) and ties with itself, 0.0 ties with -0.0; a null has no
    rank. Values are counted first, so a value with most of the rows is one row in the order, and joins by broadcast.
    """
    value = F.col(column) + F.lit(0.0) if df.schema[column].dataType.typeName() in ("double", "float") else F.col(column)
    rows = materialize(df.drop(name, "__value").withColumn("__value", value), "ranked")
    counts = materialize(rows.where(F.col("__value").isNotNull()).groupBy("__value").agg(F.count("*").alias("__n")), "values")
    total = rows.count()
    placed = running_before(counts, ["__value"], ordered_bucket(counts, "__value"), F.col("__n"), name="__before")
    up = F.col("__before") + (F.col("__n") + 1) / 2.0
    if descending:
        known = counts.agg(F.sum("__n")).first()[0] or 0
        up = F.lit(known) + 1.0 - up
    ranks = materialize(placed.select("__value", "__n", up.alias(name)), "ranks")
    known = join_counted(rows.where(F.col("__value").isNotNull()), ranks, ["__value"], "__n", total)
    missing = rows.where(F.col("__value").isNull()).withColumn(name, F.lit(None).cast("double"))
    return known.unionByName(missing).drop("__value")


def rank_sum(df: DataFrame, columns: Mapping[str, bool], name: str = "rank_sum") -> DataFrame:
    """Adds the sum of the average ranks over several columns (``descending`` by column); null if one value is null."""
    require(bool(columns), "at least one column is needed")
    keep, out = [c for c in df.columns if c != name], df
    for k, (column, descending) in enumerate(columns.items()):
        out = average_ranks(out, column, f"__rank_{k}", descending)
    total = sum((F.col(f"__rank_{k}") for k in range(len(columns))), F.lit(0.0))
    return out.select(*keep, total.alias(name))
