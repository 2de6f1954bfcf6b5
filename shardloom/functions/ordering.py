"""Positions and running sums in a given order, without ever sorting one group in one task.

A plain ``Window.orderBy`` puts the whole table (or a hot group) in one task. Here rows first get an
order-preserving bucket; per-bucket totals are few, so their prefix sum is cheap, and the exact order is
only needed inside each (group, bucket). The bucket is a function of the row's own value, so a recomputed
task lands on the same result. A table counted as small enough for one task gets no bucket (None) and a
plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

SINGLE_TASK_ROWS = 500_000
ROWS_PER_BUCKET = 100_000
MIN_BUCKETS, MAX_BUCKETS = 16, 16_384
# Hash-picked values per bucket behind the text cut points.
SAMPLE_PER_BUCKET = 4


def running_before(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column | None,
    value: Column | None = None,
    group: Sequence[str] = (),
    name: str = "before",
    position: str | None = None,
) -> DataFrame:
    """Add ``name`` = sum of ``value`` (default: row count) over the rows ahead in ``order`` within ``group``.

    ``position`` also adds the number of rows ahead. ``bucket`` must not decrease along ``order``. One shuffle
    of the rows on (group, bucket), plus the map-side combined totals.
    """
    one = F.lit(1).cast("bigint")
    wanted = {name: one if value is None else value} | ({position: one} if position else {})
    if bucket is None:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(amount).over(w), F.lit(0)).alias(out) for out, amount in wanted.items()])
    keys = ["__group", "__bucket"]
    rows = _keyed(df, group, bucket)
    for out, amount in wanted.items():
        rows = rows.withColumn(f"__amount_{out}", amount)
    ahead = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(*[F.sum(f"__amount_{out}").alias(f"__total_{out}") for out in wanted])
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"__total_{out}").over(ahead), F.lit(0)).alias(f"__offset_{out}") for out in wanted]
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, keys)
    for out in wanted:
        before = F.coalesce(F.sum(f"__amount_{out}").over(inside), F.lit(0))
        placed = placed.withColumn(out, F.col(f"__offset_{out}") + before)
    return placed.drop(*keys, *[f"__{kind}_{out}" for kind in ("amount", "offset") for out in wanted])


def _keyed(df: DataFrame, group: Sequence[str], bucket: Column) -> DataFrame:
    """Group and bucket as join keys that are never null, so rows with null groups or orders stay."""
    key = F.struct(*group) if group else F.lit(0)
    return df.withColumn("__group", key).withColumn("__bucket", F.coalesce(bucket, F.lit(-1)))


def bucket_count(rows: int) -> int:
    """Enough buckets to keep each near a fixed size, few enough for their totals to fit one task."""
    return min(MAX_BUCKETS, max(MIN_BUCKETS, rows // ROWS_PER_BUCKET))


def range_bucket(df: DataFrame, column: str, single_task_rows: int | None = None) -> Column | None:
    """Buckets of about equal counts along numbers, dates or timestamps, none for a small table.

    Cut at approximate quantiles, which are merged from every task's sketch, so an outlier does not empty the buckets.
    NaN comes last, as in Spark's order.
    """
    rows = df.count()
    if rows <= (SINGLE_TASK_ROWS if single_task_rows is None else single_task_rows):
        return None
    buckets = bucket_count(rows)
    number = _as_number(df, column)
    points = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    found = df.where(number.isNotNull() & ~F.isnan(number)).agg(F.percentile_approx(number, points, F.lit(max(10_000, 4 * buckets)))).first()[0]
    cuts = np.unique(np.array(found or [], dtype=np.float64))

    @F.pandas_udf("bigint")
    def place(values: pd.Series) -> pd.Series:
        at = values.to_numpy(dtype=np.float64, na_value=np.nan)
        return pd.Series(np.searchsorted(cuts, at, side="right"))

    # null and NaN look alike to numpy: null keeps no bucket
    return F.when(number.isNotNull(), place(number))


def _as_number(df: DataFrame, column: str) -> Column:
    """A double that does not decrease along the column; equal ones share a bucket and are ordered exactly there."""
    kind = df.schema[column].dataType.typeName()
    if kind == "timestamp":
        number = F.unix_micros(F.col(column))
    elif kind == "timestamp_ntz":
        number = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))
    elif kind == "date":
        number = F.unix_date(F.col(column))
    else:
        number = F.col(column)
    return number.cast("double")


def text_bucket(df: DataFrame, column: str, rows: int) -> Column:
    """Order-preserving buckets for a text column, cut at quantiles of a small hash-picked sample of its distinct values,
    each weighted by its rows, so a frequent text does not fill the sample.

    The sample only balances the buckets; every row is still placed exactly.
    """
    buckets = bucket_count(rows)
    picked = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__rows"))
    sample = picked.orderBy(F.xxhash64(column), column).limit(buckets * SAMPLE_PER_BUCKET).toPandas().sort_values(column)
    reached = sample["__rows"].cumsum().to_numpy(dtype=float)
    share = reached[-1] / buckets if len(reached) else 1.0
    # a value opens a bucket when the rows up to it pass the next share
    opens = np.floor(reached / share) > np.floor(np.concatenate([[0.0], reached[:-1]]) / share)
    cuts = sample[column].to_numpy(dtype=object)[opens]
    encoded = np.array([c.encode() for c in cuts], dtype=object)

    @F.pandas_udf("bigint")
    def place(values: pd.Series) -> pd.Series:
        # bytes compare the way Spark orders strings
        known = values.fillna("").str.encode("utf-8").to_numpy()
        return pd.Series(np.where(values.isna(), -1, np.searchsorted(encoded, known, side="right")))

    return place(F.col(column))


def ordered_bucket(df: DataFrame, column: str, single_task_rows: int | None = None) -> Column | None:
    """Buckets along any sortable column, none for a small table."""
    if df.schema[column].dataType.typeName() != "string":
        return range_bucket(df, column, single_task_rows)
    rows = df.count()
    return None if rows <= (SINGLE_TASK_ROWS if single_task_rows is None else single_task_rows) else text_bucket(df, column, rows)


def bucket_in_groups(df: DataFrame, group: Sequence[str], bucket: Column, max_rows: int = ROWS_PER_BUCKET) -> Column | None:
    """``bucket`` if some group is too long for one task, else None: then a plain window needs one shuffle only."""
    longest = df.groupBy(*group).count().agg(F.max("count")).first()[0]
    return bucket if (longest or 0) > max_rows else None


def last_rows(df: DataFrame, group: Sequence[str], order: str, k: int, tiebreak: str | None = None) -> DataFrame:
    """The ``k`` rows with the largest ``order`` per group, with ``rank_desc`` = 1 for the newest.

    Groups are cut into salts first, so a hot group's rows are sorted by many tasks and at most
    ``salts * k`` of them meet in one.
    """
    salts = 256
    order_cols = [F.col(order).desc(), *([F.col(tiebreak).desc()] if tiebreak else [])]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(order, *([tiebreak] if tiebreak else [])), F.lit(salts)))
    near = Window.partitionBy(*group, "__salt").orderBy(*order_cols)
    final = Window.partitionBy(*group).orderBy(*order_cols)
    return (
        salted.withColumn("rank_desc", F.row_number().over(near))
        .where(F.col("rank_desc") <= k)
        .withColumn("rank_desc", F.row_number().over(final))
        .where(F.col("rank_desc") <= k)
        .drop("__salt")
    )


def last_before(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column | None,
    value: Column,
    group: Sequence[str] = (),
    name: str = "previous",
    inclusive: bool = False,
) -> DataFrame:
    """Add ``name`` = the latest non-null ``value`` ahead of each row in ``order`` (or at it, if ``inclusive``).

    Like ``lag`` / ``last(ignorenulls)`` over the group, but a hot group is spread over its buckets: each
    bucket's last value is carried forward over the few bucket rows, and only rows of one bucket are sorted.
    """
    end = Window.currentRow if inclusive else -1
    if bucket is None:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    keys = ["__group", "__bucket"]
    rows = _keyed(df, group, bucket).withColumn("__value", value)
    ahead = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("__value").isNotNull(), F.struct(*order))
    carried = (
        rows.groupBy(*keys)
        .agg(F.max_by("__value", at).alias("__last"))
        .select(*keys, F.last("__last", ignorenulls=True).over(ahead).alias("__carry"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    return (
        rows.join(carried, keys)
        .withColumn(name, F.coalesce(F.last("__value", ignorenulls=True).over(inside), F.col("__carry")))
        .drop(*keys, "__value", "__carry")
    )
