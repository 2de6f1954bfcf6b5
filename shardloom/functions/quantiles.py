"""Exact quantiles of groups of any size.

Spark's ``percentile`` keeps a whole group's values in one task. Here counts per order-preserving code find
the code that holds each wanted rank, twice, and only the values under those codes are looked at one by one.

The same rules hold at every size: nulls and NaN among plain values are left out, infinite values are ranked as the
ends of the order, and a tensor that is null, holds a null or is not as wide as declared is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shardloom.functions.batches import extended_schema, group_rows, key_columns, matrix
from shardloom.functions.joins import join_groups
from shardloom.session import BROADCAST_ROWS, materialize

# 64 codes per doubling on the first level, each cut 4096-fold on the second.
CODES_PER_DOUBLING = 64
FINE_CUT = 4096
_FINE = CODES_PER_DOUBLING * FINE_CUT
_SHIFT = 12
_OFFSET = 1100.0
_TABLE_CODES = 1 << 22
# Up to this many values in all, every group fits one task.
SMALL_VALUES = 1_000_000


def value_codes(values: np.ndarray) -> np.ndarray:
    """Numbers that never decrease as the values grow; infinite values lie beyond all others. No NaN."""
    size = np.clip(np.abs(values), np.finfo(np.float64).tiny * 2.0**-52, np.finfo(np.float64).max)
    magnitude = np.floor((np.log2(size) + _OFFSET) * _FINE) + 1 + np.where(np.isinf(values), float(_FINE), 0.0)
    return np.where(values == 0, 0, np.sign(values) * magnitude).astype(np.int64)


@F.pandas_udf(T.LongType())
def _code(v: pd.Series) -> pd.Series:
    """``value_codes`` of a column; the one coder of all levels and both forms."""
    return pd.Series(value_codes(v.to_numpy(dtype=np.float64)))


def count_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often each occurs; a table of counts where the codes lie close together."""
    if codes.dtype.kind != "i" or not len(codes):
        return np.unique(codes, return_counts=True)
    low, high = int(codes.min()), int(codes.max())
    if high - low > _TABLE_CODES:
        return np.unique(codes, return_counts=True)
    counts = np.bincount(codes - low, minlength=1)
    at = np.flatnonzero(counts)
    return at + low, counts[at]


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), small_values: int | None = None
) -> DataFrame:
    """One row per group: ``n`` and ``q`` (array aligned with ``probs``), linear interpolation.

    Nulls and NaN are left out. A table counted as small is ranked at once; a larger one takes three passes,
    whose shuffles move pre-counted codes or values.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    small = SMALL_VALUES if small_values is None else small_values
    if rows.limit(small + 1).count() <= small:
        return _at_once(rows, probs, by)
    rows = rows.withColumn("__fine", _code(F.col("__v"))).withColumn("__coarse", F.shiftright("__fine", _SHIFT))

    def count(level: str, hits: DataFrame | None, few: bool) -> DataFrame:
        keys = [*by, *_LEVELS[: _LEVELS.index(level) + 1]]
        if hits is None:
            return rows.groupBy(*keys).agg(F.count("*").alias("__c"))
        inside = join_groups(rows, hits, keys[:-1], small=few)
        return inside.groupBy(*keys).agg(F.count("*").alias("__c"), *_carried())

    return _quantiles(count, probs, by)


def tensor_quantiles(
    df: DataFrame, width: int, probs: Sequence[float], by: Sequence[str] = (), tensor: str = "tensor",
    magnitude: bool = False, small_values: int | None = None,
) -> DataFrame:
    """``exact_quantiles`` of all values in arrays of ``width``; tasks count codes in blocks, nothing is exploded.

    Falls back to the row form when there are too many groups to hand the wanted codes to every task.
    """
    by = list(by)
    bad = F.col(tensor).isNull() | (F.size(tensor) != width) | F.exists(tensor, lambda v: v.isNull())
    sound = F.when(bad, F.raise_error(F.lit(f"a tensor is not {width} values"))).otherwise(F.col(tensor))
    source = df.select(*by, tensor)
    small = (SMALL_VALUES if small_values is None else small_values) // width
    if source.limit(small + 1).count() <= small:
        rows = source.withColumn(tensor, sound).select(*by, F.explode(tensor).alias("__v")).withColumn("__v", F.col("__v").cast("double"))
        rows = rows.withColumn("__v", F.abs("__v")) if magnitude else rows
        return _at_once(rows.where(~F.isnan("__v")), probs, by)

    def counts(level: int, wanted: dict | None) -> DataFrame:
        shared = None if wanted is None else df.sparkSession.sparkContext.broadcast(wanted)
        schema = extended_schema(df.select(*by).schema, "__coarse bigint, __fine bigint, __v double, __c bigint")
        kinds = {f.name: f.dataType for f in schema.fields[: len(by)]}

        def fold(batches):
            for batch in batches:
                x = matrix(batch.column(tensor), width)
                x = np.abs(x) if magnitude else x
                for key, at in group_rows(batch, by):
                    v = x[at].reshape(-1)
                    v = v[~np.isnan(v)]
                    fine = value_codes(v)
                    coarse = fine >> _SHIFT
                    if shared is not None:
                        keep = np.isin(coarse if level == 1 else fine, shared.value.get(key, []))
                        v, fine, coarse = v[keep], fine[keep], coarse[keep]
                    picked, n = count_codes((coarse, fine, v)[level])
                    if not len(picked):
                        continue
                    out = key_columns(key, by, kinds, len(picked))
                    codes = picked if level == 1 else value_codes(picked) if level == 2 else np.zeros(len(picked), np.int64)
                    out["__coarse"] = pa.array(picked if level == 0 else codes >> _SHIFT)
                    out["__fine"] = pa.array(codes)
                    out["__v"] = pa.array(picked if level == 2 else np.zeros(len(picked)))
                    out["__c"] = pa.array(n)
                    yield pa.RecordBatch.from_pydict(out)

        return source.mapInArrow(fold, schema)

    def wanted_codes(hits: DataFrame, code: str) -> dict:
        found: dict[tuple, list] = {}
        for row in hits.select(*by, code).collect():  # bounded: checked against BROADCAST_ROWS
            found.setdefault(tuple(row[:-1]), []).append(row[-1])
        return {k: np.array(v) for k, v in found.items()}

    def count(level: str, hits: DataFrame | None, few: bool) -> DataFrame:
        keys = [*by, *_LEVELS[: _LEVELS.index(level) + 1]]
        if hits is None:
            return counts(0, None).groupBy(*keys).agg(F.sum("__c").alias("__c"))
        if few:
            found = join_groups(counts(_LEVELS.index(level), wanted_codes(hits, keys[-2])), hits, keys[:-1], small=True)
        else:
            exploded = source.select(*by, F.explode(tensor).alias("__v")).withColumn("__v", F.col("__v").cast("double"))
            if magnitude:
                exploded = exploded.withColumn("__v", F.abs("__v"))
            exploded = exploded.where(~F.isnan("__v")).withColumn("__fine", _code(F.col("__v")))
            coded = exploded.withColumn("__coarse", F.shiftright("__fine", _SHIFT)).withColumn("__c", F.lit(1).cast("bigint"))
            found = join_groups(coded, hits, keys[:-1])
        return found.groupBy(*keys).agg(F.sum("__c").alias("__c"), *_carried())

    return _quantiles(count, probs, by)


def _at_once(rows: DataFrame, probs: Sequence[float], by: list[str]) -> DataFrame:
    points = F.array(*[F.lit(float(p)) for p in probs])
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("__v", points).alias("q"))
    return out.where(F.col("n") > 0)


_LEVELS = ["__coarse", "__fine", "__v"]


def _carried() -> list[Column]:
    """Facts that are the same in all rows under one code."""
    return [F.first(c).alias(c) for c in ("__ranks", "__base", "__n")]


def _quantiles(count, probs: Sequence[float], by: list[str]) -> DataFrame:
    codes = count("__coarse", None, False).withColumn("__n", F.sum("__c").over(Window.partitionBy(*by)))
    ends = [fn(F.lit(float(p)) * (F.col("__n") - 1)).cast("bigint") for p in probs for fn in (F.floor, F.ceil)]
    codes = codes.withColumn("__ranks", F.array_distinct(F.array(*ends))).withColumn("__base", F.lit(0))
    # the first pass is kept, so the later ones neither repeat it nor guess its size
    hits = materialize(_ranks_inside(codes, by, "__coarse"), "quantile-codes")
    few = hits.count() * 2 * len(probs) <= BROADCAST_ROWS
    hits = _ranks_inside(count("__fine", hits, few), [*by, "__coarse"], "__fine")
    if few:
        hits = materialize(hits, "quantile-codes")
    found = _ranks_inside(count("__v", hits, few), [*by, "__coarse", "__fine"], "__v")
    picked = found.select(*by, "__n", F.explode("__ranks").alias("__rank"), "__v")
    grouped = picked.groupBy(*by).agg(
        F.first("__n").alias("n"), F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at")
    )

    def interpolate(p: float) -> Column:
        pos = F.lit(float(p)) * (F.col("n") - 1)
        low = F.try_element_at("__at", F.floor(pos).cast("bigint"))
        high = F.try_element_at("__at", F.ceil(pos).cast("bigint"))
        # as in Spark's percentile, so an infinite neighbour gives the same value in both forms
        between = (F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high
        return F.when((F.floor(pos) == F.ceil(pos)) | (low == high), low).otherwise(between)

    return grouped.select(*by, "n", F.array(*[interpolate(p) for p in probs]).alias("q"))


def _ranks_inside(counts: DataFrame, parts: Sequence[str], order: str) -> DataFrame:
    """Keep the codes whose span of ranks holds a wanted rank, with those ranks and the new base."""
    ahead = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__base") + F.coalesce(F.sum("__c").over(ahead), F.lit(0))
    keys = list(dict.fromkeys([*parts, order]))
    return (
        counts.withColumn("__start", start)
        .withColumn(
            "__ranks",
            F.filter("__ranks", lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__c"))),
        )
        .where(F.size("__ranks") > 0)
        .select(*keys, "__ranks", F.col("__start").alias("__base"), "__n")
    )
