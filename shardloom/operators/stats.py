"""Global and per-channel statistics of tensor tables.

Each task folds its rows into one small partial per (group, channel); partials are algebraic, so they merge
in any order, over any split, and across stream batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shardloom.functions.arrays import is_not_finite
from shardloom.functions.batches import bytes_matrix, extended_schema, group_rows, matrix
from shardloom.functions.joins import join_groups
from shardloom.functions.quantiles import tensor_quantiles
from shardloom.spec import DatasetSpec

PARTIAL_COLUMNS = ["sample_count", "n", "s", "ss", "mn", "mx"]
# A task that meets more groups than this hands on what it has and starts afresh.
_MAX_OPEN_GROUPS = 4096


def tensor_partials(df: DataFrame, spec: DatasetSpec, by: Sequence[str] = (), tensor: str = "tensor") -> DataFrame:
    """Rows ``(by..., channel, sample_count, n, s, ss, mn, mx)``, one per (task, group, channel)."""
    by = list(by)
    channels, plane, size = spec.channels, spec.plane, spec.size
    binary = df.schema[tensor].dataType.typeName() == "binary"
    schema = extended_schema(
        df.select(*by).schema,
        "channel int, sample_count bigint, n bigint, s double, ss double, mn double, mx double",
    )
    key_types = {f.name: f.dataType for f in schema.fields[: len(by)]}

    def fold(batches):
        open_groups: dict[tuple, np.ndarray] = {}
        for batch in batches:
            column = batch.column(tensor)
            values = (bytes_matrix if binary else matrix)(column, size).astype(np.float64)
            values = values.reshape(-1, channels, plane)
            for key, rows in group_rows(batch, by):
                part = _fold_block(values[rows])
                seen = open_groups.get(key)
                open_groups[key] = part if seen is None else _merge_block(seen, part)
            if len(open_groups) > _MAX_OPEN_GROUPS:
                yield _partial_batch(open_groups, by, key_types, channels)
                open_groups = {}
        if open_groups:
            yield _partial_batch(open_groups, by, key_types, channels)

    return df.select(*by, tensor).mapInArrow(fold, schema)


def _fold_block(x: np.ndarray) -> np.ndarray:
    """Columns n_samples, n, s, ss, mn, mx per channel of an ``[n, C, plane]`` block."""
    samples, channels, plane = x.shape
    counts = np.full((channels, 2), [samples, samples * plane], dtype=np.float64)
    return np.column_stack(
        [
            counts,
            x.sum(axis=(0, 2)),
            np.einsum("ncp,ncp->c", x, x),
            np.fmin.reduce(np.fmin.reduce(x, axis=2), axis=0),
            np.fmax.reduce(np.fmax.reduce(x, axis=2), axis=0),
        ]
    )


def _merge_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.column_stack([a[:, :4] + b[:, :4], np.fmin(a[:, 4], b[:, 4]), np.fmax(a[:, 5], b[:, 5])])


def _partial_batch(groups: dict, by: list[str], key_types: dict, channels: int) -> pa.RecordBatch:
    block = np.concatenate(list(groups.values()))
    columns = {
        name: pa.array([key[i] for key in groups for _ in range(channels)], to_arrow_type(key_types[name]))
        for i, name in enumerate(by)
    }
    columns["channel"] = pa.array(np.tile(np.arange(channels, dtype=np.int32), len(groups)))
    for i, name in enumerate(PARTIAL_COLUMNS):
        columns[name] = pa.array(block[:, i].astype(np.int64) if i < 2 else block[:, i])
    return pa.RecordBatch.from_pydict(columns)


def merge_stats(partials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Associative merge of partial rows per (group, channel); union two partial tables to merge them."""
    return partials.groupBy(*by, "channel").agg(*_merge_columns())


def _merge_columns() -> list[Column]:
    sums = [F.sum(c).alias(c) for c in PARTIAL_COLUMNS[:4]]
    return [*sums, F.min("mn").alias("mn"), F.max("mx").alias("mx")]


def _moments(n: Column, s: Column, ss: Column, ddof: int) -> dict[str, Column]:
    mean = s / n
    centred = F.greatest(F.lit(0.0), ss / n - mean * mean)
    std = F.sqrt(centred) if ddof == 0 else F.when(n > ddof, F.sqrt(centred * n / (n - F.lit(ddof))))
    return {"mean": mean, "std": std, "rms": F.sqrt(F.greatest(F.lit(0.0), ss / n))}


def finalize_channels(merged: DataFrame, by: Sequence[str] = (), ddof: int = 0) -> DataFrame:
    m = _moments(F.col("n"), F.col("s"), F.col("ss"), ddof)
    return merged.select(
        *by, "channel", "sample_count", F.col("n").alias("count"), m["mean"].alias("mean"), m["std"].alias("std"),
        m["rms"].alias("rms"), F.col("mn").alias("min"), F.col("mx").alias("max"),
    )


def finalize_global(merged: DataFrame, by: Sequence[str] = (), ddof: int = 0) -> DataFrame:
    """Fold channel partials into one row per group; an empty table gives counts only."""
    total = merged.groupBy(*by).agg(
        F.coalesce(F.max("sample_count"), F.lit(0)).alias("sample_count"),
        *[F.sum(c).alias(c) for c in ("n", "s", "ss")], F.min("mn").alias("mn"), F.max("mx").alias("mx"),
    )
    m = _moments(F.col("n"), F.col("s"), F.col("ss"), ddof)
    return total.select(
        *by, "sample_count", F.coalesce("n", F.lit(0)).alias("count"), m["mean"].alias("mean"),
        m["std"].alias("std"), m["rms"].alias("rms"), F.col("mn").alias("min"), F.col("mx").alias("max"),
        F.greatest(F.abs("mn"), F.abs("mx")).alias("absmax"),
    )


def tensor_stats(
    df: DataFrame, spec: DatasetSpec, by: Sequence[str] = (), tensor: str = "tensor", ddof: int = 0
) -> DataFrame:
    """sample_count, count, mean, std (population unless ``ddof=1``), rms, min, max, absmax per group."""
    return finalize_global(merge_stats(tensor_partials(df, spec, by, tensor), by), by, ddof)


def channel_stats(
    df: DataFrame, spec: DatasetSpec, by: Sequence[str] = (), tensor: str = "tensor", ddof: int = 0
) -> DataFrame:
    """The same per channel over all positions."""
    return finalize_channels(merge_stats(tensor_partials(df, spec, by, tensor), by), by, ddof)


def channel_summary(channels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """min, max, mean and population std of the channel means and of the channel stds."""
    return channels.groupBy(*by).agg(
        *[
            fn(c).alias(f"{c}_{label}")
            for c in ("mean", "std")
            for label, fn in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))
        ]
    )


def stats_with_merged(df: DataFrame, spec: DatasetSpec, key: str = "view", tensor: str = "tensor") -> DataFrame:
    """Per-channel statistics for each key and for all keys merged (``key`` null), in one scan."""
    partials = tensor_partials(df, spec, [key], tensor)
    both = partials.groupingSets([[key, "channel"], ["channel"]], key, "channel").agg(*_merge_columns())
    return finalize_channels(both, [key])


def shape_span(registry: DataFrame, order: str = "path", shape: str = "latent_shape", count: str = "num_samples") -> DataFrame:
    """First and last tensor shape ``[N, C, H, W]`` met in merge order."""
    full = F.concat(F.array(F.col(count).cast("bigint")), F.col(shape).cast("array<bigint>"))
    return registry.where(F.col(count) > 0).agg(
        F.min_by(full, order).alias("shape_first"), F.max_by(full, order).alias("shape_last")
    )


def abs_quantiles(df: DataFrame, spec: DatasetSpec, by: Sequence[str] = (), tensor: str = "tensor") -> DataFrame:
    """mean, std of the values and mean, median, p90, p95, p99, max of their magnitudes; quantiles are exact."""
    by = list(by)
    # the values and their magnitudes side by side, folded as two channels in one scan
    doubled = df.withColumn(tensor, F.concat(tensor, F.transform(tensor, F.abs)))
    pair = channel_stats(doubled, DatasetSpec(2, 1, spec.size), by, tensor)

    def of(channel: int, stat: str) -> Column:
        return F.max(F.when(F.col("channel") == channel, F.col(stat)))

    folded = pair.groupBy(*by).agg(
        of(0, "mean").alias("mean"), of(0, "std").alias("std"), of(1, "mean").alias("abs_mean"), of(1, "max").alias("abs_max")
    )
    ranked = tensor_quantiles(df, spec.size, [0.5, 0.9, 0.95, 0.99], by, tensor, magnitude=True).select(
        *by,
        *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("abs_median", "abs_p90", "abs_p95", "abs_p99"))],
    )
    return join_groups(folded, ranked, by)


def finite_audit(df: DataFrame, by: Sequence[str] = (), tensor: str = "tensor") -> DataFrame:
    """All-finite flag and counts of NaN and infinite values; an empty group set gives false."""
    x = F.col(tensor)
    inf = float("inf")
    rows = df.select(
        *by,
        F.exists(x, is_not_finite).alias("__bad"),
        F.size(F.filter(x, F.isnan)).cast("bigint").alias("__nan"),
        F.size(F.filter(x, lambda v: v == inf)).cast("bigint").alias("__pos"),
        F.size(F.filter(x, lambda v: v == -inf)).cast("bigint").alias("__neg"),
    )
    return rows.groupBy(*by).agg(
        F.count("*").alias("samples"),
        F.coalesce(F.bool_and(~F.col("__bad")), F.lit(False)).alias("all_finite"),
        F.coalesce(F.sum("__nan"), F.lit(0)).alias("nan_count"),
        F.coalesce(F.sum("__pos"), F.lit(0)).alias("pos_inf_count"),
        F.coalesce(F.sum("__neg"), F.lit(0)).alias("neg_inf_count"),
    )
