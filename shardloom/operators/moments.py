"""Mean and covariance of feature tables of any length.

Tasks fold their rows into one Gram matrix; only those partials are shuffled, row by row of the matrix, and
summed as vectors. The result has one row per feature: ``i, n, mu, sigma`` (row i of the covariance).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.functions.batches import extended_schema, group_rows, key_columns, list_column, matrix
from shardloom.functions.joins import join_groups
from shardloom.session import require

_PILOT_ROWS = 256
_MAX_OPEN_CELLS = 2**25
_CHUNK_CELLS = 65_536


# Partials of so many tasks meet first, so no group grows with the number of tasks.
_MERGED_TASKS = 64


def feature_width(df: DataFrame, features: str) -> int:
    first = df.select(F.size(features)).first()
    require(first is not None, "the feature table is empty")
    return first[0]


def vector_sums(partials: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise sum of ``vector`` per key, as a tree: rows are summed in salted groups, then those sums.

    A first group holds the partials of a share of the tasks, a last one at most ``_MERGED_TASKS`` rows.
    """
    keys = list(keys)
    schema = partials.select(*keys, vector).schema

    def add(table: pa.Table) -> pa.Table:
        column = table.column(vector).combine_chunks()
        total = matrix(column, len(column[0])).sum(axis=0, keepdims=True)
        out = {k: table.column(k).slice(0, 1) for k in keys}
        out[vector] = list_column(total, pa.float64())
        return pa.table(out)

    # the salt follows from the row itself, so a repeated task sends its partial the same way
    salted = partials.select(*keys, vector, F.pmod(F.xxhash64(vector), F.lit(_MERGED_TASKS)).alias("__salt"))
    first = salted.groupBy(*keys, "__salt").applyInArrow(add, schema)
    return first.groupBy(*keys).applyInArrow(add, schema)


def gram_partials(
    df: DataFrame, features: str, width: int, by: Sequence[str] = (), pilot: np.ndarray | None = None
) -> DataFrame:
    """Rows ``(by..., chunk, cells)``: the Gram matrix of ``[x - pilot, 1]`` per task and group, in chunks of rows.

    The column of ones makes the last matrix row carry the plain sums and the count.
    """
    by = list(by)
    shift = np.zeros(width) if pilot is None else pilot
    schema = extended_schema(df.select(*by).schema, "chunk int, cells array<double>")
    kinds = {f.name: f.dataType for f in schema.fields[: len(by)]}
    piece = _chunk_rows(width) * (width + 1)

    def emit(groups):
        for key, gram in groups.items():
            flat = gram.reshape(-1)
            for chunk, at in enumerate(range(0, len(flat), piece)):
                out = key_columns(key, by, kinds, 1)
                out["chunk"] = pa.array([chunk], pa.int32())
                out["cells"] = list_column(flat[None, at : at + piece], pa.float64())
                yield pa.RecordBatch.from_pydict(out)

    def fold(batches):
        groups: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = matrix(batch.column(features), width) - shift
            x = np.column_stack([x, np.ones(len(x))])
            for key, rows in group_rows(batch, by):
                part = x[rows].T @ x[rows]
                groups[key] = groups[key] + part if key in groups else part
            if len(groups) * (width + 1) ** 2 > _MAX_OPEN_CELLS and len(groups) > 1:
                yield from emit(groups)
                groups = {}
        yield from emit(groups)

    return df.select(*by, features).mapInArrow(fold, schema)


def _chunk_rows(width: int) -> int:
    return max(1, _CHUNK_CELLS // (width + 1))


def moments(
    df: DataFrame, features: str = "features", by: Sequence[str] = (), width: int | None = None, strict: bool = True
) -> DataFrame:
    """``(by..., i, n, mu, sigma)``; covariance with n-1. ``strict`` raises when n < 2, else sigma is null."""
    # shifting by a rough mean keeps the one-pass covariance from cancelling
    head = df.select(features).limit(_PILOT_ROWS).toPandas()[features]
    require(len(head) > 0, "the feature table is empty")
    pilot = np.array(head.tolist(), dtype=np.float64).mean(axis=0)
    require(width is None or len(pilot) == width, f"expected features of {width} values")
    sums = vector_sums(gram_partials(df, features, len(pilot), by, pilot), [*by, "chunk"], "cells")
    return finalize_moments(sums, by, pilot, strict)


def finalize_moments(sums: DataFrame, by: Sequence[str], pilot: np.ndarray, strict: bool = True, weighted: bool = False) -> DataFrame:
    """Summed Gram chunks to moments. ``weighted`` sums carry any weights: the covariance is divided by the total weight, which
    is added as ``weight`` (``n`` is its nearest whole number)."""
    by, width = list(by), len(pilot)
    rows = _chunk_rows(width)
    last = width // rows
    start = (width - last * rows) * (width + 1)
    totals = sums.where(F.col("chunk") == last).select(*by, F.slice("cells", start + 1, width + 1).alias("__sums"))
    schema = extended_schema(sums.select(*by).schema, "i int, n bigint, mu double, sigma array<double>" + (", weight double" if weighted else ""))

    def finish(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                total = batch.column("__sums")[r].values.to_numpy()
                block = batch.column("cells")[r].values.to_numpy().reshape(-1, width + 1)
                first = batch.column("chunk")[r].as_py() * rows
                block = block[: max(0, width - first)]
                count, sums_i, n = len(block), block[:, width], total[width]
                if not count:
                    continue
                if weighted or n >= 2:
                    divisor = n if weighted else n - 1
                    sigma = list_column((block[:, :width] - np.outer(sums_i, total[:width]) / n) / divisor, pa.float64())
                elif strict:
                    raise ValueError("at least two samples are needed for a covariance")
                else:
                    sigma = pa.nulls(count, pa.list_(pa.float64()))
                at = np.arange(first, first + count)
                out = {c: batch.column(c).take(pa.array([r] * count)) for c in by}
                out |= {"i": pa.array(at.astype(np.int32)), "n": pa.array([round(n)] * count, pa.int64())}
                out |= {"mu": pa.array(pilot[at] + sums_i / n), "sigma": sigma}
                out |= {"weight": pa.array([n] * count, pa.float64())} if weighted else {}
                yield pa.RecordBatch.from_pydict(out)

    return join_groups(sums, totals, by).mapInArrow(finish, schema)


def moment_cells(mom: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form ``(by..., i, j, n, mu_i, sigma_ij)``."""
    return mom.select(
        *by, "i", "n", F.col("mu").alias("mu_i"), F.posexplode("sigma").alias("j", "sigma_ij")
    )


def packed_moments(mom: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``mu array<double>, sigma array<array<double>>, count``."""
    ordered = F.sort_array(F.collect_list(F.struct("i", "mu", "sigma")))  # as many rows as features
    return mom.groupBy(*by).agg(ordered.alias("__r"), F.max("n").alias("count")).select(
        *by, F.col("__r.mu").alias("mu"), F.col("__r.sigma").alias("sigma"), "count"
    )


def moment_summary(mom: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population std over all feature values, from the moments alone."""
    square = F.get("sigma", F.col("i")) * (F.col("n") - 1) / F.col("n") + F.col("mu") * F.col("mu")
    sums = mom.groupBy(*by).agg(F.avg("mu").alias("feature_mean"), F.avg(square).alias("__square"))
    spread = F.greatest(F.col("__square") - F.col("feature_mean") * F.col("feature_mean"), F.lit(0.0))
    return sums.select(*by, "feature_mean", F.sqrt(spread).alias("feature_std"))


def trace_sigma(mom: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return mom.groupBy(*by).agg(
        F.max("n").alias("n"), F.count("*").alias("dims"), F.sum(F.get("sigma", F.col("i"))).alias("sigma_trace")
    )


def write_reference_stats(df: DataFrame, path: str, features: str = "features", by: Sequence[str] = ()) -> str:
    """Moments of a reference set, built once; staged, checked, then published by pointer."""
    from shardloom.sources.sinks import publish_table

    mom = moments(df, features, by)
    return publish_table(mom, path, lambda t: require(t.limit(1).count() == 1, "no reference statistics written"))


def load_reference_stats(spark, path: str) -> DataFrame:
    from shardloom.sources.sinks import read_published

    return read_published(spark, path)
