"""Confidence intervals of the Fréchet distance from a Poisson bootstrap.

Row r has in replicate b a weight drawn from the Poisson distribution with mean 1; the draw is a function of seed, replicate
and row, so nothing changes when a task is repeated or the table is dealt differently. Tasks fold the weighted Gram matrices
of as many replicates at once as fit their memory, so all replicates of 64 features take one scan, and those of very wide
features a few.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shardloom.functions.batches import list_column, matrix
from shardloom.functions.hashing import draw_key
from shardloom.functions.joins import with_row
from shardloom.operators.distances import frechet
from shardloom.operators.moments import _PILOT_ROWS, _chunk_rows, finalize_moments, moments, vector_sums
from shardloom.session import materialize, require

#: Weights of 0, 1, ... lie below these values of a uniform draw; the rest of the distribution is below 2**-32.
POISSON_CUTS = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(14)]
#: Cells of the open Gram matrices of a task.
OPEN_CELLS = 1 << 24
#: Draws of 32 bits in one md5 key.
PER_KEY = 4


def draw_keys(index: str, replicates: int, seed: int) -> Column:
    """One md5 key for every ``PER_KEY`` replicates of a row."""
    groups = F.sequence(F.lit(0), F.lit((replicates - 1) // PER_KEY))
    return F.transform(groups, lambda g: draw_key(seed, g, F.col(index)))


def weights_of(keys: pa.Array, replicates: int) -> np.ndarray:
    """Weights (row, replicate) from the hexadecimal digits of the keys."""
    flat = keys.flatten()
    raw = np.frombuffer("".join(flat.to_pylist()).encode(), dtype=np.uint8).astype(np.int64)
    digits = np.where(raw >= ord("a"), raw - ord("a") + 10, raw - ord("0")).reshape(-1, 8)
    draws = (digits @ (16 ** np.arange(7, -1, -1))).reshape(len(keys), -1)[:, :replicates] / 2.0**32
    return np.searchsorted(POISSON_CUTS, draws, side="right").astype(np.float64)


def _weighted_partials(df: DataFrame, features: str, width: int, replicates: range, pilot: np.ndarray) -> DataFrame:
    """``replicate, chunk, cells``: the weighted Gram matrices of ``[x - pilot, 1]`` of each task."""
    piece = _chunk_rows(width) * (width + 1)
    first, last = replicates.start, replicates.stop

    def fold(batches):
        total = np.zeros((len(replicates), width + 1, width + 1))
        for batch in batches:
            x = matrix(batch.column(features), width) - pilot
            x = np.column_stack([x, np.ones(len(x))])
            w = weights_of(batch.column("__keys"), last)[:, first:]
            for r in range(len(replicates)):
                some = np.flatnonzero(w[:, r])
                total[r] += (x[some] * w[some, r, None]).T @ x[some]
        for r, gram in zip(replicates, total, strict=True):
            flat = gram.ravel()
            for chunk, at in enumerate(range(0, len(flat), piece)):
                yield pa.RecordBatch.from_pydict({
                    "replicate": pa.array([r], pa.int32()), "chunk": pa.array([chunk], pa.int32()),
                    "cells": list_column(flat[None, at : at + piece], pa.float64()),
                })

    return df.select(features, "__keys").mapInArrow(fold, "replicate int, chunk int, cells array<double>")


def bootstrap_moments(
    df: DataFrame, replicates: int, index: str = "global_index", features: str = "features", seed: int = 0
) -> DataFrame:
    """``replicate, i, n, mu, sigma`` of each replicate; n is the sum of its weights. Needs two drawn rows in each.

    Two tables with one ``index`` and seed get equal weights in the rows they share, as a paired comparison needs.
    """
    require(replicates >= 1, "at least one replicate is needed")
    head = df.select(features).limit(_PILOT_ROWS).toPandas()[features]
    require(len(head) > 0, "the feature table is empty")
    pilot = np.array(head.tolist(), dtype=np.float64).mean(axis=0)
    keyed = df.withColumn("__keys", draw_keys(index, replicates, seed))
    at_once = max(1, OPEN_CELLS // (len(pilot) + 1) ** 2)
    partials = None
    for at in range(0, replicates, at_once):
        some = _weighted_partials(keyed, features, len(pilot), range(at, min(replicates, at + at_once)), pilot)
        partials = some if partials is None else partials.unionByName(some)
    return finalize_moments(vector_sums(partials, ["replicate", "chunk"], "cells"), ["replicate"], pilot)


def _interval(values: DataFrame, column: str, level: float) -> DataFrame:
    """One row: number, mean, standard deviation and the percentile interval over a few hundred replicates."""
    tail = (1.0 - level) / 2.0
    return values.agg(
        F.count("*").alias("replicates"), F.avg(column).alias("boot_mean"), F.stddev_samp(column).alias("boot_std"),
        F.percentile(column, F.lit(tail)).alias("low"), F.percentile(column, F.lit(1.0 - tail)).alias("high"),
    )


def frechet_interval(
    gen: DataFrame, reference: DataFrame, replicates: int = 200, level: float = 0.95, index: str = "global_index",
    features: str = "features", seed: int = 0, both: bool = False,
) -> DataFrame:
    """``fid`` of all rows with ``replicates, boot_mean, boot_std, low, high``.

    The reference is a fixed population, as published statistics are, unless ``both`` sides are drawn (with equal weights
    for equal indexes).
    """
    ref = moments(reference, features)
    drawn = bootstrap_moments(gen, replicates, index, features, seed)
    other = bootstrap_moments(reference, replicates, index, features, seed) if both else ref
    per = materialize(frechet(drawn, other, ["replicate"]), "replicates")
    return with_row(frechet(moments(gen, features), ref), _interval(per, "fid", level))


def paired_frechet(
    one: DataFrame, two: DataFrame, reference: DataFrame, replicates: int = 200, level: float = 0.95,
    index: str = "global_index", features: str = "features", seed: int = 0,
) -> DataFrame:
    """Difference of the distances of two tables over the same indexes to one reference, with its interval and
    ``share_above``, the share of replicates in which the first is farther away (ties count half)."""
    ref = moments(reference, features)
    per = [frechet(bootstrap_moments(df, replicates, index, features, seed), ref, ["replicate"]).select("replicate", F.col("fid").alias(c)) for df, c in ((one, "a"), (two, "b"))]
    gaps = materialize(per[0].join(per[1], "replicate").withColumn("gap", F.col("a") - F.col("b")), "gaps")
    all_rows = [frechet(moments(df, features), ref).select(F.col("fid").alias(c)) for df, c in ((one, "fid_one"), (two, "fid_two"))]
    above = gaps.agg(F.avg(F.when(F.col("gap") > 0, 1.0).when(F.col("gap") < 0, 0.0).otherwise(0.5)).alias("share_above"))
    out = with_row(with_row(with_row(all_rows[0], all_rows[1]), _interval(gaps, "gap", level)), above)
    return out.withColumn("difference", F.col("fid_one") - F.col("fid_two"))
