"""RBF-kernel MMD of large feature tables in time linear in their rows, with a standard error.

Rows of both sides are dealt to blocks of a fixed size; each block gives an unbiased estimate from its own pairs, and their
mean is the result. A row is shuffled once, and pairs of rows in different blocks are never compared: the price is the reported
error, which falls with the root of the number of blocks. ``distances.mmd_rbf`` stays the form over all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shardloom.functions.batches import list_column, matrix
from shardloom.operators.block_pairs import kernel_total, pair_sums, rbf_kernel
from shardloom.operators.moments import feature_width, vector_sums
from shardloom.session import broadcast_if_small, materialize, require

#: Rows per side aimed at in a block.
BLOCK_ROWS = 1024
#: Rows of a part of a block; a block with more rows of both sides is cut into parts that meet pair by pair.
PART_ROWS = 1 << 14


def mean_sq_distance(df: DataFrame, features: str = "features") -> float:
    """Mean squared distance over all pairs of different rows, from sums alone; 0 for a single row."""
    first = df.select(features).first()
    require(first is not None, "the feature table is empty")
    pilot = np.array(first[0], dtype=np.float64)  # a shift near the data keeps the sums from cancelling

    def fold(batches):
        total = np.zeros(len(pilot) + 2)
        for batch in batches:
            x = matrix(batch.column("f"), len(pilot)) - pilot
            total += np.concatenate([x.sum(axis=0), [np.square(x).sum(), len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), list_column(total[None], pa.float64())], ["one", "sums"])

    partials = df.select(F.col(features).alias("f")).mapInArrow(fold, "one int, sums array<double>")
    sums = np.array(vector_sums(partials, ["one"], "sums").first()["sums"])
    n = sums[-1]
    return float(2 * (sums[-2] - np.square(sums[:-2]).sum() / n) / (n - 1)) if n > 1 else 0.0


def _by_parts(rows: DataFrame, key: list[str], kernel, width: int) -> DataFrame:
    """``n, m, xx, yy, xy`` of blocks of any size: every two parts of a block meet in a task of their own."""
    def pack(table: pa.Table) -> pa.Table:
        f = matrix(table.column("f").combine_chunks(), width)
        out = table.select([*key, "side", "blk"]).slice(0, 1)
        return out.append_column("packed", pa.array([f.tobytes()], pa.binary())).append_column("n", pa.array([len(f)], pa.int64()))

    # parts of the second side are numbered after those of the first
    part = F.pmod("h", "parts") + F.when(F.col("side") == "y", F.col("parts")).otherwise(0)
    dealt = rows.select(*key, "side", part.alias("blk"), "f")
    kinds = "__blk bigint, __none boolean, "
    packed = materialize(dealt.groupBy(*key, "blk").applyInArrow(pack, f"{kinds}side string, blk bigint, packed binary, n bigint"), "parts")
    others = packed.groupBy(*key).agg(F.collect_list("blk").alias("others"))  # numbers only
    sent = packed.join(others, key).select(*key, "side", "blk", "packed", F.lit(True).alias("wide"), F.explode("others").alias("other"))
    pairs = sent.select("*", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q")).drop("other")
    sums = pair_sums(pairs, kernel, width, tuple(key), kinds).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("xx", "yy", "xy")])
    sizes = packed.groupBy(*key).agg(*[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(c) for s, c in (("x", "n"), ("y", "m"))])
    return sizes.join(sums, key).select("n", "m", "xx", "yy", "xy")


def mmd_rbf_linear(
    x: DataFrame, y: DataFrame, bandwidth2: float | None = None, features: str = "features", index: str = "global_index",
    rows: int = BLOCK_ROWS, block: Column | None = None, part_rows: int = PART_ROWS,
) -> DataFrame:
    """``n, m, blocks, mmd2, std_error, bandwidth2, unused_rows``.

    Without ``bandwidth2`` it is the mean squared distance of the pooled rows. ``block`` deals the rows in place of a hash of
    ``index``. A block with fewer than two rows of a side gives no estimate; its rows are counted in ``unused_rows``. With one
    block the error is null, with none the estimate too. If all rows are equal the bandwidth is 0 and the kernel 1. Blocks with
    more than ``part_rows`` rows are cut into parts of about so many, whose pairs go to different tasks.
    """
    require(rows >= 2, "a block needs two rows of each side")
    width = feature_width(x, features)
    if bandwidth2 is None:
        bandwidth2 = mean_sq_distance(x.select(features).unionByName(y.select(features)), features)
    require(bandwidth2 >= 0, "the bandwidth must not be negative")
    if block is None:
        blocks = max(1, min(x.count(), y.count()) // rows)
        block = F.pmod(F.xxhash64(index), F.lit(blocks))
    sides = [df.select(F.lit(side).alias("side"), block.cast("bigint").alias("blk"), F.col(features).cast("array<double>").alias("f"), F.xxhash64(index, F.lit("part")).alias("h")) for side, df in zip("xy", (x, y))]
    both, kernel = sides[0].unionByName(sides[1]), rbf_kernel(bandwidth2)

    def estimate(table: pa.Table) -> pa.Table:
        f, side = matrix(table.column("f").combine_chunks(), width), np.array(table.column("side").to_pylist())
        a, b = f[side == "x"], f[side == "y"]
        n, m = len(a), len(b)
        sums = [kernel_total(kernel, *pair) for pair in ((a, a, True), (b, b, True), (a, b, False))]
        return pa.table({"n": [n], "m": [m]} | {c: [v] for c, v in zip(("xx", "yy", "xy"), sums, strict=True)})

    large = both.groupBy(F.coalesce("blk", F.lit(0)).alias("__blk"), F.col("blk").isNull().alias("__none")).count().where(F.col("count") > part_rows)
    large = materialize(large.select("__blk", "__none", F.ceil(F.col("count") / part_rows).alias("parts")), "large_blocks")
    sums = "n bigint, m bigint, xx double, yy double, xy double"
    if large.isEmpty():
        found = both.groupBy("blk").applyInArrow(estimate, sums)
    else:
        keyed = both.withColumn("__blk", F.coalesce("blk", F.lit(0))).withColumn("__none", F.col("blk").isNull())
        large, key = broadcast_if_small(large), ["__blk", "__none"]
        whole = keyed.join(large, key, "left_anti").groupBy(*key).applyInArrow(estimate, sums)
        found = whole.unionByName(_by_parts(keyed.join(large, key), key, kernel, width))

    def mean(c: str, *sizes: Column):
        return F.col(c) / (sizes[0].cast("double") * sizes[1])

    n, m = F.col("n"), F.col("m")
    value = mean("xx", n, n - 1) + mean("yy", m, m - 1) - 2 * mean("xy", n, m)
    found = found.select("n", "m", F.when((n >= 2) & (m >= 2), value).alias("value"))
    lost = F.when(F.col("value").isNull(), F.col("n") + F.col("m")).otherwise(0)
    return found.agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("value").alias("blocks"), F.avg("value").alias("mmd2"),
        (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("std_error"), F.lit(bandwidth2).alias("bandwidth2"),
        F.sum(lost).alias("unused_rows"),
    )
