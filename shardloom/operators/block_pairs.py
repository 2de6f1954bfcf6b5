"""Every pair of rows of two feature tables, met block by block.

Rows are packed into blocks by a hash of their index, each block is sent to the pairs of blocks it belongs
to, and the two blocks of a pair meet by equi-join key. Functions see two matrices and return a few numbers;
row pairs are never stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.functions.batches import matrix
from shardloom.functions.joins import with_row
from shardloom.functions.ordering import ordered_bucket, running_before
from shardloom.session import broadcast_if_small, materialize

#: Rows of a tile: a few tiles of distances stay in a core's cache.
_TILE = 384
_MAX_BLOCK_BYTES = 64 << 20
#: Values behind the first guess of a median, its reach in ranks to either side, and the bins of a pass over all pairs.
_SAMPLE_BYTES, _SAMPLE_ROWS, _REACH, _BINS = 4 << 20, 2048, 0.04, 1 << 14
#: Distances that may be left to the last pass; after so many passes more are.
_LEFT, _PASSES = 1 << 22, 4


def block_rows(n: int, width: int, parallelism: int) -> int:
    """Rows per block: enough pairs to keep every core busy, blocks no larger than a task should hold.

    Fewer, larger blocks mean fewer copies, as each block goes to every other.
    """
    most = max(256, _MAX_BLOCK_BYTES // (8 * width))
    wanted = math.ceil(n / math.ceil(2 * math.sqrt(parallelism)))
    return max(256, min(most, wanted))


def pack_blocks(x: DataFrame, y: DataFrame, features: str, index: str, width: int, block: int | None) -> DataFrame:
    """``(side, blk, packed, wide, n)``, written once because several passes read it.

    Values keep the precision they are stored in (``wide`` for doubles) and are widened where they are used.
    """
    counts = [df.count() for df in (x, y)]
    block = block or block_rows(max(counts), width, x.sparkSession.sparkContext.defaultParallelism)
    blocks = [max(1, -(-n // block)) for n in counts]
    firsts = [0, blocks[0]]
    rows = [
        df.select(
            F.lit(side).alias("side"),
            (F.pmod(F.xxhash64(index), F.lit(count)) + F.lit(first)).cast("int").alias("blk"),
            F.col(features).alias("f"),
        )
        for side, df, count, first in zip("xy", (x, y), blocks, firsts)
    ]

    wide = any(df.schema[features].dataType.elementType.typeName() != "float" for df in (x, y))
    kind = np.float64 if wide else np.float32

    def pack(table: pa.Table) -> pa.Table:
        m = matrix(table.column("f").combine_chunks(), width).astype(kind)
        return pa.table(
            {"side": table.column("side").slice(0, 1), "blk": table.column("blk").slice(0, 1),
             "packed": pa.array([m.tobytes()], pa.binary()), "wide": [wide], "n": [len(m)]}
        )

    packed = rows[0].unionByName(rows[1]).groupBy("blk").applyInArrow(
        pack, "side string, blk int, packed binary, wide boolean, n bigint"
    )
    return materialize(packed, "blocks")


def side_counts(blocks: DataFrame) -> DataFrame:
    def rows(side: str):
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0))

    return blocks.agg(rows("x").alias("n"), rows("y").alias("m"))


def pair_up(blocks: DataFrame) -> DataFrame:
    """Every block once for each pair ``(p, q)``, p <= q, it belongs to."""
    numbers = blocks.select("blk")
    last = numbers.agg(F.max("blk")).first()[0]
    sent = blocks.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(last)))).select(
        F.least("blk", "__other").alias("p"), F.greatest("blk", "__other").alias("q"), "side", "blk", "packed", "wide"
    )
    if numbers.count() == last + 1:
        return sent
    # a hash may leave a block number unused; pairs with it have one block only and are left out
    for end in ("p", "q"):
        sent = sent.join(broadcast_if_small(numbers.select(F.col("blk").alias(end))), end)
    return sent


def read_block(packed: pa.Scalar, wide: bool, width: int) -> np.ndarray:
    kind = np.float64 if wide else np.float32
    return np.frombuffer(packed.as_buffer(), dtype=kind).reshape(-1, width).astype(np.float64)


def over_pairs(pairs: DataFrame, fn, schema: str, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Run ``fn(side_p, P, side_q, Q, same)`` once per unordered pair of blocks; it returns columns.

    ``schema`` names those and, first, the columns ``by``, within which blocks are numbered.
    """
    def meet(table: pa.Table) -> pa.Table:
        facts = table.select(["blk", "side", "wide"]).to_pylist()
        ends = sorted(range(len(facts)), key=lambda i: facts[i]["blk"])
        p, q = ends[0], ends[-1]
        packed = table.column("packed").combine_chunks()

        def block(i: int) -> np.ndarray:
            return read_block(packed[i], facts[i]["wide"], width)

        a = block(p)
        out = pa.table(fn(facts[p]["side"], a, facts[q]["side"], a if p == q else block(q), p == q))
        for at, name in enumerate(by):
            out = out.add_column(at, name, table.column(name).take([0] * len(out)))
        return out

    return pairs.groupBy(*by, "p", "q").applyInArrow(meet, schema)


def _tiles(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pieces of a pair of blocks; of a block with itself only the upper half, diagonal pieces marked."""
    for i in range(0, len(a), _TILE):
        for j in range(i if same else 0, len(b), _TILE):
            yield a[i : i + _TILE], b[j : j + _TILE], same and i == j


def squared_distances(a: np.ndarray, b: np.ndarray, scratch: dict | None = None) -> np.ndarray:
    """max(|a|² + |b|² - 2 a·b, 0) for all rows of two matrices.

    With ``scratch`` the result lies in memory it keeps, until the next call: fresh pages for every tile cost more than the
    products.
    """
    size = len(a) * len(b)
    held = {} if scratch is None else scratch
    if "out" not in held or len(held["out"]) < size:
        held["out"], held["cross"] = np.empty(size), np.empty(size)
    out, cross = (held[k][:size].reshape(len(a), len(b)) for k in ("out", "cross"))
    np.add(np.sum(a * a, axis=1)[:, None], np.sum(b * b, axis=1)[None, :], out=out)
    np.matmul(2.0 * a, b.T, out=cross)
    out -= cross
    return np.maximum(out, 0.0, out=out)


def rbf_kernel(bandwidth2: float):
    """exp(-d² / 2b²) of all rows of two matrices; 1 for a bandwidth of 0."""
    scratch: dict = {}

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d2 = squared_distances(a, b, scratch)
        if bandwidth2 <= 0:
            return np.ones(d2.shape)
        d2 /= -2.0 * bandwidth2
        return np.exp(d2, out=d2)

    return kernel


def kernel_total(kernel, a: np.ndarray, b: np.ndarray, same: bool) -> float:
    """Sum of the kernel over the pairs of rows of two blocks, or over the ordered pairs of different rows of one."""
    total = 0.0
    for p, q, diagonal in _tiles(a, b, same):
        k = kernel(p, q)
        if diagonal:
            np.fill_diagonal(k, 0.0)
        total += float(k.sum()) * (2.0 if same and not diagonal else 1.0)
    return total


def pair_sums(pairs: DataFrame, kernel, width: int, by: tuple[str, ...] = (), kinds: str = "") -> DataFrame:
    """``by..., xx, yy, xy`` of every pair of blocks: kernel sums over ordered pairs of different rows."""
    def sums(side_p, a, side_q, b, same):
        total = kernel_total(kernel, a, b, same)
        within = side_p == side_q
        out = {"xx": [0.0], "yy": [0.0], "xy": [0.0]}
        out[side_p + side_q if within else "xy"] = [total * (2.0 if within and not same else 1.0)]
        return out

    return over_pairs(pairs, sums, f"{kinds}xx double, yy double, xy double", width, by)


def kernel_sums(blocks: DataFrame, pairs: DataFrame, kernel, width: int) -> DataFrame:
    """One row ``n, m, xx, yy, xy``: kernel sums over ordered pairs, the diagonal left out of xx and yy."""
    total = pair_sums(pairs, kernel, width).agg(*[F.sum(c).alias(c) for c in ("xx", "yy", "xy")])
    return with_row(total, side_counts(blocks))


def sample_rows(blocks: DataFrame, width: int) -> np.ndarray:
    """A few rows of every block."""
    most = max(2, min(_SAMPLE_ROWS, _SAMPLE_BYTES // (8 * width)))
    each = -(-most // max(1, blocks.count()))
    size = F.when(F.col("wide"), 8).otherwise(4) * width * each
    rows = blocks.orderBy("blk").limit(most).select("wide", F.expr("packed").substr(F.lit(1), size.cast("int")).alias("packed")).collect()
    sample = [np.frombuffer(r["packed"], dtype=np.float64 if r["wide"] else np.float32).reshape(-1, width).astype(np.float64) for r in rows]
    return np.concatenate(sample)[:_SAMPLE_ROWS] if sample else np.zeros((0, width))


def _guess(blocks: DataFrame, width: int) -> tuple[float, float]:
    """A range that is likely to hold the median, from the pairs of a few rows of every block."""
    x = sample_rows(blocks, width)
    d = squared_distances(x, x)[np.triu_indices(len(x), k=1)]
    d = d[(d > 0) & np.isfinite(d)]
    if len(d) < 1000:
        return 0.0, math.inf
    low, high = np.quantile(d, [0.5 - _REACH, 0.5 + _REACH])
    return float(low), float(high)


def median_sq_distance(pairs: DataFrame, width: int, blocks: DataFrame | None = None) -> float:
    """Exact median of the positive squared distances over unordered pairs; 1.0 when there is none.

    A pass over all pairs counts the distances below a range and those in each of its bins; the first range is a guess from
    a few rows of ``blocks``, and a wrong or a wide one costs another pass. The last pass hands on the distances of the bins
    that hold the middle ranks. A pair costs a product and a comparison; only pairs in the range are binned.
    """
    def positive(a, b, same):
        scratch: dict = {}
        for p, q, diagonal in _tiles(a, b, same):
            d = squared_distances(p, q, scratch)
            yield np.triu(d, k=1) if diagonal else d  # of zeros none is counted

    def codes(d: np.ndarray, low: float, high: float) -> np.ndarray:
        scale = _BINS / (high - low) if high > low else 0.0
        scale = scale if math.isfinite(scale) else 0.0
        return np.minimum(((d - low) * scale).astype(np.int64), _BINS - 1)

    def count_bins(low: float, high: float) -> DataFrame:
        """Code -1 for positive ones below, -2 for all positive ones; ``v`` is the greatest finite distance."""
        def count(side_p, a, side_q, b, same):
            bins, below, all_, top = np.zeros(_BINS, dtype=np.int64), 0, 0, 0.0
            for d in positive(a, b, same):
                all_ += np.count_nonzero(d > 0)
                below += np.count_nonzero((d > 0) & (d < low)) if low > 0 else 0
                greatest = d.max(initial=0.0)
                top = max(top, float(greatest if np.isfinite(greatest) else d[np.isfinite(d)].max(initial=0.0)))
                if high < math.inf:
                    bins += np.bincount(codes(d[(d >= low) & (d <= high) & (d > 0)], low, high), minlength=_BINS)
            used = np.flatnonzero(bins)
            return {
                "code": pa.array(np.concatenate([[-2, -1], used]), pa.int64()), "v": pa.array(np.full(len(used) + 2, top)),
                "n": pa.array(np.concatenate([[all_, below], bins[used]]), pa.int64()),
            }

        found = over_pairs(pairs, count, "code bigint, v double, n bigint", width)
        return found.groupBy("code").agg(F.max("v").alias("v"), F.sum("n").alias("n"))  # as many rows as bins

    low, high = (0.0, math.inf) if blocks is None else _guess(blocks, width)
    for turn in range(_PASSES):
        table = count_bins(low, high).orderBy("code").toPandas()
        if not len(table) or not table["n"][0]:
            return 1.0
        total, base, top = int(table["n"][0]), int(table["n"][1]), float(table["v"].max())
        ranks = [(total - 1) // 2, total // 2]
        reach = base + table["n"][2:].cumsum().to_numpy()
        end = int(reach[-1]) if len(reach) else base
        if total <= _LEFT and math.isinf(high):
            low, high, inside, base = 0.0, math.inf, None, 0
            break
        if ranks[0] >= base and ranks[1] < end:
            at = np.searchsorted(reach, ranks, side="right")
            inside = sorted({int(c) for c in table["code"][2:].to_numpy()[at]})
            base = int(reach[at[0] - 1]) if at[0] else base
            step = (high - low) / _BINS
            narrow = low + step * inside[0], low + step * (inside[-1] + 1)
            if int(reach[at[1]]) - base <= _LEFT or turn == _PASSES - 1 or not low < narrow[0] < narrow[1] < high:
                break
            # one bin more on either side, for rounding
            low, high = max(low, narrow[0] - step), min(high, narrow[1] + step)
        elif not top or (ranks[1] >= end and top <= high < math.inf):
            return 1.0  # infinite
        else:
            low, high = (0.0, top) if turn or not 0 < low < high < math.inf else (low / 2, min(2 * high, top))
    else:
        low, high, inside, base = 0.0, math.inf, None, 0

    def pick(side_p, a, side_q, b, same):
        seen: dict[float, int] = {}
        for d in positive(a, b, same):
            values = d[(d >= low) & (d <= high) & (d > 0)]
            if inside is not None:
                values = values[np.isin(codes(values, low, high), inside)]
            for v, n in zip(*np.unique(values, return_counts=True), strict=True):
                seen[float(v)] = seen.get(float(v), 0) + int(n)
        return {"v": pa.array(list(seen), pa.float64()), "n": pa.array(list(seen.values()), pa.int64())}

    values = materialize(over_pairs(pairs, pick, "v double, n bigint", width).groupBy("v").agg(F.sum("n").alias("n")), "distances")
    median = float(np.mean([row["v"] for row in rows_at_ranks(values, [r - base for r in sorted(set(ranks))])]))
    return median if np.isfinite(median) and median > 0 else 1.0


def rows_at_ranks(table: DataFrame, ranks: list[int]) -> list:
    """For each 0-based rank the (v, n, ahead) row that covers it: one or two rows, whatever the size."""
    placed = running_before(table, ["v"], ordered_bucket(table, "v"), F.col("n"), name="ahead")
    hit = F.lit(False)
    for r in ranks:
        hit = hit | ((F.col("ahead") <= r) & (F.col("ahead") + F.col("n") > r))
    found = placed.where(hit).limit(len(ranks)).collect()
    return [next(x for x in found if x["ahead"] <= r < x["ahead"] + x["n"]) for r in ranks]
