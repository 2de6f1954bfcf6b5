"""The nearest training row of every generated row, exactly, and the rates of memorised and near-duplicate rows.

1. Rows get a few coordinates: projections on the leading principal directions of the training rows, and the length of what
   is left. No two rows are closer than their coordinates, so a distance of coordinates is a bound on the true one.
2. Training rows are range-partitioned along their coordinates: a tree of cuts, balanced on a bounded sample, places every
   row in a cell. Cells that stay large (copies, dense spots) are dealt to several blocks. Each block keeps its bounding box.
3. Neighbouring blocks form groups, so that a generated row is copied once for many blocks. It first meets the group whose
   boxes are nearest, which gives it a distance to beat, then the other groups with a box that is not farther than that.
   Inside a group it meets its nearest block, then those not farther than the best distance, by matrix products; what these
   leave in doubt is taken directly.

Only rows close to their training set prune well; far ones meet more blocks, at worst all, and the result stays exact. What is
broadcast is bounded by the number of blocks (at most ``CELLS`` and a half) and of directions, whatever the tables hold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.functions.batches import list_column, matrix
from shardloom.operators.block_pairs import squared_distances
from shardloom.operators.moments import feature_width, moments
from shardloom.session import materialize, require

#: Principal directions behind the coordinates.
DIRECTIONS = 12
#: Training rows aimed at per block, and the most cells; with more rows than both allow, blocks hold more.
BLOCK_ROWS = 4096
CELLS = 1 << 14
#: Sampled training rows per cell, for balance only.
SAMPLE_PER_CELL = 8
#: Training rows aimed at per group of blocks, and the most bytes of their features.
GROUP_ROWS, GROUP_BYTES = 1 << 15, 32 << 20
#: Groups that a generated row meets first.
FIRST_GROUPS = 1
#: Generated rows that meet one copy of a group.
CHUNK_ROWS = 8192
#: Cells of a tile of bounds, and rows of each side of a tile of distances.
_TILE, _SIDE = 1 << 20, 384
#: Share of the squared lengths by which a bound may be off.
_ROUNDING = 1e-11


def _frame(real: DataFrame, features: str, directions: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal directions (columns) of the training rows."""
    rows = moments(real, features, strict=False).orderBy("i").collect()  # one row per feature
    mean = np.array([r["mu"] for r in rows])
    if rows[0]["sigma"] is None:
        return mean, np.zeros((len(mean), 0))
    _, vectors = np.linalg.eigh(np.array([r["sigma"] for r in rows]))
    return mean, vectors[:, ::-1][:, : min(directions, len(mean))]


def _with_coordinates(df: DataFrame, index: str, features: str, mean: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """``id, f, y``: the projections and the length of the rest."""
    def run(batches):
        for batch in batches:
            x = matrix(batch.column("f"), len(mean))
            if not np.isfinite(x).all():
                raise ValueError("features must be finite")
            centred = x - mean
            z = centred @ vectors
            rest = np.sqrt(np.square(centred - z @ vectors.T).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), list_column(x, pa.float64()), list_column(np.column_stack([z, rest]), pa.float64())], ["id", "f", "y"]
            )

    rows = df.select(F.col(index).cast("bigint").alias("id"), F.col(features).alias("f"))
    return rows.mapInArrow(run, "id bigint, f array<double>, y array<double>")


def _cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and cut of every inner node of a tree: the widest axis at its median. A node of equal rows sends all to the left."""
    axis, cut = np.zeros((1 << depth) - 1, dtype=np.int64), np.full((1 << depth) - 1, np.inf)
    parts = {0: sample}
    for node in range(len(axis)):
        rows = parts.pop(node)
        right = np.zeros(len(rows), dtype=bool)
        if len(rows) > 1:
            spread = rows.max(axis=0) - rows.min(axis=0)
            a = int(np.argmax(spread))
            if spread[a] > 0:
                ordered = np.sort(rows[:, a])
                at = ordered[(len(rows) - 1) // 2]
                at = at if at < ordered[-1] else ordered[ordered < at][-1]
                axis[node], cut[node] = a, at
                right = rows[:, a] > at
        parts[2 * node + 1], parts[2 * node + 2] = rows[~right], rows[right]
    return axis, cut


def _cell_of(y: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node = np.zeros(len(y), dtype=np.int64)
    while len(axis) and node[0] < len(axis):  # all rows reach a level together
        node = 2 * node + 1 + (y[np.arange(len(y)), axis[node]] > cut[node])
    return node - len(axis)


def _blocks(real: DataFrame, width: int, dims: int, block: int, cells: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Training rows with their ``blk`` and ``grp``, the first block of each group, and the blocks' boxes."""
    n = real.count()
    block = max(block, -(-n // cells))
    depth = min(max(0, math.ceil(math.log2(max(1, n / block)))), int(math.log2(cells)))
    picked = real.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CELL << depth).select("y").collect() if depth else []
    axis, cut = _cuts(np.array([r["y"] for r in picked], dtype=np.float64).reshape(len(picked), width), depth)

    def place(batches):
        for batch in batches:
            y = matrix(batch.column("y"), width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_cell_of(y, axis, cut), pa.int64())], [*batch.schema.names, "cell"])

    placed = materialize(real.mapInArrow(place, "id bigint, f array<double>, y array<double>, cell bigint"), "cells")
    sizes = placed.groupBy("cell").count().select("cell", F.ceil(F.col("count") / (2 * block)).cast("int").alias("parts"))  # one row per cell
    rows = placed.join(F.broadcast(sizes), "cell").select(
        (F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts"))).alias("blk"), "id", "f", "y"
    )
    rows = materialize(rows, "blocks")
    ends = [f(F.get("y", F.lit(i))) for f in (F.min, F.max) for i in range(width)]
    found = rows.groupBy("blk").agg(F.count("*").alias("n"), F.array(*ends[:width]).alias("low"), F.array(*ends[width:]).alias("high")).orderBy("blk").collect()
    before = np.cumsum([r["n"] for r in found]) - [r["n"] for r in found]
    _, starts, group = np.unique(before // max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * dims))), return_index=True, return_inverse=True)
    groups = real.sparkSession.createDataFrame([(r["blk"], int(g)) for r, g in zip(found, group, strict=True)], "blk bigint, grp bigint")
    return rows.join(F.broadcast(groups), "blk"), starts, np.array([r["low"] for r in found]), np.array([r["high"] for r in found])


def _box_bounds(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from each row to each box."""
    out = np.zeros((len(y), len(low)))
    for i in range(y.shape[1]):
        gap = np.maximum(low[:, i] - y[:, i, None], y[:, i, None] - high[:, i])
        out += np.square(np.maximum(gap, 0.0))
    return out


def _visits(rows: DataFrame, width: int, dims: int, boxes, first: bool) -> DataFrame:
    """``grp, id, f, y, best``: the nearest group of each row, or all others that may hold something as near as ``best``.

    Of several equally near groups, rows take different ones.
    """
    shared = rows.sparkSession.sparkContext.broadcast(boxes)

    def run(batches):
        starts, lows, highs, longest = shared.value
        step = max(1, _TILE // max(1, len(lows)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                bounds = np.minimum.reduceat(_box_bounds(matrix(part.column("y"), width), lows, highs), starts, axis=1)
                if first:
                    k = min(FIRST_GROUPS, len(starts))
                    turn = (np.arange(len(starts)) + part.column("id").to_numpy(zero_copy_only=False)[:, None]) % len(starts)
                    c = np.lexsort((turn, bounds), axis=1)[:, :k].reshape(-1)
                    r = np.repeat(np.arange(part.num_rows), k)
                else:
                    best, met = part.column("best").to_numpy(zero_copy_only=False), part.column("seen")
                    seen = np.zeros(bounds.shape, dtype=bool)
                    seen[np.repeat(np.arange(part.num_rows), met.value_lengths().to_numpy()), met.flatten().to_numpy()] = True
                    doubt = _ROUNDING * (np.square(matrix(part.column("f"), dims)).sum(axis=1) + longest)
                    r, c = np.nonzero((bounds <= (best + doubt)[:, None]) & ~seen)
                took = part.take(pa.array(r))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()), *(took.column(k) for k in ("id", "f", "y", "best"))], ["grp", "id", "f", "y", "best"]
                )

    return rows.mapInArrow(run, "grp bigint, id bigint, f array<double>, y array<double>, best double")


class _Search:
    """Squared distance, id and number of distances taken directly for each row of ``f``, none farther than ``best``."""

    def __init__(self, f: np.ndarray, best: np.ndarray, longest: float) -> None:
        self.f, self.best, self.who = f, best.copy(), np.full(len(f), -1, dtype=np.int64)
        self.taken, self.doubt = np.zeros(len(f), dtype=np.int64), _ROUNDING * (np.square(f).sum(axis=1) + longest)
        self.scratch: dict = {}

    def meet(self, rows: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Lets some of the rows meet ``x``."""
        for at in range(0, len(rows), _SIDE):
            for to in range(0, len(x), _SIDE):
                self._tile(rows[at : at + _SIDE], x[to : to + _SIDE], ids[to : to + _SIDE])

    def _tile(self, rows: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        d, doubt = squared_distances(self.f[rows], x, self.scratch), self.doubt[rows]
        least = d.min(axis=1)
        near = np.flatnonzero(least <= self.best[rows] + doubt)
        if not len(near):
            return
        r, c = np.nonzero(d[near] <= (np.minimum(least[near], self.best[rows[near]]) + 2 * doubt[near])[:, None])
        at = rows[near[r]]
        exact = np.square(self.f[at] - x[c]).sum(axis=1)
        np.add.at(self.taken, at, 1)
        # of each row the least distance, then the least id
        order = np.lexsort((ids[c], exact, at))
        order = order[np.append(True, at[order][1:] != at[order][:-1])]
        at, exact, who = at[order], exact[order], ids[c[order]]
        better = (exact < self.best[at]) | ((exact == self.best[at]) & ((self.who[at] < 0) | (who < self.who[at])))
        self.best[at[better]], self.who[at[better]] = exact[better], who[better]


def _closest(f, y, best, x, coordinates, ids, blocks, longest) -> _Search:
    """Rows of ``f`` against the blocks of a group: the nearest one, then those whose boxes are not farther than the best."""
    order = np.argsort(blocks, kind="stable")
    x, coordinates, ids, blocks = x[order], coordinates[order], ids[order], blocks[order]
    starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    ends = np.append(starts[1:], len(blocks))
    low, high = (u.reduceat(coordinates, starts, axis=0) for u in (np.minimum, np.maximum))
    search, step = _Search(f, best, longest), max(1, _TILE // len(starts))
    for at in range(0, len(f), step):
        rows = np.arange(at, min(len(f), at + step))
        bounds = _box_bounds(y[rows], low, high)
        first = bounds.argmin(axis=1)
        for turn in (0, 1):
            for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
                mine = (first == k) != bool(turn)
                asked = rows[mine & (bounds[:, k] <= search.best[rows] + search.doubt[rows])]
                search.meet(asked, x[a:b], ids[a:b])
    return search


def _meet(visits: DataFrame, rows: DataFrame, width: int, dims: int, longest: float, chunk: int) -> DataFrame:
    """``id, grp, nearest, d2, verified`` of every visit. A group with many visitors is copied once per chunk of them."""
    visits = materialize(visits, "visits")  # counted and sent
    counts = visits.groupBy("grp").count()  # at most one row per group
    chunks = materialize(counts.select("grp", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "chunks")
    visitors = visits.join(F.broadcast(chunks), "grp").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks")))
    copies = rows.join(F.broadcast(chunks), "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks").cast("bigint") - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["id", "grp", "nearest", "d2", "verified"]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.float64() if c == "d2" else pa.int64()) for c in names})
        f, y = matrix(left.column("f").combine_chunks(), dims), matrix(left.column("y").combine_chunks(), width)
        x, z = matrix(right.column("f").combine_chunks(), dims), matrix(right.column("y").combine_chunks(), width)
        ids, blocks = right.column("id").to_numpy(), right.column("blk").to_numpy()
        found = _closest(f, y, left.column("best").to_numpy(), x, z, ids, blocks, longest)
        columns = (left.column("id"), left.column("grp"), pa.array(found.who, mask=found.who < 0), pa.array(found.best), pa.array(found.taken))
        return pa.table(dict(zip(names, columns, strict=True)))

    return visitors.drop("chunks").groupBy("grp", "chunk").cogroup(copies.drop("chunks").groupBy("grp", "chunk")).applyInArrow(
        search, "id bigint, grp bigint, nearest bigint, d2 double, verified bigint"
    )


def nearest_training_rows(
    gen: DataFrame, real: DataFrame, within: float = math.inf, features: str = "features", index: str = "global_index",
    block: int = BLOCK_ROWS, cells: int = CELLS, directions: int = DIRECTIONS, chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """``index, nearest, distance, verified`` for every generated row: its nearest training row (ties to the least index) by
    Euclidean distance, and how many distances were taken directly, the others being ruled out by bounds or matrix products.

    Rows farther than ``within`` from all training rows have a null ``nearest`` and ``distance``; a small radius saves most of
    the work. Indexes are whole numbers, those of generated rows distinct. Features must be finite; the training table must
    not be empty, the generated one may be.
    """
    require(within >= 0, "the radius must not be negative")
    dims = feature_width(real, features)
    mean, vectors = _frame(real, features, directions)
    width = vectors.shape[1] + 1
    rows, starts, low, high = _blocks(_with_coordinates(real, index, features, mean, vectors), width, dims, block, cells)
    longest = float(rows.agg(F.max(F.aggregate("f", F.lit(0.0), lambda s, v: s + v * v))).first()[0])
    queries = materialize(_with_coordinates(gen, index, features, mean, vectors).withColumn("best", F.lit(within * within)), "queries")
    boxes = (starts, low, high, longest)
    first = materialize(_meet(_visits(queries, width, dims, boxes, True), rows, width, dims, longest, chunk), "first")
    known = queries.drop("best").join(first.groupBy("id").agg(F.min("d2").alias("best"), F.collect_list("grp").alias("seen")), "id")
    known = materialize(known, "known")
    rest = _meet(_visits(known, width, dims, boxes, False), rows, width, dims, longest, chunk)
    # distance first, then the least id; a visit that found nothing has no nearest row
    best = F.min(F.when(F.col("nearest").isNotNull(), F.struct("d2", "nearest"))).alias("b")
    found = first.unionByName(rest).groupBy("id").agg(best, F.sum("verified").alias("verified"))
    return found.select(F.col("id").alias(index), F.col("b.nearest").alias("nearest"), F.sqrt("b.d2").alias("distance"), "verified")


def memorisation(
    gen: DataFrame, real: DataFrame, radius: float, features: str = "features", index: str = "global_index", **how
) -> DataFrame:
    """``n, copies, near, near_rate, mean_distance, verified_share``: generated rows that equal a training row, those within
    ``radius`` of one, the mean distance to the nearest one, and the share of all pairs whose distance was taken directly."""
    found = nearest_training_rows(gen, real, features=features, index=index, **how)
    n_real = real.count()
    rows = found.agg(
        F.count("*").alias("n"), F.count_if(F.col("distance") == 0).alias("copies"), F.count_if(F.col("distance") <= radius).alias("near"),
        F.avg("distance").alias("mean_distance"), (F.sum("verified") / n_real).alias("__share"),
    )
    share = lambda c: F.when(F.col("n") > 0, c / F.col("n"))
    return rows.select("n", "copies", "near", share(F.col("near")).alias("near_rate"), "mean_distance", share(F.col("__share")).alias("verified_share"))


def near_duplicate_rate(
    gen: DataFrame, real: DataFrame, radius: float, features: str = "features", index: str = "global_index", **how
) -> DataFrame:
    """``n, near, near_rate`` without the distances beyond ``radius``: blocks farther than that are never met."""
    found = nearest_training_rows(gen, real, radius, features, index, **how)
    rows = found.agg(F.count("*").alias("n"), F.count("nearest").alias("near"))
    return rows.select("n", "near", F.when(F.col("n") > 0, F.col("near") / F.col("n")).alias("near_rate"))
