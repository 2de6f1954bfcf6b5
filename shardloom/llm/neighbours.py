"""Approximate nearest neighbours by collision counting over query-centred windows.

Every block of vectors keeps, for each of ``PROJECTIONS`` random directions, the sorted array of its projections. A query
opens a window around its own projection in each array and widens all windows together (virtual rehashing: the window of a
larger radius contains that of a smaller one, so only what is new is counted). A vector that lies in at least half of the
windows is verified by its exact distance. Widening stops when the k-th verified distance is so small that a nearer vector
would have been in half of the windows with a chance of about 97 %, or when all vectors have been verified.

Rows meet as blocks of vectors with chunks of queries, both of bounded size; each block gives at most k rows per query.

Null or odd input: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
different lengths are never compared. Rows with a query's id are its own; a repeated query id is asked once. Ties go to
the smaller id. Further columns are not returned. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from shardloom.llm import workers
from shardloom.llm.registry import query, table

PROJECTIONS = 128
BLOCK_ROWS = 8_192
CHUNK_QUERIES = 1_024
FOUND = "query_id long, vec_id long, score double"
#: Half a window, in units of the distance, at which a vector falls into a window with chance 0.5 + 2 * sigma.
REACH = 0.82
WIDEN = 1.4
#: Queries of a chunk that widen their windows together.
TOGETHER = 128


class _Asked:
    """One query: collisions of each row of the block, and what has been verified. Its own rows count as done."""

    def __init__(self, n: int, vector: np.ndarray, own: np.ndarray) -> None:
        self.hits, self.done, self.vector = np.zeros(n, dtype=np.int64), own.copy(), vector
        self.rows, self.distances = np.zeros(0, dtype=np.int64), np.zeros(0)

    def best(self, ids: np.ndarray, k: int, near: float, whole: bool):
        """The k nearest if they all are within ``near``, or if there is nothing more to verify; else None."""
        if not whole and (len(self.rows) < k or np.partition(self.distances, k - 1)[k - 1] > near):
            return None
        chosen = np.lexsort((ids[self.rows], self.distances))[:k]
        return ids[self.rows[chosen]], self.distances[chosen]


class CollisionIndex:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 7) -> None:
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        self.directions = directions
        projected = self.vectors @ directions
        self.order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.sort(projected, axis=0).T)
        self.step = float(projected.std(axis=0).mean()) / 2 or 1.0

    def _bounds(self, centres: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Windows of all queries in all arrays, as (projection, query)."""
        low = [np.searchsorted(a, c - half, "left") for a, c in zip(self.sorted, centres.T, strict=True)]
        high = [np.searchsorted(a, c + half, "right") for a, c in zip(self.sorted, centres.T, strict=True)]
        return np.stack(low), np.stack(high)

    def nearest(self, query_ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and distances of the k nearest found of each query, nearest first."""
        n, vectors = len(self.ids), vectors.astype(np.float64)
        centres = vectors @ self.directions
        low = high = self._bounds(centres, 0.0)[0]
        states = [_Asked(n, v, self.ids == q) for q, v in zip(query_ids, vectors, strict=True)]
        found: list = [None] * len(states)
        active, half = np.arange(len(states)), self.step
        while len(active):
            to_low, to_high = self._bounds(centres[active], half)
            for at, q in enumerate(active.tolist()):
                whole = self._widen(states[q], low[:, at], high[:, at], to_low[:, at], to_high[:, at])
                found[q] = states[q].best(self.ids, k, half / REACH, whole)
            more = np.array([found[q] is None for q in active.tolist()])
            low, high, active = np.minimum(low, to_low)[:, more], np.maximum(high, to_high)[:, more], active[more]
            half *= WIDEN
        return found

    def _widen(self, asked: _Asked, low, high, to_low, to_high) -> bool:
        """Counts what is new in the wider windows and verifies what has enough collisions; true if all rows are covered."""
        new = [o[a:b] for o, a, b in zip(self.order, to_low.tolist(), low.tolist(), strict=True) if b > a]
        new += [o[a:b] for o, a, b in zip(self.order, high.tolist(), to_high.tolist(), strict=True) if b > a]
        if new:
            asked.hits += np.bincount(np.concatenate(new), minlength=len(self.ids))
        fresh = np.flatnonzero((asked.hits >= PROJECTIONS // 2) & ~asked.done)
        asked.done[fresh] = True
        if len(fresh):
            gap = self.vectors[fresh] - asked.vector
            asked.rows = np.append(asked.rows, fresh)
            asked.distances = np.append(asked.distances, np.sqrt((gap * gap).sum(axis=1)))
        return bool((to_low == 0).all() and (to_high == len(self.ids)).all())


def _search(k: int):
    def run(data: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        is_query = data.column("is_query").to_numpy()
        ids = data.column("vec_id").to_numpy()
        flat = data.column("vec").combine_chunks()
        values = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        out = ([], [], [])
        if (~is_query).any():
            index = CollisionIndex(ids[~is_query], values[~is_query])
            asked = np.flatnonzero(is_query)
            for at in range(0, len(asked), TOGETHER):
                some = asked[at : at + TOGETHER]
                for q, (found, score) in zip(ids[some].tolist(), index.nearest(ids[some], values[some], k), strict=True):
                    for column, x in zip(out, (np.full(len(found), q), found, score), strict=True):
                        column.append(x)
        join = lambda xs, kind: pa.array(np.concatenate(xs) if xs else [], kind)
        return pa.table({"query_id": join(out[0], pa.int64()), "vec_id": join(out[1], pa.int64()), "score": join(out[2], pa.float64())})

    return run


def usable(vector: str):
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0)


def nearest_neighbours(
    base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding",
    block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of every query, by Euclidean distance."""
    pick = lambda df: df.where(usable(vector)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("vec")).where("vec_id IS NOT NULL")
    rows, asked = pick(base), pick(queries).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    blocks = -(-max(1, rows.count()) // block_rows)
    parts = -(-max(1, asked.count()) // chunk_queries)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    # A repeated id may not fill one block, so a vector's block also depends on the vector.
    deal = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)).cast("int")
    left = rows.select(F.lit(False).alias("is_query"), deal.alias("block"), spread(parts).alias("part"), "vec_id", "vec")
    right = asked.select(F.lit(True).alias("is_query"), own(parts).alias("part"), spread(blocks).alias("block"), "vec_id", "vec")
    met = left.unionByName(right).withColumn("width", F.size("vec"))
    found = met.groupBy("width", "block", "part").applyInArrow(workers.group(_search(k)), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))
