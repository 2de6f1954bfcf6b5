"""Precision and recall of generated features by balls around their neighbours, and the Inception Score.

Both feature tables are packed into blocks that meet pair by pair (``block_pairs``). A first pass over pairs of one side finds
the k-th neighbour distance of every row from the k nearest of each block; a second pass over pairs of different sides tells
which rows lie in a ball of the other side. Only a few numbers per row and block leave a task, never a pair of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.functions.batches import extended_schema, group_rows, key_columns, list_column, matrix
from shardloom.functions.joins import with_row
from shardloom.operators.block_pairs import pack_blocks, pair_up, side_counts, squared_distances
from shardloom.operators.moments import feature_width, vector_sums
from shardloom.session import materialize, require

#: Rows of each of two blocks compared at a time, so that a task's memory does not grow with its blocks.
_TILE = 384
#: Bits of a row's place within its block.
_PLACE_BITS = 32
#: Distances by matrix products are exact to about this share of the squared lengths; closer calls are made directly.
_ROUNDING = 1e-11


def _ends(table: pa.Table, width: int) -> list[dict]:
    """The one or two blocks of a pair, the lower number first."""
    facts = table.select([c for c in table.column_names if c not in ("packed", "radii")]).to_pylist()
    out = []
    for i in sorted(range(len(facts)), key=lambda i: facts[i]["blk"]):
        kind = np.float64 if facts[i]["wide"] else np.float32
        x = np.frombuffer(table.column("packed")[i].as_buffer(), dtype=kind).reshape(-1, width).astype(np.float64)
        radii = np.frombuffer(table.column("radii")[i].as_buffer(), dtype=np.float64) if "radii" in table.column_names else None
        out.append(facts[i] | {"x": x, "radii": radii})
    return out


def _nearest(a: np.ndarray, b: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Squared distances to the k nearest rows of ``b`` for each row of ``a``, infinite beyond the rows there are."""
    out = np.full((len(a), k), np.inf)
    lengths, scratch = np.square(b).sum(axis=1), {}
    for at in range(0, len(a), _TILE):
        rows, best = a[at : at + _TILE], out[at : at + _TILE]  # a view
        own = np.square(rows).sum(axis=1)
        for to in range(0, len(b), _TILE):
            others = b[to : to + _TILE]
            d = squared_distances(rows, others, scratch)
            if same and at == to:
                np.fill_diagonal(d, np.inf)
            kept = min(k, len(others))
            doubt = _ROUNDING * (own + lengths[to : to + _TILE].max())
            closer = np.flatnonzero(d.min(axis=1) <= best[:, -1] + doubt)
            if not len(closer):
                continue
            d = d[closer]
            near = np.argpartition(d, kept - 1, axis=1)[:, :kept]
            exact = np.square(rows[closer][:, None, :] - others[near]).sum(axis=2)
            exact[np.isinf(np.take_along_axis(d, near, axis=1))] = np.inf  # the row itself
            best[closer] = np.sort(np.concatenate([best[closer], exact], axis=1), axis=1)[:, :k]
    return out


def _inside(a: np.ndarray, b: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Rows of ``a`` in the ball of any row of ``b``; its squared radii include the border."""
    out = np.zeros(len(a), dtype=bool)
    lengths, scratch = np.square(b).sum(axis=1), {}
    for at in range(0, len(a), _TILE):
        rows = a[at : at + _TILE]
        hit, own = np.zeros(len(rows), dtype=bool), _ROUNDING * np.square(rows).sum(axis=1)
        for to in range(0, len(b), _TILE):
            left = np.flatnonzero(~hit)
            if not len(left):
                break
            others, reach = b[to : to + _TILE], radii[to : to + _TILE]
            gap = squared_distances(rows[left], others, scratch)
            gap -= reach
            doubt = own[left] + _ROUNDING * lengths[to : to + _TILE].max()
            least = gap.min(axis=1)
            hit[left[least < -doubt]] = True
            # Rows that are inside no ball for certain, and close to the border of some.
            close = np.flatnonzero(np.abs(least) <= doubt)
            r, c = np.nonzero(gap[close] <= doubt[close, None])
            r = left[close[r]]
            hit[r[np.square(rows[r] - others[c]).sum(axis=1) <= reach[c]]] = True
        out[at : at + _TILE] = hit
    return out


def _pairs(blocks: DataFrame, across: bool) -> DataFrame:
    """Pairs of blocks of different sides, or of one side."""
    last_x = blocks.where("side = 'x'").agg(F.max("blk")).first()[0]
    other = (F.col("p") <= last_x) != (F.col("q") <= last_x)
    pairs = pair_up(blocks.select("side", "blk", "packed", "wide"))
    return pairs.where(other if across else ~other)


def neighbour_radii(blocks: DataFrame, k: int, width: int) -> DataFrame:
    """``side, blk, place, radius``: squared distance of every row to its k-th neighbour of the same side.

    With fewer than k other rows it is the distance to the farthest one; a single row has radius 0.
    """
    def near(table: pa.Table) -> pa.Table:
        ends = _ends(table, width)
        p, q = ends[0], ends[-1]
        rows, found = [], []
        for one, other in [(p, q)] if p is q else [(p, q), (q, p)]:
            rows.append((one["blk"] << _PLACE_BITS) + np.arange(len(one["x"])))
            found.append(_nearest(one["x"], other["x"], k, p is q))
        sides = np.repeat(p["side"], sum(map(len, rows)))
        return pa.table({"side": pa.array(sides, pa.string()), "row": pa.array(np.concatenate(rows)), "near": list_column(np.concatenate(found), pa.float64())})

    found = _pairs(blocks, False).groupBy("p", "q").applyInArrow(near, "side string, row bigint, near array<double>")
    merged = found.groupBy("side", "row").agg(F.flatten(F.collect_list("near")).alias("near"))  # k numbers per block
    sorted_near = F.slice(F.array_sort(F.filter("near", lambda d: d < float("inf"))), 1, k)
    return merged.select(
        "side", F.shiftright("row", _PLACE_BITS).cast("int").alias("blk"), (F.col("row") % (1 << _PLACE_BITS)).alias("place"),
        F.coalesce(F.try_element_at(sorted_near, F.lit(-1)), F.lit(0.0)).alias("radius"),
    )


def precision_recall(
    gen: DataFrame, real: DataFrame, k: int = 3, features: str = "features", index: str = "global_index", block: int | None = None
) -> DataFrame:
    """``n_gen, n_real, precision, recall``: the shares of generated rows in a ball of a real row, and of real rows in a ball
    of a generated one, a ball reaching to the k-th neighbour of its own side, its border included."""
    require(k >= 1, "at least one neighbour is needed")
    width = feature_width(real, features)
    blocks = pack_blocks(gen, real, features, index, width, block)
    radii = neighbour_radii(blocks, k, width).groupBy("blk").agg(F.array_sort(F.collect_list(F.struct("place", "radius"))).alias("r"))

    def packed(batches):
        for batch in batches:
            rows = [np.array([x["radius"] for x in r]).tobytes() for r in batch.column("r").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("blk"), pa.array(rows, pa.binary())], ["blk", "radii"])

    radii = materialize(radii.mapInArrow(packed, "blk int, radii binary"), "radii")

    def cover(table: pa.Table) -> pa.Table:
        one, two = _ends(table, width)
        out = {"side": [], "row": []}
        for a, b in ((one, two), (two, one)):
            hit = np.flatnonzero(_inside(a["x"], b["x"], b["radii"]))
            out["side"] += [a["side"]] * len(hit)
            out["row"] += ((a["blk"] << _PLACE_BITS) + hit).tolist()
        return pa.table({"side": pa.array(out["side"], pa.string()), "row": pa.array(out["row"], pa.int64())})

    met = _pairs(blocks, True).join(radii, "blk")
    covered = met.groupBy("p", "q").applyInArrow(cover, "side string, row bigint").distinct()
    counts = covered.agg(F.count_if(F.col("side") == "x").alias("__gen"), F.count_if(F.col("side") == "y").alias("__real"))
    return with_row(counts, side_counts(blocks)).select(
        F.col("n").alias("n_gen"), F.col("m").alias("n_real"), (F.col("__gen") / F.col("n")).alias("precision"), (F.col("__real") / F.col("m")).alias("recall")
    )


def inception_score(df: DataFrame, probabilities: str = "probabilities", by: Sequence[str] = ()) -> DataFrame:
    """``by..., n, inception_score``: exp of the mean divergence of the rows' class probabilities from their average.

    One scan: tasks fold the sums of the probabilities and of ``p ln p`` (0 for p = 0). Groups play the part of splits.
    """
    by = list(by)
    width = feature_width(df, probabilities)
    schema = extended_schema(df.select(*by).schema, "sums array<double>")
    kinds = {f.name: f.dataType for f in schema.fields[: len(by)]}

    def fold(batches):
        groups: dict[tuple, np.ndarray] = {}
        for batch in batches:
            p = matrix(batch.column(probabilities), width)
            if (p < 0).any() or not np.isfinite(p).all():
                raise ValueError("probabilities must be finite and not negative")
            own = (p * np.log(np.where(p > 0, p, 1.0))).sum(axis=1)
            rows = np.column_stack([p, own, np.ones(len(p))])
            for key, some in group_rows(batch, by):
                groups[key] = groups.get(key, 0.0) + rows[some].sum(axis=0)
        for key, total in groups.items():
            yield pa.RecordBatch.from_pydict(key_columns(key, by, kinds, 1) | {"sums": list_column(total[None], pa.float64())})

    sums = vector_sums(df.select(*by, probabilities).mapInArrow(fold, schema), by, "sums")
    n = F.get("sums", F.lit(width + 1))
    average = F.transform(F.slice("sums", 1, width), lambda s: s / n)
    mixed = F.aggregate(average, F.lit(0.0), lambda acc, p: acc + F.when(p > 0, p * F.ln(p)).otherwise(0.0))
    return sums.select(*by, n.cast("bigint").alias("n"), F.exp(F.get("sums", F.lit(width)) / n - mixed).alias("inception_score"))
