"""Resharding by minimum-cost flow: from the rows of the old shards and the capacities of the new ones to the transfers
that move the fewest bytes.

A row may stay, at no cost, if a new shard has the number of its old one, or move, at the cost of its bytes. Old shard i
sends its rows either to new shard i or, class of size by class of size, to a hub that feeds all new shards; new shards
take a lowest and a highest number of rows. The network has a few nodes per shard whatever the number of rows, and its
cheapest flow says how many rows of which size classes each old shard gives up. Rows are ranked within their old shard from
the largest class down, so a block of ranks stays and the blocks after it are the transfers; a block's place in its new
shard is known from the flow, and so is every row's slot.

Ranks are computed in two steps, counts of small cells (old shard, size class, hash bucket) and positions within a cell,
so a hot shard is spread over many tasks. Only shards that give or take rows are rewritten.

Null or odd input: a null text has no bytes; a null old shard is a shard without a new one, so its rows move; repeated
rows are rows of their own; an empty table gives no rows. Further columns are kept as they are.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from shardloom.llm.registry import query, table
from shardloom.session import broadcast_if_small, scratch_dir

SHARDS = 24
#: Classes per doubling of a row's size.
CLASSES = 4
#: Rows that a cell should hold.
CELL_ROWS = 5_000


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials; all costs are 0 or more."""

    def __init__(self) -> None:
        self.arcs: list[list[int]] = []  # to, room, cost; arc k ^ 1 is its reverse
        self.out: dict[object, list[int]] = {}

    def arc(self, a, b, room: int, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.arcs.append([y, r, c])
        return len(self.arcs) - 2

    def sent(self, arc: int) -> int:
        return self.arcs[arc ^ 1][1]

    def solve(self, source, sink) -> int:
        height = dict.fromkeys(self.out, 0.0)
        total = 0
        while True:
            far, came, heap, n = {source: 0.0}, {}, [(0.0, 0, source)], 0
            while heap:
                d, _, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for k in self.out[x]:
                    y, room, cost = self.arcs[k]
                    if room and (new := d + max(0.0, cost + height[x] - height[y])) < far.get(y, float("inf")) - 1e-9:
                        far[y], came[y], n = new, k, n + 1
                        heapq.heappush(heap, (new, n, y))
            if sink not in far:
                return total
            most = max(far.values())
            for x in height:
                height[x] += far.get(x, most)
            path, x = [], sink
            while x != source:
                path.append(came[x])
                x = self.arcs[came[x] ^ 1][0]
            amount = min(self.arcs[k][1] for k in path)
            for k in path:
                self.arcs[k][1] -= amount
                self.arcs[k ^ 1][1] += amount
            total += amount


@dataclass
class Block:
    """Ranks ``first`` to ``first + rows - 1`` of an old shard go to ``shard``, to slots from ``slot`` on."""

    old: int
    first: int
    rows: int
    shard: int
    slot: int


def even(total: int, shards: int) -> list[tuple[int, int]]:
    """Lowest and highest number of rows of each new shard, at most one apart."""
    low = total // shards
    return [(low, low + (total % shards > 0))] * shards


def plan_transfers(classes: list[tuple[int, int, int, int]], capacities: list[tuple[int, int]]) -> list[Block]:
    """Blocks of the cheapest flow. ``classes``: (old shard, class, rows, bytes) of all rows."""
    flow, rows = Flow(), {}
    for old, _, n, _ in classes:
        rows[old] = rows.get(old, 0) + n
    if not sum(low for low, _ in capacities) <= sum(rows.values()) <= sum(high for _, high in capacities):
        raise ValueError("the rows do not fit the capacities")
    # A row above a shard's lowest number costs more than any move, so lowest numbers are met first.
    dear = 1.0 + 2 * max((b / n for _, _, n, b in classes), default=1.0)
    leave, stay = {}, {}
    for old, n in rows.items():
        flow.arc("source", ("old", old), n, 0.0)
        if 0 <= old < len(capacities):
            stay[old] = flow.arc(("old", old), ("new", old), n, 0.0)
    for old, _, n, size in classes:
        leave.setdefault(old, []).append(flow.arc(("old", old), "hub", n, size / n))
    take = [flow.arc("hub", ("new", j), sum(rows.values()), 0.0) for j in range(len(capacities))]
    for j, (low, high) in enumerate(capacities):
        flow.arc(("new", j), "sink", low, 0.0)
        flow.arc(("new", j), "sink", high - low, dear)
    if rows and flow.solve("source", "sink") != sum(rows.values()):
        raise ValueError("the rows do not fit the capacities")
    blocks, filled = [], {}
    for old in sorted(rows):
        kept = flow.sent(stay[old]) if old in stay else 0
        if kept:
            blocks.append(Block(old, 0, kept, old, 0))
        filled[old] = kept
    need = [(j, flow.sent(k)) for j, k in enumerate(take)]
    for old in sorted(rows):
        rank, left = filled[old], sum(flow.sent(k) for k in leave.get(old, []))
        while left:
            j, want = need[0]
            n = min(left, want)
            if n:
                blocks.append(Block(old, rank, n, j, filled.get(j, 0)))
                filled[j] = filled.get(j, 0) + n
            rank, left = rank + n, left - n
            need[0] = (j, want - n)
            if want == n:
                need.pop(0)
    # Arrivals start after the rows that stay; a shard's own stay block was counted first.
    return blocks


def place_rows(docs: DataFrame, old_shard: Column, size: Column, order: list[str], capacities=None, shards: int = SHARDS):
    """``docs`` with ``old_shard``, ``size``, ``shard`` and ``slot``, and the blocks of the plan.

    ``order`` are columns that break ties between rows of one cell; rows alike in all of them are interchangeable.
    """
    spark = docs.sparkSession
    dealt = docs.withColumn("old_shard", F.coalesce(old_shard.cast("int"), F.lit(-1))).withColumn("size", size.cast("long"))
    dealt = dealt.withColumn("__class", F.floor(F.log2(F.col("size") + 1) * CLASSES).cast("int"))
    classes = [tuple(r) for r in dealt.groupBy("old_shard", "__class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()]
    total = sum(c[2] for c in classes)
    blocks = plan_transfers(classes, capacities or even(total, shards))
    # Enough buckets that the largest class of a shard falls into cells of about CELL_ROWS.
    buckets = -(-max((c[2] for c in classes), default=1) // CELL_ROWS)
    dealt = dealt.withColumn("__down", -F.col("__class")).withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    cell = ["old_shard", "__down", "__bucket"]
    before = Window.partitionBy("old_shard").orderBy("__down", "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = dealt.groupBy(*cell).agg(F.count("*").alias("__n"))
    cells = cells.select(*cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # Neighbouring cells share a task, so a task writes to few shards.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = Window.partitionBy(*cell).orderBy(F.desc("size"), *order)
    ranked = dealt.repartitionByRange(parts, *cell).withColumn("__own", F.row_number().over(own) - 1)
    ranked = ranked.join(broadcast_if_small(cells), cell).withColumn("__rank", F.col("__before") + F.col("__own"))
    rows = ", ".join(f"({b.old}, {b.first}L, {b.first + b.rows}L, {b.shard}, {b.slot}L)" for b in blocks) or "(-2, 0L, 0L, 0, 0L)"
    # At most one block for each pair of shards.
    table_ = F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS t(__old, __first, __last, shard, __slot)"))
    placed = ranked.join(
        table_, (F.col("old_shard") == F.col("__old")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__last"))
    ).withColumn("slot", F.col("__slot") + F.col("__rank") - F.col("__first"))
    return placed.drop("__class", "__down", "__bucket", "__before", "__own", "__rank", "__old", "__first", "__last", "__slot"), blocks


def affected_shards(blocks: list[Block]) -> list[int]:
    """Shards that take rows from another, or give some away."""
    return sorted({s for b in blocks if b.old != b.shard for s in (b.old, b.shard) if s >= 0})


def rewrite(placed: DataFrame, blocks: list[Block], path: str) -> DataFrame:
    """Writes the shards whose rows changed below ``path``, one folder each; returns these and the untouched rows."""
    changed = affected_shards(blocks)
    placed.where(F.col("shard").isin(changed)).write.partitionBy("shard").parquet(path)
    spark = placed.sparkSession
    schema = T.StructType([*placed.drop("shard").schema.fields, placed.schema["shard"]])
    back = spark.read.schema(schema).parquet(path)
    if all(b.shard in changed for b in blocks):
        return back
    return back.unionByName(placed.where(~F.col("shard").isin(changed)))


@query("op10_sharding")
def op10_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # The old layout: rows of a source lie in the shard that its name hashes to.
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(SHARDS))
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    placed, blocks = place_rows(docs.select("doc_id", "text", "source"), old, size, ["doc_id", "text"])
    back = rewrite(placed.drop("source"), blocks, scratch_dir(spark, "shards"))
    return back.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
