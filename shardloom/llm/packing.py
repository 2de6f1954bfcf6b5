"""Best-fit packing by exact-complement hashing.

Only the number of pieces of each length matters for the packing, at most ``capacity`` numbers whatever the corpus. From
the longest down, the gap of a length is looked up among the single lengths, then the sums of two, then the sums of
three; a combination that fills the gap exactly is used as often as its counts allow. What is left is filled best fit
first. Where large pieces are many, combinations can use up the small ones that the rest would need, so this is also tried
with shorter combinations, and the plan of fewest sequences is taken. The outcome is a list of recipes with the number of times each is used. Every use of a recipe is a sequence, and
the pieces of one length are dealt to the places for that length by their rank, which is computed in two steps, so that a
frequent length is spread over many tasks.

Null or odd input: a null text is empty and has the end id only; an empty table gives no rows; repeated ids and rows are
pieces of their own (pieces alike in every column are interchangeable). Further columns are not returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from shardloom.llm import tokens, workers
from shardloom.llm.registry import query, table
from shardloom.llm.textscan import chunks
from shardloom.session import materialize

CAPACITY = 4096
END = 1
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bytes of text encoded at a time.
ENCODE_BYTES = 1 << 20


def cut_pieces(docs: DataFrame, path: str, keep_blanks: bool, end: int, capacity: int) -> DataFrame:
    """One row per piece of every document: its ids and the end id, cut only where they exceed the capacity."""

    workers.small_batches(docs.sparkSession)

    def run(batches):
        encoder = tokens.encoder(path, keep_blanks)
        for batch in batches:
            for part in chunks(batch, "text", ENCODE_BYTES):
                ids, counts = tokens.with_end(*encoder.encode(part.column("text")), end)
                pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(capacity, counts[doc] - number * capacity)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(number * capacity, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(tokens.crc32s(ids, length), pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(workers.batches(run, keep_encoders=True), PIECE)


class Recipes:
    """Recipes for the given counts by length: ``recipes`` holds (lengths in order, times used)."""

    def __init__(self, counts: np.ndarray, longest: int = 3) -> None:
        self.capacity, self.longest = len(counts) - 1, longest
        self.left = counts.astype(np.int64).copy()
        self.recipes: list[tuple[list[int], int]] = []
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                found = self._exact(length)
                if found is None:
                    break
                self._use([length, *found])
        while self.left.any():
            self._use(self._best_fit())

    @classmethod
    def fewest(cls, counts: np.ndarray) -> Recipes:
        """The plan of fewest sequences over combinations of at most three, two and one."""
        plans = [cls(counts, longest) for longest in (3, 2, 1)]
        return min(plans, key=lambda plan: sum(n for _, n in plan.recipes))

    def _use(self, lengths: list[int]) -> None:
        kinds, times = np.unique(lengths, return_counts=True)
        n = int((self.left[kinds] // times).min())
        self.left[kinds] -= n * times
        self.recipes.append((sorted(lengths, reverse=True), n))

    def _exact(self, length: int) -> list[int] | None:
        gap = self.capacity - length
        if not gap:
            return []
        free = self.left.copy()
        free[length] -= 1
        ways = (self._single, self._pair, self._triple)[: self.longest]
        return next((found for way in ways if (found := way(gap, free))), None)

    @staticmethod
    def _single(total: int, free: np.ndarray) -> list[int] | None:
        return [total] if free[total] > 0 else None

    @staticmethod
    def _pair(total: int, free: np.ndarray) -> list[int] | None:
        """The two lengths with this sum whose longer one is longest."""
        long = np.arange(total - 1, (total - 1) // 2, -1)
        good = np.flatnonzero((free[long] > 0) & (free[total - long] > (long * 2 == total)))
        return [int(long[good[0]]), int(total - long[good[0]])] if len(good) else None

    @classmethod
    def _triple(cls, total: int, free: np.ndarray) -> list[int] | None:
        there = (free[: total + 1] > 0).astype(float)
        size = 1 << (2 * len(there)).bit_length()
        sums = np.fft.irfft(np.fft.rfft(there, size) ** 2, size)[: total + 1] > 0.5  # sums of two lengths that exist
        for first in np.flatnonzero((there > 0) & sums[::-1])[::-1].tolist():
            free[first] -= 1
            rest = cls._pair(total - first, free) if total - first >= 2 else None
            free[first] += 1
            if rest:
                return [first, *rest]
        return None

    def _best_fit(self) -> list[int]:
        """One sequence: the longest piece left, then again and again the longest that fits."""
        free, chosen, gap = self.left.copy(), [], self.capacity
        while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
            length = int(fits[-1])
            n = int(min(free[length], gap // length))
            free[length] -= n
            chosen += [length] * n
            gap -= n * length
        return chosen

    def places(self) -> dict[int, np.ndarray]:
        """By length, rows (first rank, first sequence, offset): ranks from the first on take the sequences from the first on."""
        rows: dict[int, list] = {}
        ranks = np.zeros(self.capacity + 1, dtype=np.int64)
        sequence = 0
        for lengths, n in self.recipes:
            offset = 0
            for length in lengths:
                rows.setdefault(length, []).append((ranks[length], sequence, offset))
                ranks[length] += n
                offset += length
            sequence += n
        return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Pieces with ``rank`` among those of their length; ``pieces`` must be a written table, it is read twice."""
    order = ["doc_id", "piece", "ids_crc32", "start"]
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    cells = cells.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy(*order)
    return (
        dealt.withColumn("own", F.row_number().over(own) - 1).join(cells, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("own")).drop("bucket", "own", "before")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """The pieces (``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most one row per length
        counts[row["length"]] = row["count"]
    places = spark.sparkContext.broadcast(Recipes.fewest(counts).places())

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            rows = places.value[int(size)]
            at = np.searchsorted(rows[:, 0], ranks[mine], "right") - 1
            sequence[mine] = rows[at, 1] + ranks[mine] - rows[at, 0]
            offset[mine] = rows[at, 2]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked(pieces, buckets).withColumn("place", place("length", "rank")).select(
        *[c for c in pieces.columns], "place.sequence_id", "place.offset"
    )


def pack_documents(docs: DataFrame, path: str | None = None, keep_blanks: bool = False, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    pieces = cut_pieces(docs, path or tokens.tokenizer_file("word_bpe_49k.json"), keep_blanks, end, capacity)
    return pack(materialize(pieces, "pieces"), capacity)


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
