"""Benchmark decontamination with suffix arrays of the training texts.

Each chunk of training documents is a shard. Its suffix array holds the word suffixes that open with two words which open
some benchmark suffix; no other suffix can match one. Every benchmark suffix with a window left is then looked up by binary
search. The range that shares its first ``window`` words gives all locations, which mark the hit words; each is followed
word by word to its longest verbatim match. Matches shorter than a window are not reported. Documents never leave their
task, so nothing is shuffled unless the benchmark has several parts.

The benchmark is sent to the tasks in parts of at most ``PART_BYTES`` of text, as many as it takes; hits of several parts
are merged per document.

Null or odd input: null and empty texts have no words and are never contaminated; an item without words has no window; an
item shorter than the window is one window. Repeated documents and items, null ids and extra columns are kept as they
are; an item with a null id marks words and has its longest match, but no entry in ``items``; an empty benchmark
contaminates nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.llm import workers
from shardloom.llm.registry import query, table
from shardloom.llm.textscan import ALNUM, chunks, ragged, scan_words
from shardloom.session import materialize

WINDOW = 13
PART_BYTES = 16 << 20
HITS = "n_words long, hits array<struct<start:int,length:int>>, items array<string>, longest array<struct<item:string,item_word:int,word:int,length:int>>"


class Benchmark:
    """Words of the items coded by rank, and one entry per window: its item, place, length and codes."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int) -> None:
        words = scan_words(pa.array(texts, pa.string()), ALNUM, True)
        self.vocabulary, codes = np.unique(words.hashes, return_inverse=True)
        lengths = words.counts
        size = np.minimum(lengths, window)
        windows = np.where(lengths > 0, np.maximum(lengths - window + 1, 1), 0)
        self.item = np.repeat(np.arange(len(ids)), windows)
        self.place = ragged(np.zeros(len(ids), dtype=np.int64), windows)
        self.length = size[self.item]
        self.left = lengths[self.item] - self.place
        at = words.first[:-1][self.item] + self.place
        # One code more than the window: 0 ends a short suffix and sorts before every word.
        grid = at[:, None] + np.arange(window)
        inside = np.arange(window) < self.length[:, None]
        self.codes = np.where(inside, np.append(codes, 0)[np.where(inside, grid, len(codes))] + 1, 0)
        self.words, self.first = codes + 1, words.first
        self.ids = ids
        self.singles = np.unique(self.codes[self.length == 1, 0]) if len(self.item) else np.zeros(0, dtype=np.int64)
        self.pairs = np.unique(self.codes[self.length > 1, 0] * (len(self.vocabulary) + 2) + self.codes[self.length > 1, 1]) if len(self.item) and window > 1 else np.zeros(0, dtype=np.int64)

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of training words; 0 for a word that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _keys(codes: np.ndarray) -> np.ndarray:
    """Rows of codes as byte strings whose byte order is the order of the rows."""
    wide = np.ascontiguousarray(codes.astype(">u4") * 2 + 1).astype(">u4")  # the last byte of a code is never 0
    return wide.view(f"S{4 * codes.shape[1]}").ravel()


class SuffixArray:
    """Sorted suffixes of a shard's coded words, cut at document ends, that start at the given places."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, places: np.ndarray, depth: int) -> None:
        grid = places[:, None] + np.arange(depth)
        rows = np.where(grid < ends[:, None], np.append(codes, 0)[np.minimum(grid, len(codes))], 0)
        keys = _keys(rows)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows, self.places = keys[order], rows[order], places[order]

    def prefix_range(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open ranges of the suffixes that open with the first ``length`` codes of each row."""
        depth = rows.shape[1]
        inside = np.arange(depth) < length[:, None]
        low = _keys(np.where(inside, rows, 0))
        high = _keys(np.where(inside, rows, (1 << 31) - 1))
        return np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")


def _search(words, bench: Benchmark, window: int):
    """Hit words of one shard and, per match, its document, item, item place, word and length."""
    codes = bench.code(words.hashes)
    doc_of = np.repeat(np.arange(len(words.counts)), words.counts)
    ends = words.first[1:][doc_of] if len(doc_of) else np.zeros(0, dtype=np.int64)
    here = np.flatnonzero(codes)
    following = np.where(here + 1 < ends[here], np.append(codes, 0)[np.minimum(here + 1, len(codes))], 0)
    opens = np.isin(codes[here] * (len(bench.vocabulary) + 2) + following, bench.pairs) | np.isin(codes[here], bench.singles)
    places = here[opens]
    if not len(places) or not len(bench.item):
        return None
    index = SuffixArray(codes, ends[places], places, window)
    low, high = index.prefix_range(bench.codes, bench.length)
    found = np.flatnonzero(high > low)
    which = np.repeat(found, (high - low)[found])
    at = index.places[ragged(low[found], (high - low)[found])]
    return codes, doc_of, ends, index, which, at


def _match_batches(bench: Benchmark, text: str, window: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                words = scan_words(part.column(text), ALNUM, True)
                n = part.num_rows
                hits, items, longest = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
                found = _search(words, bench, window)
                if found is not None:
                    _collect(words, bench, window, found, hits, items, longest)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(words.counts, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
                     pa.array(items, pa.list_(pa.string())),
                     pa.array(longest, pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int32()), ("word", pa.int32()), ("length", pa.int32())])))],
                    [*part.schema.names, "n_words", "hits", "items", "longest"],
                )

    return run


def _collect(words, bench, window, found, hits, items, longest):
    codes, doc_of, ends, index, which, at = found
    if not len(which):
        return
    # Hit words: the union of the matched windows, as runs.
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + bench.length[which], -1)
    covered = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).view(np.int8), [0]])
    # A run never joins two documents: it is cut where a document starts.
    step = np.diff(covered)
    opens = np.union1d(np.flatnonzero(step == 1), words.first[:-1][(words.counts > 0) & (covered[1:-1][np.minimum(words.first[:-1], len(codes) - 1)] > 0)])
    stops = np.flatnonzero(step == -1)
    stops = np.minimum(stops[np.searchsorted(stops, opens, "right")], ends[opens])
    for o, s in zip(opens.tolist(), stops.tolist(), strict=True):
        d = doc_of[o]
        hits[d].append({"start": int(o - words.first[d]), "length": int(s - o)})
    pairs = np.unique(np.stack([doc_of[at], bench.item[which]], axis=1), axis=0)
    for d, i in pairs.tolist():
        if bench.ids[i] is not None:
            items[d].append(bench.ids[i])
    # The longest match of each (document, item): follow each match that no earlier window of the item continues.
    length = bench.length[which].copy()
    before = (at > words.first[:-1][doc_of[at]]) & (bench.place[which] > 0)
    item_at = bench.first[:-1][bench.item[which]] + bench.place[which]
    before &= codes[np.maximum(at - 1, 0)] == bench.words[np.maximum(item_at - 1, 0)]
    keep = np.flatnonzero(~before)
    at, which, item_at, length = at[keep], which[keep], item_at[keep], length[keep]
    item_end = bench.first[1:][bench.item[which]]
    open_ = np.arange(len(at))
    while len(open_):
        here, there = at[open_] + length[open_], item_at[open_] + length[open_]
        more = (here < ends[at[open_]]) & (there < item_end[open_])
        more &= codes[np.minimum(here, len(codes) - 1)] == bench.words[np.minimum(there, len(bench.words) - 1)]
        open_ = open_[more]
        length[open_] += 1
    order = np.lexsort((at, -length, bench.item[which], doc_of[at]))
    key = np.stack([doc_of[at], bench.item[which]], axis=1)[order]
    first = np.append(True, (key[1:] != key[:-1]).any(axis=1))
    for k in order[first].tolist():
        d = doc_of[at[k]]
        longest[d].append({"item": bench.ids[bench.item[which[k]]], "item_word": int(bench.place[which[k]]), "word": int(at[k] - words.first[d]), "length": int(length[k])})


def find_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The documents with ``n_words``, ``hits`` (runs of hit words), ``items`` (sorted ids as text) and ``longest``.

    ``longest`` has, for each item that hits, its longest verbatim match: its first word there, here, and its length.
    """
    spark = docs.sparkSession
    workers.small_batches(spark)
    for taken in ("n_words", "hits", "items", "longest"):
        docs = docs.drop(taken)
    names = docs.columns
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.coalesce(item_text, F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("id"), F.lit(0)) + 16)).first()[0] or 0
    parts = -(-int(total) // part_bytes) or 1
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    found = None
    if parts > 1:
        # Several scans meet again by row, so the numbers are written once. No column can clash: the row is a struct.
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if docs.columns else F.struct(F.lit(0).alias("none"))
        docs = materialize(docs.select(F.monotonically_increasing_id().alias("__row"), whole.alias("__columns"), F.col(f"`{text}`").alias("__text")), "numbered")
        fields, text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "__text"
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()  # at most about part_bytes
        rows = sorted({(r["id"], r["text"]) for r in mine}, key=lambda r: (r[0] is None, r[0] or "", r[1]))
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        one = docs.mapInArrow(workers.batches(lambda b, sent=sent: _match_batches(Benchmark(*sent.value, window), text, window)(b)), f"{fields}, {HITS}")
        found = one if found is None else found.unionByName(one)
    if parts > 1:
        found = _merge(found).select(*[F.col("__columns").getField(c).alias(c) for c in names], "n_words", "hits", "items", "longest")
    return found.withColumn("items", F.array_sort(F.array_distinct("items")))


def _merge(found: DataFrame) -> DataFrame:
    """One row per document from the rows of each benchmark part; overlapping runs are joined."""
    one = found.groupBy("__row").agg(
        F.first("__columns").alias("__columns"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.flatten(F.collect_list("items")).alias("items"),
        F.flatten(F.collect_list("longest")).alias("longest"),
    )
    run = "array<struct<start:int,length:int>>"
    joined = F.expr(
        f"""aggregate(hits, cast(array() as {run}), (done, h) ->
        CASE WHEN size(done) > 0 AND element_at(done, -1).start + element_at(done, -1).length >= h.start
        THEN concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'length',
          greatest(element_at(done, -1).length, h.start + h.length - element_at(done, -1).start))))
        ELSE concat(done, array(h)) END)"""
    )
    return one.withColumn("hits", joined)


def n_hit():
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["length"])


def contaminated():
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents of which less than a twentieth of the words is hit, with their own columns."""
    columns = docs.columns
    return find_matches(docs, benchmark, **options).where(~contaminated()).select(*[F.col(f"`{c}`") for c in columns])


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT n, i, size, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT n, i, size, item_id FROM dw JOIN bw USING (size, k)),
words AS (SELECT n, count(DISTINCT x) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS x FROM hit) GROUP BY n),
items AS (SELECT n, count(DISTINCT item_id::VARCHAR) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS s FROM hit GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (n) LEFT JOIN items USING (n)
"""


@query("op8_decontamination", OP8_SQL)
def op8_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )
