"""Suffix-array dedup: bytes in strings of ``length`` bytes that start earlier in the corpus too are removed.

Texts are read as UTF-8 bytes; a string that starts at a place is called its window.

0. Of a text with very many copies only the first row takes part; the others are repeats as a whole.
1. Every window is named by the least hash of the ``GRAM``-byte grams in it. Neighbouring windows named by one and the same
   gram form a fragment. Equal windows have equal names and those of a fragment all differ, so a name that occurs once
   needs no further look, which leaves the part of the corpus in which something may repeat.
2. Equal fragments are copies of one kind, and all windows of a later copy are repeats. What is left are windows that kinds
   of one name share in part. The first copies of kinds are dealt to shards by name.
3. A shard is a suffix array, built by difference-cover blockwise construction (``suffix_blocks``): one bucket of suffixes
   is sorted at a time, and long ties are resolved by the ranks of the cover. Suffixes that agree in ``length`` bytes are
   neighbours in it; all but the first in the order of the corpus repeat.
4. A name whose kinds alone exceed a shard (a passage in thousands of different surroundings) is split: its windows are
   grouped by their own hash, and the first of each group is found before the shuffle.
5. Repeats go back to the documents, which are read once more to cut out the union of their bytes.

Texts of step 0 are told apart by md5, fragments of one name and the windows of a name of step 4 by a 64-bit block hash
beside the name's.

The order of the corpus: by id, null ids last, then by a hash of the text, then by place. Null or odd input: a null text is
empty; a text shorter than ``length`` loses nothing; rows equal in id and text are one document, so they do not repeat each
other and get the same result; of rows with one id and different texts the lesser hash is first. Ids are integers. An
empty table gives no rows. Further columns are kept by ``remove_repeated_bytes``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from shardloom.functions.hot_joins import HOT_KEYS, hot_and_cold, join_counted
from shardloom.llm import workers
from shardloom.llm.registry import query, table
from shardloom.llm.suffix_blocks import BUCKET, SuffixBlocks
from shardloom.llm.textscan import chunks, eight_bytes, mix, ragged, signed, text_bytes
from shardloom.session import materialize

LENGTH = 100
GRAM = 20
#: Bytes of the texts a task works on at a time, and of the kinds of one shard. A larger name is split.
PIECE_BYTES = 1 << 20
SHARD_BYTES = 2 << 20
#: Copies of a hot kind are dealt to at least SALTS parts, about SALT_ROWS of all hot fragments to each.
SALTS, SALT_ROWS = 16, 1 << 20
#: A text with at least so many copies is taken once; at most HOT_KEYS texts are.
MANY_COPIES = 1_000
ORDER = ["a", "b"]
LAST = (1 << 63) - 1


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    n = len(words) - GRAM + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at in (8, GRAM - 8):
        h ^= h >> np.uint64(29)
        h += words[at : at + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def block_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of at least eight bytes, mixed block by block."""
    h = mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    open_ = np.arange(len(starts))
    for at in range(0, int(lengths.max(initial=0)), 8):
        open_ = open_[lengths[open_] > at]
        place = starts[open_] + np.minimum(at, lengths[open_] - 8)  # the last block ends with the span
        h[open_] = mix((h[open_] ^ words[place]) * np.uint64(0xD1342543DE82EF95))
    return h


def fragments(data: np.ndarray, offsets: np.ndarray, length: int):
    """Row, first byte in the row, windows, name and hash of every fragment."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    words = eight_bytes(data).astype(np.uint64)
    hashes = gram_hashes(words)
    bits = np.uint64(len(hashes).bit_length())
    # The place in the low bits makes the first of equal grams the least.
    least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    valid = np.arange(len(place)) + length <= offsets[1:][row_of]
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (row_of[1:] != row_of[:-1])
    at = np.flatnonzero(opens)
    closed = np.append(np.flatnonzero(~valid), len(place))
    windows = np.minimum(np.append(at[1:], len(place)), closed[np.searchsorted(closed, at)]) - at
    return row_of[at], at - offsets[:-1][row_of[at]], windows, hashes[place[at]], block_hashes(words, at, windows + length - 1)


def _fragment_rows(length: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", PIECE_BYTES):
                row, start, windows, names, hashes = fragments(*text_bytes(part.column("text")), length)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(names)), pa.array(signed(hashes)), *(part.column(c).take(at) for c in ORDER), pa.array(start, pa.int64()), pa.array(windows, pa.int32())],
                    ["name", "frag", *ORDER, "start", "windows"],
                )

    return run, "name long, frag long, a long, b long, start long, windows int"


def _wanted_pieces(part: pa.RecordBatch, length: int):
    """Bytes of a chunk, and of all wanted kinds the first byte in the chunk, the size and the columns."""
    data, offsets = text_bytes(part.column("text"))
    lists = part.column("wanted")
    columns = {c: lists.flatten().field(c) for c in ("name", "start", "windows")}
    row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
    return data, offsets[:-1][row] + columns["start"].to_numpy(), columns["windows"].to_numpy() + length - 1, row, columns


def _content_rows(length: int, shards: int):
    """Bytes of the wanted kinds, dealt to shards by name."""
    schema = "shard int, a long, b long, start long, bytes binary"

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", PIECE_BYTES):
                data, at, size, row, columns = _wanted_pieces(part, length)
                ends = np.cumsum(size).astype(np.int32)
                flat = np.ascontiguousarray(data[ragged(at, size.astype(np.int64))])
                content = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(np.int32(0), ends)), pa.py_buffer(flat)])
                shard = (columns["name"].to_numpy().view(np.uint64) % np.uint64(shards)).astype(np.int32)
                of_row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), *(part.column(c).take(of_row) for c in ORDER), columns["start"], content],
                    ["shard", *ORDER, "start", "bytes"],
                )

    return run, schema


def _window_rows(length: int):
    """Every window of the wanted kinds with its hash and its place in the corpus."""
    schema = "name long, a long, b long, start long, hash long"

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", PIECE_BYTES):
                data, first, size, row, columns = _wanted_pieces(part, length)
                words = eight_bytes(data).astype(np.uint64)
                windows = columns["windows"].to_numpy().astype(np.int64)
                per = max(1, PIECE_BYTES // (8 * length))  # kinds at a time
                for k in range(0, len(windows), per):
                    mine = slice(k, k + per)
                    n = windows[mine]
                    repeat, at = pa.array(np.repeat(np.arange(k, k + len(n)), n)), ragged(np.zeros(len(n), dtype=np.int64), n)
                    starts = ragged(first[mine], n)
                    place = np.repeat(columns["start"].to_numpy()[mine], n) + at
                    of_row = pa.array(np.repeat(row[mine], n))
                    hashes = block_hashes(words, starts, np.full(len(starts), length))
                    yield pa.RecordBatch.from_arrays(
                        [columns["name"].take(repeat), *(part.column(c).take(of_row) for c in ORDER), pa.array(place), pa.array(signed(hashes))],
                        ["name", *ORDER, "start", "hash"],
                    )

    return run, schema


def later_windows(contents: list[np.ndarray], order: np.ndarray, start: np.ndarray, length: int, bucket_size: int = BUCKET) -> list[np.ndarray]:
    """For each byte string the mask of its windows that also start earlier: in a string of a lesser ``order``, or in one of
    the same at a lesser place, the string itself lying at ``start``."""
    sizes = np.array([len(c) for c in contents])
    first = np.cumsum(sizes) - sizes
    index = SuffixBlocks(np.concatenate(contents))
    windows = sizes - length + 1
    places = ragged(first, windows)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    repeats = np.zeros(int(sizes.sum()), dtype=bool)
    kept: tuple | None = None  # last suffix of the bucket before, and the first in the corpus of those that agree with it
    key = lambda p: (order[owner[p]], start[owner[p]] + p - first[owner[p]])
    for bucket in index.buckets(places, bucket_size):
        if not len(bucket):
            continue
        agree = np.append(False, index.agree(bucket[:-1], bucket[1:], length))
        if kept is not None:
            agree[0] = index.agree(kept[0], bucket[:1], length)[0]
        group = np.cumsum(~agree) - (0 if agree[0] else 1)
        # The group that goes on from the bucket before takes its first suffix along.
        members, groups = (np.append(kept[1], bucket), np.append(0, group)) if agree[0] else (bucket, group)
        by = np.lexsort((*key(members)[::-1], groups))
        opens = np.append(True, groups[by][1:] != groups[by][:-1])
        repeats[members] = True
        least = members[by][opens]
        repeats[least] = False
        kept = bucket[-1:], least[-1:]
    return [repeats[f : f + w] for f, w in zip(first.tolist(), windows.tolist(), strict=True)]


def _shard_marks(length: int):
    def run(data: pa.Table) -> pa.Table:
        a, b, start = (data.column(c).to_numpy() for c in (*ORDER, "start"))
        by = np.lexsort((b, a))
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.cumsum(np.append(False, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])))
        contents = [np.frombuffer(c, dtype=np.uint8) for c in data.column("bytes").to_pylist()]
        masks = later_windows(contents, rank, start, length)
        hit = [k for k, m in enumerate(masks) if m.any()]
        packed = pa.array([np.packbits(masks[k], bitorder="little").tobytes() for k in hit], pa.binary())
        chosen = pa.array(hit, pa.int64())
        windows = pa.array([len(masks[k]) for k in hit], pa.int32())
        return pa.table({**{c: data.column(c).take(chosen) for c in (*ORDER, "start")}, "windows": windows, "mask": packed})

    return run


def _wanted(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """The documents that hold the first copy of a kind, with their kinds in ``wanted``."""
    listed = kinds.groupBy(*ORDER).agg(F.collect_list(F.struct("name", "start", "windows")).alias("wanted"))
    return docs.join(listed, ORDER)


def _split_marks(docs: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """Later windows of names too large for a shard, by the hashes of their windows."""
    run, schema = _window_rows(length)
    found = materialize(_wanted(docs, kinds).mapInArrow(workers.batches(run), schema), "windows")
    place = F.struct(*ORDER, "start")
    groups = found.groupBy("name", "hash").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    later = join_counted(found, materialize(groups, "window_groups"), ["name", "hash"], "times", found.count())
    return later.where(place > F.col("first")).selectExpr(*ORDER, "start", "1 AS windows", "cast(NULL AS binary) AS mask")


def _told_apart(found: DataFrame, names: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Fragments of repeated names as kinds, ``a, b, start, windows, name, bytes, different`` of the first copy, the last
    two being the size and number of all kinds of the name, and as later copies, ``a, b, start, windows``.

    One shuffle by name serves the join and all windows; the fragments of hot names are dealt by kind and salt.
    """
    hot, cold = hot_and_cold(names, "times", found.count())
    size = F.col("windows") + length - 1
    columns = [*ORDER, "start", "windows", "name", "bytes", "different"]
    rest = found if hot is None else found.join(F.broadcast(hot.select("name")), "name", "left_anti")
    copy = F.row_number().over(Window.partitionBy("name", "frag").orderBy(*ORDER, "start"))
    whole = Window.partitionBy("name")
    sized = [F.sum(F.when(F.col("copy") == 1, x)).over(whole).alias(c) for x, c in ((size, "bytes"), (F.lit(1), "different"))]
    told = rest.join(cold.select("name"), "name").withColumn("copy", copy).select("*", *sized)
    # Kinds without another kind of their name have no part in what follows.
    told = materialize(told.where("copy > 1 OR different > 1").select(*columns, "copy"), "copies")
    kinds, later = told.where("copy = 1").select(columns), told.where("copy > 1").select(*ORDER, "start", "windows")
    if hot is None:
        return kinds, later
    rows = materialize(found.join(F.broadcast(hot.select("name")), "name"), "hot_fragments")
    # The first copy of a kind is found in salted parts, then among the firsts of these.
    salt = F.pmod(F.xxhash64(*ORDER, "start"), F.lit(SALTS + rows.count() // SALT_ROWS))
    near = F.row_number().over(Window.partitionBy("name", "frag", "salt").orderBy(*ORDER, "start"))
    parts = materialize(rows.withColumn("salt", salt).withColumn("copy", near).drop("salt"), "hot_parts")
    firsts = materialize(parts.where("copy = 1").withColumn("copy", copy), "hot_kinds")
    mine = firsts.where("copy = 1")
    sizes = mine.groupBy("name").agg(F.sum(size).alias("bytes"), F.count("*").alias("different")).where("different > 1")
    kinds = kinds.unionByName(mine.join(F.broadcast(sizes), "name").select(columns))  # as few as hot names
    for found in (parts, firsts):
        later = later.unionByName(found.where("copy > 1").select(*ORDER, "start", "windows"))
    return kinds, later


def repeated_windows(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``a, b, start, windows, mask``: of so many windows from a start on those in the mask, or all if it is null, also
    start earlier. ``docs`` has the order ``a, b`` of a document and its ``text``, once."""
    if length < GRAM:
        raise ValueError(f"strings of at least {GRAM} bytes are supported")
    run, schema = _fragment_rows(length)
    found = materialize(docs.mapInArrow(workers.batches(run), schema), "fragments")
    names = materialize(found.groupBy("name").agg(F.count("*").alias("times")).where("times > 1"), "names")
    kinds, later = _told_apart(found, names, length)
    kinds = kinds.where("different > 1")
    large = F.col("bytes") > shard_bytes
    total, split = kinds.agg(F.sum(F.when(~large, F.col("windows") + length - 1)), F.count(F.when(large, 1))).first()
    run, schema = _content_rows(length, -(-int(total or 0) // shard_bytes) or 1)
    contents = _wanted(docs, kinds.where(~large)).mapInArrow(workers.batches(run), schema)
    marks = contents.groupBy("shard").applyInArrow(workers.group(_shard_marks(length)), "a long, b long, start long, windows int, mask binary")
    if split:
        marks = marks.unionByName(_split_marks(docs, kinds.where(large), length))
    return marks.unionByName(later.withColumn("mask", F.lit(None).cast("binary")))


def _merge_runs(length: int):
    """Runs of bytes covered by a document's repeated windows."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def merged(starts, windows, masks) -> list[dict]:
        plain = np.array([m is None for m in masks])
        low, high = [starts[plain]], [starts[plain] + windows[plain]]
        for k in np.flatnonzero(~plain).tolist():
            bits = np.unpackbits(np.frombuffer(masks[k], dtype=np.uint8), bitorder="little")
            edge = np.diff(np.concatenate([[0], bits, [0]]).astype(np.int8))
            low.append(starts[k] + np.flatnonzero(edge == 1))
            high.append(starts[k] + np.flatnonzero(edge == -1))
        low, high = np.concatenate(low), np.concatenate(high) + length - 1
        order = np.argsort(low, kind="stable")
        low, reach = low[order], np.maximum.accumulate(high[order])
        opens = np.append(True, low[1:] > reach[:-1])
        last = np.append(np.flatnonzero(opens)[1:], len(low)) - 1
        return [{"start": x, "length": y - x} for x, y in zip(low[opens].tolist(), reach[last].tolist(), strict=True)]

    def run(batches):
        for batch in batches:
            lists = batch.column("marks")
            starts, windows = (lists.flatten().field(c).to_numpy() for c in ("start", "windows"))
            masks, ends = lists.flatten().field("mask").to_pylist(), lists.offsets.to_pylist()
            out = [merged(starts[x:y], windows[x:y], masks[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, run_type)], ["__a", "__b", "__runs"])

    return run, "__a long, __b long, __runs array<struct<start:long,length:long>>"


def _cut(names: list[str], keep: bool):
    """Digest of the kept bytes of each document, and with ``keep`` the bytes themselves."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "__text", PIECE_BYTES):
                data, offsets = text_bytes(part.column("__text"))
                raw, ends = data.tobytes(), offsets.tolist()
                kept, removed = [], []
                for x, y, runs in zip(ends[:-1], ends[1:], part.column("__runs").to_pylist(), strict=True):
                    pieces, at = [], x
                    for r in runs or ():
                        pieces.append(raw[at : x + r["start"]])
                        at = x + r["start"] + r["length"]
                    kept.append(b"".join([*pieces, raw[at:y]]))
                    removed.append(y - x - len(kept[-1]))
                columns = {c: part.column("__row").field(c) for c in names}
                columns |= {"n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed": part.column("__runs")}
                columns["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
                if keep:
                    columns["kept"] = pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def remove_repeated_bytes(
    docs: DataFrame, length: int = LENGTH, keep: bool = True, id_col: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """The documents with ``n_bytes, n_removed, removed`` (maximal runs; null if there are none) and ``kept_sha256``, and with
    ``keep`` the remaining bytes as ``kept``, which need not be UTF-8 where a run ends inside a character."""
    added = ["n_bytes", "n_removed", "removed", "kept_sha256", "kept"]
    docs = docs.drop(*added)
    names = docs.columns
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.lit(0).cast("long")]
    if not docs.groupBy(key[0].alias("a")).count().where("count > 1").isEmpty():
        key[1] = F.xxhash64(F.col(id_col).isNull(), F.col(text))  # ids alone do not tell the rows apart
    size, digest = F.octet_length(text), F.unhex(F.md5(text)).alias("__digest")
    texts = docs.where(size >= length).groupBy(digest).agg(F.count("*").alias("n"), F.min(F.struct(key[0].alias("a"), key[1].alias("b"))).alias("__first"))
    least = max(MANY_COPIES, docs.count() // HOT_KEYS)
    frequent = materialize(texts.where(F.col("n") >= least).select("__digest", "__first"), "frequent_texts")  # at most HOT_KEYS
    once = docs.where(size >= length).select(key[0].alias("a"), key[1].alias("b"), F.col(text).alias("text"), digest)
    once = once.join(F.broadcast(frequent), "__digest", "left").where(F.col("__first").isNull() | (F.struct(*ORDER) == F.col("__first")))
    once = once.select(*ORDER, "text")
    again = once.groupBy(*ORDER).count().where("count > 1").select(*ORDER)
    if not again.isEmpty():
        again = materialize(again, "equal_rows")
        twice = once.join(again, ORDER).groupBy(*ORDER).agg(F.min("text").alias("text"))
        once = materialize(once.join(again, ORDER, "left_anti").unionByName(twice), "documents_once")
    run, schema = _merge_runs(length)
    marks = repeated_windows(once, length, shard_bytes).groupBy(*ORDER).agg(F.collect_list(F.struct("start", "windows", "mask")).alias("marks"))
    runs = materialize(marks.mapInArrow(workers.batches(run), schema), "runs")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(text).alias("__text"), key[0].alias("__a"), key[1].alias("__b"))
    rows = rows.withColumn("__digest", F.unhex(F.md5("__text"))).join(F.broadcast(frequent), "__digest", "left")
    copy = F.struct(F.col("__a").alias("a"), F.col("__b").alias("b")) != F.col("__first")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("__text").cast("long").alias("length")))
    cut = rows.join(runs, ["__a", "__b"], "left").withColumn("__runs", F.when(copy, whole).otherwise(F.col("__runs"))).select("__row", "__text", "__runs")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = f"{fields}, n_bytes long, n_removed long, removed array<struct<start:long,length:long>>, kept_sha256 string" + (", kept binary" if keep else "")
    return cut.mapInArrow(workers.batches(_cut(names, keep)), schema)


OP11_SQL = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
later AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY r, i) AS n FROM s) WHERE n > 1),
opened AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 100, true)::INT AS o FROM later),
runs AS (SELECT r, min(i) AS a, max(i) + 100 AS b FROM (SELECT r, i, sum(o) OVER (PARTITION BY r ORDER BY i) AS g FROM opened) GROUP BY r, g),
pieces AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS c FROM runs),
cut AS (SELECT r, count(*) AS n, sum(b - a)::BIGINT AS size, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(size, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""


@query("op11_suffix_array_dedup", OP11_SQL)
def op11_suffix_array_dedup(spark, sf_dir):
    found = remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_spans"), "kept_sha256")
