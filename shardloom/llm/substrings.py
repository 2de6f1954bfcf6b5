"""Substring dedup: words in windows that occur again anywhere are removed, found by matching statistics on FM-indexes.

1. Every window of ``window`` words is named by the least hash of the word ``ANCHOR``-grams in it. Neighbouring windows
   named by one and the same gram form a fragment. Equal windows have equal names, and those of one fragment all differ,
   so a name that occurs once needs no further look, and this leaves the part of the corpus in which something may repeat.
2. Fragments whose names repeat are dealt to shards by name, each distinct fragment once with the number of its copies.
   The windows of a name with too many distinct fragments for one shard are counted instead: each is named by its own
   hash, the copies of equal ones are summed before the shuffle, and the repeated ones go back to their fragments in
   salted parts, so that no task holds all copies of a window however often it occurs.
3. A shard is an FM-index. All its fragments are streamed through it from right to left, side by side: a backward search
   step on the wavelet tree adds a word, and a window matches elsewhere if its interval, counted with copies, holds more
   than itself; then the last word is given up and the next step taken.
4. Repeated windows go back to the documents, which are read once more to cut out the union of their words.

Words, fragments and the windows of a hot name are told apart by 64-bit hashes.

Null or odd input: a null text has no words; texts shorter than a window lose nothing; equal rows repeat each other, and
rows are told apart by id and text, so ids may be null or repeated; an empty table gives no rows. Further columns are kept
by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.functions.hot_joins import join_counted
from shardloom.llm import workers
from shardloom.llm.fm_index import FMIndex
from shardloom.llm.registry import query, table
from shardloom.llm.textscan import NOT_BLANK, Powers, Words, chunks, mix, ngram_hashes, ragged, scan_words, signed
from shardloom.session import broadcast_if_small, materialize

WINDOW = 35
ANCHOR = 10
SHARD_WORDS = 1 << 18
SMALL_BYTES = 1 << 20
#: Windows of hot names in one salted part, at most about so many with one hash.
SALT_ROWS = 1 << 16


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value among the ``width`` from each position on."""
    def least(a, b):
        return np.where(values[b] < values[a], b, a)

    at, size = np.arange(len(values)), 1
    while 2 * size <= width:
        at = least(at[:-size], at[size:])
        size *= 2
    return least(at[: len(at) - (width - size)], at[width - size :]) if width > size else at


def fragments(words: Words, window: int, powers: Powers):
    """Document, first word in the document, windows, name and hash of every fragment of a chunk."""
    n = len(words.hashes)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = ngram_hashes(words.hashes, ANCHOR)
    least = window_minima(grams, window - ANCHOR + 1)
    doc_of = np.repeat(np.arange(len(words.counts)), words.counts)[: len(least)]
    valid = np.arange(len(least)) + window <= words.first[1:][doc_of]
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (doc_of[1:] != doc_of[:-1])
    at = np.flatnonzero(opens)
    closed = np.append(np.flatnonzero(~valid), len(least))
    windows = np.minimum(np.append(at[1:], len(least)), closed[np.searchsorted(closed, at)]) - at
    up, down = powers.upto(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words.hashes * up[:n], out=total[1:])
    end = at + windows + window - 1
    hashes = mix((total[end] - total[at]) * down[at] + (end - at).astype(np.uint64))
    return doc_of[at], at - words.first[:-1][doc_of[at]], windows, grams[least[at]], hashes


def _fragment_rows(window: int):
    def run(batches):
        powers = Powers()
        for batch in batches:
            for part in chunks(batch, "text", SMALL_BYTES):
                words = scan_words(part.column("text"), NOT_BLANK, False)
                doc, start, windows, names, hashes = fragments(words, window, powers)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(doc)), pa.array(start, pa.int32()), pa.array(windows, pa.int32()), pa.array(signed(names)), pa.array(signed(hashes))],
                    ["key", "start", "windows", "name", "frag"],
                )

    return run, "key long, start int, windows int, name long, frag long"


def _content_rows(window: int, shards: int):
    """Words of the wanted fragments, dealt to shards by name."""
    schema = "shard int, name long, frag long, copies long, words binary"

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", SMALL_BYTES):
                words = scan_words(part.column("text"), NOT_BLANK, False)
                wanted, first = part.column("wanted"), words.first[:-1]
                out: list[list] = [[] for _ in range(5)]
                for d in range(part.num_rows):
                    for w in wanted[d].as_py():
                        a = int(first[d]) + w["start"]
                        end = a + w["windows"] + window - 1
                        shard = int(np.uint64(w["name"] & ((1 << 64) - 1)) % np.uint64(shards))
                        for column, x in zip(out, (shard, w["name"], w["frag"], w["copies"], words.hashes[a:end].tobytes()), strict=True):
                            column.append(x)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["shard", "name", "frag", "copies", "words"])

    return run, schema


def _window_rows(window: int):
    """Hashes of the windows of the wanted fragments."""
    schema = "name long, frag long, at int, copies long, hash long"

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", SMALL_BYTES):
                words = scan_words(part.column("text"), NOT_BLANK, False)
                grams = mix(ngram_hashes(words.hashes, window))
                lists = part.column("wanted")
                name, frag, copies, start, windows = (lists.flatten().field(c).to_numpy() for c in ("name", "frag", "copies", "start", "windows"))
                doc_of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                at = ragged(np.zeros(len(windows), dtype=np.int64), windows)
                hashes = grams[ragged(words.first[:-1][doc_of] + start, windows)]
                columns = [*(pa.array(np.repeat(c, windows)) for c in (name, frag)), pa.array(at, pa.int32()), pa.array(np.repeat(copies, windows)), pa.array(signed(hashes))]
                yield pa.RecordBatch.from_arrays(columns, ["name", "frag", "at", "copies", "hash"])

    return run, schema


def repeated_windows(texts: list[np.ndarray], copies: np.ndarray, window: int) -> np.ndarray:
    """For each sequence of words the mask of its windows that occur again in any of them, itself included."""
    sizes = np.array([len(t) for t in texts])
    _, codes = np.unique(np.concatenate(texts), return_inverse=True)
    start = np.cumsum(sizes + 1) - sizes - 1
    whole = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    at = ragged(start, sizes)
    whole[at] = codes + 1
    weights = np.zeros(len(whole), dtype=np.int64)
    weights[at] = np.repeat(copies, sizes)
    index = FMIndex(whole, window, weights)
    order = np.argsort(-sizes, kind="stable")
    place = (start + sizes)[order] - 1  # the last word of each
    low, high = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), len(whole))
    masks = np.zeros(len(texts), dtype=np.uint64)
    live = np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), "left")
    for step in range(int(sizes.max())):
        k = int(live[step])
        lo, hi = index.step(low[:k], high[:k], whole[place[:k] - step])
        if step >= window - 1:
            again = index.count(lo, hi) >= 2
            number = sizes[order[:k]] - step - 1  # the window that starts at this word
            masks[:k] |= again.astype(np.uint64) << number.astype(np.uint64)
            lo, hi = index.forget_last(lo, hi)
        low[:k], high[:k] = lo, hi
    out = np.empty(len(texts), dtype=np.uint64)
    out[order] = masks
    return out


def _shard_masks(window: int):
    def run(data: pa.Table) -> pa.Table:
        name, frag, copies = (data.column(c).to_numpy() for c in ("name", "frag", "copies"))
        # Equal rows of a table can send a fragment twice.
        _, one = np.unique(np.stack([name, frag]), axis=1, return_index=True)
        words = data.column("words")
        texts = [np.frombuffer(words[int(k)].as_py(), dtype=np.uint64) for k in one]
        masks = repeated_windows(texts, copies[one], window)
        hit = masks != 0
        return pa.table({"name": name[one][hit], "frag": frag[one][hit], "mask": signed(masks[hit])})

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key, start, mask``: bit k says that the window at word start + k repeats. ``docs`` has ``key`` and ``text``.

    A fragment has at most window - ANCHOR + 1 windows, which must fit a mask of 64 bits.
    """
    if not ANCHOR <= window <= ANCHOR + 63:
        raise ValueError(f"windows of {ANCHOR} to {ANCHOR + 63} words are supported")
    run, schema = _fragment_rows(window)
    found = materialize(docs.select("key", "text").mapInArrow(workers.batches(run), schema), "fragments")
    names = materialize(found.groupBy("name").agg(F.count("*").alias("times")).where("times > 1"), "names")
    occurrences = materialize(join_counted(found, names, ["name"], "times", found.count()), "occurrences")
    kinds = occurrences.groupBy("name", "frag").agg(F.count("*").alias("copies"), F.min(F.struct("key", "start", "windows")).alias("one"))
    kinds = materialize(kinds.select("name", "frag", "copies", "one.key", "one.start", "one.windows"), "kinds")
    size = F.col("windows") + window - 1
    total = kinds.agg(F.sum(size)).first()[0] or 0
    shards = -(-int(total) // SHARD_WORDS) or 1
    hot = kinds.groupBy("name").agg(F.sum(size).alias("n")).where(F.col("n") > SHARD_WORDS // 4).select("name")
    hot = broadcast_if_small(materialize(hot, "hot"))
    docs = _once(docs)
    run, schema = _content_rows(window, shards)
    contents = _wanted(docs, kinds.join(hot, "name", "left_anti")).mapInArrow(workers.batches(run), schema)
    masks = contents.groupBy("shard").applyInArrow(workers.group(_shard_masks(window)), "name long, frag long, mask long")
    if not hot.isEmpty():
        # Written by one job, in which both sides read the texts from one and the same shuffle.
        run, schema = _window_rows(window)
        windows = _wanted(docs, kinds.join(hot, "name", "left_semi")).mapInArrow(workers.batches(run), schema)
        found = materialize(masks.unionByName(windows, allowMissingColumns=True), "found")
        masks = found.where("mask IS NOT NULL").select("name", "frag", "mask")
        masks = masks.unionByName(_hot_masks(found.where("mask IS NULL").drop("mask")))
    told = materialize(masks.join(kinds.select("name", "frag", "copies"), ["name", "frag"]), "told")
    return join_counted(occurrences, told, ["name", "frag"], "copies", occurrences.count()).select("key", "start", "mask")


def _once(docs: DataFrame) -> DataFrame:
    """One of the rows that are equal in id and text, so that each fragment is sent to its shard once."""
    again = docs.groupBy("key").count().where("count > 1").select("key")
    if again.isEmpty():
        return docs
    again = broadcast_if_small(materialize(again, "equal_rows"))
    one = docs.join(again, "key").groupBy("key").agg(F.min("text").alias("text"))
    return materialize(docs.join(again, "key", "left_anti").unionByName(one), "documents_once")


def _wanted(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """The documents that hold the first copy of a fragment, with their fragments in ``wanted``."""
    wanted = kinds.groupBy("key").agg(F.collect_list(F.struct("name", "frag", "copies", "start", "windows")).alias("wanted"))
    return join_spans(docs.select("key", "text"), materialize(wanted, "wanted"), "key", "inner")


def _hot_masks(found: DataFrame) -> DataFrame:
    """``name, frag, mask`` of fragments by counting their windows. A fragment that equal rows of a table send twice has
    copies already, so its windows repeat anyway."""
    salts = found.count() // SALT_ROWS + 1
    found = found.withColumn("salt", F.pmod("frag", F.lit(salts)))
    parts = materialize(found.groupBy("name", "hash", "salt").agg(F.sum("copies").alias("copies")), "window_counts")
    again = parts.groupBy("name", "hash").agg(F.sum("copies").alias("n")).where("n > 1").select("name", "hash")
    hits = found.join(parts.join(again, ["name", "hash"]).select("name", "hash", "salt"), ["name", "hash", "salt"])
    return hits.groupBy("name", "frag").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))


def join_spans(docs: DataFrame, spans: DataFrame, key: str, how: str) -> DataFrame:
    """``docs`` with their row of ``spans``, which grow with the documents: both are shuffled and sorted, at any size."""
    return docs.join(spans.hint("merge"), key, how)


def _merge_runs(window: int):
    """Runs of words covered by a document's repeated windows."""

    def run(batches):
        for batch in batches:
            lists = batch.column("marks")
            starts, masks = (lists.flatten().field(c).to_numpy() for c in ("start", "mask"))
            out = []
            for a, b in zip(lists.offsets.to_pylist()[:-1], lists.offsets.to_pylist()[1:], strict=True):
                bits = (masks[a:b].view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
                which, bit = np.nonzero(bits)
                at = np.unique(starts[a:b][which] + bit)
                opens = np.append(True, at[1:] > at[:-1] + window)
                last = np.append(np.flatnonzero(opens)[1:], len(at)) - 1
                out.append([{"start": int(x), "length": int(y) + window - int(x)} for x, y in zip(at[opens], at[last], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))], ["__key", "__runs"]
            )

    return run, "__key long, __runs array<struct<start:int,length:int>>"


def _cut(names: list[str], keep_text: bool):
    """Kept words of each document; ``keep_text`` puts them in place of the text, where anything was removed."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", SMALL_BYTES):
                words = scan_words(part.column("text"), NOT_BLANK, False)
                removed, digests, texts = [], [], []
                raw, runs = words.data.tobytes(), part.column("__runs").to_pylist()
                starts, ends = words.starts.tolist(), words.ends.tolist()
                for first, count, mine in zip(words.first[:-1].tolist(), words.counts.tolist(), runs, strict=True):
                    kept, at = [], first
                    for r in mine or ():
                        kept += range(at, first + r["start"])
                        at = first + r["start"] + r["length"]
                    kept += range(at, first + count)
                    text = b" ".join([raw[starts[k] : ends[k]] for k in kept])
                    removed.append(count - len(kept))
                    digests.append(hashlib.sha256(text).hexdigest())
                    texts.append(text.decode() if keep_text and mine else None)
                columns = {c: part.column("__row").field(c) for c in names}
                if keep_text:
                    columns["text"] = pa.array([t if t is not None else o for t, o in zip(texts, columns["text"].to_pylist(), strict=True)], pa.string())
                columns |= {"n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """The documents with ``n_words, n_removed, kept_sha256``. With ``keep_text`` the text of a document that lost words
    is its kept words joined by blanks; other texts stay as they are."""
    workers.small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    marks = repeated_spans(docs.select(key.alias("key"), "text"), window).distinct().groupBy("key")
    run, schema = _merge_runs(window)
    runs = materialize(marks.agg(F.collect_list(F.struct("start", "mask")).alias("marks")).mapInArrow(workers.batches(run), schema), "runs")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), key.alias("__key"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    keyed = join_spans(rows, runs, "__key", "left").select(F.col("__row.text").alias("text"), "__row", "__runs")  # no name can clash
    return keyed.mapInArrow(
        workers.batches(_cut(docs.columns, keep_text)), f"{fields}, n_words long, n_removed long, kept_sha256 string"
    )


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM s JOIN again USING (k)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


@query("op5_substring_dedup", OP5_SQL)
def op5_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )
