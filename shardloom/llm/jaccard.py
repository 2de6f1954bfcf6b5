"""N-gram Jaccard join as a blocked sparse matrix product of documents and n-grams.

1. Every document's set of hashed word n-grams is a row of the incidence matrix. Documents with equal sets are one class
   and go on once.
2. Of a row of n entries only the first n - ceil(t n) + 1 + x n in a common order are multiplied at first: two rows with
   similarity t or more share more than x n of these. Any common order is right; n-grams that whole neighbourhoods repeat
   are put last (a bounded list, found while reading), so the entries that count are rare ones.
3. The product of these entries is accumulated column by column. A column of few rows gives its pairs; the overlaps of a
   pair are summed over columns, and the pair is dropped if they and all entries not multiplied cannot reach the overlap
   that its two sizes call for. A column of many rows gives one hub edge per row instead of pairs.
4. Pairs and hubs connect rows to rough clusters, which hold every link. A cluster is cut into blocks by size band and
   hash; two blocks meet in a tile only if their bands can link. A tile multiplies its whole rows, tests every pair by
   the exact overlap, and returns a spanning forest of the links, so its output is no longer than its input.
5. Forests of clusters of one tile are final; those of larger clusters are joined by connected components.

N-grams and sets are told apart by 64-bit and 128-bit hashes.

Null or odd input: a null or empty text, or one without words, has an empty set, links with nothing and is its own
component; a text with fewer words than n has its whole word sequence as its only n-gram. A row with a null id links like
any other but gives no name to a component; a component that has only such rows is null. Rows that share an id are told
apart by their sets. Further columns are not returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shardloom.functions.hot_joins import join_counted
from shardloom.llm import workers
from shardloom.llm.components import components
from shardloom.llm.registry import query, table
from shardloom.llm.textscan import NOT_BLANK, Words, chunks, mix, ngram_hashes, scan_words, signed
from shardloom.session import BROADCAST_ROWS, materialize

NGRAM = 5
PERCENT = 80
#: Entries of a row, in percent, that are multiplied beyond the least number; the more, the sharper the bounds.
EXTRA = 10
#: n-grams counted together when looking for frequent ones, how often one must occur there, and in all.
COUNTED, FREQUENT_HERE, FREQUENT = 1 << 21, 2, 20
#: At most so many n-grams are put last. This bounds a broadcast; it changes the order only, never a result.
MOST_FREQUENT = 1 << 19
#: Rows of a column that are still paired one by one.
PAIRED = 24
#: Entries and rows that a block should hold.
BLOCK_ENTRIES, BLOCK_ROWS = 1 << 19, 384
SMALL_BYTES = 1 << 20


def gram_sets(words: Words, n: int):
    """Sorted distinct n-gram hashes of each document."""
    grams = ngram_hashes(words.hashes, n)
    for first, count in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if count >= n:
            yield np.unique(grams[first : first + count - n + 1])
        elif count:
            yield ngram_hashes(words.hashes[first : first + count], count) + np.uint64(count)
        else:
            yield grams[:0]


def signature(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    a = mix(grams).sum(dtype=np.uint64)
    b = mix(grams ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return tuple(np.array([a, b], dtype=np.uint64).view(np.int64).tolist())


def prefix_size(n, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1 + n * EXTRA // 100


def _sets(batches, n: int):
    for batch in batches:
        for part in chunks(batch, "text", SMALL_BYTES):
            yield part, list(gram_sets(scan_words(part.column("text"), NOT_BLANK, True), n))


def _describe(n: int):
    """Rows of documents (id, size, signature) and of n-grams that are frequent where they were read."""
    schema = "frequent boolean, doc_id long, n long, a long, b long"
    names = ["frequent", "doc_id", "n", "a", "b"]

    def counted(held):
        kinds, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= FREQUENT_HERE
        m = int(often.sum())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(m, dtype=bool)), pa.nulls(m, pa.int64()), pa.array(times[often]), pa.array(signed(kinds[often])), pa.nulls(m, pa.int64())], names
        )

    def run(batches):
        held, size = [], 0
        for part, sets in _sets(batches, n):
            a, b = zip(*map(signature, sets), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sets), dtype=bool)), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names
            )
            held += sets
            size += sum(map(len, sets))
            if size >= COUNTED:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return run, schema


def _entries(col, row, n, k, hub: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col), pa.array(row), pa.array(n.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(np.full(len(col), hub))], ["col", "row", "n", "k", "hub"]
    )


class _Order:
    """Tells frequent n-grams: a small table of flags first, then the sorted list."""

    def __init__(self, frequent: np.ndarray) -> None:
        self.frequent = np.sort(frequent)
        self.flags = np.zeros(1 << 20, dtype=bool)
        self.flags[(self.frequent & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def last(self, grams: np.ndarray) -> np.ndarray:
        maybe = self.flags[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)]
        if maybe.any():
            some = np.flatnonzero(maybe)
            at = np.minimum(np.searchsorted(self.frequent, grams[some]), len(self.frequent) - 1)
            maybe[some] = self.frequent[at] == grams[some]
        return maybe


def _prefixes(frequent, n: int, percent: int):
    """Entries (column, row) of the first multiplication, and with ``hub`` edges for columns known to be long, with the
    number k of such entries that an edge stands for. A row with many is joined to one of these columns, and that to the
    others, so rows that share a long column are connected by edges that many rows have in common."""

    def run(batches):
        order, done = _Order(frequent.value), set()
        for _, sets in _sets(batches, n):
            columns, rows, sizes, edges = [], [], [], set()
            for grams in sets:
                if not len(grams):
                    continue
                a, b = signature(grams)
                if (a, b) in done:  # a copy in the same task
                    continue
                done.add((a, b))
                last = order.last(grams)
                p = prefix_size(len(grams), percent)
                rare = grams[~last][:p]
                long = hub_node(grams[last][: p - len(rare)]).tolist()
                if long and len(long) < len(grams) * EXTRA // 100:
                    edges |= {(x, a, len(grams), 1) for x in long}
                elif long:
                    edges |= {(long[0], x, 0, 0) for x in long[1:]} | {(long[0], a, len(grams), len(long))}
                columns.append(rare)
                rows.append(np.full(len(rare), a))
                sizes.append(np.full(len(rare), len(grams)))
            if rows:
                col = signed(np.concatenate(columns))
                yield _entries(col, np.concatenate(rows), np.concatenate(sizes), np.zeros(len(col), dtype=np.int64), False)
            if edges:
                yield _entries(*np.array(sorted(edges)).T, True)

    return run, "col long, row long, n int, k int, hub boolean"


def _multiply(percent: int):
    """Pairs of short columns and hub edges of long ones, from entries sorted by column, row."""

    def run(batches):
        left = None
        for batch in batches:
            entries = [batch.column(c).to_numpy() for c in ("col", "row", "n")]
            if left is not None:
                entries = [np.concatenate(x) for x in zip(left, entries, strict=True)]
            entries = _distinct(*entries)
            col = entries[0]
            cut = int(np.searchsorted(col, col[-1], "left")) if len(col) else 0
            # What is held back of one column stays short: once it is long, only as many rows as show that it is.
            if len(col) - cut > 4 * PAIRED:
                yield from _column_rows(*entries, percent)
                left = [x[-2 * PAIRED :] for x in entries]
            else:
                yield from _column_rows(*[x[:cut] for x in entries], percent)
                left = [x[cut:] for x in entries]
        if left is not None:
            yield from _column_rows(*left, percent)

    return run, "u long, v long, n_u int, n_v int"


def _distinct(col, row, n) -> list[np.ndarray]:
    """Sorted entries without the repeats that copies read by several tasks make."""
    fresh = np.ones(len(col), dtype=bool)
    fresh[1:] = (col[1:] != col[:-1]) | (row[1:] != row[:-1])
    return [col[fresh], row[fresh], n[fresh]]


def _column_rows(col, row, n, percent: int):
    if len(col) < 2:
        return
    opens = np.flatnonzero(np.append(True, col[1:] != col[:-1]))
    sizes = np.diff(np.append(opens, len(col)))
    out = []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= PAIRED)]).tolist():
        at = opens[sizes == size]
        i, j = np.triu_indices(size, 1)
        first, second = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
        fits = 100 * np.minimum(n[first], n[second]) >= percent * np.maximum(n[first], n[second])
        first, second = first[fits], second[fits]
        out.append((row[first], row[second], n[first], n[second]))  # rows of a column are sorted, so u < v
    long = np.repeat(sizes > PAIRED, sizes)
    if long.any():
        out.append((hub_node(col[long]), row[long], np.zeros(int(long.sum()), np.int32), n[long]))
    for u, v, n_u, n_v in out:
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n_u, pa.int32()), pa.array(n_v, pa.int32())], ["u", "v", "n_u", "n_v"])


def hub_node(col: np.ndarray) -> np.ndarray:
    """Names of columns among rows."""
    return signed(mix(col.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))


def _reachable(percent: int) -> Column:
    """Whether the overlaps counted, those that long columns may add and all entries not multiplied can make the overlap
    that the sizes call for."""
    rest = lambda n: F.ceil(n * percent / 100.0 - 1e-9) - 1 - F.floor(n * EXTRA / 100.0 + 1e-9)
    need = F.ceil((F.col("n_u") + F.col("n_v")) * percent / (100.0 + percent) - 1e-9)
    long = F.least(F.coalesce("k_u", F.lit(0)), F.coalesce("k_v", F.lit(0)))
    return F.col("c") + long + F.greatest(rest(F.col("n_u")), rest(F.col("n_v"))) >= need


def rough_clusters(docs: DataFrame, frequent, n: int, percent: int) -> DataFrame:
    """``row, cluster`` of all rows that may link with another."""
    run, schema = _prefixes(frequent, n, percent)
    entries = materialize(docs.mapInArrow(workers.batches(run), schema), "entries")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run, schema = _multiply(percent)
    short = entries.where("NOT hub").select("col", "row", "n").repartition(2 * parts, "col").sortWithinPartitions("col", "row")
    product = materialize(short.mapInArrow(workers.batches(run), schema), "product")
    # Long columns, of the list and found by the product, and how many entries each row has in them.
    hubs = entries.where("hub").select("col", "row", "n", "k").unionByName(
        product.where("n_u = 0").select(F.col("u").alias("col"), F.col("v").alias("row"), F.col("n_v").alias("n"), F.lit(1).alias("k"))
    )
    long = hubs.where("k > 0").groupBy("row").agg(F.sum("k").alias("k"), F.max("n").alias("n"))
    long = materialize(long.select("row", "k", (F.col("k") >= F.floor(F.col("n") * EXTRA / 100.0 + 1e-9)).alias("linkable")), "long")
    used = hubs.where("k = 0").unionByName(hubs.where("k > 0").join(long.where("linkable").select("row"), "row", "left_semi"))
    pairs = product.where("n_u > 0").groupBy("u", "v", "n_u", "n_v").agg(F.count("*").alias("c"))
    for side in ("u", "v"):
        pairs = pairs.join(long.select(F.col("row").alias(side), F.col("k").alias(f"k_{side}")), side, "left")
    edges = pairs.where(_reachable(percent)).select("u", "v").unionByName(used.select(F.col("col").alias("u"), F.col("row").alias("v")))
    return components(edges).select(F.col("node").alias("row"), F.col("root").alias("cluster"))


def _asked_rows(n: int):
    """Documents asked for whose set is the one meant. Their texts go on: they take less room than the hashes."""

    def run(batches):
        for part, sets in _sets(batches, n):
            want = [part.column(c).to_pylist() for c in ("a", "b")]
            at = pa.array([k for k, s in enumerate(sets) if signature(s) == (want[0][k], want[1][k])], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(c).take(at) for c in ("tiles", "node", "text")], ["tiles", "node", "text"])

    return run, "tiles array<string>, node string, text string"


def _signed_texts(n: int):
    """Texts with the signatures of their sets, the empty ones left out."""

    def run(batches):
        for part, sets in _sets(batches, n):
            at = [k for k, s in enumerate(sets) if len(s)]
            a, b = zip(*(signature(sets[k]) for k in at), strict=True) if at else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), part.column("text").take(pa.array(at, pa.int64()))], ["a", "b", "text"])

    return run, "a long, b long, text string"


def asked_texts(docs: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """``tiles, node, text`` of one text or more of each class in ``asked`` (a written table). Classes with an id are found by it,
    those of rows without ids by the set."""
    run, schema = _asked_rows(n)
    facts = asked.agg(F.sum(F.size("tiles") + 1), F.count_if(F.col("doc_id").isNull())).first()
    known = asked.where("doc_id IS NOT NULL").select("doc_id", "node", "a", "b", "tiles")
    known = F.broadcast(known) if (facts[0] or 0) <= BROADCAST_ROWS else known  # names of tiles, a few bytes each
    rows = docs.join(known, "doc_id").mapInArrow(workers.batches(run), schema)
    if not facts[1]:
        return rows
    run, schema = _signed_texts(n)
    texts = docs.where("doc_id IS NULL").select("text").mapInArrow(workers.batches(run), schema)
    texts = texts.groupBy("a", "b").agg(F.min("text").alias("text"))
    return rows.unionByName(texts.join(asked.where("doc_id IS NULL"), ["a", "b"]).select("tiles", "node", "text"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the incidence matrix in slices of columns; columns of one row are left out."""
    sizes = [len(s) for s in sets]
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    row, value = np.repeat(np.arange(len(sets)), sizes)[shared], inverse[shared]
    number = np.cumsum(counts > 1) - 1
    column = number[value]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    wide = max(256, (1 << 21) // max(1, len(sets)))
    for at in range(0, int((counts > 1).sum()), wide):
        a, b = np.searchsorted(column, [at, at + wide])
        block = np.zeros((len(sets), wide), dtype=np.float32)
        block[row[a:b], column[a:b] - at] = 1
        out += block @ block.T
    return out


def linked_groups(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the least position that links of similarity ``percent`` or more lead to."""
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    both = overlaps(sets)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(linked, True)
    root = np.arange(len(sets))
    while True:
        near = np.where(linked, root[None, :], len(sets)).min(axis=1)
        near = near[near]
        if (near == root).all():
            return root
        root = near


def _tiles(n: int, percent: int):
    """Spanning forests of the links in each tile, from rows sorted by tile and node."""

    def forest(ids, sets):
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        root = linked_groups([sets[k] for k in order.tolist()], percent)
        return ids[ids != ids[root]], ids[root][ids != ids[root]]

    def run(batches):
        tile, ids, held = None, [], []
        for part, sets in _sets(batches, n):
            for t, d, s in zip(part.column("tile").to_pylist(), part.column("node").to_pylist(), sets, strict=True):
                if t != tile:
                    if len(ids) > 1:
                        yield emit(tile, *forest(np.array(ids), held))
                    tile, ids, held = t, [], []
                if ids and ids[-1] == d:  # a repeated row
                    continue
                ids.append(d)
                held.append(s)
        if len(ids) > 1:
            yield emit(tile, *forest(np.array(ids), held))

    def emit(tile, u, v):
        return pa.RecordBatch.from_arrays([pa.array(u.tolist(), pa.string()), pa.array(v.tolist(), pa.string()), pa.array([tile.count("/") > 0] * len(u), pa.bool_())], ["u", "v", "part"])

    return run, "u string, v string, part boolean"


def deal_tiles(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (narrow: ``node``, set, ``n``, ``cluster``) with ``tiles``, the names of those they take part in. A cluster of
    one block is one tile; in others, blocks of a size band meet each other and those of the next band, the only ones
    whose sizes can link."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    banded = rows.withColumn("band", band)
    blocks = lambda: F.greatest(F.ceil(F.sum("n") / BLOCK_ENTRIES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int")
    whole = rows.groupBy("cluster").agg(blocks().alias("whole"))
    sizes = banded.groupBy("cluster", "band").agg(blocks().alias("blocks"))

    def near(shift, name):
        return sizes.select("cluster", (F.col("band") - shift).alias("band"), F.col("blocks").alias(name))

    dealt = (
        banded.join(whole, "cluster").join(near(0, "own"), ["cluster", "band"]).join(near(1, "above"), ["cluster", "band"], "left")
        .join(near(-1, "below"), ["cluster", "band"], "left").withColumn("block", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
    )
    name = lambda low, i, high, j: F.concat_ws("/", "cluster", low, i, high, j)
    upto = lambda c: F.when(c.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), c - 1))
    tiles = F.concat(
        F.transform(upto(F.col("own")), lambda j: name(F.col("band"), F.least("block", j), F.col("band"), F.greatest("block", j))),
        F.transform(upto(F.col("above")), lambda j: name(F.col("band"), F.col("block"), F.col("band") + 1, j)),
        F.transform(upto(F.col("below")), lambda j: name(F.col("band") - 1, j, F.col("band"), F.col("block"))),
    )
    tiles = F.when(F.col("whole") == 1, F.array(F.col("cluster").cast("string"))).otherwise(tiles)
    return dealt.withColumn("tiles", tiles).select(*rows.columns, "tiles")


def near_duplicates(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; documents link at similarity ``percent`` / 100 or more."""
    spark = docs.sparkSession
    workers.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run, schema = _describe(n)
    described = materialize(docs.mapInArrow(workers.batches(run), schema), "described")
    info = described.where("NOT frequent").select("doc_id", "n", "a", "b")
    often = described.where("frequent").groupBy("a").agg(F.sum("n").alias("times")).where(F.col("times") >= FREQUENT)
    found = often.orderBy(F.desc("times"), "a").limit(MOST_FREQUENT).select("a").toArrow().column("a").to_numpy()
    frequent = spark.sparkContext.broadcast(found.astype(np.int64).view(np.uint64))

    clusters = rough_clusters(docs, frequent, n, percent)
    # Classes of equal sets go by their signature, so rows without an id link too and equal ids of unlike texts do not.
    classes = info.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes.withColumn("node", F.concat_ws(":", "a", "b")), "classes")
    asked = classes.join(clusters, F.col("a") == F.col("row")).select(F.col("rep").alias("doc_id"), "node", "a", "b", "n", "cluster")
    asked = materialize(deal_tiles(asked, percent).select("doc_id", "node", "a", "b", "tiles"), "asked")
    run, schema = _tiles(n, percent)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiled = asked_texts(docs, asked, n).select(F.explode("tiles").alias("tile"), "node", "text")
    tiled = tiled.repartition(parts, "tile").sortWithinPartitions("tile", "node")
    links = materialize(tiled.mapInArrow(workers.batches(run), schema), "links")
    roots = links.where("NOT part").select(F.col("u").alias("node"), F.col("v").alias("root"))
    if links.where("part").limit(1).count():
        roots = roots.unionByName(components(links.where("part").select("u", "v")))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root"))
    roots = roots.groupBy("node").agg(F.min("root").alias("root"))
    linked = materialize(roots.join(classes.select("node", "rep"), "node"), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("members")), "least")
    linked = join_counted(linked.select("node", "root"), least, ["root"], "members", linked.count()).select("node", "least")
    named = classes.join(linked, "node", "left").select("a", "b", "n", F.coalesce("least", "rep").alias("root"))
    return info.join(named, ["a", "b", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id")
    )


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT v, root FROM reach JOIN both_ways ON u = node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id)
  JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node) USING (doc_id)
"""


@query("op4_ngram_jaccard", OP4_SQL)
def op4_ngram_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
