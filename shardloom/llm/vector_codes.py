"""Vector code compression: one codebook per part of the vectors, trained by Ball k-means on exact integers.

Every entry of a codebook is the centre of a ball: its radius is the largest distance of a part it holds. Only entries
whose half distance does not exceed the radius are neighbours. A part nearer to its entry than half the way to the nearest
neighbour lies in the stable core and stays without another distance; any other part lies in a ring between two half
distances, and only the neighbours within can take it. All bounds are integers and include equality, so the result is that
of a full search, ties included.

A round scans the table, sums the parts of every entry in the tasks, and sends the sums of all entries (fixed in number) to
the driver, which has the next codebooks. A task finds the codes a row had in the last round by replaying the rounds since
the last written state, which its balls make cheap; a state is written every ``REPLAYED`` rounds, so nothing is shuffled
but sums, whatever the number of copies.

Null or odd input: rows whose vector is null, empty, or holds a null, a non-finite component or one of ``LARGEST`` or more
in size take no part, nor do vectors of another length than the commonest (the longer one of two); that length must be a
multiple of the number of parts. The codebooks start from the rows with the smallest ids (equal ids in the order of their
vectors, null ids last); a table with fewer rows has as many entries. Ids and labels may be null or repeated, further
columns are kept, an empty table gives no rows. Errors beyond 38 digits do not occur.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.functions.batches import matrix
from shardloom.llm import workers
from shardloom.llm.registry import query, table
from shardloom.llm.whitening import common_width, integers, usable
from shardloom.session import broadcast_if_small, materialize, require

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rounds a task replays before a state is written.
REPLAYED = 8
#: 64-bit sums of squares are exact up to this size of a component, in parts of at most 1,024 dimensions.
NARROW = 1 << 25
#: Labels with at least this share of the rows are joined by broadcast; there are at most so many.
HOT_LABELS = 1_000


def squares(gaps: np.ndarray) -> np.ndarray:
    return (gaps * gaps).sum(axis=-1)


def reassign(x: np.ndarray, own: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry and squared distance of each part ``x``, which entry ``own`` holds, and the distances computed."""
    distance = squares(x - book[own])
    apart = squares(book[:, None, :] - book[None, :, :])
    radius = np.zeros(len(book), dtype=book.dtype)
    np.maximum.at(radius, own, distance)
    # Neighbours of each entry by distance; the entry itself and what lies beyond its radius come last.
    beyond = 4 * max(int(radius.max(initial=0)), 0) + 1
    near = np.where((apart <= 4 * radius[:, None]) & ~np.eye(len(book), dtype=bool), apart, beyond)
    neighbours = np.argsort(near, axis=1, kind="stable")
    rings = np.take_along_axis(near, neighbours, axis=1)
    reach = (rings[own] <= 4 * distance[:, None]).sum(axis=1)
    entry, best, computed = own.copy(), distance.copy(), len(x)
    moving = np.flatnonzero(reach)  # the others lie in stable cores
    for k in range(int(reach.max(initial=0))):
        moving = moving[reach[moving] > k]
        other = neighbours[own[moving], k]
        d = squares(x[moving] - book[other])
        computed += len(moving)
        better = (d < best[moving]) | ((d == best[moving]) & (other < entry[moving]))
        entry[moving[better]], best[moving[better]] = other[better], d[better]
    return entry, best, computed


def _parts_of(column: pa.Array, parts: int) -> np.ndarray:
    """Integer vectors as (row, part, place); Python integers where 64 bits could overflow."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    x = flat.reshape(len(column), parts, -1) if len(column) else flat.reshape(0, parts, 1)
    return x.astype(object) if int(np.abs(x).max(initial=0)) >= NARROW else x


def _replay(batch: pa.RecordBatch, parts: int, history: list[np.ndarray]):
    """Parts of a batch with their entries and squared distances under the last codebooks of ``history``."""
    x = _parts_of(batch.column("x"), parts)
    codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(len(x), parts)
    entry = codes.T.astype(np.int64)
    error = np.zeros(entry.shape, dtype=x.dtype)
    for books in history:
        books = books.astype(object) if x.dtype == object or int(np.abs(books).max()) >= NARROW else books.astype(np.int64)
        for p in range(parts):
            entry[p], error[p], _ = reassign(x[:, p], entry[p], books[p])
    return x, entry, error


def _sums(parts: int, history: list[np.ndarray]):
    """Per task the sums of the parts of each entry: slot = (part, entry, place), the last place counts."""
    def run(batches):
        total: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, entry, _ = _replay(batch, parts, history)
            entries, width = history[-1].shape[1], x.shape[2]
            x = np.concatenate([x, np.ones((len(x), parts, 1), dtype=x.dtype)], axis=2)
            if total is None:
                total = np.zeros((parts, entries, width + 1), dtype=object)
            for p in range(parts):
                if int(np.abs(x[:, p]).max()) * len(x) < 1 << 53:
                    member = (entry[p][:, None] == np.arange(entries)).astype(np.float64)
                    total[p] += (member.T @ x[:, p].astype(np.float64)).astype(np.int64)
                else:
                    np.add.at(total[p], entry[p], x[:, p].astype(object))
        if total is not None:
            flat = total.ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([Decimal(int(v)) for v in flat[at]], pa.decimal128(38, 0))], ["slot", "total"])

    return run, "slot long, total decimal(38,0)"


def _with_codes(parts: int, history: list[np.ndarray], names: list[str], state: bool):
    """Rows with their codes; for the next state as they are, else with their errors and without the integers."""
    def run(batches):
        for batch in batches:
            _, entry, error = _replay(batch, parts, history)
            raw = entry.T.astype(np.uint8).tobytes()
            code = pa.array([raw[at : at + parts] for at in range(0, len(raw), parts)], pa.binary())
            if state:
                yield batch.set_column(batch.schema.get_field_index("code"), "code", code)
                continue
            total = pa.array([Decimal(int(v)) for v in error.sum(axis=0)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("row").field(c) for c in names] + [code, total], [*names, "code", "error"])

    return run


def train_and_encode(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE, replayed: int = REPLAYED,
) -> tuple[DataFrame, np.ndarray | None]:
    """Rows without their vectors, with ``code binary`` (a byte per part) and ``error decimal(38,0)``, and the codebooks as
    integers (part, entry, place); None for a table without usable vectors."""
    require(1 <= entries <= 256, "a code is one byte")
    keep = [c for c in rows.columns if c not in (vector, "code", "error")]
    rows = rows.where(usable(vector))
    width = common_width(rows, vector)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(keep).schema.fields)
    out = ", ".join(filter(None, [fields, "code binary, error decimal(38,0)"]))
    if width is None:
        return rows.select(*keep, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("decimal(38,0)").alias("error")), None
    require(width % parts == 0, f"vectors of {width} values cannot be cut into {parts} equal parts")
    rows = rows.where(F.size(vector) == width)
    first = rows.orderBy(F.col(id_col).asc_nulls_last(), F.col(vector)).limit(entries).select(integers(vector, scale).alias("x")).collect()
    book = np.array([r["x"] for r in first], dtype=object).reshape(len(first), parts, -1).transpose(1, 0, 2)
    packed = F.struct(*keep) if keep else F.struct(F.lit(0).alias("__none"))
    nothing = F.lit(bytes(parts))
    state, history = materialize(rows.select(packed.alias("row"), integers(vector, scale).alias("x"), nothing.alias("code")), "state"), [book]
    for _ in range(rounds):
        book = _next_book(state, parts, history)
        if len(history) == replayed:
            state = materialize(state.mapInArrow(workers.batches(_with_codes(parts, history, keep, True)), state.schema), "state")
            history = []
        history.append(book)
    return state.mapInArrow(workers.batches(_with_codes(parts, history, keep, False)), out), book


def _next_book(state: DataFrame, parts: int, history: list[np.ndarray]) -> np.ndarray:
    """The floored means of the parts each entry holds now; an unused entry stays."""
    run, schema = _sums(parts, history)
    book = history[-1].copy()
    entries, width = book.shape[1:]
    sums = np.zeros(parts * entries * (width + 1), dtype=object)
    for slot, total in state.select("x", "code").mapInArrow(workers.batches(run), schema).groupBy("slot").agg(F.sum("total")).collect():
        sums[slot] = int(total)
    sums = sums.reshape(parts, entries, width + 1)
    used = sums[:, :, -1] > 0
    book[used] = sums[:, :, :-1][used] // sums[:, :, -1:][used]
    return book


def add_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``label_error decimal(38,0)``: the errors of all rows with the row's label, nulls being one label."""
    coded = materialize(coded, "coded")
    key = F.struct(F.col(label))  # never null
    sums = materialize(coded.groupBy(key.alias("__label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("__n")), "label_errors")
    keyed = coded.drop("label_error").withColumn("__label", key)
    hot = sums.where(F.col("__n") * HOT_LABELS > coded.count()).drop("__n")
    cold = broadcast_if_small(sums.drop("__n").join(F.broadcast(hot.select("__label")), "__label", "left_anti"))
    with_hot = keyed.join(F.broadcast(hot), "__label")
    with_cold = keyed.join(F.broadcast(hot.select("__label")), "__label", "left_anti").join(cold, "__label")
    return with_hot.unionByName(with_cold).drop("__label")


def books_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in book.ravel()).encode()).hexdigest()


def _sql() -> str:
    """All rounds as one chain of tables: ``c0`` .. ``c6`` codebooks, ``a0`` .. ``a6`` assigned parts."""
    chain = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, len(embedding) // {PARTS} AS w,
  list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        f"parts AS MATERIALIZED (SELECT r, p, x[p * w + 1 : p * w + w] AS x FROM k, range({PARTS}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES})",
    ]
    for t in range(ROUNDS + 1):
        chain.append(f"""a{t} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS b
  FROM parts JOIN c{t} USING (p) GROUP BY r, p)""")
        if t < ROUNDS:
            chain.append(f"""s{t} AS (SELECT p, b.e AS e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT p, b, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{t}) GROUP BY ALL),
m{t} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{t} GROUP BY p, e),
c{t + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM c{t} LEFT JOIN m{t} USING (p, e))""")
    chain += [
        f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS})",
        f"rows AS (SELECT r, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)",
    ]
    return "WITH " + ",\n".join(chain) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM rows JOIN k USING (r), digest"""


@query("op13_vector_codes", _sql())
def op13_vector_codes(spark, sf_dir):
    coded, book = train_and_encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    long = lambda c: F.expr(f"try_cast({c} AS long)").alias(c)
    return add_label_errors(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), long("error"), long("label_error"),
        F.lit(None if book is None else books_digest(book)).cast("string").alias("codebooks_sha256"),
    )
