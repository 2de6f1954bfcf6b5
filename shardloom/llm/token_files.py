"""Token-ID output: token files of coded blocks in ascending document order, and their reader.

A file is a Parquet file of segments, written by Spark's own committer, so lost tasks are simply written again. A segment
is a run of whole documents: their ids, the number of ids of each, and the ids of all of them as a model and blocks of
``range_coder`` that are coded, checked and decoded on their own, by that model. Documents are range partitioned by id, each partition
is a part of the file set, and a segment knows its part and the number of ids before it there; the ids before a part are
the sum over earlier parts, of which there are as many as partitions.

Null or odd input: a null text is empty and has the end id only; documents with equal ids are ordered by text, those with
a null id come first; an empty table makes files without segments. Further columns are not stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from shardloom.llm import range_coder, tokens, workers
from shardloom.llm.registry import query, table
from shardloom.llm.textscan import chunks
from shardloom.session import scratch_dir

END = 2
#: Ids of a segment, but for the last document, which is whole.
SEGMENT_IDS = 1 << 22
#: Ids of a block: the shorter, the more blocks there are to take a step together.
BLOCK_IDS = 1_024
#: Blocks decoded side by side, which holds all of a segment but for one with a very long document.
LANES = 8_192
ENCODE_BYTES = 1 << 20
SEGMENT = "seq long, before long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, model binary, blocks array<binary>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, keep_blanks: bool = True, end: int = END, parts: int | None = None) -> None:
    """Encodes ``doc_id, text`` and writes the token files below ``path``."""
    spark = docs.sparkSession
    workers.small_batches(spark)
    vocabulary = vocabulary or tokens.tokenizer_file("byte_bpe_50k.json")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        encoder = tokens.encoder(vocabulary, keep_blanks)
        held: list = []
        state = {"seq": 0, "before": 0}

        def segment():
            ids = np.concatenate([h[2] for h in held])
            lengths = np.concatenate([h[1] for h in held])
            doc_ids = pa.concat_arrays([h[0] for h in held])
            model, blocks = range_coder.encode_blocks([ids[at : at + BLOCK_IDS] for at in range(0, len(ids), BLOCK_IDS)], shared=True)
            row = pa.RecordBatch.from_arrays(
                [pa.array([state["seq"]], pa.int64()), pa.array([state["before"]], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                 pa.array([lengths], pa.list_(pa.int64())), pa.array([model], pa.binary()), pa.array([blocks], pa.list_(pa.binary()))],
                ["seq", "before", "n_ids", "doc_ids", "lengths", "model", "blocks"],
            )
            state["seq"] += 1
            state["before"] += len(ids)
            held.clear()
            return row

        for batch in batches:
            for piece in chunks(batch, "text", ENCODE_BYTES):
                ids, counts = tokens.with_end(*encoder.encode(piece.column("text")), end)
                held.append((piece.column("doc_id"), counts, ids))
                if sum(len(h[2]) for h in held) >= SEGMENT_IDS:
                    yield segment()
        if held:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(workers.batches(run, keep_encoders=True), SEGMENT).withColumn("part", F.spark_partition_id()).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens, ids_crc32, ids`` (little-endian unsigned 32-bit), from the files."""
    segments = spark.read.parquet(path)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition written
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = segments.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("before")).alias("start"), "doc_ids", "lengths", "model", "blocks")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield _documents(*[batch.column(c)[k] for c in ("start", "doc_ids", "lengths", "model", "blocks")])

    return placed.mapInArrow(workers.batches(run), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _documents(start: pa.Scalar, doc_ids: pa.Scalar, lengths: pa.Scalar, model: pa.Scalar, blocks: pa.Scalar) -> pa.RecordBatch:
    coded = blocks.as_py()
    decoded: list[np.ndarray] = []
    for at in range(0, len(coded), LANES):
        decoded += range_coder.decode_blocks(coded[at : at + LANES], model.as_py())
    ids = np.concatenate(decoded)
    counts = lengths.values.to_numpy()
    if counts.sum() != len(ids):
        raise ValueError("a segment's documents do not cover its ids")
    stops = np.cumsum(counts)
    raw = pa.py_buffer(ids.astype("<u4").tobytes())
    offsets = pa.array(np.concatenate([[0], 4 * stops]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [doc_ids.values, pa.array(start.as_py() + stops - counts), pa.array(counts), pa.array(tokens.crc32s(ids, counts), pa.int64()),
         pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, offsets.buffers()[1], raw])],
        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
    )


@query("op1_token_output")
def op1_token_output(spark, sf_dir):
    path = scratch_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).drop("ids")
