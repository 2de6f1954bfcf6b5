"""User-supplied batch functions (encoders, decoders, feature extractors) over tensor tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.functions.batches import bytes_column, bytes_matrix, extended_schema, list_column, matrix
from shardloom.session import require
from shardloom.spec import DatasetSpec

BatchFn = Callable[[np.ndarray], np.ndarray]


def batch_infer(
    df: DataFrame, make_fn: Callable[[], BatchFn], spec: DatasetSpec, batch_size: int = 256,
    views: Sequence[str] | None = None, tensor: str = "tensor", out: str = "features", keep_input: bool = False,
    out_type: str = "float",
) -> DataFrame:
    """Apply ``make_fn()(array[n, C, H, W]) -> array[n, ...]`` to batches; other columns are kept.

    ``make_fn`` runs once per task, so a model is loaded once. Unwanted views are filtered before the
    function, never after it. Batches hold at most ``batch_size`` rows and are filled across input chunks.
    """
    require(batch_size > 0, "batch_size must be positive")
    require(out_type in ("float", "double"), f"unsupported output type {out_type!r}")
    if views is not None:
        df = df.where(F.col("view").isin(list(views)))
    binary = df.schema[tensor].dataType.typeName() == "binary"
    kept = [c for c in df.columns if keep_input or c != tensor]
    schema = extended_schema(df.select(*kept).schema, f"{out} array<{out_type}>")
    shape, size = spec.shape, spec.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for table in rebatch(batches, batch_size):
            fn = fn or make_fn()
            column = table.column(tensor).combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            x = bytes_matrix(column, size) if binary else matrix(column, size).astype(np.float32)
            y = np.asarray(fn(x.reshape(-1, *shape)))
            if len(y) != len(x):
                raise ValueError(f"the batch function returned {len(y)} rows for {len(x)}")
            columns = {c: table.column(c).combine_chunks() for c in kept}
            columns[out] = list_column(y.reshape(len(y), -1), pa.float32() if out_type == "float" else pa.float64())
            yield from pa.table(columns).to_batches()

    return df.mapInArrow(run, schema)


def rebatch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of exactly ``size`` rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            table = pa.Table.from_batches(held)
            full = rows - rows % size
            for at in range(0, full, size):
                yield table.slice(at, size)
            held, rows = table.slice(full).to_batches(), rows - full
    if rows:
        yield pa.Table.from_batches(held)


def identity() -> BatchFn:
    return lambda x: x


def pooled_mean() -> BatchFn:
    """Mean over positions: one value per channel."""
    return lambda x: x.mean(axis=(2, 3), dtype=np.float64)


def hflip(df: DataFrame, spec: DatasetSpec, image: str = "image") -> DataFrame:
    """Mirror images along the last axis. A flipped latent is the encoding of this, not the mirrored latent."""
    if df.schema[image].dataType.typeName() != "binary":
        from shardloom.functions.arrays import flip_last_axis

        return df.withColumn(image, flip_last_axis(F.col(image), spec))
    shape, size = spec.shape, spec.size

    @F.arrow_udf("binary")
    def flip(images: pa.Array) -> pa.Array:
        planes = bytes_matrix(images, size).reshape(-1, *shape)
        return bytes_column(planes[..., ::-1].reshape(-1, size))

    return df.withColumn(image, flip(F.col(image)))
