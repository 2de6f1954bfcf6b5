"""Arrow batch helpers shared by the numeric operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as an ``[n, width]`` float64 matrix; every row must have exactly ``width`` values."""
    n = len(column)
    if column.null_count or not np.all(np.asarray(column.value_lengths()) == width):
        raise ValueError(f"every row must hold an array of {width} values")
    values = column.flatten()
    if values.null_count:
        raise ValueError("arrays must not hold nulls")
    return values.to_numpy(zero_copy_only=False).reshape(n, width).astype(np.float64)


def bytes_matrix(column: pa.Array, width: int) -> np.ndarray:
    """A binary column as an ``[n, width]`` uint8 matrix over the column's own buffer."""
    n = len(column)
    lengths = pc.binary_length(column)
    if column.null_count or (n and not np.all(lengths.to_numpy(zero_copy_only=False) == width)):
        raise ValueError(f"every image must hold {width} bytes")
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    if not n or data is None:
        return np.zeros((n, width), dtype=np.uint8)
    start = np.frombuffer(offsets, dtype=np.int64)[wide.offset]
    return np.frombuffer(data, dtype=np.uint8)[start : start + n * width].reshape(n, width)


def bytes_column(values: np.ndarray) -> pa.Array:
    """The rows of an ``[n, width]`` uint8 matrix as a binary column."""
    n, width = values.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int64) * width)
    wide = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(values, dtype=np.uint8))])
    return wide.cast(pa.binary())


def list_column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An ``[n, width]`` matrix as a list column."""
    n, width = values.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).reshape(-1), type=kind))


def group_rows(batch: pa.RecordBatch, keys: list[str]):
    """Yield ``(key tuple, row numbers)`` for the distinct keys of a batch; keys are plain Python values."""
    if not keys:
        yield (), slice(None)
        return
    combined, values = np.zeros(batch.num_rows, dtype=np.int64), []
    for name in keys:
        encoded = batch.column(name).dictionary_encode(null_encoding="encode")
        values.append(encoded.dictionary.to_pylist())
        combined = combined * len(values[-1]) + encoded.indices.to_numpy()
    present, group = np.unique(combined, return_inverse=True)
    order = np.argsort(group, kind="stable")
    for code, rows in zip(present, np.split(order, np.cumsum(np.bincount(group))[:-1])):
        key = []
        for options in reversed(values):
            code, at = divmod(int(code), len(options))
            key.append(options[at])
        yield tuple(reversed(key)), rows


def extended_schema(base: StructType, ddl: str) -> StructType:
    """``base`` plus the columns of a DDL string; leaves ``base`` alone."""
    return StructType([*base.fields, *StructType.fromDDL(ddl).fields])


def key_columns(key: tuple, names: list[str], kinds: dict, rows: int) -> dict[str, pa.Array]:
    """A group key repeated as columns."""
    return {name: pa.array([v] * rows, to_arrow_type(kinds[name])) for name, v in zip(names, key)}
