"""Tensor shard files as a Spark data source, and the sink that writes them.

A shard file is an 8-byte little-endian header length, a JSON header naming each tensor's dtype, shape and
byte range, then the raw tensors. Only the wanted tensors and row ranges are read; large shards are cut into
several partitions by file size, so one huge shard does not become one task.

Where the session has ``spark.sql.python.filterPushdown.enabled``, comparisons of ``path``, ``shard``, ``local_index`` and
``view`` with values are pushed: files they exclude are not opened, and of the others only the tensors and rows that can
match are read. Spark cannot tell a Python source which columns are used, so ``columns`` names those wanted; tensors that
none of them needs are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from shardloom.functions.batches import bytes_column, list_column, matrix
from shardloom.functions.parsing import shard_number
from shardloom.session import broadcast_if_small, materialize, require
from shardloom.sources.files import list_files, open_fs
from shardloom.spec import DatasetSpec

FORMAT = "tensor_shards"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
# Dtype names of the shard format and their little-endian numpy forms (BF16 is widened by hand).
DTYPES = {
    "BOOL": "|b1", "U8": "|u1", "I8": "|i1", "I16": "<i2", "U16": "<u2", "I32": "<i4", "U32": "<u4",
    "I64": "<i8", "U64": "<u8", "F16": "<f2", "BF16": "<u2", "F32": "<f4", "F64": "<f8",
}
# Fixed value: order in which a view is picked when none is named.
VIEW_ORDER = ["samples", "latents", "latents_flip"]
_PARTITION_BYTES = 128 << 20
_BATCH_BYTES = 16 << 20
_MAX_HEADER = 100 << 20

SAMPLE_SCHEMA = (
    "path string, shard int, local_index bigint, view string, tensor array<float>, label bigint, source_index bigint"
)
IMAGE_SCHEMA = "path string, shard int, local_index bigint, image binary, label bigint, source_index bigint"
HEADER_SCHEMA = (
    "path string, shard_index int, bytes bigint, num_samples bigint, "
    "tensors array<struct<name:string,dtype:string,shape:array<bigint>>>, latent_shape array<bigint>, "
    "flip_shape array<bigint>, label_shape array<bigint>, label_dtype string, has_latents_flip boolean, "
    "label_min bigint, label_max bigint, metadata map<string,string>, read_error string"
)


def read_header(handle) -> tuple[dict, dict, int]:
    """Tensors by name, file metadata, and the offset of the first tensor byte."""
    handle.seek(0)
    lead = handle.read(8)
    if len(lead) < 8:
        raise ValueError("truncated file: no header length")
    length = int.from_bytes(lead, "little")
    if length > _MAX_HEADER:
        raise ValueError("truncated or foreign file: impossible header length")
    raw = handle.read(length)
    if len(raw) < length:
        raise ValueError("truncated file: header cut short")
    tensors = json.loads(raw)
    meta = tensors.pop("__metadata__", {}) or {}
    base = 8 + length
    end = base + max((t["data_offsets"][1] for t in tensors.values()), default=0)
    handle.seek(0, 2)
    if handle.tell() < end:
        raise ValueError("truncated file: tensors cut short")
    return tensors, meta, base


def read_rows(handle, info: dict, base: int, start: int, stop: int) -> np.ndarray:
    """Rows ``[start, stop)`` of a tensor; BF16 widens to float32 exactly by a 16-bit shift."""
    shape, kind = info["shape"], np.dtype(DTYPES[info["dtype"]])
    row = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
    handle.seek(base + info["data_offsets"][0] + start * row)
    values = np.frombuffer(handle.read((stop - start) * row), dtype=kind).reshape([stop - start, *shape[1:]])
    if info["dtype"] == "BF16":
        return (values.astype(np.uint32) << 16).view(np.float32)
    return values


class _Rows(InputPartition):
    """The ``part``-th of ``parts`` row ranges of one file."""

    def __init__(self, path: str, shard: int, part: int, parts: int):
        self.path, self.shard, self.part, self.parts = path, shard, part, parts


class TensorShardSource(DataSource):
    """Options: path, glob, mode (samples | images | headers), views, channels, height, width, partition_bytes, columns, push."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        whole = {"headers": HEADER_SCHEMA, "images": IMAGE_SCHEMA}.get(self.options.get("mode", "samples"), SAMPLE_SCHEMA)
        if "columns" not in self.options:
            return whole
        fields, wanted = dict(f.split(" ", 1) for f in whole.split(", ")), self.options["columns"].split(",")
        if unknown := [c for c in wanted if c not in fields]:
            raise ValueError(f"no columns {unknown}; there are {list(fields)}")
        return ", ".join(f"{c} {fields[c]}" for c in wanted)

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _PushingShardReader if self.options.get("push") == "true" else _ShardReader
        return kind(dict(self.options), schema)


class _Limits:
    """What pushed comparisons leave of one column: a range, both ends included, or a set of values."""

    def __init__(self) -> None:
        self.low = self.high = self.values = None

    def narrow(self, found: Filter) -> None:
        if isinstance(found, (EqualTo, In)):
            values = {found.value} if isinstance(found, EqualTo) else set(found.value)
            self.values = values if self.values is None else self.values & values
        elif isinstance(found, (GreaterThan, GreaterThanOrEqual)):
            self.low = found.value if self.low is None else max(self.low, found.value)
        else:
            self.high = found.value if self.high is None else min(self.high, found.value)

    def admits(self, value) -> bool:
        if self.values is not None and value not in self.values:
            return False
        return (self.low is None or value >= self.low) and (self.high is None or value <= self.high)

    def span(self, start: int, stop: int) -> tuple[int, int]:
        """The part of a half-open range of numbers that can match."""
        values = [v for v in self.values if v is not None] if self.values is not None else None
        if values is not None:
            start, stop = (max(start, min(values)), min(stop, max(values) + 1)) if values else (start, start)
        return max(start, self.low if self.low is not None else start), min(stop, self.high + 1 if self.high is not None else stop)


class _ShardReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.mode = options.get("mode", "samples")
        self.limits: dict[str, _Limits] = {}

    def _admits(self, column: str, value) -> bool:
        return column not in self.limits or self.limits[column].admits(value)

    def partitions(self) -> list[InputPartition]:
        files = list_files(self.options["path"], self.options.get("glob", "*.safetensors"))
        target = int(self.options.get("partition_bytes", _PARTITION_BYTES))
        out = []
        for path, size in files:
            found = re.search(r"shard(\d+)\.safetensors$", path)
            shard = int(found.group(1)) if found else -1
            if not (self._admits("path", path) and self._admits("shard", shard)):
                continue
            parts = 1 if self.mode == "headers" else max(1, -(-size // target))
            out += [_Rows(path, shard, i, parts) for i in range(parts)]
        return out

    def read(self, partition: _Rows):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        fs, inner = open_fs(partition.path)
        if self.mode == "headers":
            yield pa.RecordBatch.from_pylist([self._header(fs, inner, partition)], schema)
            return
        with fs.open_input_file(inner) as handle:
            tensors, _, base = read_header(handle)
            views = ["images"] if self.mode == "images" else self._views(tensors, partition.path)
            n = tensors["labels"]["shape"][0] if "labels" in tensors else tensors[views[0]]["shape"][0]
            start, stop = (n * k // partition.parts for k in (partition.part, partition.part + 1))
            if "local_index" in self.limits:
                start, stop = self.limits["local_index"].span(start, stop)
            for view in views:
                self._check(tensors[view], view, n, partition.path)
                if self.mode != "images" and not self._admits("view", view):
                    continue
                width = int(np.prod(tensors[view]["shape"][1:], dtype=np.int64))
                step = max(1, _BATCH_BYTES // (4 * max(1, width)))
                for at in range(start, stop, step):
                    upto = min(stop, at + step)
                    yield self._batch(handle, tensors, base, view, partition, at, upto, schema)

    def _views(self, tensors: dict, path: str) -> list[str]:
        wanted = self.options.get("views", "latents")
        if wanted == "auto":
            return [next(v for v in VIEW_ORDER if v in tensors)]
        names = [v.strip() for v in wanted.split(",") if v.strip()]
        missing = [v for v in names if v not in tensors]
        if missing:
            raise KeyError(f"{path} has no tensors {missing}; present: {sorted(tensors)}")
        return names

    def _check(self, info: dict, view: str, n: int, path: str) -> None:
        shape = info["shape"]
        want = [int(self.options[k]) for k in ("channels", "height", "width") if k in self.options]
        if len(shape) != 4 or shape[0] != n or (want and shape[1:] != want):
            raise ValueError(f"{path}: {view} has shape {shape}, expected [{n}, {', '.join(map(str, want))}]")

    def _batch(self, handle, tensors, base, view, partition, start, stop, schema):
        n, wanted = stop - start, {f.name for f in schema}
        rows = None
        if wanted & {"image", "tensor"}:
            rows = read_rows(handle, tensors[view], base, start, stop).reshape(n, -1)
        columns = {
            "path": pa.array([partition.path] * n), "shard": pa.array([partition.shard] * n, pa.int32()),
            "local_index": pa.array(np.arange(start, stop)),
        }
        columns["view"] = pa.array([view] * n)
        if rows is not None and self.mode == "images":
            columns["image"] = bytes_column(np.ascontiguousarray(rows).view(np.uint8).reshape(n, -1))
        elif rows is not None:
            columns["tensor"] = list_column(rows.astype(np.float32), pa.float32())
        for name, key in (("label", "labels"), ("source_index", "source_indices")):
            if name not in wanted:
                continue
            if key in tensors:
                columns[name] = pa.array(read_rows(handle, tensors[key], base, start, stop).astype(np.int64))
            else:
                columns[name] = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    def _header(self, fs, inner: str, partition: _Rows) -> dict:
        row = {"path": partition.path, "shard_index": partition.shard, "num_samples": 0, "has_latents_flip": False}
        try:
            row["bytes"] = fs.get_file_info(inner).size
            with fs.open_input_file(inner) as handle:
                tensors, meta, base = read_header(handle)
                row["tensors"] = [{"name": k, "dtype": t["dtype"], "shape": t["shape"]} for k, t in sorted(tensors.items())]
                row["metadata"] = list({str(k): str(v) for k, v in meta.items()}.items())
                main = next((v for v in [*VIEW_ORDER, "images"] if v in tensors), None)
                if main:
                    row["latent_shape"] = tensors[main]["shape"]
                if "latents_flip" in tensors:
                    row["flip_shape"], row["has_latents_flip"] = tensors["latents_flip"]["shape"], True
                if "labels" in tensors:
                    info = tensors["labels"]
                    row["label_shape"], row["label_dtype"] = info["shape"], info["dtype"]
                    row["num_samples"] = info["shape"][0] if info["shape"] else 0
                    if len(info["shape"]) == 1 and info["shape"][0]:
                        labels = read_rows(handle, info, base, 0, info["shape"][0])
                        row["label_min"], row["label_max"] = int(labels.min()), int(labels.max())
        except Exception as exc:  # an unreadable shard is a row with its reason
            row["read_error"] = f"{type(exc).__name__}: {exc}"
        return row


class _PushingShardReader(_ShardReader):
    """Spark refuses a reader with ``pushFilters`` where the session has pushing switched off."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  Spark's name
        for found in filters:
            kinds = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
            if isinstance(found, kinds) and len(found.attribute) == 1 and found.attribute[0] in ("path", "shard", "local_index", "view"):
                self.limits.setdefault(found.attribute[0], _Limits()).narrow(found)
            yield found  # all are checked again by Spark: ranges are narrowed to whole numbers, both ends included


def _source(spark: SparkSession, path: str, glob: str, **options):
    if options.get("mode") != "headers" and spark.conf.get(PUSHDOWN, "false") == "true":
        options["push"] = "true"
    spark.dataSource.register(TensorShardSource)
    reader = spark.read.format(FORMAT).option("path", path).option("glob", glob)
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, str(v))
    return reader.load()


def read_tensor_shards(
    spark: SparkSession, path: str, spec: DatasetSpec, views: Sequence[str] = ("latents",),
    glob: str = "*.safetensors", partition_bytes: int | None = None, columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per (shard, local_index, view). ``views=('auto',)`` takes samples, latents or latents_flip; ``columns`` are
    those to read, all if it is None."""
    return _source(
        spark, path, glob, views=",".join(views), channels=spec.channels, height=spec.height, width=spec.width,
        partition_bytes=partition_bytes, columns=columns and ",".join(columns),
    )


def read_image_shards(
    spark: SparkSession, path: str, spec: DatasetSpec, glob: str = "*.safetensors", partition_bytes: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    return _source(
        spark, path, glob, mode="images", channels=spec.channels, height=spec.height, width=spec.width,
        partition_bytes=partition_bytes, columns=columns and ",".join(columns),
    )


def read_shard_headers(spark: SparkSession, path: str, glob: str = "*.safetensors") -> DataFrame:
    """Header facts only; label range from the labels tensor. Unreadable files carry ``read_error``."""
    return _source(spark, path, glob, mode="headers")


def write_tensor_shards(
    df: DataFrame, path: str, spec: DatasetSpec, tensors: Sequence[str] = ("latents",), dtype: str = "F32",
    shard_size: int = 4096, prefix: str = "latents_rank00_shard", index: str = "global_index",
    metadata: dict | None = None,
) -> DataFrame:
    """One file per ``index div shard_size``, rows in index order; returns ``(path, rows, bytes, sha256)``.

    Every row becomes one piece per tensor; pieces are shuffled to their shard, sorted in the order of the file by Spark (which
    spills) and written as they come, so a worker holds a batch of pieces, not a shard. Files appear under their name only
    when complete, and a retried task writes the same bytes again.
    """
    require(dtype in ("F32", "BF16", "F16", "U8"), f"unsupported dtype {dtype}")
    shape, size = spec.shape, spec.size
    numbers = [("labels", "label")] + ([("source_indices", "source_index")] if "source_index" in df.columns else [])
    columns = [*tensors, *(c for _, c in numbers)]
    # name in the file, dtype, shape of a row and its bytes, in file order
    layout = [(name, dtype, list(shape), size * _ITEM_BYTES[dtype]) for name in tensors] + [(name, "I64", [], 8) for name, _ in numbers]
    meta = {str(k): str(v) for k, v in (metadata or {}).items()}
    root = path.rstrip("/")

    def pieces(batches):
        for batch in batches:
            step = max(1, _BATCH_BYTES // max(1, 8 * size))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                for number, name in enumerate(columns):
                    blob = _encode(part.column(f"__{number}"), size, layout[number][1]) if number < len(tensors) else _whole_numbers(part.column(f"__{number}"), name)
                    data = pa.array([row.tobytes() for row in blob], pa.binary())
                    numbered = pa.array(np.full(part.num_rows, number, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([part.column("__shard"), part.column("__n"), numbered, part.column("__id"), data], ["shard", "n", "number", "id", "data"])

    def write(batches):
        current = None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if current is None or current.shard != shards[low]:
                    if current is not None:
                        yield current.finish()
                    current = _ShardFile(f"{root}/{prefix}{int(shards[low]):06d}.safetensors", shards[low], batch.column("n")[int(low)].as_py(), layout, meta)
                for data in batch.column("data").slice(low, high - low):
                    current.write(data.as_buffer())
        if current is not None:
            yield current.finish()

    shard = F.floor(F.col(index) / shard_size).cast("bigint")
    sizes = materialize(df.groupBy(shard.alias("__shard")).agg(F.count("*").alias("__n")), "shard_sizes")
    rows = df.select(shard.alias("__shard"), F.col(index).cast("bigint").alias("__id"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)])
    rows = rows.join(broadcast_if_small(sizes), "__shard").mapInArrow(pieces, "shard bigint, n bigint, number int, id bigint, data binary")
    ordered = rows.repartition("shard").sortWithinPartitions("shard", "number", "id")
    # writing happens once, here; the facts about the files are kept as a table
    return materialize(ordered.mapInArrow(write, "path string, rows bigint, bytes bigint, sha256 string"), "written")


#: Bytes of a value in the dtypes that can be written.
_ITEM_BYTES = {"F32": 4, "BF16": 2, "F16": 2, "U8": 1}


def _encode(column: pa.Array, size: int, dtype: str) -> np.ndarray:
    """One row of encoded values per tensor."""
    values = matrix(column, size)
    if dtype == "BF16":
        bits = values.astype("<f4").view("<u4")
        # round to nearest even on the dropped half
        return ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype("<u2")
    return values.astype(DTYPES[dtype])


def _whole_numbers(column: pa.Array, name: str) -> np.ndarray:
    if column.null_count:
        raise ValueError(f"{name} must not be null")
    return column.to_numpy(zero_copy_only=False).astype("<i8")[:, None]


class _ShardFile:
    """A shard file being written piece by piece in file order, under a name of its own until it is complete."""

    def __init__(self, target: str, shard: int, rows: int, layout: list[tuple], meta: dict):
        self.target, self.shard, self.rows = target, shard, rows
        header, at = {"__metadata__": meta} if meta else {}, 0
        for name, dtype, dims, size in layout:
            header[name] = {"dtype": dtype, "shape": [rows, *dims], "data_offsets": [at, at + rows * size]}
            at += rows * size
        head = json.dumps(header, separators=(",", ":")).encode()
        head += b" " * (-len(head) % 8)
        self.expected = 8 + len(head) + at
        self.fs, self.inner = open_fs(target)
        self.fs.create_dir(self.inner.rsplit("/", 1)[0], recursive=True)
        self.attempt = f"{self.inner}.{uuid.uuid4().hex}.tmp"
        self.out, self.digest, self.total = self.fs.open_output_stream(self.attempt), hashlib.sha256(), 0
        self.write(len(head).to_bytes(8, "little") + head)

    def write(self, data) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.total += len(data)

    def finish(self) -> pa.RecordBatch:
        self.out.close()
        if self.total != self.expected:
            raise ValueError(f"{self.target}: {self.total} bytes written, {self.expected} expected; the rows changed between two reads")
        self.fs.move(self.attempt, self.inner)
        return pa.RecordBatch.from_pydict({"path": [self.target], "rows": [self.rows], "bytes": [self.total], "sha256": [self.digest.hexdigest()]})


def registry_rows(headers: DataFrame) -> DataFrame:
    """Header rows in the form the registry operators take: C,H,W without N."""
    return headers.withColumn("latent_shape", F.slice("latent_shape", 2, 3)).withColumn(
        "shard_index", shard_number(F.col("path"))
    )
