"""File listings and byte access on whatever file system a path names."""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

_CHUNK = 8 << 20


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system a path names and the path inside it."""
    if "://" in path:
        return pafs.FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a://") else path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def list_files(path: str, glob: str = "*", recursive: bool = False) -> list[tuple[str, int]]:
    """``(path, bytes)`` of the matching files below a folder, in path order."""
    path = path.rstrip("/")
    fs, root = open_fs(path)
    root = root.rstrip("/")
    found = fs.get_file_info(pafs.FileSelector(root, recursive=recursive, allow_not_found=True))
    lead = path[: len(path) - len(root)]  # scheme and authority, if any
    hits = [
        (lead + f.path, f.size)
        for f in found
        if f.type == pafs.FileType.File and fnmatch.fnmatch(posixpath.basename(f.path), glob)
    ]
    return sorted(hits)


def list_folders(path: str, glob: str, holding: str) -> list[str]:
    """Matching folders right below a folder that hold a file of the given name, in path order. No file is listed."""
    path = path.rstrip("/")
    fs, root = open_fs(path)
    lead = path[: len(path) - len(root)]
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    folders = sorted(f.path for f in found if f.type == pafs.FileType.Directory and fnmatch.fnmatch(posixpath.basename(f.path), glob))
    marks = fs.get_file_info([f"{f}/{holding}" for f in folders]) if folders else []
    return [lead + f for f, mark in zip(folders, marks, strict=True) if mark.type == pafs.FileType.File]


def remove_folder(path: str) -> None:
    """Remove a folder and what is in it; one that is not there is fine."""
    fs, root = open_fs(path.rstrip("/"))
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)


def file_table(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """``(path, name, bytes)`` of the files below a folder."""
    rows = list_files(path, glob, recursive)
    return spark.createDataFrame(rows, "path string, bytes bigint").withColumn(
        "name", F.element_at(F.split("path", "/"), -1)
    )


def checksum(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``sha256`` of each file's bytes, read in chunks; no file is ever one value."""
    from shardloom.functions.batches import extended_schema

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for name in batch.column(path).to_pylist():
                fs, inner = open_fs(name)
                h = hashlib.sha256()
                with fs.open_input_file(inner) as f:
                    while block := f.read(_CHUNK):
                        h.update(block)
                sums.append(h.hexdigest())
            yield pa.RecordBatch.from_pydict(
                {**{c: batch.column(c) for c in batch.schema.names}, "sha256": pa.array(sums, pa.string())}
            )

    spread = files.repartition(files.sparkSession.sparkContext.defaultParallelism, F.col(path))
    return spread.mapInArrow(digest, extended_schema(files.schema, "sha256 string"))


def publish_selection(files: DataFrame, include: list[str], exclude: list[str], path: str = "path") -> DataFrame:
    """Adds ``published``: matches an include pattern and no exclude pattern."""
    def any_of(patterns: list[str]):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.col(path).rlike(p)
        return hit

    return files.withColumn("published", any_of(include) & ~any_of(exclude))


def selection_summary(selected: DataFrame, size: str = "bytes") -> DataFrame:
    return selected.groupBy("published").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
