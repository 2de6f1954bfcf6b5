"""Shard registry: which files exist, what they hold, and where each global index lives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shardloom.functions.joins import with_row
from shardloom.functions.ordering import ordered_bucket, running_before
from shardloom.functions.parsing import evenly_spaced
from shardloom.session import BROADCAST_ROWS, broadcast_if_small, materialize, require


def shard_registry(
    headers: DataFrame, max_shards: int | None = None, max_samples: int | None = None, order: str = "path"
) -> DataFrame:
    """Half-open global ranges and ``shard_pos`` in path order, plus ``source_total_seen``.

    Takes the first ``max_shards``; with ``max_samples`` the last shard is cut and later ones dropped.
    Empty shards never appear. One row per shard, written once, since every later step reads it.
    """
    ranged = running_before(
        headers, [order], ordered_bucket(headers, order), F.col("num_samples"), name="start", position="shard_pos"
    )
    if max_shards is not None:
        ranged = ranged.where(F.col("shard_pos") < max_shards)
    kept = F.col("num_samples")
    if max_samples is not None:
        ranged = ranged.where(F.col("start") < max_samples)
        kept = F.least(kept, F.lit(max_samples) - F.col("start"))
    rows = ranged.withColumn("source_num_samples", F.col("num_samples")).withColumn("num_samples", kept)
    rows = rows.where(F.col("num_samples") > 0).withColumn("end", F.col("start") + F.col("num_samples"))
    rows = rows.withColumn("source_total_seen", F.col("start") + F.col("source_num_samples"))
    return materialize(rows, "registry")


def source_total_seen(registry: DataFrame) -> DataFrame:
    """Samples in the shards that were opened, before any cut."""
    return registry.agg(
        F.coalesce(F.max("source_total_seen"), F.lit(0)).alias("source_total_seen"),
        F.coalesce(F.max("end"), F.lit(0)).alias("total_samples"),
    )


def select_shards(
    registry: DataFrame,
    indices: Sequence[int] | None = None,
    linspace: int | None = None,
    max_shards: int | None = None,
) -> DataFrame:
    """Explicit indices, then evenly spaced, then the first k of a registry, by ``shard_pos``.

    Slices in ``indices`` come from ``parse_index_list``; negatives count from the end. Empty shards hold a
    position in the file list but not in the registry, so select from a registry without them.
    """
    size = registry.count()
    picked: range | list[int] = range(size)
    if indices is not None:
        for i in indices:
            require(-size <= i < size, f"shard index {i} out of range for {size} shards")
        picked = [i % size for i in indices]
    if linspace is not None:
        picked = [picked[i] for i in evenly_spaced(linspace, len(picked))]
    if max_shards is not None:
        picked = picked[:max_shards]
    require(len(picked) > 0, "no shards selected")
    if isinstance(picked, range):
        return registry.where(F.col("shard_pos") < len(picked))
    wanted = registry.sparkSession.createDataFrame([(i,) for i in sorted(set(picked))], "shard_pos bigint")
    return registry.join(broadcast_if_small(wanted), "shard_pos", "left_semi")


def locate(indices: DataFrame, registry: DataFrame, index: str = "global_index") -> DataFrame:
    """Shard and local index of every global index; a negative index wraps once, outside is an error.

    A range join written as an equi-join: shard ranges are cut into index blocks about one average shard
    long (at most twice as many pieces as shards), so a huge shard spreads and the pieces are broadcast only
    when the shard count shows they are few.
    """
    total, shards = registry.agg(F.max("end"), F.count("*")).first()
    require(bool(shards), "the registry is empty")
    block = max(1, -(-total // shards))
    pieces = registry.select(
        "path", "start", "end",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("__block"),
    )
    wrapped = F.when(F.col(index) < 0, F.col(index) + total).otherwise(F.col(index))
    asked = indices.withColumn("__at", wrapped).withColumn(
        "__at",
        F.when((F.col("__at") >= 0) & (F.col("__at") < total), F.col("__at")).otherwise(
            F.raise_error(F.concat(F.lit("index out of range: "), F.col(index).cast("string")))
        ),
    )
    asked = asked.withColumn("__block", F.floor(F.col("__at") / block))
    if shards <= BROADCAST_ROWS // 2:
        pieces = F.broadcast(pieces)
    hit = asked.join(pieces, "__block").where((F.col("__at") >= F.col("start")) & (F.col("__at") < F.col("end")))
    return hit.withColumn("local_index", F.col("__at") - F.col("start")).drop("__block", "__at", "start", "end")


def with_global_index(samples: DataFrame, registry: DataFrame, shard: str = "path") -> DataFrame:
    """``start + local_index``; samples a cut registry no longer covers are dropped."""
    spans = registry.select(shard, F.col("start").alias("__start"), F.col("num_samples").alias("__n"))
    joined = samples.join(broadcast_if_small(spans), shard).where(F.col("local_index") < F.col("__n"))
    return joined.withColumn("global_index", F.col("__start") + F.col("local_index")).drop("__start", "__n")


def dataset_summary(
    registry: DataFrame, quarantine: DataFrame | None = None, expected: int | None = None, k: int = 8,
    order: str = "path",
) -> DataFrame:
    """One row: totals, first and last k shards, skipped files, and ``ready``."""
    totals = registry.agg(
        F.count("*").alias("num_shards"), F.coalesce(F.sum("num_samples"), F.lit(0)).alias("total_samples"),
        F.coalesce(F.max("source_total_seen"), F.lit(0)).alias("source_total_seen"),
    )
    ready = F.lit(None).cast("boolean") if expected is None else F.col("total_samples") == expected
    out = totals.withColumn("ready", ready)
    ends = {"first_shards": registry.orderBy(F.col(order).asc()), "last_shards": registry.orderBy(F.col(order).desc())}
    for name, rows in ends.items():
        listed = rows.limit(k).agg(F.array_join(F.sort_array(F.collect_list(order)), ",").alias(name))
        out = with_row(out, listed)
    if quarantine is None:
        return out.withColumn("skipped_count", F.lit(0).cast("bigint")).withColumn("skipped_first", F.lit(""))
    skipped = quarantine.agg(F.count("*").alias("skipped_count"))
    first = quarantine.orderBy(order).limit(k).agg(
        F.array_join(F.sort_array(F.collect_list(order)), ",").alias("skipped_first")
    )
    return with_row(with_row(out, skipped), first)


def cache_inventory(files: DataFrame, expected: int, headers: DataFrame | None = None) -> DataFrame:
    """Per cache: files, bytes, decimal GB, samples, temp and bad files, completeness and what remains.

    ``files``: cache, name, bytes, is_tmp, is_bad, num_samples (or ``headers`` with name, num_samples).
    """
    if headers is not None:
        files = files.drop("num_samples").join(headers.select("cache", "name", "num_samples"), ["cache", "name"], "left")
    good = ~F.col("is_tmp") & ~F.col("is_bad")
    out = files.groupBy("cache").agg(
        F.count_if(good).alias("files"),
        F.coalesce(F.sum(F.when(good, F.col("num_samples"))), F.lit(0)).alias("samples"),
        F.coalesce(F.sum(F.when(good, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.count_if(F.col("is_tmp")).alias("tmp_files"), F.count_if(F.col("is_bad")).alias("bad_files"),
    )
    done = F.col("samples") / F.lit(expected)
    return (
        out.withColumn("gb", F.col("bytes") / 1e9)
        .withColumn("completeness", done)
        .withColumn("remaining", F.greatest(F.lit(expected) - F.col("samples"), F.lit(0)).cast("bigint"))
        .withColumn("complete", (F.col("samples") == expected) & (F.col("tmp_files") == 0) & (F.col("bad_files") == 0))
    )
