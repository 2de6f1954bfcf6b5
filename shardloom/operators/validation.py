"""Checks on shards, whole datasets, derivation order and pairs. Problems are rows, not exceptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shardloom.functions.hashing import hex_prefix
from shardloom.functions.joins import with_row
from shardloom.session import materialize, require

# Spellings of a 64-bit integer dtype in shard headers.
INT64_NAMES = ["I64", "int64", "torch.int64"]


def validate_shards(headers: DataFrame, strict: bool = False, order: str = "path") -> DataFrame:
    """Adds ``status`` (ok / error) and ``error`` text per shard.

    ``headers``: path, read_error, label_shape, latent_shape (with N), flip_shape (null when absent).
    The tensor shape to agree on is the first valid shard's. With ``strict`` the first error is raised;
    no valid shard at all is always an error.
    """
    rank_ok = F.size("latent_shape") == 4
    local = (
        F.when(F.col("read_error").isNotNull(), F.col("read_error"))
        .when(F.col("latent_shape").isNull() & F.col("label_shape").isNull(), "missing keys [labels, latents]")
        .when(F.col("latent_shape").isNull(), "missing keys [latents]")
        .when(F.col("label_shape").isNull(), "missing keys [labels]")
        .when(F.size("label_shape") != 1, "labels must be [N]")
        .when(~rank_ok, "latents must be [N,C,H,W]")
        .when(F.get("label_shape", F.lit(0)) != F.get("latent_shape", F.lit(0)), "labels/latents N mismatch")
        .when(F.col("flip_shape").isNotNull() & (F.col("flip_shape") != F.col("latent_shape")), "flip shape mismatch")
    )
    checked = headers.withColumn("error", local).withColumn("__chw", F.slice("latent_shape", 2, 3))
    first = checked.where(F.col("error").isNull()).agg(F.min_by("__chw", order)).first()[0]
    if first is None:
        require(checked.limit(1).count() == 0 and not strict, "no valid shard")
        return checked.withColumn("status", F.lit("error")).drop("__chw")
    agreed = F.array(*[F.lit(int(v)).cast("bigint") for v in first])
    changed = F.col("error").isNull() & (F.col("__chw").cast("array<bigint>") != agreed)
    out = checked.withColumn("error", F.when(changed, "latent shape changed").otherwise(F.col("error"))).drop("__chw")
    out = out.withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))
    if strict:
        bad = out.where(F.col("status") == "error").agg(F.min_by(F.struct(order, "error"), order)).first()[0]
        require(bad is None, f"{bad and bad[0]}: {bad and bad[1]}")
    return out


def quarantine(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("status") == "error")


def verify_dataset(
    headers: DataFrame, expected_total: int | None = None, expected_shape: Sequence[int] | None = None,
    flip_required: bool = True,
) -> DataFrame:
    """One row of checks over shard headers: contiguous numbers from 0, shapes, label dtype, totals.

    ``headers``: shard_index, num_samples, bytes, label_shape, latent_shape, flip_shape, label_dtype.
    """
    n = F.col("num_samples")
    shapes = (
        (F.size("label_shape") == 1) & (F.get("label_shape", F.lit(0)) == n)
        & (F.size("latent_shape") == 4) & (F.get("latent_shape", F.lit(0)) == n)
    )
    if flip_required:
        shapes = shapes & F.col("flip_shape").eqNullSafe(F.col("latent_shape"))
    if expected_shape is not None:
        want = F.array(*[F.lit(int(v)).cast("bigint") for v in expected_shape])
        shapes = shapes & (F.slice("latent_shape", 2, 3).cast("array<bigint>") == want)
    # numbers are 0..n-1 exactly when the smallest is 0, the largest n-1 and none repeats
    per_number = headers.groupBy("shard_index").agg(
        F.count("*").alias("__files"), F.sum("num_samples").alias("__n"), F.sum("bytes").alias("__b"),
        F.bool_and(F.coalesce(shapes, F.lit(False))).alias("__shape"),
        F.bool_and(F.coalesce(F.col("label_dtype").isin(INT64_NAMES), F.lit(False))).alias("__dtype"),
    )
    total = per_number.agg(
        F.coalesce(F.sum("__files"), F.lit(0)).alias("num_files"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total_samples"),
        F.coalesce(F.sum("__b"), F.lit(0)).alias("total_bytes"),
        F.coalesce(
            (F.min("shard_index") == 0) & (F.max("shard_index") == F.count("*") - 1) & (F.max("__files") == 1),
            F.lit(True),
        ).alias("contiguous_shards"),
        F.coalesce(F.bool_and("__shape"), F.lit(True)).alias("shape_ok"),
        F.coalesce(F.bool_and("__dtype"), F.lit(True)).alias("dtype_ok"),
    )
    total_ok = F.lit(True) if expected_total is None else F.col("total_samples") == expected_total
    return total.withColumn("total_ok", total_ok).withColumn(
        "ok",
        (F.col("num_files") > 0) & F.col("contiguous_shards") & F.col("shape_ok") & F.col("dtype_ok") & F.col("total_ok"),
    )


def row_hash(columns: Sequence[str], portable: bool = False) -> Column:
    """64-bit hash of whole rows; ``portable`` hashes their text with md5, repeatable in other engines."""
    if not portable:
        return F.xxhash64(*[F.col(c) for c in columns])
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    return hex_prefix(F.md5(text), 15)


def digest_columns(row: Column) -> list[Column]:
    """Order-insensitive aggregates of row hashes."""
    return [
        F.bit_xor(row).alias("digest_xor"), F.sum(F.pmod(row, F.lit(1_000_003))).alias("digest_sum"),
    ]


def table_digest(df: DataFrame, by: Sequence[str] = (), portable: bool = False) -> DataFrame:
    """Order-insensitive digest of whole rows; equal tables give equal digests."""
    hashed = df.select(*by, row_hash(df.columns, portable).alias("__h"))
    return hashed.groupBy(*by).agg(F.count("*").alias("rows"), *digest_columns(F.col("__h")))


def resume_plan(source: DataFrame, done: DataFrame, key: str = "source_index") -> DataFrame:
    """Source rows without a finished result. ``done`` must list completed work only."""
    return source.join(done.select(key), key, "left_anti")


def resume_after_prefix(source: DataFrame, done: DataFrame, key: str = "source_index") -> DataFrame:
    """The same when finished work is a gap-free prefix: a filter that prunes files; falls back if it is not."""
    n, lo, hi, distinct = done.agg(F.count(key), F.min(key), F.max(key), F.count_distinct(key)).first()
    if n == 0:
        return source
    first = source.agg(F.min(key)).first()[0]
    if lo == first and distinct == hi - lo + 1:
        return source.where(F.col(key) > hi)
    return resume_plan(source, done, key)


def order_audit(source: DataFrame, derived: DataFrame, key: str = "source_index", position: str = "position") -> DataFrame:
    """One row: missing, extra, repeated and out-of-order derived rows and label mismatches.

    ``position`` numbers the derived rows from 0 without gaps. A row is compared with its predecessor through
    an equi-join on ``position``, so no ordered window over the table is needed.
    """
    # three narrow columns, read three times below
    derived = materialize(derived.select(key, "label", position), "derived-order")
    copies = derived.groupBy(key).agg(
        F.count("*").alias("__copies"), F.min("label").alias("__lo"), F.max("label").alias("__hi")
    )
    src = source.select(key, F.col("label").alias("__label"), F.lit(1).alias("__src"))
    matched = src.join(copies, key, "full_outer").agg(
        F.count_if(F.col("__copies").isNull()).alias("gaps"),
        F.count_if(F.col("__src").isNull()).alias("extra"),
        F.coalesce(F.sum(F.when(F.col("__copies") > 1, F.col("__copies") - 1)), F.lit(0)).alias("duplicates"),
        F.count_if(
            F.col("__src").isNotNull() & F.col("__copies").isNotNull()
            & ~(F.col("__label").eqNullSafe(F.col("__lo")) & F.col("__label").eqNullSafe(F.col("__hi")))
        ).alias("label_mismatches"),
    )
    previous = derived.select((F.col(position) + 1).alias(position), F.col(key).alias("__previous"))
    order = derived.join(previous, position).agg(
        F.count_if(F.col(key) <= F.col("__previous")).alias("order_breaks")
    )
    both = with_row(matched, order)
    problems = sum((F.col(c) for c in ("gaps", "extra", "duplicates", "label_mismatches", "order_breaks")), F.lit(0))
    return both.withColumn("ok", problems == 0)


def match_pairs(a: DataFrame, b: DataFrame, key: str = "global_index", label: str = "label") -> DataFrame:
    """One row: matched pairs, equal labels, and the keys only one side has."""
    left = a.select(key, F.col(label).alias("__la"), F.lit(1).alias("__a"))
    right = b.select(key, F.col(label).alias("__lb"), F.lit(1).alias("__b"))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    same = both & F.col("__la").eqNullSafe(F.col("__lb"))
    return left.join(right, key, "full_outer").agg(
        F.count_if(both).alias("matched"), F.count_if(same).alias("labels_equal"),
        F.count_if(F.col("__b").isNull()).alias("only_left"), F.count_if(F.col("__a").isNull()).alias("only_right"),
    ).withColumn(
        "ok",
        (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("labels_equal") == F.col("matched")),
    )
