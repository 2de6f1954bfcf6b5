"""Paired errors: pixels and vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.functions.arrays import as_double
from shardloom.functions.batches import bytes_column, bytes_matrix, extended_schema, list_column, matrix
from shardloom.functions.joins import join_groups
from shardloom.functions.quantiles import exact_quantiles
from shardloom.operators.stats import tensor_partials
from shardloom.session import materialize, require
from shardloom.spec import DatasetSpec


def image_summary(df: DataFrame, spec: DatasetSpec, by: Sequence[str] = (), image: str = "image") -> DataFrame:
    """Values / 255: min, max, mean, population std, and mean/std per colour channel.

    Tasks fold whole images; the sums are whole numbers until the last step, so nothing drifts.
    """
    by = list(by)
    exact = "decimal(38,0)"
    per = tensor_partials(df, spec, by, image).groupBy(*by, "channel").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast(exact)).alias("s"), F.sum(F.col("ss").cast(exact)).alias("ss"),
        F.min("mn").alias("mn"), F.max("mx").alias("mx"),
    )

    def mean(n, s):
        return s.cast("double") / n / 255.0

    def spread(n, s, ss):
        s, ss = s.cast("double"), ss.cast("double")
        return F.sqrt(F.greatest(F.lit(0.0), ss / n - (s / n) * (s / n))) / 255.0

    n, s, ss = F.col("n"), F.col("s"), F.col("ss")
    total = per.groupBy(*by).agg(
        F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(ss).alias("ss"),
        (F.min("mn") / 255.0).alias("min"), (F.max("mx") / 255.0).alias("max"),
        *[
            F.max(F.when(F.col("channel") == c, value)).alias(f"{name}_{c}")
            for c in range(spec.channels)
            for name, value in (("channel_mean", mean(n, s)), ("channel_std", spread(n, s, ss)))
        ],
    )
    return total.withColumn("mean", mean(n, s)).withColumn("std", spread(n, s, ss)).withColumnRenamed("n", "count").drop("s", "ss")


def array_to_bytes(df: DataFrame, spec: DatasetSpec, image: str = "image") -> DataFrame:
    """``array<int>`` of 0..255 to ``binary``."""
    size = spec.size

    @F.arrow_udf("binary")
    def pack(images: pa.Array) -> pa.Array:
        return bytes_column(matrix(images, size).astype(np.uint8))

    return df.withColumn(image, pack(F.col(image)))


def pair_images(original: DataFrame, recon: DataFrame, key: str = "global_index", image: str = "image") -> DataFrame:
    right = recon.select(key, F.col(image).alias("recon"), *([c for c in ("name",) if c in recon.columns]))
    return original.select(key, F.col(image).alias("original")).join(right, key)


def image_errors(pairs: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Per image: integer squared and absolute error sums and the largest difference."""
    kept = [c for c in pairs.columns if c not in ("original", "recon")]
    if pairs.schema["original"].dataType.typeName() == "binary":
        return _byte_errors(pairs, spec, kept)
    diff = F.zip_with("original", "recon", lambda a, b: b.cast("int") - a.cast("int"))
    zero = F.lit(0).cast("bigint")
    sized = F.when(
        (F.size("original") == spec.size) & (F.size("recon") == spec.size), diff
    ).otherwise(F.raise_error(F.lit("pixel shape mismatch")))
    rows = pairs.select(*kept, sized.alias("__d"))
    return rows.select(
        *kept, F.lit(spec.size).cast("bigint").alias("n"),
        F.aggregate("__d", zero, lambda acc, v: acc + v * v).alias("sq"),
        F.aggregate("__d", zero, lambda acc, v: acc + F.abs(v)).alias("ab"),
        F.array_max(F.transform("__d", F.abs)).alias("mx"),
    )


def _byte_errors(pairs: DataFrame, spec: DatasetSpec, kept: list[str]) -> DataFrame:
    size = spec.size
    schema = extended_schema(pairs.select(*kept).schema, "n bigint, sq bigint, ab bigint, mx int")

    def fold(batches):
        for batch in batches:
            d = bytes_matrix(batch.column("recon"), size).astype(np.int32) - bytes_matrix(batch.column("original"), size)
            columns = {c: batch.column(c) for c in kept}
            columns["n"] = pa.array(np.full(len(d), size, dtype=np.int64))
            columns["sq"] = pa.array(np.einsum("ij,ij->i", d, d, dtype=np.int64))
            columns["ab"] = pa.array(np.abs(d).sum(axis=1, dtype=np.int64))
            columns["mx"] = pa.array(np.abs(d).max(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_pydict(columns)

    return pairs.mapInArrow(fold, schema)


def pixel_error(pairs: DataFrame, spec: DatasetSpec, by: Sequence[str] = ()) -> DataFrame:
    """Global and per-image MSE, MAE, PSNR (inf when identical), medians exact at any size."""
    by = list(by)
    # one narrow row per image: the medians reread these, not the images
    per = materialize(image_errors(pairs, spec), "image-errors").withColumn("mse", F.col("sq") / F.col("n") / (255.0 * 255.0)).withColumn(
        "mae", F.col("ab") / F.col("n") / 255.0
    )
    inf = F.lit(float("inf"))

    def psnr(mse):
        return F.when(mse <= 0, inf).otherwise(10.0 * F.log10(1.0 / mse))

    per = per.withColumn("__psnr", psnr(F.col("mse"))).withColumn(
        "psnr", F.when(F.col("__psnr") < inf, F.col("__psnr"))
    )
    total = per.groupBy(*by).agg(
        F.sum("n").alias("count_values"), (F.sum("sq") / F.sum("n") / (255.0 * 255.0)).alias("mse"),
        (F.sum("ab") / F.sum("n") / 255.0).alias("mae"), F.max("mx").alias("max_abs_uint8"),
        F.count("*").alias("image_count"), F.avg("mse").alias("image_mse_mean"), F.avg("mae").alias("image_mae_mean"),
        F.coalesce(F.avg("psnr"), inf).alias("image_psnr_mean"),
    ).withColumn("rmse", F.sqrt("mse")).withColumn("psnr_global", psnr(F.col("mse")))
    kinds = F.explode(
        F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("mse", "mae", "psnr")])
    )
    long = per.select(*by, kinds.alias("k")).select(*by, "k.kind", "k.value")
    medians = exact_quantiles(long, "value", [0.5], [*by, "kind"])
    wide = medians.groupBy(*by).agg(
        *[F.max(F.when(F.col("kind") == c, F.get("q", F.lit(0)))).alias(f"image_{c}_median") for c in ("mse", "mae", "psnr")]
    ).withColumn("image_psnr_median", F.coalesce("image_psnr_median", inf))
    return join_groups(total, wide, by)


def rel_error(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """|a-b| / (|a| + 1e-12) with norms over the whole group; ``a`` is the reference vector."""
    zero = F.lit(0.0)
    x, y = as_double(F.col(a)), as_double(F.col(b))
    diff = F.zip_with(x, y, lambda p, q: p - q)
    rows = pairs.select(
        *by,
        F.aggregate(x, zero, lambda acc, v: acc + v * v).alias("__aa"),
        F.aggregate(y, zero, lambda acc, v: acc + v * v).alias("__bb"),
        F.aggregate(diff, zero, lambda acc, v: acc + v * v).alias("__dd"),
        F.array_max(F.transform(diff, F.abs)).alias("__mx"),
    )
    out = rows.groupBy(*by).agg(
        F.sqrt(F.sum("__aa")).alias("a_norm"), F.sqrt(F.sum("__bb")).alias("b_norm"),
        F.sqrt(F.sum("__dd")).alias("diff_norm"), F.max("__mx").alias("max_abs"),
    )
    return out.withColumn("rel_error", F.col("diff_norm") / (F.col("a_norm") + 1e-12))


def random_projection(
    df: DataFrame, spec: DatasetSpec, dim: int = 128, size: int = 32, seed: int = 20260527, image: str = "image",
    out: str = "features",
) -> DataFrame:
    """Images / 255, bilinear to ``size`` x ``size``, times a fixed Gaussian matrix.

    The matrix is drawn once on the driver (it depends on the seed only) and shipped with the function;
    resizing gathers four pixels per target with half-pixel centres.
    """
    require(spec.size > 0, "empty spec")
    flat = spec.channels * size * size
    projection = np.random.default_rng(seed).normal(0.0, 1.0 / np.sqrt(flat), size=(flat, dim))
    shared = df.sparkSession.sparkContext.broadcast(projection)
    rows, cols = _bilinear_taps(spec.height, size), _bilinear_taps(spec.width, size)
    channels, height, width, total = spec.channels, spec.height, spec.width, spec.size
    binary = df.schema[image].dataType.typeName() == "binary"
    kept = [c for c in df.columns if c != image]
    schema = extended_schema(df.select(*kept).schema, f"{out} array<double>")

    def project(batches):
        for batch in batches:
            column = batch.column(image)
            raw = bytes_matrix(column, total) if binary else np.asarray(column.flatten()).reshape(-1, total)
            # single precision up to the resize, as images are stored
            x = raw.reshape(-1, channels, height, width).astype(np.float32) / np.float32(255.0)
            if (height, width) != (size, size):
                x = _resize(x, rows, cols)
            features = x.reshape(len(x), -1).astype(np.float64) @ shared.value
            columns = {c: batch.column(c) for c in kept}
            columns[out] = list_column(features, pa.float64())
            yield pa.RecordBatch.from_pydict(columns)

    return df.select(*kept, image).mapInArrow(project, schema)


def _bilinear_taps(source: int, target: int):
    at = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0.0, None)
    low = np.minimum(at.astype(np.int64), source - 1)
    return low, np.minimum(low + 1, source - 1), (at - low).astype(np.float32)


def _resize(x: np.ndarray, rows, cols) -> np.ndarray:
    top, bottom, wy = rows
    left, right, wx = cols
    wy = wy[:, None]
    upper = x[:, :, top][..., left] * (1 - wx) + x[:, :, top][..., right] * wx
    lower = x[:, :, bottom][..., left] * (1 - wx) + x[:, :, bottom][..., right] * wx
    return upper * (1 - wy) + lower * wy
