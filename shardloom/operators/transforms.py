"""Normalising, denormalising, affine statistics, quantising and scale sweeps."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shardloom.functions.arrays import STD_FLOOR, VAR_FLOOR, affine_channels, as_double
from shardloom.functions.joins import join_groups
from shardloom.functions.parsing import scale_slug
from shardloom.operators.sampling import sample_exact
from shardloom.operators.stats import channel_stats, tensor_stats
from shardloom.session import is_small, require
from shardloom.spec import DatasetSpec

# Std and rms of the raw reference representation, for ratio columns.
REFERENCE_STD = 1.7140430386576422
REFERENCE_RMS = 1.7140669521708671

STAT_FIELDS = ("mean", "std", "rms", "min", "max", "absmax")


def fit_normalizer(
    df: DataFrame, spec: DatasetSpec, sample_n: int = 10_000, seed: int = 20260527, tensor: str = "tensor"
) -> DataFrame:
    """``(channel, mean, std, num_samples)`` from an exact sample of the canonical view."""
    if "view" in df.columns:
        df = df.where(F.col("view") == "latents")
    stats = channel_stats(sample_exact(df, sample_n, seed, cap=True, ordered=False), spec, tensor=tensor)
    std = F.sqrt(F.greatest(F.col("std") * F.col("std"), F.lit(VAR_FLOOR)))
    return stats.select("channel", "mean", std.alias("std"), F.col("sample_count").alias("num_samples"))


def channel_vectors(stats: DataFrame, spec: DatasetSpec) -> tuple[list[float], list[float]]:
    """The C-sized mean and std of a normaliser table; must hold exactly one row per channel."""
    rows = stats.select("channel", "mean", "std").orderBy("channel").limit(spec.channels + 1).collect()
    require([r["channel"] for r in rows] == list(range(spec.channels)), f"expected {spec.channels} channel rows")
    return [r["mean"] for r in rows], [max(r["std"], STD_FLOOR) for r in rows]


def normalize(
    df: DataFrame, spec: DatasetSpec, stats: DataFrame, multiplier: float = 1.0, tensor: str = "tensor"
) -> DataFrame:
    """``(x - mean) / max(std, 1e-6) * multiplier`` per channel."""
    mean, std = channel_vectors(stats, spec)
    gain = [multiplier / s for s in std]
    offset = [-m * g for m, g in zip(mean, gain)]
    return df.withColumn(tensor, affine_channels(F.col(tensor), spec, gain, offset))


def denormalize(
    df: DataFrame, spec: DatasetSpec, scale: float = 1.0, shift: float = 0.0, stats: DataFrame | None = None,
    tensor: str = "tensor",
) -> DataFrame:
    """``(z * scale + shift) * std + mean``; without statistics only the scalar step, and identity is free."""
    if stats is None:
        if scale == 1.0 and shift == 0.0:
            return df
        return df.withColumn(tensor, F.transform(as_double(F.col(tensor)), lambda v: v * scale + shift))
    mean, std = channel_vectors(stats, spec)
    gain = [scale * s for s in std]
    offset = [shift * s + m for m, s in zip(mean, std)]
    return df.withColumn(tensor, affine_channels(F.col(tensor), spec, gain, offset))


def affine_stats(stats: DataFrame, scale, shift) -> DataFrame:
    """Statistics of ``scale * x + shift`` from those of x, without touching the data."""
    a = scale if isinstance(scale, Column) else F.lit(float(scale))
    b = shift if isinstance(shift, Column) else F.lit(float(shift))
    low, high = F.col("min") * a + b, F.col("max") * a + b
    rms2 = a * a * F.col("rms") * F.col("rms") + 2.0 * a * b * F.col("mean") + b * b
    moved = {
        "mean": F.col("mean") * a + b,
        "std": F.col("std") * F.abs(a),
        "rms": F.sqrt(F.greatest(rms2, F.lit(0.0))),
        "min": F.least(low, high),
        "max": F.greatest(low, high),
        "absmax": F.greatest(F.abs(low), F.abs(high)),
    }
    kept = [c for c in stats.columns if c not in moved]
    return stats.select(*kept, *[F.col(c).alias(f"sample_space_{c}") for c in STAT_FIELDS],
                        *[v.alias(f"decode_space_{c}") for c, v in moved.items()])


def with_reference_ratios(
    report: DataFrame, ref_std: float = REFERENCE_STD, ref_rms: float = REFERENCE_RMS
) -> DataFrame:
    """Adds std and rms ratios to a reference; null when the reference is 0."""
    for space in ("sample_space", "decode_space"):
        for field, ref in (("std", ref_std), ("rms", ref_rms)):
            ratio = F.col(f"{space}_{field}") / F.lit(ref) if ref else F.lit(None).cast("double")
            report = report.withColumn(f"{space}_{field}_over_reference", ratio)
    return report


def space_report(
    df: DataFrame, spec: DatasetSpec, scale: float = 1.0, shift: float = 0.0, stats: DataFrame | None = None,
    ref_std: float = REFERENCE_STD, ref_rms: float = REFERENCE_RMS, tensor: str = "tensor",
) -> DataFrame:
    """One row: exact statistics before and after the pre-decode transform, with ratios to a reference."""
    sample = tensor_stats(df, spec, tensor=tensor)
    if stats is None:
        return with_reference_ratios(affine_stats(sample, scale, shift), ref_std, ref_rms)
    decoded = tensor_stats(denormalize(df, spec, scale, shift, stats, tensor), spec, tensor=tensor)
    left = sample.select("sample_count", "count", *[F.col(c).alias(f"sample_space_{c}") for c in STAT_FIELDS])
    right = decoded.select("sample_count", *[F.col(c).alias(f"decode_space_{c}") for c in STAT_FIELDS])
    return with_reference_ratios(left.join(right, "sample_count"), ref_std, ref_rms)


def match_scale(stats: DataFrame, ref_std: float = REFERENCE_STD) -> DataFrame:
    """The scale that makes the std equal the reference."""
    return stats.withColumn("matched_scale", F.when(F.col("std") > 0, F.lit(ref_std) / F.col("std")))


def quantize_u8(
    df: DataFrame, mode: str = "auto", by: Sequence[str] = (), tensor: str = "tensor", out: str = "image"
) -> DataFrame:
    """Tensor to 0..255, rounded half to even.

    ``zero1`` clamps to [0,1], ``minus1_1`` to [-1,1]; ``auto`` decides once per group (``by``) from the
    group's min and max.
    """
    require(mode in ("zero1", "minus1_1", "auto"), f"unsupported mode {mode!r}")

    def level(unit: bool) -> Column:
        def one(v):
            if unit:
                return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255.0).cast("int")
            return F.rint((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)) + 1.0) * 127.5).cast("int")

        return F.transform(as_double(F.col(tensor)), one)

    if mode != "auto":
        return df.withColumn(out, level(mode == "zero1"))
    by = list(by)
    span = df.groupBy(*by).agg(
        F.min(F.array_min(tensor)).cast("double").alias("__lo"), F.max(F.array_max(tensor)).cast("double").alias("__hi")
    )
    if by:
        df = join_groups(df, span, by, small=is_small(span))
        unit = (F.col("__lo") >= -0.05) & (F.col("__hi") <= 1.05)
        return df.withColumn(out, F.when(unit, level(True)).otherwise(level(False))).drop("__lo", "__hi")
    lo, hi = span.first()
    return df.withColumn(out, level(lo is not None and lo >= -0.05 and hi <= 1.05))


def scale_sweep(
    df: DataFrame, spec: DatasetSpec, scales: Sequence[float], shift: float = 0.0, stats: DataFrame | None = None,
    ref_std: float = REFERENCE_STD, ref_rms: float = REFERENCE_RMS,
    metric_fn: Callable[[DataFrame, float], DataFrame] | None = None, tensor: str = "tensor",
) -> DataFrame:
    """One row per scale: statistics, reference ratios, metrics and status.

    Without channel statistics every scale follows in closed form from one scan. ``metric_fn(decoded, scale)``
    gives one row with any of ``fid``, ``mmd2``; when it raises, the scale stays as a ``failed`` row.
    """
    require(len(scales) > 0, "at least one scale is required")
    slugs = F.element_at(F.create_map(*[F.lit(v) for s in scales for v in (float(s), scale_slug(s))]), F.col("scale"))
    if stats is None:
        base = tensor_stats(df, spec, tensor=tensor)
        options = base.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
        swept = with_reference_ratios(affine_stats(options, F.col("scale"), shift), ref_std, ref_rms)
    else:
        reports = [
            space_report(df, spec, s, shift, stats, ref_std, ref_rms, tensor).withColumn("scale", F.lit(float(s)))
            for s in scales
        ]
        swept = reports[0]
        for r in reports[1:]:
            swept = swept.unionByName(r)
    swept = swept.withColumn("scale_slug", slugs)
    if metric_fn is None:
        return swept.withColumn("status", F.lit("ok"))
    records = []
    for s in scales:
        try:
            row = metric_fn(denormalize(df, spec, float(s), shift, stats, tensor), float(s)).first().asDict()
            records.append((float(s), "ok", row.get("fid"), row.get("mmd2"), None))
        except Exception as exc:  # a failed scale is a result row
            records.append((float(s), "failed", None, None, f"{type(exc).__name__}: {exc}"[:500]))
    metrics = df.sparkSession.createDataFrame(records, "scale double, status string, fid double, mmd2 double, error string")
    return swept.join(metrics, "scale")


def best_scales(sweep: DataFrame) -> DataFrame:
    """Best by smallest fid and by smallest mmd2, among ok rows that have a fid."""
    usable = sweep.where((F.col("status") == "ok") & F.col("fid").isNotNull())
    by_mmd = F.struct(F.coalesce("mmd2", F.lit(math.inf)), "scale")
    return usable.agg(
        F.min_by("scale", F.struct("fid", "scale")).alias("best_fid_scale"), F.min("fid").alias("best_fid"),
        F.min_by("scale", by_mmd).alias("best_mmd_scale"), F.min("mmd2").alias("best_mmd2"),
    )
