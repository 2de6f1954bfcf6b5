"""Column expressions on flat row-major tensors (``array<float>``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from shardloom.spec import DatasetSpec

# The clamps used wherever a stored normaliser is applied or fitted.
STD_FLOOR = 1e-6
VAR_FLOOR = 1e-12


def as_double(x: Column) -> Column:
    """Widen before any reduction, so sums never run in single precision."""
    return x.cast("array<double>")


def array_sum(x: Column) -> Column:
    return F.aggregate(as_double(x), F.lit(0.0), lambda acc, v: acc + v)


def array_sumsq(x: Column) -> Column:
    return F.aggregate(as_double(x), F.lit(0.0), lambda acc, v: acc + v * v)


def dot(x: Column, y: Column) -> Column:
    return array_sum(F.zip_with(as_double(x), as_double(y), lambda a, b: a * b))


def l2_norm(x: Column) -> Column:
    return F.sqrt(array_sumsq(x))


def sq_distance(x: Column, y: Column) -> Column:
    """``max(|x|^2 + |y|^2 - 2 x.y, 0)``."""
    return F.greatest(array_sumsq(x) + array_sumsq(y) - 2.0 * dot(x, y), F.lit(0.0))


def double_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def per_channel(x: Column, spec: DatasetSpec, fn) -> Column:
    """Apply ``fn(value, channel)``; the channel of position ``i`` is ``i div plane``."""
    return F.transform(as_double(x), lambda v, i: fn(v, (i / F.lit(spec.plane)).cast("int")))


def affine_channels(x: Column, spec: DatasetSpec, gain: Sequence[float], offset: Sequence[float]) -> Column:
    """``v * gain[c] + offset[c]`` with C-sized literal arrays."""
    g, o = double_literal(gain), double_literal(offset)
    return per_channel(x, spec, lambda v, c: v * F.get(g, c) + F.get(o, c))


def is_not_finite(v: Column) -> Column:
    return F.isnan(v) | (F.abs(v) == F.lit(float("inf")))


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~is_not_finite(v)


def flip_last_axis(x: Column, spec: DatasetSpec) -> Column:
    """Mirror every row of the last axis."""
    rows = F.sequence(F.lit(0), F.lit(spec.channels * spec.height - 1))
    return F.flatten(F.transform(rows, lambda r: F.reverse(F.slice(x, r * spec.width + 1, spec.width))))
