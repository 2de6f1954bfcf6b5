"""Deterministic per-row draws. md5 keeps them repeatable on retries and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def draw_key(*parts) -> Column:
    """Hex key of ``part:part:...``; uniform, so its prefix is a balanced bucket."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def hex_prefix(key: Column, digits: int) -> Column:
    """The first ``digits`` hex digits as a number."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")


def unit_draw(*parts) -> Column:
    """A uniform value in [0, 1) from the first eight hex digits."""
    return hex_prefix(draw_key(*parts), 8).cast("double") / F.lit(float(2**32))
