"""Driver-side arguments and timestamp text."""

from __future__ import annotations


from pyspark.sql import Column, functions as F

from shardloom.session import require


def parse_index_list(text: str, size: int | None = None) -> list[int]:
    """``0,10,20`` and slices ``a:b[:step]``; negative plain indices count from ``size``."""
    picked: list[int] = []
    for piece in filter(None, (p.strip() for p in text.split(","))):
        bounds = [b.strip() for b in piece.split(":")]
        require(len(bounds) <= 3, f"bad slice {piece!r}")
        if len(bounds) == 1:
            picked.append(int(bounds[0]))
        else:
            step = int(bounds[2]) if len(bounds) == 3 and bounds[2] else 1
            picked += range(int(bounds[0]), int(bounds[1]), step)
    return [i + size if size is not None and i < 0 else i for i in picked]


def parse_float_list(text: str) -> list[float]:
    values = [float(p) for p in text.split(",") if p.strip()]
    require(bool(values), "at least one value is required")
    return values


def evenly_spaced(count: int, size: int) -> list[int]:
    """``count`` positions from 0 to ``size - 1``, rounded half to even, without repeats."""
    n = min(count, size)
    if n <= 1:
        return [0] if n == 1 else []
    step = (size - 1) / (n - 1)
    # the last point is exact, as in a closed linear space
    return sorted({round(size - 1 if i == n - 1 else i * step) for i in range(n)})


def iso_timestamp(text: Column) -> Column:
    """UTC ISO-8601 text, with ``Z`` or ``+00:00``; null when it does not parse."""
    return F.try_to_timestamp(text)


def compact_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def shard_number(path: Column, pattern: str = r"shard(\d+)\.safetensors$") -> Column:
    """Trailing number of a shard file, -1 when the name has none."""
    digits = F.regexp_extract(path, pattern, 1)
    return F.when(digits == "", F.lit(-1)).otherwise(digits.cast("int"))


def checkpoint_step(name: Column) -> Column:
    digits = F.regexp_extract(name, r"step_(\d+)\.pt$", 1)
    return F.when(digits == "", F.lit(-1)).otherwise(digits.cast("bigint"))


def path_step(path: Column) -> Column:
    """First ``step_<n>`` in a path; null when absent."""
    digits = F.regexp_extract(path, r"step_(\d+)", 1)
    return F.when(digits == "", F.lit(None)).otherwise(digits).cast("bigint")


def scale_slug(scale: float) -> str:
    """File-name form of a scale: 0.35 -> ``s0p35``, -1 -> ``sm1``."""
    return "s" + f"{scale:g}".translate({ord("-"): "m", ord("."): "p", ord("+"): None})
