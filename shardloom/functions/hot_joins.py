"""Inner joins with a table of one row per key, in which some keys may hold a large share of the other side's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Keys with at least so many rows are joined by broadcast, and at most so many keys are.
HOT_ROWS, HOT_KEYS = 10_000, 50_000


def hot_and_cold(keys: DataFrame, count: str, rows: int) -> tuple[DataFrame | None, DataFrame]:
    """Keys with at least ``rows / HOT_KEYS`` of the ``rows`` rows of the other side (None if there are none), which are
    fewer than ``HOT_KEYS``, and the other keys."""
    least = max(HOT_ROWS, rows // HOT_KEYS)
    hot = keys.where(F.col(count) >= least)
    return None if hot.isEmpty() else hot, keys.where(F.col(count) < least)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, rows: int) -> DataFrame:
    """``left`` with its row of ``right``, whose ``count`` says how many of the ``rows`` rows of ``left`` a key has.

    Rows of hot keys stay where they are, since so few narrow rows can be broadcast; what is shuffled has less than
    that per key. Both sides are read twice, so they should be written tables.
    """
    hot, cold = hot_and_cold(right, count, rows)
    if hot is None:
        return left.join(cold.drop(count), keys)
    spread = left.join(F.broadcast(hot.drop(count)), keys)
    rest = left.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold.drop(count), keys)
    return spread.unionByName(rest)
