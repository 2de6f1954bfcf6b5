"""The median bandwidth and the kernel sums of an RBF MMD of many rows, from one pass over all pairs in single precision.

Distances are taken relative to a guess c of their median, g = d²/c - 1: one matrix product a tile. The pass counts and picks the
distances around the median; what single precision leaves open is taken again in double precision, so the median is exact. It
also sums the powers of g from the fourth on. With w = c/2b², exp(-d²/2b²) = exp(-w) Σ (-w g)^k / k!; the powers 1 to 3, the
bulk, come from third moments in double precision, linear in the rows. The error of the rest is bounded from the sums; where the
bound is too large, as for few dimensions, the caller sums the kernel itself in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.operators.block_pairs import read_block, rows_at_ranks, sample_rows, squared_distances
from shardloom.session import materialize

#: Rows of a tile and bins of a range.
TILE, BINS = 384, 1 << 14
#: From so many pairs on the passes are worth their preparation.
MANY_PAIRS = 1 << 28
#: Distances picked around the median, about; the pairs of the trial that sets the range, at least.
_PICKED, _TRIAL = 1 << 26, 1 << 27
#: Ranks to either side of the median in the first range; standard errors of the trial to either side in the second.
_REACH, _ERRORS = 0.04, 8.0
#: Most the mean of a kernel may be wrong for the series to be taken: a bound as if no two errors of rounding cancelled.
_SERIES_ERROR = 1e-9
_DEGREES = (8, 12)
_SINGLE, _DOUBLE = 2.0**-24, 2.0**-53
_BATCH, _GROUP = 1 << 21, 4
# kinds of rows in a pass's result, besides bins from 0 and powers k as -100 - k
_BELOW, _SEEN, _ZEROS, _REACHED, _HEIGHT, _LENGTH = -1, -2, -3, -4, -5, -6


@dataclass(frozen=True)
class Frame:
    """Coordinates in which single precision is good: moved by ``centre``, divided by the root of ``c``."""

    centre: np.ndarray
    c: float

    def moved(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows z and h = |z|² - 1/2, so that g = h_a + h_b - 2 z_a·z_b."""
        z = (rows - self.centre) / math.sqrt(self.c)
        return z, np.einsum("ij,ij->i", z, z) - 0.5

    def factors(self, rows: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The factor of g these rows give in single precision, with |z| and |h|; h is split, so that it keeps its digits."""
        n, width = rows.shape
        out, reach, height = np.empty((n, width + 4), np.float32), np.empty(n), np.empty(n)
        for at in range(0, n, 4096):
            part = slice(at, at + 4096)
            z, h = self.moved(rows[part])
            out[part, :width] = z if left else -2.0 * z
            own, other = (width, width + 2) if left else (width + 2, width)
            out[part, own] = h
            out[part, own + 1] = h - out[part, own]
            out[part, other : other + 2] = 1.0
            reach[part], height[part] = np.sqrt(h + 0.5), np.abs(h)
        return out, reach, height


@dataclass(frozen=True)
class Plan:
    """What a trial found: the range of distances to pick, the greatest |z|, |h| and the sum's degree, 0 for no series."""

    frame: Frame
    low: float
    high: float
    reach: float
    height: float
    degree: int


def _rounding(width: int, reach_a, reach_b, height_a, height_b):
    """Bound of the error of g in single precision: ``width`` + 4 products summed, both factors rounded."""
    return (width + 9) * _SINGLE * (2.0 * reach_a * reach_b + height_a + height_b)


def _tile_max(values: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(values, np.arange(0, len(values), TILE))


def _on_tiles(frame: Frame, a: np.ndarray, b: np.ndarray, same: bool, step: int = 1) -> Iterator[tuple]:
    """``(rows of a, rows of b, g, bound of its error, diagonal)`` of every ``step``-th tile; ``g`` is overwritten by the next.
    All rows have as many tiles; with more than one step not those of the same places, where a row and its copy may meet.

    Of a block with itself, pairs are above the diagonal; others on a diagonal tile are 0.
    """
    width = a.shape[1]
    left, reach_a, height_a = frame.factors(a, True)
    right, reach_b, height_b = frame.factors(b, False)
    size_a, size_b = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    (ra, ha, la), (rb, hb, lb) = [[_tile_max(v) for v in side] for side in ((reach_a, height_a, size_a), (reach_b, height_b, size_b))]
    held = np.empty(TILE * TILE, np.float32)
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            ti, tj = i // TILE, j // TILE
            if (tj - ti - step // 2) % step:
                continue
            p, q = left[i : i + TILE], right[j : j + TILE]
            g = held[: len(p) * len(q)].reshape(len(p), len(q))
            np.matmul(p, q.T, out=g)
            diagonal = same and i == j
            if diagonal:
                g[np.tril_indices(len(p))] = 0.0
            # the distance in double precision has an error too, from the rows as they are
            error = _rounding(width, ra[ti], rb[tj], ha[ti], hb[tj]) + 2 * (width + 4) * _DOUBLE * (la[ti] + lb[tj]) ** 2 / frame.c
            yield i, j, g, float(error) + 1e-30, diagonal


class _Exact:
    """Squared distances in double precision of single pairs of a tile; exactly 0 for equal rows."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.rows, self.own = (a, b), (np.vecdot(a, a), np.vecdot(b, b))
        # kept, as fresh pages for every tile cost more than the products
        self.held = [np.empty((max(1, _BATCH // (8 * a.shape[1])), a.shape[1])) for _ in "ab"]

    def whole(self, i: int, j: int, shape: tuple[int, int], first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Of so many pairs of the tile that begins at rows i and j that all of it is cheaper."""
        d = squared_distances(self.rows[0][i : i + shape[0]], self.rows[1][j : j + shape[1]])[first, second]
        tiny = np.flatnonzero(d <= 1e-12 * sum(own[k : k + n].max() for own, k, n in zip(self.own, (i, j), shape, strict=True)))
        d[tiny] = self.pairs(first[tiny] + i, second[tiny] + j)
        return d

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, most = np.empty(len(i)), len(self.held[0])
        for at in range(0, len(i), most):
            p, q = (np.take(rows, k[at : at + most], axis=0, out=h[: len(k) - at], mode="clip") for rows, k, h in zip(self.rows, (i, j), self.held, strict=True))
            out[at : at + most] = self.own[0][i[at : at + most]] + self.own[1][j[at : at + most]] - 2.0 * np.vecdot(p, q)
        return np.maximum(out, 0.0, out=out)


def _sides(side_p: str, side_q: str) -> str:
    return side_p + side_q if side_p == side_q else "xy"


def _table(sides: str, rows: dict[int, tuple[float, int]]) -> pa.Table:
    return pa.table({
        "sides": [sides] * len(rows), "code": pa.array(list(rows), pa.int32()),
        "v": pa.array([float(v) for v, _ in rows.values()], pa.float64()), "n": pa.array([int(n) for _, n in rows.values()], pa.int64()),
    })


def _over_pairs(pairs: DataFrame, last: int, width: int, fn) -> DataFrame:
    """``fn(side_p, a, side_q, b, same)`` of every pair of blocks in a task of its own, as rows ``sides, code, v, n``."""
    number = (F.col("q") * (F.col("q") + 1) / 2 + F.col("p")).cast("int")
    dealt = pairs.repartitionById((last + 1) * (last + 2) // 2, number)

    def meet(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                p, q, side, blk, wide = (batch.column(c)[k].as_py() for c in ("p", "q", "side", "blk", "wide"))
                held.setdefault((p, q), []).append((blk, side, read_block(batch.column("packed")[k], wide, width)))
        for (p, q), found in held.items():
            found.sort(key=lambda f: f[0])
            (_, side_p, a), (_, side_q, b) = found[0], found[-1]
            yield from fn(side_p, a, side_q, b, p == q).to_batches()

    return dealt.mapInArrow(meet, "sides string, code int, v double, n bigint")


def _trial(pairs: DataFrame, first_y: int, last: int, width: int, frame: Frame, low: float, high: float, step: int) -> DataFrame:
    """Bins of g in a range over a share of the pairs in which all rows have a part: blocks with themselves and their twin."""
    x, y = first_y, last + 1 - first_y
    twins = ((F.col("p") % y == (F.col("q") - x) % y) if x >= y else (F.col("p") == (F.col("q") - x) % x)) & (F.col("p") < x) & (F.col("q") >= x)
    lowest, scale = low / frame.c - 1.0, BINS / ((high - low) / frame.c)

    def count(side_p, a, side_q, b, same):
        bins, below, seen, zeros, sums = np.zeros(BINS, np.int64), 0, 0, 0, np.zeros(_DEGREES[-1] + 1)
        held = [np.empty(TILE * TILE, np.float32) for _ in range(2, _DEGREES[-1] // 2 + 1)]
        for _, _, g, error, diagonal in _on_tiles(frame, a, b, same, step):
            _powers_summed(g, held, sums)
            if diagonal:
                g = g[np.triu_indices(len(g), k=1)]
            seen += g.size
            zeros += np.count_nonzero(g <= -1.0 + error)
            at = (g[(g >= lowest) & (g < high / frame.c - 1.0)] - lowest) * scale
            below += np.count_nonzero(g < lowest)
            bins += np.bincount(np.minimum(at.astype(np.int64), BINS - 1), minlength=BINS)
        facts = {_BELOW: (0, below), _SEEN: (0, seen), _ZEROS: (0, zeros)}
        _, reach, height = zip(*(frame.factors(m, True) for m in (a, b)), strict=True)
        length = np.max([np.einsum("ij,ij->i", m, m).max() for m in (a, b)])
        facts |= {_REACHED: (np.max([r.max() for r in reach]), 0), _HEIGHT: (np.max([h.max() for h in height]), 0), _LENGTH: (length, 0)}
        facts |= {-100 - k: (sums[k], 0) for k in (4, *_DEGREES)}
        return _table(_sides(side_p, side_q), facts | {int(k): (0, bins[k]) for k in np.flatnonzero(bins)})

    found = _over_pairs(pairs.where((F.col("p") == F.col("q")) | twins), last, width, count)
    value = F.when(F.col("code") <= -100, F.sum("v")).otherwise(F.max("v"))
    return found.groupBy("sides", "code").agg(value.alias("v"), F.sum("n").alias("n"))  # as many rows as bins


def plan(blocks: DataFrame, pairs: DataFrame, width: int, sizes: dict[str, int], most_width: int) -> Plan | None:
    """From a sample and a trial the range to pick; none where the pass does not suit the rows (equal, infinite, uneven)."""
    sample = sample_rows(blocks, width)
    d = squared_distances(sample, sample)[np.triu_indices(len(sample), k=1)]
    if not np.isfinite(d).all() or np.count_nonzero(d) < 1000:
        return None
    low, c, high = (float(v) for v in np.quantile(d[d > 0], [0.5 - _REACH, 0.5, 0.5 + _REACH]))
    ends = blocks.groupBy("side").agg(F.min("blk").alias("first"), F.max("blk").alias("last"), F.avg("n").alias("rows")).toPandas().set_index("side")
    if not 0 < low < c < high or not np.isfinite(sample.mean(axis=0)).all() or len(ends) < 2 or c < 1e-200:
        return None
    frame, last, first_y = Frame(sample.mean(axis=0), c), int(ends["last"].max()), int(ends["first"]["y"])

    total = sum(sizes.values())
    wanted = max(_TRIAL, (2 * _ERRORS * 0.5 * total / _PICKED) ** 2)
    step = max(1, min(int(2 * total / (last + 1) / wanted), int(ends["rows"].min()) // TILE))
    table = _trial(pairs, first_y, last, width, frame, low, high, step).toPandas()
    facts = table[table["code"] < 0].pivot(index="code", columns="sides")
    reach, height, length = (float(facts["v"].loc[k].max()) for k in (_REACHED, _HEIGHT, _LENGTH))
    seen = facts["n"].loc[_SEEN]
    if not np.isfinite([reach, height, length]).all() or reach > 1e6 or any(sizes[s] and not seen.get(s, 0) for s in sizes):
        return None

    weight = {s: sizes[s] / total / seen[s] for s in sizes if sizes[s]}
    below, zeros = (sum(weight[s] * facts["n"].loc[k][s] for s in weight) for k in (_BELOW, _ZEROS))
    bins = np.zeros(BINS)
    for s in weight:
        part = table[(table["sides"] == s) & (table["code"] >= 0)]
        bins[part["code"]] += weight[s] * part["n"]
    reached = below + np.concatenate([[0.0], np.cumsum(bins)])
    middle, off = zeros + (1.0 - zeros) / 2, _ERRORS * 0.5 * math.sqrt(sum((sizes[s] / total) ** 2 / seen[s] for s in weight))
    if reached[0] > middle - off or reached[-1] < middle + off:
        return None
    edges = np.searchsorted(reached, middle - off, side="right") - 2, np.searchsorted(reached, middle + off) + 1
    low, high = (low + (high - low) / BINS * min(max(int(k), 0), BINS) for k in edges)

    degree = 0
    if width <= most_width:
        means = {k: max(facts["v"].loc[-100 - k][s] / seen[s] for s in weight) for k in (4, *_DEGREES)}
        degree = next((k for k in _DEGREES if _series_error(0.5, k, means[k], means[4], width, reach, height) < _SERIES_ERROR), 0)
    return Plan(frame, low, high, reach, height, degree)


def _series_error(w: float, degree: int, top: float, fourth: float, width: int, reach: float, height: float) -> float:
    """Bound of the error of a mean kernel: powers left out, and rounding of g and of its powers; means of g^degree and g^4 given."""
    greatest = w * max(1.0, 4.0 * reach**2 - 1.0)
    if greatest >= degree / 4:
        return math.inf
    ratio = greatest / (degree + 1)
    left_out = w**degree * top / math.factorial(degree) * ratio / (1.0 - ratio)
    error = w * _rounding(width, reach, reach, height, height)
    quartic, more = w**4 * fourth, math.exp(greatest)
    slope = quartic**0.75 / 6 + quartic / 24 * more  # of the powers from the fourth on, a mean
    return (left_out + error * slope + (_GROUP * TILE / 8 + 64) * _SINGLE * quartic / 24 * more) * math.exp(-w)


def _powers_summed(g: np.ndarray, held: list[np.ndarray], sums: np.ndarray) -> np.ndarray:
    """Adds the sums of g^4 and up; returns the sums of the highest power, an even one, by groups of as many rows."""
    rows = len(g) if len(g) % _GROUP else len(g) // _GROUP  # fewer, longer sums are faster, and short enough for their rounding
    powers = [None, g.reshape(rows, -1), *(h[: g.size].reshape(rows, -1) for h in held)]
    for k in range(2, len(powers)):
        np.multiply(powers[k // 2], powers[k - k // 2], out=powers[k])
    for k in range(4, 2 * len(powers) - 1):
        by_group = np.vecdot(powers[k // 2], powers[k - k // 2])
        sums[k] += by_group.sum(dtype=np.float64)
    return by_group


def _differing(one: np.ndarray, other: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The few positions at which two flat masks differ, found by words of eight."""
    whole = len(one) & -8
    words = np.bitwise_xor(one[:whole].view(np.uint64), other[:whole].view(np.uint64), out=held[: whole // 8])
    some = np.flatnonzero(words != 0)
    at = np.flatnonzero(words[some].view(bool))
    at = some[at >> 3] * 8 + (at & 7)
    return at if whole == len(one) else np.concatenate([at, whole + np.flatnonzero(one[whole:] != other[whole:])])


class _Picked:
    """Distances in the range with their counts, and the number below it; equal ones are merged as they come."""

    def __init__(self, low: float, high: float, exact: _Exact):
        self.low, self.high, self.exact, self.below = low, high, exact, 0
        self.values, self.counts, self.size, self.merged = [np.empty(0)], [np.empty(0, np.int64)], 0, 0
        self.waiting, self.pending = 0, []

    def add(self, i: int, j: int, shape: tuple[int, int], at: np.ndarray) -> None:
        """The pairs at the flat positions ``at`` of a tile."""
        first, second = np.divmod(at, shape[1])
        if len(at) * 16 >= shape[0] * shape[1]:
            self._take(self.exact.whole(i, j, shape, first, second))
            return
        self.pending.append((first + i, second + j))
        self.waiting += len(at)
        if self.waiting >= 1 << 12:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            self._take(self.exact.pairs(*(np.concatenate(k) for k in zip(*self.pending, strict=True))))
        self.waiting, self.pending = 0, []

    def _take(self, d: np.ndarray) -> None:
        self.below += np.count_nonzero(d < self.low)
        # many pairs of rounded rows share a distance
        values, counts = np.unique(d[(d >= self.low) & (d <= self.high)], return_counts=True)
        self.values.append(values)
        self.counts.append(counts)
        self.size += len(values)
        if self.size > max(1 << 20, 2 * self.merged):
            self._merge()

    def _merge(self) -> None:
        values, at = np.unique(np.concatenate(self.values), return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, at, np.concatenate(self.counts))
        self.values, self.counts, self.size, self.merged = [values], [counts], len(values), len(values)

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        self._flush()
        self._merge()
        return self.values[0], self.counts[0]


def scan(pairs: DataFrame, last: int, width: int, plan: Plan) -> DataFrame:
    """All pairs once: counts below the range and of zeros, the distances in it by bin, and the sums of powers of g."""
    frame, low, high, degree = plan.frame, plan.low, plan.high, plan.degree

    def look(side_p, a, side_q, b, same):
        sums, below, zeros, seen = np.zeros(degree + 1), 0, 0, 0
        held = [np.empty(TILE * TILE, np.float32) for _ in range(2, degree // 2 + 1)]
        exact = _Exact(a, b)
        picked = _Picked(low, high, exact)
        under, upto, words = np.empty(TILE * TILE, bool), np.empty(TILE * TILE, bool), np.empty(TILE * TILE // 8, np.uint64)
        for i, j, g, error, diagonal in _on_tiles(frame, a, b, same):
            near = np.float32(-1.0 + error * 1.0001 + 1e-7)
            if degree:
                # a distance of 0 shows in the sum of an even power over its rows
                by_group = _powers_summed(g, held, sums)
                some = ~(by_group < 0.999 * max(0.0, -float(near)) ** degree)
                rows = np.flatnonzero(np.repeat(some, len(g) // len(some))) if some.any() else []
            else:
                rows = np.flatnonzero(~(g.min(axis=1) > near))
            if diagonal:
                g[np.tril_indices(len(g))] = np.inf
            seen += len(g) * (len(g) - 1) // 2 if diagonal else g.size
            if len(rows):
                first, second = np.nonzero(g[rows] <= near)
                zeros += np.count_nonzero(exact.pairs(rows[first] + i, second + j) <= 0)
            flat = g.reshape(-1)
            start = np.nextafter(np.float32(low / frame.c - 1.0 - error), np.float32(-np.inf))
            stop = np.nextafter(np.float32(high / frame.c - 1.0 + error), np.float32(np.inf))
            lower, upper = under[: flat.size], upto[: flat.size]
            np.less(flat, start, out=lower)
            below += np.count_nonzero(lower)
            np.less_equal(flat, stop, out=upper)
            picked.add(i, j, g.shape, _differing(lower, upper, words))
        values, counts = picked.close()
        bins = np.minimum(((values - low) * (BINS / (high - low))).astype(np.int32), BINS - 1)
        sides = _sides(side_p, side_q)
        facts = {_BELOW: (0, below + picked.below), _ZEROS: (0, zeros), _SEEN: (0, seen)} | {-100 - k: (sums[k], 0) for k in range(4, degree + 1)}
        inside = pa.table({
            "sides": pa.array([sides] * len(bins), pa.string()), "code": pa.array(bins, pa.int32()), "v": pa.array(values), "n": pa.array(counts),
        })
        return pa.concat_tables([_table(sides, facts), inside])

    return materialize(_over_pairs(pairs, last, width, look), "all_pairs")


@dataclass(frozen=True)
class Found:
    """The exact median and, unless their error may be too large, the sums of powers of g over unordered pairs by sides."""

    frame: Frame
    median: float
    powers: dict[str, np.ndarray] | None

    def factors(self) -> np.ndarray:
        """Of the powers of g in exp(-d²/2b²) / ``scale()``."""
        return np.array([(-self.frame.c / (2.0 * self.median)) ** k / math.factorial(k) for k in range(len(self.powers["xy"]))])

    def scale(self) -> float:
        return math.exp(-self.frame.c / (2.0 * self.median))


def all_pairs(blocks: DataFrame, pairs: DataFrame, width: int, sizes: dict[str, int], most_width: int) -> Found | None:
    """One pass over all pairs; ``sizes`` are the unordered pairs within x, within y and across. None where it does not suit."""
    chosen = plan(blocks, pairs, width, sizes, most_width)
    if chosen is None:
        return None
    found = scan(pairs, blocks.agg(F.max("blk")).first()[0], width, chosen)
    facts = found.where("code < 0").groupBy("sides", "code").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
    count = facts.groupby("code")["n"].sum()
    total, below = int(count[_SEEN] - count[_ZEROS]), int(count[_BELOW] - count[_ZEROS])
    bins = found.where("code >= 0").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()  # as many rows as bins
    ranks, reached = [(total - 1) // 2, total // 2], below + bins["n"].cumsum().to_numpy()
    if total < 1 or ranks[0] < below or not len(bins) or ranks[1] >= reached[-1]:
        return None  # the trial misled
    at = np.searchsorted(reached, ranks, side="right")
    base = int(reached[at[0] - 1]) if at[0] else below
    inside = found.where(F.col("code").isin(sorted({int(k) for k in bins["code"].to_numpy()[at]})))
    values = materialize(inside.groupBy("v").agg(F.sum("n").alias("n")), "distances")
    median = float(np.mean([row["v"] for row in rows_at_ranks(values, [r - base for r in sorted(set(ranks))])]))

    powers = {s: np.zeros(chosen.degree + 1) for s in sizes}
    for row in facts[facts["code"] <= -100].itertuples():
        powers[row.sides][-100 - row.code] = row.v
    w, degree = chosen.frame.c / (2.0 * median), chosen.degree
    good = degree and all(
        _series_error(w, degree, powers[s][degree] / n, powers[s][4] / n, width, chosen.reach, chosen.height) <= _SERIES_ERROR
        for s, n in sizes.items() if n
    )
    return Found(chosen.frame, median, powers if good else None)
