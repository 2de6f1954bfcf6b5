"""Suffix array of a byte string by difference-cover blockwise construction: the suffixes come bucket by bucket.

The suffixes at a difference cover (places whose remainder by ``PERIOD`` is in ``COVER``) are sorted once, by their first
``PERIOD`` bytes and then by prefix doubling; their ranks are all that is kept of the order. Splitters from the sorted
cover cut the suffixes into buckets of about one size. One bucket at a time is sorted by its first ``PERIOD`` bytes; suffixes
that agree in all of them are ordered by the ranks of the two cover places that follow both at one distance below
``PERIOD``. Besides the text, its ranks and one small number per suffix, memory holds one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# A smallest difference cover of 32, every difference modulo 32 is one of two of its elements.
PERIOD = 32
COVER = np.array([0, 1, 3, 11, 17, 24, 29])
BUCKET = 1 << 16
BLOCKS = PERIOD // 8


def _distances() -> np.ndarray:
    """For two remainders the least step that takes both into the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    both = np.array([[[inside[a + s] and inside[b + s] for s in range(PERIOD)] for b in range(PERIOD)] for a in range(PERIOD)])
    return both.argmax(axis=2)


STEP = _distances()
CODE = np.full(PERIOD, -1)
CODE[COVER] = np.arange(len(COVER))


def dense(keys: list[np.ndarray]) -> np.ndarray:
    """Rank of each row of several key columns, the first one being the most significant; equal rows share one."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


class SuffixBlocks:
    """Suffixes of ``text`` (uint8); zero bytes follow its end."""

    def __init__(self, text: np.ndarray) -> None:
        whole = -(-(len(text) + 2 * PERIOD) // PERIOD) * PERIOD
        padded = np.zeros(whole + PERIOD + 8, dtype=np.uint8)
        padded[: len(text)] = text
        self.bytes, self.whole = padded, whole
        # Eight bytes from every place on, read as one number whose order is that of the bytes.
        self.words = np.ndarray(whole + PERIOD, dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
        self.ranks = self._rank_cover()

    def _rank_cover(self) -> np.ndarray:
        """Rank of every cover suffix, as (place div PERIOD, cover element)."""
        rows = self.whole // PERIOD
        places = (np.arange(rows)[:, None] * PERIOD + COVER).ravel()
        rank = dense([self.words[places + 8 * b] for b in range(BLOCKS)])
        step = 1
        while int(rank.max()) + 1 < len(rank):
            after = -1 - places  # of two suffixes that reach the end the shorter one is first
            following = rank[step * len(COVER) :]
            after[: len(following)] = following
            rank = dense([rank, after])
            step *= 2
        return rank.astype(np.int32)

    def _follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at ``left`` is before, at or after that at ``right``; both agree in PERIOD bytes."""
        step = STEP[left % PERIOD, right % PERIOD]
        return np.sign(self._rank(left + step).astype(np.int64) - self._rank(right + step))

    def _rank(self, place: np.ndarray) -> np.ndarray:
        return self.ranks[place // PERIOD * len(COVER) + CODE[place % PERIOD]]

    def compare(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left), dtype=np.int64)
        open_ = np.arange(len(left))
        for b in range(BLOCKS):
            x, y = self.words[left[open_] + 8 * b], self.words[right[open_] + 8 * b]
            out[open_] = np.where(x < y, -1, (x > y).astype(np.int64))
            open_ = open_[x == y]
        out[open_] = self._follows(left[open_], right[open_])
        return out

    def _splitters(self, n: int, bucket: int) -> np.ndarray:
        """Places of the suffixes that open all buckets but the first, in order."""
        buckets = -(-n // bucket)
        order = np.argsort(self.ranks, kind="stable")
        at = order[np.arange(1, buckets) * len(order) // buckets]
        return at // len(COVER) * PERIOD + COVER[at % len(COVER)]

    def _bucket_of(self, places: np.ndarray, splitters: np.ndarray) -> np.ndarray:
        """Number of splitters at or before each suffix."""
        first = self.words[splitters]
        low, high = np.searchsorted(first, self.words[places], "left"), np.searchsorted(first, self.words[places], "right")
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            up = self.compare(places[open_], splitters[middle]) >= 0
            low[open_[up]], high[open_[~up]] = middle[up] + 1, middle[~up]
            open_ = open_[low[open_] < high[open_]]
        return low

    def buckets(self, places: np.ndarray, bucket: int = BUCKET) -> Iterator[np.ndarray]:
        """The suffixes at ``places`` in their order, in pieces of about ``bucket``."""
        number = self._bucket_of(places, self._splitters(len(places), bucket)).astype(np.int32)
        for b in range(int(number.max(initial=-1)) + 1):
            yield self._sorted(places[number == b])

    def _sorted(self, places: np.ndarray) -> np.ndarray:
        keys = [self.words[places + 8 * b] for b in range(BLOCKS)]
        order = np.lexsort(keys[::-1])
        places = places[order]
        new = np.ones(len(places), dtype=bool)
        new[1:] = False
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        self._order_ties(places, np.cumsum(new))
        return places

    def _order_ties(self, places: np.ndarray, group: np.ndarray) -> None:
        """Orders the suffixes of each group in place: all groups are parted around a member each, then their parts."""
        active = np.arange(len(places))
        while True:
            edge = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, dtype=np.int64)
            sizes = np.diff(np.append(edge, len(group)))
            many = np.repeat(sizes > 1, sizes)
            if not many.any():
                return
            active, edge, sizes = active[many], np.cumsum(sizes[sizes > 1]) - sizes[sizes > 1], sizes[sizes > 1]
            mine = places[active]
            middle = np.repeat(mine[edge + sizes // 2], sizes)
            side = 3 * np.repeat(np.arange(len(sizes)), sizes) + 1 + self._follows(mine, middle)
            order = np.argsort(side, kind="stable")
            places[active], group = mine[order], side[order]

    def agree(self, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
        """Whether the ``length`` bytes from both places on, all inside the text, are equal."""
        same = np.ones(len(left), dtype=bool)
        open_ = np.arange(len(left))
        for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])]:
            equal = self.words[left[open_] + at] == self.words[right[open_] + at]
            same[open_[~equal]] = False
            open_ = open_[equal]
        return same
