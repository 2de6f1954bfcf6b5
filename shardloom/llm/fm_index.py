"""FM-index over a sequence of word codes: suffix order, wavelet tree of the word before each suffix, backward steps.

The tree keeps one packed bit vector per bit of a code, with a count per 64 bits: n log2(words) bits in all. Queries are
arrays, so one step moves many patterns.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, dtype=np.uint8)])
        self.words = packed.view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.zeros(len(self.words), dtype=np.int32)
        np.cumsum(counts[:-1], out=self.before[1:])
        self.ones = int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Occurrences of a code before a position; levels from the highest bit down, zeros of a level before its ones."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[BitVector, int]] = []
        self.shifts = list(range(bits - 1, -1, -1))
        for shift in self.shifts:
            bit = (codes >> shift) & 1
            vector = BitVector(bit.astype(bool))
            self.levels.append((vector, len(codes) - vector.ones))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])

    def ranks(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each code before ``low`` and before ``high``."""
        start = np.zeros(len(code), dtype=np.int64)
        for (vector, zeros), shift in zip(self.levels, self.shifts, strict=True):
            bit = ((code >> shift) & 1).astype(bool)
            s, lo, hi = vector.rank(start), vector.rank(low), vector.rank(high)
            start = np.where(bit, zeros + s, start - s)
            low = np.where(bit, zeros + lo, low - lo)
            high = np.where(bit, zeros + hi, high - hi)
        return low - start, high - start


def suffix_order(codes: np.ndarray, depth: int, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` codes or more, and their ranks by the first ``power`` codes, a power
    of two."""
    n = len(codes)
    rank = codes.astype(np.int64)
    kept, length = rank, 1
    order = np.argsort(rank, kind="stable")
    while length < depth:
        key = rank * (n + 2)
        key[: n - length] += rank[length:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        length *= 2
        if length == power:
            kept = rank
    return order, kept


class FMIndex:
    """Index of ``codes`` (0 separates, words from 1 on) for patterns of at most ``depth`` words without a separator.

    Suffixes are ordered by ``depth`` words or more, which is all that such patterns can tell apart.
    """

    def __init__(self, codes: np.ndarray, depth: int, weights: np.ndarray) -> None:
        n = self.n = len(codes)
        power = 1 << ((depth - 1).bit_length() - 1)
        order, rank = suffix_order(codes, depth, power)
        self.first = np.searchsorted(codes[order], np.arange(int(codes.max(initial=0)) + 2))
        self.tree = WaveletTree(codes[order - 1], max(1, int(codes.max(initial=1)).bit_length()))
        self.weight = np.concatenate([[0], np.cumsum(weights[order])])
        # Groups of neighbours that share depth - 1 words: two overlapping powers of two cover these.
        rank = np.append(rank, np.full(depth, -1))
        shift = depth - 1 - power
        same = (rank[order[1:]] == rank[order[:-1]]) & (rank[order[1:] + shift] == rank[order[:-1] + shift])
        opens = np.append(True, ~same) if n else np.zeros(0, dtype=bool)
        self.group = np.cumsum(opens) - 1
        self.group_start = np.append(np.flatnonzero(opens), n)

    def step(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns one word longer to the left."""
        lo, hi = self.tree.ranks(code, low, high)
        return self.first[code] + lo, self.first[code] + hi

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Weighted number of suffixes in intervals."""
        return self.weight[high] - self.weight[low]

    def forget_last(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns of ``depth`` words without their last word; empty ones stay empty."""
        group = self.group[np.minimum(low, self.n - 1)]
        found = high > low
        return np.where(found, self.group_start[group], 0), np.where(found, self.group_start[group + 1], 0)
