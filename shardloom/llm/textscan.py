"""Words of whole texts as numpy arrays, straight from the UTF-8 buffers of Arrow batches.

All separators are ASCII bytes, so working on bytes splits UTF-8 exactly as working on characters would. Batches are cut
into chunks of a bounded number of bytes; only a single longer document makes a chunk larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, true inside the given inclusive byte ranges."""
    flags = np.zeros(256, dtype=bool)
    for low, high in ranges:
        flags[low : high + 1] = True
    return flags


#: ``[^\\x20\\x09-\\x0D]+``
NOT_BLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; read it after lower-casing.
ALNUM = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so any of their bits can pick a bucket."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown to the longest chunk seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            tables = []
            for base in (BASE, inverse):
                table = np.full(size, base, dtype=np.uint64)
                table[0] = 1
                np.multiply.accumulate(table, out=table)
                tables.append(table)
            self.up, self.down = tables
        return self.up, self.down


@dataclass
class Words:
    """Words of a run of documents: byte spans, 64-bit hashes, and ``first[d] : first[d + 1]`` of document d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    spans = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(spans):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[spans[0] : spans[-1]], spans - spans[0]


#: Keeps the first k of eight bytes read as a little-endian number.
FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
#: Longer spans are hashed one by one.
LONG_SPAN = 512


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, over a copy of ``data``; zero bytes follow the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, mixed block by block of eight bytes.

    Each step is a bijection of the state, so spans of one length of at most eight bytes never share a hash, and no pattern
    within longer ones cancels out as it would in a sum of powers.
    """
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    if not len(starts):
        return out
    words = eight_bytes(data)
    left, at, h, which = lengths, starts, out, None  # ``which`` spans are still open; at first all of them
    for k in range(LONG_SPAN // 8):
        blocks = words[at] & FIRST_BYTES[np.minimum(left, 8)]
        h = mix((h ^ blocks) * np.uint64(0xD1342543DE82EF95))
        if which is None:
            out = h
        else:
            out[which] = h
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        which = more if which is None else which[more]
        at, left, h = at[more] + 8, left[more] - 8, h[more]
    for k in np.flatnonzero(lengths > LONG_SPAN).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def scan_words(column: pa.Array, word_bytes: np.ndarray, lower: bool) -> Words:
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = word_bytes[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    after = before[1:].copy()
    after[:-1] = inside[1:]
    if len(data):
        after[-1] = False
    cuts = offsets[1:-1]
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), span_hashes(data, starts, ends))


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes; a longer document is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, n = 0, len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, for every position with n words left in the array."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + len(total)]
    return mix(total)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
