"""Token ids of whole texts by the ``tokenizers`` library, each distinct chunk of a task being encoded once.

Both pre-tokenizers in use never join characters across the start of a blank run, so a text's ids are those of its chunks
(a blank run with the word after it, or the words alone where blanks are dropped) one after the other. Texts with other
white space than the ASCII kind, whose runs could be cut in the middle, are encoded whole. Where blanks are kept, stops
that end a chunk after a letter are a chunk of their own, as they are to the pre-tokenizer.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from shardloom.llm.textscan import FIRST_BYTES, LONG_SPAN, NOT_BLANK, byte_class, eight_bytes, ragged, span_hashes, text_bytes
from shardloom.llm.workers import release

# White space beyond ASCII.
OTHER_BLANKS = "[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: Distinct chunks remembered by a task before it starts afresh, without and with their blanks.
REMEMBERED, REMEMBERED_BLANKS = 480_000, 1_900_000
#: New plain chunks that go to the tokenizer as one text.
JOINED = 300
LETTER, STOP = byte_class((65, 90), (97, 122)), byte_class((44, 44), (46, 46), (58, 59))
#: Stops at the end of a chunk, if they are cut off: more stay in the chunk.
MOST_STOPS = 3
#: Bytes of the letters of ASCII and of U+00C0 to U+017F, but for two: as last bytes these also make the signs U+00D7 and U+00F7.
LATIN = byte_class((65, 90), (97, 122), (0xC3, 0xC5), (0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))
#: Other signs of ASCII, but for the apostrophe, with which contractions start.
SIGN = byte_class((33, 38), (40, 47), (58, 64), (91, 96), (123, 126))


def byte_characters() -> np.ndarray:
    """Code points that stand for the bytes in byte-level vocabularies: of Latin-1 if they can be seen, else from 256 on."""
    seen = byte_class((33, 126), (161, 172), (174, 255))
    return np.where(seen, np.arange(256), 255 + np.cumsum(~seen)).astype("<u4")


BYTE_CHARACTERS = byte_characters()


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_spans(data: np.ndarray, offsets: np.ndarray, keep_blanks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the chunks of all rows, and the first chunk of each row."""
    word = NOT_BLANK[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = word
    before[offsets[:-1]] = False
    if keep_blanks:
        # A chunk starts where a row does, or where blanks follow a word.
        opens = ~word & before[:-1]
        rows = offsets[:-1][np.diff(offsets) > 0]
        opens[rows] = True
        opens[_stops(data, np.flatnonzero(opens))] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))
    else:
        starts = np.flatnonzero(word & ~before[:-1])
        after = np.zeros(len(data) + 1, dtype=bool)
        after[:-1] = word
        after[offsets[1:]] = False
        ends = np.flatnonzero(word & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _stops(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the stops begin that end a chunk after a letter, of ASCII or from U+00C0 to U+00FF."""
    ends = np.append(starts[1:], len(data))
    at = ends.copy()
    for _ in range(MOST_STOPS):
        at -= (at > starts + 1) & STOP[data[at - 1]]
    last, lead = data[at - 1], data[np.maximum(at - 2, 0)]
    letter = LETTER[last] | ((at > starts + 1) & (lead == 0xC3) & (last != 0x97) & (last != 0xB7))
    return at[(at < ends) & letter]


def _plain(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which chunks, joined in ``raw``, are a blank or none, letters, and signs or none."""
    letter, sign = LATIN[raw], SIGN[raw]
    odd = ~(letter | sign)
    odd[1:] |= sign[:-1] & letter[1:]
    ends = np.append(starts[1:], len(raw))
    opens = starts + ~NOT_BLANK[raw[starts]]
    odd[starts] = False
    odd[opens[opens < ends]] = False
    return ~np.logical_or.reduceat(odd, starts) & (opens < ends) & letter[np.minimum(opens, len(raw) - 1)]


class HashIndex:
    """Places of distinct 64-bit keys in the order they were added; an open-addressing table probed by whole arrays."""

    def __init__(self, bits: int = 16) -> None:
        self.count, self.mask = 0, (1 << bits) - 1
        self.keys, self.places = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left, slot = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            place = self.places[slot]
            same = (self.keys[slot] == keys[left]) & (place >= 0)
            out[left[same]] = place[same]
            go = (place >= 0) & ~same
            left, slot = left[go], (slot[go] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        if 2 * (self.count + len(keys)) > self.mask:
            used = np.flatnonzero(self.places >= 0)
            old = self.keys[used][np.argsort(self.places[used])]
            self.__init__(int(2 * (self.count + len(keys))).bit_length())
            self.add(old)
        place = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        left, slot = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = self.places[slot] < 0
            self.places[slot[free]] = place[left[free]]  # of several writers of a slot the last stays
            own = self.places[slot] == place[left]
            self.keys[slot[own]] = keys[left[own]]
            left, slot = left[~own], (slot[~own] + 1) & self.mask
        self.count += len(keys)


class Encoder:
    """Ids of Arrow string columns. A worker process keeps one for all its tasks, see ``encoder``."""

    def __init__(self, path: str, keep_blanks: bool) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that are set apart already, by spaces, and written in the vocabulary's characters.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        if keep_blanks and (resize := getattr(self.words.model, "_resize_cache", None)):
            resize(0)  # words come once, so the library's own memory of words only costs time
        self.keep_blanks = keep_blanks
        self.remembered = REMEMBERED_BLANKS if keep_blanks else REMEMBERED
        # Bytes of each id of a byte-level vocabulary, which has a character for every byte.
        vocabulary = self.tokenizer.get_vocab() if keep_blanks else {}
        self.id_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        self.id_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.forget()

    def forget(self) -> None:
        self.seen = HashIndex()
        self.first = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int32)
        self.flat = np.zeros(1 << 18, dtype=np.uint16)
        self.used = 0
        # Bytes of the remembered chunks, to tell apart different ones with one hash; at least eight bytes follow them.
        self.bytes = np.zeros(1 << 20, dtype=np.uint8)
        self.bytes_first, self.bytes_size, self.bytes_used = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64), 0

    def _plain_ids(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids of plain chunks, joined in ``raw``, and the number of each one's. Their words, which the pre-tokenizer would
        find (signs and a blank that is no space are words of their own), are set apart here and go to the tokenizer's model
        many at a time; ids are told apart by their bytes. None if these do not fall in with the chunks."""
        ends = np.cumsum(sizes)
        starts = ends - sizes
        letter, blank = LATIN[raw], ~NOT_BLANK[raw]
        cut = np.zeros(len(raw), dtype=bool)
        cut[1:] = letter[:-1] & ~letter[1:]
        cut[starts] = True
        cut[starts[blank[starts] & (raw[starts] != 32)] + 1] = True
        at = np.flatnonzero(cut)
        text = np.insert(BYTE_CHARACTERS[raw], at, 32).tobytes().decode("utf-32-le")
        first = starts[::JOINED]
        first = (first + np.searchsorted(at, first)).tolist()
        parts = [text[a:b] for a, b in zip(first, [*first[1:], len(text)], strict=True)]
        encoded = self.words.encode_batch_fast(parts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=np.int64) for e in encoded])
        stops = np.cumsum(self.id_bytes[ids])
        last = np.minimum(np.searchsorted(stops, ends), len(stops) - 1)
        return (ids, np.diff(last, prepend=-1)) if len(ids) and np.array_equal(stops[last], ends) else None

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of chunks. ASCII letters, with one blank before them at most, are one word to the tokenizer's model, and a
        run of stops after them is another; all other chunks take the tokenizer's full way."""
        tokenize = self.tokenizer.model.tokenize
        out, rest, tails = [], [], {b"": []}
        for k, raw in enumerate(texts):
            word = raw.rstrip(b".,;:")
            tail = raw[len(word) :]
            if self.keep_blanks and word[:1] == b" ":
                word, text = word[1:], "Ġ" + word[1:].decode("latin-1")
            else:
                text = word.decode("latin-1") if self.keep_blanks else word.lower().decode("latin-1")
            if word.isalpha():  # of bytes: ASCII letters only
                if tail not in tails:
                    tails[tail] = self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids
                out.append([t.id for t in tokenize(text)] + tails[tail])
            else:
                out.append(None)
                rest.append(k)
        whole = self.tokenizer.encode_batch_fast([texts[k].decode() for k in rest], add_special_tokens=False)
        for k, e in zip(rest, whole, strict=True):
            out[k] = e.ids
        return out

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Remembers new chunks, spans of ``data``, and gives their places."""
        sizes = ends - starts
        plain = np.zeros(len(starts), dtype=bool)
        if self.keep_blanks:
            plain = _plain(data[ragged(starts, sizes)], np.cumsum(sizes) - sizes)
        # Plain chunks go first.
        order = np.argsort(~plain, kind="stable")
        many = int(plain.sum())
        hashes, sizes = hashes[order], sizes[order]
        raw = data[ragged(starts[order], sizes)]
        joined = self._plain_ids(raw[: sizes[:many].sum()], sizes[:many]) if many else None
        stops = np.cumsum(sizes)
        left, every = slice(0 if joined is None else many, None), raw.tobytes()
        encoded = self._ids([every[a:b] for a, b in zip((stops - sizes)[left].tolist(), stops[left].tolist(), strict=True)])
        lengths = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        ids = np.fromiter(itertools.chain.from_iterable(encoded), dtype=np.int64, count=int(lengths.sum()))
        if joined is not None:
            ids, lengths = np.concatenate([joined[0], ids]), np.concatenate([joined[1], lengths])
        if len(ids) and ids.max() > 65_534:
            raise ValueError("ids above 65,534 are not supported")
        n, m = self.seen.count, len(hashes)
        while n + m > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
            self.bytes_first, self.bytes_size = np.resize(self.bytes_first, len(self.first)), np.resize(self.bytes_size, len(self.first))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.size[n : n + m] = lengths
        while self.bytes_used + len(raw) + 8 > len(self.bytes):
            self.bytes = np.resize(self.bytes, 2 * len(self.bytes))
        self.bytes[self.bytes_used : self.bytes_used + len(raw)] = raw
        self.bytes_first[n : n + m], self.bytes_size[n : n + m] = self.bytes_used + stops - sizes, sizes
        self.bytes_used += len(raw)
        self.seen.add(hashes)
        self.used += len(ids)
        places = np.empty(m, dtype=np.int64)
        places[order] = np.arange(n, n + m)
        return places

    def _differ(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Chunks that are not, byte by byte, the remembered ones whose hash they share."""
        sizes = ends - starts
        bad = sizes != self.bytes_size[entry]
        here, there = eight_bytes(data), np.ndarray(len(self.bytes) - 8, dtype="<u8", buffer=self.bytes, strides=(1,))
        which, at, to, left = np.arange(len(starts)), starts, self.bytes_first[entry], np.where(bad | (sizes > LONG_SPAN), 0, sizes)
        for _ in range(LONG_SPAN // 8):
            if not len(which):
                break
            bad[which[((here[at] ^ there[to]) & FIRST_BYTES[np.minimum(left, 8)]) != 0]] = True
            more = np.flatnonzero(left > 8)
            which, at, to, left = which[more], at[more] + 8, to[more] + 8, left[more] - 8
        for k in np.flatnonzero(~bad & (sizes > LONG_SPAN)).tolist():
            first = self.bytes_first[entry[k]]
            bad[k] = not np.array_equal(data[starts[k] : ends[k]], self.bytes[first : first + sizes[k]])
        return np.flatnonzero(bad)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows as uint16, and the number of ids of each row; null is an empty text."""
        odd = pc.fill_null(pc.match_substring_regex(column, OTHER_BLANKS), False).to_numpy(zero_copy_only=False).copy()
        plain = pc.if_else(pa.array(odd), pa.scalar("", column.type), column) if odd.any() else column
        ids, counts, differing = self._encode_chunks(plain)
        odd[differing] = True
        if not odd.any():
            return ids, counts
        rows = np.split(ids, np.cumsum(counts)[:-1])
        for k in np.flatnonzero(odd).tolist():
            rows[k] = np.array(self.tokenizer.encode(column[k].as_py(), add_special_tokens=False).ids, dtype=np.uint16)
        return np.concatenate(rows), np.array([len(r) for r in rows], dtype=np.int64)

    def _encode_chunks(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their number in each row, and the rows with a chunk whose hash another one has."""
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, dtype=np.uint16), np.zeros(len(column), dtype=np.int64), np.zeros(0, dtype=np.int64)
        starts, ends, first = chunk_spans(data, offsets, self.keep_blanks)
        if self.seen.count > self.remembered:
            self.forget()
        codes, distinct = pd.factorize(span_hashes(data, starts, ends))
        known = self.seen.find(distinct)
        new = np.flatnonzero(known < 0)
        if len(new):
            example = np.zeros(len(distinct), dtype=np.int64)
            example[codes[::-1]] = np.arange(len(codes))[::-1]
            known[new] = self._learn(distinct[new], data, starts[example[new]], ends[example[new]])
        entry = known[codes]
        size = self.size[entry].astype(np.int64)
        ids = self.flat[ragged(self.first[entry], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        bad = self._differ(data, starts, ends, entry)
        return ids, np.diff(total[first]), np.searchsorted(first, bad, "right") - 1


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each row, and the new counts."""
    at = np.cumsum(counts)
    return np.insert(ids, at, np.uint16(end)), counts + 1


def crc32s(ids: np.ndarray, counts: np.ndarray) -> list[int]:
    """Unsigned crc32 of each row's ids as little-endian unsigned 32-bit integers."""
    import zlib

    raw = memoryview(ids.astype("<u4").tobytes())
    stops = (4 * np.cumsum(counts)).tolist()
    return [zlib.crc32(raw[a:b]) for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def encoder(path: str, keep_blanks: bool) -> Encoder:
    """The encoder of this worker process; it outlives a task, so what one task learned the next one knows."""
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if (path, keep_blanks) not in kept:
        kept.clear()
        kept[path, keep_blanks] = Encoder(path, keep_blanks)
        release()  # reading a vocabulary takes more memory than keeping it
    return kept[path, keep_blanks]
