"""A context-mixing range coder for token ids, run for many blocks side by side.

Three orders predict each id, and their shares of the range are summed: how often ids come at all (order 0), the id that
last followed the same id in the block (order 1) and the one that last followed the same two ids (order 2). The weights
depend on how these two predictions fared last and whether they agree. Order 0 and the weights are the ``Model``, which
the encoder counts in a first pass; predictions are learned block by block, by the encoder and the decoder alike.

Blocks with a common model need that and nothing of each other; without one, each block carries its own. A block's header
holds a checksum, and so does a model's.

All blocks of a batch take one step together, so a step is a few numpy operations over as many lanes as there are blocks.
All numbers of the range are below 2**53, so they are kept as doubles, on which these operations are fastest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK_IDS = 4096
#: Magic, ids, 16-bit digits, bytes of the block's own model, checksum of the ids (as 32-bit integers) and of the rest.
HEADER = "<4sIIII"
HEADER_SIZE = struct.calcsize(HEADER)
MAGIC = b"SLR3"
#: Ids are below it.
NONE = 65_535
#: Kinds of ids, checksum.
MODEL_HEADER = "<II"
MODEL_HEADER_SIZE = struct.calcsize(MODEL_HEADER)
#: The range is cut into so many units; an order 0 of weight ``part`` has ``part`` of them for each of its slots.
UNITS, SLOTS = float(1 << 24), 1 << 16
PARTS = (1 << 24) // SLOTS
RANGE_TOP, RANGE_LOW, DIGIT = float(1 << 48), float(1 << 32), float(1 << 16)
#: Places for predictions of each order in a block.
CELL_SHIFT = 6
CELLS = 1 << 16 - CELL_SHIFT
#: A prediction and how it fared: 0 there is none, 1 it is new or failed, 2 and 3 it held.
FARED_SHIFT, BEST = 16, 3
CONTEXTS = 2 * (BEST + 1) ** 2
#: Steps whose predictions the encoder finds at once, and steps it prepares at once for all lanes.
PREDICTED, PREPARED = 1 << 16, 1 << 14


class Model:
    """Order 0 and the weights of each context. ``part`` is a slot's share, ``weight1`` and ``weight2`` those of the predictions."""

    def __init__(self, kinds: np.ndarray, counts: np.ndarray, part: np.ndarray, weight2: np.ndarray) -> None:
        self.kinds, self.counts, self.part = kinds, counts.astype(np.float64), part.astype(np.float64)
        self.first = np.cumsum(self.counts) - self.counts
        self.slots = np.repeat(np.arange(len(kinds), dtype=np.int32), counts)
        self.weight2 = weight2.astype(np.float64)
        self.weight1 = UNITS - SLOTS * self.part - self.weight2

    @staticmethod
    def order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kinds of ids, ascending, and the slots of each, one at least."""
        came = np.bincount(ids, minlength=1)
        kinds = np.flatnonzero(came)
        if not len(kinds):
            return kinds, kinds
        came = came[kinds]
        counts = 1 + came * (SLOTS - len(kinds)) // came.sum()
        counts[came.argmax()] += SLOTS - counts.sum()
        return kinds, counts

    @staticmethod
    def weights(tally: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts and second weights from how often each context saw neither prediction hold, the first alone, the second."""
        neither, one, two = tally.reshape(CONTEXTS, 3).T
        part = np.clip(np.rint(PARTS * (neither + 1) / (neither + one + two + 1)), 1, PARTS)
        weight2 = np.floor((UNITS - SLOTS * part) * two / np.maximum(one + two, 1))
        return part.astype(np.int64), weight2.astype(np.int64)

    def to_bytes(self) -> bytes:
        body = b"".join(
            [self.kinds.astype("<u2").tobytes(), (self.counts - 1).astype("<u2").tobytes(), (self.part - 1).astype("<u1").tobytes(), self.weight2.astype("<u4").tobytes()]
        )
        return struct.pack(MODEL_HEADER, len(self.kinds), zlib.crc32(body)) + body

    @staticmethod
    def from_bytes(raw: bytes) -> Model:
        if len(raw) < MODEL_HEADER_SIZE:
            raise ValueError("a model is cut short")
        n, check = struct.unpack_from(MODEL_HEADER, raw)
        body = raw[MODEL_HEADER_SIZE:]
        if len(body) != 4 * n + 5 * CONTEXTS or zlib.crc32(body) != check:
            raise ValueError("not a model, or a damaged one")
        kinds, counts = (np.frombuffer(body, "<u2", n, 2 * n * k).astype(np.int64) for k in range(2))
        part, weight2 = np.frombuffer(body, "<u1", CONTEXTS, 4 * n), np.frombuffer(body, "<u4", CONTEXTS, 4 * n + CONTEXTS)
        return Model(kinds, counts + 1, part.astype(np.int64) + 1, weight2)


def _runs(lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Steps from, to and the lanes that take them; ``lengths`` falls."""
    at = 0
    for stop in np.unique(lengths[lengths > 0]).tolist():
        yield at, stop, int((lengths >= stop).sum())
        at = stop


def _hashes(kinds: int) -> list[np.ndarray]:
    """Hashes of kinds to cells: of the last id at order 1, of the one before it and the last at order 2."""
    number = np.arange(max(kinds, 1))
    return [(number * m & 0xFFFF) >> CELL_SHIFT for m in (40_503, 48_271, 25_717)]


class _Predictions:
    """What followed the last id and the last two ids of each lane; ids are numbers of kinds."""

    def __init__(self, lanes: int, kinds: int) -> None:
        self.hash1, self.hash2, self.hash3 = _hashes(kinds)
        self.one, self.two = np.zeros(lanes * CELLS, dtype=np.int32), np.zeros(lanes * CELLS, dtype=np.int32)
        self.rows = np.arange(lanes) * CELLS
        self.last = np.zeros(lanes, dtype=np.int32)
        self.before = np.zeros(lanes, dtype=np.int64)

    def lanes(self, k: int) -> None:
        self.rows, self.last, self.before = self.rows[:k], self.last[:k], self.before[:k]

    def next(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The predictions of both orders and the context; without a prediction it is kind 0, whose weight is 0."""
        self.cell1 = self.rows + self.hash1.take(self.last, mode="clip")
        self.cell2 = self.rows + (self.before ^ self.hash3.take(self.last, mode="clip"))
        found1, found2 = self.one.take(self.cell1, mode="clip"), self.two.take(self.cell2, mode="clip")
        self.guess1, self.guess2 = found1 & 0xFFFF, found2 & 0xFFFF
        self.fared1, self.fared2 = found1 >> FARED_SHIFT, found2 >> FARED_SHIFT
        context = (self.fared2 << 3) + (self.fared1 << 1) + (self.guess1 == self.guess2)
        return self.guess1, self.guess2, context

    def came(self, ids: np.ndarray, held1: np.ndarray, held2: np.ndarray) -> None:
        """Takes up what came, as 32-bit numbers."""
        self.one[self.cell1] = ids + (np.minimum(self.fared1 * held1 + 1, BEST) << FARED_SHIFT)
        self.two[self.cell2] = ids + (np.minimum(self.fared2 * held2 + 1, BEST) << FARED_SHIFT)
        self.before, self.last = self.hash2.take(self.last, mode="clip"), ids


def _chained(cells: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_Predictions`` finds at each step in the cells of an order, for all steps of some lanes (rows) at once: the
    prediction, how it fared before, and whether it holds.

    A cell holds the id of the step before that had this cell too, so steps are sorted by cell. How a prediction fared
    follows from the two before it, as it counts to three at most.
    """
    rows, steps = ids.shape
    order = (np.argsort(cells, axis=1, kind="stable") + np.arange(rows)[:, None] * steps).ravel()
    cell, now = cells.ravel().take(order, mode="clip").reshape(rows, steps), ids.ravel().take(order, mode="clip").reshape(rows, steps)
    again, found = np.zeros(ids.shape, dtype=bool), np.zeros((rows, steps, 2), dtype=np.uint16)
    guess, fared = found[:, :, 0], np.zeros(ids.shape, dtype=np.uint8)
    np.equal(cell[:, 1:], cell[:, :-1], out=again[:, 1:])
    np.multiply(now[:, :-1], again[:, 1:], out=guess[:, 1:])
    held = again & (guess == now)
    fared += again
    twice = again[:, 1:] & held[:, :-1]
    fared[:, 1:] += twice
    fared[:, 2:] += twice[:, 1:] & held[:, :-2]
    found[:, :, 1] = fared + (held.view(np.uint8) << 2)
    placed = np.empty(ids.size, dtype=np.uint32)
    placed[order] = found.view(np.uint32).ravel()
    found = placed.view(np.uint16).reshape(rows, steps, 2)
    fared = found[:, :, 1].astype(np.uint8)
    return found[:, :, 0], fared & BEST, fared >> 2


def _predicted(ids: np.ndarray, lengths: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Predictions and contexts of all steps of all lanes (rows), and how often each context saw neither, the first or the
    second hold."""
    guesses1, guesses2 = np.zeros(ids.shape, dtype=np.uint16), np.zeros(ids.shape, dtype=np.uint16)
    contexts, tally = np.zeros(ids.shape, dtype=np.uint8), np.zeros(CONTEXTS * 3, dtype=np.int64)
    hash1, hash2, hash3 = (h.astype(np.uint16) for h in _hashes(kinds))
    at_once = max(PREDICTED // max(ids.shape[1], 1), 1)
    for at in range(0, len(ids), at_once):
        now = ids[at : at + at_once]
        last, before = np.zeros_like(now), np.zeros_like(now)
        last[:, 1:] = now[:, :-1]
        before[:, 2:] = hash2.take(now[:, :-2], mode="clip")
        guess1, fared1, held1 = _chained(hash1.take(last, mode="clip"), now)
        guess2, fared2, held2 = _chained(before ^ hash3.take(last, mode="clip"), now)
        context = (fared2 << 3) + (fared1 << 1) + (guess1 == guess2)
        seen = 3 * context + np.maximum(2 * held2, held1)
        if (lengths[at : at + at_once] < ids.shape[1]).any():
            seen = seen[np.arange(ids.shape[1]) < lengths[at : at + at_once, None]]
        tally += np.bincount(seen.ravel(), minlength=len(tally))
        guesses1[at : at + at_once], guesses2[at : at + at_once], contexts[at : at + at_once] = guess1, guess2, context
    return guesses1, guesses2, contexts, tally


def encode_blocks(blocks: list[np.ndarray], shared: bool = False) -> tuple[bytes, list[bytes]] | list[bytes]:
    """Coded blocks of ids (each of at most BLOCK_IDS ids below 65,535), each with its model; with ``shared`` the common
    model and the blocks."""
    if not shared:
        return [_encode([block], True)[1][0] for block in blocks]
    return _encode(blocks, False)


def _encode(blocks: list[np.ndarray], own: bool) -> tuple[bytes, list[bytes]]:
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    lengths = np.array([len(blocks[k]) for k in order], dtype=np.int64)
    n, longest, runs = len(blocks), int(lengths.max(initial=0)), list(_runs(lengths))
    kinds, counts = Model.order0(np.concatenate([*blocks, np.zeros(0, dtype=np.uint16)]).astype(np.uint16))
    number = np.zeros(NONE + 1, dtype=np.uint16)
    number[kinds] = np.arange(len(kinds))
    ids = np.zeros((n, longest), dtype=np.uint16)
    for lane, k in enumerate(order):
        ids[lane, : lengths[lane]] = number[blocks[k]]
    guesses1, guesses2, contexts, tally = _predicted(ids, lengths, len(kinds))
    ids, guesses1, guesses2, contexts = (np.ascontiguousarray(x.T) for x in (ids, guesses1, guesses2, contexts))
    model = Model(kinds, counts, *Model.weights(tally))
    low, width = np.zeros(n), np.full(n, RANGE_TOP)
    # Digits of 16 bits; a digit may overflow into the one before, which is settled at the end. The dearest id, of one
    # slot and the least part, takes little over 24 bits, so a step leaves two digits at most. Three follow the last step.
    digits, left = np.zeros((2 * longest + 3, n), dtype=np.uint32), np.zeros((2 * longest + 3, n), dtype=bool)
    for start, stop, k in runs:
        lo, wide = low[:k], width[:k]
        at_once = max(PREPARED // k, 1)
        for t in range(start, stop):
            if (t - start) % at_once == 0:
                steps = slice(t, min(t + at_once, stop))
                now, context, guess1, guess2 = ids[steps, :k], contexts[steps, :k], guesses1[steps, :k], guesses2[steps, :k]
                part, weight1, weight2 = (x.take(context, mode="clip") for x in (model.part, model.weight1, model.weight2))
                firsts = part * model.first.take(now, mode="clip") + weight1 * (guess1 < now) + weight2 * (guess2 < now)
                shares = part * model.counts.take(now, mode="clip") + weight1 * (guess1 == now) + weight2 * (guess2 == now)
            unit = np.floor(wide * (1 / UNITS))
            lo += unit * firsts[(t - start) % at_once]
            np.multiply(unit, shares[(t - start) % at_once], out=wide)
            full = wide < RANGE_LOW
            digit = np.floor(lo * (1 / RANGE_LOW))
            digits[2 * t, :k], left[2 * t, :k] = digit, full
            leaves = full.astype(np.float64)
            lo -= digit * leaves * RANGE_LOW
            leaves *= DIGIT - 1
            leaves += 1
            lo *= leaves
            wide *= leaves
            if len(some := np.flatnonzero(wide < RANGE_LOW)):
                digit = np.floor(lo[some] * (1 / RANGE_LOW))
                digits[2 * t + 1, some], left[2 * t + 1, some] = digit, True
                lo[some] = (lo[some] - digit * RANGE_LOW) * DIGIT
                wide[some] *= DIGIT
    rest = low.astype(np.uint64)
    for last, shift in enumerate((32, 16, 0), 2 * longest):
        digits[last] = (rest >> np.uint64(shift)) & np.uint64(0xFFFFFFFF if shift == 32 else 0xFFFF)
        left[last] = True
    left = np.ascontiguousarray(left.T)
    used = left.sum(axis=1)
    digits = digits.T[left]
    over = np.flatnonzero(digits > 0xFFFF)
    while len(over):
        more = digits[over] >> 16
        digits[over] &= 0xFFFF
        over -= 1
        digits[over] += more
        over = over[digits[over] > 0xFFFF]
    raw_digits, stops = digits.astype("<u2").tobytes(), 2 * np.cumsum(used)
    raw_model = model.to_bytes()
    mine = raw_model if own else b""
    out: list[bytes] = [b""] * n
    for lane, k in enumerate(order):
        payload = mine + raw_digits[stops[lane] - 2 * used[lane] : stops[lane]]
        check = zlib.crc32(payload, zlib.crc32(blocks[k].astype("<u4").tobytes()))
        out[k] = struct.pack(HEADER, MAGIC, len(blocks[k]), used[lane], len(mine), check) + payload
    return raw_model, out


def decode_blocks(coded: list[bytes], model: bytes | None = None) -> list[np.ndarray]:
    """The ids of coded blocks as uint16, by the common ``model`` or by their own; raises ValueError on a damaged block."""
    heads = []
    for raw in coded:
        if len(raw) < HEADER_SIZE:
            raise ValueError("a block is cut short")
        magic, n_ids, n_digits, n_model, check = struct.unpack_from(HEADER, raw)
        if magic != MAGIC or n_ids > BLOCK_IDS or len(raw) != HEADER_SIZE + n_model + 2 * n_digits or bool(n_model) != (model is None):
            raise ValueError("not a block, or one cut short")
        heads.append((n_ids, n_digits, n_model, check))
    if model is not None:
        return _decode(coded, heads, Model.from_bytes(model))
    own = [Model.from_bytes(raw[HEADER_SIZE : HEADER_SIZE + h[2]]) for raw, h in zip(coded, heads, strict=True)]
    return [_decode([raw], [head], m)[0] for raw, head, m in zip(coded, heads, own, strict=True)]


def _decode(coded: list[bytes], heads: list[tuple[int, int, int, int]], model: Model) -> list[np.ndarray]:
    order = sorted(range(len(coded)), key=lambda k: -heads[k][0])
    lengths = np.array([heads[k][0] for k in order], dtype=np.int64)
    n, longest = len(coded), int(lengths.max(initial=0))
    if longest and not len(model.kinds):
        raise ValueError("a block fails its checksum")
    row = max((h[1] for h in heads), default=0) + 4
    digits = np.zeros((n, row), dtype=np.uint16)
    for lane, k in enumerate(order):
        digits[lane, : heads[k][1]] = np.frombuffer(coded[k], dtype="<u2", offset=HEADER_SIZE + heads[k][2])
    all_code = digits[:, 0] * RANGE_LOW + digits[:, 1] * DIGIT + digits[:, 2]
    all_width = np.full(n, RANGE_TOP)
    all_places, all_limits = np.arange(n) * row + 3, (np.arange(n) + 1) * row - 1
    digits = digits.ravel()
    out = np.zeros((longest, n), dtype=np.uint16)
    state = _Predictions(n, len(model.kinds))
    for start, stop, k in _runs(lengths):
        state.lanes(k)
        code, width, place, limit = all_code[:k], all_width[:k], all_places[:k], all_limits[:k]
        for t in range(start, stop):
            guess1, guess2, context = state.next()
            part, weight1, weight2 = (x.take(context, mode="clip") for x in (model.part, model.weight1, model.weight2))
            unit = np.floor(width * (1 / UNITS))
            value = np.minimum(np.floor(code / unit), UNITS - 1)
            # The share of a prediction lies before the slots of its kind; taken out, the slots are left. Lesser kind first.
            least, most = (model.first.take(guess, mode="clip") for guess in (np.minimum(guess1, guess2), np.maximum(guess1, guess2)))
            both = weight1 + weight2
            weight = weight2 + (weight1 - weight2) * (guess1 <= guess2)
            slots = np.minimum(value, np.maximum(part * least, value - weight))
            slots = np.minimum(slots, np.maximum(part * most, slots - (both - weight)))
            now = model.slots.take((slots / part).astype(np.int64), mode="clip")
            held1, held2 = guess1 == now, guess2 == now
            code -= unit * (part * model.first.take(now, mode="clip") + weight1 * (guess1 < now) + weight2 * (guess2 < now))
            np.multiply(unit, part * model.counts.take(now, mode="clip") + weight1 * held1 + weight2 * held2, out=width)
            full = width < RANGE_LOW
            scale = full * (DIGIT - 1)
            scale += 1
            code *= scale
            code += digits.take(place, mode="clip") * full
            width *= scale
            place += full
            if len(some := np.flatnonzero(width < RANGE_LOW)):
                code[some] = code[some] * DIGIT + digits.take(place[some], mode="clip")
                width[some] *= DIGIT
                place[some] += 1
            np.minimum(place, limit, out=place)
            out[t, :k] = now
            state.came(now, held1, held2)
    result: list[np.ndarray] = [np.zeros(0, np.uint16)] * n
    ids = model.kinds.astype(np.uint16)[out.T] if longest else np.zeros((n, 0), dtype=np.uint16)
    for lane, k in enumerate(order):
        found = ids[lane, : lengths[lane]]
        if zlib.crc32(coded[k][HEADER_SIZE:], zlib.crc32(found.astype("<u4").tobytes())) != heads[k][3]:
            raise ValueError("a block fails its checksum")
        result[k] = found
    return result
