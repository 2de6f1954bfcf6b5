"""Blockwise suffix arrays and removal of repeated bytes against plain loops."""

import hashlib
import random

import numpy as np
import pytest

from shardloom.functions import hot_joins
from shardloom.llm import byte_repeats
from shardloom.llm.suffix_blocks import COVER, PERIOD, SuffixBlocks


def test_cover():
    assert {(a - b) % PERIOD for a in COVER.tolist() for b in COVER.tolist()} == set(range(PERIOD))


@pytest.mark.parametrize("n,letters,repeat,bucket", [(1, 2, 1, 4), (5, 1, 1, 2), (60, 1, 1, 7), (2000, 2, 1, 64), (2000, 1, 1, 100), (500, 4, 6, 1 << 16), (500, 4, 6, 90), (3000, 256, 1, 200)])
def test_suffix_order(n, letters, repeat, bucket):
    text = np.tile(np.random.default_rng(n).integers(0, letters, n).astype(np.uint8), repeat)
    index = SuffixBlocks(text)
    raw = text.tobytes() + bytes(index.whole - len(text))
    buckets = list(index.buckets(np.arange(len(text)), bucket))
    assert np.concatenate(buckets).tolist() == sorted(range(len(text)), key=lambda i: raw[i:])
    assert max(map(len, buckets)) < 3 * bucket + 100  # also where all suffixes open with the same bytes


@pytest.mark.parametrize("bucket", [1 << 16, 50])
def test_later_windows(bucket):
    rnd = random.Random(2)
    shared = bytes(rnd.choice(b"abc") for _ in range(60))
    contents = [bytes(rnd.choice(b"xyz") for _ in range(rnd.randint(0, 12))) + shared[k % 7 :] + bytes(rnd.choice(b"xyz") for _ in range(k % 3)) for k in range(90)] + [b"a" * 70]
    order, start = np.array([k * 37 % 45 for k in range(len(contents))]), np.array([k * 1000 for k in range(len(contents))])
    seen: dict[bytes, tuple] = {}
    for k, c in enumerate(contents):
        for i in range(len(c) - 39):
            w = c[i : i + 40]
            seen[w] = min(seen.get(w, (99, 0)), (int(order[k]), int(start[k]) + i))
    found = byte_repeats.later_windows([np.frombuffer(c, dtype=np.uint8) for c in contents], order, start, 40, bucket)
    for k, c in enumerate(contents):
        assert found[k].tolist() == [(int(order[k]), int(start[k]) + i) > seen[c[i : i + 40]] for i in range(len(c) - 39)]


def brute(rows, length):
    """Kept bytes and removed runs of rows given in the order of the corpus."""
    seen, out = set(), []
    for text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        edge = np.diff(np.concatenate([[False], gone]).astype(np.int8))
        runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((bytes(b for b, g in zip(raw, gone, strict=False) if not g), [(x, y - x) for x, y in runs]))
    return out


@pytest.mark.parametrize("shard_bytes,hot_rows", [(1 << 20, 10_000), (3000, 20), (300, 40), (1 << 20, 3)])
def test_removal(spark, shard_bytes, hot_rows, monkeypatch):
    monkeypatch.setattr(hot_joins, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(byte_repeats, "MANY_COPIES", hot_rows)
    rnd = random.Random(5)
    words = "eau où été the und straße of 水 x".split()
    make = lambda n: " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(n))
    passage, other = make(40), make(30)
    texts = [None, "", "é" * 49, "é" * 50, "é" * 51, "a" * 99, "a" * 100, "a" * 400, "abc" * 34, "abc" * 35 + "d", passage, passage[20:] + other]
    texts += [make(rnd.randint(1, 60)) for _ in range(30)]
    texts += [make(3) + passage + make(3) for _ in range(60)]  # one passage in many surroundings
    texts += [f"{make(1)} {passage[k:]} {other[: 90 + k]}" for k in range(40)]
    texts += [texts[20]] * 30 + [passage + passage, make(3000) + other]  # copies, a repeat within a text, a long text
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    again = [rows[25], rows[10], rows[10]]  # equal rows are one document
    late = [(None, texts[15] + passage)]
    docs = spark.createDataFrame(rows + again + late, "doc_id long, text string").selectExpr("*", "1 AS a", "2 AS __a", "3 AS kept", "4 AS name", "5 AS wanted", "6 AS removed").repartition(7)
    got = byte_repeats.remove_repeated_bytes(docs, shard_bytes=shard_bytes)
    assert got.columns == ["doc_id", "text", "a", "__a", "name", "wanted", "n_bytes", "n_removed", "removed", "kept_sha256", "kept"]
    got = got.collect()
    assert len(got) == len(rows) + 4
    want = dict(zip([i for i, _ in rows] + [None], brute([t for _, t in rows] + [late[0][1]], 100), strict=True))
    for r in got:
        kept, runs = want[r.doc_id]
        assert (bytes(r.kept), [(x.start, x.length) for x in r.removed or ()]) == (kept, runs), r.doc_id
        assert r.n_bytes == len((r.text or "").encode()) and r.n_removed == r.n_bytes - len(kept) and r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_removal_of_little(spark):
    docs = spark.createDataFrame([(1, "short"), (1, None), (None, "x" * 150), (None, "x" * 150)], "doc_id int, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in byte_repeats.remove_repeated_bytes(docs, keep=False).collect()) == [(0, 0), (5, 0), (150, 149), (150, 149)]
    assert byte_repeats.remove_repeated_bytes(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        byte_repeats.remove_repeated_bytes(docs, length=8)
