"""Whitening and vector codes against NumPy and plain loops."""

import hashlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from shardloom.llm import spectral, vector_codes, whitening


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["plain", "equal", "two values", "steep", "zero"])
def test_spectral(n, kind):
    rnd = np.random.default_rng(n)
    q, _ = np.linalg.qr(rnd.standard_normal((n, n)))
    values = {
        "plain": rnd.random(n) * 9, "equal": np.full(n, 3.0), "two values": np.repeat([5.0, 1.0], [n // 2, n - n // 2]),
        "steep": 10.0 ** -np.linspace(0, 14, n), "zero": np.zeros(n),
    }[kind]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    for wanted in (1, 4, n):
        e, v = spectral.leading_components(a, wanted)
        want = np.sort(np.linalg.eigvalsh(a))[::-1][:wanted]
        size = max(1.0, float(np.abs(values).max()))
        assert len(e) == min(wanted, n) and np.abs(e - want).max() < 1e-13 * size
        assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13 and np.abs(a @ v - v * e).max() < 1e-13 * size


def odd_rows(width):
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1), (901, [], 1), (902, [1.0] * (width - 1) + [None], 1), (903, [nan] + [1.0] * (width - 1), 2), (904, [inf] + [0.5] * (width - 1), 2), (905, [1.0] * (width - 1), 3), (906, [1e30] * width, 3)]


def vectors(n, width, seed=3, spread=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((6, width))
    rows = [(i * 7 % 1000, (centres[i % 6] + 0.2 * spread * rnd.standard_normal(width)).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(None, rows[5][1], None), (rows[3][0], rows[4][1], 1), (4000, [0.0] * width, 2)]
    return rows + [(5000 + i, rows[0][1], 7) for i in range(n)]  # a hot vector and label


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_whitening(spark):
    rows = vectors(200, 16)
    df = spark.createDataFrame(rows + odd_rows(16), SCHEMA).selectExpr("*", "1 AS x", "2 AS whitened", "3 AS i", "4 AS cells").repartition(5)
    found, model, error = whitening.whiten(df, components=20)
    assert found.columns == ["vec_id", "embedding", "label", "x", "i", "cells", "whitened", "deviation"]
    out = found.toPandas()
    assert len(out) == len(rows) and error < 1e-10
    x = np.floor(256 * np.array(out["embedding"].tolist(), dtype=np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    assert (model.n, model.sums) == (n, sums.tolist())
    covariance = np.cov(fit.T, bias=True)
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1], v[:, ::-1]
    assert np.allclose(model.values, e, rtol=1e-12) and model.trace == pytest.approx(np.trace(covariance), rel=1e-13)
    want = (x - sums / n) @ v / np.sqrt(e)
    got = np.array(out["whitened"].tolist())
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9
    assert [int(d) for d in out["deviation"]] == [int(((n * r - sums) ** 2).sum()) for r in x]


def test_whitening_of_little(spark):
    none, model, error = whitening.whiten(spark.createDataFrame(odd_rows(4)[:5], SCHEMA))
    assert none.count() == 0 and model is None and error is None and none.columns[-2:] == ["whitened", "deviation"]
    # One distinct vector has no variance; of a plane in three dimensions only two components have some.
    same, model, error = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA))
    assert error is None and model.trace == 0 and {tuple(r.whitened) for r in same.collect()} == {(None, None)}
    plane = [(i, [float(i % 5), float(i % 7), float(i % 5)], 0) for i in range(35)]
    flat, model, error = whitening.whiten(spark.createDataFrame(plane, SCHEMA))
    assert error < 1e-12 and all(r.whitened[2] is None and None not in r.whitened[:2] for r in flat.collect())
    # Sums and squares beyond 64 bits stay exact; beyond 38 digits they are null.
    big = [(0, [5e11, -1.0], 0), (1, [-7e11, 0.5], 0), (2, [3.0, 1e11], 0)]
    rows = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int"))[0].collect()
    x = [[int(np.floor(256 * c)) for c in r.embedding] for r in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert [int(r.deviation) for r in rows] == [sum((3 * a - s) ** 2 for a, s in zip(c, sums, strict=True)) for c in x]


def brute_codes(rows, parts, entries, rounds, scale):
    """Every round by full search, in Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(Fraction(c) * scale)) for c in v] for _, v, _ in rows]
    w = len(x[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in x]
    books = [[cut[k][p] for k in range(min(entries, len(x)))] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for v in cut:
                held[near(v[p], books[p])[1]].append(v[p])
            for e, members in held.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    out = [(r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for r, f in zip(rows, found, strict=True)]
    return out, hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest(), rows


@pytest.mark.parametrize("scale,replayed", [(4096, 8), (4096, 2), (3, 1), (1 << 24, 3)])
def test_vector_codes(spark, scale, replayed):
    rows = vectors(120, 16)
    df = spark.createDataFrame(rows + odd_rows(16), SCHEMA).selectExpr("*", "1 AS x", "2 AS code", "3 AS row", "4 AS slot").repartition(5)
    coded, book = vector_codes.train_and_encode(df, parts=4, entries=9, rounds=5, scale=scale, replayed=replayed)
    assert coded.columns == ["vec_id", "label", "x", "row", "slot", "code", "error"]
    got = vector_codes.add_label_errors(coded).collect()
    want, digest, ordered = brute_codes(rows, 4, 9, 5, scale)
    key = lambda r: repr(r)
    assert sorted(((r.vec_id, r.code.hex(), int(r.error)) for r in got), key=key) == sorted(want, key=key)
    assert vector_codes.books_digest(book) == digest
    totals = defaultdict(int)
    for (_, _, error), (_, _, label) in zip(want, ordered, strict=True):
        totals[label] += error
    assert all(int(r.label_error) == totals[r.label] for r in got)


def test_balls_skip_and_ties():
    rnd = np.random.default_rng(1)
    book = rnd.integers(-4000, 4000, (16, 8))
    own = rnd.integers(0, 16, 5000)
    x = book[own] + rnd.integers(-60, 60, (5000, 8))
    full = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    entry, distance, computed = vector_codes.reassign(x, own, book)
    assert (entry == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all() and computed < 1.1 * len(x)
    # Ties and equal entries go to the lower index, from whatever entry a part comes.
    book = np.array([[0, 0], [4, 0], [0, 0], [2, 2], [2, -2]])
    x = np.array([[2, 0], [0, 0], [4, 0], [2, 2], [100, 0]])
    for own in range(5):
        entry, _, _ = vector_codes.reassign(x, np.full(5, own), book)
        assert entry.tolist() == [0, 0, 1, 3, 1]


def test_vector_codes_of_little(spark):
    none, book = vector_codes.train_and_encode(spark.createDataFrame(odd_rows(8)[:5], SCHEMA))
    assert book is None and vector_codes.add_label_errors(none).count() == 0
    few, book = vector_codes.train_and_encode(spark.createDataFrame([(3, [1.0] * 8, None), (1, [-0.3] * 8, None)], SCHEMA))
    assert book.shape == (8, 2, 1) and {(r.vec_id, r.code.hex(), int(r.label_error)) for r in vector_codes.add_label_errors(few).collect()} == {(1, "00" * 8, 0), (3, "01" * 8, 0)}
    with pytest.raises(ValueError):
        vector_codes.train_and_encode(spark.createDataFrame([(1, [1.0] * 9, 0)], SCHEMA))
