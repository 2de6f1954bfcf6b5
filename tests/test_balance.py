"""Class-balanced subsets against plain sorting, class scatter against NumPy."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from shardloom.operators import balance


def wanted(rows, n, seed):
    out = []
    for label in {r[0] for r in rows}:
        keyed = sorted((hashlib.md5((f"{seed}:{i}" if i is not None else str(seed)).encode()).hexdigest(), i) for k, i in rows if k == label)
        last = keyed[min(n, len(keyed)) - 1][0]
        out += [(label, i) for key, i in keyed if key <= last]
    return Counter(out)


@pytest.mark.parametrize("step, ranked", [(4, 100_000), (1, 3), (4, 0), (5, 0)])
def test_balanced_subset(spark, step, ranked):
    """One label with nine tenths of the rows, a null label, one with a single row, and repeated indexes."""
    rows = [("hot", i) for i in range(900)] + [(None, i) for i in range(60)] + [("b", i) for i in range(39)] + [("one", 5)] + [("same", 7)] * 20
    df = spark.createDataFrame(rows, "label string, global_index long").repartition(4)
    got = balance.balanced_subset(df, 12, seed=3, cap=True, step=step, ranked=ranked)
    found = Counter(map(tuple, got.collect()))
    assert found == wanted(rows, 12, 3) and got.columns == ["label", "global_index"]
    assert Counter(k for k, _ in found.elements()) == {"hot": 12, None: 12, "b": 12, "one": 1, "same": 20}


def test_balanced_subset_of_the_rarest_and_of_nothing(spark):
    rows = [(i % 3 if i < 9 else 0, i) for i in range(200)]
    df = spark.createDataFrame(rows, "label long, global_index long")
    assert Counter(r.label for r in balance.balanced_subset(df).collect()) == {0: 3, 1: 3, 2: 3}
    with pytest.raises(ValueError, match="rarest has 3"):
        balance.balanced_subset(df, 4)
    assert balance.balanced_subset(df.where("label > 5")).count() == 0


def test_more_labels_than_a_broadcast_takes(spark, monkeypatch):
    monkeypatch.setattr(balance, "is_small", lambda df: False)
    rows = [(i % 40 if i % 2 else 0, i) for i in range(800)]
    df = spark.createDataFrame(rows, "label long, global_index long").repartition(3)
    assert Counter(map(tuple, balance.balanced_subset(df, 5, 1, step=1, ranked=2).collect())) == wanted(rows, 5, 1)


@pytest.mark.parametrize("classes", [1, 4, 60])
def test_class_scatter(spark, classes):
    rnd = np.random.default_rng(classes)
    x = rnd.normal(size=(60, 3)) + 50.0
    labels = [None if c == 0 else c for c in (np.arange(60) % classes).tolist()]
    x[:, 0] += np.arange(60) % classes
    df = spark.createDataFrame([(c, [float(v) for v in r]) for c, r in zip(labels, x)], "label long, features array<double>").repartition(3)
    got = sorted(balance.class_scatter(df).collect(), key=lambda r: r.i)
    means = np.array([x[[k for k in range(60) if labels[k] == c]].mean(axis=0) for c in labels])
    between = (means - x.mean(axis=0)).T @ (means - x.mean(axis=0)) / 60
    assert np.allclose([r.between for r in got], between, atol=1e-10) and all((r.n, r.classes) == (60, classes) for r in got)
    if classes == 60:
        assert all(r.within is None for r in got)
    else:
        assert np.allclose([r.within for r in got], (x - means).T @ (x - means) / (60 - classes), atol=1e-10)


def test_class_coverage(spark):
    real = spark.createDataFrame([(1,), (1,), (2,), (None,)], "label long")
    gen = spark.createDataFrame([(1,), (3,), (3,), (None,), (None,)], "label long")
    assert tuple(balance.class_coverage(gen, real).first()) == (3, 2, 2 / 3, 2)
    assert tuple(balance.class_coverage(gen, real, least=2).first()) == (3, 1, 1 / 3, 2)
    assert tuple(balance.class_coverage(gen.limit(0), real.limit(0)).first()) == (0, 0, None, 0)
