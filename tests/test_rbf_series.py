"""The single pass over all pairs against NumPy: exact median, kernel sums as a series, and what it hands back."""

import numpy as np
import pytest

from shardloom.operators import distances as D, rbf_series as S
from shardloom.operators.block_pairs import squared_distances


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "global_index bigint, features array<double>")


def expected(x, y):
    z = np.concatenate([x, y])
    d = ((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=-1)
    above = d[np.triu_indices(len(z), k=1)]
    b2 = np.median(above[above > 1e-12])
    k, n, m = np.exp(-d / (2 * b2)), len(x), len(y)
    within = [(part.sum() - len(part)) / (len(part) * (len(part) - 1)) for part in (k[:n, :n], k[n:, n:])]
    return b2, sum(within) - 2 * k[:n, n:].sum() / (n * m)


@pytest.fixture
def many(monkeypatch):
    monkeypatch.setattr(S, "MANY_PAIRS", 0)
    monkeypatch.setattr(S, "TILE", 64)


def wide_sides(seed, equal=30):
    rnd = np.random.default_rng(seed)
    x, y = (z / np.linalg.norm(z, axis=1)[:, None] for z in (rnd.normal(size=(520, 64)), rnd.normal(size=(410, 64))))
    x, y = x + 0.3, np.round(y, 1) + 0.3
    y[:equal], y[equal : 2 * equal] = x[:equal], y[2 * equal : 3 * equal]  # distances of 0 are not positive
    return x, y


def test_many_rows_meet_once(spark, many, monkeypatch):
    x, y = wide_sides(1)
    for name in ("median_sq_distance", "kernel_sums"):
        monkeypatch.setattr(D, name, lambda *_: pytest.fail("another pass over all pairs"))
    b2, value = expected(x, y)
    for block in (150, 1000):
        row = D.mmd_rbf(table(spark, x), table(spark, y), block=block).first()
        assert (row["n"], row["m"]) == (520, 410)
        assert row["bandwidth2"] == pytest.approx(b2, rel=1e-12) and row["mmd2"] == pytest.approx(value, abs=1e-10)


def test_few_dimensions_keep_the_kernel_in_double_precision(spark, many, monkeypatch):
    rnd = np.random.default_rng(2)
    x, y = rnd.normal(size=(400, 3)), rnd.normal(size=(300, 3)) * 1.5
    monkeypatch.setattr(D, "median_sq_distance", lambda *_: pytest.fail("another pass for the median"))
    row, (b2, value) = D.mmd_rbf(table(spark, x), table(spark, y), block=150).first(), expected(x, y)
    assert row["bandwidth2"] == pytest.approx(b2, rel=1e-12) and row["mmd2"] == pytest.approx(value, rel=1e-9)


def test_distances_with_few_values(spark, many):
    """Most pairs share a distance with others, the median's among them."""
    rnd = np.random.default_rng(3)
    x, y = rnd.integers(0, 2, size=(400, 24)).astype(float), rnd.integers(0, 2, size=(300, 24)).astype(float)
    row, (b2, value) = D.mmd_rbf(table(spark, x), table(spark, y), block=150).first(), expected(x, y)
    assert row["bandwidth2"] == pytest.approx(b2, rel=1e-12) and row["mmd2"] == pytest.approx(value, abs=1e-10)


@pytest.mark.parametrize("shift", [0.9, 1.1, None])
def test_a_misled_trial_costs_other_passes_only(spark, many, monkeypatch, shift):
    x, y = wide_sides(4, equal=0)
    right, (b2, value) = S.plan, expected(x, y)

    def wrong(*given):
        plan = right(*given)
        return plan and shift and S.Plan(plan.frame, plan.low * shift, plan.high * shift, plan.reach, plan.height, plan.degree)

    monkeypatch.setattr(S, "plan", wrong)
    row = D.mmd_rbf(table(spark, x), table(spark, y), block=300).first()
    assert row["bandwidth2"] == pytest.approx(b2, rel=1e-12) and row["mmd2"] == pytest.approx(value, rel=1e-9)


def test_single_pairs_are_exact():
    rnd = np.random.default_rng(5)
    a = rnd.normal(size=(70, 9))
    b = a[10:50]
    exact, (i, j) = S._Exact(a, b), np.divmod(np.arange(70 * 40), 40)
    want = squared_distances(a, b).reshape(-1)
    for got in (exact.pairs(i, j), exact.whole(0, 0, (70, 40), i, j)):
        assert got == pytest.approx(want, abs=1e-12) and np.count_nonzero(got == 0) == 40  # equal rows
