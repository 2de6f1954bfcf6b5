"""Bootstrap intervals, precision and recall, Inception Score and ranks against NumPy and plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.functions import hot_joins, ordering
from shardloom.operators import bootstrap, coverage, distances, moments, ranks

NAN = float("nan")


def features(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "global_index bigint, features array<double>")


def weight(seed, replicate, index):
    key = hashlib.md5(f"{seed}:{replicate // 4}:{index}".encode()).hexdigest()
    u = int(key[replicate % 4 * 8 :][:8], 16) / 2**32
    return sum(u >= c for c in bootstrap.POISSON_CUTS)


def test_cuts_are_those_of_the_poisson_distribution():
    assert bootstrap.POISSON_CUTS[0] == math.exp(-1) and 1 - bootstrap.POISSON_CUTS[-1] < 2**-32
    w = [weight(0, b, i) for b in range(8) for i in range(4000)]
    assert np.mean(w) == pytest.approx(1, abs=0.03) and np.var(w) == pytest.approx(1, abs=0.05)


@pytest.mark.parametrize("cells", [1 << 24, 60])
def test_replicates_are_weighted_moments(spark, monkeypatch, cells):
    monkeypatch.setattr(bootstrap, "OPEN_CELLS", cells)  # few cells: one scan per two replicates
    x = np.random.default_rng(0).normal(size=(70, 4)) + 100.0
    rows = bootstrap.bootstrap_moments(features(spark, x).repartition(5), 7, seed=2).collect()
    assert len(rows) == 7 * 4
    for b in range(7):
        w = np.array([weight(2, b, i) for i in range(70)])
        mu, sigma = np.average(x, axis=0, weights=w), np.cov(x.T, fweights=w)
        for r in (r for r in rows if r["replicate"] == b):
            assert r["n"] == w.sum() and r["mu"] == pytest.approx(mu[r["i"]], rel=1e-12) and np.allclose(r["sigma"], sigma[r["i"]], atol=1e-10)


def test_intervals(spark):
    rnd = np.random.default_rng(1)
    x, ref = rnd.normal(size=(300, 3)), features(spark, rnd.normal(size=(400, 3)))
    near, far = features(spark, x + 0.3), features(spark, 1.1 * x + 0.6)
    got = bootstrap.frechet_interval(near, ref, 60, 0.9).first()
    mom = moments.moments(ref)
    per = [r["fid"] for r in distances.frechet(bootstrap.bootstrap_moments(near, 60), mom, ["replicate"]).collect()]
    assert got["replicates"] == 60 and got["low"] == pytest.approx(np.quantile(per, 0.05)) and got["high"] == pytest.approx(np.quantile(per, 0.95))
    assert got["fid"] == pytest.approx(distances.frechet(moments.moments(near), mom).first()["fid"]) and got["low"] < got["fid"] < got["high"]
    pair = bootstrap.paired_frechet(far, near, ref, 40).first()
    assert pair["difference"] > 0 and pair["share_above"] == 1.0 and 0 < pair["low"] < pair["high"]
    same = bootstrap.paired_frechet(near, near, ref, 5).first()
    assert same["difference"] == same["low"] == same["high"] == 0 and same["share_above"] == 0.5


def brute_coverage(gen, real, k):
    def radii(x):
        d = np.sort(np.square(x[:, None] - x[None]).sum(axis=2) + np.diag(np.full(len(x), -1.0)), axis=1)
        return d[:, min(k, len(x) - 1)] if len(x) > 1 else np.zeros(1)

    cross = np.square(gen[:, None] - real[None]).sum(axis=2)
    return (cross <= radii(real)[None, :]).any(axis=1).mean(), (cross <= radii(gen)[:, None]).any(axis=0).mean()


@pytest.mark.parametrize("k", [1, 3, 500])
@pytest.mark.parametrize("block", [None, 7])
def test_precision_and_recall(spark, k, block):
    rnd = np.random.default_rng(3)
    real, gen = rnd.integers(0, 4, (60, 3)).astype(float), rnd.integers(1, 6, (41, 3)).astype(float)  # many ties and copies
    got = coverage.precision_recall(features(spark, gen), features(spark, real), k, block=block).first()
    want = brute_coverage(gen, real, k)
    assert (got["n_gen"], got["n_real"], got["precision"], got["recall"]) == (41, 60, *want)


def test_coverage_of_single_rows(spark):
    one, other = features(spark, [[1.0, 2.0]]), features(spark, [[1.0, 2.5]])
    assert tuple(coverage.precision_recall(one, other).first()) == (1, 1, 0.0, 0.0)
    assert tuple(coverage.precision_recall(one, one).first()) == (1, 1, 1.0, 1.0)
    with pytest.raises(ValueError):
        coverage.precision_recall(one, other, 0)


def test_inception_score(spark):
    p = np.random.default_rng(0).dirichlet(np.full(5, 0.3), 200)
    p[:40] = np.eye(5)[np.arange(40) % 5]  # zeros count nothing
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 3, r.tolist()) for i, r in enumerate(p)], "part int, probabilities array<double>")
    got = {r["part"]: r for r in coverage.inception_score(df, by=["part"]).collect()}
    for part in (None, 1, 2):
        q = p[[i for i in range(200) if (None if i % 3 == 0 else i % 3) == part]]
        mean = q.mean(axis=0)
        score = math.exp(np.mean([sum(a * math.log(a / m) for a, m in zip(r, mean, strict=True) if a > 0) for r in q]))
        assert got[part]["n"] == len(q) and got[part]["inception_score"] == pytest.approx(score, rel=1e-12)
    assert coverage.inception_score(df.limit(30).withColumn("probabilities", F.array(F.lit(0.5), F.lit(0.5)))).first()["inception_score"] == pytest.approx(1.0)
    with pytest.raises(Exception, match="not negative"):
        coverage.inception_score(spark.createDataFrame([([-0.5, 1.5],)], "probabilities array<double>")).collect()


@pytest.mark.parametrize("hot,single", [(10_000, 500_000), (3, 5)])
def test_ranks(spark, monkeypatch, hot, single):
    monkeypatch.setattr(hot_joins, "HOT_ROWS", hot)
    monkeypatch.setattr(ordering, "SINGLE_TASK_ROWS", single)
    values = [3.0] * 200 + [0.0, -0.0, NAN, NAN, None, None, float("inf"), -5.5] + [float(v) for v in range(40)]
    df = spark.createDataFrame([(i, v, i % 4) for i, v in enumerate(values)], "id int, v double, w int").selectExpr("*", "1 AS __n", "7 AS rank").repartition(6)
    order = lambda v: (math.isnan(v), v if not math.isnan(v) else 0)
    known = sorted((v for v in values if v is not None), key=order)
    for down in (False, True):
        got = ranks.average_ranks(df, "v", descending=down)
        assert got.columns == ["id", "v", "w", "__n", "rank"]
        for r in got.collect():
            if r["v"] is None:
                assert r["rank"] is None
                continue
            at = [k for k, u in enumerate(known, 1) if order(u) == order(r["v"])]
            up = (at[0] + at[-1]) / 2
            assert r["rank"] == (len(known) + 1 - up if down else up)
    both = {r["id"]: r["rank_sum"] for r in ranks.rank_sum(df, {"v": False, "w": True}).collect()}
    assert len(both) == len(values) and both[204] is None and both[0] is not None


def test_neighbours_of_large_blocks_take_bounded_memory():
    """The distances of a thousand rows to all rows of a block were held at once."""
    import tracemalloc

    rnd = np.random.default_rng(8)
    a, b = rnd.normal(size=(1500, 3)), rnd.normal(size=(60_000, 3))
    radii = np.full(len(b), 1e-4)
    tracemalloc.start()
    got, inside = coverage._nearest(a, b, 3, False), coverage._inside(a, b, radii)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    some = rnd.choice(len(a), 50, replace=False)
    d = np.square(a[some, None] - b).sum(axis=2)
    assert np.allclose(got[some], np.sort(d, axis=1)[:, :3], rtol=0, atol=0) and (inside[some] == (d <= 1e-4).any(axis=1)).all()
    own = coverage._nearest(a, a, 2, True)
    assert np.allclose(own, np.sort(np.square(a[:, None] - a).sum(axis=2), axis=1)[:, 1:3]) and peak < 30e6
