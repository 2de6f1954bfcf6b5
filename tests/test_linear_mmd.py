"""The linear-time MMD against all pairs, and its stated error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import distances, linear_mmd as L


def features(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "global_index bigint, features array<double>").repartition(4)


def brute(a, b, h):
    k = lambda p, q: np.exp(-np.square(p[:, None] - q[None]).sum(axis=2) / (2 * h))
    own = lambda p: (k(p, p).sum() - len(p)) / (len(p) * (len(p) - 1))
    return own(a) + own(b) - 2 * k(a, b).mean()


def test_estimate_and_error(spark):
    rnd = np.random.default_rng(0)
    x, y = rnd.normal(size=(2000, 3)) + 100, rnd.normal(size=(1600, 3)) * 1.2 + 100.3
    fx, fy = features(spark, x), features(spark, y)
    pooled = np.concatenate([x, y])
    assert L.mean_sq_distance(fx.unionByName(fy)) == pytest.approx(2 * pooled.var(axis=0, ddof=1).sum())
    exact = distances.mmd_rbf(fx, fy).first()
    got = L.mmd_rbf_linear(fx, fy, exact["bandwidth2"], rows=50).first()
    assert (got["n"], got["m"], got["blocks"], got["unused_rows"]) == (2000, 1600, 32, 0)
    assert abs(got["mmd2"] - exact["mmd2"]) < 4 * got["std_error"] < exact["mmd2"]
    whole = L.mmd_rbf_linear(fx, fy, exact["bandwidth2"], rows=5000).first()
    assert whole["blocks"] == 1 and whole["mmd2"] == pytest.approx(exact["mmd2"], abs=1e-10) and whole["std_error"] is None


def test_given_blocks_and_small_ones(spark):
    rnd = np.random.default_rng(1)
    x, y = rnd.normal(size=(31, 2)), rnd.normal(size=(20, 2))
    got = L.mmd_rbf_linear(features(spark, x), features(spark, y), 2.0, block=F.floor(F.col("global_index") / 10)).first()
    values = [brute(x[i * 10 : i * 10 + 10], y[i * 10 : i * 10 + 10], 2.0) for i in range(2)]
    assert (got["blocks"], got["unused_rows"]) == (2, 11) and got["mmd2"] == pytest.approx(np.mean(values))
    assert got["std_error"] == pytest.approx(np.std(values, ddof=1) / np.sqrt(2))
    same = features(spark, np.ones((8, 2)))
    flat = L.mmd_rbf_linear(same, same).first()
    assert flat["bandwidth2"] == 0 and flat["mmd2"] == 0
    single = L.mmd_rbf_linear(same.limit(1), same).first()
    assert single["mmd2"] is None and single["unused_rows"] == 9


def test_a_large_block_is_met_part_by_part(spark):
    """One task held whole blocks and the kernel of all their pairs."""
    rnd = np.random.default_rng(3)
    x, y = rnd.normal(size=(700, 2)), rnd.normal(size=(500, 2)) + 0.5
    block = F.when(F.col("global_index") < 400, 0).when(F.col("global_index") < 405, 1)  # the rest has none
    got = L.mmd_rbf_linear(features(spark, x), features(spark, y), 2.0, block=block, part_rows=64).first()
    values = [brute(x[a:b], y[a:b], 2.0) for a, b in ((0, 400), (400, 405), (405, None))]
    assert (got["n"], got["m"], got["blocks"], got["unused_rows"]) == (700, 500, 3, 0) and got["mmd2"] == pytest.approx(np.mean(values))
