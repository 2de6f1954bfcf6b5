"""Judges of different widths and condition numbers against NumPy."""

import numpy as np
import pytest

from shardloom.operators import judges, moments


def features(spark, x, **more):
    rows = [(i, [float(v) for v in r], *more.values()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "global_index bigint, features array<double>" + "".join(f", {c} string" for c in more))


def test_gap_of_judges_with_different_widths(spark):
    rnd = np.random.default_rng(0)
    real = {j: rnd.normal(size=(60, d)) for j, d in (("a", 3), ("b", 5), ("c", 2))}
    frames = lambda k: {j: features(spark, x * k) for j, x in real.items()}
    found = judges.judge_distances(frames(1.5), frames(1.0), frames(1.25))
    got = {r["judge"]: r for r in found.collect()}
    for j, x in real.items():
        size = np.square(x.mean(axis=0)).sum() + np.trace(np.cov(x.T))
        assert (got[j]["n1"], got[j]["n2"], got[j]["dims"]) == (60, 60, x.shape[1])
        assert got[j]["fid"] == pytest.approx(0.25 * size) and got[j]["fid_ratio"] == pytest.approx(4.0, rel=1e-6)
    gap = judges.judge_gap(found, ["a", "c"], "fid").first()
    assert (gap["train_judges"], gap["holdout_judges"]) == (2, 1)
    assert gap["gap"] == pytest.approx(got["b"]["fid"] - (got["a"]["fid"] + got["c"]["fid"]) / 2)
    alone = judges.judge_gap(found, ["a", "b", "c"]).first()
    assert alone["holdout_mean"] is None and alone["gap"] is None
    plain = judges.judge_distances(frames(1.5), frames(1.0)).first()
    assert plain["fid_ratio"] is None
    with pytest.raises(ValueError, match="same judges"):
        judges.judge_distances(frames(1.0), {"a": features(spark, real["a"])})


def test_condition_numbers(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(50, 4)) * [1, 10, 0.1, 3]
    e = np.linalg.eigvalsh(np.cov(x.T))
    got = judges.condition_number(moments.moments(features(spark, x))).first()
    assert (got["n"], got["dims"]) == (50, 4) and got["condition"] == pytest.approx(e[-1] / e[0]) and got["eig_min"] == pytest.approx(e[0])
    flat = features(spark, np.column_stack([x[:, 0], 2 * x[:, 0]]), run="flat").unionByName(features(spark, x[:1, :2], run="one"))
    rows = {r["run"]: r for r in judges.condition_number(moments.moments(flat, by=["run"], strict=False), ["run"]).collect()}
    assert rows["flat"]["condition"] == float("inf") and rows["flat"]["eig_min"] == 0
    assert rows["one"]["n"] == 1 and rows["one"]["condition"] is None
