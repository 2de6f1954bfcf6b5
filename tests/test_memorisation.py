"""Nearest training rows against all pairs in NumPy."""

import math

import numpy as np
import pytest

from shardloom.operators import memorisation as M


def features(spark, x, first=0):
    rows = [(i + first, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "global_index bigint, features array<double>").repartition(4)


def brute(gen, real, within=math.inf):
    d2 = np.square(gen[:, None] - real[None]).sum(axis=2)
    at = d2.argmin(axis=1)  # the first of equal ones
    return [(int(a), math.sqrt(d2[i, a])) if d2[i, a] <= within * within else (None, None) for i, a in enumerate(at)]


def check(spark, gen, real, within=math.inf, **how):
    rows = M.nearest_training_rows(features(spark, gen), features(spark, real), within, **how).collect()
    got = {r["global_index"]: r for r in rows}
    assert len(rows) == len(got) == len(gen)
    for i, (who, d) in enumerate(brute(gen, real, within)):
        assert got[i]["nearest"] == who
        assert got[i]["distance"] is None if d is None else got[i]["distance"] == pytest.approx(d, abs=1e-12)
    return sum(r["verified"] for r in rows) / (len(gen) * len(real))


@pytest.mark.parametrize("how", [{}, {"block": 16, "chunk": 5}, {"block": 8, "cells": 4, "directions": 2}, {"directions": 0}])
def test_far_rows_and_ties(spark, how):
    rnd = np.random.default_rng(0)
    real = rnd.integers(0, 3, (300, 5)).astype(float)  # many copies and ties
    check(spark, rnd.integers(-1, 5, (80, 5)) / 2, real, **how)
    check(spark, rnd.integers(-1, 5, (80, 5)) / 2, real, 0.5, **how)


def test_near_copies_are_found_with_few_distances(spark):
    rnd = np.random.default_rng(1)
    real = rnd.normal(size=(1500, 24)) + 50.0
    gen = real[rnd.permutation(1500)[:300]] + rnd.normal(scale=0.02, size=(300, 24))
    assert check(spark, gen, real, block=64) < 0.05
    got = M.memorisation(features(spark, gen), features(spark, real), 0.11, block=64).first()
    d = np.array([d for _, d in brute(gen, real)])
    assert (got["n"], got["copies"], got["near"]) == (300, 0, (d <= 0.11).sum()) and got["verified_share"] < 0.05
    assert got["mean_distance"] == pytest.approx(d.mean())
    rate = M.near_duplicate_rate(features(spark, gen), features(spark, real), 0.11, block=64).first()
    assert rate["near_rate"] == pytest.approx((d <= 0.11).mean())


def test_a_third_of_both_tables_is_one_row(spark):
    rnd = np.random.default_rng(2)
    real, gen = rnd.normal(size=(600, 4)), rnd.normal(size=(300, 4))
    real[100:300] = gen[50:150] = real[100]
    check(spark, gen, real, block=20, chunk=10)


def test_single_and_missing_rows(spark):
    one = features(spark, [[1.0, 2.0]])
    assert M.nearest_training_rows(features(spark, [[1.0, 2.0], [4.0, 6.0]]), one).orderBy("global_index").select("nearest", "distance").collect() == [(0, 0.0), (0, 5.0)]
    none = one.limit(0)
    assert M.nearest_training_rows(none, one).count() == 0
    assert M.memorisation(none, one, 1.0).first()["near_rate"] is None
    with pytest.raises(ValueError, match="empty"):
        M.nearest_training_rows(one, none)
    with pytest.raises(Exception, match="finite"):
        M.nearest_training_rows(features(spark, [[math.nan, 1.0]]), one).collect()


@pytest.mark.parametrize("group", [64, 1000])
def test_a_row_is_copied_once_for_many_blocks(spark, group, monkeypatch):
    """Far rows meet every block; each meeting used to be a copy of the row."""
    rnd = np.random.default_rng(4)
    real, gen = rnd.normal(size=(600, 12)), rnd.normal(size=(90, 12))
    monkeypatch.setattr(M, "GROUP_ROWS", group)
    meet, copies = M._meet, []
    monkeypatch.setattr(M, "_meet", lambda visits, *rest: (copies.append(visits.count()), meet(visits, *rest))[1])
    check(spark, gen, real, block=10, chunk=40)
    assert sum(copies) <= 90 * -(-600 // group)
