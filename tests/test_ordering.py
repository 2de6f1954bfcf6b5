"""Ordered operators on skewed tables: one group holds more than a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shardloom.functions import ordering as O, quantiles as Q
from shardloom.functions.parsing import evenly_spaced, parse_float_list, parse_index_list, scale_slug


@pytest.fixture(autouse=True, params=[10, 10**6], ids=["buckets", "window"])
def path(request, monkeypatch):
    """Both ways: buckets as for a large table, and the plain window of a small one."""
    monkeypatch.setattr(O, "SINGLE_TASK_ROWS", request.param if "null" not in request.node.name else min(request.param, 1))


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 4000
    frame = pd.DataFrame({
        "id": np.arange(n), "g": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 50, n)),
        "t": rng.integers(0, 1000, n), "v": np.round(rng.normal(size=n), 3), "w": rng.integers(0, 5, n),
    })
    return frame, spark.createDataFrame(frame).repartition(5)


def test_running_sum_and_position(skewed):
    frame, df = skewed
    out = O.running_before(df, ["t", "id"], O.range_bucket(df, "t"), F.col("w"), ["g"], "before", position="pos").toPandas()
    s = frame.sort_values(["g", "t", "id"])
    s["before"] = s.groupby("g")["w"].cumsum() - s["w"]
    s["pos"] = s.groupby("g").cumcount()
    both = s.merge(out, on="id", suffixes=("", "_got"))
    assert (both["before"] == both["before_got"]).all() and (both["pos"] == both["pos_got"]).all()


def test_global_order_over_text_buckets(spark, skewed):
    frame, df = skewed
    named = df.withColumn("path", F.concat(F.lit("é/"), F.lpad(F.col("id").cast("string"), 6, "0")))
    bucket = O.ordered_bucket(named, "path")
    out = O.running_before(named, ["path"], bucket, name="pos").toPandas().sort_values("id")
    assert (out["pos"].to_numpy() == np.arange(len(frame))).all()
    if bucket is not None:
        assert named.select(bucket.alias("b")).distinct().count() > 8


def test_last_before_carries_over_buckets_and_nulls(skewed):
    frame, df = skewed
    value = F.when(F.col("v") > 1.0, F.col("v"))
    for inclusive in (False, True):
        out = O.last_before(df, ["t", "id"], O.range_bucket(df, "t"), value, ["g"], "last", inclusive).toPandas()
        s = frame.sort_values(["g", "t", "id"])
        s["x"] = s["v"].where(s["v"] > 1.0)
        filled = s.groupby("g")["x"].ffill()
        s["last"] = filled if inclusive else filled.groupby(s["g"]).shift()
        both = s.merge(out, on="id", suffixes=("", "_got"))
        assert both["last"].fillna(-1).equals(both["last_got"].fillna(-1))


def test_last_rows_per_group(skewed):
    frame, df = skewed
    for k in (3, 1500):
        out = O.last_rows(df, ["g"], "t", k, "id").toPandas()
        want = frame.sort_values(["t", "id"], ascending=False).groupby("g").head(k)
        assert set(out["id"]) == set(want["id"])
        assert (out.groupby("g")["rank_desc"].max() <= k).all()


@pytest.mark.parametrize("few", [None, True, False])
def test_exact_quantiles(skewed, monkeypatch, few):
    frame, df = skewed
    if few is not None:
        monkeypatch.setattr(Q, "SMALL_VALUES", 0)
    if few is False:
        monkeypatch.setattr(Q, "BROADCAST_ROWS", -1)
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    for r in Q.exact_quantiles(df, "v", probs, ["g"]).collect():
        v = frame.loc[frame["g"] == r["g"], "v"]
        assert r["n"] == len(v) and r["q"] == pytest.approx(np.quantile(v, probs), abs=1e-12)
    whole = Q.exact_quantiles(df, "v", [0.5]).first()
    assert whole["q"][0] == pytest.approx(np.median(frame["v"]))


@pytest.mark.parametrize("few", [None, True, False])
def test_tensor_quantiles(spark, monkeypatch, few):
    if few is not None:
        monkeypatch.setattr(Q, "SMALL_VALUES", 0)
    if few is False:
        monkeypatch.setattr(Q, "BROADCAST_ROWS", -1)
    x = np.random.default_rng(0).normal(size=(50, 6)).round(2)
    df = spark.createDataFrame([(i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "g int, tensor array<double>")
    for magnitude in (False, True):
        v = np.abs(x) if magnitude else x
        for r in Q.tensor_quantiles(df, 6, [0.1, 0.5, 0.9], ["g"], magnitude=magnitude).collect():
            assert r["q"] == pytest.approx(np.quantile(v[r["g"] :: 2], [0.1, 0.5, 0.9]), abs=1e-12)


def test_quantiles_leave_out_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,), (0.0,), (-2.0,)], "v double")
    row = Q.exact_quantiles(df, "v", [0.5, 1.0]).first()
    assert row["n"] == 4 and row["q"] == [0.5, 3.0]


def test_driver_side_lists():
    assert parse_index_list("0,10, 20") == [0, 10, 20] and parse_index_list("0:100:40,7") == [0, 40, 80, 7]
    assert parse_index_list("-1,2", 10) == [9, 2]
    with pytest.raises(ValueError):
        parse_index_list("1:2:3:4")
    assert evenly_spaced(1, 9) == [0] and evenly_spaced(3, 6) == [0, 2, 5] and evenly_spaced(9, 4) == [0, 1, 2, 3]
    assert evenly_spaced(32, 313) == sorted({int(round(v)) for v in np.linspace(0, 312, 32)})
    assert parse_float_list("0.5, 1") == [0.5, 1.0]
    with pytest.raises(ValueError):
        parse_float_list(" , ")
    assert [scale_slug(s) for s in (0.35, -1, 1e-7, 1e20)] == ["s0p35", "sm1", "s1em07", "s1e20"]


def test_rows_with_null_keys_stay(spark, monkeypatch):
    monkeypatch.setattr(Q, "SMALL_VALUES", 0)
    rows = [(None, 1, 1.0), (None, 2, 2.0), ("a", None, 3.0), ("a", 1, 4.0), ("a", 2, None)]
    df = spark.createDataFrame(rows, "g string, t bigint, v double")
    out = O.running_before(df, ["t"], O.range_bucket(df, "t"), group=["g"], name="pos")
    assert sorted((r["g"] or "", r["t"] or 0, r["pos"]) for r in out.collect()) == [("", 1, 0), ("", 2, 1), ("a", 0, 0), ("a", 1, 1), ("a", 2, 2)]
    last = O.last_before(df, ["t"], O.range_bucket(df, "t"), F.col("v"), ["g"], "p", inclusive=True)
    assert {(r["g"], r["t"]): r["p"] for r in last.collect()}[("a", 2)] == 4.0 and last.count() == 5
    assert {r["g"]: r["q"][0] for r in Q.exact_quantiles(df, "v", [0.5], ["g"]).collect()} == {None: 1.5, "a": 3.5}
    texts = spark.createDataFrame([("b",), (None,), ("a",)], "s string")
    placed = O.running_before(texts, ["s"], O.ordered_bucket(texts, "s"), name="pos")
    assert {r["s"]: r["pos"] for r in placed.collect()} == {None: 0, "a": 1, "b": 2}


@pytest.mark.parametrize("small", [0, 100])
def test_tensor_quantiles_keep_a_null_group(spark, monkeypatch, small):
    monkeypatch.setattr(Q, "SMALL_VALUES", small)
    df = spark.createDataFrame([(None, [1.0, 2.0]), (1, [5.0, 7.0])], "g int, tensor array<double>")
    assert {r["g"]: r["q"][0] for r in Q.tensor_quantiles(df, 2, [0.5], ["g"]).collect()} == {None: 1.5, 1: 6.0}


def test_batch_groups_keep_large_and_null_keys():
    import pyarrow as pa

    from shardloom.functions.batches import group_rows

    batch = pa.RecordBatch.from_pydict({"a": pa.array([2**60 + 1, None, 2**60 + 1, 5]), "b": ["x", "x", "x", None]})
    got = {k: list(r) for k, r in group_rows(batch, ["a", "b"])}
    assert got == {(2**60 + 1, "x"): [0, 2], (None, "x"): [1], (5, None): [3]}
