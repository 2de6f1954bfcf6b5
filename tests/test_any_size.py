"""Operators that take another way for large tables give the same answers there."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.functions import ordering, quantiles
from shardloom.operators import distances, moments, sampling
from shardloom.session import scratch_dir
from shardloom.sources import logs, tables

INF = float("inf")


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and ((math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-12)))


@pytest.mark.parametrize("values", [
    [-1.0, 2.0, 5.0, INF, INF], [-INF, -INF, 0.0, -0.0, 1e-320, 1e308], [float("nan"), None, 3.0], [INF], [-INF, INF], [1.0, 1.0, 1.0000000000000002, 4.0],
])
def test_quantiles_of_odd_values(spark, values):
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    small, large = (quantiles.exact_quantiles(df, "v", probs, small_values=n).first() for n in (10**6, 0))
    assert small["n"] == large["n"] and all(same(a, b) for a, b in zip(small["q"], large["q"], strict=True)), (small, large)


def test_tensor_quantiles_of_odd_values(spark):
    rows = [(1, [-1.0, INF]), (1, [3.5, float("nan")]), (2, [0.0, -INF])]
    df = spark.createDataFrame(rows, "label int, tensor array<double>")
    for magnitude in (False, True):
        small, large = (
            {r["label"]: r for r in quantiles.tensor_quantiles(df, 2, [0.0, 0.5, 1.0], ["label"], magnitude=magnitude, small_values=n).collect()}
            for n in (10**6, 0)
        )
        for k in (1, 2):
            assert small[k]["n"] == large[k]["n"] and all(same(a, b) for a, b in zip(small[k]["q"], large[k]["q"], strict=True))
    for bad in ([1.0], [1.0, None], None, [1.0, 2.0, 3.0]):
        damaged = spark.createDataFrame([(1, [1.0, 2.0]), (1, bad)], "label int, tensor array<double>")
        for n in (10**6, 0):
            with pytest.raises(Exception):  # noqa: B017  a task's error
                quantiles.tensor_quantiles(damaged, 2, [0.5], small_values=n).collect()


def test_codes_never_decrease():
    v = np.sort(np.concatenate([np.random.default_rng(0).standard_normal(2000) * 10.0 ** np.arange(-300, 300, 0.3), [0.0, -0.0, INF, -INF, 5e-324, -5e-324, 1.7e308]]))
    codes = quantiles.value_codes(v)
    assert (np.diff(codes) >= 0).all() and codes[0] < codes[1] and codes[-1] > codes[-2]


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "double", "long", "string"])
def test_positions_in_any_order_column(spark, kind):
    start = dt.datetime(2020, 1, 1)
    values = {
        "date": [(start + dt.timedelta(days=k % 40)).date() for k in range(200)], "string": [f"v{k % 17}" for k in range(200)],
        "double": [float(k % 23) if k % 9 else float("nan") if k % 2 else INF for k in range(200)], "long": [k * k % 91 for k in range(200)],
    }.get(kind, [start + dt.timedelta(microseconds=k * 37 % 1000) for k in range(200)])
    df = spark.createDataFrame([(k, v if k % 31 else None) for k, v in enumerate(values)], f"id long, at {kind}")
    small, large = (
        {r["id"]: r["before"] for r in ordering.running_before(df, ["at", "id"], ordering.ordered_bucket(df, "at", n)).collect()} for n in (10**6, 0)
    )
    assert small == large and sorted(large.values()) == list(range(200))


def test_outliers_and_frequent_texts_spread(spark):
    numbers = spark.range(1000).select(F.when(F.col("id") == 0, 1e12).otherwise(F.col("id").cast("double")).alias("at"))
    texts = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("at"))
    for df, most in ((numbers, 200), (texts, 600)):
        sizes = [r["count"] for r in df.withColumn("b", ordering.ordered_bucket(df, "at", 0)).groupBy("b").count().collect()]
        assert len(sizes) > 4 and max(sizes) <= most


def test_sums_do_not_meet_all_at_once(spark):
    rows = [(k % 50, np.random.default_rng(k).standard_normal(5).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "label long, features array<double>").repartition(40)
    got = {(r["label"], r["i"]): r for r in moments.moments(df, by=["label"]).collect()}
    for label in (0, 49):
        x = np.array([v for k, v in rows if k == label])
        assert got[label, 2]["mu"] == pytest.approx(x[:, 2].mean())
        assert got[label, 2]["sigma"] == pytest.approx(np.cov(x.T)[2].tolist())


def test_distance_forms_agree(spark):
    rnd = np.random.default_rng(5)
    x, y = rnd.standard_normal((12, 20)), rnd.standard_normal((60, 20)) + 0.3
    one, two = (spark.createDataFrame([(v.tolist(),) for v in a], "features array<double>") for a in (x, y))
    full = distances.frechet(moments.moments(one), moments.moments(two)).first()["fid"]
    assert distances.frechet_low_rank(one, moments.moments(two)).first()["fid"] == pytest.approx(full, rel=1e-6)
    a, b = np.cov(x.T), np.cov(y.T)
    cross = np.sqrt(np.clip(np.linalg.eigvals(a @ b).real, 0, None)).sum()
    assert full == pytest.approx(((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * cross, rel=1e-5)


def test_first_samples_of_gapped_indexes(spark):
    rows = [(view, i, i % 3) for view in ("a", "b") for i in (5, 9, 100, 101, 400)]
    df = spark.createDataFrame(rows, "view string, global_index long, label long")
    assert sorted((r["view"], r["global_index"]) for r in sampling.take_per_view(df, 2).collect()) == [("a", 5), ("a", 9), ("b", 5), ("b", 9)]
    assert sampling.take_per_view(df, 99).count() == 10
    bank = tables.feature_bank(df.where("view = 'a'"), 3).collect()
    assert sorted(r["global_index"] for r in bank) == [5, 9, 100] and bank[0]["truncated_to_max_ref"] == 3
    assert tables.feature_bank(df.where("view = 'a'"), 5).first()["truncated_to_max_ref"] is None


def test_metric_text_over_line_breaks(spark):
    texts = {"a": ["FID:", "12.5"], "b": ["fid is", "", "  = ", "-3e1 end"], "c": ["FID:", "next", "7"], "d": ["FID50k:", "fid 4"], "e": ["fid", "e 5"], "f": ["fid 1", "FID:", "2"]}
    lines = spark.createDataFrame([(k, n, x) for k, v in texts.items() for n, x in enumerate(v)], "run string, line_no int, line string")
    got = {r["run"]: r["parsed_fid"] for r in logs.parse_metric_text(lines, ["run"]).collect()}
    import re

    for k, v in texts.items():
        found = re.search(logs.FID_TEXT, "\n".join(v))
        assert got[k] == (float(found[1]) if found else None), k


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = Context()

    with pytest.raises(ValueError):
        scratch_dir(Session(), "x")
    assert scratch_dir(spark, "x")


def test_long_groups_take_buckets(spark):
    df = spark.range(60).select((F.col("id") % 3).alias("g"), "id", (F.col("id") / 10).cast("int").alias("b"))
    found = []
    for most in (5, 100):
        bucket = ordering.bucket_in_groups(df, ["g"], F.col("b"), most)
        assert (bucket is None) == (most == 100)
        found.append(sorted((r["g"], r["id"], r["before"]) for r in ordering.running_before(df, ["id"], bucket, group=["g"]).collect()))
    assert found[0] == found[1]
