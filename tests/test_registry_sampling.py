import pytest
from pyspark.sql import functions as F

from shardloom.operators import registry as R, sampling as S, validation as V


@pytest.fixture(scope="module")
def headers(spark):
    rows = [("s2", 5), ("s0", 4), ("s1", 0), ("s3", 6)]
    return spark.createDataFrame(rows, "path string, num_samples bigint").withColumn("latent_shape", F.array(*[F.lit(4)] * 3))


@pytest.fixture(scope="module")
def samples(spark):
    return spark.range(500).select(F.col("id").alias("global_index"), (F.col("id") % 7).alias("label"))


def spans(df):
    return [(r["path"], r["start"], r["end"]) for r in df.orderBy("path").collect()]


def test_registry_ranges_and_cuts(headers):
    assert spans(R.shard_registry(headers)) == [("s0", 0, 4), ("s2", 4, 9), ("s3", 9, 15)]
    cut = R.shard_registry(headers, max_samples=7)
    assert spans(cut) == [("s0", 0, 4), ("s2", 4, 7)]
    assert R.source_total_seen(cut).first().asDict() == {"source_total_seen": 9, "total_samples": 7}
    assert spans(R.shard_registry(headers, max_shards=2)) == [("s0", 0, 4)]


def test_select_shards_order_of_rules(spark):
    headers = spark.range(20).select(F.format_string("p%03d", "id").alias("path"), F.lit(1).cast("bigint").alias("num_samples"))
    reg = R.shard_registry(headers)

    def picked(**kw):
        return sorted(r["shard_pos"] for r in R.select_shards(reg, **kw).collect())

    assert picked() == list(range(20)) and picked(max_shards=3) == [0, 1, 2]
    assert picked(indices=[0, -1, 5]) == [0, 5, 19] and picked(linspace=1) == [0]
    assert picked(indices=list(range(10)), linspace=4, max_shards=3) == [0, 3, 6]
    with pytest.raises(ValueError, match="out of range"):
        picked(indices=[20])
    with pytest.raises(ValueError, match="no shards"):
        picked(indices=[])


def test_locate_wraps_once_and_rejects_outside(spark, headers):
    reg = R.shard_registry(headers)
    asked = spark.createDataFrame([(0,), (8,), (14,), (-1,), (-15,)], "global_index bigint")
    got = {r["global_index"]: (r["path"], r["local_index"]) for r in R.locate(asked, reg).collect()}
    assert got == {0: ("s0", 0), 8: ("s2", 4), 14: ("s3", 5), -1: ("s3", 5), -15: ("s0", 0)}
    for bad in (15, -16):
        with pytest.raises(Exception, match="index out of range"):
            R.locate(spark.createDataFrame([(bad,)], "global_index bigint"), reg).collect()


def test_locate_spreads_one_huge_shard(spark):
    headers = spark.createDataFrame([("a", 10_000)] + [(f"b{i}", 1) for i in range(99)], "path string, num_samples bigint")
    asked = spark.range(10_099).withColumnRenamed("id", "global_index")
    out = R.locate(asked, R.shard_registry(headers))
    assert out.count() == 10_099 and out.where("path = 'a'").count() == 10_000


def test_global_index_drops_samples_past_a_cut(spark, headers):
    items = spark.createDataFrame([("s0", 0), ("s2", 1), ("s2", 4), ("s3", 0)], "path string, local_index bigint")
    cut = R.shard_registry(headers, max_samples=7)
    assert sorted(r["global_index"] for r in R.with_global_index(items, cut).collect()) == [0, 5]


def test_inventory_and_summary(spark, headers):
    files = spark.createDataFrame(
        [("c", "a", 10, False, False, 4), ("c", "b", 10, True, False, 9), ("d", "a", 7, False, False, 5), ("d", "b", 7, False, True, 5)],
        "cache string, name string, bytes bigint, is_tmp boolean, is_bad boolean, num_samples bigint",
    )
    rows = {r["cache"]: r for r in R.cache_inventory(files, 5).collect()}
    assert rows["c"]["samples"] == 4 and rows["c"]["remaining"] == 1 and rows["c"]["tmp_files"] == 1
    assert rows["d"]["samples"] == 5 and rows["d"]["bad_files"] == 1 and not rows["d"]["complete"]
    summary = R.dataset_summary(R.shard_registry(headers), expected=15, k=2).first()
    assert summary["ready"] and summary["first_shards"] == "s0,s2" and summary["last_shards"] == "s2,s3"


HEADER = "path string, read_error string, label_shape array<bigint>, latent_shape array<bigint>, flip_shape array<bigint>"
CASES = {
    "a_first": ("a_first", None, [3], [3, 4, 4, 4], [3, 4, 4, 4]),
    "labels must be [N]": ("b", None, [3, 1], [3, 4, 4, 4], None),
    "latents must be [N,C,H,W]": ("c", None, [3], [3, 4, 4], None),
    "labels/latents N mismatch": ("d", None, [2], [3, 4, 4, 4], None),
    "flip shape mismatch": ("e", None, [3], [3, 4, 4, 4], [3, 4, 4, 8]),
    "missing keys [labels]": ("f", None, None, [3, 4, 4, 4], None),
    "missing keys [latents]": ("g", None, [3], None, None),
    "latent shape changed": ("h", None, [3], [3, 8, 4, 4], None),
    "truncated": ("i", "truncated", None, None, None),
}


def test_every_validation_reason(spark):
    out = V.validate_shards(spark.createDataFrame(list(CASES.values()), HEADER))
    got = {r["path"]: (r["status"], r["error"]) for r in out.collect()}
    for reason, row in CASES.items():
        assert got[row[0]] == (("ok", None) if reason == "a_first" else ("error", reason))
    assert V.quarantine(out).count() == len(CASES) - 1
    with pytest.raises(ValueError, match="b: labels must be"):
        V.validate_shards(spark.createDataFrame(list(CASES.values()), HEADER), strict=True)
    with pytest.raises(ValueError, match="no valid shard"):
        V.validate_shards(spark.createDataFrame([CASES["truncated"]], HEADER))


def verify(spark, indices, dtype="I64", flip=True, **kw):
    rows = [(i, 3, 10, [3], [3, 4, 4, 4], [3, 4, 4, 4] if flip else None, dtype) for i in indices]
    schema = "shard_index int, num_samples bigint, bytes bigint, label_shape array<bigint>, latent_shape array<bigint>, flip_shape array<bigint>, label_dtype string"
    return V.verify_dataset(spark.createDataFrame(rows, schema), **kw).first()


def test_verify_dataset(spark):
    assert verify(spark, [0, 1, 2], expected_total=9, expected_shape=[4, 4, 4])["ok"]
    assert not verify(spark, [0, 2])["contiguous_shards"] and not verify(spark, [0, 1, 1])["contiguous_shards"]
    assert not verify(spark, [1, 2])["contiguous_shards"] and not verify(spark, [-1, 0])["contiguous_shards"]
    assert not verify(spark, [0], dtype="I32")["dtype_ok"] and not verify(spark, [0], flip=False)["shape_ok"]
    assert not verify(spark, [0], expected_total=4)["ok"] and not verify(spark, [])["ok"]


def test_samples_do_not_depend_on_partitioning(samples):
    ids = [[r["global_index"] for r in S.sample_exact(df, 60, 3).collect()] for df in (samples, samples.repartition(13))]
    assert ids[0] == ids[1] == sorted(ids[0]) and len(set(ids[0])) == 60
    bucketed = [r["global_index"] for r in S.sample_exact(samples, 60, 3, top_n_limit=0).collect()]
    assert bucketed == ids[0]
    assert [r["global_index"] for r in S.sample_exact(samples, 60, 4).collect()] != ids[0]
    with pytest.raises(ValueError):
        S.sample_exact(samples, 501, 3)
    assert S.sample_exact(samples, 501, 3, cap=True).count() == 500


def test_slices_are_clipped_and_checked(samples):
    assert S.slice_samples(samples, 490, 50).count() == 10
    for start in (-1, 500):
        with pytest.raises(ValueError):
            S.slice_samples(samples, start, 1)
    probes = [r["global_index"] for r in S.probe_points(samples).orderBy("global_index").collect()]
    assert probes == [0, 250, 499] and S.probe_points(samples.where("global_index < 1")).count() == 1


def test_view_choice(samples):
    df = samples.withColumn("has_flip", F.col("global_index") % 2 == 0)
    assert S.choose_view(df, 0.0, 1, 0).where("chosen_view = 'latents_flip'").count() == 0
    assert S.choose_view(df, 1.0, 1, 0).where("chosen_view = 'latents_flip'").count() == 250
    half = S.choose_view(df, 0.5, 1, 0).where("chosen_view = 'latents_flip'").count()
    assert 80 < half < 170
    with pytest.raises(ValueError):
        S.choose_view(df, 1.5, 1, 0)


def test_epoch_is_a_permutation(samples):
    out = S.epoch_batches(samples, 96, 1, 0, drop_last=False).toPandas().sort_values("perm_rank")
    assert list(out["perm_rank"]) == list(range(500)) and set(out["global_index"]) == set(range(500))
    assert out.groupby("batch_id").size().tolist() == [96] * 5 + [20]
    assert S.epoch_batches(samples, 96, 1, 0).count() == 480
    other = S.epoch_batches(samples, 96, 1, 1, drop_last=False).toPandas().sort_values("perm_rank")
    assert list(other["global_index"]) != list(out["global_index"])


def test_label_draws(spark, samples):
    fixed = [r["label"] for r in S.eval_labels(spark, 5, fixed=[1, 2]).orderBy("pos").collect()]
    assert fixed == [1, 2, 1, 2, 1]
    drawn = S.eval_labels(spark, 400, num_classes=10).toPandas()["label"]
    assert drawn.between(0, 9).all() and drawn.nunique() == 10
    matched = S.matched_labels(samples, 1250, 3)
    assert sorted(r["pos"] for r in matched.collect()) == list(range(1250))
    assert S.label_marginal_gap(samples, S.matched_labels(samples, 1000, 3)).first()["max_share_gap"] == 0
    assert S.matched_labels(samples, 0, 3).count() == 0


def test_resume_and_pairs(spark, samples):
    done = samples.where("global_index < 100")
    for fn in (V.resume_plan, V.resume_after_prefix):
        assert fn(samples, done, "global_index").count() == 400
    holes = samples.where("global_index < 100 AND global_index <> 50")
    assert V.resume_after_prefix(samples, holes, "global_index").count() == 401
    assert V.resume_after_prefix(samples, samples.limit(0), "global_index").count() == 500
    pairs = V.match_pairs(samples, done.withColumn("label", F.lit(0).cast("bigint"))).first()
    assert pairs["matched"] == 100 and pairs["only_left"] == 400 and pairs["labels_equal"] == 15 and not pairs["ok"]
    assert V.match_pairs(samples, samples).first()["ok"]


def test_order_audit(spark, samples):
    source = samples.select(F.col("global_index").alias("source_index"), "label")
    derived = source.withColumn("position", F.col("source_index"))
    assert V.order_audit(source, derived).first()["ok"]
    swapped = derived.withColumn("position", F.when(F.col("source_index") == 5, 6).when(F.col("source_index") == 6, 5).otherwise(F.col("position")))
    assert V.order_audit(source, swapped).first()["order_breaks"] == 1
    broken = derived.where("source_index <> 9").withColumn("label", F.when(F.col("source_index") == 3, 99).otherwise(F.col("label")))
    row = V.order_audit(source, broken).first()
    assert row["gaps"] == 1 and row["label_mismatches"] == 1 and not row["ok"]


def test_digest_ignores_order_only(samples):
    a, b = V.table_digest(samples).first(), V.table_digest(samples.repartition(9)).first()
    assert a == b and a != V.table_digest(samples.withColumn("label", F.col("label") + (F.col("global_index") == 7).cast("int"))).first()
