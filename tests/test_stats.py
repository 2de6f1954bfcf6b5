import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import errors, stats, transforms
from shardloom.spec import DatasetSpec

SPEC = DatasetSpec(3, 2, 2)


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(1).normal(0.3, 2.0, size=(97, SPEC.size)).astype(np.float32)


def table(spark, x, labels=None):
    rows = [(i, int(labels[i]) if labels is not None else i % 5, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "global_index bigint, label bigint, tensor array<float>")


def test_global_and_channel_statistics(spark, data):
    df = table(spark, data).repartition(7)
    x = data.astype(np.float64)
    row = stats.tensor_stats(df, SPEC).first()
    assert row["sample_count"] == 97 and row["count"] == x.size
    assert row["mean"] == pytest.approx(x.mean()) and row["std"] == pytest.approx(x.std())
    assert row["rms"] == pytest.approx(np.sqrt((x * x).mean())) and row["absmax"] == np.abs(x).max()
    per = {r["channel"]: r for r in stats.channel_stats(df, SPEC).collect()}
    cube = x.reshape(-1, 3, 4)
    for c in range(3):
        assert per[c]["mean"] == pytest.approx(cube[:, c].mean()) and per[c]["std"] == pytest.approx(cube[:, c].std())
    sample = stats.tensor_stats(df, SPEC, ddof=1).first()
    assert sample["std"] == pytest.approx(x.std(ddof=1))


def test_merge_equals_union_for_any_split(spark, data):
    df = table(spark, data)
    whole = stats.finalize_channels(stats.merge_stats(stats.tensor_partials(df, SPEC))).orderBy("channel").collect()
    for cut in (1, 40, 96):
        parts = [stats.tensor_partials(df.where(c), SPEC) for c in (F.col("global_index") < cut, F.col("global_index") >= cut)]
        both = stats.finalize_channels(stats.merge_stats(parts[0].unionByName(parts[1]))).orderBy("channel").collect()
        for a, b in zip(whole, both):
            assert a["sample_count"] == b["sample_count"] and a["std"] == pytest.approx(b["std"], rel=1e-12)


def test_empty_table_gives_counts_only(spark, data):
    row = stats.tensor_stats(table(spark, data).limit(0), SPEC).first()
    assert row["count"] == 0 and row["sample_count"] == 0 and row["mean"] is None


def test_wrong_size_is_an_error(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0])], "global_index bigint, tensor array<float>")
    with pytest.raises(Exception, match="every row must hold an array of 12 values"):
        stats.tensor_stats(df, SPEC).collect()


def test_many_groups_flush_partials(spark, monkeypatch, data):
    df = table(spark, data, np.arange(97))
    monkeypatch.setattr(stats, "_MAX_OPEN_GROUPS", 10)
    out = stats.tensor_stats(df, SPEC, ["label"])
    assert out.count() == 97 and out.agg(F.sum("sample_count")).first()[0] == 97


def test_single_precision_sums_do_not_drift(spark):
    spec = DatasetSpec(1, 1, 4)
    df = spark.range(200_000).select(F.col("id").alias("global_index"), F.array(*[F.lit(16_777_217.0).cast("float")] * 4).alias("tensor"))
    assert stats.tensor_stats(df, spec).first()["mean"] == float(np.float32(16_777_217.0))


def test_finite_audit_counts(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", [1.0, nan, inf]), ("a", [-inf, 1.0, 2.0]), ("b", [0.0, 1.0, 2.0])], "g string, tensor array<float>")
    rows = {r["g"]: r for r in stats.finite_audit(df, ["g"]).collect()}
    assert (rows["a"]["nan_count"], rows["a"]["pos_inf_count"], rows["a"]["neg_inf_count"]) == (1, 1, 1)
    assert not rows["a"]["all_finite"] and rows["b"]["all_finite"]
    assert stats.finite_audit(df.limit(0)).first()["all_finite"] is False


def test_abs_quantiles_are_exact(spark, data):
    row = stats.abs_quantiles(table(spark, data), SPEC).first()
    want = np.quantile(np.abs(data.astype(np.float64)), [0.5, 0.9, 0.95, 0.99])
    assert [row[c] for c in ("abs_median", "abs_p90", "abs_p95", "abs_p99")] == pytest.approx(want, rel=1e-12)
    assert row["abs_mean"] == pytest.approx(np.abs(data.astype(np.float64)).mean())


def test_affine_closed_form_equals_recomputation(spark, data):
    df = table(spark, data)
    for scale, shift in ((-1.5, 0.25), (0.35, 0.0), (0.0, 2.0)):
        closed = transforms.affine_stats(stats.tensor_stats(df, SPEC), scale, shift).first()
        again = stats.tensor_stats(transforms.denormalize(df, SPEC, scale, shift), SPEC).first()
        for f in transforms.STAT_FIELDS:
            assert closed[f"decode_space_{f}"] == pytest.approx(again[f], abs=1e-6)


def test_normalize_then_denormalize_is_identity(spark, data):
    df = table(spark, data)
    norm = transforms.fit_normalizer(df, SPEC, 50)
    back = transforms.denormalize(transforms.normalize(df, SPEC, norm), SPEC, stats=norm)
    got = np.array([r["tensor"] for r in back.orderBy("global_index").collect()])
    assert np.allclose(got, data, atol=1e-9)
    assert transforms.denormalize(df, SPEC) is df


def test_normalizer_must_fit_the_channels(spark, data):
    df = table(spark, data)
    with pytest.raises(ValueError, match="expected 3 channel rows"):
        transforms.normalize(df, SPEC, transforms.fit_normalizer(df, SPEC, 50).where("channel < 2"))


def test_quantize_rounds_half_to_even(spark):
    x = [0.5 / 255, 1.5 / 255, 2.5 / 255, -0.2, 1.4]
    df = spark.createDataFrame([(0, [float(v) for v in x])], "global_index bigint, tensor array<double>")
    assert transforms.quantize_u8(df, "zero1").first()["image"] == [0, 2, 2, 0, 255]
    assert transforms.quantize_u8(df, "minus1_1").first()["image"][-1] == 255
    # -0.2 is outside the unit range, so the group is read as [-1, 1]
    assert transforms.quantize_u8(df, "auto").first()["image"] == transforms.quantize_u8(df, "minus1_1").first()["image"]
    with pytest.raises(ValueError):
        transforms.quantize_u8(df, "other")


def test_identical_images_have_infinite_psnr(spark):
    spec = DatasetSpec(1, 2, 2)
    rows = [(i, [i, 1, 2, 3]) for i in range(4)]
    a = spark.createDataFrame(rows, "global_index bigint, image array<int>")
    same = errors.pixel_error(errors.pair_images(a, a), spec).first()
    inf = float("inf")
    assert same["mse"] == 0 and same["psnr_global"] == inf and same["image_psnr_mean"] == inf and same["image_psnr_median"] == inf
    b = spark.createDataFrame([(i, [v + (4 if i == 0 else 0) for v in r]) for i, r in rows], "global_index bigint, image array<int>")
    one = errors.pixel_error(errors.pair_images(a, b), spec).first()
    assert one["max_abs_uint8"] == 4 and one["image_psnr_mean"] == pytest.approx(10 * np.log10(255**2 / 16))
    assert one["image_mse_median"] == 0


def test_binary_and_array_images_agree(spark):
    spec = DatasetSpec(3, 2, 2)
    rng = np.random.default_rng(3)
    rows = [(i, [int(v) for v in rng.integers(0, 256, spec.size)]) for i in range(20)]
    arrays = spark.createDataFrame(rows, "global_index bigint, image array<int>")
    packed = errors.array_to_bytes(arrays, spec)
    a, b = errors.image_summary(arrays, spec).first().asDict(), errors.image_summary(packed, spec).first().asDict()
    assert a == b
    u = np.array([r[1] for r in rows]) / 255.0
    assert a["mean"] == pytest.approx(u.mean()) and a["channel_std_2"] == pytest.approx(u.reshape(-1, 3, 4)[:, 2].std())


def test_rel_error_uses_group_norms(spark):
    df = spark.createDataFrame([([3.0, 0.0], [3.0, 1.0]), ([4.0, 0.0], [4.0, 0.0])], "a array<double>, b array<double>")
    row = errors.rel_error(df, "a", "b").first()
    assert row["rel_error"] == pytest.approx(1 / 5) and row["max_abs"] == 1.0


def test_scale_sweep_keeps_failures(spark, data):
    df = table(spark, data)

    def metric(decoded, scale):
        if scale == 2.0:
            raise RuntimeError("no memory")
        return stats.tensor_stats(decoded, SPEC).select((F.col("std") - 1).alias("fid"))

    swept = transforms.scale_sweep(df, SPEC, [0.5, 2.0], metric_fn=metric)
    rows = {r["scale"]: r for r in swept.collect()}
    assert rows[2.0]["status"] == "failed" and "no memory" in rows[2.0]["error"] and rows[0.5]["status"] == "ok"
    assert transforms.best_scales(swept).first()["best_fid_scale"] == 0.5


def test_reference_ratio_is_null_for_zero_reference(spark, data):
    row = transforms.space_report(table(spark, data), SPEC, ref_std=0.0).first()
    assert row["sample_space_std_over_reference"] is None and row["sample_space_rms_over_reference"] is not None
