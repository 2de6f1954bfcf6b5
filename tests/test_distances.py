import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import block_pairs, distances as D, errors, moments as M
from shardloom.spec import DatasetSpec


def features(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "global_index bigint, features array<double>").repartition(3)


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(60, 8)), rng.normal(0.4, 1.3, size=(45, 8))
    return x, y, features(spark, x), features(spark, y)


def kid(x, y):
    k = lambda a, b: (a @ b.T / x.shape[1] + 1) ** 3
    n, m = len(x), len(y)
    return (k(x, x).sum() - np.trace(k(x, x))) / n / (n - 1) + (k(y, y).sum() - np.trace(k(y, y))) / m / (m - 1) - 2 * k(x, y).mean()


def rbf(x, y):
    d = lambda a, b: np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)
    z = np.concatenate([x, y])
    tri = d(z, z)[np.triu_indices(len(z), 1)]
    b2 = float(np.median(tri[tri > 0])) if (tri > 0).any() else 1.0
    k = lambda a, b: np.exp(-d(a, b) / 2 / b2)
    n, m = len(x), len(y)
    return (k(x, x).sum() - n) / n / (n - 1) + (k(y, y).sum() - m) / m / (m - 1) - 2 * k(x, y).mean(), b2


def frechet(x, y):
    s1, s2 = np.cov(x, rowvar=False), np.cov(y, rowvar=False)
    w = np.linalg.eigvals(s1 @ s2)
    return ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * np.sqrt(np.clip(w.real, 0, None)).sum()


def test_moments_match_numpy(spark, sides):
    x, _, fx, _ = sides
    row = M.packed_moments(M.moments(fx)).first()
    assert np.allclose(row["mu"], x.mean(0), atol=1e-13) and np.allclose(row["sigma"], np.cov(x, rowvar=False), atol=1e-13)
    assert row["count"] == 60


def test_moments_survive_a_large_offset(spark, sides):
    x = sides[0] + 1e6
    row = M.packed_moments(M.moments(features(spark, x))).first()
    assert np.allclose(row["sigma"], np.cov(x, rowvar=False), rtol=1e-6, atol=1e-8)


def test_wide_moments_join_their_pilot(spark):
    x = np.random.default_rng(2).normal(3.0, 1.0, size=(40, 300))
    row = M.packed_moments(M.moments(features(spark, x))).first()
    assert np.allclose(row["mu"], x.mean(0)) and np.allclose(row["sigma"], np.cov(x, rowvar=False))


def test_one_sample_has_no_covariance(spark, sides):
    one = sides[2].where("global_index = 0")
    with pytest.raises(Exception, match="at least two samples"):
        M.moments(one).collect()
    reg = D.frechet_regularized(M.moments(one, strict=False), M.moments(sides[3])).first()["fid_reg"]
    x, y = sides[0][:1], sides[1]
    s1, s2 = np.eye(8) * 2e-6, np.cov(y, rowvar=False) + np.eye(8) * 1e-6
    want = ((x[0] - y.mean(0)) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * np.sqrt(np.linalg.eigvals(s1 @ s2).real).sum()
    assert reg == pytest.approx(want, rel=1e-9)


def test_frechet(spark, sides):
    x, y, fx, fy = sides
    mx, my = M.moments(fx), M.moments(fy)
    assert D.frechet(mx, my).first()["fid"] == pytest.approx(frechet(x, y), rel=1e-9)
    assert D.frechet(mx, mx).first()["fid"] == pytest.approx(0, abs=1e-9)
    few = fx.where("global_index < 6")
    low, full = D.frechet_low_rank(few, my).first(), D.frechet(M.moments(few), my).first()
    assert low["fid"] == pytest.approx(full["fid"], abs=1e-6) and low["n1"] == 6
    with pytest.raises(ValueError):
        D.frechet_low_rank(fx, my)


def test_frechet_against_one_common_reference(spark, sides):
    fx = sides[2].withColumn("name", F.when(F.col("global_index") % 2 == 0, "even").otherwise("odd"))
    rows = {r["name"]: r["fid"] for r in D.frechet(M.moments(fx, by=["name"]), M.moments(sides[3]), ["name"]).collect()}
    assert rows["even"] == pytest.approx(frechet(sides[0][0::2], sides[1]), rel=1e-9) and len(rows) == 2


def test_kid_both_ways_and_symmetric(spark, sides):
    x, y, fx, fy = sides
    want = kid(x, y)
    for method in ("moments", "blocks"):
        row = D.kid_poly3(fx, fy, method=method, block=16).first()
        assert row["mmd2"] == pytest.approx(want, rel=1e-9) and row["kid_x1000"] == pytest.approx(want * 1000, rel=1e-9)
        assert D.kid_poly3(fy, fx, method=method, block=16).first()["mmd2"] == pytest.approx(want, rel=1e-9)
    with pytest.raises(Exception, match="at least two samples"):
        D.kid_poly3(fx.where("global_index = 0"), fy).collect()


def test_tiles_cover_every_pair_once(spark, sides, monkeypatch):
    monkeypatch.setattr(block_pairs, "_TILE", 7)
    x, y, fx, fy = sides
    assert D.kid_poly3(fx, fy, method="blocks", block=30).first()["mmd2"] == pytest.approx(kid(x, y), rel=1e-9)
    value, b2 = rbf(x, y)
    row = D.mmd_rbf(fx, fy, block=30).first()
    assert row["bandwidth2"] == pytest.approx(b2, rel=1e-12) and row["mmd2"] == pytest.approx(value, rel=1e-9)


def test_rbf_falls_back_when_all_points_are_equal(spark):
    same = features(spark, np.ones((5, 3)))
    row = D.mmd_rbf(same, same).first()
    assert row["bandwidth2"] == 1.0 and row["mmd2"] == pytest.approx(0, abs=1e-12)


def test_random_projection_twin(spark):
    spec, size, dim, seed = DatasetSpec(3, 5, 7), 4, 6, 11
    x = np.random.default_rng(0).integers(0, 256, size=(9, spec.size)).astype(np.uint8)
    df = spark.createDataFrame([(i, bytes(r)) for i, r in enumerate(x)], "global_index bigint, image binary")
    got = np.array([r["features"] for r in errors.random_projection(df, spec, dim, size, seed).orderBy("global_index").collect()])
    image = x.reshape(-1, 3, 5, 7) / 255.0
    resized = np.zeros((9, 3, size, size))
    for i in range(size):
        for j in range(size):
            fy, fx = max((i + 0.5) * 5 / size - 0.5, 0), max((j + 0.5) * 7 / size - 0.5, 0)
            y0, x0 = int(fy), int(fx)
            y1, x1, dy, dx = min(y0 + 1, 4), min(x0 + 1, 6), fy - int(fy), fx - int(fx)
            resized[:, :, i, j] = (
                image[:, :, y0, x0] * (1 - dy) * (1 - dx) + image[:, :, y0, x1] * (1 - dy) * dx
                + image[:, :, y1, x0] * dy * (1 - dx) + image[:, :, y1, x1] * dy * dx
            )
    proj = np.random.default_rng(seed).normal(0, 1 / np.sqrt(3 * size * size), size=(3 * size * size, dim))
    assert np.allclose(got, resized.reshape(9, -1) @ proj, atol=1e-6)


def test_report_guards_its_pairs(spark, sides):
    fx = sides[2].withColumn("label", F.lit(1))
    with pytest.raises(ValueError, match="not the same samples"):
        D.reconstruction_report(fx, {"r": fx.where("global_index > 0")})
    skipped = D.reconstruction_report(fx, {"r": fx}, skip_mmd=True).first()
    assert skipped["mmd_skipped"] and skipped["mmd2_vs_original"] is None and skipped["rfid_vs_original"] == pytest.approx(0, abs=1e-9)


def test_compare_features_record(spark, sides):
    x, y, fx, fy = sides
    row = D.compare_features(fx, M.moments(fy)).first()
    assert row["mmd_status"] == "skipped_no_ref_features" and row["kid"] is None and row["ref_count"] == 45
    assert row["feature_mean"] == pytest.approx(x.mean()) and row["feature_std"] == pytest.approx(x.std())
    assert row["sigma_trace"] == pytest.approx(np.trace(np.cov(x, rowvar=False)))


def test_backends_need_both_thresholds(spark):
    def label(base, other):
        df = spark.createDataFrame([("a", base), ("b", other)], "name string, rfid_vs_original double")
        return D.compare_backends(df, "a", "b").first()

    assert label(1.0, 2.5)["label"] == "much_worse"
    assert label(0.1, 0.5)["label"] == "not_much_worse"
    assert label(10.0, 12.0)["label"] == "not_much_worse"
    assert label(0.0, 2.0)["ratio"] == float("inf")


def test_reference_statistics_round_trip(spark, sides, tmp_path):
    M.write_reference_stats(sides[2], str(tmp_path / "ref"))
    back = M.load_reference_stats(spark, str(tmp_path / "ref"))
    assert D.frechet(back, M.moments(sides[3])).first()["fid"] == pytest.approx(frechet(sides[0], sides[1]), rel=1e-9)


def test_median_distance_of_many_pairs(spark, monkeypatch):
    """Bins and their last pass against all pairs, with right, wrong and useless first guesses."""
    from shardloom.operators import block_pairs as B

    rnd = np.random.default_rng(9)
    x, y = rnd.normal(size=(90, 3)), np.round(rnd.normal(size=(70, 3)), 1) * 3
    y[:20] = y[0]
    rows = lambda z: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(z)], "global_index bigint, features array<double>")
    blocks = B.pack_blocks(rows(x), rows(y), "features", "global_index", 3, 40)
    pairs = B.pair_up(blocks)
    z = np.concatenate([x, y])
    d = B.squared_distances(z, z)[np.triu_indices(len(z), k=1)]
    want = np.median(d[d > 1e-12])
    monkeypatch.setattr(B, "_LEFT", 50)
    for low, high in ((want * 0.9, want * 1.1), (want * 1.5, want * 1.6), (want / 9, want / 8), (0.0, float("inf"))):
        monkeypatch.setattr(B, "_guess", lambda *_: (low, high))
        assert B.median_sq_distance(pairs, 3, blocks) == pytest.approx(want, rel=1e-9)


def test_block_form_of_many_rows_forms_no_pairs(spark, monkeypatch):
    rnd = np.random.default_rng(10)
    x, y = rnd.normal(size=(60, 3)), rnd.normal(size=(50, 3)) + 0.2
    rows = lambda z: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(z)], "global_index bigint, features array<double>")
    want = D.kid_poly3(rows(x), rows(y), method="blocks", block=30).first()["mmd2"]
    monkeypatch.setattr(D, "pair_up", lambda *_: pytest.fail("pairs of rows"))
    assert D.kid_poly3(rows(x), rows(y), method="blocks").first()["mmd2"] == pytest.approx(want, rel=1e-9)
