"""Statistics, normalisation, quantising and paired-error queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from shardloom.functions import quantiles
from shardloom.operators import errors, stats, transforms
from shardloom.plans.catalog import query, rounded
from shardloom.plans.views import SPEC, Tables
from shardloom.spec import DatasetSpec

STATS = """round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(sqrt(avg(v * v)), 6) AS rms,
    round(min(v), 6) AS "min", round(max(v), 6) AS "max" """
COUNTS = "count(DISTINCT global_index) AS sample_count, count(*) AS count"


@query("tensor_stats", f"SELECT {COUNTS}, {STATS}, round(max(abs(v)), 6) AS absmax FROM elements", ("elements",))
def _(t: Tables):
    return rounded(stats.tensor_stats(t.latents, SPEC))


@query(
    "tensor_stats_by_shard",
    f"SELECT shard, {COUNTS}, {STATS}, round(max(abs(v)), 6) AS absmax FROM elements GROUP BY shard", ("elements",),
)
def _(t: Tables):
    return rounded(stats.tensor_stats(t.latents, SPEC, ["shard"]))


@query(
    "tensor_stats_sample_std",
    "SELECT label, round(stddev_samp(v), 6) AS std FROM elements GROUP BY label", ("elements",),
)
def _(t: Tables):
    return rounded(stats.tensor_stats(t.latents, SPEC, ["label"], ddof=1).select("label", "std"))


@query(
    "channel_stats",
    f"SELECT CAST(channel AS INTEGER) AS channel, {COUNTS}, {STATS} FROM elements GROUP BY channel", ("elements",),
)
def _(t: Tables):
    return rounded(stats.channel_stats(t.latents, SPEC))


@query(
    "channel_summary",
    """WITH per AS (SELECT shard, channel, avg(v) AS m, stddev_pop(v) AS s FROM elements GROUP BY ALL)
    SELECT shard, round(min(m), 6) AS mean_min, round(max(m), 6) AS mean_max, round(avg(m), 6) AS mean_mean,
      round(stddev_pop(m), 6) AS mean_std, round(min(s), 6) AS std_min, round(max(s), 6) AS std_max,
      round(avg(s), 6) AS std_mean, round(stddev_pop(s), 6) AS std_std FROM per GROUP BY shard""",
    ("elements",),
)
def _(t: Tables):
    return rounded(stats.channel_summary(stats.channel_stats(t.latents, SPEC, ["shard"]), ["shard"]))


@query(
    "stats_with_merged",
    f"""WITH every AS (SELECT 'latents' AS view, * FROM elements UNION ALL BY NAME SELECT 'latents_flip' AS view, * FROM flips),
    keyed AS (SELECT view || global_index AS sample, * FROM every)
    SELECT view, CAST(channel AS INTEGER) AS channel, count(DISTINCT sample) AS sample_count, count(*) AS count, {STATS}
    FROM keyed GROUP BY GROUPING SETS ((view, channel), (channel))""",
    ("elements", "flips"),
)
def _(t: Tables):
    return rounded(stats.stats_with_merged(t.views, SPEC))


@query(
    "merge_stats", f"SELECT CAST(channel AS INTEGER) AS channel, {COUNTS}, {STATS} FROM elements GROUP BY channel",
    ("elements",),
)
def _(t: Tables):
    """Partials of ten parts (by label), kept apart and merged: the same as one pass."""
    parts = stats.merge_stats(stats.tensor_partials(t.latents, SPEC, ["label"]), ["label"])
    return rounded(stats.finalize_channels(stats.merge_stats(parts)))


@query(
    "shape_span",
    """SELECT array_to_string(list(num_samples ORDER BY path)[1:1] || [4, 4, 4], ',') AS shape_first,
      array_to_string(list(num_samples ORDER BY path DESC)[1:1] || [4, 4, 4], ',') AS shape_last FROM headers""",
    ("headers",),
)
def _(t: Tables):
    registry = t.registry.withColumn("latent_shape", F.array(F.lit(4), F.lit(4), F.lit(4)))
    return stats.shape_span(registry).select(
        *[F.array_join(c, ",").alias(c) for c in ("shape_first", "shape_last")]
    )


@query(
    "abs_quantiles",
    """SELECT label, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(avg(abs(v)), 6) AS abs_mean,
      round(max(abs(v)), 6) AS abs_max, round(quantile_cont(abs(v), 0.5), 6) AS abs_median,
      round(quantile_cont(abs(v), 0.9), 6) AS abs_p90, round(quantile_cont(abs(v), 0.95), 6) AS abs_p95,
      round(quantile_cont(abs(v), 0.99), 6) AS abs_p99 FROM elements GROUP BY label""",
    ("elements",),
)
def _(t: Tables):
    return rounded(stats.abs_quantiles(t.latents, SPEC, ["label"]))


@query(
    "abs_quantiles_global",
    """SELECT round(quantile_cont(abs(v), 0.5), 6) AS abs_median, round(quantile_cont(abs(v), 0.99), 6) AS abs_p99
    FROM elements""",
    ("elements",),
)
def _(t: Tables):
    return rounded(stats.abs_quantiles(t.latents, SPEC).select("abs_median", "abs_p99"))


@query(
    "abs_quantiles_large",
    """SELECT label, count(*) AS n, round(quantile_cont(abs(v), 0.5), 6) AS abs_median, round(quantile_cont(abs(v), 0.99), 6) AS abs_p99
    FROM elements GROUP BY label""",
    ("elements",),
)
def _(t: Tables):
    """The form for tables of any size, which the other quantile queries only take beyond a million values."""
    q = quantiles.tensor_quantiles(t.latents, SPEC.size, [0.5, 0.99], ["label"], magnitude=True, small_values=0)
    return rounded(q.select("label", "n", F.col("q")[0].alias("abs_median"), F.col("q")[1].alias("abs_p99")))


def _nonfinite(small_values: int):
    def run(t: Tables):
        v = F.when(F.col("event_id") % 50 == 0, float("inf")).when(F.col("event_id") % 50 == 1, float("-inf"))
        v = v.when(F.col("event_id") % 50 == 2, float("nan")).when(F.col("event_id") % 50 == 3, None).otherwise(F.col("value"))
        rows = t.read("events").select("event_type", v.alias("v"))
        q = quantiles.exact_quantiles(rows, "v", [0.0, 0.25, 0.5, 1.0], ["event_type"], small_values=small_values)
        names = ("lowest", "q25", "median", "highest")
        return q.select("event_type", "n", *[F.round(F.col("q")[k], 6).cast("string").alias(name) for k, name in enumerate(names)])

    return run


NONFINITE = """WITH e AS (SELECT event_type, CASE event_id % 50 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE value END AS v FROM events),
    q AS (SELECT event_type, count(v) AS n, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b FROM e WHERE v IS NOT NULL GROUP BY event_type)
    SELECT event_type, n, '-Infinity' AS lowest, round(a, 6)::VARCHAR AS q25, round(b, 6)::VARCHAR AS median, 'Infinity' AS highest FROM q"""
query("exact_quantiles_nonfinite", NONFINITE)(_nonfinite(10**6))
query("exact_quantiles_nonfinite_large", NONFINITE)(_nonfinite(0))


@query(
    "finite_audit",
    """WITH hurt AS (SELECT label, global_index, pos, CASE WHEN v > 0.4 THEN 'nan' WHEN v > 0.35 THEN 'pos'
        WHEN v < -0.4 THEN 'neg' END AS bad FROM elements)
    SELECT label, count(DISTINCT global_index) AS samples, coalesce(bool_and(bad IS NULL), false) AS all_finite,
      count(*) FILTER (bad = 'nan') AS nan_count, count(*) FILTER (bad = 'pos') AS pos_inf_count,
      count(*) FILTER (bad = 'neg') AS neg_inf_count FROM hurt GROUP BY label""",
    ("elements",),
)
def _(t: Tables):
    inf = float("inf")
    v = lambda x: x.cast("double")
    hurt = F.transform(
        "tensor",
        lambda x: F.when(v(x) > 0.4, F.lit(float("nan"))).when(v(x) > 0.35, F.lit(inf)).when(v(x) < -0.4, F.lit(-inf)).otherwise(v(x)),
    )
    return stats.finite_audit(t.latents.withColumn("tensor", hurt), ["label"])


NORM = """norm AS (SELECT channel, avg(v) AS m, greatest(sqrt(greatest(var_pop(v), 1e-12)), 1e-6) AS s FROM elements
    WHERE global_index IN (SELECT global_index FROM latents
      ORDER BY md5(concat_ws(':', 20260527, global_index)), global_index LIMIT 200) GROUP BY channel)"""


@query(
    "fit_normalizer",
    f"""WITH {NORM} SELECT CAST(channel AS INTEGER) AS channel, round(m, 6) AS mean, round(s, 6) AS std,
      CAST(200 AS BIGINT) AS num_samples FROM norm""",
    ("latents", "elements"),
)
def _(t: Tables):
    return rounded(transforms.fit_normalizer(t.views, SPEC, 200))


def _values(df: DataFrame) -> DataFrame:
    long = df.select("global_index", F.posexplode("tensor").alias("pos", "v"))
    return rounded(long.withColumn("pos", F.col("pos").cast("bigint")), 5)


@query(
    "normalize",
    f"""WITH {NORM} SELECT global_index, pos, round((v - m) / s * 1.5, 5) AS v FROM elements JOIN norm USING (channel)""",
    ("latents", "elements"),
)
def _(t: Tables):
    return _values(transforms.normalize(t.latents, SPEC, transforms.fit_normalizer(t.latents, SPEC, 200), 1.5))


@query(
    "denormalize",
    f"""WITH {NORM} SELECT global_index, pos, round((v * 0.5 + 0.25) * s + m, 5) AS v
    FROM elements JOIN norm USING (channel)""",
    ("latents", "elements"),
)
def _(t: Tables):
    return _values(transforms.denormalize(t.latents, SPEC, 0.5, 0.25, transforms.fit_normalizer(t.latents, SPEC, 200)))


def _space(prefix: str, x: str) -> str:
    return f"""round(avg({x}), 6) AS {prefix}_mean, round(stddev_pop({x}), 6) AS {prefix}_std,
      round(sqrt(avg({x} * {x})), 6) AS {prefix}_rms, round(min({x}), 6) AS {prefix}_min,
      round(max({x}), 6) AS {prefix}_max, round(max(abs({x})), 6) AS {prefix}_absmax"""


REF_STD, REF_RMS = transforms.REFERENCE_STD, transforms.REFERENCE_RMS


def _ratios(x: str, prefix: str) -> str:
    return f"""round(stddev_pop({x}) / {REF_STD}, 6) AS {prefix}_std_over_reference,
      round(sqrt(avg({x} * {x})) / {REF_RMS}, 6) AS {prefix}_rms_over_reference"""


@query(
    "affine_stats",
    f"SELECT {COUNTS}, {_space('sample_space', 'v')}, {_space('decode_space', '(v * -1.5 + 0.2)')} FROM elements",
    ("elements",),
)
def _(t: Tables):
    return rounded(transforms.affine_stats(stats.tensor_stats(t.latents, SPEC), -1.5, 0.2))


@query(
    "space_report",
    f"""WITH {NORM}, moved AS (SELECT global_index, v, (v * 0.5 + 0.25) * s + m AS y FROM elements JOIN norm USING (channel))
    SELECT {COUNTS}, {_space('sample_space', 'v')}, {_space('decode_space', 'y')}, {_ratios('v', 'sample_space')},
      {_ratios('y', 'decode_space')} FROM moved""",
    ("latents", "elements"),
)
def _(t: Tables):
    norm = transforms.fit_normalizer(t.latents, SPEC, 200)
    return rounded(transforms.space_report(t.latents, SPEC, 0.5, 0.25, norm))


SCALES = [0.35, 0.5, 1.0, 2.0, -1.0]


@query(
    "scale_sweep",
    f"""WITH scales AS (SELECT * FROM (VALUES (0.35::DOUBLE, 's0p35'), (0.5, 's0p5'), (1.0, 's1'), (2.0, 's2'), (-1.0, 'sm1')) x(scale, scale_slug)),
    moved AS (SELECT scale, scale_slug, global_index, v, v * scale + 0.1 AS y FROM elements, scales)
    SELECT scale, scale_slug, {COUNTS}, {_space('sample_space', 'v')}, {_space('decode_space', 'y')},
      {_ratios('v', 'sample_space')}, {_ratios('y', 'decode_space')}, 'ok' AS status
    FROM moved GROUP BY scale, scale_slug""",
    ("elements",),
)
def _(t: Tables):
    return rounded(transforms.scale_sweep(t.latents, SPEC, SCALES, 0.1))


@query(
    "best_scales",
    """WITH scales AS (SELECT unnest([0.35, 0.5, 1.0, 2.0, -1.0])::DOUBLE AS scale),
    m AS (SELECT scale, abs(stddev_pop(v * scale) - 0.2) AS fid, abs(max(v * scale) - 0.3) AS mmd2 FROM elements, scales GROUP BY scale)
    SELECT min_by(scale, fid) AS best_fid_scale, round(min(fid), 6) AS best_fid, min_by(scale, mmd2) AS best_mmd_scale,
      round(min(mmd2), 6) AS best_mmd2 FROM m""",
    ("elements",),
)
def _(t: Tables):
    def metric(decoded: DataFrame, scale: float) -> DataFrame:
        s = stats.tensor_stats(decoded, SPEC)
        return s.select(F.abs(F.col("std") - 0.2).alias("fid"), F.abs(F.col("max") - 0.3).alias("mmd2"))

    return rounded(transforms.best_scales(transforms.scale_sweep(t.latents, SPEC, SCALES, metric_fn=metric)))


@query(
    "match_scale", f"SELECT shard, round({REF_STD} / stddev_pop(v), 6) AS matched_scale FROM elements GROUP BY shard",
    ("elements",),
)
def _(t: Tables):
    by_shard = stats.tensor_stats(t.latents, SPEC, ["shard"])
    return rounded(transforms.match_scale(by_shard).select("shard", "matched_scale"))


def _pixel_rows(df: DataFrame) -> DataFrame:
    return df.select("global_index", F.posexplode("image").alias("pos", "p")).select(
        "global_index", F.col("pos").cast("bigint").alias("pos"), F.col("p").cast("bigint").alias("p")
    )


@query("quantize_u8", "SELECT global_index, pos, p FROM pixels", ("pixels",))
def _(t: Tables):
    return _pixel_rows(t.images)


@query(
    "quantize_u8_auto",
    """WITH spread AS (SELECT *, CASE WHEN label < 5 THEN v ELSE abs(v) END AS x FROM elements),
    span AS (SELECT label, min(x) >= -0.05 AND max(x) <= 1.05 AS unit FROM spread GROUP BY label)
    SELECT global_index, pos, CAST(CASE WHEN unit THEN round_even(greatest(0.0, least(1.0, x)) * 255.0, 0)
      ELSE round_even((greatest(-1.0, least(1.0, x)) + 1.0) * 127.5, 0) END AS BIGINT) AS p
    FROM spread JOIN span USING (label)""",
    ("elements",),
)
def _(t: Tables):
    spread = F.when(F.col("label") < 5, F.col("tensor")).otherwise(F.transform("tensor", lambda v: F.abs(v)))
    return _pixel_rows(transforms.quantize_u8(t.latents.withColumn("tensor", spread), "auto", ["label"]))


@query(
    "image_summary",
    """WITH one AS (SELECT label, channel, p / 255.0::DOUBLE AS u FROM pixels),
    per AS (SELECT label, channel, avg(u) AS m, stddev_pop(u) AS s FROM one GROUP BY ALL)
    SELECT label, count(*) AS count, round(min(u), 6) AS "min", round(max(u), 6) AS "max", round(avg(u), 6) AS mean,
      round(stddev_pop(u), 6) AS std,
      round(any_value((SELECT m FROM per WHERE per.label = one.label AND channel = 0)), 6) AS channel_mean_0,
      round(any_value((SELECT s FROM per WHERE per.label = one.label AND channel = 0)), 6) AS channel_std_0,
      round(any_value((SELECT m FROM per WHERE per.label = one.label AND channel = 1)), 6) AS channel_mean_1,
      round(any_value((SELECT s FROM per WHERE per.label = one.label AND channel = 1)), 6) AS channel_std_1,
      round(any_value((SELECT m FROM per WHERE per.label = one.label AND channel = 2)), 6) AS channel_mean_2,
      round(any_value((SELECT s FROM per WHERE per.label = one.label AND channel = 2)), 6) AS channel_std_2,
      round(any_value((SELECT m FROM per WHERE per.label = one.label AND channel = 3)), 6) AS channel_mean_3,
      round(any_value((SELECT s FROM per WHERE per.label = one.label AND channel = 3)), 6) AS channel_std_3
    FROM one GROUP BY label""",
    ("pixels",),
)
def _(t: Tables):
    return rounded(errors.image_summary(t.images, SPEC, ["label"]))


PAIRED = """recon AS (SELECT global_index, pos,
      CAST(round_even((greatest(-1.0, least(1.0, round(v, 1))) + 1.0) * 127.5, 0) AS BIGINT) AS r FROM elements),
    diff AS (SELECT global_index, pos, r - p AS d FROM pixels JOIN recon USING (global_index, pos))"""


@query(
    "pixel_error",
    f"""WITH {PAIRED},
    per AS (SELECT global_index, avg(d * d) / 65025.0 AS mse, avg(abs(d)) / 255.0 AS mae FROM diff GROUP BY global_index),
    tot AS (SELECT count(*) AS n, sum(d * d) / count(*) / 65025.0 AS mse, avg(abs(d)) / 255.0 AS mae, max(abs(d)) AS mx FROM diff)
    SELECT n AS count_values, round(any_value(tot.mse), 9) AS mse, round(any_value(tot.mae), 9) AS mae,
      CAST(any_value(mx) AS INTEGER) AS max_abs_uint8, count(*) AS image_count, round(avg(per.mse), 9) AS image_mse_mean,
      round(avg(per.mae), 9) AS image_mae_mean, round(avg(10 * log10(1 / per.mse)), 6) AS image_psnr_mean,
      round(sqrt(any_value(tot.mse)), 9) AS rmse, round(10 * log10(1 / any_value(tot.mse)), 6) AS psnr_global,
      round(quantile_cont(per.mse, 0.5), 9) AS image_mse_median, round(quantile_cont(per.mae, 0.5), 9) AS image_mae_median,
      round(quantile_cont(10 * log10(1 / per.mse), 0.5), 6) AS image_psnr_median FROM per, tot GROUP BY n""",
    ("pixels",),
)
def _(t: Tables):
    out = errors.pixel_error(errors.pair_images(t.images, t.recon_images(1)), SPEC)
    fine = [c for c in out.columns if "psnr" not in c]
    return rounded(rounded(out.select(*fine), 9).join(rounded(out.drop(*[c for c in fine if c != "image_count"])), "image_count"), 9)


@query(
    "image_errors",
    f"""WITH {PAIRED} SELECT global_index, count(*) AS n, CAST(sum(d * d) AS BIGINT) AS sq, CAST(sum(abs(d)) AS BIGINT) AS ab,
      CAST(max(abs(d)) AS INTEGER) AS mx FROM diff GROUP BY global_index""",
    ("pixels",),
)
def _(t: Tables):
    pairs = errors.pair_images(errors.array_to_bytes(t.images, SPEC), errors.array_to_bytes(t.recon_images(1), SPEC))
    return errors.image_errors(pairs, SPEC)


@query(
    "rel_error",
    """WITH p AS (SELECT label, v AS a, round(v, 1) AS b FROM elements)
    SELECT label, round(sqrt(sum(a * a)), 6) AS a_norm, round(sqrt(sum(b * b)), 6) AS b_norm,
      round(sqrt(sum((a - b) * (a - b))), 6) AS diff_norm, round(max(abs(a - b)), 6) AS max_abs,
      round(sqrt(sum((a - b) * (a - b))) / (sqrt(sum(a * a)) + 1e-12), 6) AS rel_error FROM p GROUP BY label""",
    ("elements",),
)
def _(t: Tables):
    pairs = t.latents.join(t.recon(1).select("global_index", F.col("tensor").alias("b")), "global_index")
    return rounded(errors.rel_error(pairs, "tensor", "b", ["label"]))


@query("random_projection")
def _(t: Tables):
    """Fixed Gaussian features of 1-channel 8x8-pixel images; checked against a NumPy twin in the tests."""
    spec = DatasetSpec(1, 8, 8)
    features = errors.random_projection(errors.array_to_bytes(t.images, spec), spec, dim=16, size=8)
    return features.select("global_index", F.posexplode("features").alias("dim", "value"))


#: The fixed draw of 16 rows (pixels) and 4 columns (features), as the operator makes it from its seed.
_DRAW = np.random.default_rng(20260527).normal(0.0, 1.0 / np.sqrt(16), size=(16, 4))


@query(
    "random_projection_resized",
    f"""WITH g AS (SELECT global_index, pos // 16 AS r, (pos % 8) // 2 AS c, (pos // 8) % 2 AS i, pos % 2 AS j, CAST(p AS FLOAT) / CAST(255 AS FLOAT) AS x FROM pixels),
    q AS (SELECT global_index, r, c, max(x) FILTER (i = 0 AND j = 0) * 0.5::FLOAT + max(x) FILTER (i = 0 AND j = 1) * 0.5::FLOAT AS upper,
      max(x) FILTER (i = 1 AND j = 0) * 0.5::FLOAT + max(x) FILTER (i = 1 AND j = 1) * 0.5::FLOAT AS lower FROM g GROUP BY ALL),
    s AS (SELECT global_index, r * 4 + c AS cell, CAST(upper * 0.5::FLOAT + lower * 0.5::FLOAT AS DOUBLE) AS x FROM q),
    w AS (SELECT * FROM (VALUES {", ".join(f"({i}, {j}, {float(_DRAW[i, j])!r}::DOUBLE)" for i in range(16) for j in range(4))}) v(cell, dim, w))
    SELECT global_index, CAST(dim AS INTEGER) AS dim, round(sum(x * w), 9) AS value FROM s JOIN w USING (cell) GROUP BY ALL""",
    ("pixels",),
)
def _(t: Tables):
    """8x8-pixel images halved to 4x4 before the projection: every target pixel is the mean of four."""
    spec = DatasetSpec(1, 8, 8)
    features = errors.random_projection(errors.array_to_bytes(t.images, spec), spec, dim=4, size=4)
    return rounded(features.select("global_index", F.posexplode("features").alias("dim", "value")), 9)
