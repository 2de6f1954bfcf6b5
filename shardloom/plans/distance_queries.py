"""Moments and distribution-distance queries: every sample against its rounded reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions.arrays import sq_distance
from shardloom.operators import distances, errors, linear_mmd, moments
from shardloom.plans.catalog import query, rounded
from shardloom.plans.stat_queries import PAIRED
from shardloom.plans.views import SPEC, Tables
from shardloom.sources.tables import feature_bank
from shardloom.spec import DatasetSpec

WIDE = """wide AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS x,
    [round(v::DOUBLE, 1) FOR v IN embedding] AS y FROM embeddings)"""


@query(
    "moments",
    """WITH e AS (SELECT global_index, pos, v FROM elements)
    SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, count(*) AS n, round(avg(a.v), 9) AS mu_i,
      round(covar_samp(a.v, b.v), 9) AS sigma_ij FROM e a JOIN e b USING (global_index) GROUP BY a.pos, b.pos""",
    ("elements",),
)
def _(t: Tables):
    return rounded(moments.moment_cells(moments.moments(t.features)), 9)


@query(
    "moments_by_label",
    """SELECT label, count(DISTINCT global_index) AS n, CAST(64 AS BIGINT) AS dims,
      round((SELECT sum(var) FROM (SELECT label AS l, pos, var_samp(v) AS var FROM elements GROUP BY ALL) WHERE l = e.label), 6) AS sigma_trace
    FROM elements e GROUP BY label""",
    ("elements",),
)
def _(t: Tables):
    return rounded(moments.trace_sigma(moments.moments(t.features, by=["label"]), ["label"]))


@query(
    "moment_summary",
    "SELECT label, round(avg(v), 6) AS feature_mean, round(stddev_pop(v), 6) AS feature_std FROM elements GROUP BY label",
    ("elements",),
)
def _(t: Tables):
    return rounded(moments.moment_summary(moments.moments(t.features, by=["label"]), ["label"]))


@query(
    "reference_stats",
    """SELECT count(*) AS count, CAST(pos AS INTEGER) AS i, round(avg(v), 9) AS mu, round(var_samp(v), 9) AS variance
    FROM elements GROUP BY pos""",
    ("elements",),
)
def _(t: Tables):
    """Moments written as a published table, read back, in the packed one-row form."""
    from shardloom.session import scratch_dir

    path = scratch_dir(t.spark, "reference")
    moments.write_reference_stats(t.features, path)
    packed = moments.packed_moments(moments.load_reference_stats(t.spark, path))
    diagonal = packed.select("count", F.posexplode("mu").alias("i", "mu"), "sigma").select(
        "count", "i", "mu", F.get(F.get("sigma", F.col("i")), F.col("i")).alias("variance")
    )
    return rounded(diagonal, 9)


@query("frechet")
def _(t: Tables):
    return distances.frechet(moments.moments(t.recon_features(1)), moments.moments(t.features))


@query("frechet_by_label")
def _(t: Tables):
    gen = moments.moments(t.recon_features(1), by=["label"])
    return distances.frechet(gen, moments.moments(t.features, by=["label"]), ["label"])


def _stretched(t: Tables):
    """Features 1.5 x + 0.25, whose distance to x has a closed form: |mean gap|^2 + (1.5 - 1)^2 tr(cov)."""
    return t.features.withColumn("features", F.transform("features", lambda v: v.cast("double") * 1.5 + 0.25))


STRETCHED = """WITH m AS (SELECT {by} pos, avg(v) AS mu, var_samp(v) AS s, count(*) AS n FROM elements GROUP BY {by} pos)
    SELECT {by} any_value(n) AS n1, any_value(n) AS n2, 64 AS dims, round(sum(pow(0.5 * mu + 0.25, 2)) + 0.25 * sum(s), 4) AS fid FROM m {group}"""


@query("frechet_stretched", STRETCHED.format(by="", group=""), ("elements",))
def _(t: Tables):
    return rounded(distances.frechet(moments.moments(_stretched(t)), moments.moments(t.features)), 4)


@query("frechet_stretched_by_label", STRETCHED.format(by="label,", group="GROUP BY label"), ("elements",))
def _(t: Tables):
    one, two = (moments.moments(f, by=["label"]) for f in (_stretched(t), t.features))
    return rounded(distances.frechet(one, two, ["label"]), 4)


@query("frechet_regularized")
def _(t: Tables):
    gen = moments.moments(t.recon_features(1), strict=False)
    return distances.frechet_regularized(gen, moments.moments(t.features, strict=False))


@query(
    "frechet_regularized_stretched",
    """WITH m AS (SELECT pos, avg(v) AS mu, var_samp(v) AS s, count(*) AS n FROM elements GROUP BY pos)
    SELECT any_value(n) AS n1, any_value(n) AS n2, 64 AS dims, round(sum(pow(0.5 * mu + 0.25, 2)) + 0.25 * sum(s) - count(*) * 1e-6::DOUBLE / 6, 6) AS fid_reg FROM m""",
    ("elements",),
)
def _(t: Tables):
    """A stretch by 1.5 leaves (sqrt(2.25 s + eps) - sqrt(s + eps))^2 per eigenvalue s, which is s / 4 - eps / 6 up to eps^2."""
    return rounded(distances.frechet_regularized(moments.moments(_stretched(t)), moments.moments(t.features)))


@query(
    "frechet_regularized_mirrored",
    """WITH m AS (SELECT label, pos, avg(v) AS mu, count(*) AS n FROM elements GROUP BY label, pos)
    SELECT label, any_value(n) AS n1, any_value(n) AS n2, 64 AS dims, round(sum(pow(2 * mu - 0.25, 2)), 6) AS fid_reg FROM m GROUP BY label HAVING any_value(n) > 0""",
    ("elements",),
)
def _(t: Tables):
    """Features 0.25 - x have the covariance of x, so the distance is that of the means."""
    mirrored = t.features.withColumn("features", F.transform("features", lambda v: F.lit(0.25) - v.cast("double")))
    one, two = (moments.moments(f, by=["label"], strict=False) for f in (mirrored, t.features))
    return rounded(distances.frechet_regularized(one, two, ["label"]))


KID_SQL = f"""WITH {WIDE}, k AS (SELECT a.id AS p, b.id AS q, pow(list_dot_product(a.x, b.x) / 64 + 1, 3) AS xx,
      pow(list_dot_product(a.y, b.y) / 64 + 1, 3) AS yy, pow(list_dot_product(a.x, b.y) / 64 + 1, 3) AS xy
    FROM wide a CROSS JOIN wide b), n AS (SELECT count(*) AS n FROM wide),
    e AS (SELECT sum(xx) FILTER (p <> q) / any_value(n * (n - 1)) + sum(yy) FILTER (p <> q) / any_value(n * (n - 1))
      - 2 * sum(xy) / any_value(n * n) AS v, any_value(n) AS n FROM k, n)
    SELECT n, n AS m, round(v, 9) AS mmd2, round(v, 9) AS kid, round(v * 1000, 6) AS kid_x1000 FROM e"""


def _kid(df):
    return df.select(
        "n", "m", F.round("mmd2", 9).alias("mmd2"), F.round("kid", 9).alias("kid"), F.round("kid_x1000", 6).alias("kid_x1000")
    )


@query("kid_poly3", KID_SQL)
def _(t: Tables):
    return _kid(distances.kid_poly3(t.features, t.recon_features(1)))


@query("kid_poly3_blocks", KID_SQL)
def _(t: Tables):
    """The block form used for wide features."""
    return _kid(distances.kid_poly3(t.features, t.recon_features(1), method="blocks"))


@query(
    "mmd_rbf",
    f"""WITH {WIDE}, z AS (SELECT id, 0 AS side, x AS f FROM wide UNION ALL SELECT id, 1, y FROM wide),
    s AS (SELECT *, list_dot_product(f, f) AS nn FROM z),
    d AS (SELECT a.side AS sa, b.side AS sb, a.id AS ia, b.id AS ib,
      greatest(a.nn + b.nn - 2 * list_dot_product(a.f, b.f), 0) AS d2 FROM s a CROSS JOIN s b),
    w AS (SELECT quantile_cont(d2, 0.5) AS b2 FROM d WHERE d2 > 0 AND (sa < sb OR (sa = sb AND ia < ib))),
    n AS (SELECT count(*) AS n FROM wide),
    e AS (SELECT sum(exp(-d2 / (2 * b2))) FILTER (sa = sb AND ia <> ib) / any_value(n * (n - 1))
      - 2 * sum(exp(-d2 / (2 * b2))) FILTER (sa < sb) / any_value(n * n) AS v, any_value(b2) AS b2, any_value(n) AS n FROM d, w, n)
    SELECT n, n AS m, round(v, 9) AS mmd2, round(b2, 6) AS bandwidth2 FROM e""",
)
def _(t: Tables):
    out = distances.mmd_rbf(t.features, t.recon_features(1))
    return out.select("n", "m", F.round("mmd2", 9).alias("mmd2"), F.round("bandwidth2", 6).alias("bandwidth2"))


@query(
    "sq_distances",
    f"""WITH {WIDE} SELECT id AS global_index,
      round(greatest(list_dot_product(x, x) + list_dot_product(y, y) - 2 * list_dot_product(x, y), 0), 6) AS d2 FROM wide""",
)
def _(t: Tables):
    """Squared distance of every sample to its own reconstruction; all pairs stay inside ``mmd_rbf``."""
    pairs = t.features.join(t.recon_features(1).select("global_index", F.col("features").alias("y")), "global_index")
    return rounded(pairs.select("global_index", sq_distance(F.col("features"), F.col("y")).alias("d2")))


@query(
    "feature_bank",
    """SELECT global_index, label, CASE WHEN (SELECT count(*) FROM latents) > 400 THEN CAST(400 AS BIGINT) END AS truncated_to_max_ref
    FROM latents WHERE global_index < 400""",
    ("latents",),
)
def _(t: Tables):
    return feature_bank(t.features, 400).select("global_index", "label", "truncated_to_max_ref")


@query("compare_features")
def _(t: Tables):
    return distances.compare_features(t.recon_features(1), moments.moments(t.features), feature_bank(t.features))


@query("compare_features_without_bank")
def _(t: Tables):
    return distances.compare_features(t.recon_features(1), moments.moments(t.features))


@query("reconstruction_report")
def _(t: Tables):
    recons = {"one_decimal": t.recon_features(1), "two_decimals": t.recon_features(2)}
    return distances.reconstruction_report(t.features, recons, moments.moments(t.features), feature_bank(t.features))


@query(
    "compare_backends",
    f"""WITH {PAIRED}, one AS (SELECT avg(d * d) / 65025.0 AS v FROM diff),
    fine AS (SELECT avg(pow(CAST(round_even((greatest(-1.0, least(1.0, round(v, 2))) + 1.0) * 127.5, 0) AS BIGINT) - p, 2)) / 65025.0 AS v
      FROM elements JOIN pixels USING (global_index, pos))
    SELECT round(fine.v, 9) AS base_value, round(one.v, 9) AS other_value, round(one.v / fine.v, 3) AS ratio,
      round(one.v - fine.v, 9) AS delta,
      CASE WHEN one.v / fine.v >= 2 AND one.v - fine.v >= 0.00001 THEN 'much_worse' ELSE 'not_much_worse' END AS label
    FROM one, fine""",
    ("elements", "pixels"),
)
def _(t: Tables):
    """The two-threshold comparison, on the pixel error of two reconstructions."""
    named = t.recon_images(1).withColumn("name", F.lit("one")).unionByName(
        t.recon_images(2).withColumn("name", F.lit("two"))
    )
    per = errors.pixel_error(errors.pair_images(t.images, named), SPEC, ["name"])
    out = distances.compare_backends(per, "two", "one", 2.0, 0.00001, "mse")
    return out.select(
        F.round("base_value", 9).alias("base_value"), F.round("other_value", 9).alias("other_value"),
        F.round("ratio", 3).alias("ratio"), F.round("delta", 9).alias("delta"), "label",
    )


@query("compact_metrics")
def _(t: Tables):
    return distances.compact_metrics(t.recon_images(1), t.images, DatasetSpec(1, 8, 8), dim=16, size=8)


def _moved(name: str, a: float, b: float) -> str:
    """CTEs of a record on the features a x + b against x: sizes, distance, spread and KID."""
    return f"""{name}_f AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, [v::DOUBLE * {a} + {b} FOR v IN embedding] AS y FROM embeddings),
    {name}_n AS (SELECT count(*) AS n FROM {name}_f),
    {name}_k AS (SELECT sum(pow(list_dot_product(a.x, b.x) / 64 + 1, 3)) FILTER (a.id <> b.id) / any_value(n * (n - 1))
      + sum(pow(list_dot_product(a.y, b.y) / 64 + 1, 3)) FILTER (a.id <> b.id) / any_value(n * (n - 1))
      - 2 * sum(pow(list_dot_product(a.x, b.y) / 64 + 1, 3)) / any_value(n * n) AS kid FROM {name}_f a CROSS JOIN {name}_f b CROSS JOIN {name}_n),
    {name}_m AS (SELECT pos, avg(v) AS mu, var_samp(v) AS s FROM elements GROUP BY pos),
    {name} AS (SELECT n, sum(pow(({a} - 1) * mu + {b}, 2)) + pow({a} - 1, 2) * sum(s) AS fid, pow({a}, 2) * sum(s) AS tr, any_value(kid) AS kid,
      (SELECT avg({a} * v + {b}) FROM elements) AS mean, (SELECT stddev_pop({a} * v + {b}) FROM elements) AS std FROM {name}_m, {name}_k, {name}_n GROUP BY n)"""


_RECORD = """n AS num_images, n AS ref_count, 64 AS dims, round(fid, 4) AS fid, round(mean, 4) AS feature_mean, round(std, 4) AS feature_std,
      round(tr, 4) AS sigma_trace"""


@query(
    "compare_features_stretched",
    f"""WITH {_moved("w", 1.5, 0.25)} SELECT {_RECORD}, n AS ref_features_used, round(kid, 4) AS mmd2, round(kid, 4) AS kid,
      round(kid * 1000, 4) AS kid_x1000, 'ok' AS mmd_status, 'ok' AS status FROM w""",
    ("elements",),
)
def _(t: Tables):
    return rounded(distances.compare_features(_stretched(t), moments.moments(t.features), feature_bank(t.features)), 4)


@query(
    "compare_features_stretched_without_bank",
    f"""WITH {_moved("w", 1.5, 0.25)} SELECT {_RECORD}, NULL::BIGINT AS ref_features_used, NULL::DOUBLE AS mmd2, NULL::DOUBLE AS kid,
      NULL::DOUBLE AS kid_x1000, 'skipped_no_ref_features' AS mmd_status, 'ok' AS status FROM w""",
    ("elements",),
)
def _(t: Tables):
    return rounded(distances.compare_features(_stretched(t), moments.moments(t.features)), 4)


_REPORT = """SELECT '{0}' AS name, n AS num_images, 64 AS dims, round(fid, 4) AS rfid_vs_original, round(mean, 4) AS feature_mean,
    round(std, 4) AS feature_std, round(tr, 4) AS sigma_trace, round(fid, 4) AS fid_vs_full_ref, round(kid, 4) AS mmd2_vs_original,
    round(kid * 1000, 4) AS kid_x1000_vs_original, round(kid, 4) AS mmd2_vs_full_ref_bank, round(kid * 1000, 4) AS kid_x1000_vs_full_ref_bank,
    false AS mmd_skipped, NULL::VARCHAR AS mmd_skip_reason FROM {0}"""


@query(
    "reconstruction_report_stretched",
    f"""WITH {_moved("wide", 1.5, 0.25)}, {_moved("flat", 0.5, -0.125)} {_REPORT.format("wide")} UNION ALL {_REPORT.format("flat")}""",
    ("elements",),
)
def _(t: Tables):
    """Two reconstructions whose covariances are multiples of the originals', so every column has a closed form."""
    flat = t.features.withColumn("features", F.transform("features", lambda v: v.cast("double") * 0.5 - 0.125))
    recons = {"wide": _stretched(t), "flat": flat}
    return rounded(distances.reconstruction_report(t.features, recons, moments.moments(t.features), feature_bank(t.features)), 4)


@query(
    "mmd_rbf_linear",
    """WITH f AS (SELECT vec_id AS id, vec_id % 5 AS blk, CAST(embedding AS DOUBLE[]) AS x, [v::DOUBLE * 1.5 + 0.25 FOR v IN embedding] AS y FROM embeddings),
    z AS (SELECT id, blk, 0 AS side, x AS f FROM f UNION ALL SELECT id, blk, 1, y FROM f),
    h AS (SELECT 2 * sum(s) AS h FROM (SELECT var_samp(v) AS s FROM (SELECT pos, v FROM elements UNION ALL SELECT pos, v * 1.5 + 0.25 FROM elements) GROUP BY pos)),
    n AS (SELECT blk, count(*) AS n FROM f GROUP BY blk),
    k AS (SELECT a.blk, a.side AS sa, b.side AS sb, a.id <> b.id AS other, exp(-pow(list_distance(a.f, b.f), 2) / (2 * h)) AS k
      FROM z a JOIN z b ON a.blk = b.blk AND a.side <= b.side CROSS JOIN h),
    e AS (SELECT blk, sum(k) FILTER (sa = sb AND other) / any_value(n * (n - 1)) - 2 * sum(k) FILTER (sa < sb) / any_value(n * n) AS v FROM k JOIN n USING (blk) GROUP BY blk)
    SELECT (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM f) AS m, count(v) AS blocks, round(avg(v), 9) AS mmd2,
      round(stddev_samp(v) / sqrt(count(v)), 9) AS std_error, round((SELECT h FROM h), 9) AS bandwidth2, CAST(0 AS BIGINT) AS unused_rows FROM e""",
    ("elements",),
)
def _(t: Tables):
    """Five blocks by index: every sample against its stretched form within a block."""
    return rounded(linear_mmd.mmd_rbf_linear(t.features, _stretched(t), block=F.col("global_index") % 5), 9)
