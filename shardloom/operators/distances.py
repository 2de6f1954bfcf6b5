"""Distances between two feature distributions: Fréchet, polynomial-kernel and RBF-kernel MMD."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.functions.batches import extended_schema, list_column, matrix
from shardloom.functions.joins import with_row
from shardloom.operators.errors import random_projection
from shardloom.operators import rbf_series
from shardloom.operators.block_pairs import kernel_sums, median_sq_distance, pack_blocks, pair_up, rbf_kernel, side_counts
from shardloom.operators.moments import (
    feature_width, moment_summary, moments, trace_sigma, vector_sums,
)
from shardloom.operators.validation import match_pairs
from shardloom.session import materialize, require
from shardloom.spec import DatasetSpec

# Up to this width the cubic kernel is summed through third moments: linear in the number of rows.
MOMENT_KERNEL_WIDTH = 192
_CHUNK = 65_536


# ---- Fréchet ----------------------------------------------------------------------------------------------

def _factor(cov: np.ndarray) -> np.ndarray:
    """F with F F^T = cov: scaled eigenvectors; small negative eigenvalues count as 0."""
    scale, axes = np.linalg.eigh(cov)
    return axes * np.sqrt(np.maximum(scale, 0.0))


def _nuclear_cross(left: np.ndarray, right: np.ndarray) -> float:
    """tr (A B)^(1/2) for A = left left^T and B = right right^T: the sum of the singular values of left^T right."""
    cross = left.T @ right
    return float(np.linalg.svd(cross, compute_uv=False).sum()) if np.isfinite(cross).all() else float("nan")


def _trace_sqrt_product(s1: np.ndarray, s2: np.ndarray) -> float:
    return _nuclear_cross(_factor(s1), _factor(s2))


def _unpack(side: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    side = side.sort_values("i")
    d = len(side)
    mu = side["mu"].to_numpy(dtype=np.float64)
    rows = [np.full(d, np.nan) if r is None else np.asarray(r, dtype=np.float64) for r in side["sigma"]]
    return int(side["n"].iloc[0]), mu, np.stack(rows)


def _pairwise(m1: DataFrame, m2: DataFrame, by: Sequence[str], fn, out: str) -> DataFrame:
    """Apply ``fn(n1, mu1, S1, n2, mu2, S2)`` per group. A group holds two d x d matrices, whatever the data size.

    A second side without the group columns is one common reference: its single d x d matrix goes to every task.
    """
    by = list(by)
    columns = ["i", "n", "mu", "sigma"]
    schema = extended_schema(
        m1.select(*by).schema, f"n1 bigint, n2 bigint, dims int, {out} double"
    )
    names = [f.name for f in schema.fields]
    common = bool(by) and not any(c in m2.columns for c in by)
    reference = m1.sparkSession.sparkContext.broadcast(_unpack(m2.select(*columns).toPandas())) if common else None

    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf["__side"] == 1], pdf[pdf["__side"] == 2]
        if one.empty or (two.empty and not common):
            return pd.DataFrame(columns=names)
        n1, mu1, s1 = _unpack(one)
        n2, mu2, s2 = reference.value if common else _unpack(two)
        if mu1.shape != mu2.shape:
            raise ValueError(f"feature widths differ: {len(mu1)} and {len(mu2)}")
        value = fn(n1, mu1, s1, n2, mu2, s2)
        return pd.DataFrame([[*key[: len(by)], n1, n2, len(mu1), value]], columns=names)

    tagged = m1.select(*by, F.lit(1).alias("__side"), *columns)
    if not common:
        tagged = tagged.unionByName(m2.select(*by, F.lit(2).alias("__side"), *columns))
    return tagged.withColumn("__one", F.lit(1)).groupBy(*by, "__one").applyInPandas(step, schema)


def frechet(m1: DataFrame, m2: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``n1, n2, dims, fid`` per group from two moment tables; clamped at 0.

    ``m2`` may lack the group columns: it is then the common reference.
    """
    def value(n1, mu1, s1, n2, mu2, s2):
        diff = mu1 - mu2
        return max(float(diff @ diff + np.trace(s1) + np.trace(s2) - 2.0 * _trace_sqrt_product(s1, s2)), 0.0)

    return _pairwise(m1, m2, by, value, "fid")


def frechet_low_rank(features: DataFrame, m2: DataFrame, column: str = "features") -> DataFrame:
    """Exact Fréchet distance for fewer samples than features, from an n x n Gram matrix.

    Only for n < d, so the rows that meet in the one small task are bounded by d x d values.
    """
    width = feature_width(features, column)
    n = features.count()
    require(2 <= n < width, f"the low-rank form needs 2 <= n < {width}, got {n}")
    x = features.select(
        F.lit(1).alias("__side"), F.lit(-1).alias("i"), F.lit(n).cast("bigint").alias("n"), F.lit(0.0).alias("mu"),
        F.col(column).cast("array<double>").alias("sigma"),
    )
    both = x.unionByName(m2.select(F.lit(2).alias("__side"), "i", "n", "mu", "sigma"))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        samples = np.array(pdf.loc[pdf["__side"] == 1, "sigma"].tolist(), dtype=np.float64)
        n2, mu2, s2 = _unpack(pdf[pdf["__side"] == 2])
        centre = samples.mean(axis=0)
        # the scaled deviations are a factor of the sample covariance with only n columns
        factor = (samples - centre).T / np.sqrt(len(samples) - 1)
        parts = [np.square(centre - mu2).sum(), np.square(factor).sum(), np.trace(s2), -2.0 * _nuclear_cross(factor, _factor(s2))]
        return pd.DataFrame({"n1": [len(samples)], "n2": [n2], "dims": [len(mu2)], "fid": [max(float(sum(parts)), 0.0)]})

    return both.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(
        step, "n1 bigint, n2 bigint, dims int, fid double"
    )


def frechet_regularized(m1: DataFrame, m2: DataFrame, by: Sequence[str] = (), eps: float = 1e-6) -> DataFrame:
    """``fid_reg``: eps on both diagonals, not clamped; a single sample counts as covariance 1e-6 I.

    Build the moments with ``strict=False`` when a side may hold one row.
    """
    def value(n1, mu1, s1, n2, mu2, s2):
        eye = np.eye(len(mu1))
        a, b = [(1e-6 * eye if n <= 1 else s) + eps * eye for n, s in ((n1, s1), (n2, s2))]
        cross = _trace_sqrt_product(a, b)
        if not np.isfinite(cross):
            cross = _trace_sqrt_product(a + 10 * eps * eye, b + 10 * eps * eye)
        diff = mu1 - mu2
        return float(diff @ diff + np.trace(a) + np.trace(b) - 2.0 * cross)

    return _pairwise(m1, m2, by, value, "fid_reg")


# ---- polynomial kernel ------------------------------------------------------------------------------------

def kid_poly3(
    x: DataFrame, y: DataFrame, features: str = "features", index: str = "global_index", block: int | None = None,
    method: str | None = None,
) -> DataFrame:
    """Unbiased MMD² with k(x,y) = (x·y/d + 1)³: ``n, m, mmd2, kid, kid_x1000``; may be negative.

    Narrow features go through third moments (``method='moments'``): Σ(x·y)³ over all pairs is the inner
    product of the two sums of x⊗x⊗x, so the cost is linear in the rows and no pair is ever formed. Wide
    features use blocks of rows (``method='blocks'``), one number per pair of blocks. With so many rows that their pairs
    take more products than third moments that fit a task, those give the same sums, unless ``block`` is given.
    """
    width = feature_width(x, features)
    require(width == feature_width(y, features), "feature widths differ")
    method = method or ("moments" if width <= MOMENT_KERNEL_WIDTH else "blocks")
    if method == "blocks" and block is None and width <= MOMENT_KERNEL_WIDTH:
        # (n + m)^2 / 2 pairs of width products each, or (n + m) cubes of width^3 / 2
        method = "blocks" if x.count() + y.count() <= width**2 else "moments"
    if method == "moments":
        def own(rows):
            return (np.einsum("ij,ij->i", rows, rows) / width + 1.0) ** 3 - 1.0

        # of (x·y/d + 1)^3; the constant 1 cancels in the estimate, so it is left out of all three sums
        factors = [3.0 / width, 3.0 / width**2, 1.0 / width**3]
        sums = _kernel_sums_by_moments(x, y, features, width, factors, np.ones(width), lambda rows: matrix(rows, width), own)
    else:
        def kernel(a, b):
            k = a @ b.T
            k /= width
            k += 1.0
            cube = k * k
            cube *= k
            return cube

        blocks = pack_blocks(x, y, features, index, width, block)
        sums = kernel_sums(blocks, pair_up(blocks), kernel, width)
    return _mmd_row(sums).withColumn("kid", F.col("mmd2")).withColumn("kid_x1000", F.col("mmd2") * 1000.0)


def _mmd_row(sums: DataFrame) -> DataFrame:
    """One row with n, m, xx, yy, xy (kernel sums, diagonals left out of xx and yy) to the estimate."""
    def within(s, n):
        return F.col(s) / (F.col(n) * (F.col(n) - 1.0))

    enough = (F.col("n") >= 2) & (F.col("m") >= 2)
    value = within("xx", "n") + within("yy", "m") - 2.0 * F.col("xy") / (F.col("n") * F.col("m").cast("double"))
    return sums.select(
        "n", "m",
        F.when(enough, value)
        .otherwise(F.raise_error(F.lit("both sides need at least two samples")).cast("double")).alias("mmd2"),
    )


def _power_sums(df: DataFrame, features: str, width: int, side: str, lift, own) -> DataFrame:
    """``(side, chunk, v)``: Σ1, Σ ``own``(x), Σx, Σx⊗x, Σx⊗x⊗x (i<=j only) of rows x = ``lift``(row), laid out in chunks, one set
    per task.
    """
    upper_i, upper_j = np.triu_indices(width)

    def fold(batches):
        low = np.zeros(2 + width + width * width)
        cube = np.zeros((len(upper_i), width))
        for batch in batches:
            rows = batch.column(0)
            for at in range(0, len(rows), 512):
                x = lift(rows.slice(at, 512))
                low += np.concatenate([[len(x), own(x).sum()], x.sum(axis=0), (x.T @ x).reshape(-1)])
                cube += (x[:, upper_i] * x[:, upper_j]).T @ x
        if low[0]:
            flat = np.concatenate([low, cube.reshape(-1)])
            for chunk, at in enumerate(range(0, len(flat), _CHUNK)):
                part = flat[at : at + _CHUNK]
                yield pa.RecordBatch.from_pydict(
                    {"side": [side], "chunk": pa.array([chunk], pa.int32()), "v": list_column(part[None, :], pa.float64())}
                )

    return df.select(features).mapInArrow(fold, "side string, chunk int, v array<double>")


def _kernel_sums_by_moments(
    x: DataFrame, y: DataFrame, features: str, width: int, factors: Sequence[float], signs: np.ndarray, lift, own
) -> DataFrame:
    """``n, m, xx, yy, xy`` of Σ factors[k] p^k, k = 1 to 3, with p = Σ signs·a·b of lifted rows, and ``own`` that of a row itself."""
    parts = _power_sums(x, features, width, "x", lift, own).unionByName(_power_sums(y, features, width, "y", lift, own))
    sums = vector_sums(parts, ["side", "chunk"], "v")
    upper_i, upper_j = np.triu_indices(width)
    # weights of each stored sum; i<j cells stand for two
    twice = np.where(upper_i == upper_j, 1.0, 2.0) * signs[upper_i] * signs[upper_j]
    weights = np.concatenate(
        [[0.0, 0.0], factors[0] * signs, factors[1] * np.outer(signs, signs).reshape(-1), factors[2] * np.outer(twice, signs).reshape(-1)]
    )
    shared = x.sparkSession.sparkContext.broadcast(weights)

    def contract(table: pa.Table) -> pa.Table:
        sides = dict(zip(table.column("side").to_pylist(), range(len(table))))
        column = table.column("v").combine_chunks()
        vectors = matrix(column, len(column[0]))
        chunk = table.column("chunk")[0].as_py()
        w = shared.value[chunk * _CHUNK : chunk * _CHUNK + vectors.shape[1]]
        vx, vy = (vectors[sides[s]] if s in sides else np.zeros(vectors.shape[1]) for s in "xy")
        head = chunk == 0
        return pa.table(
            {
                "n": [int(vx[0]) if head else 0], "m": [int(vy[0]) if head else 0],
                "xx": [float(vx * w @ vx) - (vx[1] if head else 0.0)],
                "yy": [float(vy * w @ vy) - (vy[1] if head else 0.0)], "xy": [float(vx * w @ vy)],
            }
        )

    per_chunk = sums.groupBy("chunk").applyInArrow(contract, "n bigint, m bigint, xx double, yy double, xy double")
    return per_chunk.agg(*[F.sum(c).alias(c) for c in ("n", "m", "xx", "yy", "xy")])


# ---- RBF kernel ---------------------------------------------------------------------------------------------

def mmd_rbf(
    x: DataFrame, y: DataFrame, features: str = "features", index: str = "global_index", block: int | None = None
) -> DataFrame:
    """Unbiased MMD² with k = exp(-d²/2b²); b² is the exact median of positive squared distances over x ∪ y.

    Many rows meet once, in single precision where that does not show in the result (``rbf_series``).
    """
    width = feature_width(x, features)
    blocks = pack_blocks(x, y, features, index, width, block)
    pairs = pair_up(blocks)
    rows = side_counts(blocks).first()
    sizes = {"xx": rows["n"] * (rows["n"] - 1) // 2, "yy": rows["m"] * (rows["m"] - 1) // 2, "xy": rows["n"] * rows["m"]}
    met = None
    if sum(sizes.values()) >= rbf_series.MANY_PAIRS:
        met = rbf_series.all_pairs(blocks, pairs, width, sizes, MOMENT_KERNEL_WIDTH - 2)
    bandwidth2 = met.median if met else median_sq_distance(pairs, width, blocks)
    if met and met.powers:
        sums = _rbf_sums(x, y, features, width, met)
    else:
        sums = kernel_sums(blocks, pairs, rbf_kernel(bandwidth2), width)
    return _mmd_row(sums).withColumn("bandwidth2", F.lit(bandwidth2))


def _rbf_sums(x: DataFrame, y: DataFrame, features: str, width: int, met: rbf_series.Found) -> DataFrame:
    """Kernel sums from the powers of g met over all pairs and, for the first three, third moments of (z, h + 1, h - 1):

    g = h_a + h_b - 2 z_a·z_b, and h_a + h_b = ((h_a + 1)(h_b + 1) - (h_a - 1)(h_b - 1)) / 2.
    """
    factors, frame = met.factors(), met.frame

    def lift(rows):
        z, h = frame.moved(matrix(rows, width))
        return np.column_stack([z, h + 1.0, h - 1.0])

    signs = np.concatenate([np.full(width, -2.0), [0.5, -0.5]])
    alone = sum(f * (-1.0) ** k for k, f in enumerate(factors[1:4], 1))  # of a row itself g is -1
    low = _kernel_sums_by_moments(x, y, features, width + 2, factors[1:4], signs, lift, lambda rows: np.full(len(rows), alone))
    # the constant is left out: it cancels in the estimate
    rest = {s: float(factors[4:] @ sums[4:]) * (1.0 if s == "xy" else 2.0) for s, sums in met.powers.items()}
    return low.select("n", "m", *[(F.lit(met.scale()) * (F.col(s) + F.lit(v))).alias(s) for s, v in rest.items()])


# ---- reports ----------------------------------------------------------------------------------------------

def compare_features(
    gen: DataFrame, ref_moments: DataFrame, ref_bank: DataFrame | None = None, features: str = "features",
    index: str = "global_index",
) -> DataFrame:
    """One record: sizes, fid, feature mean/std, trace, and KID when a reference bank is given."""
    mom = materialize(moments(gen, features), "moments")
    parts = [
        frechet(mom, ref_moments).select("n1", "n2", "dims", "fid"),
        moment_summary(mom),
        trace_sigma(mom).select("sigma_trace"),
    ]
    if ref_bank is not None:
        kid = kid_poly3(gen, ref_bank, features, index)
        parts.append(kid.select(F.col("m").alias("ref_features_used"), "mmd2", "kid", "kid_x1000", F.lit("ok").alias("mmd_status")))
    row = _side_by_side(parts).withColumnRenamed("n1", "num_images").withColumnRenamed("n2", "ref_count")
    if ref_bank is None:
        none = F.lit(None).cast("double")
        row = row.select(
            "*", F.lit(None).cast("bigint").alias("ref_features_used"), none.alias("mmd2"), none.alias("kid"),
            none.alias("kid_x1000"), F.lit("skipped_no_ref_features").alias("mmd_status"),
        )
    return row.withColumn("status", F.lit("ok"))


def _side_by_side(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = with_row(out, p)
    return out


SKIP_REASON = "mmd_not_requested"


def reconstruction_report(
    original: DataFrame, recons: Mapping[str, DataFrame], full_ref: DataFrame | None = None,
    bank: DataFrame | None = None, skip_mmd: bool = False, features: str = "features", index: str = "global_index",
) -> DataFrame:
    """One row per reconstruction: distance to the same N originals, to a full reference, and KID."""
    require(bool(recons), "at least one reconstruction is required")
    tagged = None
    for name, df in recons.items():
        paired = match_pairs(original, df, index).first()
        require(paired["only_left"] == 0 and paired["only_right"] == 0, f"{name}: not the same samples as the original")
        rows = df.select(F.lit(name).alias("name"), index, features)
        tagged = rows if tagged is None else tagged.unionByName(rows)
    mom = materialize(moments(tagged, features, ["name"]), "moments")
    origin = materialize(moments(original, features), "moments")
    out = frechet(mom, origin, ["name"]).select(
        "name", F.col("n1").alias("num_images"), "dims", F.col("fid").alias("rfid_vs_original")
    )
    out = out.join(moment_summary(mom, ["name"]), "name").join(
        trace_sigma(mom, ["name"]).select("name", "sigma_trace"), "name"
    )
    if full_ref is not None:
        out = out.join(frechet(mom, full_ref, ["name"]).select("name", F.col("fid").alias("fid_vs_full_ref")), "name")
    if not skip_mmd:
        targets = {"original": original} | ({"full_ref_bank": bank} if bank is not None else {})
        for label, target in targets.items():
            kids = None
            for name, df in recons.items():
                k = kid_poly3(df, target, features, index).select(
                    F.lit(name).alias("name"), F.col("mmd2").alias(f"mmd2_vs_{label}"),
                    F.col("kid_x1000").alias(f"kid_x1000_vs_{label}"),
                )
                kids = k if kids is None else kids.unionByName(k)
            out = out.join(kids, "name")
    reason = F.lit(SKIP_REASON if skip_mmd else None).cast("string")
    if skip_mmd:
        out = out.withColumn("mmd2_vs_original", F.lit(None).cast("double")).withColumn(
            "kid_x1000_vs_original", F.lit(None).cast("double")
        )
    return out.withColumn("mmd_skipped", F.lit(skip_mmd)).withColumn("mmd_skip_reason", reason)


def compare_backends(
    report: DataFrame, base: str, other: str, ratio: float = 2.0, delta: float = 1.0, metric: str = "rfid_vs_original"
) -> DataFrame:
    """Ratio and difference of ``other`` to ``base``; ``much_worse`` only when both thresholds are reached."""
    row = report.agg(
        F.max(F.when(F.col("name") == base, F.col(metric))).alias("base_value"),
        F.max(F.when(F.col("name") == other, F.col(metric))).alias("other_value"),
    )
    row = row.withColumn(
        "ratio", F.when(F.col("base_value") > 0, F.col("other_value") / F.col("base_value")).otherwise(float("inf"))
    ).withColumn("delta", F.col("other_value") - F.col("base_value"))
    worse = (F.col("ratio") >= ratio) & (F.col("delta") >= delta)
    return row.withColumn("label", F.when(worse, "much_worse").otherwise("not_much_worse"))


def compact_metrics(
    gen: DataFrame, real: DataFrame, spec: DatasetSpec, dim: int = 128, size: int = 32, seed: int = 20260527,
    index: str = "global_index", image: str = "image",
) -> DataFrame:
    """Smoke metrics on random-projection features of images; not comparable with real feature metrics."""
    keep = [index, image]
    sides = [
        materialize(random_projection(df.select(*keep), spec, dim, size, seed, image), "projection")
        for df in (real, gen)
    ]
    mom = [moments(s, strict=False) for s in sides]
    parts = [
        frechet_regularized(*mom).select(F.col("fid_reg").alias("compact_fid_rp")),
        mmd_rbf(*sides, index=index).select(
            F.col("mmd2").alias("compact_mmd_rbf"), F.col("bandwidth2").alias("compact_mmd_rbf_bandwidth2")
        ),
        kid_poly3(*sides, index=index).select(F.col("mmd2").alias("compact_kid_poly3")),
    ]
    return _side_by_side(parts).select(
        "*", F.lit("random_projection_smoke").alias("feature_method"), F.lit(size).alias("feature_image_size"),
        F.lit(dim).alias("feature_dim"), F.lit(seed).cast("bigint").alias("feature_seed"),
    )
