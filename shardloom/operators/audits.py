"""Numeric audit grids and their gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

ERROR = "fd_rel_err_full_jvp"
# The flags that must all hold for a clean audit row.
CLEAN_FLAGS = ["u_finite", "du_finite", "fd_finite", "all_r_eq_t_degenerate_finite", "backbone_u_finite"]


def with_clean_flag(audits: DataFrame) -> DataFrame:
    clean = F.lit(True)
    for flag in CLEAN_FLAGS:
        clean = clean & F.coalesce(F.col(flag), F.lit(False))
    return audits.withColumn("no_nan_or_inf", clean)


def numeric_audit_table(audits: DataFrame, eps: Sequence[float], by: Sequence[str] = ("mode",)) -> DataFrame:
    """Mode x eps grid of the relative error, an all-clean flag and the best eps per mode."""
    best = F.struct(F.col(ERROR), F.col("fd_eps"))
    facts = with_clean_flag(audits).groupBy(*by).agg(
        *[F.min(F.when(F.col("fd_eps") == F.lit(float(e)), F.col(ERROR))).alias(f"err_{e:g}".replace("-", "m")) for e in eps],
        F.bool_and("no_nan_or_inf").alias("no_nan_or_inf"), F.min_by("fd_eps", best).alias("best_eps"),
        F.min(ERROR).alias("best_err"),
    )
    return facts


def strict_fast_ratio(table: DataFrame, strict: str, fast: str) -> DataFrame:
    """Best error of the fast mode over that of the strict mode."""
    row = table.agg(
        F.max(F.when(F.col("mode") == strict, F.col("best_err"))).alias("strict_err"),
        F.max(F.when(F.col("mode") == fast, F.col("best_err"))).alias("fast_err"),
    )
    return row.withColumn("fast_over_strict", F.when(F.col("strict_err") > 0, F.col("fast_err") / F.col("strict_err")))


# Gate limits and the token counts both gates ask for.
STRICT_FD, PRACTICAL_FD, PRACTICAL_DEGENERATE = 1e-2, 5e-2, 1e-7
TOY_FD, TOY_DEGENERATE_FP32, TOY_DEGENERATE_FP64 = 0.05, 1e-6, 1e-10
REQUIRED_TOKENS = (256, 1024)


def audit_gates(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Strict and practical gate over stress results; only fp32 rows count, errors fail the strict gate.

    Rows whose train step was skipped (null ``grad_is_finite``) say nothing about gradients.
    """
    ok = F.col("status") == "ok"
    fp32 = ok & (F.col("mode") == "fp32")

    def of_fp32(c):
        return F.when(fp32, c)

    facts = results.groupBy(*by).agg(
        F.count("*").alias("n_results"), F.count_if(ok).alias("n_ok"),
        F.count_if(F.coalesce(~ok, F.lit(True))).alias("n_error"), F.count_if(fp32).alias("fp32_count"),
        F.max(of_fp32(F.col(ERROR))).alias("max_fd"),
        F.max(of_fp32(F.coalesce("degenerate_target_minus_v_max_abs", F.lit(float("inf"))))).alias("max_degenerate"),
        F.coalesce(F.bool_and(of_fp32(F.col("grad_is_finite"))), F.lit(True)).alias("grad_all_finite"),
        F.coalesce(F.bool_and(of_fp32(F.coalesce("du_finite", F.lit(False)))), F.lit(True)).alias("du_all_finite"),
        *[
            F.coalesce(F.bool_or(of_fp32(F.col("n_tokens") == n)), F.lit(False)).alias(f"has_{n}")
            for n in REQUIRED_TOKENS
        ],
    )
    common = (F.col("fp32_count") > 0) & F.col("du_all_finite") & F.col("grad_all_finite")
    for n in REQUIRED_TOKENS:
        common = common & F.col(f"has_{n}")

    def below(name, limit):
        return F.coalesce(F.col(name) < limit, F.lit(False))

    strict = common & (F.col("n_error") == 0) & below("max_fd", STRICT_FD) & F.coalesce(F.col("max_degenerate") == 0, F.lit(False))
    practical = common & below("max_fd", PRACTICAL_FD) & below("max_degenerate", PRACTICAL_DEGENERATE)
    return facts.withColumn("strict_pass", strict).withColumn("practical_pass", practical)


def audit_errors(results: DataFrame) -> DataFrame:
    """The failed configurations as rows, with how often each failed."""
    keys = ["grid", "latent_mode", "mode", "error_type", "error_message"]
    return results.where(F.coalesce(F.col("status") != "ok", F.lit(True))).groupBy(*keys).agg(F.count("*").alias("n"))


def toy_gate(audits: DataFrame, config: str = "config", dtype: str = "float32") -> DataFrame:
    """Best error per configuration must stay below 0.05, the degenerate error below its dtype's limit."""
    best = audits.groupBy(config).agg(
        F.min(ERROR).alias("best"), F.max("degenerate_target_minus_v_max_abs").alias("degenerate"),
        F.bool_or(F.coalesce("has_nan_or_inf", F.lit(True))).alias("nan"),
    )
    limit = TOY_DEGENERATE_FP32 if dtype == "float32" else TOY_DEGENERATE_FP64
    return best.agg(
        F.count("*").alias("configs"), F.max("best").alias("max_best_fd"), F.max("degenerate").alias("max_degenerate"),
        F.coalesce(F.bool_or("nan"), F.lit(True)).alias("any_nan"),
    ).withColumn(
        "toy_pass",
        F.coalesce((F.col("max_best_fd") < TOY_FD) & (F.col("max_degenerate") < limit) & ~F.col("any_nan"), F.lit(False)),
    )
