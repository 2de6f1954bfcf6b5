"""Analytics over run logs: one row per event, any number of runs, any run length."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shardloom.functions.ordering import last_rows
from shardloom.session import require

EVENT_TYPES = ["train_step", "fd_audit", "checkpoint", "eval"]
RUN = ["run"]

# What every step of a healthy run reports.
FINITE_FLAGS = {
    "loss_all_finite": ["loss_finite"],
    "grad_all_finite": ["grad_is_finite"],
    "target_all_finite": ["u_finite", "du_finite", "target_finite"],
}
EQUAL_FLAGS = {
    "target_detached_all_steps": {"target_requires_grad": False},
    "live_params_all_steps": {"jvp_param_source": "live"},
    "class_cond_all_steps": {"class_cond_injected": True},
    "sample_level_sampler": {"r_t_sampling_granularity": "sample_level"},
    "mixed_modes_ok": {"backbone_forward_mode": "bf16_autocast", "jvp_target_mode": "fp32", "fd_audit_mode": "fp32"},
}


def split_events(log: DataFrame) -> dict[str, DataFrame]:
    """One filtered view of the log per event type."""
    return {t: log.where(F.col("type") == t) for t in EVENT_TYPES}


def _every(condition: Column) -> Column:
    """True only when it holds for every row; false for no rows."""
    return F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(False))


def run_summary(
    steps: DataFrame, by: Sequence[str] = RUN, finite_flags: Mapping[str, Sequence[str]] = FINITE_FLAGS,
    equal_flags: Mapping[str, Mapping] = EQUAL_FLAGS, runs: DataFrame | None = None,
) -> DataFrame:
    """One row per run: step range, losses, all-finite and all-equal flags, mean fraction, peak memory.

    Only flags whose columns exist are reported. ``runs`` lists the runs to report even when they have no
    step: flags false, values null.
    """
    has = set(steps.columns)

    def optional(name: str, make) -> list[Column]:
        return [make(F.col(name))] if name in has else []

    columns = [
        F.min("step").alias("start_step"), F.max("step").alias("final_step"), F.count("step").alias("recorded_steps"),
        F.min_by("loss", F.when(F.col("loss").isNotNull(), F.col("step"))).alias("first_loss"),
        F.min("loss").alias("min_loss"), F.max("loss").alias("max_loss"),
        F.max_by("loss", F.when(F.col("loss").isNotNull(), F.col("step"))).alias("final_loss"),
        *optional("realized_r_eq_t_fraction", lambda c: F.avg(c).alias("mean_realized_fraction")),
        *optional("actual_rt_samples_target_minus_v_max_abs", lambda c: F.max(c).alias("max_degenerate_error")),
        *optional("peak_memory_mb", lambda c: F.max(c).alias("peak_memory_mb")),
        *optional("ema_used_for_target_jvp", lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias("ema_used_any_step")),
    ]
    flags = []
    for name, cols in finite_flags.items():
        if has.issuperset(cols):
            flags.append((name, [F.col(c) for c in cols]))
    for name, wanted in equal_flags.items():
        if has.issuperset(wanted):
            flags.append((name, [F.col(c) == F.lit(v) for c, v in wanted.items()]))
    for name, conditions in flags:
        every = conditions[0]
        for c in conditions[1:]:
            every = every & c
        columns.append(_every(every).alias(name))
    out = steps.groupBy(*by).agg(*columns)
    if runs is not None:
        out = runs.select(*by).distinct().join(out, list(by), "left").na.fill(False, [n for n, _ in flags])
        out = out.na.fill(0, ["recorded_steps"])
    return out


# Limits of the training gate.
FD_LIMIT = 1e-2
DEGENERATE_LIMIT = 1e-7
TRAIN_FLAGS = list(FINITE_FLAGS)
PRACTICAL_FLAGS = ["class_cond_all_steps", "target_detached_all_steps", "live_params_all_steps", "mixed_modes_ok"]


def training_gate(
    summary: DataFrame, audits: DataFrame, evals: DataFrame, checkpoints: DataFrame, max_steps: int | None = None,
    eval_required: bool = True, by: Sequence[str] = RUN, flags: Sequence[str] = (*TRAIN_FLAGS, *PRACTICAL_FLAGS),
) -> DataFrame:
    """Pass/fail per run from its summary, its last audit, its evals and checkpoints.

    ``max_steps`` is the requested last step (``requested_max_steps`` of the summary when None). Each of ``flags`` must
    be reported by the summary and true: a run without one fails.
    """
    by = list(by)
    last = audits.groupBy(*by).agg(
        F.max_by("fd_rel_err_full_jvp", "step").alias("fd_rel_err"),
        F.max_by("all_r_eq_t_degenerate_target_minus_v_max_abs", "step").alias("degenerate_error"),
    )
    ok_evals = evals.groupBy(*by).agg(F.bool_or(F.col("sample_status") == "ok").alias("__eval_ok"))
    saved = checkpoints.groupBy(*by).agg((F.count("*") > 0).alias("__ckpt"))
    rows = summary.join(last, by, "left").join(ok_evals, by, "left").join(saved, by, "left")

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    wanted = F.col("requested_max_steps") if max_steps is None else F.lit(max_steps)
    train = sure(F.col("final_step") == wanted)
    def reported(name: str) -> Column:
        return sure(F.col(name)) if name in summary.columns else F.lit(False)

    for name in TRAIN_FLAGS:
        if name in flags:
            train = train & reported(name)
    rows = (
        rows.withColumn("train_ok", train)
        .withColumn("fd_ok", sure(F.col("fd_rel_err") < FD_LIMIT))
        .withColumn("degenerate_ok", sure(F.col("degenerate_error") < DEGENERATE_LIMIT))
        .withColumn("checkpoint_ok", sure(F.col("__ckpt")))
        .withColumn("eval_ok", sure(F.col("__eval_ok")) | F.lit(not eval_required))
        .withColumn("memory_logged", F.col("peak_memory_mb").isNotNull())
    )
    gate = F.lit(True)
    for name in ("train_ok", "fd_ok", "degenerate_ok", "checkpoint_ok", "eval_ok", "memory_logged"):
        gate = gate & F.col(name)
    for name in PRACTICAL_FLAGS:
        if name in flags:
            gate = gate & reported(name)
    return rows.withColumn("practical_gate_pass", gate).select(
        *by, "train_ok", "fd_rel_err", "fd_ok", "degenerate_error", "degenerate_ok", "checkpoint_ok", "eval_ok",
        "memory_logged", "practical_gate_pass",
    )


def _last_windows(steps: DataFrame, sizes: Sequence[int], by: Sequence[str]) -> DataFrame:
    """The newest ``max(sizes)`` steps, once per window they belong to."""
    newest = last_rows(steps, by, "step", max(sizes))
    windows = F.filter(F.array(*[F.lit(int(s)) for s in sizes]), lambda s: s >= F.col("rank_desc"))
    return newest.withColumn("window", F.explode(windows))


def throughput_windows(
    steps: DataFrame, sizes: Sequence[int] = (50, 200, 1000), by: Sequence[str] = RUN, seconds: str = "step_sec"
) -> DataFrame:
    """Over the last k steps: seconds per step, samples/s, steps/h, mean memory, ranges, steps used."""
    rows = _last_windows(steps, sizes, by)
    out = rows.groupBy(*by, "window").agg(
        F.count("*").alias("steps_used"), F.avg(seconds).alias("mean_sec_per_step"),
        F.max_by("batch_size", "step").alias("batch_size"), F.avg("peak_memory_mb").alias("mean_peak_memory_mb"),
        F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.min("created_at").alias("first_time"), F.max("created_at").alias("last_time"),
    )
    return out.withColumn("samples_per_sec", F.col("batch_size") / F.col("mean_sec_per_step")).withColumn(
        "steps_per_hour", F.lit(3600.0) / F.col("mean_sec_per_step")
    )


def trailing_windows(
    steps: DataFrame, value: str = "loss", sizes: Sequence[int] = (100, 500, 1000, 5000, 10000), by: Sequence[str] = RUN
) -> DataFrame:
    """mean, median, min, max over the last k steps."""
    # at most k values meet per window, so the exact median stays small
    return _last_windows(steps, sizes, by).groupBy(*by, "window").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def step_bins(steps: DataFrame, width: int, value: str = "loss", by: Sequence[str] = RUN) -> DataFrame:
    """Bins ``[1..w], [w+1..2w], ...``: mean and median; a bin holds at most ``width`` steps of a run."""
    require(width > 0, "width must be positive")
    start = F.floor((F.col("step") - 1) / width) * width + 1
    return steps.groupBy(*by, start.alias("bin_start")).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"),
    ).withColumn("bin_end", F.col("bin_start") + width - 1)


def speedup(windows: DataFrame, baseline: str, config: str = "run") -> DataFrame:
    """samples/s relative to the baseline configuration, window by window."""
    base = windows.where(F.col(config) == baseline).select("window", F.col("samples_per_sec").alias("baseline_rate"))
    # the baseline has one row per window size
    return windows.join(F.broadcast(base), "window").withColumn("speedup", F.col("samples_per_sec") / F.col("baseline_rate"))


def latest_by_type(log: DataFrame, types: Sequence[str] = ("train_step", "fd_audit"), by: Sequence[str] = RUN) -> DataFrame:
    """The newest row of each type per run."""
    rest = [c for c in log.columns if c not in (*by, "type")]
    newest = log.where(F.col("type").isin(list(types))).groupBy(*by, "type").agg(
        F.max_by(F.struct(*rest), "step").alias("__row")
    )
    return newest.select(*by, "type", "__row.*")


def evals_done(log: DataFrame, steps: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """The wanted ``(run, step)`` rows that have an eval with ``sample_status = 'ok'``."""
    ok = log.where((F.col("type") == "eval") & (F.col("sample_status") == "ok"))
    return steps.join(ok.select(*by, "step"), [*by, "step"], "left_semi")


def lr_schedule(
    step: Column, base: float, kind: str = "constant", warmup: int = 0, end: int = 1, minimum: float = 0.0
) -> Column:
    """Learning rate at ``step``: constant, or linear warm-up then cosine decay to ``minimum``."""
    if kind in ("", "none", "constant", "null"):
        return F.lit(float(base))
    require(kind in ("cosine", "warmup_cosine", "cosine_warmup"), f"unsupported scheduler {kind!r}")
    s = F.greatest(step, F.lit(0)).cast("double")
    last = max(warmup + 1, end)
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (s - warmup) / float(last - warmup)))
    cosine = minimum + 0.5 * (base - minimum) * (1.0 + F.cos(F.lit(3.141592653589793) * progress))
    return F.when(s < warmup, F.lit(float(base)) * s / float(max(1, warmup))).otherwise(cosine)


def lr_check(steps: DataFrame, tolerance: float = 1e-12, logged: str = "optimizer_lr", **config) -> DataFrame:
    """Adds the expected rate, the absolute difference and whether they agree."""
    expected = lr_schedule(F.col("step"), **config)
    out = steps.withColumn("expected_lr", expected)
    return out.withColumn("lr_abs_diff", F.abs(F.col(logged) - F.col("expected_lr"))).withColumn(
        "lr_ok", F.coalesce(F.col("lr_abs_diff") <= tolerance, F.lit(False))
    )
