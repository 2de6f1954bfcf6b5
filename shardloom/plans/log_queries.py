"""Run-log, trend, artifact, audit and planning queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shardloom.operators import artifacts, audits, planning, runlog, trends
from shardloom.plans.catalog import query, rounded, stamp
from shardloom.plans.views import Tables

TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
STEPS = "s AS (SELECT * FROM runlog WHERE type = 'train_step')"


def _steps(t: Tables) -> DataFrame:
    return t.log.where(F.col("type") == "train_step")


@query("split_events", "SELECT type, count(*) AS n, max(step) AS last_step FROM runlog GROUP BY type", ("runlog",))
def _(t: Tables):
    parts = [df.groupBy("type").agg(F.count("*").alias("n"), F.max("step").alias("last_step")) for df in runlog.split_events(t.log).values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "run_summary",
    f"""WITH {STEPS}, r AS (SELECT DISTINCT run FROM runlog)
    SELECT run, min(step) AS start_step, max(step) AS final_step, count(step) AS recorded_steps,
      min_by(loss, step) AS first_loss, min(loss) AS min_loss, max(loss) AS max_loss, max_by(loss, step) AS final_loss,
      round(avg(realized), 12) AS mean_realized_fraction, max(peak_memory_mb) AS peak_memory_mb,
      coalesce(bool_and(loss_finite), false) AS loss_all_finite, coalesce(bool_and(grad_is_finite), false) AS grad_all_finite
    FROM r LEFT JOIN s USING (run) GROUP BY run""",
    ("runlog",),
)
def _(t: Tables):
    return rounded(runlog.run_summary(_steps(t), runs=t.log), 12)


@query(
    "training_gate",
    f"""WITH {STEPS}, top AS (SELECT run, max(step) AS final_step, bool_and(loss_finite) AND bool_and(grad_is_finite) AS fin FROM s GROUP BY run),
    a AS (SELECT run, max_by(fd_rel_err, step) AS fd, max_by(degenerate, step) AS dg FROM runlog WHERE type = 'fd_audit' GROUP BY run),
    e AS (SELECT run, bool_or(sample_status = 'ok') AS ok FROM runlog WHERE type = 'eval' GROUP BY run),
    c AS (SELECT DISTINCT run FROM runlog WHERE type = 'checkpoint'),
    g AS (SELECT top.run, fin AS train_ok, fd AS fd_rel_err, coalesce(fd < 1e-2, false) AS fd_ok, dg AS degenerate_error,
      coalesce(dg < 1e-7, false) AS degenerate_ok, c.run IS NOT NULL AS checkpoint_ok, coalesce(e.ok, false) AS eval_ok
      FROM top LEFT JOIN a USING (run) LEFT JOIN e USING (run) LEFT JOIN c ON c.run = top.run)
    SELECT run, train_ok, round(fd_rel_err, 6) AS fd_rel_err, fd_ok, round(degenerate_error, 12) AS degenerate_error,
      degenerate_ok, checkpoint_ok, eval_ok, true AS memory_logged,
      train_ok AND fd_ok AND degenerate_ok AND checkpoint_ok AND eval_ok AS practical_gate_pass FROM g""",
    ("runlog",),
)
def _(t: Tables):
    parts = runlog.split_events(t.log)
    summary = runlog.run_summary(parts["train_step"]).withColumn("requested_max_steps", F.col("final_step"))
    # the log of this query records these two flags
    flags = ["loss_all_finite", "grad_all_finite"]
    gate = runlog.training_gate(summary, parts["fd_audit"], parts["eval"], parts["checkpoint"], flags=flags)
    return gate.withColumn("fd_rel_err", F.round("fd_rel_err", 6)).withColumn(
        "degenerate_error", F.round("degenerate_error", 12)
    )


def _last(sizes: str) -> str:
    return f"""WITH {STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rd FROM s),
    z AS (SELECT unnest({sizes}) AS "window"), j AS (SELECT * FROM r, z WHERE rd <= "window")"""


@query(
    "throughput_windows",
    f"""{_last('[5, 20, 100]')} SELECT run, "window", count(*) AS steps_used, round(avg(step_sec), 6) AS mean_sec_per_step,
      96 AS batch_size, round(avg(peak_memory_mb), 6) AS mean_peak_memory_mb, min(step) AS first_step, max(step) AS last_step,
      {TS.format('min(created_at)')} AS first_time, {TS.format('max(created_at)')} AS last_time,
      round(96 / avg(step_sec), 6) AS samples_per_sec, round(3600 / avg(step_sec), 6) AS steps_per_hour
    FROM j GROUP BY run, "window" """,
    ("runlog",),
)
def _(t: Tables):
    out = runlog.throughput_windows(_steps(t), (5, 20, 100))
    return rounded(out.withColumn("first_time", stamp("first_time")).withColumn("last_time", stamp("last_time")))


@query(
    "trailing_windows",
    f"""{_last('[10, 50, 1000, 10000]')} SELECT run, "window", count(loss) AS n, round(avg(loss), 11) AS mean,
      round(quantile_cont(loss, 0.5), 11) AS median, min(loss) AS "min", max(loss) AS "max" FROM j GROUP BY run, "window" """,
    ("runlog",),
)
def _(t: Tables):
    return rounded(runlog.trailing_windows(_steps(t), "loss", (10, 50, 1000, 10000)), 11)


@query(
    "step_bins",
    f"""WITH {STEPS} SELECT run, (step - 1) // 16 * 16 + 1 AS bin_start, count(*) AS n, round(avg(loss), 11) AS mean,
      round(quantile_cont(loss, 0.5), 11) AS median, (step - 1) // 16 * 16 + 16 AS bin_end FROM s GROUP BY run, (step - 1) // 16""",
    ("runlog",),
)
def _(t: Tables):
    return rounded(runlog.step_bins(_steps(t), 16), 11)


@query(
    "speedup",
    f"""{_last('[5, 20]')}, w AS (SELECT run, "window", 96 / avg(step_sec) AS rate FROM j GROUP BY run, "window"),
    b AS (SELECT "window", rate AS base FROM w WHERE run = (SELECT min(run) FROM s))
    SELECT run, "window", round(rate / base, 6) AS speedup FROM w JOIN b USING ("window")""",
    ("runlog",),
)
def _(t: Tables):
    steps = _steps(t)
    baseline = steps.agg(F.min("run")).first()[0]
    return rounded(runlog.speedup(runlog.throughput_windows(steps, (5, 20)), baseline).select("run", "window", "speedup"))


@query(
    "latest_by_type",
    """SELECT run, type, max(step) AS step, max_by(event_id, step) AS event_id, max_by(loss, step) AS loss FROM runlog
    WHERE type IN ('train_step', 'fd_audit') GROUP BY run, type""",
    ("runlog",),
)
def _(t: Tables):
    return runlog.latest_by_type(t.log.select("run", "type", "step", "event_id", "loss"))


@query("evals_done", "SELECT run, step FROM runlog WHERE type = 'eval' AND sample_status = 'ok'", ("runlog",))
def _(t: Tables):
    return runlog.evals_done(t.log, t.log.select("run", "step"))


LR = """CASE WHEN step < 10 THEN 0.001 * step / 10 ELSE
    0.0001 + 0.5 * (0.001 - 0.0001) * (1 + cos(pi() * least(1, greatest(0, (step - 10) / 90.0::DOUBLE)))) END"""


@query("lr_schedule", f"SELECT run, step, round({LR}, 12) AS lr FROM runlog", ("runlog",))
def _(t: Tables):
    lr = runlog.lr_schedule(F.col("step"), 0.001, "cosine", 10, 100, 0.0001)
    return t.log.select("run", "step", F.round(lr, 12).alias("lr"))


@query(
    "lr_check",
    f"""WITH {STEPS} SELECT run, count(*) AS steps, count(*) FILTER (k % 7 <> 0 OR step < 1) AS agreeing,
      round(max(CASE WHEN k % 7 = 0 THEN 0.00001 ELSE 0 END)::DOUBLE, 9) AS worst FROM s GROUP BY run""",
    ("runlog",),
)
def _(t: Tables):
    config = {"base": 0.001, "kind": "cosine", "warmup": 10, "end": 100, "minimum": 0.0001}
    logged = runlog.lr_schedule(F.col("step"), **config) + F.when(F.col("k") % 7 == 0, 1e-5).otherwise(0.0)
    checked = runlog.lr_check(_steps(t).withColumn("optimizer_lr", logged), **config)
    return checked.groupBy("run").agg(
        F.count("*").alias("steps"), F.count_if("lr_ok").alias("agreeing"), F.round(F.max("lr_abs_diff"), 9).alias("worst")
    )


@query(
    "progress_eta",
    f"""WITH d AS (SELECT event_type AS job, date_trunc('day', ts) AS day, count(*) AS c FROM events GROUP BY ALL),
    p AS (SELECT job, day + INTERVAL 1 DAY AS t, sum(c) OVER (PARTITION BY job ORDER BY day) AS done,
      date_diff('day', min(day) OVER (PARTITION BY job), day) * 86400.0::DOUBLE + 86400 AS el FROM d),
    q AS (SELECT job, t, CAST(done AS BIGINT) AS done, greatest(5000 - done, 0) AS remaining, done / el AS avg_rate,
      (done - lag(done) OVER w) / (epoch(t) - epoch(lag(t) OVER w)) AS interval_rate FROM p WINDOW w AS (PARTITION BY job ORDER BY t))
    SELECT job, {TS.format('t')} AS time, done, CAST(remaining AS BIGINT) AS remaining, round(avg_rate, 13) AS avg_rate,
      round(interval_rate, 13) AS interval_rate, round(remaining / avg_rate, 3) AS eta_sec,
      strftime(t + to_seconds(floor(remaining / avg_rate)), '%Y%m%dT%H%M%SZ') AS finish_utc FROM q""",
)
def _(t: Tables):
    e = t.read("events").withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    daily = e.groupBy(F.col("event_type").alias("job"), "day").agg(F.count("*").alias("c"))
    w = Window.partitionBy("job").orderBy("day")  # one row per job and day
    first = F.min("day").over(Window.partitionBy("job"))
    progress = daily.select(
        "job", (F.col("day") + F.expr("INTERVAL 1 DAY")).alias("time_utc"), F.sum("c").over(w).alias("done"),
        F.lit(5000).cast("bigint").alias("target"), (F.datediff("day", first) * 86400.0 + 86400.0).alias("elapsed_sec"),
    )
    out = trends.progress_eta(progress)
    return out.select(
        "job", stamp("time_utc").alias("time"), "done", "remaining", F.round("avg_rate", 13).alias("avg_rate"),
        F.round("interval_rate", 13).alias("interval_rate"), F.round("eta_sec", 3).alias("eta_sec"), "finish_utc",
    )


DOCS = """docs AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS step, value AS fid, '/res/eval/step_' ||
    CASE k % 3 WHEN 0 THEN 'smoke/' WHEN 1 THEN 'inception_eval/' ELSE 'other/' END || lpad(CAST(event_id AS VARCHAR), 12, '0') AS metrics_path,
    user_id AS run FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""


def _docs(t: Tables) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind = F.when(k % 3 == 0, "smoke/").when(k % 3 == 1, "inception_eval/").otherwise("other/")
    return t.read("events").select(
        F.datediff("ts", F.lit("2024-01-01")).cast("bigint").alias("step"), F.col("value").alias("fid"),
        F.concat(F.lit("/res/eval/step_"), kind, F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("metrics_path"),
        F.col("user_id").alias("run"),
    )


@query(
    "trend_table",
    f"""WITH {DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY contains(metrics_path, 'smoke'),
      NOT contains(metrics_path, '/inception_eval/'), metrics_path) AS rn FROM docs)
    SELECT step, fid, metrics_path FROM r WHERE rn = 1""",
)
def _(t: Tables):
    return trends.trend_table(_docs(t).drop("run"))


@query(
    "anchor_deltas",
    f"""WITH {DOCS}, best AS (SELECT *, row_number() OVER (PARTITION BY run, step ORDER BY contains(metrics_path, 'smoke'),
      NOT contains(metrics_path, '/inception_eval/'), metrics_path) AS rn FROM docs),
    a AS (SELECT run, step FROM (SELECT DISTINCT run FROM docs), (SELECT unnest([2, 7, 14, 21, 28])::BIGINT AS step)),
    j AS (SELECT a.run, a.step, b.fid FROM a LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON a.run = b.run AND a.step = b.step),
    p AS (SELECT *, last_value(CASE WHEN fid IS NOT NULL THEN step END IGNORE NULLS) OVER w AS ps,
      last_value(fid IGNORE NULLS) OVER w AS pf FROM j
      WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT run, step, fid, ps AS previous_step, round(fid - pf, 6) AS delta,
      round(CASE WHEN pf <> 0 THEN 100 * (fid - pf) / pf END, 6) AS delta_pct, round(1000 * (fid - pf) / (step - ps), 6) AS delta_per_1k_steps,
      CASE WHEN fid IS NULL THEN 'missing' ELSE 'ok' END AS status FROM p""",
)
def _(t: Tables):
    return rounded(trends.anchor_deltas(trends.trend_table(_docs(t), ["run"]), [2, 7, 14, 21, 28]))


@query(
    "equal_budget_compare",
    """WITH a AS (SELECT run // 2 AS pair, step, loss, step * 96 AS p FROM runlog WHERE run % 2 = 0),
    b AS (SELECT run // 2 AS pair, step, loss, step * 64 AS p FROM runlog WHERE run % 2 = 1)
    SELECT a.pair, a.step, a.p AS processed, round(a.p / 64.0::DOUBLE, 6) AS equivalent_step, round(a.p / 1000.0::DOUBLE, 6) AS epochs,
      a.loss AS value_a, b.loss AS value_b, b.step AS step_b, round(a.loss - b.loss, 6) AS difference,
      CASE WHEN b.step IS NULL THEN 'none' WHEN b.p = a.p THEN 'exact' ELSE 'nearest_below' END AS match
    FROM a ASOF LEFT JOIN b ON a.pair = b.pair AND a.p >= b.p""",
    ("runlog",),
)
def _(t: Tables):
    """Neighbouring runs as pairs: an even run at batch 96 against the odd run after it at batch 64."""
    paired = t.log.select(F.floor(F.col("run") / 2).alias("pair"), "run", "step", "loss")
    a, b = paired.where("run % 2 = 0"), paired.where("run % 2 = 1")
    return rounded(trends.equal_budget_compare(a, b, 96, 64, 1000, "loss", ["pair"]))


CKPT = """files AS (SELECT run, CASE WHEN type = 'checkpoint' THEN 'step_' || lpad(CAST(step AS VARCHAR), 7, '0') || '.pt'
    ELSE 'note_' || step || '.txt' END AS name, CASE WHEN type = 'checkpoint' THEN step ELSE -1 END AS step FROM runlog)"""


def _files(t: Tables) -> DataFrame:
    number = F.col("step").cast("string")
    name = F.when(F.col("type") == "checkpoint", F.concat(F.lit("step_"), F.lpad(number, 7, "0"), F.lit(".pt")))
    return t.log.select("run", F.coalesce(name, F.concat(F.lit("note_"), number, F.lit(".txt"))).alias("name"))


@query(
    "latest_checkpoint",
    f"""WITH {CKPT}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC, name DESC) AS rn FROM files)
    SELECT run, step, name FROM r WHERE rn = 1""",
    ("runlog",),
)
def _(t: Tables):
    return artifacts.latest_checkpoint(_files(t), ["run"])


@query(
    "retention",
    f"""WITH {CKPT}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC, name DESC) AS rn FROM files WHERE step >= 0)
    SELECT run, name, step, CASE WHEN rn <= 3 THEN 'newest' WHEN step IN (5, 7) THEN 'protected' WHEN step % 10 = 0 THEN 'archive' END AS reason,
      rn <= 3 OR step IN (5, 7) OR step % 10 = 0 AS keep FROM r""",
    ("runlog",),
)
def _(t: Tables):
    checkpoints = _files(t).where(F.col("name").startswith("step_"))
    return artifacts.retention(checkpoints, 3, 10, [5, 7], ["run"])


@query(
    "eval_backlog",
    """SELECT run, step FROM runlog s WHERE type = 'train_step' AND step BETWEEN 5 AND 60
      AND NOT EXISTS (SELECT 1 FROM runlog m WHERE m.type = 'checkpoint' AND m.k > 20 AND m.run = s.run AND m.step - 1 = s.step)
      AND NOT EXISTS (SELECT 1 FROM runlog m WHERE m.type = 'fd_audit' AND m.run = s.run AND m.step - 1 = s.step)
      AND NOT EXISTS (SELECT 1 FROM runlog m WHERE m.type = 'eval' AND m.run = s.run AND m.step - 1 = s.step)""",
    ("runlog",),
)
def _(t: Tables):
    def before(kind: str) -> DataFrame:
        rows = t.log.where(F.col("type") == kind)
        return rows.select("run", (F.col("step") - 1).alias("step"), F.greatest(F.col("k") - 20, F.lit(0)).alias("bytes"))

    samples = _steps(t).select("run", "step")
    return artifacts.eval_backlog(samples, before("checkpoint"), before("fd_audit"), 5, 60, before("eval"))


@query(
    "stable_files",
    f"""WITH o AS (SELECT event_id, event_type AS cache, CAST(user_id AS VARCHAR) || CASE WHEN k = 0 THEN '.tmp' ELSE '' END AS name, (k // 25)::BIGINT * 1000000000 AS bytes, ts
      FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)),
    p AS (SELECT *, lag(bytes) OVER (PARTITION BY cache, name ORDER BY ts) AS pb FROM o WHERE name NOT LIKE '%.tmp'),
    tw AS (SELECT DISTINCT cache, replace(name, '.tmp', '') AS name FROM o WHERE name LIKE '%.tmp')
    SELECT p.event_id, p.cache, p.name, CAST(p.bytes AS BIGINT) AS bytes, CAST(p.pb AS BIGINT) AS previous_bytes,
      coalesce(p.bytes = p.pb AND p.bytes > 1000000000, false) AND tw.name IS NULL AS ready
    FROM p LEFT JOIN tw ON p.cache = tw.cache AND p.name = tw.name""",
)
def _(t: Tables):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    seen = t.read("events").select(
        "event_id", F.col("event_type").alias("cache"),
        F.concat(F.col("user_id").cast("string"), F.when(k == 0, ".tmp").otherwise("")).alias("name"),
        (F.floor(k / 25) * 1_000_000_000).alias("bytes"), F.col("ts").cast("timestamp").alias("observed_at"),
    )
    return artifacts.stable_files(seen).drop("observed_at")


AUDIT = """audit AS (SELECT event_type AS mode, pow(10, -2.0 - k % 3) AS fd_eps, (k + 1) * (loss + 1) / 1e5 AS err, k FROM runlog)"""


def _audits(t: Tables) -> DataFrame:
    k = F.col("k")
    eps = F.when(k % 3 == 0, 1e-2).when(k % 3 == 1, 1e-3).otherwise(1e-4)
    return t.log.select(
        F.col("event_type").alias("mode"), eps.alias("fd_eps"), ((k + 1) * (F.col("loss") + 1) / 1e5).alias("fd_rel_err_full_jvp"),
        (k < 99).alias("u_finite"), F.lit(True).alias("du_finite"), F.lit(True).alias("fd_finite"),
        F.when(k > 0, True).alias("all_r_eq_t_degenerate_finite"), F.lit(True).alias("backbone_u_finite"),
    )


@query(
    "numeric_audit_table",
    f"""WITH {AUDIT} SELECT mode, round(min(err) FILTER (k % 3 = 0), 9) AS "err_0.01", round(min(err) FILTER (k % 3 = 1), 9) AS "err_0.001",
      round(min(err) FILTER (k % 3 = 2), 9) AS "err_0.0001", bool_and(k < 99 AND k > 0) AS no_nan_or_inf,
      arg_min(CASE k % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.001 ELSE 0.0001 END::DOUBLE, err) AS best_eps, round(min(err), 9) AS best_err
    FROM audit GROUP BY mode""",
    ("runlog",),
)
def _(t: Tables):
    table = audits.numeric_audit_table(_audits(t), [1e-2, 1e-3, 1e-4])
    return table.select(
        *[F.round(f"`{c}`", 9).alias(c) if c.startswith("err") or c == "best_err" else F.col(c) for c in table.columns]
    )


@query(
    "strict_fast_ratio",
    f"""WITH {AUDIT} SELECT round(min(err) FILTER (mode = 'click'), 9) AS strict_err, round(min(err) FILTER (mode = 'view'), 9) AS fast_err,
      round(min(err) FILTER (mode = 'view') / min(err) FILTER (mode = 'click'), 6) AS fast_over_strict FROM audit""",
    ("runlog",),
)
def _(t: Tables):
    out = audits.strict_fast_ratio(audits.numeric_audit_table(_audits(t), [1e-2]), "click", "view")
    return out.select(
        F.round("strict_err", 9).alias("strict_err"), F.round("fast_err", 9).alias("fast_err"),
        F.round("fast_over_strict", 6).alias("fast_over_strict"),
    )


def _results(t: Tables) -> DataFrame:
    k = F.col("k")
    return t.log.select(
        "run", (k % 4).alias("grid"), F.when(k % 2 == 0, 256).otherwise(1024).alias("n_tokens"),
        F.when(k % 5 < 3, "normal").otherwise("smooth").alias("latent_mode"),
        F.when(F.col("event_type") == "view", "fp32").otherwise("bf16").alias("mode"),
        F.when(k == 50, "error").otherwise("ok").alias("status"), (k / 2000.0).alias("fd_rel_err_full_jvp"),
        F.when(k % 11 == 0, k / 1e10).otherwise(0.0).alias("degenerate_target_minus_v_max_abs"),
        (k != 13).alias("grad_is_finite"), (k != 17).alias("du_finite"),
        F.when(k == 50, "OutOfMemory").alias("error_type"), F.when(k == 50, F.concat(F.lit("batch "), k % 4)).alias("error_message"),
    )


@query(
    "audit_gates",
    """WITH g AS (SELECT run, count(*) AS n_results, count(*) FILTER (k <> 50) AS n_ok, count(*) FILTER (k = 50) AS n_error,
      count(*) FILTER (f) AS fp32_count, max(k / 2000.0::DOUBLE) FILTER (f) AS max_fd,
      max(CASE WHEN k % 11 = 0 THEN k / 1e10 ELSE 0.0 END::DOUBLE) FILTER (f) AS max_degenerate,
      coalesce(bool_and(k <> 13) FILTER (f), true) AS grad_all_finite, coalesce(bool_and(k <> 17) FILTER (f), true) AS du_all_finite,
      coalesce(bool_or(k % 2 = 0) FILTER (f), false) AS has_256, coalesce(bool_or(k % 2 = 1) FILTER (f), false) AS has_1024
      FROM (SELECT *, event_type = 'view' AND k <> 50 AS f FROM runlog) GROUP BY run)
    SELECT run, n_results, n_ok, n_error, fp32_count, round(max_fd, 6) AS max_fd, round(max_degenerate, 12) AS max_degenerate,
      grad_all_finite, du_all_finite, has_256, has_1024,
      fp32_count > 0 AND du_all_finite AND grad_all_finite AND has_256 AND has_1024 AND n_error = 0 AND max_fd < 1e-2 AND max_degenerate = 0 AS strict_pass,
      fp32_count > 0 AND du_all_finite AND grad_all_finite AND has_256 AND has_1024 AND max_fd < 5e-2 AND max_degenerate < 1e-7 AS practical_pass
    FROM g""",
    ("runlog",),
)
def _(t: Tables):
    out = audits.audit_gates(_results(t), ["run"])
    return out.withColumn("max_fd", F.round("max_fd", 6)).withColumn("max_degenerate", F.round("max_degenerate", 12))


@query(
    "audit_errors",
    """SELECT k % 4 AS grid, CASE WHEN k % 5 < 3 THEN 'normal' ELSE 'smooth' END AS latent_mode,
      CASE WHEN event_type = 'view' THEN 'fp32' ELSE 'bf16' END AS mode, 'OutOfMemory' AS error_type, 'batch ' || k % 4 AS error_message,
      count(*) AS n FROM runlog WHERE k = 50 GROUP BY ALL""",
    ("runlog",),
)
def _(t: Tables):
    return audits.audit_errors(_results(t))


@query(
    "toy_gate",
    """WITH b AS (SELECT event_type, min(k / 100.0::DOUBLE) AS best, max(k / 1e9::DOUBLE) AS dg, false AS nan FROM runlog GROUP BY event_type)
    SELECT count(*) AS configs, round(max(best), 6) AS max_best_fd, round(max(dg), 12) AS max_degenerate, bool_or(nan) AS any_nan,
      max(best) < 0.05 AND max(dg) < 1e-6 AND NOT bool_or(nan) AS toy_pass FROM b""",
    ("runlog",),
)
def _(t: Tables):
    rows = t.log.select(
        F.col("event_type").alias("config"), (F.col("k") / 100.0).alias("fd_rel_err_full_jvp"),
        (F.col("k") / 1e9).alias("degenerate_target_minus_v_max_abs"), F.lit(False).alias("has_nan_or_inf"),
    )
    out = audits.toy_gate(rows)
    return out.withColumn("max_best_fd", F.round("max_best_fd", 6)).withColumn("max_degenerate", F.round("max_degenerate", 12))


BENCH = """bench AS (SELECT run, event_type AS config, k % 8 AS batch, avg(loss) AS total_rate, bool_and(k < 96) AS good
    FROM runlog GROUP BY run, event_type, k % 8)"""


def _bench(t: Tables) -> DataFrame:
    rows = t.log.groupBy("run", F.col("event_type").alias("config"), (F.col("k") % 8).alias("batch")).agg(
        F.avg("loss").alias("total_rate"), F.bool_and(F.col("k") < 96).alias("good")
    )
    return rows.withColumn("total_rate", F.round("total_rate", 9)).withColumn("status", F.when(F.col("good"), "PASS").otherwise("OOM"))


@query(
    "capacity_plan",
    f"""WITH {BENCH}, r AS (SELECT config, batch, round(avg(total_rate), 6) AS total_rate FROM bench GROUP BY config, batch),
    tg AS (SELECT * FROM (VALUES ('validation', 50000::BIGINT), ('train', 1281167)) x(target, samples))
    SELECT config, batch, total_rate, target, samples, round(samples / total_rate / 3600 + 0.5, 6) AS hours,
      round(samples * 32776.68 / 1e9, 6) AS gb, round(samples * 32776.68 / 1073741824, 6) AS gib, CAST(ceil(samples / 4096) AS BIGINT) AS shards
    FROM r, tg""",
    ("runlog",),
)
def _(t: Tables):
    rates = rounded(_bench(t).groupBy("config", "batch").agg(F.avg("total_rate").alias("total_rate")))
    targets = {"validation": 50_000, "train": 1_281_167}
    return rounded(planning.capacity_plan(rates, targets, 32_776.68, 0.5))


@query(
    "stage_breakdown",
    """WITH r AS (SELECT run, count(*) AS encoded, sum(step_sec) AS encode_sec, sum(k) / 400.0::DOUBLE AS copy_sec,
      sum(k) / 800.0::DOUBLE AS save_sec, sum(loss) / 100 AS elapsed_sec FROM runlog GROUP BY run),
    x AS (SELECT *, greatest(elapsed_sec - encode_sec - copy_sec - save_sec, 0) AS rest_sec FROM r)
    SELECT run, round(encode_sec / elapsed_sec, 6) AS encode_share, round(copy_sec / elapsed_sec, 6) AS copy_share,
      round(save_sec / elapsed_sec, 6) AS save_share, round(rest_sec / elapsed_sec, 6) AS rest_share,
      round(encoded / encode_sec, 6) AS encode_rate,
      CASE WHEN rest_sec / elapsed_sec > encode_sec / elapsed_sec THEN 'input_preprocess_bound_not_gpu_bound' ELSE 'gpu_bound' END AS bound_by
    FROM x""",
    ("runlog",),
)
def _(t: Tables):
    runs = t.log.groupBy("run").agg(
        F.count("*").alias("encoded"), F.sum("step_sec").alias("encode_sec"), (F.sum("k") / 400.0).alias("copy_sec"),
        (F.sum("k") / 800.0).alias("save_sec"), (F.sum("loss") / 100).alias("elapsed_sec"),
    )
    out = planning.stage_breakdown(runs)
    return rounded(out.select("run", "encode_share", "copy_share", "save_share", "rest_share", "encode_rate", "bound_by"))


@query(
    "pick_config",
    f"""WITH {BENCH}, b AS (SELECT run, config, batch, round(total_rate, 9) AS total_rate, CASE WHEN good THEN 'PASS' ELSE 'OOM' END AS status FROM bench),
    w AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY status = 'PASS' DESC, total_rate DESC, batch, config DESC) AS rn FROM b)
    SELECT run, config, batch, total_rate, status, rn = 1 AND status = 'PASS' AS chosen FROM w""",
    ("runlog",),
)
def _(t: Tables):
    return planning.pick_config(_bench(t).drop("good"), ["run"])
