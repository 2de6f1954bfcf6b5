import math

import pytest
from pyspark.sql import functions as F

from shardloom.operators import artifacts as A, audits as U, planning as P, runlog as L, trends as T

STEPS = "run string, step bigint, loss double, loss_finite boolean, grad_is_finite boolean, peak_memory_mb double, batch_size int, step_sec double, created_at timestamp"


def steps(spark, rows):
    full = [(r, s, loss, math.isfinite(loss), True, 10.0, 96, sec, None) for r, s, loss, sec in rows]
    return spark.createDataFrame(full, STEPS)


def test_summary_and_empty_run(spark):
    df = steps(spark, [("a", 1, 3.0, 1.0), ("a", 3, 1.0, 1.0), ("a", 2, 2.0, 1.0), ("b", 1, float("inf"), 1.0)])
    runs = spark.createDataFrame([("a",), ("b",), ("empty",)], "run string")
    rows = {r["run"]: r for r in L.run_summary(df, runs=runs).collect()}
    assert (rows["a"]["first_loss"], rows["a"]["final_loss"], rows["a"]["min_loss"]) == (3.0, 1.0, 1.0)
    assert rows["a"]["loss_all_finite"] and not rows["b"]["loss_all_finite"]
    assert rows["empty"]["final_loss"] is None and rows["empty"]["loss_all_finite"] is False and rows["empty"]["recorded_steps"] == 0


def test_equal_flags(spark):
    df = steps(spark, [("a", 1, 1.0, 1.0), ("a", 2, 1.0, 1.0)]).withColumn("jvp_param_source", F.when(F.col("step") == 1, "live"))
    assert L.run_summary(df).first()["live_params_all_steps"] is False
    assert L.run_summary(df.withColumn("jvp_param_source", F.lit("live"))).first()["live_params_all_steps"] is True


def gate(spark, fd=0.001, degenerate=0.0, ok="ok", ckpt=True, last=2, unreported=None, **kw):
    summary = L.run_summary(steps(spark, [("a", 1, 1.0, 1.0), ("a", 2, 1.0, 1.0)]))
    for flag in (*L.TRAIN_FLAGS, *L.PRACTICAL_FLAGS):
        summary = summary.withColumn(flag, F.lit(True)) if flag != unreported else summary.drop(flag)
    audits = spark.createDataFrame([("a", 1, 9.0, 9.0), ("a", 2, fd, degenerate)], "run string, step bigint, fd_rel_err_full_jvp double, all_r_eq_t_degenerate_target_minus_v_max_abs double")
    evals = spark.createDataFrame([("a", ok)], "run string, sample_status string")
    ckpts = spark.createDataFrame([("a" if ckpt else "z",)], "run string")
    return L.training_gate(summary, audits, evals, ckpts, last, **kw).first()


def test_training_gate(spark):
    assert gate(spark)["practical_gate_pass"]
    for bad in ({"fd": 0.01}, {"fd": None}, {"degenerate": 1e-7}, {"ok": "timeout"}, {"ckpt": False}, {"last": 3}):
        assert not gate(spark, **bad)["practical_gate_pass"], bad
    assert gate(spark, ok="timeout", eval_required=False)["practical_gate_pass"]
    for flag in (*L.TRAIN_FLAGS, *L.PRACTICAL_FLAGS):  # what a run does not report it has not shown
        assert not gate(spark, unreported=flag)["practical_gate_pass"], flag
        assert gate(spark, unreported=flag, flags=[f for f in (*L.TRAIN_FLAGS, *L.PRACTICAL_FLAGS) if f != flag])["practical_gate_pass"]


def test_windows_use_the_newest_steps(spark):
    df = steps(spark, [("a", s, float(s), s / 10) for s in range(1, 101)])
    rows = {r["window"]: r for r in L.throughput_windows(df, (10, 1000)).collect()}
    assert rows[10]["first_step"] == 91 and rows[10]["steps_used"] == 10 and rows[1000]["steps_used"] == 100
    assert rows[10]["samples_per_sec"] == pytest.approx(96 / 9.55)
    trail = {r["window"]: r for r in L.trailing_windows(df, "loss", (3, 10)).collect()}
    assert trail[3]["median"] == 99 and trail[10]["mean"] == 95.5
    bins = {r["bin_start"]: r for r in L.step_bins(df, 30).collect()}
    assert bins[1]["mean"] == 15.5 and bins[91]["n"] == 10 and bins[61]["bin_end"] == 90


def test_learning_rate(spark):
    cfg = dict(base=1e-3, kind="cosine", warmup=10, end=110, minimum=1e-4)
    df = spark.createDataFrame([(0, 0.0), (5, 5e-4), (10, 1e-3), (60, 5.5e-4), (110, 1e-4), (500, 1e-4), (7, 1.0)], "step bigint, optimizer_lr double")
    rows = {r["step"]: r["lr_ok"] for r in L.lr_check(df, **cfg).collect()}
    assert rows == {0: True, 5: True, 10: True, 60: True, 110: True, 500: True, 7: False}
    with pytest.raises(ValueError):
        L.lr_schedule(F.col("step"), 1.0, "linear")


def test_trend_prefers_full_canonical_documents(spark):
    docs = [
        (1, 1.0, "/e/step_1/smoke/m"), (1, 2.0, "/e/step_1/other/m"), (1, 3.0, "/e/step_1/inception_eval/m"),
        (2, 4.0, "/e/step_2/smoke/b"), (2, 5.0, "/e/step_2/smoke/a"), (3, 6.0, "/e/step_3/z"), (3, 7.0, "/e/step_3/y"),
    ]
    df = spark.createDataFrame(docs, "step bigint, fid double, metrics_path string")
    assert {r["step"]: r["fid"] for r in T.trend_table(df).collect()} == {1: 3.0, 2: 5.0, 3: 7.0}


def test_missing_anchors_stay(spark):
    trend = spark.createDataFrame([("a", 10, 8.0), ("a", 30, 4.0)], "run string, step bigint, fid double")
    rows = {r["step"]: r for r in T.anchor_deltas(trend, [10, 20, 30]).collect()}
    assert rows[20]["status"] == "missing" and rows[30]["previous_step"] == 10
    assert rows[30]["delta"] == -4.0 and rows[30]["delta_pct"] == -50.0 and rows[30]["delta_per_1k_steps"] == -200.0


def test_equal_budget(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "step bigint, fid double")
    b = spark.createDataFrame([(3, 30.0), (5, 50.0)], "step bigint, fid double")
    rows = {r["step"]: r for r in T.equal_budget_compare(a, b, 64, 32, 640).collect()}
    assert rows[1]["match"] == "none" and rows[2]["match"] == "nearest_below" and rows[2]["value_b"] == 30.0
    assert rows[3]["match"] == "nearest_below" and rows[3]["step_b"] == 5 and rows[3]["equivalent_step"] == 6.0 and rows[3]["epochs"] == 0.3
    exact = T.equal_budget_compare(a, spark.createDataFrame([(4, 9.0)], "step bigint, fid double"), 64, 32, 640)
    assert exact.where("step = 2").first()["match"] == "exact"


def test_progress(spark):
    df = spark.sql(
        "SELECT 'j' AS job, timestamp(t) AS time_utc, done, 100L AS target, e AS elapsed_sec FROM VALUES "
        "('2026-01-01 00:00:10', 10L, 10D), ('2026-01-01 00:00:20', 40L, 20D), ('2026-01-01 00:00:30', 100L, 30D) t(t, done, e)"
    )
    rows = T.progress_eta(df).orderBy("time_utc").collect()
    assert rows[0]["interval_rate"] is None and rows[1]["interval_rate"] == 3.0 and rows[1]["avg_rate"] == 2.0
    assert rows[1]["eta_hms"] == "00:00:30" and rows[1]["finish_utc"] == "20260101T000050Z" and rows[2]["remaining"] == 0


def test_checkpoints(spark):
    names = [f"step_{s:07d}.pt" for s in (5, 10, 15, 20, 25, 30)] + ["latest.pt"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert A.latest_checkpoint(df).first()["step"] == 30
    assert A.latest_checkpoint(df.where("name = 'latest.pt'")).first()["step"] == -1
    kept = {r["name"]: r["reason"] for r in A.retention(df, 2, 10, [5]).collect()}
    assert kept["step_0000030.pt"] == "newest" and kept["step_0000025.pt"] == "newest" and kept["step_0000005.pt"] == "protected"
    assert kept["step_0000010.pt"] == "archive" and kept["step_0000015.pt"] is None
    assert A.retention(df, 0).where("keep").count() == 7


def test_stable_files(spark):
    df = spark.sql(
        "SELECT 'c' AS cache, name, timestamp(t) AS observed_at, b AS bytes FROM VALUES ('a', '2026-01-01', 5L), ('a', '2026-01-02', 9L), "
        "('a', '2026-01-03', 9L), ('b', '2026-01-01', 9L), ('b', '2026-01-02', 9L), ('b.tmp', '2026-01-02', 1L), ('c', '2026-01-01', 2L), ('c', '2026-01-02', 2L) t(name, t, b)"
    )
    ready = A.stable_files(df, min_bytes=4).where("ready").collect()
    assert [(r["name"], r["observed_at"].day) for r in ready] == [("a", 3)]


def test_audit_gates(spark):
    schema = "status string, mode string, n_tokens int, fd_rel_err_full_jvp double, degenerate_target_minus_v_max_abs double, grad_is_finite boolean, du_finite boolean"
    good = [("ok", "fp32", n, 0.001, 0.0, True, True) for n in (256, 1024)]

    def run(extra=(), base=good):
        row = U.audit_gates(spark.createDataFrame([*base, *extra], schema)).first()
        return row["strict_pass"], row["practical_pass"]

    assert run() == (True, True)
    assert run([("error", "bf16", 1024, None, None, None, None)]) == (False, True)
    assert run([("ok", "fp32", 256, 0.04, 0.0, True, True)]) == (False, True)
    assert run([("ok", "fp32", 256, 0.001, 1e-8, True, True)]) == (False, True)
    assert run([("ok", "fp32", 256, 0.001, 0.0, False, True)]) == (False, False)
    assert run([("ok", "fp32", 256, 0.001, 0.0, None, True)]) == (True, True)  # a skipped train step
    assert run(base=good[:1]) == (False, False) and run(base=[("ok", "bf16", 256, 0.0, 0.0, True, True)]) == (False, False)


def test_planning(spark):
    bench = spark.createDataFrame([("x", 32, "PASS", 10.0), ("y", 64, "PASS", 12.0), ("z", 128, "OOM", 99.0)], "config string, batch int, status string, total_rate double")
    assert [r["config"] for r in P.pick_config(bench).where("chosen").collect()] == ["y"] and P.pick_config(bench).count() == 3
    plan = {r["target"]: r for r in P.capacity_plan(bench.limit(1), {"t": 36_000, "v": 4097}, 1000.0, 0.5).collect()}
    assert plan["t"]["hours"] == 1.5 and plan["t"]["gb"] == pytest.approx(0.036) and plan["v"]["shards"] == 2
    runs = spark.createDataFrame([(10.0, 2.0, 1.0, 1.0, 100)], "elapsed_sec double, encode_sec double, copy_sec double, save_sec double, encoded int")
    row = P.stage_breakdown(runs).first()
    assert row["rest_share"] == 0.6 and row["encode_rate"] == 50.0 and row["bound_by"].startswith("input")
