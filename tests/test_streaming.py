import datetime as dt
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import stats
from shardloom.operators.moments import moments, packed_moments
from shardloom.spec import DatasetSpec
from shardloom.streaming import follow, incremental as I, monitors as M

SPEC = DatasetSpec(2, 1, 2)


def append(df, path):
    df.coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.fixture(scope="module")
def tensors(spark):
    x = np.random.default_rng(0).normal(size=(40, 4))
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "global_index bigint, tensor array<float>")


def test_statistics_continue_after_a_restart(spark, tensors, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    append(tensors.where("global_index < 10"), src)
    I.stream_stats(stream(spark, tensors, src), SPEC, out, state).awaitTermination()
    for lo, hi in ((10, 25), (25, 40)):
        append(tensors.where(f"global_index >= {lo} AND global_index < {hi}"), src)
    I.stream_stats(stream(spark, tensors, src), SPEC, out, state).awaitTermination()
    got, per = I.read_stats(spark, out)
    want = stats.tensor_stats(tensors, SPEC).first()
    assert got.first()["sample_count"] == 40 and got.first()["std"] == pytest.approx(want["std"], rel=1e-12) and per.count() == 2


def test_a_replayed_batch_overwrites_itself(spark, tensors, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    append(tensors, src)
    for attempt in ("a", "b"):  # a lost checkpoint replays batch 0
        I.stream_stats(stream(spark, tensors, src), SPEC, out, str(tmp_path / attempt)).awaitTermination()
    assert I.read_stats(spark, out)[0].first()["sample_count"] == 40


def test_stream_moments_equal_batch(spark, tensors, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    append(tensors.where("global_index < 10"), src)
    append(tensors.where("global_index >= 10"), src)
    pilot = [0.5, 0.0, 0.0, -1.0]
    I.stream_moments(stream(spark, tensors, src), 4, out, state, features="tensor", pilot=pilot).awaitTermination()
    a, b = packed_moments(I.read_moments(spark, out, 4, pilot=pilot)).first(), packed_moments(moments(tensors, "tensor")).first()
    assert np.allclose(a["sigma"], b["sigma"]) and np.allclose(a["mu"], b["mu"]) and a["count"] == 40


LOG = "run string, type string, step bigint, loss double, batch_size int, peak_memory_mb double, created_at timestamp"


def events(spark, rows):
    base = dt.datetime(2026, 1, 1)
    full = [(run, "train_step", step, loss, 4, 1.0, base + dt.timedelta(minutes=m)) for run, step, loss, m in rows]
    return spark.createDataFrame(full, LOG)


def test_windows_close_behind_the_watermark_and_late_rows_are_counted(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))

    def run():
        s = M.monitor_windows(stream(spark, events(spark, []), src), "5 minutes", late="5 minutes")
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return M.late_rows(q)

    append(events(spark, [("a", 1, 1.0, 1), ("a", 2, float("nan"), 2)]), src)
    append(events(spark, [("a", 3, 3.0, 60)]), src)
    assert run() == 0
    first = spark.read.parquet(out).collect()
    assert len(first) == 1 and first[0]["last_step"] == 2 and first[0]["non_finite"] == 1 and first[0]["samples_per_sec"] == 8 / 300
    append(events(spark, [("a", 9, 1.0, 3)]), src)
    append(events(spark, [("a", 10, 1.0, 200)]), src)
    assert run() >= 1
    assert sorted(r["last_step"] for r in spark.read.parquet(out).collect()) == [2, 3]


def test_late_rows_of_old_batches_are_counted(spark, tmp_path):
    """Reports of a real stream, repeated to more than a query keeps; the listener is fed by hand, so no port is opened."""
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for files in (([("a", 1, 1.0, 1)], [("a", 2, 1.0, 60)]), ([("a", 3, 1.0, 3)], [("a", 4, 1.0, 200)])):
        for rows in files:
            append(events(spark, rows), src)
        s = M.monitor_windows(stream(spark, events(spark, []), src), "5 minutes", late="5 minutes")
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    once, reports = M.late_rows(q), q.recentProgress
    assert once >= 1
    counter, many = M.LateRows(), reports * 60
    for progress in many:
        counter.onQueryProgress(SimpleNamespace(progress=progress))
    busy = SimpleNamespace(id=q.id, recentProgress=many[-100:])
    assert M.late_rows(busy, counter) == 60 * once
    with pytest.raises(ValueError):
        M.late_rows(busy)


def test_alerts_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, 1.0, 0), ("a", 2, float("inf"), 5), ("a", 3, float("nan"), 6), ("a", 4, 1.0, 100), ("b", 1, 1.0, 50), ("b", 2, 1.0, 109)]
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    df = events(spark, rows)
    for cut in ("step = 1", "step = 2", "step > 2"):
        append(df.where(cut), src)
    I.keep_partials(stream(spark, df, src), lambda b: M.alert_partials(b, 3600), out, state).awaitTermination()

    def seen(a):
        return sorted((r["run"], r["kind"], r["step"] or 0, r["at"].minute) for r in a.collect())

    got = seen(M.alerts_from_partials(spark.read.parquet(out), 3600))
    assert got == seen(M.alerts(df, 3600)) == [("a", "idle", 0, 6), ("a", "non_finite", 2, 5)]


def test_stream_of_log_lines(spark, tmp_path):
    for i, line in enumerate(['{"type": "train_step", "step": 1, "run": "a"}', "broken", '{"type": "eval", "step": 1, "run": "a"}']):
        (tmp_path / f"{i}.jsonl").write_text(line + "\n")
    log = M.stream_run_log(spark, str(tmp_path), max_files=1)
    q = M.latest_state(log.select("run", "type", "step")).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["type"] for r in spark.table("latest").collect()} == {"train_step", "eval"}


def test_derived_set_waits_for_the_gap_and_finishes(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    source = spark.range(30).select(F.col("id").alias("source_index"))
    finished = {"yes": False}

    def run():
        follow.follow_derive(
            stream(spark, source, src), lambda: spark.read.parquet(src), lambda todo: todo.withColumn("y", F.col("source_index") * 2),
            out, state, min_gap=8, complete=lambda: finished["yes"],
        ).awaitTermination()

    append(source.where("source_index < 5"), src)
    run()
    assert not follow.list_folders(out, "batch_id=*", "_SUCCESS")
    append(source.where("source_index >= 5 AND source_index < 12"), src)
    run()
    assert spark.read.parquet(out).count() == 12
    finished["yes"] = True
    append(source.where("source_index >= 12 AND source_index < 15"), src)
    run()
    done = spark.read.parquet(out)
    assert done.count() == 15 and done.select("source_index").distinct().count() == 15


def test_backlog_evaluates_each_sample_set_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    sets = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("a", 5)], "run string, step bigint")

    def evaluate(rows):
        path = F.concat(F.lit("/e/step_"), F.col("step").cast("string"))
        return rows.select("run", "step", F.lit(1.5).alias("fid"), path.alias("metrics_path"), F.lit(1).cast("bigint").alias("bytes")).distinct()

    for cut in ("step < 6", "step > 6", "step = 5"):
        append(sets.where(cut), src)
        follow.follow_backlog(stream(spark, sets, src), evaluate, out, state, 2, 10).awaitTermination()
    assert sorted(r["step"] for r in spark.read.parquet(out).collect()) == [5, 9]
    assert follow.backlog_trend(spark, out).count() == 2


def test_the_rest_of_a_complete_source_needs_no_arrival(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    source = spark.range(15).withColumnRenamed("id", "source_index")
    double = lambda todo: todo.withColumn("y", F.col("source_index") * 2)
    append(source.where("source_index < 10"), src)
    append(source.where("source_index >= 10"), src)
    follow.follow_derive(stream(spark, source, src), lambda: spark.read.parquet(src).where("source_index < 10"), double, out, state, min_gap=8).awaitTermination()
    for _ in range(2):  # the second call finds the first one's folder and rewrites it
        assert follow.derive_rest(lambda: spark.read.parquet(src), double, out) == 5
        assert sorted(r["source_index"] for r in spark.read.parquet(out).collect()) == list(range(15))
    assert follow.derive_rest(lambda: spark.read.parquet(src).where("source_index < 10"), double, out) == 0


def test_failed_evaluations_are_tried_again(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    sets = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "run string, step bigint")

    def evaluate(rows, size=[0]):  # noqa: B006  the first evaluation fails
        path = F.concat(F.lit("/e/step_"), F.col("step").cast("string"))
        done = rows.select("run", "step", F.lit(1.5).alias("fid"), path.alias("metrics_path"), F.lit(size[0]).cast("bigint").alias("bytes")).distinct()
        size[0] = 7
        return done

    for step in (1, 2, 3):
        append(sets.where(f"step = {step}"), src)
        follow.follow_backlog(stream(spark, sets, src), evaluate, out, state, 1, 9, read_samples=lambda: spark.read.parquet(src)).awaitTermination()
    rows = sorted((r["step"], r["bytes"]) for r in spark.read.parquet(out).collect())
    assert rows == [(1, 0), (1, 7), (2, 7), (3, 7)]


def test_leftovers_of_a_crashed_batch_are_not_read(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    source = spark.range(9).withColumnRenamed("id", "source_index")
    append(source, src)
    for left in ("batch_id=0/_temporary/0", "batch_id=7"):  # before the first commit, and of a batch that never ended
        (tmp_path / "out" / left).mkdir(parents=True)
        (tmp_path / "out" / left / "x.parquet").write_bytes(b"half")
    double = lambda todo: todo.withColumn("y", F.col("source_index") * 2)
    follow.follow_derive(stream(spark, source, src), lambda: spark.read.parquet(src), double, out, state, min_gap=1).awaitTermination()
    assert follow._read_if_any(spark, out).count() == 9
    assert follow.derive_rest(lambda: spark.read.parquet(src), double, out) == 0


def test_live_alerts_fire_once_and_by_themselves(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    nan = float("nan")

    def run():
        s = M.live_alerts(stream(spark, events(spark, []), src), 3600, late="5 minutes")
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(s.schema).parquet(out).collect()
        return sorted((str(r["run"]), r["kind"], r["step"] or 0, (r["at"] - dt.datetime(2026, 1, 1)).total_seconds() / 60) for r in rows)

    append(events(spark, [("a", 1, 1.0, 0), ("a", 2, nan, 5), ("a", 3, nan, 6), ("b", 1, 1.0, 4), (None, 1, 1.0, 3)]), src)
    bad = [("a", "non_finite", 2, 5.0)]
    assert run() == bad  # at once, although no event follows
    append(events(spark, [("b", 2, 1.0, 68)]), src)
    assert run() == [("None", "idle", 0, 3.0), *bad]  # 63 minutes have passed for certain, by a timer: the run has no further row
    append(events(spark, [("b", 3, 1.0, 72), ("a", 4, nan, 71)]), src)
    again = run()  # a restart each time; the other silences pass the watermark now, and nothing is told twice
    append(events(spark, [("b", 4, 1.0, 80), (None, 2, 1.0, 80)]), src)
    assert again == run() == sorted([("None", "idle", 0, 3.0), ("a", "idle", 0, 6.0), ("b", "idle", 0, 4.0), *bad])
    append(events(spark, [("b", 5, 1.0, 400)]), src)
    got = run()
    log = spark.read.schema(LOG).parquet(src)
    want = sorted((str(r["run"]), r["kind"], r["step"] or 0, (r["at"] - dt.datetime(2026, 1, 1)).total_seconds() / 60) for r in M.alerts(log, 3600).collect())
    assert got == want


def test_live_alerts_of_unordered_batches(spark, tmp_path):
    """Rows within the watermark's delay may come in any order; a hot run is folded before it reaches its state."""
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    rows = [("a", i, 1.0, 3 * i + (90 if i > 40 else 0)) for i in range(80)] + [("b", 1, 1.0, 10), ("b", 2, 1.0, 200), ("c", 1, 1.0, 2000)]
    for part in (rows[1::2], rows[0::2]):
        append(events(spark, part), src)
    s = M.live_alerts(stream(spark, events(spark, []), src), 3600, late="3 days")
    s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    append(events(spark, [("d", 1, 1.0, 90_000)]), src)
    s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["run"], (r["at"] - dt.datetime(2026, 1, 1)).total_seconds() / 60) for r in spark.read.schema(s.schema).parquet(out).collect())
    want = sorted((r["run"], (r["at"] - dt.datetime(2026, 1, 1)).total_seconds() / 60) for r in M.alerts(spark.read.schema(LOG).parquet(src), 3600).collect())
    assert got == want and ("a", 120.0) in got and ("b", 10.0) in got


def test_a_piece_of_many_files_makes_no_row_late(spark):
    """Every file of a piece has rows of all its times; read over several batches, most of them were late."""
    from shardloom.plans import stream_queries as Q
    from shardloom.plans.views import Tables

    rows = [(f"r{i % 7}", i, float("nan") if i % 97 == 0 else 1.0, 30 * i) for i in range(210)]
    log = events(spark, rows).repartition(8)
    got = Q._finish_in_time(Tables(spark, ""), log, "created_at", lambda s: M.live_alerts(s, 9000, "1 minute"))
    tell = lambda df: sorted((r["run"], r["kind"], r["step"] or 0, r["at"]) for r in df.collect())
    last = dt.datetime(2026, 1, 1) + dt.timedelta(minutes=30 * 209 - 1)
    want = [r for r in tell(M.alerts(log, 9000)) if r[1] == "non_finite" or r[3] + dt.timedelta(seconds=9000) <= last]
    newest = [r for r in tell(got) if r not in want]
    assert [r for r in tell(got) if r in want] == want and len(want) > 100 and all(r[3] + dt.timedelta(seconds=9000) <= last for r in newest)
