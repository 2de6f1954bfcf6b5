"""Streaming jobs run to completion over the given tables, with the batch SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shardloom.operators import moments

from shardloom.plans.catalog import query, rounded, stamp
from shardloom.plans.source_queries import _write_log
from shardloom.plans.stat_queries import COUNTS, STATS
from shardloom.plans.views import SPEC, Tables
from shardloom.session import scratch_dir
from shardloom.streaming import follow, incremental, monitors, population

TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def _stream(t: Tables, name: str) -> DataFrame:
    """A given table as a stream (a file source reads folders, so the one file is picked by name)."""
    schema = t.read(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)


def _rolled(t: Tables, df: DataFrame, files: int = 4) -> tuple[DataFrame, str]:
    """A derived table written as several files and read back as a stream, one file per batch."""
    path = scratch_dir(t.spark, "rolled")
    df.repartition(files).write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), path


def _finish_in_time(t: Tables, df: DataFrame, time: str, job, pieces: int = 3) -> DataFrame:
    """What ``job`` tells of a derived table that arrives piece by piece in the order of its times; started again for each piece.

    A piece is read in one batch, however many files its tasks have written: files of a piece share its times, so with a
    piece over several batches the watermark of one would make rows of the next late.
    """
    path, out, state = (scratch_dir(t.spark, name) for name in ("rolled", "sink", "state"))
    at = F.unix_micros(time)
    cuts = df.select(F.percentile_approx(at, [k / pieces for k in range(1, pieces)], 10_000)).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        piece = df.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        piece.write.mode("append").parquet(path)
        told = _finish(t, job(t.spark.readStream.schema(df.schema).parquet(path)), out=out, state=state)
    return told


def _finish(t: Tables, stream: DataFrame, mode: str = "append", out: str | None = None, state: str | None = None) -> DataFrame:
    """Run a stream until its source is exhausted and return what reached the sink."""
    out, state = out or scratch_dir(t.spark, "sink"), state or scratch_dir(t.spark, "state")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    writer.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


@query(
    "stream_run_log",
    """SELECT CAST(run AS VARCHAR) AS run, type, count(*) AS n, CAST(sum(step) AS BIGINT) AS steps FROM runlog GROUP BY run, type""",
    ("runlog",),
)
def _(t: Tables):
    events = _finish(t, monitors.stream_run_log(t.spark, _write_log(t)).select("run", "type", "step"))
    return events.groupBy("run", "type").agg(F.count("*").alias("n"), F.sum("step").alias("steps"))


def _windows(rows: str) -> str:
    return f"""SELECT run, {TS.format('w')} AS window_start, count(*) AS events, max(step) AS last_step, round(avg(loss), 6) AS mean_loss,
      round(count(*) * 96 / 21600.0::DOUBLE, 9) AS samples_per_sec, count(*) FILTER (isnan(loss)) AS non_finite,
      max(peak_memory_mb) AS peak_memory_mb FROM {rows} GROUP BY run, w"""


def _monitor_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "run", stamp("window_start").alias("window_start"), "events", "last_step", F.round("mean_loss", 6).alias("mean_loss"),
        F.round("samples_per_sec", 9).alias("samples_per_sec"), "non_finite", "peak_memory_mb",
    )


@query("monitor_windows", _windows("(SELECT *, time_bucket(INTERVAL 6 HOURS, created_at) AS w FROM runlog)"), ("runlog",))
def _(t: Tables):
    return _monitor_rows(monitors.monitor_windows(t.log, "6 hours"))


@query(
    "monitor_windows_sliding",
    _windows("(SELECT *, time_bucket(INTERVAL 3 HOURS, created_at) - i * INTERVAL 3 HOURS AS w FROM runlog, (VALUES (0), (1)) v(i))"),
    ("runlog",),
)
def _(t: Tables):
    return _monitor_rows(monitors.monitor_windows(t.log, "6 hours", "3 hours"))


@query(
    "stream_monitor_windows",
    _windows("""(SELECT *, time_bucket(INTERVAL 6 HOURS, created_at) AS w FROM runlog
      WHERE time_bucket(INTERVAL 6 HOURS, created_at) + INTERVAL 6 HOURS <= (SELECT max(created_at) FROM runlog) - INTERVAL 10 MINUTES)"""),
    ("runlog",),
)
def _(t: Tables):
    """Append mode gives the intervals the watermark has passed; the open ones wait for more data."""
    # All files in one trigger: no row is late, however many tasks have written them.
    path = scratch_dir(t.spark, "rolled")
    log = t.log.select("run", "step", "loss", "batch_size", "peak_memory_mb", "created_at")
    log.write.parquet(path)
    stream = t.spark.readStream.schema(log.schema).parquet(path)
    return _monitor_rows(_finish(t, monitors.monitor_windows(stream, "6 hours")))


LATEST = """SELECT run, type, max(step) AS step, max_by(event_id, step) AS event_id FROM runlog GROUP BY run, type"""


@query("latest_state", LATEST, ("runlog",))
def _(t: Tables):
    return monitors.latest_state(t.log.select("run", "type", "step", "event_id"))


@query("stream_latest_state", LATEST, ("runlog",))
def _(t: Tables):
    """Update mode: every batch writes the rows that changed; the newest batch of a key is its state."""
    stream, _ = _rolled(t, t.log.select("run", "type", "step", "event_id"))
    out, state = scratch_dir(t.spark, "updates"), scratch_dir(t.spark, "state")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = monitors.latest_state(stream).writeStream.outputMode("update").foreachBatch(save)
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return monitors.latest_state(t.spark.read.parquet(out).drop("batch_id"))


IDLE = 172_800
ALERTS = f"""WITH bad AS (SELECT run, 'non_finite' AS kind, min(step) AS step, min_by(created_at, step) AS at FROM runlog
      WHERE NOT loss_finite OR NOT grad_is_finite GROUP BY run),
    g AS (SELECT run, created_at, coalesce(lead(created_at) OVER (PARTITION BY run ORDER BY created_at, event_id),
      (SELECT max(created_at) FROM runlog)) AS nxt FROM runlog),
    a AS (SELECT * FROM bad UNION ALL SELECT run, 'idle', NULL, created_at FROM g WHERE date_diff('microsecond', created_at, nxt) >= {IDLE}::BIGINT * 1000000)
    SELECT run, kind, step, {TS.format('"at"')} AS "at" FROM a"""


def _alert_rows(df: DataFrame) -> DataFrame:
    return df.select("run", "kind", "step", stamp("at").alias("at"))


@query("alerts", ALERTS, ("runlog",))
def _(t: Tables):
    return _alert_rows(monitors.alerts(t.log, IDLE))


@query("stream_alerts", ALERTS, ("runlog",))
def _(t: Tables):
    stream, _ = _rolled(t, t.log.select("run", "step", "loss", "loss_finite", "grad_is_finite", "created_at"))
    out, state = scratch_dir(t.spark, "alerts"), scratch_dir(t.spark, "state")
    incremental.keep_partials(stream, lambda b: monitors.alert_partials(b, IDLE), out, state).awaitTermination()
    return _alert_rows(monitors.alerts_from_partials(t.spark.read.parquet(out), IDLE))


@query(
    "stream_live_alerts",
    f"""WITH bad AS (SELECT run, 'non_finite' AS kind, min(step) AS step, min_by(created_at, step) AS at FROM runlog
      WHERE NOT loss_finite OR NOT grad_is_finite GROUP BY run),
    g AS (SELECT run, created_at, lead(created_at) OVER (PARTITION BY run ORDER BY created_at, event_id) AS nxt FROM runlog),
    a AS (SELECT * FROM bad UNION ALL SELECT run, 'idle', NULL, created_at FROM g
      WHERE (nxt IS NULL OR date_diff('microsecond', created_at, nxt) >= {IDLE}::BIGINT * 1000000)
      AND created_at + INTERVAL {IDLE} SECONDS <= (SELECT date_trunc('milliseconds', max(created_at)) FROM runlog) - INTERVAL 1 HOUR)
    SELECT run, kind, step, {TS.format('"at"')} AS "at" FROM a""",
    ("runlog",),
)
def _(t: Tables):
    """Each alert fires in the stream itself; silences that the watermark has not passed yet wait."""
    log = t.log.select("run", "step", "loss", "loss_finite", "grad_is_finite", "created_at")
    return _alert_rows(_finish_in_time(t, log, "created_at", lambda stream: monitors.live_alerts(stream, IDLE, "1 hour")))


@query("stream_stats", f"SELECT {COUNTS}, {STATS}, round(max(abs(v)), 6) AS absmax FROM elements", ("elements",))
def _(t: Tables):
    stream, _ = _rolled(t, t.latents)
    out, state = scratch_dir(t.spark, "stats"), scratch_dir(t.spark, "state")
    incremental.stream_stats(stream, SPEC, out, state).awaitTermination()
    return rounded(incremental.read_stats(t.spark, out)[0])


@query(
    "stream_moments",
    """SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, count(*) AS n, round(avg(a.v), 9) AS mu_i,
      round(covar_samp(a.v, b.v), 9) AS sigma_ij FROM elements a JOIN elements b USING (global_index) GROUP BY a.pos, b.pos""",
    ("elements",),
)
def _(t: Tables):
    stream, _ = _rolled(t, t.features)
    out, state = scratch_dir(t.spark, "moments"), scratch_dir(t.spark, "state")
    incremental.stream_moments(stream, SPEC.size, out, state).awaitTermination()
    return rounded(moments.moment_cells(incremental.read_moments(t.spark, out, SPEC.size)), 9)


ARRIVALS = 5


def _arriving(t: Tables, run) -> None:
    """Samples arrive a fifth at a time, by their index modulo five; ``run`` starts the stream again for each arrival."""
    path = scratch_dir(t.spark, "arrivals")
    for k in range(ARRIVALS):
        t.features.where(F.col("global_index") % ARRIVALS == k).write.mode("append").parquet(path)
        run(t.spark.readStream.schema(t.features.schema).parquet(path)).awaitTermination()


@query(
    "population_decayed",
    f"""WITH w AS (SELECT global_index, pos, v, pow(0.5, {ARRIVALS - 1} - global_index % {ARRIVALS}) AS w FROM elements),
    s AS (SELECT a.pos AS i, b.pos AS j, sum(a.w) AS w, sum(a.w * a.v) / sum(a.w) AS mi, sum(a.w * b.v) / sum(a.w) AS mj, sum(a.w * a.v * b.v) / sum(a.w) AS q
      FROM w a JOIN w b USING (global_index) GROUP BY a.pos, b.pos)
    SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(w, 6) AS weight, round(mi, 9) AS mu_i, round(q - mi * mj, 9) AS sigma_ij FROM s""",
    ("elements",),
)
def _(t: Tables):
    """Weights halve with every batch; finished batches are compacted on the way."""
    out, state = scratch_dir(t.spark, "population"), scratch_dir(t.spark, "state")
    _arriving(t, lambda stream: population.stream_decayed(stream, SPEC.size, out, state, 0.5, every=2))
    mom = population.read_decayed(t.spark, out, SPEC.size, 0.5)
    return rounded(
        mom.select("i", F.posexplode("sigma").alias("j", "sigma_ij"), F.round("weight", 6).alias("weight"), F.col("mu").alias("mu_i")), 9
    )


@query(
    "population_newest",
    f"""WITH k AS (SELECT vec_id AS global_index FROM embeddings ORDER BY vec_id % {ARRIVALS} DESC, vec_id DESC LIMIT 333),
    e AS (SELECT global_index, pos, v FROM elements JOIN k USING (global_index))
    SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, count(*) AS n, round(avg(a.v), 9) AS mu_i,
      round(covar_samp(a.v, b.v), 9) AS sigma_ij FROM e a JOIN e b USING (global_index) GROUP BY a.pos, b.pos""",
    ("elements",),
)
def _(t: Tables):
    """The newest 333 samples: whole batches by their sums, the oldest one by its newest rows."""
    out, state = scratch_dir(t.spark, "population"), scratch_dir(t.spark, "state")
    _arriving(t, lambda stream: population.stream_newest(stream, SPEC.size, out, state, 333))
    return rounded(moments.moment_cells(population.read_newest(t.spark, out, SPEC.size, 333)), 9)


@query(
    "follow_derive",
    "SELECT o_orderkey AS source_index, round(o_totalprice * 2, 4) AS derived FROM orders",
)
def _(t: Tables):
    """Every order gets a derived row exactly once, whatever the batches."""
    source = t.read("orders").select(F.col("o_orderkey").alias("source_index"), "o_totalprice")
    stream, path = _rolled(t, source, 3)
    out, state = scratch_dir(t.spark, "derived"), scratch_dir(t.spark, "state")
    follow.follow_derive(
        stream, lambda: t.spark.read.parquet(path),
        lambda todo: todo.select("source_index", F.round(F.col("o_totalprice") * 2, 4).alias("derived")), out, state,
        min_gap=1,
    ).awaitTermination()
    return t.spark.read.parquet(out).drop("batch_id")


@query(
    "follow_backlog",
    """WITH s AS (SELECT run, step, loss FROM runlog WHERE type = 'eval' AND step BETWEEN 3 AND 40)
    SELECT run, step, round(loss, 6) AS fid FROM s""",
    ("runlog",),
)
def _(t: Tables):
    """Each eval event is a sample set; its metric is evaluated once and enters the trend."""
    samples = t.log.where(F.col("type") == "eval").select("run", "step", "loss")
    stream, _ = _rolled(t, samples, 3)
    out, state = scratch_dir(t.spark, "backlog"), scratch_dir(t.spark, "state")

    def evaluate(rows: DataFrame) -> DataFrame:
        path = F.concat_ws("/", F.lit("eval"), F.concat(F.lit("step_"), "step"), F.lit("inception_eval"), F.lit("metrics.json"))
        return rows.select("run", "step", F.round("loss", 6).alias("fid"), path.alias("metrics_path"), F.lit(1).cast("bigint").alias("bytes"))

    follow.follow_backlog(stream, evaluate, out, state, 3, 40).awaitTermination()
    return follow.backlog_trend(t.spark, out).select("run", "step", "fid")
