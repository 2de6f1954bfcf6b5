"""Run-log monitoring as streaming queries. The same functions run on static tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shardloom.functions.arrays import is_not_finite
from shardloom.functions.joins import with_row
from shardloom.session import require
from shardloom.sources.logs import parse_run_log


def stream_run_log(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Events of a growing log folder. A file is read once, so writers must roll to new files."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(path).where(F.trim("value") != "")
    return parse_run_log(lines).where(~F.col("malformed"))


def monitor_windows(
    log: DataFrame, every: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", time: str = "created_at",
    by: Sequence[str] = ("run",),
) -> DataFrame:
    """Per interval: last step, mean loss, samples/s, non-finite count, peak memory.

    Append mode emits an interval once the watermark has passed it. ``slide`` gives overlapping intervals.
    """
    source = log.withWatermark(time, late) if log.isStreaming else log
    span = F.window(time, every, slide) if slide else F.window(time, every)
    out = source.groupBy(*by, span.alias("w")).agg(
        F.count("*").alias("events"), F.max("step").alias("last_step"), F.avg("loss").alias("mean_loss"),
        F.sum("batch_size").alias("__samples"),
        F.count_if(F.coalesce(is_not_finite(F.col("loss")), F.lit(False))).alias("non_finite"),
        F.max("peak_memory_mb").alias("peak_memory_mb"),
    )
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return out.select(
        *by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "last_step",
        "mean_loss", (F.col("__samples") / seconds).alias("samples_per_sec"), "non_finite", "peak_memory_mb",
    )


class LateRows(StreamingQueryListener):
    """Rows the watermark has turned away, by query id, over all batches reported since the listener was added."""

    def __init__(self) -> None:
        self.totals: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.totals[str(event.progress.id)] += _turned_away(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _turned_away(progress) -> int:
    return sum(op["numRowsDroppedByWatermark"] for op in progress["stateOperators"])


def count_late_rows(spark: SparkSession) -> LateRows:
    """A counter for ``late_rows``, to be added before the stream starts."""
    counter = LateRows()
    spark.streams.addListener(counter)
    return counter


def late_rows(query: StreamingQuery, counter: LateRows | None = None) -> int:
    """Rows the watermark has turned away so far: from a counter, over all batches since it was added; without one, from
    the query's recent progress, which is an error once older reports may have been dropped."""
    if counter is not None:
        return counter.totals[str(query.id)]
    reports = query.recentProgress
    limit = int(SparkSession.active().conf.get("spark.sql.streaming.numRecentProgressUpdates", "100"))
    require(len(reports) < limit, f"only the last {limit} reports are kept: add count_late_rows before the stream starts")
    return sum(map(_turned_away, reports))


def latest_state(log: DataFrame, by: Sequence[str] = ("run", "type")) -> DataFrame:
    """Newest row per (run, type); update mode on a stream."""
    rest = [c for c in log.columns if c not in by]
    return log.groupBy(*by).agg(F.max_by(F.struct(*rest), "step").alias("__row")).select(*by, "__row.*")


def _slot(time: str, idle_seconds: int) -> Column:
    """Events of one slot are closer than the idle limit."""
    return F.floor(F.unix_micros(time) / (idle_seconds * 1_000_000))


def _is_bad(log: DataFrame) -> Column:
    bad = F.coalesce(is_not_finite(F.col("loss")), F.lit(False))
    for flag in ("loss_finite", "grad_is_finite"):
        if flag in log.columns:
            bad = bad | F.coalesce(~F.col(flag), F.lit(False))
    if "status" in log.columns:
        bad = bad | F.coalesce(F.col("status") == "error", F.lit(False))
    return bad


def alert_partials(log: DataFrame, idle_seconds: int, by: Sequence[str] = ("run",), time: str = "created_at") -> DataFrame:
    """Mergeable facts behind ``alerts``: first bad step and first/last event per run and idle-long slot."""
    slot, bad = _slot(time, idle_seconds), _is_bad(log)
    return log.groupBy(*by, slot.alias("slot")).agg(
        F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.min(F.when(bad, F.col("step"))).alias("bad_step"),
        F.min_by(time, F.when(bad, F.col("step"))).alias("bad_at"),
    )


def alerts_from_partials(partials: DataFrame, idle_seconds: int, by: Sequence[str] = ("run",)) -> DataFrame:
    """``(run, kind, step, at)``: the first non-finite step of a run, and each silence of ``idle_seconds`` or more.

    Events inside one slot are closer than the limit, so gaps only need each slot's first and last event;
    a run has few slots however many events it has. The newest event of the whole log ends open silences.
    """
    by = list(by)
    merged = partials.groupBy(*by, "slot").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min("bad_step").alias("bad_step"),
        F.min_by("bad_at", "bad_step").alias("bad_at"),
    )
    bad = merged.groupBy(*by).agg(F.min("bad_step").alias("step"), F.min_by("bad_at", "bad_step").alias("at"))
    bad = bad.where(F.col("step").isNotNull()).select(*by, F.lit("non_finite").alias("kind"), "step", "at")
    newest = merged.agg(F.max("last_at").alias("__now"))
    nxt = F.lead("first_at").over(Window.partitionBy(*by).orderBy("slot"))
    gaps = with_row(merged.withColumn("__next", nxt), newest)
    silence = F.unix_micros(F.coalesce("__next", "__now")) - F.unix_micros("last_at")
    idle = gaps.where(silence >= idle_seconds * 1_000_000).select(
        *by, F.lit("idle").alias("kind"), F.lit(None).cast("bigint").alias("step"), F.col("last_at").alias("at")
    )
    return bad.unionByName(idle)


def alerts(log: DataFrame, idle_seconds: int, by: Sequence[str] = ("run",), time: str = "created_at") -> DataFrame:
    """Alerts of a static log; on a stream keep ``alert_partials`` per batch and read them back here."""
    return alerts_from_partials(alert_partials(log, idle_seconds, by, time), idle_seconds, by)


#: State of a run: slots whose silences are still open, as parallel lists, the end of the last silence told, and the
#: lowest bad step told. Times are microseconds.
ALERT_STATE = "slots array<bigint>, firsts array<bigint>, lasts array<bigint>, told bigint, bad_step bigint"


def live_alerts(
    log: DataFrame, idle_seconds: int, late: str = "10 minutes", by: Sequence[str] = ("run",), time: str = "created_at"
) -> DataFrame:
    """The rows of ``alerts`` from a stream, each as soon as it is certain and only once; append mode.

    A bad step is told in the batch that brings it (a lower one that arrives afterwards is told too). A silence is told when
    the watermark passes its limit, by an event-time timer: the run needs no further event and nobody has to look, but some
    run must move the watermark. Tasks fold a batch to one row per run and slot first, so a run with most of the events
    sends few rows to its state; the state holds the slots within the watermark's delay.
    """
    by = list(by)
    keys = log.select(*by).schema
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.fields)
    events = log.where(F.col(time).isNotNull()).select(
        *by, _slot(time, idle_seconds).alias("slot"), F.unix_micros(time).alias("first"), F.unix_micros(time).alias("last"),
        F.when(_is_bad(log), F.col("step")).cast("double").alias("bad_step"),
    )

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = frame["first"].where(frame["bad_step"].notna())
            lowest = frame.assign(bad_at=at).sort_values("bad_step", kind="stable")  # missing ones come last
            yield lowest.groupby([*by, "slot"], dropna=False, sort=False, as_index=False).agg(
                first=("first", "min"), last=("last", "max"), bad_step=("bad_step", "first"), bad_at=("bad_at", "first")
            )

    folded = events.mapInPandas(fold, f"{names}, slot bigint, first bigint, last bigint, bad_step double, bad_at double")
    timed = folded.withColumn("last_at", F.timestamp_micros("last")).withWatermark("last_at", late)
    out = timed.groupBy(*by).applyInPandasWithState(
        _alert_step(by, idle_seconds * 1_000_000), f"{names}, kind string, step bigint, at bigint", ALERT_STATE, "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return out.withColumn("at", F.timestamp_micros("at"))


def _alert_step(by: list[str], idle: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots, firsts, lasts, told, bad_step = state.get if state.exists else ([], [], [], None, None)
        open_ = {s: [f, x] for s, f, x in zip(slots, firsts, lasts, strict=True)}
        found, worst = [], None
        for frame in [] if state.hasTimedOut else frames:
            for slot, first, last in frame[["slot", "first", "last"]].itertuples(index=False):
                had = open_.setdefault(int(slot), [int(first), int(last)])
                had[:] = min(had[0], int(first)), max(had[1], int(last))
            bad = frame[frame["bad_step"].notna()]
            if len(bad):
                low = bad.loc[bad["bad_step"].idxmin()]
                worst = min(worst or (low["bad_step"], low["bad_at"]), (low["bad_step"], low["bad_at"]))
        if worst is not None and (bad_step is None or worst[0] < bad_step):
            bad_step = int(worst[0])
            found.append(("non_finite", bad_step, int(worst[1])))
        now = max(state.getCurrentWatermarkMs(), 0) * 1000
        order, wake = sorted(open_), []
        for slot, following in zip(order, [*order[1:], None], strict=True):
            first, last = open_[slot]
            if following is not None and open_[following][0] - last < idle:
                if first <= now:  # nothing earlier can arrive
                    del open_[slot]
            elif last + idle > now:
                wake.append(last + idle)
            else:  # nothing can arrive in between any more
                if told is None or last > told:
                    told = last
                    found.append(("idle", None, last))
                if following is not None:
                    del open_[slot]
        kept = sorted(open_)
        state.update((kept, [open_[s][0] for s in kept], [open_[s][1] for s in kept], told, bad_step))
        if wake:
            # a timer fires when the watermark is beyond it
            state.setTimeoutTimestamp(max(-(-min(wake) // 1000) - 1, state.getCurrentWatermarkMs() + 1))
        if not found:
            return
        rows = pd.DataFrame(found, columns=["kind", "step", "at"]).astype({"step": "Int64", "at": "Int64"})
        for name, value in zip(by, key, strict=True):
            rows[name] = value
        yield rows[[*by, "kind", "step", "at"]]

    return step
