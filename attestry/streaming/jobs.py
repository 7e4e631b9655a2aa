"""Structured Streaming jobs; each has a batch twin in operators.monitor."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.detector import Events, detect
from ..operators.monitor import latency_status, local_hour
from .fold import in_order, streamed


def new_alerts(flags: DataFrame, late: str = "1 day") -> DataFrame:
    """The first row of each (ts, flag); what is kept ends with the watermark."""
    return flags.withWatermark("ts", late).dropDuplicatesWithinWatermark(["ts", "flag"])


def hourly_latency(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, queries, avg_latency_ms, p95_ms, status) of the hours that the watermark has closed, in local time; its batch twin
    is monitor.hourly_status. Only queries with a latency count.

    The state of an open hour is a count for each of its different latencies; the percentile is taken from the counts once,
    when the hour is closed, so no hour is held event by event.
    """
    rows = events.where("event_type = 'query' and response_time_ms is not null").withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", "1 hour"), "response_time_ms").agg(F.count("*").alias("n"))
    per = counts.groupBy(F.window(F.window_time("window"), "1 hour")).agg(
        F.sum("n").alias("queries"), F.sum(F.col("n") * F.col("response_time_ms")).alias("total"), F.array_sort(F.collect_list(F.struct("response_time_ms", "n"))).alias("held"),
    )
    place = F.floor((F.col("queries") - 1) * 95 / 100)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"))

    def step(s: Column, x: Column) -> Column:
        here = (s["seen"] <= place) & (s["seen"] + x["n"] > place)
        return F.struct((s["seen"] + x["n"]).alias("seen"), F.when(here, x["response_time_ms"].cast("long")).otherwise(s["v"]).alias("v"))

    p95 = F.aggregate("held", start, step, lambda s: s["v"])
    out = per.select(local_hour(F.col("window.start")).alias("hour"), "queries", (F.col("total") / F.col("queries")).alias("avg_latency_ms"), p95.alias("p95_ms"))
    return out.withColumn("status", latency_status(F.col("p95_ms")))


def over_limit(requests: DataFrame, limit: int = 60, late: str = "1 minute") -> DataFrame:
    """(key, minute, n) of the keys that pass the limit of a calendar minute."""
    rows = requests.withWatermark("ts", late).groupBy("key", F.window("ts", "1 minute")).agg(F.count("*").alias("n"))
    return rows.where(F.col("n") > limit).select("key", F.col("window.start").alias("minute"), "n")


def _times(alerts: DataFrame) -> DataFrame:
    return alerts.select("dedup_key", F.unix_micros("ts").alias("us"), "ts")


def _suppress(gap_s: float):
    def step(last, row):
        emits = last is None or row.us - last >= gap_s * 1e6
        return (int(row.us), [(row.dedup_key, row.ts)]) if emits else (last, [])

    return step


def suppressed(alerts: DataFrame, gap_s: float = 600.0, late: str = "1 day") -> DataFrame:
    """(dedup_key, ts) of alerts that are emitted: none within gap_s of the last emitted one of its key.

    The state of a key is one time, and is dropped when the watermark has passed the gap; event time is used.
    """
    rows = _times(alerts.withWatermark("ts", late))
    return streamed(rows, "dedup_key", "us", _suppress(gap_s), "dedup_key string, ts timestamp", GroupStateTimeout.EventTimeTimeout, lambda last: last / 1000 + gap_s * 1000)


def suppressed_batch(alerts: DataFrame, gap_s: float = 600.0) -> DataFrame:
    """The batch twin of suppressed."""
    return in_order(_times(alerts), "dedup_key", "us", _suppress(gap_s), "dedup_key string, ts timestamp")


def _failures(threshold: int):
    def step(failed, row):
        failed = 0 if row.ok else (failed or 0) + 1
        return failed, [(row.series, row.position, failed)] if failed >= threshold else []

    return step


def failing(probes: DataFrame, threshold: int = 3) -> DataFrame:
    """(series, position, failures) of the probes at which failures in a row reach the threshold; twin: failure_runs."""
    return streamed(probes.select("series", "position", "ok"), "series", "position", _failures(threshold), "series string, position long, failures long")


def _escalations(windows: int):
    def step(state, row):
        alerted, pending, count = state or (0, None, 0)
        if row.level <= alerted:
            return [min(alerted, int(row.level)), None, 0], []
        count = count + 1 if pending == row.level else 1
        if count < windows:
            return [alerted, int(row.level), count], []
        return [int(row.level), None, 0], [(row.series, row.position, row.level, alerted)]

    return step


def escalations(history: DataFrame, windows: int = 2) -> DataFrame:
    """(series, position, level, from_level) of the windows that confirm a rise above the level last alerted: so many in
    a row at the same higher level. A lower level lowers the mark. Rows are (series, position, level)."""
    return streamed(history.select("series", "position", "level"), "series", "position", _escalations(windows), _ESCALATED)


def escalations_batch(history: DataFrame, windows: int = 2) -> DataFrame:
    """The batch twin of escalations."""
    return in_order(history.select("series", "position", "level"), "series", "position", _escalations(windows), _ESCALATED)


def escalation_states(history: DataFrame, windows: int = 2) -> DataFrame:
    """(series, state): where each series stands after its history, as JSON; to be saved, and to begin a stream with."""
    step = _escalations(windows)

    def held(state, row):
        state, _ = step(state, row)
        return state, [(row.series, row.position, json.dumps([None if x is None else int(x) for x in state]))]

    every = in_order(history.select("series", "position", "level"), "series", "position", held, "series string, position long, state string")
    return every.groupBy("series").agg(F.max_by("state", "position").alias("state"))


class _Escalations(StatefulProcessor):
    """The step of escalations over the state of a series, which may come from a saved one."""

    def __init__(self, windows: int) -> None:
        self.step = _escalations(windows)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("escalation", "state string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803
        self.state.update((initialState["state"].iloc[0],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        held, out = json.loads(self.state.get()[0]) if self.state.exists() else None, []
        for row in pd.concat(list(rows)).sort_values("position", kind="stable").itertuples(index=False):
            held, emitted = self.step(held, row)
            out += emitted
        self.state.update((json.dumps([None if x is None else int(x) for x in held]),))
        yield pd.DataFrame(out, columns=["series", "position", "level", "from_level"])

    def close(self) -> None:
        pass


def escalations_from(history: DataFrame, saved: DataFrame, windows: int = 2) -> DataFrame:
    """escalations of a stream that goes on from saved states (series, state), of a batch or of an earlier stream. The session's
    state store must be the one of RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    rows = history.select("series", "position", "level").groupBy("series")
    return rows.transformWithStateInPandas(_Escalations(windows), _ESCALATED, "append", "None", initialState=saved.groupBy("series"))


_ESCALATED = "series string, position long, level long, from_level long"


def detected(events: DataFrame) -> DataFrame:
    """(log_file, position, flag): the detector over a stream; its batch twin is detector_flags. The rules are the same, and the
    state of a file is what their series hold."""
    rows = events.select("log_file", "position", "event_type", F.col("response_time_ms").cast("long").alias("response_time_ms"), "scope_check", F.col("retry_count").cast("long").alias("retry_count"))

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        new = pd.concat(list(batches)).sort_values("position", kind="stable")
        columns = {"event_type": pa.string(), "response_time_ms": pa.int64(), "scope_check": pa.string(), "retry_count": pa.int64()}
        part = pa.RecordBatch.from_arrays([pa.array(new[c], t, from_pandas=True) for c, t in columns.items()], list(columns))
        flags, held = detect(Events.of(part), held)
        state.update((json.dumps(held),))
        out = [(new["log_file"].iloc[i], new["position"].iloc[i], f) for i in sorted(flags) for f in flags[i]]
        yield pd.DataFrame(out, columns=["log_file", "position", "flag"])

    return rows.groupBy("log_file").applyInPandasWithState(run, "log_file string, position long, flag string", "state string", "append", GroupStateTimeout.NoTimeout)
