"""The detector's rules over stretches of a log file, one table for batch and stream.

What the rules look back on are series: the last values of a kind of event. A stretch of events is taken at once, with
what the series held before it, so a file can be cut anywhere: batches cut it into segments and carry the series over,
streams keep the series as the state of the file.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..streaming.fold import in_order

#: Values that a series keeps, the ones of scope that a query is judged by, retries, factor, share and number that are flagged.
WINDOW, SCOPES, RETRIES, SPIKE, SURGE, BURST = 50, 10, 2, 2.0, 0.5, 3
#: Events of a segment, and most segments of all files together.
SEGMENT_ROWS, MOST_SEGMENTS = 200_000, 10_000
FIELDS = ("event_type", "response_time_ms", "scope_check", "retry_count")
_NONE = np.iinfo(np.int64).min


@dataclass
class Events:
    """Columns of a stretch, in order; -1 and the empty text stand for null."""

    kind: np.ndarray
    latency: np.ndarray
    timed: np.ndarray
    scope: np.ndarray
    retries: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch) -> Events:
        kind, scope = (batch.column(c).fill_null("").to_numpy(zero_copy_only=False) for c in ("event_type", "scope_check"))
        late = batch.column("response_time_ms")
        return Events(
            kind, late.fill_null(0).cast(pa.int64()).to_numpy(), late.is_valid().to_numpy(zero_copy_only=False), scope,
            batch.column("retry_count").fill_null(0).cast(pa.int64()).to_numpy(),
        )


#: Each series: the events whose values it takes, their values, and how many of them it keeps.
SERIES: dict[str, tuple[Callable, Callable, int]] = {
    "latency": (lambda e: (e.kind == "query") & e.timed, lambda e: e.latency, WINDOW),
    "outside": (lambda e: (e.kind == "query") & (e.scope != ""), lambda e: (e.scope == "out_of_scope").astype(np.int64), WINDOW),
    "rejection": (lambda e: e.kind == "rejection", lambda e: np.ones(len(e.kind), np.int64), WINDOW),
    "alert": (lambda e: e.kind == "security_alert", lambda e: np.ones(len(e.kind), np.int64), BURST),
}


class Series:
    """The values that a series held before a stretch and those of the stretch."""

    def __init__(self, name: str, events: Events, before: list[int]) -> None:
        takes, value, self.size = SERIES[name]
        self.own = takes(events)
        self.values = np.concatenate([np.array(before, np.int64), value(events)[self.own]])
        self.until = len(before) + np.cumsum(self.own)  # values up to each event

    def held(self, at: np.ndarray) -> np.ndarray:
        """How many values it holds right after the events at."""
        return np.minimum(self.until[at], self.size)

    def last(self, at: np.ndarray, n: int, back: int = 0) -> np.ndarray:
        """The last n values after the events at, leaving out the last `back` of them; rows begin with _NONE where there are fewer."""
        padded = np.concatenate([np.full(n, _NONE), self.values])
        return np.lib.stride_tricks.sliding_window_view(padded, n)[self.until[at] - back]

    def kept(self) -> list[int]:
        return self.values[-self.size :].tolist()


def latency_spike(e: Events, series: dict[str, Series]) -> Iterator[tuple[np.ndarray, list[str]]]:
    late = series["latency"]
    at = np.flatnonzero(late.own)
    past = np.sort(late.last(at, WINDOW, 1), axis=1)
    n = np.minimum(late.until[at] - 1, WINDOW)
    tail = past[np.arange(len(at)), np.minimum(WINDOW - n + np.minimum(n * 95 // 100, n - 1), WINDOW - 1)]
    hit = (n >= 5) & (tail > 0) & (e.latency[at] > SPIKE * tail)
    yield at[hit], [f"latency_spike:{ms}ms>2×p95({p}ms)" for ms, p in zip(e.latency[at[hit]].tolist(), tail[hit].tolist(), strict=True)]


def rejection_surge(e: Events, series: dict[str, Series]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Of rejections among what was asked, and of queries out of scope among the last ones."""
    scopes, refused = series["outside"], series["rejection"]
    at = np.flatnonzero(refused.own)
    total = scopes.held(at) + refused.held(at)
    rate = refused.held(at) / total
    hit = (total >= 10) & (rate > SURGE)
    yield at[hit], [f"rejection_surge:{r:.0%}_last{n}" for r, n in zip(rate[hit].tolist(), total[hit].tolist(), strict=True)]
    at = np.flatnonzero(scopes.own)
    at = at[scopes.until[at] >= SCOPES]
    rate = scopes.last(at, SCOPES).sum(axis=1) / SCOPES
    hit = rate > SURGE
    yield at[hit], [f"rejection_surge:{r:.0%}_last{SCOPES}" for r in rate[hit].tolist()]


def consecutive_retries(e: Events, series: dict[str, Series]) -> Iterator[tuple[np.ndarray, list[str]]]:
    at = np.flatnonzero((e.kind == "query") & (e.retries >= RETRIES))
    yield at, [f"consecutive_retries:{n}" for n in e.retries[at].tolist()]


def security_alert_burst(e: Events, series: dict[str, Series]) -> Iterator[tuple[np.ndarray, list[str]]]:
    alerts = series["alert"]
    at = np.flatnonzero(alerts.own)
    at = at[alerts.held(at) >= BURST]
    yield at, ["security_alert_burst"] * len(at)


#: In the order in which an event's flags stand.
RULES = (latency_spike, rejection_surge, consecutive_retries, security_alert_burst)


def detect(events: Events, state: dict[str, list[int]] | None) -> tuple[dict[int, list[str]], dict[str, list[int]]]:
    """(flags of the events that have any, by their place; the series after the stretch)."""
    series = {name: Series(name, events, (state or {}).get(name, [])) for name in SERIES}
    flags: dict[int, list[str]] = {}
    for rule in RULES:
        for at, said in rule(events, series):
            for i, flag in zip(at.tolist(), said, strict=True):
                flags.setdefault(i, []).append(flag)
    return flags, {name: s.kept() for name, s in series.items()}


def merged(state: dict[str, list[int]], further: dict[str, list[int]]) -> dict[str, list[int]]:
    return {name: (state.get(name, []) + further[name])[-SERIES[name][2] :] for name in SERIES}


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """((log_file, segment), rows) of sorted rows, each stretch within one batch."""
    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in ("log_file", "segment")]
        keys = list(zip(*keys, strict=True))
        a = 0
        while a < len(keys):
            b = a + 1
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            yield keys[a], batch.slice(a, b - a)
            a = b


def _row(key: tuple, state: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([json.dumps(state)])], ["log_file", "segment", "state"])


def _state_of(rows: DataFrame) -> DataFrame:
    """(log_file, segment, state): what the series hold of each segment alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for key, part in _stretches(batches):
            if key != now and now is not None:
                yield _row(now, state)
            own = {name: Series(name, Events.of(part), []).kept() for name in SERIES}
            state = merged(state, own) if key == now else own
            now = key
        if now is not None:
            yield _row(now, state)

    sorted_rows = rows.repartition("log_file", "segment").sortWithinPartitions("log_file", "segment", "position")
    return sorted_rows.mapInArrow(run, "log_file string, segment int, state string")


def _carry(state, row):
    """What the series held before each segment of a file."""
    return merged(state or {}, json.loads(row.state)), [(row.log_file, row.segment, json.dumps(state or {}))]


def flagged_events(events: DataFrame) -> DataFrame:
    """(log_file, position, anomaly_flags) of the events that have flags; position is unique within a file.

    A file of more than SEGMENT_ROWS events is cut into segments by ranges of position, which go to several tasks; the series
    of what stands before a segment come to it as a row of its own.
    """
    rows = events.select(F.col("log_file").cast("string").alias("log_file"), F.col("position").cast("long").alias("position"), *FIELDS)
    total, most = rows.groupBy("log_file").count().agg(F.sum("count"), F.max("count")).first()
    if (most or 0) > SEGMENT_ROWS:
        from pyspark.ml.feature import Bucketizer

        parts = min(MOST_SEGMENTS, -(-total // SEGMENT_ROWS))
        rows = rows.withColumn("_place", F.col("position").cast("double"))
        bounds = sorted(set(rows.approxQuantile("_place", [i / parts for i in range(1, parts)], 1 / (4 * parts))))
        cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_place", outputCol="_segment", handleInvalid="keep")
        rows = cut.transform(rows).withColumn("segment", F.col("_segment").cast("int")).drop("_place", "_segment")
        before = in_order(_state_of(rows), "log_file", "segment", _carry, "log_file string, segment int, state string")
    else:
        rows = rows.withColumn("segment", F.lit(0))
        before = rows.sparkSession.createDataFrame([], "log_file string, segment int, state string")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for key, part in _stretches(batches):
            if key != now:
                now, first = key, part.column("state")[0].as_py()
                state = json.loads(first) if first else None
                part = part.slice(1) if first else part
            flags, state = detect(Events.of(part), state)
            if flags:
                at = pa.array(sorted(flags))
                yield pa.RecordBatch.from_arrays(
                    [part.column("log_file").take(at), part.column("position").take(at), pa.array([flags[i] for i in sorted(flags)])],
                    ["log_file", "position", "anomaly_flags"],
                )

    every = rows.withColumn("state", F.lit(None).cast("string")).unionByName(before, allowMissingColumns=True)
    dealt = every.repartition("log_file", "segment").sortWithinPartitions("log_file", "segment", F.col("state").asc_nulls_last(), "position")
    return dealt.mapInArrow(run, "log_file string, position long, anomaly_flags array<string>")
