"""Audit-log analytics: key figures, days, hours, danger levels, detector flags, availability and health.

Events are rows with event_type, ts, session_id, client_ip, response_time_ms, retry_count, scope_check, threat_type,
reason, log_file and an order within the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .detector import flagged_events

SLOW_MS = 60_000


def is_type(*names: str) -> Column:
    return F.col("event_type").isin(*names)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def grouped(rows: DataFrame, by: list[str], latency: Column, definition: str, **sums: Column) -> DataFrame:
    """(by, sums, measured, p95_ms): sums of columns, the latencies that are not null, and their 95th percentile.

    The percentile is the value at a 0-based place in order, floor(0.95 (n - 1)) by P3 and P5, floor(0.95 n) by P2 and
    P4, which needs 5 values. Rows are counted by latency first, so a group holds its different latencies, not its rows.
    """
    per = rows.groupBy(*by, latency.alias("v")).agg(F.count("*").alias("measured"), *[F.sum(c).alias(k) for k, c in sums.items()])
    some = F.col("v").isNotNull()
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in {**{k: F.col(k) for k in sums}, "measured": F.when(some, F.col("measured"))}.items()]
    out = per.groupBy(*by).agg(*counts, F.array_sort(F.collect_list(F.when(some, F.struct("v", F.col("measured").alias("n"))))).alias("values"))
    n = F.col("measured")
    place = F.floor((n - 1) * 95 / 100) if definition in ("P3", "P5") else F.floor(n * 95 / 100)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(dict(per.dtypes)["v"]).alias("v"))

    def step(s: Column, x: Column) -> Column:
        here = (s["seen"] <= place) & (s["seen"] + x["n"] > place)
        return F.struct((s["seen"] + x["n"]).alias("seen"), F.when(here, x["v"]).otherwise(s["v"]).alias("v"))

    value = F.aggregate("values", start, step, lambda s: s["v"])
    return out.withColumn("p95_ms", F.when(n >= 5, value) if definition == "P4" else value).drop("values")


def query_latency() -> Column:
    return F.when(is_type("query"), F.col("response_time_ms"))


def has_flags() -> Column:
    return F.coalesce(F.size("anomaly_flags") > 0, F.lit(False))


def kpi(flagged: DataFrame) -> DataFrame:
    """One row: queries, rejections, rejection_rate, security_alerts, anomalies (events with flags), p95_ms; rates are
    not rounded."""
    kinds = {
        "queries": flag(is_type("query")), "rejections": flag(is_type("rejection")), "security_alerts": flag(is_type("security_alert")),
        "anomalies": flag(has_flags()),
    }
    rate = F.col("rejections") / F.greatest(F.col("queries") + F.col("rejections"), F.lit(1))
    return grouped(flagged, [], query_latency(), "P4", **kinds).select("queries", "rejections", rate.alias("rejection_rate"), "security_alerts", "anomalies", "p95_ms")


def per_day(flagged: DataFrame, day: Column) -> DataFrame:
    """One row a day: anomalies are queries with flags, and the mean latency is cut to an integer, null without any."""
    q, r = count_if(is_type("query")), count_if(is_type("rejection"))
    mean = F.floor(F.avg(F.when(is_type("query"), F.col("response_time_ms"))))
    return flagged.groupBy(day.alias("day")).agg(
        q.alias("queries"), r.alias("rejections"), count_if(is_type("security_alert")).alias("security_alerts"),
        count_if(is_type("query") & has_flags()).alias("anomalies"), mean.cast("long").alias("avg_latency_ms"),
        (r / F.greatest(q + r, F.lit(1))).alias("rejection_rate"),
    )


#: Offset of the local time of timestamps that name none, and of hours that are shown.
LOCAL = "+08:00"


def parsed_time(value: Column) -> Column:
    """A timestamp from epoch seconds or ISO text, null for anything else; text without an offset is in LOCAL time."""
    t = F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", "")
    iso = t.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:\d\d)?)?$")
    whole = F.when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00"))).otherwise(t)
    zoned = F.when(whole.rlike(r"(Z|[+-]\d\d:\d\d)$"), whole).otherwise(F.concat(whole, F.lit(LOCAL)))
    number = F.when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), t.try_cast("double").try_cast("timestamp"))
    return F.coalesce(number, F.when(iso, zoned.try_cast("timestamp")))


def local_hour(ts: Column) -> Column:
    return F.date_trunc("hour", F.from_utc_timestamp(ts, LOCAL))


def latency_status(p95_ms: Column) -> Column:
    return (
        F.when(p95_ms.isNull(), "no_data").when(p95_ms <= 40_000, "normal").when(p95_ms <= 50_000, "watch")
        .when(p95_ms <= 60_000, "warning").otherwise("critical")
    )


def hourly_status(events: DataFrame, end: Column, hours: int = 24) -> DataFrame:
    """(hour, queries, p95_ms, status, latest) of the last hours up to the one of `end`, without gaps, in LOCAL time.

    Only queries with a latency count. latest marks the newest hour that has any, or else the last one. `ts` is in UTC.
    """
    base = events.agg(local_hour(end).alias("last")).select(
        F.explode(F.sequence(F.col("last") - F.make_dt_interval(hours=F.lit(hours - 1)), F.col("last"), F.expr("interval 1 hour"))).alias("hour")
    )
    queries = events.where(is_type("query") & F.col("response_time_ms").isNotNull()).withColumn("hour", local_hour(F.col("ts")))
    seen = grouped(queries, ["hour"], F.col("response_time_ms"), "P3", queries=F.lit(1)).drop("measured")
    out = base.join(seen, "hour", "left").select("hour", F.coalesce("queries", F.lit(0)).alias("queries"), "p95_ms")
    # a window over `hours` rows
    newest = F.coalesce(F.max(F.when(F.col("queries") > 0, F.col("hour"))).over(Window.partitionBy(F.lit(0))), F.max("hour").over(Window.partitionBy(F.lit(0))))
    return out.select("*", latency_status(F.col("p95_ms")).alias("status"), (F.col("hour") == newest).alias("latest"))


def safety_summary(events: DataFrame) -> DataFrame:
    """(event_type, kind, n): security alerts by threat, rejections and failed logins by reason, with their defaults."""
    name = (
        F.when(is_type("security_alert"), F.coalesce(F.nullif("threat_type", F.lit("")), F.lit("unknown")))
        .when(is_type("rejection"), F.coalesce(F.nullif("reason", F.lit("")), F.lit("out_of_scope")))
        .otherwise(F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown")))
    )
    return events.where(is_type("security_alert", "rejection", "auth_failure")).groupBy("event_type", name.alias("kind")).agg(F.count("*").alias("n"))


def flag_kind(flag: Column) -> Column:
    return F.get(F.split(flag, ":"), F.lit(0))


def anomaly_summary(flagged: DataFrame, most: int = 20) -> DataFrame:
    """(kind, n) of the most frequent flags; equal counts in the order in which they first occur."""
    rows = flagged.select("position", F.explode("anomaly_flags").alias("flag"))
    kinds = rows.groupBy(flag_kind(F.col("flag")).alias("kind")).agg(F.count("*").alias("n"), F.min("position").alias("first"))
    return kinds.orderBy(F.desc("n"), "first").limit(most).select("kind", "n")


def danger_level(flags: Column | None = None) -> Column:
    flags = F.array().cast("array<string>") if flags is None else flags
    burst = F.exists(flags, lambda f: f.contains("security_alert_burst"))
    return (
        F.when(is_type("security_alert"), "critical").when(is_type("auth_failure"), "warning").when(burst, "critical")
        .when(F.size(flags) > 0, "warning").when(is_type("query") & (F.col("response_time_ms") > SLOW_MS), "warning").otherwise("normal")
    )


def danger_reason(flags: Column | None = None) -> Column:
    flags = F.array().cast("array<string>") if flags is None else flags
    said = lambda *names: F.coalesce(*[F.nullif(n, F.lit("")) for n in names])
    return (
        F.when(is_type("security_alert"), F.coalesce(said("threat_type", "reason"), F.lit("security alert")))
        .when(is_type("auth_failure"), F.coalesce(said("reason"), F.lit("auth failure"))).when(F.size(flags) > 0, F.array_join(flags, ", "))
        .when(is_type("query") & (F.col("response_time_ms") > SLOW_MS), F.concat(F.lit("latency "), F.col("response_time_ms"), F.lit(" ms"))).otherwise("")
    )


# The fields of an event that a free-text search looks at, besides its metadata.
SEARCHED = (
    "event_type", "session_id", "request_id", "openai_response_id", "client_ip", "source_app", "frontend_session_id", "frontend_user_id", "frontend_chat_id",
    "frontend_message_id", "user_query", "model_response", "reason", "threat_type", "prompt_baseline", "prompt_version_hash",
)
_STRING = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")([,:]?)|([,:])'


def spaced_json(value: Column) -> Column:
    """A map, struct or VARIANT as JSON with a space after each comma and colon outside strings."""
    marked = F.regexp_replace(F.to_json(value), _STRING, "$1$2$3\u0001")
    return F.replace(F.replace(marked, F.lit('"\u0001'), F.lit('"')), F.lit("\u0001"), F.lit(" "))


def said_by(events: DataFrame, columns: tuple[str, ...] | None = None, metadata: str = "frontend_metadata") -> list[Column]:
    """What a free-text search looks at: SEARCHED, as far as events have them, and the JSON of the metadata; or `columns`."""
    have = {f.name: f.dataType for f in events.schema.fields}
    shown = [F.col(c).cast("string") for c in (SEARCHED if columns is None else columns) if c in have]
    if columns is None and metadata in have:
        meta = F.col(metadata)
        if isinstance(have[metadata], T.StringType):
            shown.append(meta)
        else:
            shown.append(F.when(F.size(meta) > 0, spaced_json(meta)) if isinstance(have[metadata], T.MapType) else spaced_json(meta))
    return shown


#: Different trigrams that the index of a log file tells apart.
GRAMS = 1 << 16


def _grams(text: Column) -> Column:
    """The trigrams of a lower-cased text, as numbers below GRAMS."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1))
    return F.transform(found, lambda g: F.pmod(F.xxhash64(g), F.lit(GRAMS)).cast("int"))


def text_index(events: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """(log_file, gram): the trigrams that the searched fields of a log file have, at most GRAMS rows a file. To be stored, and
    appended to as files come."""
    grams = F.array_distinct(F.flatten(F.array(*[F.coalesce(_grams(c), F.array().cast("array<int>")) for c in said_by(events, columns)])))
    return events.select("log_file", F.explode(grams).alias("gram")).distinct()


def files_that_may_say(index: DataFrame, text: str) -> DataFrame | None:
    """(log_file): the files that have all trigrams of a text; no other file says it. None for a text of fewer than three signs."""
    if len(text) < 3:
        return None
    asked = index.sparkSession.range(1).select(F.explode(F.array_distinct(_grams(F.lit(text)))).alias("gram"))
    asked = F.broadcast(asked.withColumn("all", F.count("*").over(Window.partitionBy(F.lit(0)))))
    per = index.join(asked, "gram").groupBy("log_file").agg(F.countDistinct("gram").alias("n"), F.first("all").alias("all"))
    return per.where("n = all").select("log_file")


def says(events: DataFrame, text: str, columns: tuple[str, ...] | None = None, metadata: str = "frontend_metadata") -> Column:
    """Whether a field of an event, or the JSON of its metadata, contains the text in either case; an empty text is in all."""
    if not text:
        return F.lit(True)
    hit = F.lit(False)
    for c in said_by(events, columns, metadata):
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return hit


def search(
    events: DataFrame, limit: int = 100, danger_only: bool = False, text: str = "", columns: tuple[str, ...] | None = None,
    start: str = "", end: str = "", index: DataFrame | None = None, **exact,
) -> DataFrame:
    """Events that meet all conditions, the latest first, at most 1000: equality on event_type, substring otherwise.

    `text` is looked for in SEARCHED and in the metadata, or in `columns`; with an `index` (text_index of the same fields) only in
    the files that may have it. An event without a readable timestamp is outside
    any bound. Timestamps are put in order as text.
    """
    at = parsed_time(F.col("timestamp"))
    if start:
        events = events.where(at >= parsed_time(F.lit(start)))
    if end:
        events = events.where(at <= parsed_time(F.lit(end)))
    for name, value in exact.items():
        events = events.where(F.col(name) == value if name == "event_type" else F.col(name).contains(value))
    if danger_only:
        events = events.where(F.col("danger_level") != "normal")
    files = files_that_may_say(index, text) if index is not None else None
    if files is not None:
        events = events.join(F.broadcast(files), "log_file", "left_semi")
    events = events.where(says(events, text, columns))
    return events.orderBy(F.desc("timestamp"), "log_file", "position").limit(max(1, min(limit, 1000)))


def perf_signals(events: DataFrame, baseline_ms: float | None = None) -> DataFrame:
    """One row: rates over queries and rejections, mean and p95 latency, and the mean's change as a part of a baseline.

    Citations are counted over the queries in scope; citation_count and scope_check are columns of events.
    """
    late, q, r, mean = query_latency(), F.col("q"), F.col("r"), F.try_divide("total_ms", "measured")
    delta = F.when(mean != 0, (mean - F.lit(baseline_ms)) / F.greatest(F.lit(baseline_ms), F.lit(1.0))) if baseline_ms is not None else F.lit(None).cast("double")
    inside = is_type("query") & (F.col("scope_check") == "in_scope")
    counts = grouped(
        events, [], late, "P4", q=flag(is_type("query")), r=flag(is_type("rejection")), total_ms=late, inside=flag(inside),
        cited=flag(inside & (F.col("citation_count") > 0)), retried=flag(is_type("query") & (F.col("retry_count") > 0)), alerts=flag(is_type("security_alert")),
    )
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.select(
        q.alias("queries"), part(r, q + r).alias("rejection_rate"), mean.alias("avg_latency_ms"), "p95_ms", delta.alias("avg_latency_delta"),
        part(F.col("cited"), F.col("inside")).alias("citation_rate"), part(F.col("retried"), q).alias("retry_rate"),
        part(F.col("alerts"), q + r).alias("security_rate"),
    )


def detector_flags(events: DataFrame) -> DataFrame:
    """events with anomaly_flags of the detector, which starts anew with each file; see detector.flagged_events."""
    found = flagged_events(events).select(F.col("log_file").alias("_file"), F.col("position").alias("_place"), F.col("anomaly_flags"))
    same = F.col("log_file").eqNullSafe(F.col("_file")) & (F.col("position") == F.col("_place"))
    flags = F.coalesce("anomaly_flags", F.array().cast("array<string>"))
    rows = events.drop("anomaly_flags").join(found, same, "left")
    return rows.withColumn("anomaly_flags", flags).drop("_file", "_place")


def file_stats(flagged: DataFrame) -> DataFrame:
    """One row a log file. The rate is rejections over queries, null without queries; the mean is cut to an integer."""
    late = query_latency()
    counts = grouped(
        flagged, ["log_file"], late, "P2", events=F.lit(1), queries=flag(is_type("query")), rejections=flag(is_type("rejection")),
        security_alerts=flag(is_type("security_alert")), anomalous=flag(has_flags()), total_ms=late,
    )
    return counts.select(
        "log_file", "events", "queries", "rejections", "security_alerts", "anomalous", F.try_divide("rejections", "queries").alias("rejection_rate"),
        F.floor(F.try_divide("total_ms", "measured")).cast("long").alias("avg_latency_ms"), "p95_ms",
    )


def flag_counts(flagged: DataFrame) -> DataFrame:
    """(log_file, kind, n): the flags of each kind in each file."""
    kinds = flagged.select("log_file", F.explode("anomaly_flags").alias("flag"))
    return kinds.groupBy("log_file", flag_kind(F.col("flag")).alias("kind")).agg(F.count("*").alias("n"))


def days_rollup(stats: DataFrame) -> DataFrame:
    """Totals over file_stats; the latency is the mean of the daily means that are not 0."""
    return stats.agg(
        F.count("*").alias("days"), F.sum("queries").alias("queries"), F.sum("rejections").alias("rejections"),
        F.floor(F.avg(F.when(F.col("avg_latency_ms") > 0, F.col("avg_latency_ms")))).cast("long").alias("avg_daily_latency_ms"),
        F.try_divide(F.sum("rejections"), F.sum("queries")).alias("rejection_rate"),
    )


def failure_runs(probes: DataFrame, threshold: int = 3, by: str = "series") -> DataFrame:
    """Probes at which the failures in a row reach the threshold; a success starts the count anew."""
    along = Window.partitionBy(by).orderBy("position")
    island = F.sum(F.col("ok").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = probes.withColumn("island", island)
    run = F.sum((~F.col("ok")).cast("long")).over(Window.partitionBy(by, "island").orderBy("position"))
    return rows.withColumn("failures", run).where((F.col("failures") >= threshold) & ~F.col("ok")).drop("island")


def availability(probes: DataFrame, tail: int = 3, by: str = "series") -> DataFrame:
    """(series, probes, uptime_pct, recent_ok_pct, current_ok, last_ok, hard_down): last_ok is the position of the last
    probe that succeeded, and hard_down is a tail of three probes or more that all failed."""
    latest = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("position")))
    rows = probes.withColumn("nth", latest)
    recent = F.avg(F.when(F.col("nth") <= tail, F.col("ok").cast("double"))) * 100
    return rows.groupBy(by).agg(
        F.count("*").alias("probes"), (F.avg(F.col("ok").cast("double")) * 100).alias("uptime_pct"), recent.alias("recent_ok_pct"),
        F.bool_or(F.when(F.col("nth") == 1, F.col("ok"))).alias("current_ok"), F.max(F.when(F.col("ok"), F.col("position"))).alias("last_ok"),
        ((F.least(F.count("*"), F.lit(tail)) >= 3) & (recent == 0)).alias("hard_down"),
    )


def dependency_uptime(probes: DataFrame, by: str = "series") -> DataFrame:
    """(series, dependency, probes, uptime_pct) of probes with a map per_dep from names to whether they answered, or to
    structs that say so in ok."""
    each = probes.select(by, F.explode("per_dep").alias("dependency", "up"))
    if isinstance(each.schema["up"].dataType, T.StructType):
        each = each.withColumn("up", F.col("up.ok"))
    return each.groupBy(by, "dependency").agg(F.count("*").alias("probes"), (F.avg(F.coalesce("up", F.lit(False)).cast("double")) * 100).alias("uptime_pct"))


def latency_score(ms: Column) -> Column:
    s = ms / 1000
    return F.when(s <= 40, s / 40 * 25).when(s <= 60, 25 + (s - 40) / 20 * 50).when(s.isNotNull(), F.least(F.lit(100.0), 75 + (s - 60) / 40 * 25))


def faithfulness_score(f: Column) -> Column:
    return (
        F.when(f >= 0.9, 0.0).when(f >= 0.8, (0.9 - f) / 0.1 * 50).when(f >= 0.65, 50 + (0.8 - f) / 0.15 * 25)
        .when(f.isNotNull(), F.least(F.lit(100.0), 75 + (0.65 - f) / 0.65 * 100))
    )


def availability_score(u: Column) -> Column:
    return (
        F.when(u >= 99, (100 - u) * 24).when(u >= 95, 24 + (99 - u) / 4 * 51)
        .when(u.isNotNull(), F.least(F.lit(100.0), 75 + (95 - u) / 95 * 100))
    )


def score_level(score: Column) -> Column:
    return F.when(score < 25, "normal").when(score < 50, "watch").when(score < 75, "warning").otherwise("critical")


def health(signals: DataFrame, least_queries: int = 30) -> DataFrame:
    """signals (p95_ms, queries, faithfulness, uptime_pct, recent_ok_pct, hard_down, chain_broken) with score, severity."""
    scores = [
        F.when(F.col("queries") >= least_queries, latency_score(F.col("p95_ms"))), faithfulness_score(F.col("faithfulness")),
        availability_score(F.coalesce("recent_ok_pct", "uptime_pct")),
    ]
    top = F.array_max(F.array(*[s.cast("double") for s in scores]))
    override = F.coalesce("hard_down", F.lit(False)) | F.coalesce("chain_broken", F.lit(False))
    severity = F.when(override, "critical").when(top.isNull(), "insufficient_data").otherwise(score_level(top))
    return signals.withColumn("score", F.coalesce(top, F.lit(0.0))).withColumn("severity", severity)


def admitted(requests: DataFrame, limit: int = 60) -> DataFrame:
    """requests with nth (its place in its key's minute) and admitted: at most `limit` a key and calendar minute."""
    minute = F.date_trunc("minute", "ts")
    nth = F.row_number().over(Window.partitionBy("key", minute).orderBy("ts", "position"))
    return requests.withColumn("nth", nth).withColumn("admitted", F.col("nth") <= limit)


def alert_counts(alerts: DataFrame) -> DataFrame:
    """(severity, n): info, warning and critical always, other severities if they occur."""
    base = alerts.sparkSession.createDataFrame([("info",), ("warning",), ("critical",)], "severity string")
    return base.join(alerts.groupBy("severity").agg(F.count("*").alias("n")), "severity", "full").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


# The severity of an alert by the kind of its flag; any other kind is info.
FLAG_SEVERITY = {
    "latency_spike": "warning", "rejection_surge": "warning", "security_alert_burst": "critical", "consecutive_retries": "info",
    "stream_output_redacted": "warning",
}


def flag_alerts(flagged: DataFrame) -> DataFrame:
    """An alert for each flag of each event: severity, title, message, dedup_key and what the event says."""
    rows = flagged.withColumn("flag", F.explode("anomaly_flags")).withColumn("title", flag_kind(F.col("flag")))
    severity = F.create_map(*[F.lit(x) for kv in FLAG_SEVERITY.items() for x in kv])
    return rows.select(
        F.coalesce(F.try_element_at(severity, F.col("title")), F.lit("info")).alias("severity"), F.lit("anomaly").alias("source"), "title",
        F.concat(F.lit("audit anomaly: "), F.col("flag")).alias("message"),
        F.concat_ws(":", F.lit("anomaly"), "title", F.coalesce("session_id", F.lit("?"))).alias("dedup_key"), "log_file", "position", "ts",
    )


def recent_alerts(alerts: DataFrame, since: Column, most: int = 50) -> DataFrame:
    """The last alerts of the log (ts, position) from `since` on, the latest line first."""
    return alerts.where(F.col("ts") >= since).orderBy(F.desc("position")).limit(most)


def prompt_status(events: DataFrame, running: DataFrame) -> DataFrame:
    """events with prompt_status: how a query's prompt compares with the running one (one row: available, baseline, hash)."""
    one = F.broadcast(running.limit(1).select(
        F.coalesce("available", F.lit(False)).alias("run_available"), F.coalesce("baseline", F.lit("")).alias("run_baseline"), F.coalesce("hash", F.lit("")).alias("run_hash")
    ))
    log, base = F.coalesce("prompt_version_hash", F.lit("")), F.coalesce("prompt_baseline", F.lit(""))
    status = (
        F.when(~is_type("query"), "not_applicable").when(~F.coalesce("run_available", F.lit(False)), "unavailable").when(log == "", "missing")
        .when((log != F.col("run_hash")) | ((base != "") & (base != F.col("run_baseline"))), "mismatch").when(base == "", "match_legacy").otherwise("match")
    )
    return events.join(one, F.lit(True), "left").withColumn("prompt_status", status).drop("run_available", "run_baseline", "run_hash")


def last_per_key(rows: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """(key, columns): of each key the row that comes last in order, combined before the shuffle."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("last"))
    return last.select(key, *[F.col(f"last.{c}").alias(c) for c in columns])


def business_goal(reports: DataFrame, target: float = 0.9) -> DataFrame:
    """reports (evaluated, hit_rate) with goal: met, not_met, or inconclusive without a rate or anything evaluated."""
    hit = F.col("hit_rate")
    goal = F.when(hit.isNull() | (F.coalesce("evaluated", F.lit(0)) == 0), "inconclusive").when(hit >= target, "met").otherwise("not_met")
    return reports.withColumn("goal", goal)


def operation_status(signals: DataFrame) -> DataFrame:
    """signals (critical, warning: recent alerts of operation; security_alerts, anomalies, goal, severity) with the status
    of operation, quality and service, and the worst of them; of equals the first counts."""
    operation = (
        F.when(F.col("critical") > 0, "critical").when((F.col("warning") > 0) | (F.col("security_alerts") > 0), "warning")
        .when(F.col("anomalies") > 0, "watch").otherwise("ok")
    )
    quality = F.when(F.col("goal") == "met", "ok").when(F.col("goal") == "not_met", "warning").otherwise("watch")
    service = F.when(F.col("severity").isin("watch", "warning", "critical"), F.col("severity")).when(F.col("severity") == "insufficient_data", "watch").otherwise("ok")
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in ("ok", "watch", "warning", "critical")]), c)
    a, b, c = (rank(F.col(x)) for x in ("operation", "quality", "service"))
    worst = F.when((a >= b) & (a >= c), "operation").when(b >= c, "quality").otherwise("service")
    rows = signals.withColumns({"operation": operation, "quality": quality, "service": service}).withColumn("worst", worst)
    return rows.withColumn("overall", F.when(F.col("worst") == "operation", F.col("operation")).when(F.col("worst") == "quality", F.col("quality")).otherwise(F.col("service")))


def banner(critical: Column, warning: Column, health: Column) -> Column:
    """State of the alert banner: a past critical alert counts as a warning once the service is healthy again."""
    healthy = health.isin("normal", "insufficient_data")
    return F.when((critical > 0) & ~healthy, "critical").when((critical > 0) | (warning > 0), "warning").otherwise("calm")


def stale(generated_at: Column, now: Column, days: int) -> Column:
    """Whether a report is more than so many whole days old; without a readable time it is."""
    age = F.floor((F.unix_micros(now) - F.unix_micros(parsed_time(generated_at))) / 86_400_000_000)
    return F.coalesce(age > days, F.lit(True))
