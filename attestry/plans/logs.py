"""Queries over logs as text, built from the table of events, and what is kept of them between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import correlate as L, monitor as M, records as C
from ..schemas import AUDIT_EVENT, PROBE
from ..sources.files import parsed_lines
from .queries import audit, query, table


def mixed_lines(spark, sf_dir) -> DataFrame:
    """(value): a log line for each event, with fields of several types, and lines that are malformed or no object."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").withColumn("v", F.floor(F.col("value") * 100).cast("long"))
    head = F.concat(F.lit('{"request_id": "'), e.cast("string"), F.lit('", "event_type": "'), F.col("event_type"), F.lit('", '))
    v = F.col("v").cast("string")
    tail = (
        F.when(e % 10 == 0, F.concat(F.lit('"response_time_ms": '), v, F.lit(', "retry_count": 1}')))
        .when(e % 10 == 1, F.concat(F.lit('"response_time_ms": '), v, F.lit('.5, "retry_count": 2}')))
        .when(e % 10 == 2, F.lit('"response_time_ms": true, "retry_count": 3.0}'))
        .when(e % 10 == 3, F.concat(F.lit('"retry_count": "2", "session_id": '), F.col("user_id").cast("string"), F.lit("}")))
        .when(e % 10 == 4, F.concat(F.lit('"response_time_ms": '), v))  # cut off
        .when(e % 10 == 5, F.lit('"anomaly_flags": ["a", 1, null, {"b": [2]}], "frontend_metadata": {"c": {"d": "x, y: z"}, "e": "f", "n": 1}}'))
        .when(e % 10 == 6, F.concat(F.lit('"response_time_ms": 1, "response_time_ms": '), v, F.lit("}")))
        .when(e % 10 == 7, F.lit('"retry_count": 1} {"retry_count": 2}'))
        .when(e % 10 == 8, F.lit('"response_time_ms": null, "user_notified": 1, "wrapper_mode": true, "anomaly_flags": "none"}'))
        .otherwise(F.lit('"response_time_ms": 123456789012345678901234567890, "session_id": [1]}'))
    )
    line = F.when(e % 97 == 0, F.lit(" \t")).when(e % 89 == 0, F.lit("[1, 2]")).otherwise(F.concat(F.when(e % 3 == 0, F.lit("  ")).otherwise(F.lit("")), head, tail))
    return rows.select(line.alias("value"))


MIXED = """SELECT event_id, event_type, CAST(floor(value * 100) AS BIGINT) AS v, user_id, event_id % 10 AS form FROM events
    WHERE event_id % 10 NOT IN (4, 7) AND event_id % 97 <> 0 AND event_id % 89 <> 0"""


@query(f"""SELECT CAST(event_id AS VARCHAR) AS request_id, event_type, CASE form WHEN 0 THEN v WHEN 2 THEN 1 WHEN 6 THEN v END AS response_time_ms,
    CASE form WHEN 0 THEN 1 WHEN 1 THEN 2 END AS retry_count, CASE form WHEN 3 THEN CAST(user_id AS VARCHAR) WHEN 9 THEN '[1]' END AS session_id,
    CASE WHEN form = 5 THEN 'a|1|{{"b":[2]}}' END AS flags, CASE WHEN form = 5 THEN '{{"d":"x, y: z"}}' END AS c, CASE WHEN form = 8 THEN TRUE END AS wrapper_mode, CAST(NULL AS BOOLEAN) AS user_notified
    FROM ({MIXED})""")
def sc2_mixed_log(spark, sf_dir):
    rows = parsed_lines(mixed_lines(spark, sf_dir), AUDIT_EVENT)
    return rows.select(
        "request_id", "event_type", "response_time_ms", "retry_count", "session_id", F.array_join("anomaly_flags", "|").alias("flags"),
        F.try_element_at("frontend_metadata", F.lit("c")).alias("c"), "wrapper_mode", "user_notified",
    )


@query(f"""SELECT event_type, count(*) AS events, count(*) FILTER (form IN (0, 2, 6)) AS measured, CAST(sum(CASE form WHEN 0 THEN v WHEN 2 THEN 1 WHEN 6 THEN v END) AS BIGINT) AS total_ms,
    count(*) FILTER (form = 1) AS retried FROM ({MIXED}) GROUP BY 1""")
def f6_latency_validity(spark, sf_dir):
    """Which latencies count: integers, true as 1, and no others."""
    rows = parsed_lines(mixed_lines(spark, sf_dir), AUDIT_EVENT)
    return rows.groupBy("event_type").agg(
        F.count("*").alias("events"), F.count("response_time_ms").alias("measured"), F.sum("response_time_ms").alias("total_ms"),
        M.count_if(F.col("retry_count") >= 2).alias("retried"),
    )


@query("""SELECT series, dependency, count(*) AS probes, avg(CAST(coalesce(up, FALSE) AS DOUBLE)) * 100 AS uptime_pct FROM (
        SELECT session_id AS series, 'db' AS dependency, k % 2 = 0 AS up FROM ev UNION ALL SELECT session_id, 'model', k % 3 = 0 FROM ev WHERE k % 5 <> 0
        UNION ALL SELECT session_id, 'cache', FALSE FROM ev WHERE k % 7 = 0) GROUP BY ALL""")
def a21_dependency_probes(spark, sf_dir):
    """Probes as lines of a log: a dependency has ok, detail and time, or says nothing of use."""
    k = F.col("k")
    one = lambda name, ok: F.concat(F.lit(f'"{name}": {{"ok": '), ok.cast("string"), F.lit(', "detail": null, "rtt_ms": '), F.coalesce(k, F.lit(0)).cast("string"), F.lit("}"))
    both = F.concat_ws(
        ", ", F.coalesce(one("db", k % 2 == 0), F.lit('"db": {}')), F.when(k % 5 != 0, one("model", k % 3 == 0)), F.when(k % 7 == 0, F.lit('"cache": {"ok": "yes", "rtt_ms": "slow"}')),
    )
    lines = audit(spark, sf_dir).select(F.col("session_id").alias("series"), F.concat(F.lit('{"overall_ok": true, "per_dep": {'), both, F.lit("}}")).alias("value"))
    return M.dependency_uptime(parsed_lines(lines, PROBE))


@query("""SELECT position FROM ev WHERE contains(lower('asks about item ' || coalesce(CAST(k AS VARCHAR), '')), 'item 7')
    OR contains(session_id, 'item 7') OR contains(coalesce(threat_type, ''), 'item 7') OR k % 11 = 3""")
def f3_free_text(spark, sf_dir):
    """Events whose fields or metadata say `Item 7`: a string of it, or a key and a value with what stands between."""
    k = F.col("k")
    rows = audit(spark, sf_dir).withColumns({
        "user_query": F.concat(F.lit("Asks about ITEM "), F.coalesce(k.cast("string"), F.lit(""))), "client_ip": F.lit("10.0.0.1"),
        "frontend_metadata": F.when(k % 11 == 3, F.create_map(F.lit("list"), F.lit('an "item" or item 7'))).when(k % 11 == 4, F.create_map(F.lit("item"), F.lit("7"))),
    })
    return rows.where(M.says(rows, "Item 7")).select("position")


@query("""SELECT position FROM ev WHERE k % 11 = 4 OR k % 11 = 5""")
def f3_metadata_dump(spark, sf_dir):
    """The metadata as JSON with its punctuation: a needle over a key and its value, and none within a string."""
    k = F.col("k")
    rows = audit(spark, sf_dir).withColumn("frontend_metadata", (
        F.when(k % 11 == 4, F.create_map(F.lit("item"), F.lit("7"))).when(k % 11 == 5, F.create_map(F.lit("a"), F.lit("x\\\""), F.lit("Item"), F.lit("70")))
        .when(k % 11 == 6, F.create_map(F.lit("a"), F.lit('item":"7'))).when(k % 11 == 7, F.create_map(F.lit("item"), F.lit(" 7")))
    ))
    return rows.where(M.says(rows, '"item": "7')).select("position")


@query("""SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'http_api' WHEN 2 THEN 'openwebui' WHEN 3 THEN 'openwebui' ELSE 'unknown' END AS source_app,
    CASE page_id % 6 WHEN 1 THEN 'user-agent=' || repeat('u', CAST(least(300, page_id) AS BIGINT)) WHEN 2 THEN 'origin=https://OpenWebUI.example' WHEN 3 THEN 'x-openwebui-user-role=admin' ELSE '' END AS kept FROM pages""")
def z1_listed_headers(spark, sf_dir):
    """Requests with headers that are not among those that say where a request came from, or that are empty or long."""
    i = F.col("page_id")
    one = lambda name, value: F.create_map(F.lit(name), value, F.lit("accept"), F.lit("*/*"))
    headers = (
        F.when(i % 6 == 0, F.create_map(F.lit("accept"), F.lit("*/*"))).when(i % 6 == 1, one("user-agent", F.repeat(F.lit("u"), i.cast("int"))))
        .when(i % 6 == 2, one("origin", F.lit("https://OpenWebUI.example"))).when(i % 6 == 3, one("x-openwebui-user-role", F.lit("admin")))
        .when(i % 6 == 4, one("x-openwebui-chat-id", F.lit(""))).otherwise(F.create_map(F.lit("x-openwebui-other"), F.lit("1")))
    )
    rows = C.request_context(table(spark, sf_dir, "pages").select("page_id", headers.alias("headers")))
    kept = F.array_join(F.transform(F.map_entries("frontend_metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("page_id", "source_app", kept.alias("kept"))


@query("""SELECT event_id, chat_id, CAST(place AS INT) AS place FROM (
        SELECT event_id, chat_id, row_number() OVER (PARTITION BY event_id ORDER BY updated DESC, chat_id) AS place FROM (
            SELECT item_id AS event_id, item_id * 300 AS moment, lower(substr(text, 1, CASE WHEN item_id % 2 = 0 THEN 5 ELSE 14 END)) AS q FROM benchmark) b
        JOIN (SELECT doc_id AS chat_id, doc_id // 2 * 60 AS updated, lower(text) AS t FROM documents ORDER BY doc_id // 2 * 60 DESC, doc_id LIMIT 500) d
        ON contains(t, q) AND (length(q) >= 12 OR abs(moment - updated) <= 900) WHERE q <> '') WHERE place <= 5""")
def j8_chats_in_time(spark, sf_dir):
    """Chats by short queries, which need a chat of about the same time, and by longer ones; ties in time."""
    i, d = F.col("item_id"), F.col("doc_id")
    events = table(spark, sf_dir, "benchmark").select(i.alias("event_id"), F.timestamp_seconds(i * 300).alias("at"), F.substring("text", F.lit(1), F.when(i % 2 == 0, 5).otherwise(14)).alias("query"))
    chats = table(spark, sf_dir, "documents").select(d.alias("chat_id"), F.timestamp_seconds(F.floor(d / 2) * 60).alias("updated_at"), F.array("text").alias("strings"))
    return L.by_text(events, chats).select("event_id", "chat_id", "place")


@query("""SELECT session_id, CASE WHEN n % 5 = 0 OR n % 7 = 0 THEN 'critical' WHEN n % 3 = 0 THEN 'insufficient_data' WHEN s < 25 THEN 'normal' WHEN s < 50 THEN 'watch' WHEN s < 75 THEN 'warning' ELSE 'critical' END AS severity
    FROM (SELECT session_id, count(*) AS n, CASE WHEN (count(*) % 60)::DOUBLE <= 40 THEN (count(*) % 60) / 40 * 25 ELSE 25 + ((count(*) % 60) - 40) / 20 * 50 END AS s FROM ev GROUP BY 1)""")
def m13_health_overrides(spark, sf_dir):
    """Health where a series is down or a chain is broken, whatever the scores say, or where nothing can be scored."""
    n, none = F.col("n"), F.lit(None).cast("double")
    rows = audit(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n")).select(
        "session_id", F.when(n % 3 > 0, n % 60 * 1000).alias("p95_ms"), F.lit(30).alias("queries"), none.alias("faithfulness"), none.alias("uptime_pct"),
        none.alias("recent_ok_pct"), F.when(n % 2 == 0, n % 5 == 0).otherwise(F.when(n % 5 == 0, True)).alias("hard_down"), F.when(n % 7 == 0, True).alias("chain_broken"),
    )
    return M.health(rows).select("session_id", "severity")
