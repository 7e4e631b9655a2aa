"""Queries over the driver's tables, and the same in DuckDB SQL.

The tables hold no audit log, so EVENTS maps the table of events to one, in both dialects: clicks, views and purchases
are queries, sign-ups rejections, errors security alerts. Rows are ordered by time and event_id within a day's file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import hosts as H, split as S, text as X
from ..operators import answers as A, compare as C, correlate as L, evaluate as E, integrity as I, monitor as M, retrieve as R, scoring as SC

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EVENTS = """
    ev AS (
        SELECT *, CAST(k % 8 AS VARCHAR) AS threat_type, CASE WHEN event_type = 'query' THEN v END AS response_time_ms,
               k % 3 AS retry_count, k % 4 AS citation_count,
               CASE WHEN event_type = 'query' THEN CASE WHEN k % 9 < 5 THEN 'in_scope' ELSE 'out_of_scope' END END AS scope_check
        FROM (
            SELECT epoch_us(ts) * 1000 + event_id % 1000 AS position, ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS log_file,
                   CAST(user_id AS VARCHAR) AS session_id,
                   CASE event_type WHEN 'signup' THEN 'rejection' WHEN 'error' THEN 'security_alert' ELSE 'query' END AS event_type,
                   CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value * 100) AS BIGINT) AS v
            FROM events
        )
    )
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_view(events: DataFrame) -> DataFrame:
    """The table of events as an audit log."""
    kind = F.when(F.col("event_type") == "signup", "rejection").when(F.col("event_type") == "error", "security_alert").otherwise("query")
    k = F.get_json_object("props", "$.k").cast("long")
    ts = F.col("ts").cast("timestamp")
    rows = events.select(
        (F.unix_micros(ts) * 1000 + F.col("event_id") % 1000).alias("position"), ts.alias("ts"), F.to_date(ts).cast("string").alias("log_file"),
        F.col("user_id").cast("string").alias("session_id"), kind.alias("event_type"), k.alias("k"), F.floor(F.col("value") * 100).cast("long").alias("v"),
    )
    query = F.col("event_type") == "query"
    return rows.withColumns({
        "threat_type": (F.col("k") % 8).cast("string"), "reason": F.lit(None).cast("string"), "response_time_ms": F.when(query, F.col("v")),
        "retry_count": F.col("k") % 3, "citation_count": F.col("k") % 4, "scope_check": F.when(query, F.when(F.col("k") % 9 < 5, "in_scope").otherwise("out_of_scope")), "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    }).drop("v")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_view(table(spark, sf_dir, "events"))


def query(sql: str | None = None):
    """Registers a query and its SQL under the function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {EVENTS.strip()} {sql}" if sql.lstrip().startswith((",", "SELECT")) and " ev" in sql else sql
        return f

    return add


P4 = "CASE WHEN count(response_time_ms) >= 5 THEN list_sort(list(response_time_ms) FILTER (response_time_ms IS NOT NULL))[count(response_time_ms) * 95 // 100 + 1] END"


FLAGS = """, w AS (
        SELECT *, list(response_time_ms) OVER (PARTITION BY log_file, event_type = 'query' ORDER BY position ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS past,
               list(scope_check) OVER (PARTITION BY log_file, scope_check IS NOT NULL ORDER BY position ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS lately,
               least(count(scope_check) OVER a, 50) AS scopes, least(count(*) FILTER (event_type = 'rejection') OVER a, 50) AS refused,
               count(*) FILTER (event_type = 'security_alert') OVER a AS alerts
        FROM ev WINDOW a AS (PARTITION BY log_file ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ), x AS (
        SELECT *, list_sort(past)[least(len(past) * 95 // 100, len(past) - 1) + 1] AS p95, len(list_filter(lately, lambda x: x = 'out_of_scope')) / 10 AS outside FROM w
    ), f AS (
        SELECT *, concat_ws(',',
            CASE WHEN event_type = 'query' AND len(past) >= 5 AND p95 > 0 AND response_time_ms > 2 * p95
                 THEN 'latency_spike:' || response_time_ms || 'ms>2×p95(' || p95 || 'ms)' END,
            CASE WHEN event_type = 'rejection' AND scopes + refused >= 10 AND refused / (scopes + refused) > 0.5
                      THEN 'rejection_surge:' || CAST(round_even(refused / (scopes + refused) * 100, 0) AS BIGINT) || '%_last' || (scopes + refused)
                 WHEN event_type = 'query' AND len(lately) = 10 AND outside > 0.5 THEN 'rejection_surge:' || CAST(round_even(outside * 100, 0) AS BIGINT) || '%_last10' END,
            CASE WHEN event_type = 'query' AND retry_count >= 2 THEN 'consecutive_retries:' || retry_count END,
            CASE WHEN event_type = 'security_alert' AND alerts >= 3 THEN 'security_alert_burst' END) AS flags
        FROM x
    )"""


def flagged(spark, sf_dir):
    return M.detector_flags(audit(spark, sf_dir))


@query(f"""{FLAGS} SELECT count(*) FILTER (event_type = 'query') AS queries, count(*) FILTER (event_type = 'rejection') AS rejections,
    count(*) FILTER (event_type = 'rejection') / greatest(count(*) FILTER (event_type IN ('query', 'rejection')), 1) AS rejection_rate,
    count(*) FILTER (event_type = 'security_alert') AS security_alerts, count(*) FILTER (flags <> '') AS anomalies, {P4} AS p95_ms FROM f""")
def a1_kpi(spark, sf_dir):
    return M.kpi(flagged(spark, sf_dir))


@query(f"""{FLAGS} SELECT log_file AS day, count(*) FILTER (event_type = 'query') AS queries, count(*) FILTER (event_type = 'rejection') AS rejections,
    count(*) FILTER (event_type = 'security_alert') AS security_alerts, count(*) FILTER (event_type = 'query' AND flags <> '') AS anomalies,
    CAST(floor(avg(response_time_ms)) AS BIGINT) AS avg_latency_ms,
    count(*) FILTER (event_type = 'rejection') / greatest(count(*) FILTER (event_type IN ('query', 'rejection')), 1) AS rejection_rate
    FROM f GROUP BY log_file""")
def a2_per_day(spark, sf_dir):
    return M.per_day(flagged(spark, sf_dir), F.substring("timestamp", 1, 10))


@query("""SELECT CAST(h.hour AS VARCHAR) AS hour, coalesce(s.queries, 0) AS queries, s.p95_ms,
    CASE WHEN p95_ms IS NULL THEN 'no_data' WHEN p95_ms <= 40000 THEN 'normal' WHEN p95_ms <= 50000 THEN 'watch' WHEN p95_ms <= 60000 THEN 'warning' ELSE 'critical' END AS status
    , hour = coalesce(max(hour) FILTER (s.queries > 0) OVER (), max(hour) OVER ()) AS latest
    FROM (SELECT unnest(generate_series(date_trunc('hour', max(ts) + INTERVAL 8 HOUR) - INTERVAL 23 HOUR, date_trunc('hour', max(ts) + INTERVAL 8 HOUR), INTERVAL 1 HOUR)) AS hour FROM ev) h
    LEFT JOIN (SELECT date_trunc('hour', ts + INTERVAL 8 HOUR) AS hour, count(*) AS queries, list_sort(list(response_time_ms))[(count(*) - 1) * 95 // 100 + 1] AS p95_ms
               FROM ev WHERE event_type = 'query' AND response_time_ms IS NOT NULL GROUP BY 1) s USING (hour)""")
def a3_hourly_status(spark, sf_dir):
    rows = M.hourly_status(audit(spark, sf_dir), F.max("ts"))
    return rows.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT event_type, CASE event_type WHEN 'security_alert' THEN threat_type ELSE 'out_of_scope' END AS kind, count(*) AS n
    FROM ev WHERE event_type IN ('security_alert', 'rejection') GROUP BY 1, 2""")
def a5_safety_summary(spark, sf_dir):
    return M.safety_summary(audit(spark, sf_dir))


@query(f"{FLAGS} SELECT position, flags FROM f WHERE flags <> ''")
def w1_w5_detector_flags(spark, sf_dir):
    rows = flagged(spark, sf_dir).where(F.size("anomaly_flags") > 0)
    return rows.select("position", F.array_join("anomaly_flags", ",").alias("flags"))


@query(f"""{FLAGS} SELECT split_part(flag, ':', 1) AS kind, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM f WHERE flags <> '')
    GROUP BY 1""")
def a6_anomaly_summary(spark, sf_dir):
    return M.anomaly_summary(flagged(spark, sf_dir))


@query(f"""{FLAGS} SELECT event_type, CASE WHEN event_type = 'security_alert' THEN 'critical' WHEN contains(flags, 'security_alert_burst') THEN 'critical'
    WHEN flags <> '' THEN 'warning' WHEN event_type = 'query' AND response_time_ms > 60000 THEN 'warning' ELSE 'normal' END AS danger_level, count(*) AS n FROM f GROUP BY 1, 2""")
def a7_danger_histogram(spark, sf_dir):
    return SC.danger_histogram(flagged(spark, sf_dir), M.danger_level(F.col("anomaly_flags")))


@query(f"""SELECT queries, r / (queries + r) AS rejection_rate, mean AS avg_latency_ms, p95_ms, (mean - 900.0) / greatest(900.0, 1.0) AS avg_latency_delta,
    cited / inside AS citation_rate, retried / queries AS retry_rate, alerts / (queries + r) AS security_rate
    FROM (SELECT count(*) FILTER (event_type = 'query') AS queries, count(*) FILTER (event_type = 'rejection') AS r, avg(response_time_ms) AS mean, {P4} AS p95_ms,
        count(*) FILTER (scope_check = 'in_scope') AS inside, count(*) FILTER (scope_check = 'in_scope' AND citation_count > 0) AS cited,
        count(*) FILTER (event_type = 'query' AND retry_count > 0) AS retried, count(*) FILTER (event_type = 'security_alert') AS alerts FROM ev)""")
def a9_perf_signals(spark, sf_dir):
    return M.perf_signals(audit(spark, sf_dir), 900.0)


FILES = f"""SELECT log_file, count(*) AS events, count(*) FILTER (event_type = 'query') AS queries, count(*) FILTER (event_type = 'rejection') AS rejections,
    count(*) FILTER (event_type = 'security_alert') AS security_alerts, count(*) FILTER (flags <> '') AS anomalous,
    CASE WHEN count(*) FILTER (event_type = 'query') > 0 THEN count(*) FILTER (event_type = 'rejection') / count(*) FILTER (event_type = 'query') END AS rejection_rate,
    CAST(floor(avg(response_time_ms)) AS BIGINT) AS avg_latency_ms,
    list_sort(list(response_time_ms) FILTER (response_time_ms IS NOT NULL))[count(response_time_ms) * 95 // 100 + 1] AS p95_ms FROM f GROUP BY log_file"""


@query(f"{FLAGS} {FILES}")
def a10_file_stats(spark, sf_dir):
    return M.file_stats(flagged(spark, sf_dir))


@query(f"""{FLAGS} SELECT log_file, split_part(flag, ':', 1) AS kind, count(*) AS n
    FROM (SELECT log_file, unnest(string_split(flags, ',')) AS flag FROM f WHERE flags <> '') GROUP BY ALL""")
def a11_flag_counts(spark, sf_dir):
    return M.flag_counts(flagged(spark, sf_dir))


@query(f"""{FLAGS} SELECT severity, title, dedup_key, count(*) AS n FROM (
        SELECT split_part(flag, ':', 1) AS title, 'anomaly:' || split_part(flag, ':', 1) || ':' || session_id AS dedup_key,
               CASE split_part(flag, ':', 1) WHEN 'latency_spike' THEN 'warning' WHEN 'rejection_surge' THEN 'warning' WHEN 'security_alert_burst' THEN 'critical' ELSE 'info' END AS severity
        FROM (SELECT session_id, unnest(string_split(flags, ',')) AS flag FROM f WHERE flags <> '')) GROUP BY ALL""")
def m19_flag_alerts(spark, sf_dir):
    return M.flag_alerts(flagged(spark, sf_dir)).groupBy("severity", "title", "dedup_key").agg(F.count("*").alias("n"))


@query(f"""{FLAGS} SELECT position, CASE WHEN event_type = 'security_alert' THEN threat_type WHEN flags <> '' THEN replace(flags, ',', ', ')
    WHEN event_type = 'query' AND response_time_ms > 60000 THEN 'latency ' || response_time_ms || ' ms' ELSE '' END AS reason FROM f""")
def f5_danger_reasons(spark, sf_dir):
    return flagged(spark, sf_dir).select("position", M.danger_reason(F.col("anomaly_flags")).alias("reason"))


@query("""SELECT position, ts, session_id FROM ev WHERE event_type = 'security_alert' AND ts >= (SELECT max(ts) FROM ev) - INTERVAL 5 DAY ORDER BY position DESC LIMIT 50""")
def sc7_recent_alerts(spark, sf_dir):
    rows = audit(spark, sf_dir)
    last = F.broadcast(rows.agg(F.max("ts").alias("last")))
    alerts = rows.where("event_type = 'security_alert'").crossJoin(last)
    return M.recent_alerts(alerts, F.col("last") - F.expr("interval 5 days")).select("position", F.col("ts").cast("timestamp_ntz").alias("ts"), "session_id")


@query("""SELECT position, CASE WHEN event_type <> 'query' THEN 'not_applicable' WHEN k % 7 = 0 THEN 'missing' WHEN k % 7 > 3 OR (k % 3 = 1) THEN 'mismatch'
    WHEN k % 3 = 0 THEN 'match_legacy' ELSE 'match' END AS prompt_status FROM ev""")
def j9_prompt_status(spark, sf_dir):
    k = F.col("k")
    rows = audit(spark, sf_dir).withColumns({
        "prompt_version_hash": F.when(k % 7 == 0, "").when(k % 7 > 3, "old").otherwise("now"), "prompt_baseline": F.when(k % 3 == 1, "b1").when(k % 3 == 2, "b2"),
    })
    running = spark.createDataFrame([(True, "b2", "now")], "available boolean, baseline string, hash string")
    return M.prompt_status(rows, running).select("position", "prompt_status")


@query("""SELECT session_id, arg_max(k, position) AS k, arg_max(event_type, position) AS event_type FROM ev GROUP BY session_id""")
def w9_last_per_session(spark, sf_dir):
    return M.last_per_key(audit(spark, sf_dir), "session_id", F.col("position"), "k", "event_type")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 3 THEN NULL WHEN event_id % 5 = 2 THEN epoch_us(ts) // 1000000 - 28800 ELSE epoch_us(ts) // 1000000 END AS seconds FROM events""")
def t1_parsed_times(spark, sf_dir):
    """Times with an offset, with Z, without any, as epoch seconds, and unreadable ones."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    form = F.col("event_id") % 5
    text = (
        F.when(form == 0, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(form == 1, F.concat(F.date_format(F.from_utc_timestamp("at", "+08:00"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")))
        .when(form == 2, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")).when(form == 3, F.lit("not a time")).otherwise(F.unix_seconds("at").cast("string"))
    )
    return rows.select("event_id", F.unix_seconds(M.parsed_time(text)).alias("seconds"))


@query("""SELECT session_id AS id, goal, operation, quality, service, overall, CASE WHEN ra >= rb AND ra >= rc THEN 'operation' WHEN rb >= rc THEN 'quality' ELSE 'service' END AS worst FROM (
    SELECT *, list_position(l, operation) AS ra, list_position(l, quality) AS rb, list_position(l, service) AS rc,
           l[greatest(list_position(l, operation), list_position(l, quality), list_position(l, service))] AS overall FROM (
        SELECT *, ['ok', 'watch', 'warning', 'critical'] AS l,
            CASE WHEN n % 11 = 0 THEN 'critical' WHEN n % 5 = 0 OR alerts > 2 THEN 'warning' WHEN n % 3 = 0 THEN 'watch' ELSE 'ok' END AS operation,
            CASE goal WHEN 'met' THEN 'ok' WHEN 'not_met' THEN 'warning' ELSE 'watch' END AS quality,
            CASE n % 6 WHEN 0 THEN 'watch' WHEN 1 THEN 'warning' WHEN 2 THEN 'critical' WHEN 3 THEN 'watch' ELSE 'ok' END AS service FROM (
            SELECT session_id, count(*) AS n, count(*) FILTER (event_type = 'security_alert') AS alerts,
                CASE WHEN count(*) % 4 = 0 OR count(*) % 7 = 0 THEN 'inconclusive' WHEN count(*) % 9 / 8 >= 0.9 THEN 'met' ELSE 'not_met' END AS goal FROM ev GROUP BY session_id)))""")
def m14_m15_status(spark, sf_dir):
    n = F.col("n")
    rows = audit(spark, sf_dir).groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "security_alert", 1)).alias("alerts"))
    rows = M.business_goal(rows.withColumns({"evaluated": F.when(n % 4 == 0, 0).otherwise(n), "hit_rate": F.when(n % 7 != 0, n % 9 / 8)}))
    rows = rows.withColumns({
        "critical": (n % 11 == 0).cast("int"), "warning": (n % 5 == 0).cast("int"), "security_alerts": F.greatest(F.lit(0), F.col("alerts") - 2),
        "anomalies": (n % 3 == 0).cast("int"), "severity": F.element_at(F.array(*[F.lit(x) for x in ("watch", "warning", "critical", "insufficient_data", "normal", "normal")]), (n % 6 + 1).cast("int")),
    })
    return M.operation_status(rows).select("id", "goal", "operation", "quality", "service", "overall", "worst")


@query(f"""{FLAGS} SELECT count(*) AS days, CAST(sum(queries) AS BIGINT) AS queries, CAST(sum(rejections) AS BIGINT) AS rejections,
    CAST(floor(avg(avg_latency_ms) FILTER (avg_latency_ms > 0)) AS BIGINT) AS avg_daily_latency_ms, sum(rejections) / sum(queries) AS rejection_rate
    FROM ({FILES})""")
def a12_days_rollup(spark, sf_dir):
    return M.days_rollup(M.file_stats(flagged(spark, sf_dir)))


@query("""SELECT position, session_id, event_type FROM ev WHERE event_type = 'security_alert' AND contains(session_id, '1')
    ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') DESC, log_file, position LIMIT 200""")
def f2_audit_search(spark, sf_dir):
    rows = audit(spark, sf_dir).withColumn("danger_level", M.danger_level())
    return M.search(rows, 200, danger_only=True, event_type="security_alert", session_id="1").select("position", "session_id", "event_type")


PROBES = """SELECT session_id AS series, position, event_type <> 'security_alert' AS ok FROM ev"""


def probes(spark, sf_dir):
    return audit(spark, sf_dir).select(F.col("session_id").alias("series"), "position", (F.col("event_type") != "security_alert").alias("ok"))


@query(f"""SELECT series, position, CAST(failures AS BIGINT) AS failures FROM (
    SELECT series, position, ok, count(*) FILTER (NOT ok) OVER (PARTITION BY series, island ORDER BY position) AS failures FROM (
        SELECT *, count(*) FILTER (ok) OVER (PARTITION BY series ORDER BY position) AS island FROM ({PROBES})))
    WHERE failures >= 3 AND NOT ok""")
def w7_failure_runs(spark, sf_dir):
    return M.failure_runs(probes(spark, sf_dir)).select("series", "position", "failures")


@query(f"""SELECT series, count(*) AS probes, avg(CAST(ok AS DOUBLE)) * 100 AS uptime_pct, avg(CAST(ok AS DOUBLE)) FILTER (nth <= 3) * 100 AS recent_ok_pct,
    bool_or(ok) FILTER (nth = 1) AS current_ok, max(position) FILTER (ok) AS last_ok, count(*) >= 3 AND avg(CAST(ok AS DOUBLE)) FILTER (nth <= 3) = 0 AS hard_down
    FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY position DESC) AS nth FROM ({PROBES})) GROUP BY series""")
def a21_availability(spark, sf_dir):
    return M.availability(probes(spark, sf_dir))


@query("""SELECT series, dependency, count(*) AS probes, avg(CAST(coalesce(up, FALSE) AS DOUBLE)) * 100 AS uptime_pct FROM (
        SELECT session_id AS series, 'db' AS dependency, k % 2 = 0 AS up FROM ev UNION ALL SELECT session_id, 'model', k % 3 = 0 FROM ev WHERE k % 5 <> 0) GROUP BY ALL""")
def c2_dependency_uptime(spark, sf_dir):
    k = F.col("k")
    both = F.create_map(F.lit("db"), k % 2 == 0, F.lit("model"), k % 3 == 0)
    rows = audit(spark, sf_dir).select(F.col("session_id").alias("series"), F.when(k % 5 != 0, both).otherwise(F.create_map(F.lit("db"), k % 2 == 0)).alias("per_dep"))
    return M.dependency_uptime(rows)


LEVELS = """SELECT session_id AS series, position, k % 3 AS level FROM ev"""


@query(f""", l AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY position) AS n FROM ({LEVELS})),
    s(series, n, position, level, alerted, pending, seen, from_level) AS (
        SELECT DISTINCT series, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM l
        UNION ALL SELECT l.series, l.n, l.position, l.level, CASE WHEN l.level < alerted OR pending = l.level AND seen = 1 THEN l.level ELSE alerted END,
            CASE WHEN l.level > alerted AND NOT coalesce(pending = l.level AND seen = 1, FALSE) THEN l.level END,
            CASE WHEN l.level > alerted AND NOT coalesce(pending = l.level AND seen = 1, FALSE) THEN 1 ELSE 0 END,
            CASE WHEN l.level > alerted AND pending = l.level AND seen = 1 THEN alerted END
        FROM s JOIN l ON l.series = s.series AND l.n = s.n + 1)
    SELECT series, position, level, from_level FROM s WHERE from_level IS NOT NULL""")
def w11_escalations(spark, sf_dir):
    from ..streaming.jobs import escalations_batch

    return escalations_batch(audit(spark, sf_dir).select(F.col("session_id").alias("series"), "position", (F.col("k") % 3).alias("level")))


@query("""SELECT position, nth, nth <= 2 AS admitted FROM (
    SELECT position, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, position) AS nth FROM ev)""")
def s4_rate_limit(spark, sf_dir):
    rows = audit(spark, sf_dir).withColumn("key", F.col("event_type"))
    return M.admitted(rows, 2).select("position", F.col("nth").cast("long").alias("nth"), "admitted")


@query("""SELECT s.severity, count(e.k) AS n FROM (VALUES ('info'), ('warning'), ('critical')) s(severity)
    LEFT JOIN ev e ON e.event_type = 'security_alert' AND s.severity = CASE WHEN e.k % 3 = 0 THEN 'info' WHEN e.k % 3 = 1 THEN 'warning' ELSE 'critical' END
    GROUP BY 1""")
def a22_alert_counts(spark, sf_dir):
    level = F.when(F.col("k") % 3 == 0, "info").when(F.col("k") % 3 == 1, "warning").otherwise("critical")
    rows = audit(spark, sf_dir).where("event_type = 'security_alert'")
    return M.alert_counts(rows.select(level.alias("severity")))


@query("""SELECT log_file, score, CASE WHEN score < 25 THEN 'normal' WHEN score < 50 THEN 'watch' WHEN score < 75 THEN 'warning' ELSE 'critical' END AS severity FROM (
    SELECT log_file, CASE WHEN s <= 40 THEN s / 40 * 25 WHEN s <= 60 THEN 25 + (s - 40) / 20 * 50 ELSE least(100.0::DOUBLE, 75 + (s - 60) / 40 * 25) END AS score FROM (
        SELECT log_file, list_sort(list(response_time_ms) FILTER (response_time_ms IS NOT NULL))[count(response_time_ms) * 95 // 100 + 1] * 4 / 1000 AS s
        FROM ev GROUP BY log_file HAVING count(*) FILTER (event_type = 'query') >= 30))""")
def m13_health(spark, sf_dir):
    none = F.lit(None)
    stats = M.file_stats(flagged(spark, sf_dir)).where("queries >= 30").select(
        "log_file", (F.col("p95_ms") * 4).alias("p95_ms"), "queries", none.cast("double").alias("faithfulness"), none.cast("double").alias("uptime_pct"),
        none.cast("double").alias("recent_ok_pct"), F.lit(False).alias("hard_down"), F.lit(False).alias("chain_broken"),
    )
    return M.health(stats).select("log_file", "score", "severity")


LISTS = """SELECT session_id AS id, list(CAST(k AS VARCHAR) ORDER BY position)[1:10] AS retrieved,
    list_sort(list_distinct(coalesce(list(CAST(k AS VARCHAR)) FILTER (event_type = 'rejection'), []))) AS relevant FROM ev GROUP BY session_id"""


def ranked_lists(spark, sf_dir):
    rows = audit(spark, sf_dir).groupBy(F.col("session_id").alias("id")).agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("position", "k"))), lambda x: x["k"].cast("string")), 1, 10).alias("retrieved"),
        F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("event_type") == "rejection", F.col("k").cast("string"))))).alias("relevant"),
    )
    return rows


METRICS = f"""SELECT id, len(relevant) AS n, CAST(list_has_any(retrieved, relevant) AS DOUBLE) AS hit,
        len(list_filter(retrieved[1:5], lambda x: list_contains(relevant, x))) / len(retrieved[1:5]) AS "precision",
        coalesce(len(list_filter(relevant, lambda x: list_contains(retrieved[1:5], x))) / nullif(len(relevant), 0), 0) AS recall,
        coalesce(1 / list_min(list_filter(list_transform(retrieved, lambda x, i: CASE WHEN list_contains(relevant, x) THEN i END), lambda x: x IS NOT NULL)), 0) AS rr,
        coalesce(list_sum(list_transform(list_filter(list_transform(retrieved, lambda x, i: CASE WHEN list_contains(relevant, x) AND list_position(retrieved, x) = i THEN i END),
            lambda x: x IS NOT NULL), lambda p, i: i / p)) / nullif(len(relevant), 0), 0) AS ap FROM ({LISTS} )"""


@query(f"""SELECT id, hit, "precision", recall, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END AS f1, rr, ap
    FROM ({METRICS})""")
def m1_m6_rank_metrics(spark, sf_dir):
    return E.rank_metrics(ranked_lists(spark, sf_dir)).drop("retrieved", "relevant")


@query(f"""SELECT count(*) AS evaluated, avg(hit) AS hit, avg("precision") AS "precision", avg(recall) AS recall,
    avg(CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END) AS f1, avg(rr) AS rr, avg(ap) AS ap
    FROM ({METRICS}) WHERE n > 0""")
def a13_macro_average(spark, sf_dir):
    return E.macro_average(E.rank_metrics(ranked_lists(spark, sf_dir)))


RUNS = """SELECT session_id AS id, bool_or(k % 5 = 0) AS passed FROM ev WHERE event_type = '{}' GROUP BY 1"""
FLIPS = f"""SELECT coalesce(b.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'only_baseline' WHEN b.id IS NULL THEN 'only_current'
    WHEN b.passed IS NULL OR c.passed IS NULL THEN 'skipped' WHEN b.passed AND NOT c.passed THEN 'newly_failed'
    WHEN NOT b.passed AND c.passed THEN 'newly_passed' WHEN c.passed THEN 'still_passed' ELSE 'still_failed' END AS change
    FROM ({RUNS.format('rejection')}) b FULL JOIN ({RUNS.format('security_alert')}) c ON b.id = c.id"""


def flips(spark, sf_dir):
    rows = audit(spark, sf_dir)
    run = lambda kind: rows.where(F.col("event_type") == kind).groupBy(F.col("session_id").alias("id")).agg(F.bool_or(F.col("k") % 5 == 0).alias("passed"))
    return E.flip_matrix(run("rejection"), run("security_alert"))


@query(f"SELECT * FROM ({FLIPS} )")
def j2_flip_matrix(spark, sf_dir):
    return flips(spark, sf_dir)


@query(f"""SELECT *, CASE WHEN newly_failed > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM (SELECT count(*) FILTER (change = 'newly_failed') AS newly_failed,
    count(*) FILTER (change = 'newly_passed') AS newly_passed, count(*) FILTER (change = 'only_baseline') AS only_baseline,
    count(*) FILTER (change = 'only_current') AS only_current FROM ({FLIPS} ))""")
def m16_gate_verdict(spark, sf_dir):
    return E.gate_verdict(flips(spark, sf_dir))


@query("""SELECT session_id AS id, count(*) AS runs, count(*) FILTER (k % 2 = 0) AS passes, CASE WHEN count(*) FILTER (k % 2 = 0) * 2 > count(*) THEN 'pass' ELSE 'fail' END AS majority,
    count(*) FILTER (k % 2 = 0) IN (0, count(*)) AS unanimous, count(*) FILTER (k % 2 = 0) = count(*) AS cleared FROM ev GROUP BY 1""")
def a23_rerun_verdict(spark, sf_dir):
    return E.rerun_verdict(audit(spark, sf_dir).select(F.col("session_id").alias("id"), (F.col("k") % 2 == 0).alias("passed")))


@query(f"""SELECT label, hallucinated, count(*) AS n FROM (SELECT CASE WHEN len(relevant) = 0 THEN 'skipped' WHEN list_has_any(cited, relevant) THEN 'hit'
    WHEN list_has_any(relevant, retrieved) THEN 'G-miss' ELSE 'R-miss' END AS label, len(list_filter(cited, lambda x: NOT list_contains(retrieved, x))) > 0 AS hallucinated
    FROM (SELECT *, list_slice(list_reverse_sort(retrieved), 1, 2) AS cited FROM ({LISTS} ))) GROUP BY 1, 2""")
def m17_attribution(spark, sf_dir):
    rows = ranked_lists(spark, sf_dir)
    cited = F.slice(F.sort_array("retrieved", False), 1, 2)
    rows = rows.select(F.col("relevant").alias("expected"), cited.alias("cited"), "retrieved", F.arrays_overlap(cited, "relevant").alias("is_hit"))
    return E.attribution(rows).groupBy("label", "hallucinated").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
    FROM (SELECT doc_id // 2 AS path, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 > 0) a
    FULL JOIN (SELECT doc_id // 2 AS path, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1) b ON a.path = b.path
    WHERE a.path IS NULL OR b.path IS NULL OR a.h <> b.h""")
def j12_snapshot_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("path"), F.sha2("text", 256).alias("sha256"))
    return E.snapshot_diff(docs.where("doc_id % 2 = 0 and doc_id % 3 > 0"), docs.where("doc_id % 2 = 1"))


@query("""SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS rank FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def w10_last_messages(spark, sf_dir):
    return R.last_messages(table(spark, sf_dir, "conversations"), 3, "conv_id", [F.desc("turn")]).select("conv_id", "turn", "role", "rank")


HAS = lambda c, w: f"CASE WHEN contains(lower({c}), '{w}') THEN 1 ELSE 0 END"
KEYWORDS = ("the", "and", "of", "password")


@query(f"SELECT conv_id, turn, ({' + '.join(HAS('text', w) for w in KEYWORDS)}) / 4 AS coverage FROM conversations WHERE text IS NOT NULL")
def j14_keyword_coverage(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in KEYWORDS])
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", E.keyword_coverage(F.col("text"), words).alias("coverage"))


def _redacted_sql(column: str) -> str:
    for _, pattern, replacement in X.REDACTIONS:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        column = f"regexp_replace({column}, '{pattern.removeprefix('(?i)').replace(chr(39), chr(39) * 2)}', '{replacement}', '{flags}')"
    return column


@query(f"SELECT doc_id, sha256({_redacted_sql('text')}) AS redacted_sha256 FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x00-\\x7f]*')")
def x7_redaction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(r"text rlike '^[\\x00-\\x7f]*\\z'")
    return docs.select("doc_id", F.sha2(X.redacted(F.col("text")), 256).alias("redacted_sha256"))


@query()
def x7_redaction_whole(spark, sf_dir):
    """All texts that are not null. No SQL: case, white space and \\b of other code points differ between the dialects."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.sha2(X.redacted(F.col("text")), 256).alias("redacted_sha256"))


@query()
def x6_threats(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.threat_type(F.col("text")).alias("threat"))
    return talk.groupBy("threat").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS content_hash, length(text) AS n FROM documents WHERE text IS NOT NULL")
def h1_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.length("text").cast("long").alias("n"))


def chains(spark, sf_dir):
    """Chained logs; in two of three files a line of the finished chain is changed: its record, or its link."""
    rows = audit(spark, sf_dir)
    line = F.row_number().over(M.Window.partitionBy("log_file").orderBy("position")).cast("long")
    body = F.to_json(F.struct("event_type", "session_id", "timestamp", "response_time_ms"))
    chain = I.chained(rows.select("log_file", line.alias("line_no"), body.alias("body")))
    kind = F.dayofmonth(F.to_date("log_file")) % 3
    return chain.withColumns({
        "body": F.when((kind == 1) & (F.col("line_no") == 5), '{"event_type": "other"}').otherwise(F.col("body")),
        "prev_hash": F.when((kind == 2) & (F.col("line_no") == 7), "0").otherwise(F.col("prev_hash")),
    })


@query("""SELECT log_file, bad IS NULL AS valid, bad AS broken_at, CASE WHEN bad IS NOT NULL THEN CASE kind WHEN 1 THEN 'entry_hash mismatch' ELSE 'prev_hash mismatch' END END AS reason,
    coalesce(bad, n) AS total FROM (SELECT *, CASE WHEN kind = 1 AND n >= 5 THEN 5 WHEN kind = 2 AND n >= 7 THEN 7 END AS bad
        FROM (SELECT log_file, day(CAST(log_file AS DATE)) % 3 AS kind, count(*) AS n FROM ev GROUP BY log_file))""")
def h2_h3_hash_chain(spark, sf_dir):
    return I.verified(chains(spark, sf_dir))


@query("""SELECT count(*) AS files, count(*) FILTER (kind = 1 AND n >= 5 OR kind = 2 AND n >= 7) AS broken,
    CASE WHEN count(*) FILTER (kind = 1 AND n >= 5 OR kind = 2 AND n >= 7) > 0 THEN 'broken' ELSE 'intact' END AS state
    FROM (SELECT log_file, day(CAST(log_file AS DATE)) % 3 AS kind, count(*) AS n FROM ev GROUP BY log_file)
    WHERE log_file IN (SELECT DISTINCT log_file FROM ev ORDER BY log_file DESC LIMIT 2)""")
def h5_integrity_state(spark, sf_dir):
    days = audit(spark, sf_dir).select("log_file").distinct().orderBy(F.desc("log_file")).limit(2)
    return I.integrity_state(I.verified(chains(spark, sf_dir)), days)


COSINE = """SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_sum(list_transform(list_zip(q.e, v.e), lambda x: x[1] * x[2])) / (q.n * v.n), 9) AS score
    FROM (SELECT * FROM e WHERE vec_id % 50 = 0) q, e v"""
VECTORS = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
    sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)"""


def vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"""{VECTORS} SELECT query_id, vec_id, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({COSINE})) WHERE rank <= 10""")
def r6_vector_top_k(spark, sf_dir):
    rows, queries = vectors(spark, sf_dir)
    return R.cosine_top_k(rows, queries, 10).select("query_id", "vec_id", "rank")


@query(f"""{VECTORS} SELECT query_id, label, vec_id, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM ({COSINE})) WHERE rank <= 3""")
def t3_top_k_by_source(spark, sf_dir):
    rows, queries = vectors(spark, sf_dir)
    return R.cosine_top_k(rows, queries, 3, ["label"]).select("query_id", "label", "vec_id", "rank")


@query(f"""{VECTORS} SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY turn, first) AS INT) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY query_id, label) AS first FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS pos FROM ({COSINE})) WHERE pos <= 20)""")
def w13_interleave(spark, sf_dir):
    rows, queries = vectors(spark, sf_dir)
    hits = R.cosine_top_k(rows, queries, 20).withColumnRenamed("rank", "pos").join(rows.select("vec_id", F.col("label").alias("source")), "vec_id")
    return R.interleave(hits, ["query_id"]).select("query_id", "vec_id", "place")


BM25 = """t AS (SELECT doc_id, len(w) AS len, unnest(w) AS token FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)),
    size AS (SELECT count(*) AS n, avg(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS m FROM documents),
    tf AS (SELECT doc_id, len, token, count(*) AS tf FROM t GROUP BY ALL),
    raw AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, size GROUP BY token, n),
    df AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
    q AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest(regexp_split_to_array(text, '\\s+')) AS token FROM benchmark) WHERE token <> '' GROUP BY ALL),
    s AS (SELECT item_id AS query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))) AS score FROM q JOIN tf USING (token) JOIN df USING (token), size GROUP BY 1, 2)"""


@query(f"""WITH {BM25} SELECT query_id, doc_id, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def r7_bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25(docs, queries).select("query_id", "doc_id", "rank")


@query("""SELECT doc_id, sha256(trim(part)) AS part_sha256 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS part FROM documents) WHERE trim(part) <> ''""")
def r1_split(spark, sf_dir):
    parts = R.paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"), "\n")
    return parts.select("doc_id", F.sha2("part", 256).alias("part_sha256"))


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, trim(substr(text, 1, 100)) ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1""")
def w12_first_of_each(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.col("doc_id").alias("pos"))
    return R.first_of_each(docs, F.col("text"), ["source"]).select("doc_id")


@query("""SELECT query_id, pos, sha256(text) AS text_sha256 FROM (
        SELECT v.label AS query_id, v.vec_id AS pos, coalesce(d.text, 'chunk') AS text, row_number() OVER (PARTITION BY v.label, v.vec_id % 90 ORDER BY v.vec_id) AS nth
        FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id % 90 AND d.doc_id % 2 = 0 WHERE v.vec_id % 5 > 0) WHERE nth = 1
    UNION ALL SELECT label, vec_id, sha256('chunk') FROM embeddings WHERE vec_id % 5 = 0""")
def j1_parents(spark, sf_dir):
    """Chunks and their parents: some chunks name no document, and some documents are missing."""
    v = F.col("vec_id")
    chunks = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), v.alias("pos"), F.when(v % 5 > 0, v % 90).alias("doc_id"), F.lit("chunk").alias("text"))
    found = R.parents(chunks, table(spark, sf_dir, "documents").where("doc_id % 2 = 0"), ["query_id"])
    return found.select("query_id", "pos", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT category, difficulty, count(*) AS n FROM (SELECT lang AS category, source AS difficulty FROM documents) GROUP BY GROUPING SETS ((category), (difficulty))""")
def a20_breakdown(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.col("source").alias("difficulty"))
    return SC.breakdown(docs, "category", "difficulty")


@query(""", a AS (SELECT session_id AS dedup_key, ts FROM ev WHERE event_type = 'security_alert'),
    s AS (SELECT dedup_key, min(ts) AS ts FROM a GROUP BY dedup_key
        UNION ALL SELECT s.dedup_key, min(a.ts) FROM s JOIN a ON a.dedup_key = s.dedup_key AND a.ts >= s.ts + INTERVAL 3 DAY GROUP BY s.dedup_key)
    SELECT dedup_key, ts FROM s""")
def s2_suppression(spark, sf_dir):
    from ..streaming.jobs import suppressed_batch

    alerts = audit(spark, sf_dir).where("event_type = 'security_alert'").select(F.col("session_id").alias("dedup_key"), "ts")
    return suppressed_batch(alerts, 3 * 86_400.0).select("dedup_key", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""SELECT conv_id, turn, CASE WHEN size <= 4 OR start IS NULL OR turn >= start THEN 'recent' ELSE 'history' END AS part FROM (
        SELECT *, min(turn) FILTER (used <= 300 AND role = 'user') OVER (PARTITION BY conv_id) AS start FROM (
            SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS size,
                   sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations))""")
def s10_compressed_history(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("n"), "role", "text")
    return R.compressed_history(rows, 4, 300).select(F.col("session_id").alias("conv_id"), F.col("n").alias("turn"), "part")


# answers that the table of documents stands in for: a cited article a, a reported gap m, evidence e and f
ANSWERS = """doc_id, doc_id % 7 + 1 AS a, doc_id % 3 = 0 AS gap, doc_id % 5 + 1 AS m, doc_id % 4 + 1 AS q, doc_id % 6 + 1 AS e, doc_id % 11 + 1 AS f, doc_id % 4 AS n"""


def answers_view(docs: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    article = lambda k: F.concat(F.lit("第"), (d % k + 1).cast("string"), F.lit("條"))
    answer = F.concat(
        F.lit("依"), article(7), F.lit("辦理。"), F.when(d % 3 == 0, F.concat(article(5), F.lit("尚未收錄，"))).otherwise(""),
        F.when(d % 2 == 0, "參考資料：").otherwise(""), F.coalesce("text", F.lit("")),
    )
    return docs.select("doc_id", F.concat(article(4), F.lit("規定為何")).alias("question"), answer.alias("answer"),
                       F.array(article(6), article(11)).alias("evidence"), (d % 4).alias("retry_count"))


@query(f"""SELECT doc_id, CASE WHEN loose AND n >= 2 THEN 'failed_safe(ungrounded_citation)' WHEN loose THEN 'needs_retry(ungrounded_citation)'
        WHEN n < 2 AND gap AND (a IN (e, f) OR m IN (e, f)) THEN 'needs_retry(contradictory_no_info)' WHEN size < 50 THEN 'passed(non_substantive)'
        WHEN n >= 2 THEN 'passed(retry_limit)' WHEN doc_id % 2 = 0 THEN 'passed(regex)' ELSE 'needs_retry(regex)' END AS action
    FROM (SELECT *, a NOT IN (e, f) OR (gap AND m NOT IN (e, f) AND NOT (m <> a AND m = q)) AS loose
          FROM (SELECT {ANSWERS}, 7 + CASE WHEN doc_id % 3 = 0 THEN 8 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 0 END + coalesce(length(text), 0) AS size FROM documents))""")
def x11_gate(spark, sf_dir):
    return A.gated(answers_view(table(spark, sf_dir, "documents"))).select("doc_id", "action")


@query(f"""SELECT doc_id, CASE WHEN gap AND m <> a THEN m END AS missing FROM (SELECT {ANSWERS} FROM documents)""")
def x12_reported_missing(spark, sf_dir):
    rows = answers_view(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.get(A.reported_missing(F.col("answer")), F.lit(0)).cast("long").alias("missing"))


@query("""SELECT page_id, 0 AS n, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS raw, 'name' AS kind, 'public' AS category FROM pages WHERE regexp_matches(url, '^https?://[^/:?#]+')
    UNION ALL SELECT page_id, 1, h[1], h[2], h[3] FROM (SELECT page_id, CASE page_id % 8 WHEN 0 THEN ['2130706433', 'ip', 'loopback'] WHEN 1 THEN ['0x7f000001', 'ip', 'loopback'] WHEN 2 THEN ['127.1', 'ip', 'loopback']
        WHEN 3 THEN ['::1', 'ip', 'loopback'] WHEN 4 THEN ['10.0.0.' || (page_id % 200), 'ip', 'private'] WHEN 5 THEN ['169.254.169.254', 'ip', 'metadata'] WHEN 6 THEN ['8.8.8.8', 'ip', 'public']
        ELSE ['169.254.1.' || (page_id % 200), 'ip', 'link_local'] END AS h FROM pages WHERE regexp_matches(url, '^https?://[^/:?#]+'))""")
def x5_hosts(spark, sf_dir):
    """The host of each page's address, and of a second one that is written as a number, in hexadecimal, short or as IPv6."""
    i = F.col("page_id")
    forms = ("2130706433", "0x7f000001", "127.1", "[::1]", None, "169.254.169.254", "8.8.8.8", None)
    other = F.element_at(F.array(*[F.lit(x) for x in forms]), (i % 8 + 1).cast("int"))
    other = F.coalesce(other, F.concat(F.when(i % 8 == 4, "10.0.0.").otherwise("169.254.1."), i % 200))
    found = table(spark, sf_dir, "pages").where(r"url rlike '^https?://[^/:?#]+'").select(
        "page_id", F.posexplode(H.hosts(F.concat("url", F.lit(" and HTTP://"), other, F.lit(":8080/x")))).alias("n", "h")
    )
    return found.select("page_id", "n", "h.raw", "h.kind", "h.category")


@query("""SELECT item_id AS event_id, doc_id AS chat_id, CAST(place AS INT) AS place FROM (
        SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id DESC) AS place
        FROM benchmark b JOIN (SELECT doc_id, text FROM documents ORDER BY doc_id DESC LIMIT 500) d ON contains(lower(d.text), lower(b.text)) WHERE b.text <> '') WHERE place <= 5""")
def j8_chats_by_text(spark, sf_dir):
    events = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("event_id"), F.timestamp_seconds(F.lit(0)).alias("at"), F.col("text").alias("query"))
    chats = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chat_id"), F.timestamp_seconds("doc_id").alias("updated_at"), F.array("text").alias("strings"))
    return L.by_text(events, chats).select("event_id", "chat_id", "place")


@query("""SELECT c.page_id AS event_id, c.page_id % 300 AS chat_id, n_nationkey AS user_id, n_name AS name
    FROM pages c JOIN customer k ON k.c_custkey = c.page_id % 300 LEFT JOIN nation ON n_nationkey = k.c_nationkey""")
def j7_chats_by_id(spark, sf_dir):
    events = table(spark, sf_dir, "pages").select(F.col("page_id").alias("event_id"), (F.col("page_id") % 300).alias("chat_id"), F.timestamp_seconds(F.lit(0)).alias("at"))
    chats = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chat_id"), F.col("c_nationkey").alias("user_id"), F.timestamp_seconds(F.lit(9)).alias("updated_at"))
    users = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("").alias("email"), F.col("n_name").alias("name"))
    return L.by_chat_id(events, L.with_users(chats, users)).select("event_id", "chat_id", "user_id", "name")


@query("""SELECT conv_id AS group_id, round(1 - abs(hits_a - hits_b) / 3, 9) AS keyword_consistency, 1 - abs(hits_a - hits_b) / 3 >= 0.7 AS passed FROM (
        SELECT conv_id, max(hits) FILTER (turn = 0) AS hits_a, max(hits) FILTER (turn = 1) AS hits_b FROM (
            SELECT conv_id, turn, CAST(contains(lower(text), 'a') AS INT) + CAST(contains(lower(text), 'qu') AS INT) + CAST(contains(lower(text), 'th') AS INT) AS hits
            FROM conversations WHERE turn IN (0, 1) AND text IS NOT NULL) GROUP BY conv_id) WHERE hits_a IS NOT NULL AND hits_b IS NOT NULL""")
def j15_bias(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("a", "QU", "th")])
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("n"), F.col("text").alias("answer"), words.alias("keywords"))
    return C.bias(C.answer_pairs(rows)).select("group_id", F.round("keyword_consistency", 9).alias("keyword_consistency"), "passed")


@query("""SELECT count(*) AS groups, count(*) FILTER (p) AS passed, coalesce(avg(CAST(p AS INT)), 1.0) AS pass_rate FROM (
    SELECT abs(count(*) FILTER (event_type = 'query') - count(*) FILTER (event_type = 'rejection')) < 3 AS p FROM ev GROUP BY session_id)""")
def a16_bias_rate(spark, sf_dir):
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    groups = audit(spark, sf_dir).groupBy("session_id").agg((F.abs(n("query") - n("rejection")) < 3).alias("passed"))
    return C.bias_summary(groups)


JUDGED = "CASE k % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'no_coverage' WHEN 3 THEN 'abstention' END AS status, (k % 11) / 16 AS score, CASE WHEN k % 3 = 0 THEN (k % 7) / 8 END AS relevancy"


@query(f"""SELECT count(*) AS sample_size, count(score) FILTER (status = 'ok') AS evaluated, round(avg(score) FILTER (status = 'ok'), 4) AS faithfulness,
    round(avg(relevancy), 4) AS answer_relevancy, count(*) FILTER (coalesce(status, '') <> 'ok' AND relevancy IS NULL) AS skipped,
    round(count(*) FILTER (status IN ('no_coverage', 'abstention')) / count(*), 4) AS no_coverage_rate FROM (SELECT {JUDGED} FROM ev)""")
def a17_judged(spark, sf_dir):
    k = F.col("k")
    rows = audit(spark, sf_dir).select(
        F.when(k % 5 < 2, "ok").when(k % 5 == 2, "no_coverage").when(k % 5 == 3, "abstention").alias("status"), ((k % 11) / 16).alias("faithfulness"),
        F.when(k % 3 == 0, (k % 7) / 8).alias("answer_relevancy"), F.lit(None).cast("double").alias("context_precision"),
    )
    return C.judged_summary(rows).drop("context_precision", "breakdown")


@query("""SELECT doc_id, CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE (coalesce(quality, 0) + coalesce(toxic, 0)) / (CAST(quality IS NOT NULL AS INT) + CAST(toxic IS NOT NULL AS INT)) END AS overall FROM labels""")
def a18_overall(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", C.overall(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("overall"))


@query("""SELECT variant, count(*) AS n, round(avg(CAST(c > 0 AS INT)), 4) AS hit_rate, round(avg(c / 2), 4) AS precision, round(avg(c / 2), 4) AS recall, round(avg(c / 2), 4) AS f1,
    CAST(floor(avg(v)) AS BIGINT) AS avg_latency_ms, list_sort(list(v))[(count(*) - 1) * 95 // 100 + 1] AS p95_latency_ms
    FROM (SELECT threat_type AS variant, v, CAST(k % 3 = k % 5 OR k % 3 = k % 5 + 1 AS INT) + CAST(k % 3 + 1 = k % 5 OR k % 3 + 1 = k % 5 + 1 AS INT) AS c FROM ev WHERE v IS NOT NULL) GROUP BY variant""")
def a25_variants(spark, sf_dir):
    pair = lambda x: F.array(x.cast("string"), (x + 1).cast("string"))
    k = F.col("k")
    rows = audit_v(spark, sf_dir).select(F.col("threat_type").alias("variant"), pair(k % 3).alias("expected"), pair(k % 5).alias("retrieved"), F.col("v").alias("latency_ms"))
    return C.variants(rows)


def audit_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor(F.col("value") * 100).cast("long").alias("v"))
    return v.where("v is not null").withColumn("threat_type", (F.col("k") % 8).cast("string"))


@query("""SELECT event_type AS version, session_id AS id, count(*) FILTER (k % 3 = 0) AS hits, count(*) FILTER (k % 3 < 2) AS valid, count(*) FILTER (k % 3 = 2) AS empties FROM ev GROUP BY ALL""")
def a26_prompt_runs(spark, sf_dir):
    hit = F.when(F.col("k") % 3 < 2, F.col("k") % 3 == 0)
    return C.prompt_runs(audit(spark, sf_dir).select(F.col("event_type").alias("version"), F.col("session_id").alias("id"), hit.alias("hit")))


@query("""SELECT case_id, replies, median, stable, coalesce(CASE band WHEN 'high' THEN median >= 0.8 WHEN 'low' THEN median <= 0.5 ELSE median BETWEEN 0.3 AND 0.85 END, FALSE) AS direction_ok
    FROM (SELECT session_id AS case_id, CASE CAST(session_id AS BIGINT) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'mid' END AS band, count(*) AS replies,
          round(median((k % 9) / 8), 3) AS median, count(DISTINCT k % 9) <= 1 AS stable FROM ev GROUP BY ALL)""")
def a27_judge_cases(spark, sf_dir):
    third = F.col("session_id").cast("long") % 3
    rows = audit(spark, sf_dir).select(
        F.col("session_id").alias("case_id"), F.when(third == 0, "high").when(third == 1, "low").otherwise("mid").alias("band"),
        F.lit(True).alias("valid"), F.lit(False).alias("abstained"), ((F.col("k") % 9) / 8).alias("score"),
    )
    return C.judge_cases(rows).select("case_id", "replies", "median", "stable", "direction_ok")


@query()
def r4_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(S.chunked(F.col("text"))).alias("chunk"))
