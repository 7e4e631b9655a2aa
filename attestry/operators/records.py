"""Audit records from requests and events, who asked, what it was called, and counts of tables before and after a move."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

# Headers that name a request and what it belongs to, in the order in which they are asked.
HEADERS = {
    "request_id": ("x-request-id", "x-correlation-id"), "frontend_session_id": ("x-session-id", "x-openwebui-session-id"),
    "frontend_chat_id": ("x-openwebui-chat-id", "x-chat-id", "x-conversation-id"), "frontend_user_id": ("x-openwebui-user-id",),
    "frontend_message_id": ("x-openwebui-message-id", "x-message-id"),
}
# The headers of a request that are kept, for they say where it came from.
SOURCE_HEADERS = (
    "x-request-id", "x-correlation-id", "x-session-id", "x-openwebui-session-id", "x-openwebui-chat-id", "x-openwebui-user-id", "x-openwebui-user-name",
    "x-openwebui-user-email", "x-openwebui-user-role", "x-openwebui-message-id", "x-chat-id", "x-conversation-id", "x-message-id", "origin", "referer",
    "user-agent", "x-forwarded-for", "x-real-ip",
)
#: Statuses of a response that make an audit record of a failed access.
REFUSED = (401, 403, 503)
LONGEST_HEADER, LONGEST_ALERT = 300, 200


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_header(headers: Column, names: tuple[str, ...]) -> Column:
    """The first of some headers (a map with lower-case names) that is not empty, trimmed; empty without any."""
    return trimmed(F.coalesce(*[F.nullif(F.try_element_at(headers, F.lit(n)), F.lit("")) for n in names], F.lit("")))


def request_context(requests: DataFrame, made: Column | None = None) -> DataFrame:
    """requests (headers) with ids of HEADERS, frontend_metadata (SOURCE_HEADERS that are not empty, cut to LONGEST_HEADER) and
    source_app: openwebui, http_api where there is such a header, or unknown.

    `made` is the request_id of requests that name none. Ids keep letters, digits and _.:- only, 96 characters at most.
    """
    from ..functions.text import safe_id

    found = {k: first_header(F.col("headers"), names) for k, names in HEADERS.items()}
    own = safe_id(found["request_id"])
    found["request_id"] = F.when(own != "", own).otherwise(safe_id(made if made is not None else F.lit("")))
    known = F.map_filter("headers", lambda k, v: k.isin(*SOURCE_HEADERS) & (v != ""))
    kept = F.coalesce(F.transform_values(known, lambda _, v: F.substring(v, 1, LONGEST_HEADER)), F.create_map().cast("map<string,string>"))
    said = F.concat_ws(" ", *[F.try_element_at(kept, F.lit(n)) for n in ("origin", "referer", "user-agent")])
    app = (
        F.when(F.exists(F.map_keys(kept), lambda k: k.startswith("x-openwebui")) | F.lower(said).contains("openwebui"), "openwebui")
        .when(F.size(kept) > 0, "http_api").otherwise("unknown")
    )
    found["frontend_metadata"] = kept
    return requests.select("*", *[v.alias(k) for k, v in found.items()], app.alias("source_app"))


@F.pandas_udf(BooleanType())
def _inside(peers: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    nets: dict[str, list] = {}

    def one(peer: str | None, ranges: str) -> bool:
        if ranges not in nets:
            nets[ranges] = [ipaddress.ip_network(r, strict=False) for r in ranges.split(",") if r]
        try:
            return peer is not None and any(ipaddress.ip_address(peer) in n for n in nets[ranges])
        except ValueError:
            return False

    for peer, ranges in peers:
        yield pd.Series([one(p, r) for p, r in zip(peer, ranges, strict=True)])


def client_ip(peer: Column, forwarded: Column, proxies: tuple[str, ...]) -> Column:
    """The address a request came from: the last one that a trusted proxy forwards, else the peer's own."""
    ranges = F.lit(",".join(proxies))
    last = trimmed(F.element_at(F.split(forwarded, ","), -1))
    good = _inside(last, F.lit("0.0.0.0/0,::/0"))
    return F.when((F.coalesce(forwarded, F.lit("")) != "") & _inside(peer, ranges) & good, last).otherwise(F.coalesce(peer, F.lit("unknown")))


def identity(token: Column, ip: Column, keys: tuple[str, ...], intranet: bool) -> Column:
    """struct<status, identity>: 200 with the key, or with intranet:<ip> where no keys are set and that is allowed; 401
    without a valid key, and 503 where nothing is set, so that nothing is open by mistake."""
    if not keys:
        status, name = (F.lit(200), F.concat(F.lit("intranet:"), ip)) if intranet else (F.lit(503), F.lit(None).cast("string"))
    else:
        known = F.coalesce(token.isin(*keys), F.lit(False))
        status, name = F.when(known, 200).otherwise(401), F.when(known, token)
    return F.struct(status.alias("status"), name.alias("identity"))


def key_prefix(key: Column) -> Column:
    return F.substring(key, 1, 24)


def trusted_wrapper(role: Column, text: Column, peer: Column, peers: tuple[str, ...], signatures: tuple[str, ...]) -> Column:
    """Whether a message is a background task of the frontend: its role, a trusted peer, the head of a task and a signature."""
    small = F.lower(text)
    signed = F.greatest(F.lit(False), *[small.contains(s) for s in signatures])
    return role.isin("user", "system") & peer.isin(*peers) & F.regexp_replace(small, r"(?U)^\s+", "").startswith("### task:") & signed


def rejections(requests: DataFrame) -> DataFrame:
    """Audit records of refused questions (session_id, client_ip, user_query, reason)."""
    return requests.select(
        F.lit("rejection").alias("event_type"), "session_id", _known("client_ip"), "user_query", F.lit("out_of_scope").alias("scope_check"),
        F.coalesce("reason", F.lit("out_of_scope")).alias("reason"),
    )


def security_alerts(requests: DataFrame, stage: str = "input", action: str = "blocked", method: str = "input_sanitizer") -> DataFrame:
    """Audit records of blocked messages (session_id, client_ip, user_query, threat_type, reason, message_index, message_role)."""
    return requests.select(
        F.lit("security_alert").alias("event_type"), "session_id", _known("client_ip"), F.substring("user_query", 1, LONGEST_ALERT).alias("user_query"),
        "threat_type", "reason", F.lit(stage).alias("stage"), F.lit(action).alias("action_taken"), F.lit(True).alias("user_notified"),
        F.lit(method).alias("detection_method"), "message_index", "message_role",
    )


def queries(answers: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """Audit records of answered questions; absent lists are empty, and `prompts` (one row: baseline, hash) is named."""
    none = F.array().cast("array<string>")
    rows = answers.select(
        F.lit("query").alias("event_type"), "session_id", _known("client_ip"), "user_query", F.coalesce("model_response", F.lit("")).alias("model_response"),
        "scope_check", "model_name", *[F.coalesce(c, none).alias(c) for c in ("retrieved_docs", "actions", "anomaly_flags")],
        "response_time_ms", "citation_count", F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
    )
    if prompts is None:
        return rows.withColumns({"prompt_baseline": F.lit(""), "prompt_version_hash": F.lit("")})
    one = F.broadcast(prompts.limit(1).select(F.col("baseline").alias("prompt_baseline"), F.col("hash").alias("prompt_version_hash")))
    return rows.crossJoin(one)


def auth_failures(responses: DataFrame) -> DataFrame:
    """Audit records of responses (status, token, path, reason, client_ip) that refused access."""
    return responses.where(F.col("status").isin(*REFUSED)).select(
        F.lit("auth_failure").alias("event_type"), _known("client_ip"), key_prefix(F.coalesce("token", F.lit(""))).alias("api_key_prefix"), "path", "reason"
    )


def uploads(files: DataFrame) -> DataFrame:
    return files.select(F.lit("upload").alias("event_type"), "filename", "indexed", "message")


def reindexed(files: DataFrame) -> DataFrame:
    """One audit record of an indexing run over files (indexed)."""
    good, bad = F.count(F.when(F.col("indexed"), 1)), F.count(F.when(~F.col("indexed"), 1))
    said = F.concat(F.lit("Reindexed "), good.cast("string"), F.lit(" documents ("), bad.cast("string"), F.lit(" failed)"))
    return files.agg(F.lit("reindex").alias("event_type"), good.alias("success_count"), bad.alias("failed_count"), said.alias("message"))


def _known(name: str) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown")).alias(name)


def summary_line(events: DataFrame) -> Column:
    """What the console shows of a record: its parts that are not empty, parted by bars."""
    c = F.col
    part = lambda name, value: F.when(F.coalesce(c(name).cast("string"), F.lit("")).isin("", "0"), F.lit(None)).otherwise(value)
    cut = F.concat(F.lit('query="'), F.substring("user_query", 1, 60), F.when(F.length("user_query") > 60, "...").otherwise(""), F.lit('"'))
    parts = {
        "request_id": F.concat(F.lit("request="), F.substring("request_id", 1, 8)), "session_id": F.concat(F.lit("session="), F.substring("session_id", 1, 8)),
        "user_query": cut, "scope_check": F.concat(F.lit("scope="), "scope_check"), "retrieved_docs": None,
        "response_time_ms": F.concat(F.lit("time="), "response_time_ms", F.lit("ms")), "model_name": F.concat(F.lit("model="), "model_name"), "message": c("message"),
    }
    names = set(events.columns)
    docs = F.when(F.size("retrieved_docs") > 0, F.concat(F.lit("docs="), F.size("retrieved_docs"))) if "retrieved_docs" in names else None
    return F.concat_ws(" | ", *[docs if n == "retrieved_docs" else part(n, v) for n, v in parts.items() if n in names and (n != "retrieved_docs" or docs is not None)])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of tables."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def moved(before: DataFrame, after: DataFrame, exact: tuple[str, ...] = ()) -> DataFrame:
    """(name, expected, current, ok): counts (name, rows) before and after a move. No table may have lost rows, and those
    of `exact` must have as many; a table that is gone has none."""
    both = before.select("name", F.col("rows").alias("expected")).join(after.select("name", F.col("rows").alias("current")), "name", "left")
    current = F.coalesce("current", F.lit(0))
    same = F.col("name").isin(*exact) if exact else F.lit(False)
    return both.select("name", "expected", current.alias("current"), F.when(same, current == F.col("expected")).otherwise(current >= F.col("expected")).alias("ok"))


def collection_counts(collections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(collection, chunks) of all collections, those without chunks too."""
    n = chunks.groupBy("collection").agg(F.count("*").alias("chunks"))
    return collections.select("collection").join(n, "collection", "left").fillna(0, ["chunks"])
