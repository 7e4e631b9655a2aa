"""Schemas of the tables that the engine reads: audit events, golden sets, probes, reports, alerts, chats."""

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_LIST = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


AUDIT_EVENT = _struct(
    event_type=_S, timestamp=_S, session_id=_S, request_id=_S, source_app=_S, client_ip=_S, user_query=_S, model_response=_S,
    scope_check=_S, reason=_S, threat_type=_S, stage=_S, action_taken=_S, user_notified=_B, detection_method=_S, message_index=_L,
    message_role=_S, message_source=_S, wrapper_mode=_B, model_name=_S, api_key_prefix=_S, path=_S, filename=_S, indexed=_B,
    message=_S, success_count=_L, failed_count=_L, response_time_ms=_L, tokens_used=_L, retrieval_doc_count=_L,
    citation_count=_L, retry_count=_L, retrieved_docs=_LIST, actions=_LIST, anomaly_flags=_LIST, prompt_baseline=_S,
    prompt_version_hash=_S, openai_response_id=_S, frontend_session_id=_S, frontend_user_id=_S, frontend_chat_id=_S,
    frontend_message_id=_S, frontend_metadata=T.MapType(_S, _S), prev_hash=_S, entry_hash=_S,
)
GOLDEN = _struct(
    id=_S, query=_S, question=_S, expected_answer=_S, category=_S, difficulty=_S, expected_keywords=_LIST, expected_articles=_LIST,
    expected_docs=_LIST,
)
PROBE = _struct(timestamp=_S, overall_ok=_B, per_dep=T.MapType(_S, _struct(ok=_B, detail=_S, rtt_ms=_D)))
ALERT = _struct(severity=_S, source=_S, title=_S, message=_S, evidence=T.MapType(_S, _S), timestamp=_S, dedup_key=_S)
CONVERSATION = _struct(id=_L, session_id=_S, role=_S, content=_S, created_at=T.TimestampType())
CHUNK = _struct(chunk_id=_S, doc_id=_S, chunk_no=_L, text=_S, source=_S, article_id=_S)
