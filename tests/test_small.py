"""Small functions of texts, records and answers on their cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.operators import evaluate as E, monitor as M, records as C, retrieve as R
from attestry.sources import files, sinks


def values(spark, column, *cells, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, x {kind}")
    return [r[1] for r in sorted(rows.select("i", column(F.col("x"))).collect())]


def test_texts(spark):
    assert values(spark, X.visible, "a​b﻿", None) == ["ab", None]
    assert values(spark, X.trimmed_lower, "　 AbC\n", "") == ["abc", ""]
    assert values(spark, X.citation_count_streamed, "第 1 條、第二條、第12條", "") == [2, 0]
    assert values(spark, X.without_emoji, " \U0001f600 ok ✅", "x") == ["ok", "x"]
    assert values(spark, lambda x: X.chunks_of(x, 3), "abcdefgh", "", "a\nb\U0001f600c") == [["abc", "def", "gh"], [], ["a\nb", "\U0001f600c"]]
    line = lambda kind, text: values(spark, lambda x: X.message_line(F.lit(kind), x), text)[0]
    assert [line("human", "q"), line("ai", "a"), line("custom", "c")] == ["User: q", "AI: a", "Custom: c"]
    assert line("tool", "t" * 501) == "Tool: " + "t" * 500 + "... (truncated)" and line("tool", "t" * 500) == "Tool: " + "t" * 500


def test_prompt_hash(spark):
    versions = {"b": "2", "a": 'one "x"\n', "c": "é"}
    want = hashlib.sha256(json.dumps(versions, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    assert values(spark, X.prompt_hash, versions, kind="map<string,string>") == [want]


def test_answers(spark):
    kind = lambda x: E.answer_class(x, ("refused",), ("no record",))
    assert values(spark, kind, None, " \n　", "it was refused", "no record of it", "an answer") == ["empty", "empty", "rejection_oos", "no_coverage", "answer"]
    assert values(spark, E.unit_score, None, float("nan"), -1.0, 0.5, 7.0, kind="double") == [None, None, 0.0, 0.5, 1.0]
    named = lambda x: E.retrieved_article(F.lit(None).cast("string"), x)
    assert values(spark, named, "see 第 3 條 and 第4條", "none", None) == ["第3條", "", ""]
    own = lambda x: E.retrieved_article(x, F.lit("第9條"))
    assert values(spark, own, "第5條", "7", "preamble", "") == ["第5條", "第7條", "第9條", "第9條"]
    assert values(spark, lambda x: R.rerank_options(x, 4), ["ab\ncdef", "x"], kind="array<string>") == ["[1] ...ab c...\n\n[2] ...x..."]


def test_records(spark):
    wrapped = lambda role, peer, text: values(spark, lambda x: C.trusted_wrapper(F.lit(role), x, F.lit(peer), ("10.0.0.1",), ("make a title",)), text)[0]
    assert wrapped("user", "10.0.0.1", " \n### Task:\nMake a title") and wrapped("system", "10.0.0.1", "### task: make a title")
    assert not any([wrapped("tool", "10.0.0.1", "### task: make a title"), wrapped("user", "10.0.0.2", "### task: make a title"), wrapped("user", "10.0.0.1", "### task: other"), wrapped("user", "10.0.0.1", "make a title ### task:")])
    responses = spark.createDataFrame([(401, "k" * 30, "/x", "bad", ""), (200, "k", "/y", "", "1.1.1.1"), (503, None, "/z", "none", "1.1.1.1")], "status int, token string, path string, reason string, client_ip string")
    got = C.auth_failures(responses).collect()
    assert [(r.event_type, r.client_ip, r.path, r.reason) for r in got] == [("auth_failure", "unknown", "/x", "bad"), ("auth_failure", "1.1.1.1", "/z", "none")]
    assert got[0].api_key_prefix == "k" * 24
    done = spark.createDataFrame([("a", True, "m"), ("b", False, "n"), ("c", True, "o")], "filename string, indexed boolean, message string")
    assert {(r.event_type, r.filename, r.indexed) for r in C.uploads(done).collect()} == {("upload", "a", True), ("upload", "b", False), ("upload", "c", True)}
    assert tuple(C.reindexed(done).first()) == ("reindex", 2, 1, "Reindexed 2 documents (1 failed)")


def test_writers(spark, tmp_path):
    events = spark.createDataFrame([("query", "2026-05-01T01:00:00", 1), ("query", "2026-05-02T01:00:00", 2)], "event_type string, timestamp string, n long")
    for _ in range(2):
        sinks.append_audit(events, f"{tmp_path}/audit")
    back = spark.read.parquet(f"{tmp_path}/audit")
    assert back.count() == 4 and back.where("log_date = '2026-05-02'").count() == 2
    sinks.append_probes(events, f"{tmp_path}/probes")
    assert {str(r.month) for r in spark.read.parquet(f"{tmp_path}/probes").select("month").collect()} == {"2026-05"}
    snap = spark.createDataFrame([("a", "h")], "path string, sha256 string")
    sinks.save_snapshot(snap, f"{tmp_path}/snaps", "one")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.save_snapshot(snap, f"{tmp_path}/snaps", "one")
    sinks.insert_messages(spark.createDataFrame([("s1", "hi"), (None, "x")], "session_id string, content string"), f"{tmp_path}/messages")
    left = sinks.without_session(spark.read.parquet(f"{tmp_path}/messages"), "s1").collect()
    assert [r.content for r in left] == ["x"]
    table = spark.createDataFrame([("a", 1), ("b", 2)], "source string, n long")
    sinks.replace_source(table, f"{tmp_path}/by_source")
    sinks.replace_source(spark.createDataFrame([("a", 7), ("a", 8)], "source string, n long"), f"{tmp_path}/by_source")
    assert sorted((r.source, r.n) for r in spark.read.parquet(f"{tmp_path}/by_source").collect()) == [("a", 7), ("a", 8), ("b", 2)]


def test_reports_and_documents(spark, tmp_path):
    for name, body in (("health_2.json", {"n": 2, "ok": True}), ("health_1.json", {"n": 1, "ok": True}), ("health_3.json", {"n": 3})):
        (tmp_path / name).write_text(json.dumps(body))
    assert files.latest_report(spark, str(tmp_path), "health_*.json").first().n == 3
    assert files.latest_report(spark, str(tmp_path), "health_*.json", "ok").first().n == 2
    snap = spark.createDataFrame([("/d/a.md", 1, 5), ("/d/b.md", 2, 9), ("/d/c.md", 3, 9)], "path string, size long, modified long")
    assert [r.name for r in files.newest_documents(snap).collect()] == ["b.md", "c.md", "a.md"]


def test_limits_and_banners(spark):
    stale = lambda at: values(spark, lambda x: M.stale(x, F.to_timestamp(F.lit("2026-05-10 00:00:00")), 3), at)[0]
    assert [stale("2026-05-06T23:00:00+00:00"), stale("2026-05-05T23:00:00+00:00"), stale(None), stale("never")] == [False, True, True, True]
    banner = lambda c, w, h: spark.range(1).select(M.banner(F.lit(c), F.lit(w), F.lit(h))).first()[0]
    assert [banner(1, 0, "warning"), banner(1, 0, "normal"), banner(0, 2, "critical"), banner(0, 0, "critical")] == ["critical", "warning", "warning", "calm"]
