"""Expected values of the answer gate, hosts, chats, chunks, comparisons and office readers."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from attestry.functions import hosts as H, split as S
from attestry.operators import answers as A, compare as C, correlate as L
from attestry.sources import office, sinks

LONG = "依第6條與第8條辦理，" + "內容" * 30 + "參考資料"


@pytest.mark.parametrize(("host", "want"), [
    ("127.0.0.1", "loopback"), ("2130706433", "loopback"), ("0x7f000001", "loopback"), ("127.1", "loopback"), ("[::1]", "loopback"),
    ("169.254.169.254", "metadata"), ("169.254.1.1", "link_local"), ("10.1.2.3", "private"), ("8.8.8.8", "public"), ("example.org", "public"),
])
def test_hosts(host, want):
    assert H.host(f"http://{host}/x")[2] == want


def test_host_column(spark):
    rows = spark.createDataFrame([("see http://a.org/x and HTTPS://10.0.0.1:80/",), ("none",), (None,), ("http://[bad",)], "t string").select(H.hosts(F.col("t")).alias("h")).collect()
    assert [[tuple(x) for x in r.h] if r.h is not None else None for r in rows] == [
        [("a.org", "name", "public"), ("10.0.0.1", "ip", "private")], [], None, [("http://[bad", "name", "unparseable")]]


def test_gate(spark):
    cases = [
        (LONG, ["第6條", "第八條"], 0, "passed(regex)"), (LONG + "第99條", ["第6條", "第8條"], 0, "needs_retry(ungrounded_citation)"),
        (LONG + "第99條", ["第6條", "第8條"], 2, "failed_safe(ungrounded_citation)"), (LONG + "，第99條尚未收錄", ["第6條", "第8條"], 2, "passed(retry_limit)"),
        (LONG + "，第99條尚未收錄", ["第6條", "第8條"], 0, "needs_retry(contradictory_no_info)"), ("短", [], 0, "passed(non_substantive)"), (None, None, None, "passed(non_substantive)"),
        ("沒有相關" + "內容" * 30, [], 0, "passed(no_info)"), ("內容" * 30, [], 0, "needs_retry(regex)"),
    ]
    rows = spark.createDataFrame([(i, "第99條為何", a, e, n) for i, (a, e, n, _) in enumerate(cases)], "i int, question string, answer string, evidence array<string>, retry_count int")
    out = A.gated(rows).orderBy("i").collect()
    assert [r.action for r in out] == [c[3] for c in cases]
    assert out[2].reply == A.FAIL_SAFE and out[1].next_retry == 1 and out[1].ungrounded == [99] and out[2].scope == "verified"


def test_reasoning(spark):
    fold = lambda t: spark.createDataFrame([(t,)], "t string").select(A.folded(F.col("t"), "#+ *why", "#+ *answer").alias("x")).first().x
    assert fold("## why\nbecause\nso\n\n## answer\nyes\n") == "<think>\nbecause\nso\n</think>\n\n## answer\nyes\n"
    for same in ("## answer\nyes", "text\n## why\nx\n## answer\ny", "## why\n\n## answer\ny", "## why\n<THINK>\n## answer\ny", ""):
        assert fold(same) == same


def test_chats(spark):
    chats = spark.createDataFrame([("c1", "u1", 1000, json.dumps({"m": ["法規查詢 Hello"]})), ("c2", "u9", 5000, "hello, not JSON"), ("c3", None, 9000, None)], "chat_id string, user_id string, s long, chat string")
    chats = chats.select("chat_id", "user_id", F.timestamp_seconds("s").alias("updated_at"), L.chat_strings("chat").alias("strings"))
    chats = L.with_users(chats, spark.createDataFrame([("u1", "e", "n")], "id string, email string, name string"))
    events = spark.createDataFrame([(1, 1000, "c3", "x"), (2, 1000, "zz", "HELLO"), (3, 0, None, "法規查詢"), (4, 0, None, "")], "event_id int, s long, chat_id string, query string")
    events = events.withColumn("at", F.timestamp_seconds("s")).drop("s")
    found = {(r.event_id, r.chat_id, r.match_kind, r.delta_seconds, r.name) for r in L.correlated(events, chats).collect()}
    assert found == {(1, "c3", "chat_id", 8000, None), (2, "c1", "text", 0, "n")}  # event 3 is short and 1000 s away


def test_chunks(spark):
    assert S.chunks("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert S.chunks("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    assert S.chunks("前言\n第一條甲\n第二條乙", 8, 0, S.STATUTE) == ["前言\n第一條甲", "第二條乙"]
    assert [r.x for r in spark.createDataFrame([("a b",), ("",), (None,)], "t string").select(S.chunked(F.col("t")).alias("x")).collect()] == [["a b"], [], []]


def test_bias_and_summaries(spark):
    rows = spark.createDataFrame([("g", 0, "A b", ["a", "b"]), ("g", 1, "a", ["a", "b"]), ("h", 0, A.REFUSAL, []), ("h", 1, "x", []), ("i", 0, "x", []), ("i", 1, "y", []), ("k", 0, "x", [])], "group_id string, n int, answer string, keywords array<string>")
    scored = C.bias(C.answer_pairs(rows))
    assert {(r.group_id, r.keyword_consistency, r.passed) for r in scored.collect()} == {("g", 0.5, False), ("h", 1.0, False), ("i", 1.0, True)}
    assert C.bias_summary(scored.limit(0)).first().pass_rate == 1
    ddl = "status string, faithfulness double, answer_relevancy double, context_precision double"
    s = C.judged_summary(spark.createDataFrame([("ok", 0.5, None, None), ("abstention", 1.0, 0.2, None), (None, None, None, None)], ddl)).first()
    assert (s.sample_size, s.evaluated, s.faithfulness, s.answer_relevancy, s.context_precision, s.skipped, s.no_coverage_rate) == (3, 1, 0.5, 0.2, None, 1, 0.3333)
    assert s.breakdown == {"ok": 1, "abstention": 1, "unavailable": 1}
    empty = C.judged_summary(spark.createDataFrame([], ddl)).first()
    assert (empty.sample_size, empty.faithfulness, empty.no_coverage_rate, empty.breakdown) == (0, None, None, {})


def test_judge(spark):
    rows = spark.createDataFrame([(1, "high", True, False, 0.9), (1, "high", True, False, 0.9), (2, "abstain", True, True, None), (3, "low", True, False, 0.9), (4, "mid", False, False, None)], "case_id int, band string, valid boolean, abstained boolean, score double")
    assert [(r.median, r.stable, r.direction_ok) for r in C.judge_cases(rows).orderBy("case_id").collect()] == [(0.9, True, True), (None, True, True), (0.9, True, False), (None, True, False)]


def test_office(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "a.docx").write_bytes(held.getvalue())
    (tmp_path / "b.rtf").write_bytes(rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0 Hi \'e9\par \u27861?x}")
    (tmp_path / "c.docx").write_bytes(b"broken")
    got = {r.path[-6:]: (r.markdown, r.problem) for r in office.read_office(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("# a\n\n### Top\n\none two", None), "/b.rtf": ("# b\n\nHi \u00e9\n\u6cd5x", None), "c.docx": (None, "BadZipFile")}


def test_report(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string"), str(tmp_path / "r"))
    assert {r.value for r in spark.read.text(str(tmp_path / "r/markdown/rows")).collect()} == {"| 1 | a\\|b |", "| 2 |  |"}
    assert spark.read.json(str(tmp_path / "r/json")).count() == 2
