"""Logs as files: fields of other types, lines over splits, code pages, free text."""

import json

from attestry.operators import monitor as M
from attestry.schemas import AUDIT_EVENT
from attestry.sources import files, office


def test_no_line_is_lost(spark, tmp_path):
    lines = [
        {"event_type": "query", "response_time_ms": 100}, {"event_type": "query", "response_time_ms": 12.5}, {"event_type": "query", "response_time_ms": True},
        {"event_type": "security_alert", "retry_count": "2"}, {"event_type": "query", "response_time_ms": 12.0}, {"event_type": 5, "retrieved_docs": [1, "a", None]},
    ]
    text = "\n".join(json.dumps(x) for x in lines) + '\n\n[1]\n7\nnull\n{"event_type": "cut\n{"event_type": "x"} tail\n{\'event_type\': "x"}\n{"event_type": "nan", "response_time_ms": NaN}\n'
    (tmp_path / "audit_2026-05-01.jsonl").write_text(text)
    rows = files.read_audit(spark, str(tmp_path)).collect()
    assert len(rows) == 7 and all(r.retry_count is None for r in rows)
    assert [r.response_time_ms for r in rows if r.event_type == "query"] == [100, None, 1, None]
    assert next(r.retrieved_docs for r in rows if r.event_type == "5") == ["1", "a", None]


def test_probes_with_structs(spark, tmp_path):
    probes = [
        {"timestamp": "2026-05-01T10:00:00+08:00", "overall_ok": True, "per_dep": {"db": {"ok": True, "detail": "d", "rtt_ms": 3}, "llm": {"ok": False, "detail": 7, "rtt_ms": 2.5}}},
        {"timestamp": "2026-05-01T10:01:00+08:00", "overall_ok": False, "per_dep": {"db": {"ok": False}, "llm": "down"}},
        {"timestamp": "no time", "overall_ok": True}, {"timestamp": "2026-05-01T10:02:00+08:00", "per_dep": 3},
    ]
    (tmp_path / "availability_log.jsonl").write_text("\n".join(map(json.dumps, probes)))
    rows = files.read_probes(spark, [str(tmp_path / "availability_log.jsonl")])
    assert rows.count() == 3
    got = {(r.dependency, r.probes, r.uptime_pct) for r in M.dependency_uptime(rows.withColumn("series", rows["timestamp"][0:4])).collect()}
    assert got == {("db", 2, 50.0), ("llm", 2, 0.0)}


def test_lines_are_numbered_over_splits(spark, tmp_path):
    text = [f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(1, 4001)]
    (tmp_path / "audit_2026-05-01.jsonl").write_text("\n".join(text))
    (tmp_path / "audit_2026-05-02.jsonl").write_text("a\n\nb\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000b")
        rows = files.read_audit_lines(spark, str(tmp_path))
        got = {(r.log_file, r.line_no): r.value for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {("audit_2026-05-01.jsonl", i + 1): x for i, x in enumerate(text)} | {("audit_2026-05-02.jsonl", i + 1): x for i, x in enumerate(["a", "", "b"])}
    assert got == want


def test_rtf_code_pages():
    chinese = "法律第一條"
    escaped = "".join(f"\\'{b:02x}" for b in chinese.encode("cp950"))
    assert office.rtf_text(b"{\\rtf1\\ansi\\ansicpg950 " + escaped.encode() + b"\\par ok}") == chinese + "\nok"
    # a second byte that is a letter may stand as it is
    plain = "".join(f"\\'{b:02x}" if b > 127 or chr(b) in "\\{}" else chr(b) for b in "功能".encode("cp950"))
    assert office.rtf_text(b"{\\rtf1\\ansicpg950 " + plain.encode("latin-1") + b"}") == "功能"
    u = "\\" + "u"  # a character by its number, then fallbacks
    text = "{{\\rtf1\\ansi\\uc2 a{u}27861\\'aa\\'bbc\\uc0{u}27861d{u}-10179{u}-8704}}".replace("{{", "{").replace("}}", "}").replace("{u}", u)
    assert office.rtf_text(text.encode()) == "a法c法d😀"
    assert office.rtf_text(rb"{\rtf1\ansi caf\'e9 \{x\} \\}") == "café {x} \\"


def test_search_in_all_fields(spark):
    rows = spark.createDataFrame(
        [(1, "query", "2026-01-01", "f", "Alpha", {"a": "b"}), (2, "query", "2026-01-02", "f", None, {"n": 'é, "q", ü'}), (3, "alpha", "2026-01-03", "f", "z", {})],
        "position long, event_type string, timestamp string, log_file string, user_query string, frontend_metadata map<string,string>",
    )
    found = lambda text, **more: [r.position for r in M.search(rows, text=text, **more).collect()]
    assert found("ALPHA") == [3, 1] and found("alpha", columns=("user_query",)) == [1] and found("") == [3, 2, 1]
    assert found('"a": "b"') == [1] and found('{"n": "É, \\"q\\", ü"}') == [2] and found("nothing") == [] and found("alpha", columns=()) == []


def test_types_of_the_schema(spark):
    one = spark.createDataFrame([(json.dumps({f.name: {"deep": [1]} for f in AUDIT_EVENT.fields}),)], "value string")
    row = files.parsed_lines(one, AUDIT_EVENT).first()
    assert row.event_type == '{"deep":[1]}' and row.response_time_ms is None and row.actions is None and row.frontend_metadata == {"deep": "[1]"}
