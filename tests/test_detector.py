"""The detector against a plain loop: whole files, files in segments, and a stream in several triggers."""

import random

import pytest

from attestry.operators import detector, monitor as M
from attestry.streaming import jobs


def events(seed: int, n: int):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        file = None if rng.random() < 0.05 else rng.choice("aaaab")
        kind = rng.choices(["query", "rejection", "security_alert", "upload"], [8, 3, 0.2, 1])[0]
        out.append((
            file, i, kind, rng.choice([None, rng.randrange(50), rng.randrange(1000)]), rng.choice([None, "", "in_scope", "out_of_scope", "out_of_scope"]),
            rng.choice([None, 0, 1, 2, 5]),
        ))
    return out


def plain(rows):
    out, state = [], {}
    for file, position, kind, ms, scope, retries in rows:
        late, scopes, refused, alerts = state.setdefault(file, ([], [], [], []))
        flags = []
        if kind == "query":
            if ms is not None:
                past = sorted(late[-50:])
                if len(past) >= 5 and (p := past[min(len(past) * 95 // 100, len(past) - 1)]) > 0 and ms > 2 * p:
                    flags.append(f"latency_spike:{ms}ms>2×p95({p}ms)")
                late.append(ms)
            if scope:
                scopes.append(scope)
                rate = scopes[-10:].count("out_of_scope") / 10
                if len(scopes) >= 10 and rate > 0.5:
                    flags.append(f"rejection_surge:{rate:.0%}_last10")
            if (retries or 0) >= 2:
                flags.append(f"consecutive_retries:{retries}")
        elif kind == "rejection":
            refused.append(1)
            a, b = min(50, len(scopes)), min(50, len(refused))
            if a + b >= 10 and b / (a + b) > 0.5:
                flags.append(f"rejection_surge:{b / (a + b):.0%}_last{a + b}")
        elif kind == "security_alert":
            alerts.append(1)
            flags += ["security_alert_burst"] * (len(alerts) >= 3)
        if flags:
            out.append((file, position, flags))
    return out


SCHEMA = "log_file string, position long, event_type string, response_time_ms long, scope_check string, retry_count long"


@pytest.mark.parametrize(("seed", "rows"), [(1, 200_000), (2, 37), (3, 400)])
def test_segments(spark, monkeypatch, seed, rows):
    monkeypatch.setattr(detector, "SEGMENT_ROWS", rows)
    made = events(seed, 1500)
    df = spark.createDataFrame(made, SCHEMA).repartition(5)
    got = sorted(((r.log_file, r.position, r.anomaly_flags) for r in detector.flagged_events(df).collect()), key=str)
    assert got == sorted(plain(made), key=str)
    flagged = M.detector_flags(df)
    assert flagged.count() == len(made) and flagged.where("size(anomaly_flags) > 0").count() == len(got)


def test_series_that_start_late(spark, monkeypatch):
    """Segments without a value of a series pass on what stood before them."""
    monkeypatch.setattr(detector, "SEGMENT_ROWS", 10)
    made = [("f", i, "query", 10, "out_of_scope", 0) for i in range(12)] + [("f", i, "upload", None, None, None) for i in range(12, 60)]
    made += [("f", 60, "query", 25, "", 0), ("f", 61, "query", 19, "out_of_scope", 2)]
    got = sorted((r.position, r.anomaly_flags) for r in detector.flagged_events(spark.createDataFrame(made, SCHEMA)).collect())
    assert got == [(p, f) for _, p, f in plain(made)]


def test_no_events(spark):
    assert M.detector_flags(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stream(spark, tmp_path):
    made = [x for x in events(4, 600) if x[0] is not None]
    for part in range(3):
        spark.createDataFrame(made[part * 200 : part * 200 + 200], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.detected(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    got = sorted((r.log_file, r.position, r.flag) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((f, p, x) for f, p, flags in plain(made) for x in flags)
