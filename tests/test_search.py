"""Search structures against plain comparison of all with all: cells of vectors, automata, trigrams, and chats in SQLite."""

import datetime
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.operators import cells as V, correlate as L, monitor as M, retrieve as R
from attestry.sources import chats


def vectors(spark, seed, n, dims=6, clusters=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dims))
    rows = [(i, (centres[0 if i % 3 == 0 else i % clusters] + 0.2 * rng.standard_normal(dims)).astype(float).tolist()) for i in range(n)]
    rows += [(n + i, [0.0] * dims) for i in range(3)] + [(n + 10 + i, rows[0][1]) for i in range(30)]  # zeros, and many equal ones
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, v) for i, v in rows if i % 17 == 0] + [(10**6, [0.0] * dims)], "query_id long, embedding array<double>")
    return df, asked


def triples(rows):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows.collect())


@pytest.mark.parametrize(("probes", "k"), [(1, 5), (3, 12), (None, 5)])
def test_cells_are_exact(spark, tmp_path, monkeypatch, probes, k):
    monkeypatch.setattr(V, "QUESTIONS", 20)
    df, asked = vectors(spark, 1, 300)
    V.write_cells(df, str(tmp_path), cells=10)
    assert triples(V.ask_cells(spark, str(tmp_path), asked, k, probes)) == triples(R.cosine_top_k(df, asked, k))


def test_recall_of_some_cells(spark, tmp_path):
    df, asked = vectors(spark, 2, 1000, dims=12)
    V.write_cells(df, str(tmp_path), cells=16)
    want = {x[:1] + x[2:3] for x in triples(R.cosine_top_k(df, asked, 10))}
    got = {x[:1] + x[2:3] for x in triples(V.ask_cells(spark, str(tmp_path), asked, 10, probes=4, exact=False))}
    recall = len(want & got) / len(want)
    print(f"recall {recall:.3f} of 4 of 16 cells")
    assert recall >= 0.9
    stored = spark.read.parquet(f"{tmp_path}/vectors")
    assert stored.count() == df.count()  # every vector is stored


def test_cells_of_nothing(spark, tmp_path):
    df, asked = vectors(spark, 3, 20)
    V.write_cells(df.where("vec_id between 20 and 22"), f"{tmp_path}/zeros", cells=4)
    assert triples(V.ask_cells(spark, f"{tmp_path}/zeros", asked, 2)) == triples(R.cosine_top_k(df.where("vec_id between 20 and 22"), asked, 2))
    V.write_cells(df, f"{tmp_path}/all", cells=4)
    assert V.ask_cells(spark, f"{tmp_path}/all", asked.limit(0)).collect() == []


def test_texts_in_chats(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abÄé ") for _ in range(rng.randrange(1, 9)))
    at = datetime.datetime(2026, 1, 1)
    made = [(i, [None if rng.random() < 0.1 else word() + word() for _ in range(rng.randrange(4))], at + datetime.timedelta(seconds=rng.randrange(4000))) for i in range(60)]
    asked = [(i, rng.choice(["", None, "a b ä é a b ä é", word(), word()]), at + datetime.timedelta(seconds=rng.randrange(4000))) for i in range(80)]
    asked += [(100 + i, "ab", at) for i in range(40)]  # one query that many events have
    df = spark.createDataFrame(made, "chat_id long, strings array<string>, updated_at timestamp")
    events = spark.createDataFrame(asked, "event_id long, query string, at timestamp")
    want = set()
    tried = sorted(made, key=lambda c: (-c[2].timestamp(), c[0]))[:50]
    for event, q, when in asked:
        if q:
            hits = [c for c in tried if any(s and q.lower() in s.lower() for s in c[1]) and (len(q) >= 12 or abs((c[2] - when).total_seconds()) <= 900)]
            want |= {(event, c[0], i + 1, next(s for s in c[1] if s and q.lower() in s.lower())) for i, c in enumerate(hits[:5])}
    got = {(r.event_id, r.chat_id, r.place, r.matched_text) for r in L.by_text(events, df, n=50).collect()}
    assert want and got == want


def test_trigrams_rule_files_out(spark):
    rng = random.Random(3)
    rows = [(f"f{i % 40}", i, "2026-01-01", "query", "".join(rng.choice("abcdef") for _ in range(12))) for i in range(400)]
    df = spark.createDataFrame(rows, "log_file string, position long, timestamp string, event_type string, user_query string")
    index = M.text_index(df).cache()
    for text in ("ABcd", "fed", "abcdefabc", "xy", ""):
        want = sorted(r[1] for r in rows if text.lower() in r[4] or text.lower() in "query")
        assert sorted(r.position for r in M.search(df, 1000, text=text, index=index).collect()) == want
    files = {r.log_file for r in M.files_that_may_say(index, "abcde").collect()}
    assert {r[0] for r in rows if "abcde" in r[4]} <= files and len(files) < 40


def test_chats_of_sqlite(spark, tmp_path):
    path = str(tmp_path / "chats.db")
    with sqlite3.connect(path) as base:
        base.execute("CREATE TABLE chat (id TEXT, user_id TEXT, title TEXT, chat TEXT, updated_at INTEGER)")
        rows = [(f"c{i}", f"u{i % 3}", None if i % 5 == 0 else f"title {i}", '{"messages": ["hé"]}', (i * 37) % 101) for i in range(100)]
        base.executemany("INSERT INTO chat VALUES (?, ?, ?, ?, ?)", rows)
        base.execute("DELETE FROM chat WHERE id = 'c50'")
    rows = [r for r in rows if r[0] != "c50"]
    chats.register(spark)
    read = lambda **options: spark.read.format("sqlite_chats").options(path=path, **options).load()
    whole = read(partitions=4)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(rows, key=str)
    assert whole.select(F.spark_partition_id()).distinct().count() == 4
    newest = [r.id for r in read(newest=7).collect()]
    assert newest == [r[0] for r in sorted(rows, key=lambda r: -r[4])[:7]]
    assert [tuple(r) for r in read().select("id", L.chat_strings("chat")).where("id = 'c7'").collect()] == [("c7", ["hé"])]
    with sqlite3.connect(str(tmp_path / "empty.db")) as base:
        base.execute("CREATE TABLE chat (id TEXT, user_id TEXT, title TEXT, chat TEXT, updated_at INTEGER)")
    assert spark.read.format("sqlite_chats").options(path=str(tmp_path / "empty.db")).load().collect() == []
