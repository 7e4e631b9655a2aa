"""What is kept between runs: index, generations, replies, states of integrity and of escalations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attestry.operators import integrity as I, postings as P, retrieve as R
from attestry.sources.store import Generations, asked_once, threshold
from attestry.streaming import jobs


def documents(spark, n, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, f"s{i % 3}" if i % 7 else None, " ".join(["all"] * (i % 2) + rng.choices(words, k=rng.randrange(1, 30))) if i % 11 else None) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def asked(spark):
    return spark.createDataFrame([(1, "w1 w2 all"), (2, "w3 w3 none"), (3, ""), (4, "all")], "query_id long, text string")


def ranks(rows):
    return sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in rows.collect())


def test_index_gives_the_same_ranks(spark, tmp_path):
    docs = documents(spark, 200).withColumn("text", F.coalesce("text", F.lit("")))
    folder = f"{tmp_path}/index"
    P.write_index(docs.where("source = 's0' or source is null").withColumn("text", F.upper("text")), folder, buckets=4)
    P.write_index(docs.where("source = 's1'"), folder)
    P.write_index(docs.where("source is null or source <> 's1'"), folder)
    assert ranks(P.ask_index(spark, folder, asked(spark))) == ranks(R.bm25(docs, asked(spark)))
    only = {r.doc_id % 3 for r in P.ask_index(spark, folder, asked(spark), sources=["s1"]).collect()}
    assert only == {1}


def test_index_opens_asked_buckets_only(spark, tmp_path):
    folder = f"{tmp_path}/index"
    P.write_index(documents(spark, 50), folder, buckets=16)
    plan = P.ask_index(spark, folder, spark.createDataFrame([(1, "w1")], "query_id long, text string"))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", plan)
    assert P.ask_index(spark, folder, asked(spark).where("query_id = 3")).collect() == []


def test_generations(spark, tmp_path):
    store = Generations(spark, f"file://{tmp_path}/store")
    table = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x long")
    assert store.current() == 0 and store.read("a") is None
    assert store.publish({"a": table(1), "b": table(10)}) == 1
    old = store.read("a", 1), store.read("b", 1)
    broken = table(2).select(F.expr("if(x = 2, raise_error('lost'), x)").alias("x"))
    with pytest.raises(Exception, match="lost"):
        store.publish({"a": table(3), "b": broken})
    assert store.current() == 1 and store.read("a").collect() == [(1,)]
    assert store.publish({"a": table(2, 3)}) == 2
    assert [sorted(r.x for r in t.collect()) for t in old] == [[1], [10]]  # a reader that was open before
    assert sorted(r.x for r in store.read("a").collect()) == [2, 3] and store.read("b").collect() == [(10,)]
    with pytest.raises(FileExistsError):
        store.publish({"a": table(4)}, after=1)
    for i in range(3):
        store.publish({"a": table(i)})
    store.forget(2)
    assert store.numbers() == [4, 5] and store.read("b").collect() == [(10,)] and store.read("a", 4).collect() == [(1,)]


def test_texts_are_asked_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def call(texts):
        with open(log, "a") as out:
            out.writelines(t + "\n" for t in texts)
        assert len(texts) <= 2
        return [len(t) for t in texts]

    def asked_texts():
        with open(log) as f:
            return sorted(f.read().split("\n")[:-1])

    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, ""), (6, "a")], "id long, text string")
    want = {1: 1, 2: 2, 3: 1, 4: None, 5: 0, 6: 1}
    assert {r.id: r.reply for r in asked_once(rows, call, "long", f"{tmp_path}/kept", batch=2).collect()} == want
    assert asked_texts() == ["", "a", "bb"]
    more = rows.unionByName(spark.createDataFrame([(7, "ccc"), (8, "bb")], "id long, text string"))
    assert {r.id: r.reply for r in asked_once(more, call, "long", f"{tmp_path}/kept", batch=2).collect()} == want | {7: 3, 8: 2}
    assert asked_texts() == ["", "a", "bb", "ccc"]
    with pytest.raises(Exception, match="replies"):
        asked_once(spark.createDataFrame([(9, "dddd")], "id long, text string"), lambda texts: [], "long", f"{tmp_path}/kept")
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 4


def test_thresholds(spark):
    level = threshold(F.col("x"), [(50, "watch"), (25, "normal")], "critical")
    assert [r[0] for r in spark.createDataFrame([(None,), (1.0,), (25.0,), (60.0,)], "x double").select(level).collect()] == [None, "normal", "watch", "critical"]


def test_only_new_lines_are_read(spark, tmp_path):
    log, state, seen = f"{tmp_path}/log", f"file://{tmp_path}/state", f"{tmp_path}/checkpoint"
    body = lambda i: '{"n": %d}' % i
    chain = I.chained(spark.createDataFrame([(f, i, body(i)) for f in "ab" for i in range(1, 21)], "log_file string, line_no long, body string")).persist()
    put = lambda rows: rows.write.mode("append").parquet(log)
    assert I.kept_integrity(spark, state) == "unknown" and I.new_break_alerts(spark, state).collect() == []
    put(chain.where("line_no <= 8"))
    assert I.verify_new(spark, log, state, seen) == 16 and I.kept_integrity(spark, state) == "intact"
    assert I.verify_new(spark, log, state, seen) == 0
    put(chain.where("line_no between 9 and 12"))
    assert I.verify_new(spark, log, state, seen) == 8 and I.new_break_alerts(spark, state).collect() == []
    bad = chain.where("line_no > 12").withColumn("body", F.when((F.col("log_file") == "b") & (F.col("line_no") >= 15), body(0)).otherwise(F.col("body")))
    put(bad.where("log_file = 'b' and line_no <= 16"))
    assert I.verify_new(spark, log, state, seen) == 4
    assert [(r.log_file, r.broken_at) for r in I.new_break_alerts(spark, state).collect()] == [("b", 15)]
    put(bad.where("line_no > 16 or log_file = 'a'"))
    assert I.verify_new(spark, log, state, seen) == 12
    assert I.new_break_alerts(spark, state).collect() == []
    whole = {r.log_file: (r.broken_at, r.reason) for r in I.verified(spark.read.parquet(log)).collect()}
    kept = {r.log_file: (r.broken_at, r.reason) for r in Generations(spark, state).read("files").collect()}
    assert whole == kept == {"a": (None, None), "b": (15, "entry_hash mismatch")}
    assert [I.kept_integrity(spark, state, [f]) for f in "ab"] == ["intact", "broken"]


def test_escalations_go_on_from_a_saved_state(spark, tmp_path):
    rng = random.Random(6)
    made = [(f"s{i % 5}", i, rng.choice([0, 0, 1, 2, 2, 3])) for i in range(300)]
    history = spark.createDataFrame(made, "series string, position long, level long")
    whole = sorted(map(tuple, jobs.escalations_batch(history).collect()))
    first = history.where("position < 137")
    saved = spark.createDataFrame(jobs.escalation_states(first).collect(), "series string, state string")
    history.where("position >= 137").coalesce(1).write.parquet(f"{tmp_path}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        rows = spark.readStream.schema("series string, position long, level long").parquet(f"{tmp_path}/in")
        run = jobs.escalations_from(rows, saved).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(name, before)
    later = spark.read.parquet(f"{tmp_path}/out").collect()
    assert whole and sorted(map(tuple, jobs.escalations_batch(first).collect() + later)) == whole


def plain_context(docs, style, budget):
    out, used = [], 0
    for n, (source, article, text) in enumerate(docs, 1):
        source = "Unknown" if source is None else source
        head = {"document": f"=== 文件 {n} ===\n來源: {source}\n內容: ", "tool": f"[{n}] Source: {source}\nContent: ", "react": f"[{n}] 來源: {source}" + (f" ({article})" if article else "") + "\n"}[style]
        left = budget - used
        if left <= 0:
            break
        if (len(head) + len(text)) // 4 > left:
            if left * 4 - len(head) <= 200:
                break
            text = text[: left * 4 - len(head)] + ("\n... (截斷)" if style == "react" else "\n... (因 token 預算限制已截斷)")
        out.append(head + text + ("\n" if style == "tool" else ""))
        used += len(out[-1]) // 4
    return ("\n" if style == "tool" else "\n\n").join(out)


def test_context_formats(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        docs = [(rng.choice([None, "law.md", "b.md"]), rng.choice([None, "", "第1條"]), "字a" * rng.randrange(400)) for _ in range(rng.randrange(7))]
        rows.append((i, docs))
    df = spark.createDataFrame(rows, "id long, docs array<struct<source:string,article_id:string,text:string>>")
    for style in R.STYLES:
        got = {r.id: r.c for r in df.select("id", R.formatted(F.col("docs"), style, 300).alias("c")).collect()}
        assert got == {i: plain_context(docs, style, 300) for i, docs in rows}
