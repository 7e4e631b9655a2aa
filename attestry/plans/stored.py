"""Queries over what is kept between runs: the inverted index, generations, embeddings and states of integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cells as V, integrity as I, monitor as M, postings as P
from ..sources.store import Generations, asked_once, scratch
from ..streaming import jobs as J
from .queries import BM25, COSINE, VECTORS, audit, chains, query, table, vectors

RANKED = f"""WITH {BM25} SELECT query_id, doc_id, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


def asked_items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(RANKED)
def r7_stored_index(spark, sf_dir):
    """BM25 from stored postings."""
    folder = scratch(spark, "index")
    P.write_index(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), folder)
    return P.ask_index(spark, folder, asked_items(spark, sf_dir)).select("query_id", "doc_id", "rank")


@query(RANKED)
def sk9_index_replaced(spark, sf_dir):
    """The index after sources that had other texts at first were replaced, each for itself."""
    folder = scratch(spark, "index")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    last = docs.agg(F.max("source")).first()[0]
    old = docs.withColumn("text", F.when(F.col("source") == last, F.upper("text")).otherwise(F.col("text")))
    P.write_index(old, folder)
    P.write_index(docs.where(F.col("source") == last), folder)
    return P.ask_index(spark, folder, asked_items(spark, sf_dir)).select("query_id", "doc_id", "rank")


def replayed(spark, rows, schema: str, job, name: str):
    """The rows that a streaming job gives for a table that is replayed whole, then kept as Parquet."""
    folder = scratch(spark, name)
    rows.write.parquet(f"{folder}/in")
    stream = job(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("""SELECT strftime(date_trunc('hour', ts + INTERVAL 8 HOUR), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS queries, avg(response_time_ms) AS avg_latency_ms,
    list_sort(list(response_time_ms))[(count(*) - 1) * 95 // 100 + 1] AS p95_ms FROM ev
    WHERE event_type = 'query' AND response_time_ms IS NOT NULL
    GROUP BY ALL HAVING date_trunc('hour', max(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ev WHERE event_type = 'query' AND response_time_ms IS NOT NULL) - INTERVAL 1 HOUR""")
def s5_hourly_stream(spark, sf_dir):
    """Hourly percentiles of a replayed log: the hours that its watermark has closed."""
    rows = audit(spark, sf_dir).select("ts", "event_type", "response_time_ms")
    found = replayed(spark, rows, "ts timestamp, event_type string, response_time_ms long", J.hourly_latency, "hours")
    return found.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "queries", "avg_latency_ms", "p95_ms")


@query("""SELECT log_file, bad IS NULL AS valid, bad AS broken_at, CASE WHEN bad IS NOT NULL THEN CASE kind WHEN 1 THEN 'entry_hash mismatch' ELSE 'prev_hash mismatch' END END AS reason,
    coalesce(bad, n) AS total, CASE WHEN count(bad) OVER () > 0 THEN 'broken' ELSE 'intact' END AS state, 'unknown' AS before FROM (SELECT *, CASE WHEN kind = 1 AND n >= 5 THEN 5 WHEN kind = 2 AND n >= 7 THEN 7 END AS bad
        FROM (SELECT log_file, day(CAST(log_file AS DATE)) % 3 AS kind, count(*) AS n FROM ev GROUP BY log_file))""")
def s8_incremental_integrity(spark, sf_dir):
    """Chains that come in two parts, each read once: the state kept after the second one is that of a whole pass."""
    folder = scratch(spark, "integrity")
    rows, log, state = chains(spark, sf_dir), f"{folder}/log", f"{folder}/state"
    before = I.kept_integrity(spark, state)
    for part in ("line_no <= 6", "line_no > 6"):
        rows.where(part).write.mode("append").parquet(log)
        I.verify_new(spark, log, state, f"{folder}/checkpoint")
    files = Generations(spark, state).read("files")
    return files.select(
        "log_file", F.col("broken_at").isNull().alias("valid"), "broken_at", "reason", F.coalesce("broken_at", "lines").alias("total"),
        F.lit(I.kept_integrity(spark, state)).alias("state"), F.lit(before).alias("before"),
    )


def counted(texts: list[str]) -> list[list[float]]:
    """Stands for an embedder: the length of a text, and how often it has an e."""
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query("""SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS e,
    (SELECT count(DISTINCT text) FROM documents WHERE doc_id % 2 = 0) AS asked_first, (SELECT count(DISTINCT text) FROM documents) AS asked FROM documents""")
def r5_embedded_once(spark, sf_dir):
    """Vectors of texts, asked for once each: first those of half of the documents, then what is new in all of them."""
    path = scratch(spark, "embedded")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked_once(docs.where("doc_id % 2 = 0"), counted, "array<double>", path)
    first = spark.read.parquet(path).count()
    out = asked_once(docs, counted, "array<double>", path)
    asked = spark.read.parquet(path).count()
    return out.select("doc_id", F.get("reply", F.lit(0)).alias("chars"), F.get("reply", F.lit(1)).alias("e"), F.lit(first).cast("long").alias("asked_first"), F.lit(asked).cast("long").alias("asked"))


@query("""SELECT p.source, p.parents, c.chunks, 2 AS generation FROM (SELECT source, count(*) AS parents FROM documents GROUP BY source) p
    JOIN (SELECT source, CAST(sum(greatest(1, ceil(length(coalesce(text, '')) / 400.0))) AS BIGINT) AS chunks FROM documents GROUP BY source) c ON c.source IS NOT DISTINCT FROM p.source""")
def r19_generations(spark, sf_dir):
    """Parents and chunks that change together: an old pair, then the rebuilt one, read at one generation."""
    store = Generations(spark, scratch(spark, "index"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    pieces = X.chunks_of(F.col("text"), 400)
    chunks = docs.select("doc_id", "source", F.explode(F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))).alias("chunk"))
    store.publish({"parents": docs.limit(1), "chunks": chunks.limit(1)})
    store.publish({"parents": docs, "chunks": chunks})
    now = store.current()
    parents = store.read("parents", now).groupBy("source").agg(F.count("*").alias("parents"))
    per = store.read("chunks", now).groupBy(F.col("source").alias("own")).agg(F.count("*").alias("chunks"))
    return parents.join(per, F.col("source").eqNullSafe(F.col("own"))).select("source", "parents", "chunks", F.lit(now).alias("generation"))


@query(f"""{VECTORS} SELECT query_id, vec_id, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({COSINE})) WHERE rank <= 10""")
def r6_vector_cells(spark, sf_dir):
    """Cosine top-k from stored cells: the nearest ones, and those that can hold something better."""
    folder = scratch(spark, "cells")
    rows, queries = vectors(spark, sf_dir)
    V.write_cells(rows.select("vec_id", "embedding"), folder, cells=32)
    return V.ask_cells(spark, folder, queries, probes=4).select("query_id", "vec_id", "rank")


@query("""SELECT log_file, count(*) AS hits FROM ev WHERE contains(lower('asks about item ' || coalesce(CAST(k AS VARCHAR), '')), 'item 77') GROUP BY 1""")
def f3_text_index(spark, sf_dir):
    """Free text by way of the trigrams of each log file: files that cannot have it aren't looked at."""
    rows = audit(spark, sf_dir).withColumn("user_query", F.concat(F.lit("Asks about ITEM "), F.coalesce(F.col("k").cast("string"), F.lit(""))))
    path = scratch(spark, "grams")
    M.text_index(rows, ("user_query",)).write.parquet(path)
    files = M.files_that_may_say(spark.read.parquet(path), "Item 77")
    some = rows.join(F.broadcast(files), "log_file", "left_semi")
    return some.where(M.says(some, "Item 77", ("user_query",))).groupBy("log_file").agg(F.count("*").alias("hits"))
