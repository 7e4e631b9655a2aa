"""Queries over ids, vectors and texts that the small tables do not have."""

import math
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attestry.functions import split as X
from attestry.operators import postings as P, retrieve as R, scoring as S

from .oracle import TABLES, differences

SMALL = "/root/testdata/sf0.001"


def test_sizes_up_to_terabytes(spark, tmp_path):
    rows = spark.createDataFrame([(1023,), (1152,), (1408,), (5 << 27,), (9 << 37,)], "n long")
    assert [r[0] for r in rows.select(S.shown_size(F.col("n"))).collect()] == ["1023.00 B", "1.12 KB", "1.38 KB", "640.00 MB", "1.12 TB"]
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    ids = spark.createDataFrame([(i,) for i in (1, 40, 1023, 1025, 32_767, 32_768, 40_001, 1_048_575, 1_048_576, 3_000_000)], "doc_id long")
    ids.withColumn("text", F.lit("a")).toPandas().to_parquet(tmp_path / "documents.parquet")
    assert differences(entry.queries()["z16_z30_conversions"](spark, str(tmp_path)), entry.oracle_sql()["z16_z30_conversions"], str(tmp_path)) == ""


def test_vectors_are_scored_in_bounded_blocks(spark, monkeypatch):
    """A matrix of scores has no more than BLOCK cells, whatever the batch; groups, ties and ids of text stay exact."""
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((400, 5)), 1)
    x[50:150] = x[7]  # many ties
    rows = [(f"v{i:03}", v.tolist(), None if i % 11 == 0 else i % 4) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int").coalesce(1)
    asked = df.where("label = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sim = np.round(unit @ unit.T, 9)

    def best(k, by):
        out = set()
        for i in (i for i, r in enumerate(rows) if r[2] == 1):
            for own in {r[2] for r in rows} if by else {0}:
                js = sorted((j for j in range(400) if not by or rows[j][2] == own), key=lambda j: (-sim[i, j], j))[:k]
                out |= {(rows[i][0], n + 1, rows[j][0]) for n, j in enumerate(js)}
        return out

    for block, held, full in ((1 << 20, 1 << 19, 1 << 22), (700, 50, 200)):
        monkeypatch.setattr(R, "BLOCK", block), monkeypatch.setattr(R, "HELD", held), monkeypatch.setattr(R, "FULL", full)
        for k, by in ((5, []), (3, ["label"])):
            got = R.cosine_top_k(df, asked, k, by).collect()
            assert {(r.query_id, r["rank"], r.vec_id) for r in got} == best(k, by)
    batch = pd.DataFrame({"vec_id": range(10_000)})
    monkeypatch.undo()
    shapes = [len(b) for b in R.blocks_of(iter([batch]), 12_000)]
    assert sum(shapes) == 10_000 and max(shapes) * 12_000 <= R.BLOCK


def test_words_are_scored_where_documents_are(spark, tmp_path):
    """No row for each query and document is shuffled, by the texts or by stored postings; ties and copies stay exact."""
    texts = ["all w1 w2"] * 40 + [f"all w{i % 7} w{i % 3}\tw{i % 3}" for i in range(200)] + [None, "", "all\x1call"]
    docs = spark.createDataFrame([(i, f"s{i % 2}", x) for i, x in enumerate(texts)], "doc_id long, source string, text string")
    asked = spark.createDataFrame([(1, "w1 w2 all all"), (2, "w3 none"), (3, ""), (4, None)], "query_id long, text string")
    words = [x.replace("\t", " ").split(" ") if x else [] for x in texts]
    df = {w: sum(w in x for x in words) for x in words for w in x}
    idf = {w: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean, size = sum(idf.values()) / len(idf), sum(map(len, words)) / (len(texts) - 1)
    want = {}
    for q, text in ((1, "w1 w2 all all"), (2, "w3 none")):
        score = {}
        for i, x in enumerate(words):
            parts = [(idf[w] if idf[w] >= 0 else 0.25 * mean) * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / size)) for w in text.split() if w in x]
            if parts:
                score[i] = sum(parts)
        want |= {(q, n + 1): i for n, i in enumerate(sorted(score, key=lambda i: (-round(score[i], 6), i))[:10])}
    found = R.bm25(docs, asked)
    assert {(r.query_id, r["rank"]): r.doc_id for r in found.collect()} == want
    stored = docs.where("text is not null")
    P.write_index(stored, f"{tmp_path}/index")
    kept = P.ask_index(spark, f"{tmp_path}/index", asked)
    same = lambda rows: {(r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in rows.collect()}
    assert same(kept) == same(R.bm25(stored, asked))
    for rows in (found, kept):
        plan = rows._jdf.queryExecution().toString()
        assert not re.search(r"hashpartitioning\([^)]*query_id#\d+L?, doc_id", plan)


def test_postings_of_a_document_over_batches():
    wanted = pa.table({"query_id": [1, 2], "token": ["a", "b"], "times": [1, 1]})
    asked = R.Asked.of(wanted, {"a": 1.0, "b": 2.0}, 3.0)
    rows = [(d, 3, x, 1) for d in range(5) for x in "ab"]
    for cut in range(1, len(rows)):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("doc_id", "len", "token", "tf"), r)) for r in part]) for part in (rows[:cut], rows[cut:])]
        blocks = list(R.counted_postings(asked, iter(batches)))
        assert [d for b in blocks for d in b[0].to_pylist()] == list(range(5)) and sum(len(b[2]) for b in blocks) == 10
        assert all((asked.scores(len(b[0]), *b[1:]) > 0).all() for b in blocks)
    assert R.Asked.of(pa.table({"query_id": list(range(9_000)), "token": ["a"] * 9_000, "times": [1] * 9_000}), {"a": 1.0}, 1.0).rows() * 9_000 <= R.BLOCK


def test_chunks_do_not_wait_for_arrow_batches(spark):
    """A worker holds some texts at a time, not the 10000 of an Arrow batch."""
    df = spark.createDataFrame([("one two " * 200,), ("",), (None,)], "text string").select(X.chunked(F.col("text")).alias("c"))
    assert [r.c for r in df.collect()] == [X.chunks("one two " * 200, 800, 100), [], []]
    assert "ArrowEvalPython" not in df._jdf.queryExecution().toString()
