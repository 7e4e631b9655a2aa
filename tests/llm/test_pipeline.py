"""The pipeline against brute force, each stage on its own input."""

import corpus_pipeline

from . import brute

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    names = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SMALL).cache()
        ids = {r.doc_id for r in out.collect()}
        if name == "quality classifier":
            known = [(labels[i], i in ids) for i, _ in before if i in labels]
            assert sum(bool(y) == kept for y, kept in known) >= 0.9 * len(known)
        elif name == "exact dedup":
            last = {t: i for i, t in sorted(before)}
            assert ids == set(last.values())
        elif name == "n-gram Jaccard join":
            assert ids == {i for i, (_, c) in brute.near(before, 5, 80).items() if i == c}
        elif name == "benchmark decontamination":
            assert ids == {i for i, t in before if not any(x.lower() in t.lower() for x in items)}
        else:
            assert ids == {i for i, _ in before}
            assert "taken" in out.columns
            break
        assert out.columns == names
        docs = out


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and all(r.taken <= 2 * r["size"] for r in rows)


def test_corpus_is_written(spark, tmp_path):
    """The order names each word that the mix takes, in slots of one source's block."""
    corpus_pipeline.write_corpus(spark, SMALL, f"{tmp_path}/corpus")
    docs = {r.doc_id: brute.words(r.text) for r in spark.read.parquet(f"{tmp_path}/corpus/documents").collect()}
    order = spark.read.parquet(f"{tmp_path}/corpus/order").collect()
    taken, blocks = {}, {}
    for r in order:
        assert 0 <= r.first_word < r.end_word <= len(docs[r.doc_id])
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.end_word - r.first_word
        blocks.setdefault(r.slot, []).append((r.source, r.block, r.end_word - r.first_word))
    assert all(len({x[:2] for x in b}) == 1 and sum(x[2] for x in b) <= 256 for b in blocks.values())
    assert {i: n for i, n in taken.items()} == {r.doc_id: r.taken for r in corpus_pipeline.run(spark, SMALL).collect() if r.taken}


def test_stages_on_an_empty_table(spark, tmp_path):
    """Each stage on what the one before leaves of nothing, written and read again."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.count() == 0
