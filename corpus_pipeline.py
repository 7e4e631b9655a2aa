"""A training corpus from the table of documents, stage by stage. Each stage is written as Parquet and read again.

Stages read and return whole documents, so the pipeline bounds the batches of its session (`set_bounds`) for good.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.llm.decontamination import drop_contaminated
from attestry.llm.exact_dedup import drop_copies
from attestry.llm.mixing import mix_documents, mix_pieces
from attestry.llm.near_dup import drop_near_duplicates
from attestry.llm.quality import keep_quality
from attestry.llm.shared import keep, set_bounds


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_bounds(spark)
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_bounds(spark)
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_bounds(spark)
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_bounds(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_bounds(spark)
    return mix_documents(docs)


STAGES = [
    ("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near),
    ("benchmark decontamination", benchmark), ("source mixing", mix),
]

#: Discriminant, similarity join, BM25 search and schedule are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages but the last keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, cleaned(spark, sf_dir), sf_dir)


def write_corpus(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Writes the corpus to `folder`: documents (those that are kept, whole) and order, sorted by slot: slot, source, block, doc_id,
    epoch, first_word, end_word, which says what words of which document come next. An empty corpus is two empty tables."""
    set_bounds(spark)
    docs = cleaned(spark, sf_dir)
    docs.write.parquet(f"{folder}/documents")
    order = mix_pieces(docs).where("slot is not null").select("slot", "source", "block", "doc_id", "epoch", "first_word", "end_word")
    order.repartitionByRange("slot", "epoch", "doc_id").sortWithinPartitions("slot", "epoch", "doc_id").write.parquet(f"{folder}/order")
