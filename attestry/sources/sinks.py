"""Writers: partitioned appends, and rewrites that drop or replace what belongs to a source or session."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.integrity import chained


def append_audit(events: DataFrame, path: str) -> None:
    """Appends events by day, in one file for each day and task."""
    events.withColumn("log_date", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("log_date").parquet(path)


def append_chained(records: DataFrame, path: str) -> None:
    """Appends records (log_file, line_no, body) to chained logs: a file that is there already is gone on with from its
    last hash, and lines are numbered after its last line. One writer at a time."""
    spark = records.sparkSession
    try:
        old = spark.read.parquet(path).select("log_file", "line_no", "entry_hash")
    except AnalysisException:  # nothing has been written yet
        old = spark.createDataFrame([], "log_file string, line_no long, entry_hash string")
    last = old.groupBy("log_file").agg(F.max("line_no").alias("lines"), F.max_by("entry_hash", "line_no").alias("entry_hash"))
    rows = records.join(last.select("log_file", "lines"), "log_file", "left").withColumn("line_no", F.col("line_no") + F.coalesce("lines", F.lit(0)))
    chained(rows, last).write.mode("append").parquet(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Appends alerts as JSON lines, by day."""
    alerts.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def save_snapshot(snapshot: DataFrame, path: str, name: str) -> None:
    """Writes a snapshot under a name of its own; an earlier one of that name is an error."""
    snapshot.write.json(f"{path}/{name}")


def append_observations(observations: DataFrame, path: str) -> None:
    """Appends observed flips to the ledger of stability."""
    observations.write.mode("append").parquet(path)


def emptied(spark: SparkSession, path: str) -> int:
    """Empties a table, and returns how many rows it had."""
    old = spark.read.parquet(path)
    rows = old.count()
    spark.createDataFrame([], old.schema).write.mode("overwrite").parquet(path)
    return rows


def insert_messages(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").parquet(path)


def index_documents(parents: DataFrame, chunks: DataFrame, folder: str, rebuild: bool = False) -> None:
    """Writes parents and their chunks by source: those of the given sources are replaced, or with `rebuild` everything is."""
    for name, rows in (("parents", parents), ("chunks", chunks)):
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static" if rebuild else "dynamic")
        writer.partitionBy("source").parquet(f"{folder}/{name}")


def clear_index(spark: SparkSession, folder: str) -> None:
    """Leaves empty tables with the same columns."""
    for name in ("parents", "chunks"):
        empty = spark.read.parquet(f"{folder}/{name}").limit(0)
        spark.createDataFrame([], empty.schema).write.mode("overwrite").parquet(f"{folder}/{name}")


def append_probes(probes: DataFrame, path: str) -> None:
    """Appends probes by month, so that no file is ever rotated away."""
    probes.withColumn("month", F.substring("timestamp", 1, 7)).write.mode("append").partitionBy("month").parquet(path)


def without_source(chunks: DataFrame, parents: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """The chunks of other sources, and the parents that no chunk of the source names; removed_chunks counts the others."""
    gone = chunks.where(F.col("source") == source).select("doc_id").distinct()
    return chunks.where(~F.col("source").eqNullSafe(F.lit(source))), parents.join(gone, "doc_id", "left_anti")


def removed_chunks(chunks: DataFrame, source: str) -> int:
    return chunks.where(F.col("source") == source).count()


def replace_source(table: DataFrame, path: str) -> None:
    """Overwrites only the partitions of the sources in `table`."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def without_session(messages: DataFrame, session: str) -> DataFrame:
    return messages.where(~F.col("session_id").eqNullSafe(F.lit(session)))


def markdown_lines(table: DataFrame) -> DataFrame:
    """One column, value: a row of a markdown table for each row, pipes escaped, nulls empty."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in table.columns]
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def write_report(table: DataFrame, folder: str) -> None:
    """Writes a report as JSON lines and as the rows of a markdown table; its header is a file of its own."""
    head = ["| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
    table.write.mode("overwrite").json(f"{folder}/json")
    table.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/markdown/head")
    markdown_lines(table).write.mode("overwrite").text(f"{folder}/markdown/rows")
