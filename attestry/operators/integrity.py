"""Hash-chained logs: written in order for each file, verified in parallel."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from ..sources.store import Generations
from ..streaming.fold import in_order

GENESIS = "0" * 64


def canonical(record: dict) -> str:
    return json.dumps(record, ensure_ascii=False, sort_keys=True)


def chained(records: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """(log_file, line_no, body, prev_hash, entry_hash): each record hashed with the one before, by file.

    `last` (log_file, entry_hash) has the ends of chains that are gone on with; other files begin with GENESIS. Each hash
    needs the one before, so a file is written by one task, which holds one hash; a file is a day of one service.
    """

    def step(prev: str | None, row: tuple) -> tuple[str, list[tuple]]:
        prev = prev or row.before
        entry = hashlib.sha256((prev + canonical(json.loads(row.body))).encode()).hexdigest()
        return entry, [(row.log_file, row.line_no, row.body, prev, entry)]

    rows = records.select("log_file", "line_no", "body")
    if last is None:
        rows = rows.withColumn("before", F.lit(GENESIS))
    else:
        rows = rows.join(last.select("log_file", F.col("entry_hash").alias("before")), "log_file", "left").fillna(GENESIS, ["before"])
    return in_order(rows, "log_file", "line_no", step, "log_file string, line_no long, body string, prev_hash string, entry_hash string")


@F.pandas_udf(StringType())
def _canonical_text(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in bodies:
        out = []
        for body in part:
            try:
                out.append(canonical(json.loads(body)))
            except (TypeError, ValueError):
                out.append(None)
        yield pd.Series(out, dtype=object)


def verified(chain: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(log_file, valid, broken_at, reason, total): the first line whose link or hash is wrong; malformed lines are.

    Each line is checked on its own against the one before; total counts the lines up to the failure. `ends` (log_file,
    entry_hash) has the hashes that files go on from, where the chain does not have their first lines.
    """
    before = F.lag("entry_hash", 1).over(Window.partitionBy("log_file").orderBy("line_no"))
    if ends is None:
        before = F.coalesce(before, F.when(F.row_number().over(Window.partitionBy("log_file").orderBy("line_no")) == 1, GENESIS))
    else:
        chain = chain.join(ends.select("log_file", F.col("entry_hash").alias("_end")), "log_file", "left")
        first = F.row_number().over(Window.partitionBy("log_file").orderBy("line_no")) == 1
        before = F.coalesce(before, F.when(first, F.coalesce("_end", F.lit(GENESIS))))
    text = _canonical_text("body")
    reason = (
        F.when(text.isNull(), "malformed line").when(F.coalesce("prev_hash", F.lit("")) != F.coalesce("before", F.lit("")), "prev_hash mismatch")
        .when(F.sha2(F.concat("prev_hash", text), 256) != F.coalesce("entry_hash", F.lit("")), "entry_hash mismatch")
    )
    rows = chain.withColumn("before", before).withColumn("why", reason)
    first = F.min(F.when(F.col("why").isNotNull(), F.struct("line_no", "why")))
    return rows.groupBy("log_file").agg(first.alias("f"), F.count("*").alias("n"), F.max("line_no").alias("last")).select(
        "log_file", F.col("f").isNull().alias("valid"), F.col("f.line_no").alias("broken_at"), F.col("f.why").alias("reason"),
        F.coalesce("f.line_no", "n").alias("total"),
    )


def integrity_state(checked: DataFrame, days: DataFrame) -> DataFrame:
    """One row (files, broken, state) over the files of some days (log_file): broken if any chain is, intact otherwise."""
    some = checked.join(days.select("log_file").distinct(), "log_file", "left_semi")
    bad = F.count(F.when(~F.col("valid"), 1))
    return some.agg(F.count("*").alias("files"), bad.alias("broken"), F.when(bad > 0, "broken").otherwise("intact").alias("state"))


def broken_chain_alerts(checked: DataFrame) -> DataFrame:
    """A critical alert for each broken chain: severity, source, title, message, dedup_key, log_file, broken_at, total."""
    return checked.where(~F.col("valid")).select(
        F.lit("critical").alias("severity"), F.lit("integrity").alias("source"), F.concat(F.lit("audit chain broken — "), "log_file").alias("title"),
        F.concat("log_file", F.lit(" is broken at line "), "broken_at", F.lit(": "), "reason").alias("message"),
        F.concat_ws(":", F.lit("integrity"), "log_file", "broken_at").alias("dedup_key"), "log_file", "broken_at", "total",
    )


_STATE = "log_file string, lines long, last_line long, entry_hash string, broken_at long, reason string"


def verify_new(spark: SparkSession, log: str, state: str, checkpoint: str) -> int:
    """Verifies the lines that chained logs at `log` (Parquet: log_file, line_no, body, prev_hash, entry_hash) have got since the
    last call, and keeps what is known of each file as a generation of `state`. Returns how many lines were read.

    What has been read is known by `checkpoint`, so files of the log that were there before aren't opened again. A chain goes on
    from the last hash that was verified, and its first break stays. A batch that is run again after a failure takes the state that
    it began with, for a generation names the batch that made it. Lines that were changed after they had been read show in a full pass
    (`verified`) only.
    """
    kept, read = Generations(spark, state), []

    def take(lines: DataFrame, batch: int) -> None:
        done = kept.read("batches")
        if done is not None and done.where(F.col("batch") == batch).count():
            return  # this batch had been published before the failure
        old = kept.read("files")
        old = spark.createDataFrame([], _STATE) if old is None else old
        lines = lines.select("log_file", "line_no", "body", "prev_hash", "entry_hash")
        read.append(lines.count())
        new = verified(lines, old).select("log_file", "broken_at", "reason")
        size = lines.groupBy("log_file").agg(F.count("*").alias("n"), F.max("line_no").alias("to"), F.max_by("entry_hash", "line_no").alias("end"))
        both = old.join(new.join(size, "log_file").withColumnsRenamed({"broken_at": "new_broken", "reason": "new_reason"}), "log_file", "full")
        known = F.col("broken_at").isNotNull()
        files = both.select(
            "log_file", (F.coalesce("lines", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("lines"), F.coalesce("to", "last_line").alias("last_line"),
            F.coalesce("end", "entry_hash").alias("entry_hash"), F.when(known, F.col("broken_at")).otherwise(F.col("new_broken")).alias("broken_at"),
            F.when(known, F.col("reason")).otherwise(F.col("new_reason")).alias("reason"),
        )
        kept.publish({"files": files, "batches": spark.createDataFrame([(batch,)], "batch long")})

    schema = "log_file string, line_no long, body string, prev_hash string, entry_hash string"
    stream = spark.readStream.schema(schema).parquet(log).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
    return sum(read)


def kept_integrity(spark: SparkSession, state: str, days: list[str] | None = None) -> str:
    """intact, broken, or unknown before the first check, of all files or of those of some days, from the kept state."""
    files = Generations(spark, state).read("files")
    if files is None:
        return "unknown"
    if days is not None:
        files = files.where(F.col("log_file").isin(days))
    return "broken" if files.where(F.col("broken_at").isNotNull()).limit(1).count() else "intact"


def new_break_alerts(spark: SparkSession, state: str) -> DataFrame:
    """broken_chain_alerts of the breaks that the current generation of the state has and the one before had not."""
    kept = Generations(spark, state)
    now, before = kept.read("files"), kept.read("files", max(0, kept.current() - 1))
    if now is None:
        now = spark.createDataFrame([], _STATE)
    broken = now.where(F.col("broken_at").isNotNull())
    if before is not None:
        broken = broken.join(before.where(F.col("broken_at").isNotNull()).select("log_file"), "log_file", "left_anti")
    return broken_chain_alerts(broken.select("log_file", F.lit(False).alias("valid"), "broken_at", "reason", F.col("lines").alias("total")))
