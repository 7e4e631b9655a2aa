"""Exact dedup: two passes with a Bloom filter find the rows whose text may repeat; only those shuffle.

The first pass sets slots for the hash of every row, in segments of the hash; a segment is a file of the shared folder.
The second pass looks every hash up in the mapped files. Each pass reads the rows once, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .mapped import RepeatFilter, repeat_filter
from .shared import join_groups, keep, text_or_empty, unused, within_bounds

def suspect(column: Column, made: RepeatFilter) -> Column:
    """Whether a hash may repeat; only the hashes go to Python."""

    @F.pandas_udf("boolean")
    def test(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in parts:
            yield pd.Series(made.may_repeat(h.to_numpy(np.int64).view(np.uint64)))

    return test(column)


def digest_of(text: str) -> Column:
    return F.sha2(text_or_empty(text), 256)


@within_bounds
def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest doc_id stays.

    Null text counts as empty. Rows that repeat both doc_id and text are rows of their own, each counted in group_size
    and each kept or dropped like the other; rows that share a doc_id but not the text are documents of their own. A
    null doc_id never stays beside a non-null one. Other columns of docs are ignored. An empty table gives an empty
    result.
    """
    prints = docs.select(F.col(doc_id).alias("doc_id"), digest_of(text).alias("text_sha256")).withColumn("h", F.xxhash64("text_sha256"))
    prints = keep(prints, "prints")
    rows = prints.count()
    made = repeat_filter(prints.select("h"), rows)
    flagged = keep(prints.withColumn("suspect", suspect(F.col("h"), made)).drop("h"), "flagged")
    alone = flagged.where("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    suspects = flagged.where("suspect").drop("suspect")
    groups = suspects.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = join_groups(suspects, groups, "text_sha256", "group_size", rows).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(found)


@within_bounds
def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; of rows that repeat doc_id and text one stays.

    Rows whose text occurs once pass straight through; of the others the copies that stay are found by digest first,
    so a text that a third of all rows have is not sent to one task.
    """
    key, sha, row = unused(docs, "hash", "sha", "row")
    hashed = docs.withColumn(sha, digest_of(text))
    prints = keep(hashed.select(F.xxhash64(sha).alias("h")), "prints")
    made = repeat_filter(prints, prints.count())
    hashed = hashed.withColumn(key, suspect(F.xxhash64(sha), made))
    alone = hashed.where(~F.col(key)).drop(key, sha)
    suspects = hashed.where(F.col(key)).select(sha, F.struct(*docs.columns).alias(row))
    # max by id within the map tasks first: each task sends one row for each text
    best = suspects.groupBy(sha).agg(F.max_by(row, F.struct(F.col(f"{row}.{doc_id}").isNotNull(), F.col(f"{row}.{doc_id}"))).alias(row))
    return alone.unionByName(best.select(f"{row}.*"))
