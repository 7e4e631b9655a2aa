"""Comparisons: bias between paired answers, judge scores, variants of retrieval and of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .answers import REFUSAL
from .evaluate import keyword_coverage
from .monitor import grouped


def answer_pairs(answers: DataFrame) -> DataFrame:
    """(group_id, keywords, answer_a, answer_b) from answers (group_id, n, answer, keywords): those of n = 0 and 1."""
    nth = lambda n: F.max(F.when(F.col("n") == n, F.col("answer")))
    pairs = answers.where("n in (0, 1)").groupBy("group_id").agg(F.first("keywords", True).alias("keywords"), nth(0).alias("answer_a"), nth(1).alias("answer_b"))
    return pairs.where("answer_a is not null and answer_b is not null")


def bias(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """pairs with keyword_consistency, rejection_consistent and passed."""
    a, b = F.col("answer_a"), F.col("answer_b")
    far = F.abs(keyword_coverage(a, F.col("keywords")) - keyword_coverage(b, F.col("keywords")))
    scored = pairs.withColumns({"keyword_consistency": 1 - far, "rejection_consistent": a.contains(REFUSAL) == b.contains(REFUSAL)})
    return scored.withColumn("passed", F.col("rejection_consistent") & (F.col("keyword_consistency") >= least))


def bias_summary(scored: DataFrame) -> DataFrame:
    """One row; without groups the rate is 1."""
    passed = F.count(F.when(F.col("passed"), 1))
    return scored.agg(F.count("*").alias("groups"), passed.alias("passed"), F.coalesce(F.try_divide(passed, F.count("*")), F.lit(1.0)).alias("pass_rate"))


def judged_summary(rows: DataFrame) -> DataFrame:
    """One row from rows (status, faithfulness, answer_relevancy, context_precision).

    Faithfulness is the mean over status ok alone; a null status is unavailable. skipped rows have no metric at all;
    no_coverage_rate counts no_coverage and abstention. breakdown maps each status to its rows.
    """
    status = F.coalesce("status", F.lit("unavailable"))
    ok = status == "ok"
    names = ("answer_relevancy", "context_precision")
    per = rows.groupBy(status.alias("status")).agg(
        F.count("*").alias("n"), F.count(F.when(ok, F.col("faithfulness"))).alias("scored"), F.sum(F.when(ok, F.col("faithfulness"))).alias("total"),
        F.count(F.when(~ok & F.col(names[0]).isNull() & F.col(names[1]).isNull(), 1)).alias("bare"),
        *[f(c).alias(f"{c}_{k}") for c in names for k, f in (("n", F.count), ("t", F.sum))],
    )
    mean = lambda t, n: F.round(F.try_divide(F.sum(t), F.sum(n)), 4)
    gone = F.coalesce(F.sum(F.when(F.col("status").isin("no_coverage", "abstention"), F.col("n"))), F.lit(0))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("sample_size"), F.coalesce(F.sum("scored"), F.lit(0)).alias("evaluated"),
        mean("total", "scored").alias("faithfulness"), *[mean(f"{c}_t", f"{c}_n").alias(c) for c in names],
        F.coalesce(F.sum("bare"), F.lit(0)).alias("skipped"), F.round(F.try_divide(gone, F.sum("n")), 4).alias("no_coverage_rate"),
        F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("breakdown"),
    )


def overall(*metrics: Column) -> Column:
    """The mean of the metrics that are not null; null if all are."""
    some = F.array_compact(F.array(*metrics))
    return F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, x: a + x), F.size(some))


def variants(rows: DataFrame) -> DataFrame:
    """One row a variant from rows (variant, expected, retrieved, latency_ms); queries without expected ones are left out.

    Sets are compared; f1 is that of the means; the p95 is the value at place floor(0.95 (n - 1)) in order.
    """
    want, got = F.array_distinct("expected"), F.array_distinct(F.filter("retrieved", lambda x: x != ""))
    some = rows.where(F.size("expected") > 0).withColumn("n", F.size(F.array_intersect(want, got)))
    some = some.select("variant", "latency_ms", (F.col("n") > 0).cast("double").alias("hit"), (F.col("n") / F.greatest(F.size(got), F.lit(1))).alias("p"), (F.col("n") / F.size(want)).alias("r"))
    out = grouped(some, ["variant"], F.col("latency_ms"), "P5", n=F.lit(1), hit=F.col("hit"), p=F.col("p"), r=F.col("r"), total_ms=F.col("latency_ms"))
    out = out.withColumns({c: F.col(c) / F.col("n") for c in ("hit", "p", "r")})
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return out.select(
        "variant", "n", F.round("hit", 4).alias("hit_rate"), F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"),
        F.floor(F.try_divide("total_ms", "measured")).alias("avg_latency_ms"), F.col("p95_ms").alias("p95_latency_ms"),
    )


def prompt_runs(rows: DataFrame) -> DataFrame:
    """(version, id, hits, valid, empties) of repeated runs (version, id, hit); a null hit is a run without answer."""
    return rows.groupBy("version", "id").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count("hit").alias("valid"), (F.count("*") - F.count("hit")).alias("empties"))


def judge_cases(rows: DataFrame) -> DataFrame:
    """One row a case from replies (case_id, band, valid, abstained, score): is the judge stable, and right in direction?"""
    out = rows.groupBy("case_id", "band").agg(
        F.count("*").alias("replies"), F.count(F.when(F.col("valid"), 1)).alias("valid"), F.count(F.when(F.col("abstained"), 1)).alias("abstentions"),
        F.round(F.median("score"), 3).alias("median"), (F.count_distinct("score") <= 1).alias("stable"),
    )
    m = F.col("median")
    right = F.when(F.col("band") == "abstain", F.col("abstentions") >= 1).when(F.col("band") == "high", m >= 0.8)
    right = right.when(F.col("band") == "low", m <= 0.5).when(F.col("band") == "mid", m.between(0.3, 0.85))
    return out.withColumn("direction_ok", F.coalesce(right, F.lit(False)))
