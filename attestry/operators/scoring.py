"""Scores of answers from a judge's replies, checks before and after an answer, and small rules of reports.

Replies come as columns: a judge, classifier or verifier is asked with sources.store.asked_once, or was asked before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import article_numbers, json_in_text
from ..sources.files import typed
from .answers import GAPS
from .evaluate import answer_class, unit_score

_STATUS = "struct<status:string,score:double,grounded:bigint,ungrounded:bigint>"


def parsed(reply: Column) -> Column:
    """The JSON object within a reply as a VARIANT; null without one. The functions below take it, so that a reply is read once."""
    return F.try_parse_json(json_in_text(reply))


def field(found: Column, name: str) -> Column:
    return F.try_variant_get(found, f"$.{name}", "variant")


def _count(found: Column, name: str) -> Column:
    """A count that a judge gives: an integer of 0 or more, and not true or false."""
    value = field(found, name)
    n = F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    return F.when(n >= 0, n)


def truthy(value: Column) -> Column:
    """Whether a VARIANT says yes: true, a number that is not 0, a text, list or object that is not empty."""
    shape, shown = F.schema_of_variant(value), F.to_json(value)
    number = shape.isin("BIGINT", "DOUBLE") | shape.startswith("DECIMAL")
    yes = F.when(number, F.try_variant_get(value, "$", "double") != 0).otherwise(~shown.isin("null", "false", '""', "[]", "{}"))
    return F.coalesce(yes, F.lit(False))


def judged_faithfulness(found: Column) -> Column:
    """(status, score, grounded, ungrounded) from what a judge says: ok with the score made anew from the counts, abstention where
    the judge says so or both counts are 0, unavailable where there is nothing or no use in its counts."""
    g, u = _count(found, "grounded_claims"), _count(found, "ungrounded_claims")
    abstains = truthy(field(found, "is_abstention")) | F.coalesce((g == 0) & (u == 0), F.lit(False))
    status = F.when(abstains, "abstention").when(F.coalesce(g + u > 0, F.lit(False)), "ok").otherwise("unavailable")
    score = F.when(status == "ok", F.round(g / (g + u), 4))
    return F.struct(status.alias("status"), score.alias("score"), g.alias("grounded"), u.alias("ungrounded")).cast(_STATUS)


def judged_score(found: Column) -> Column:
    """The score that a judge gives, if it is a number, within 0 and 1; null without one."""
    return F.round(unit_score(typed(field(found, "score"), T.DoubleType())), 4)


def scored_answers(rows: DataFrame, refusals: tuple[str, ...], gaps: tuple[str, ...] = GAPS) -> DataFrame:
    """rows (answer, context, retrieved array<string>, faithfulness_reply, relevancy_reply, precision_reply) with class, faithfulness
    (a struct of status, score and counts), relevancy and precision.

    Refusals and empty answers aren't judged: their status is their class, unavailable for an empty one. An answer without
    context has the status no_context and a relevancy only; precision needs documents that were retrieved.
    """
    kind = answer_class(F.col("answer"), refusals, gaps)
    bare = lambda status: F.struct(status.alias("status"), F.lit(None).alias("score"), F.lit(None).alias("grounded"), F.lit(None).alias("ungrounded")).cast(_STATUS)
    blank = F.regexp_replace(F.coalesce("context", F.lit("")), r"(?U)\s+", "") == ""
    answered = F.col("_class") == "answer"
    faith = (
        F.when(~answered, bare(F.when(F.col("_class") == "empty", "unavailable").otherwise(F.col("_class")))).when(blank, bare(F.lit("no_context")))
        .otherwise(judged_faithfulness(F.col("_f")))
    )
    rows = rows.withColumns({"_f": parsed(F.col("faithfulness_reply")), "_r": parsed(F.col("relevancy_reply")), "_p": parsed(F.col("precision_reply")), "_class": kind})
    out = rows.withColumns({
        "class": F.col("_class"), "faithfulness": faith, "relevancy": F.when(answered, judged_score(F.col("_r"))),
        "precision": F.when(answered & ~blank & (F.size("retrieved") > 0), judged_score(F.col("_p"))),
    })
    return out.drop("_f", "_r", "_p", "_class")


# Where a question goes by its class; any other one is looked up.
ROUTES = ("reject", "passthrough", "security_block", "capability", "prc_block")


def route(scope: Column) -> Column:
    """Where a classified question goes."""
    return F.when(scope.isin(*ROUTES), scope).otherwise("retrieve")


def route_after(scope: Column) -> Column:
    """Where a verified answer goes: back to be generated again, or out."""
    return F.when(scope == "needs_retry", "generate").otherwise("end")


def classified(reply: Column) -> Column:
    """legal, reject or passthrough from a classifier's reply; legal for anything else, so that no question is lost."""
    scope = F.lower(F.trim(typed(field(parsed(_flat(reply)), "scope"), T.StringType())))
    return F.when(scope.isin("legal", "reject", "passthrough"), scope).otherwise("legal")


def _flat(reply: Column) -> Column:
    """The first object without objects inside, of a reply."""
    return F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{[^{}]*\}", 0)


def post_check(answer: Column, reply: Column, refusal: str, short: int = 50) -> Column:
    """(needs_retry, reason) of an answer: short ones, refusals and honest gaps pass at once, others as a verifier's reply says;
    a reply without an object, or that can't be read, passes."""
    flat, found = _flat(reply), parsed(_flat(reply))
    gap = F.lit(False)
    for g in GAPS:
        gap = gap | answer.contains(g)
    result = lambda again, why: F.struct(again.alias("needs_retry"), why.alias("reason"))
    no = F.lit(False)
    return (
        F.when((F.length(answer) < short) | answer.contains(refusal), result(no, F.lit("non_substantive"))).when(gap, result(no, F.lit("honest_no_info")))
        .when(reply.isNull(), result(no, F.lit("verify_error"))).when(flat == "", result(no, F.lit("no_json")))
        .when(found.isNull(), result(no, F.lit("verify_error")))
        .otherwise(result(truthy(field(found, "needs_retry")), F.substring(F.coalesce(typed(field(found, "reason"), T.StringType()), F.lit("")), 1, 100)))
    )


def evidence_numbers(sources: Column, texts: Column) -> Column:
    """The article numbers that source ids or retrieved texts have."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(F.concat(F.coalesce(sources, none), F.coalesce(texts, none)), article_numbers)))


def ungrounded_citations(answer: Column, sources: Column, texts: Column) -> Column:
    """The article numbers that an answer names and neither source ids nor texts have."""
    return F.array_except(article_numbers(answer), evidence_numbers(sources, texts))


def severity_rank(severity: Column) -> Column:
    """info, warning and critical as 0, 1 and 2; null for anything else."""
    return F.when(severity == "info", 0).when(severity == "warning", 1).when(severity == "critical", 2)


def critical_ok(per_dep: Column, wanted: Column) -> Column:
    """Whether all wanted dependencies of a probe (a map to whether they answered) answer; all of them, where none is wanted."""
    some = F.map_filter(per_dep, lambda k, _: F.array_contains(wanted, k))
    used = F.when(F.size(some) > 0, some).otherwise(per_dep)
    return F.forall(F.map_values(used), lambda ok: F.coalesce(ok, F.lit(False)))


def last_month(probes: DataFrame, by: str = "series") -> DataFrame:
    """(series, month) of the last record (position, timestamp) of a log; null where it has no month."""
    last = probes.groupBy(by).agg(F.max_by(F.coalesce("timestamp", F.lit("")), "position").alias("t"))
    return last.select(by, F.when(F.length("t") >= 7, F.substring("t", 1, 7)).alias("month"))


def rerun_passed(answer: Column, passed: Column) -> Column:
    """Whether a query that was asked again passes: an empty answer fails."""
    return F.when(F.coalesce(answer, F.lit("")) == "", False).otherwise(passed)


def ab_hit(answer: Column, cited: Column, expected: Column) -> Column:
    """Whether an answer cites one of the expected articles; null for an empty answer, which says nothing about a prompt."""
    return F.when(F.coalesce(answer, F.lit("")) != "", F.arrays_overlap(cited, expected))


def shown_size(size: Column) -> Column:
    """A number of bytes with two decimals in the largest unit up to TB; halves go to the even digit."""
    value = size.cast("double")
    shown = lambda i, unit: F.format_string(f"%.2f {unit}", F.bround(value / 1024.0**i, 2))
    out = F.when(value < 1024, shown(0, "B"))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(value < 1024.0 ** (i + 1), shown(i, unit))
    return out.otherwise(shown(4, "TB"))


def conversion_records(converted: DataFrame, indexed: DataFrame) -> DataFrame:
    """(source, converted, indexed, message) of converted files (source, markdown, problem), by what the index has (source)."""
    done = indexed.select("source").distinct().withColumn("has", F.lit(True))
    rows = converted.join(done, "source", "left")
    ok, has = F.col("problem").isNull(), F.coalesce("has", F.lit(False))
    message = (
        F.when(~ok, F.concat(F.lit("Conversion failed: "), "problem")).when(has, F.concat(F.lit("Successfully converted and indexed: "), "source"))
        .otherwise(F.concat(F.lit("Indexing failed: "), "source"))
    )
    return rows.select("source", ok.alias("converted"), (ok & has).alias("indexed"), message.alias("message"))


def danger_histogram(flagged: DataFrame, level: Column) -> DataFrame:
    """(event_type, danger_level, n)."""
    return flagged.groupBy("event_type", level.alias("danger_level")).agg(F.count("*").alias("n"))


def by_type(events: DataFrame) -> DataFrame:
    """(event_type, n): events without a type are unknown."""
    return events.groupBy(F.coalesce("event_type", F.lit("unknown")).alias("event_type")).agg(F.count("*").alias("n"))


def breakdown(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n): the rows by each of the columns alone, the others null."""
    return rows.groupingSets([[c] for c in by], *by).agg(F.count("*").alias("n"))


def valid_replies(replies: DataFrame) -> DataFrame:
    """(case_id, valid_rate): the share of a case's replies (case_id, reply) that hold a JSON object."""
    valid = parsed(F.col("reply")).isNotNull().cast("double")
    return replies.groupBy("case_id").agg(F.round(F.avg(valid), 4).alias("valid_rate"))
