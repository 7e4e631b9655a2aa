"""Answers: reasoning blocks, clauses that report a gap, and the gate that accepts, retries or replaces an answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import article_numbers, citation_count

# Phrases of an answer that reports a gap.
GAPS = ("尚未收錄", "無法提供", "未發現", "未檢索到", "沒有相關")
# Fixed value: where a clause ends.
CLAUSE_END = r"[。！？；;，,\n]+|但是|但|然而"
# Fixed value: how a refusal of questions out of scope begins.
REFUSAL = "本系統僅提供法律文件"
# Words of which a complete answer has one.
STRUCTURE = ("具體條文", "參考資料")
# Fixed value: the answer in place of one whose citations stay unfounded.
FAIL_SAFE = "目前無法從已檢索資料確認回答中的條文引用，為避免提供無據內容，本次不提供該回答；請重新查詢或由人工查證原文。"
MAX_RETRIES, SHORT = 2, 50


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def reported_missing(text: Column) -> Column:
    """Articles that only clauses with a gap phrase name. A text without such a phrase is not looked at any further."""
    numbered = F.transform(
        F.filter(F.split(text, CLAUSE_END), lambda c: has_any(c, GAPS) | c.contains("條")), lambda c: F.struct(has_any(c, GAPS).alias("gap"), article_numbers(c).alias("n"))
    )

    def named(clauses: Column) -> Column:
        pick = lambda gap: F.flatten(F.transform(F.filter(clauses, lambda c: c["gap"] == F.lit(gap)), lambda c: c["n"]))
        return F.array_distinct(F.array_except(pick(True), pick(False)))

    # the clauses are bound once, as the only element of an array
    found = F.element_at(F.transform(F.array(numbered), named), 1)
    return F.when(has_any(text, GAPS), found).when(text.isNotNull(), F.array().cast("array<int>"))


def gated(rows: DataFrame) -> DataFrame:
    """rows (question, answer, evidence array<string>, retry_count) with ungrounded, scope, next_retry, action, reply.

    Null texts count as empty, null evidence as none, a null retry_count as 0. Tests run in this order: citations
    without evidence, a gap reported beside cited evidence, short or refusing, gap without citation, retries used up,
    then citations with structure.
    """
    full = rows.withColumns({
        "__a": F.coalesce("answer", F.lit("")), "__n": F.coalesce("retry_count", F.lit(0)),
        "__cited": article_numbers(F.coalesce("answer", F.lit(""))),
        "__missing": reported_missing(F.coalesce("answer", F.lit(""))), "__asked": article_numbers(F.coalesce("question", F.lit(""))),
        "__got": F.array_distinct(F.flatten(F.transform(F.coalesce("evidence", F.array().cast("array<string>")), article_numbers))),
    })
    answer, tries, got = F.col("__a"), F.col("__n"), F.col("__got")
    extra = F.array_except("__cited", got)
    honest = F.array_intersect(F.array_intersect("__missing", "__asked"), extra)
    full = full.withColumn("ungrounded", F.array_except(extra, honest))
    used_up, gap, cites = tries >= MAX_RETRIES, has_any(answer, GAPS), citation_count(answer) > 0
    action = (
        F.when((F.size("ungrounded") > 0) & used_up, "failed_safe(ungrounded_citation)")
        .when(F.size("ungrounded") > 0, "needs_retry(ungrounded_citation)")
        .when(~used_up & gap & F.arrays_overlap("__cited", got), "needs_retry(contradictory_no_info)")
        .when((F.length(answer) < SHORT) | answer.contains(REFUSAL), "passed(non_substantive)")
        .when(gap & ~cites, "passed(no_info)").when(used_up, "passed(retry_limit)")
        .when(cites & has_any(answer, STRUCTURE), "passed(regex)").otherwise("needs_retry(regex)")
    )
    full = full.withColumn("action", action)
    again = F.startswith("action", F.lit("needs_retry"))
    return full.withColumns({
        "scope": F.when(again, "needs_retry").otherwise("verified"), "next_retry": tries + again.cast("int"),
        "reply": F.when(F.startswith("action", F.lit("failed_safe")), FAIL_SAFE).otherwise(F.col("answer")),
    }).drop("__a", "__n", "__cited", "__got", "__missing", "__asked")


def reasoning(text: Column, heading: str, section: str) -> Column:
    """The text between a leading heading and the next section, trimmed; empty without either or inside think tags.

    Both are patterns of whole lines, such as `#+ *依據`.
    """
    found = F.regexp_extract(text, rf"(?s)\A\s*(?-s:{heading})[^\n]*\n(.*?)(?=^(?-s:{section}))".replace("(?s)", "(?sm)", 1), 1)
    return F.when(F.lower(text).contains("<think>"), "").otherwise(F.trim(F.regexp_replace(found, r"(?U)^\s+|\s+$", "")))


def folded(text: Column, heading: str, section: str) -> Column:
    """The reasoning as a think block before the answer; a text without it stays as it is."""
    why = reasoning(text, heading, section)
    answer = F.regexp_extract(text, rf"(?sm)\A\s*(?-s:{heading})[^\n]*\n.*?(^(?-s:{section}).*)\z", 1)
    return F.when(why != "", F.concat(F.lit("<think>\n"), why, F.lit("\n</think>\n\n"), answer)).otherwise(text)
