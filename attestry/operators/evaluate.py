"""Evaluation: rank metrics over arrays, answer scores, comparison of runs and attribution of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def norm(items: Column) -> Column:
    return F.transform(items, lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))


def _hits(top: Column, relevant: Column) -> Column:
    return F.size(F.filter(top, lambda x: F.array_contains(relevant, x)))


def hit_rate(retrieved: Column, relevant: Column) -> Column:
    return F.coalesce(F.arrays_overlap(retrieved, relevant), F.lit(False)).cast("double")


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Hits over the length of the cut list; a document that occurs twice counts twice."""
    top = F.slice(retrieved, 1, k)
    return F.coalesce(F.try_divide(_hits(top, relevant), F.size(top)), F.lit(0.0))


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    top = F.slice(retrieved, 1, k)
    return F.coalesce(F.try_divide(_hits(relevant, top), F.size(relevant)), F.lit(0.0))


def f1_at(retrieved: Column, relevant: Column, k: int) -> Column:
    p, r = precision_at(retrieved, relevant, k), recall_at(retrieved, relevant, k)
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    ranks = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda x: x.isNotNull())
    return F.coalesce(F.try_divide(F.lit(1.0), F.array_min(ranks)), F.lit(0.0))


def average_precision(retrieved: Column, relevant: Column) -> Column:
    """Each relevant document counts at its first place; the denominator is the number of different relevant ones."""
    firsts = F.transform(retrieved, lambda x, i: (F.array_position(retrieved, x) == i + 1) & F.array_contains(relevant, x))
    places = F.filter(F.transform(firsts, lambda hit, i: F.when(hit, i + 1)), lambda x: x.isNotNull())
    total = F.aggregate(F.transform(places, lambda place, i: (i + 1) / place), F.lit(0.0), lambda a, b: a + b)
    return F.coalesce(F.try_divide(total, F.size(F.array_distinct(relevant))), F.lit(0.0))


def rank_metrics(rows: DataFrame, k: int = 5) -> DataFrame:
    """rows (retrieved, relevant) with the six metrics; names are compared trimmed and in lower case."""
    got, want = norm(F.col("retrieved")), norm(F.col("relevant"))
    return rows.select(
        "*", hit_rate(got, want).alias("hit"), precision_at(got, want, k).alias("precision"), recall_at(got, want, k).alias("recall"),
        f1_at(got, want, k).alias("f1"), reciprocal_rank(got, want).alias("rr"), average_precision(got, want).alias("ap"),
    )


def macro_average(scored: DataFrame) -> DataFrame:
    """Means over the queries that have relevant documents."""
    some = scored.where(F.size("relevant") > 0)
    return some.agg(F.count("*").alias("evaluated"), *[F.avg(c).alias(c) for c in ("hit", "precision", "recall", "f1", "rr", "ap")])


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """Share of the keywords that the answer has, whatever the case; 1 without keywords."""
    found = F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))))
    return F.coalesce(F.try_divide(found, F.size(keywords)), F.lit(1.0))


def answer_score(keywords: Column, articles: Column, structure: Column, rejected: Column, in_scope: Column) -> Column:
    return F.when(rejected, 1.0).when(~in_scope, 0.0).otherwise(0.5 * keywords + 0.3 * articles + 0.2 * structure)


def answer_class(answer: Column, refusals: tuple[str, ...], gaps: tuple[str, ...]) -> Column:
    """empty, rejection_oos, no_coverage or answer."""
    has = lambda words: F.greatest(F.lit(False), *[answer.contains(w) for w in words])
    return F.when(F.coalesce(answer, F.lit("")).rlike(r"(?U)^\s*$"), "empty").when(has(refusals), "rejection_oos").when(has(gaps), "no_coverage").otherwise("answer")


def faithfulness(grounded: Column, not_grounded: Column) -> Column:
    return F.try_divide(grounded, grounded + not_grounded)


def unit_score(x: Column) -> Column:
    """Clamped to 0..1, null for null and NaN."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def flip_matrix(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(id, change): how each query went in two runs (id, passed); null passed is skipped."""
    both = baseline.select("id", F.col("passed").alias("b"), F.lit(True).alias("in_b")).join(
        current.select("id", F.col("passed").alias("c"), F.lit(True).alias("in_c")), "id", "full"
    )
    change = (
        F.when(F.col("in_c").isNull(), "only_baseline").when(F.col("in_b").isNull(), "only_current")
        .when(F.col("b").isNull() | F.col("c").isNull(), "skipped").when(F.col("b") & ~F.col("c"), "newly_failed")
        .when(~F.col("b") & F.col("c"), "newly_passed").when(F.col("c"), "still_passed").otherwise("still_failed")
    )
    return both.select("id", change.alias("change"))


def gate_verdict(changes: DataFrame) -> DataFrame:
    counts = [F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("newly_failed", "newly_passed", "only_baseline", "only_current")]
    return changes.agg(*counts).withColumn("verdict", F.when(F.col("newly_failed") > 0, "FAIL").otherwise("PASS"))


def rerun_verdict(runs: DataFrame) -> DataFrame:
    """(id, runs, passes, majority, unanimous, cleared) of repeated runs (id, passed)."""
    n, p = F.count("*"), F.count(F.when(F.col("passed"), 1))
    return runs.groupBy("id").agg(
        n.alias("runs"), p.alias("passes"), F.when(p * 2 > n, "pass").otherwise("fail").alias("majority"),
        ((p == n) | (p == 0)).alias("unanimous"), (p == n).alias("cleared"),
    )


def attribution(rows: DataFrame) -> DataFrame:
    """rows (expected, cited, retrieved arrays, is_hit) with label and hallucinated (a cited article is not retrieved)."""
    want, cited, got = F.col("expected"), F.col("cited"), F.col("retrieved")
    label = (
        F.when(F.size(want) == 0, "skipped").when(F.col("is_hit"), "hit").when(got.isNull(), "no-audit-match")
        .when(F.arrays_overlap(want, got), "G-miss").otherwise("R-miss")
    )
    return rows.withColumn("label", label).withColumn("hallucinated", F.coalesce(F.size(F.array_except(cited, got)) > 0, F.lit(False)))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two snapshots (path, sha256): added, deleted or modified."""
    both = old.select("path", F.col("sha256").alias("a")).join(new.select("path", F.col("sha256").alias("b")), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


# Fixed value: an article in a label or a token, its number as written.
LABEL_ARTICLE = r"(?U)第\s*([0-9〇零一二三四五六七八九十百兩]+)\s*條"


def law_article(label: Column) -> Column:
    """struct<law, article> of a label law.md#article, its number as written; null without # or without an article."""
    number = F.regexp_extract(F.regexp_extract(label, r"(?s)^[^#]*#(.*)$", 1), LABEL_ARTICLE, 1)
    law = F.regexp_replace(F.substring_index(label, "#", 1), r"\.md$", "")
    return F.when(F.contains(label, F.lit("#")) & (number != ""), F.struct(law.alias("law"), F.concat(F.lit("第"), number, F.lit("條")).alias("article")))


def law_articles(labels: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(labels, law_article)))


def expected_law_articles(docs: Column, names: Column) -> Column:
    """The expected (law, article) pairs: those of the labels, or the articles alone under the law * if there is none."""
    pairs = F.coalesce(law_articles(docs), F.array().cast("array<struct<law:string,article:string>>"))
    number = lambda t: F.regexp_extract(t, LABEL_ARTICLE, 1)
    alone = F.transform(F.filter(names, lambda t: number(t) != ""), lambda t: F.struct(F.lit("*").alias("law"), F.concat(F.lit("第"), number(t), F.lit("條")).alias("article")))
    return F.when(F.size(pairs) > 0, pairs).otherwise(F.coalesce(F.array_distinct(alone), F.array().cast("array<struct<law:string,article:string>>")))


def articles_of(pairs: Column) -> Column:
    return F.array_distinct(F.transform(pairs, lambda x: x["article"]))


def matched(expected: Column, candidates: Column) -> Column:
    """Whether any expected pair is a candidate; under the law * articles are compared without their law."""
    loose = F.exists(expected, lambda x: x["law"] == "*")
    return F.when(loose, F.arrays_overlap(articles_of(expected), articles_of(candidates))).otherwise(F.arrays_overlap(expected, candidates))


def attributed(rows: DataFrame) -> DataFrame:
    """rows (expected_docs, expected_articles, cited_articles, retrieved_docs, is_hit) with label and hallucinated.

    skipped without anything expected, no-audit-match without retrieved documents, hit if an expected article is cited,
    R-miss if none was retrieved, else G-miss. hallucinated: not a hit, and an article is cited that was not retrieved.
    """
    want, got = expected_law_articles(F.col("expected_docs"), F.col("expected_articles")), law_articles(F.col("retrieved_docs"))
    cited = F.coalesce("cited_articles", F.array().cast("array<string>"))
    label = (
        F.when(F.size(want) == 0, "skipped").when(F.col("retrieved_docs").isNull(), "no-audit-match")
        .when(F.coalesce("is_hit", F.lit(False)) | F.arrays_overlap(articles_of(want), cited), "hit").when(matched(want, got), "G-miss").otherwise("R-miss")
    )
    loose = ~F.coalesce("is_hit", F.lit(False)) & (F.size(F.array_except(cited, articles_of(got))) > 0)
    return rows.withColumn("label", label).withColumn("hallucinated", F.col("label").isin("hit", "G-miss", "R-miss") & F.coalesce(loose, F.lit(False)))


def with_evidence(report: DataFrame, golden: DataFrame, audit: DataFrame) -> DataFrame:
    """report (id, query, category, ...) joined with golden's expected_docs by id and with the retrieved_docs of the
    latest audit query of the same trimmed text (user_query, log_file, position). Questions out of scope are left out."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    seen = audit.where("event_type = 'query'").withColumn("asked", trim(F.coalesce("user_query", F.lit("")))).where("asked <> ''")
    last = seen.groupBy("asked").agg(F.max_by(F.struct("retrieved_docs"), F.struct("log_file", "position")).alias("last"))
    rows = report.where("category is null or category <> 'out_of_scope'").withColumn("asked", trim(F.col("query")))
    rows = rows.join(golden.select("id", "expected_docs"), "id", "left").join(last, "asked", "left")
    return rows.withColumn("retrieved_docs", F.col("last.retrieved_docs")).drop("asked", "last")


def resolved_context(rows: DataFrame, index: DataFrame, most: int = 4000) -> DataFrame:
    """(id, context): the retrieved labels of rows (id, retrieved_docs) with the texts of their articles in the index
    (law, article, content), one after another, cut at `most` characters; a label without a text stays as it is."""
    each = rows.select("id", F.posexplode("retrieved_docs").alias("n", "label"))
    named = F.contains("label", F.lit("#"))
    law = F.when(named, F.regexp_replace(F.substring_index("label", "#", 1), r"\.md$", ""))
    article = F.when(named, F.regexp_replace(F.regexp_extract("label", r"(?s)^[^#]*#(.*)$", 1), r"(?U)\s+", ""))
    found = each.withColumn("law", law).withColumn("article", article).join(index.select("law", "article", "content"), ["law", "article"], "left")
    head = F.concat_ws(" ", "law", "article")
    part = (
        F.when(F.col("law").isNull(), F.concat(F.lit("- "), "label")).when(F.coalesce("content", F.lit("")) != "", F.concat(F.lit("【"), head, F.lit("】\n"), "content"))
        .otherwise(F.concat(F.lit("- "), head, F.lit("（條文未解析）")))
    )
    lists = found.withColumn("part", part).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("parts"))
    text = F.substring(F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n"), 1, most)
    return rows.select("id").join(lists.select("id", text.alias("context")), "id", "left").select("id", F.coalesce("context", F.lit("")).alias("context"))


def online_scores(answers: DataFrame, refusals: tuple[str, ...], k: int = 5) -> DataFrame:
    """answers (id, category, expected_articles, cited_articles, answer) with hit, precision, recall, f1 of the cited
    articles, null out of scope and where nothing is expected, and rejection_correct, null in scope."""
    outside = F.coalesce(F.col("category") == "out_of_scope", F.lit(False))
    scored = ~outside & (F.size("expected_articles") > 0)
    got, want = norm(F.col("cited_articles")), norm(F.col("expected_articles"))
    measures = {"hit": hit_rate(got, want), "precision": precision_at(got, want, k), "recall": recall_at(got, want, k), "f1": f1_at(got, want, k)}
    refused = F.greatest(F.lit(False), *[F.col("answer").contains(x) for x in refusals])
    return answers.select("*", outside.alias("outside"), F.when(outside, refused).alias("rejection_correct"), *[F.when(scored, m).alias(c) for c, m in measures.items()])


def online_summary(scored: DataFrame) -> DataFrame:
    """One row over online_scores: means over what was evaluated (0 without any), what was skipped, and the share of
    questions out of scope that were refused (null without any). Reciprocal rank and average precision are not meant here."""
    n, outside = F.count("hit"), F.count(F.when(F.col("outside"), 1))
    right = F.count(F.when(F.col("rejection_correct"), 1))
    return scored.agg(
        n.alias("evaluated"), (F.count("*") - n - outside).alias("skipped"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("hit", "precision", "recall", "f1")],
        outside.alias("outside_total"), right.alias("outside_refused"), F.try_divide(right, outside).alias("rejection_accuracy"),
    )


def answer_means(scored: DataFrame) -> DataFrame:
    """One row: count and the means of keyword_coverage, article_match, structure_ok and overall; null without answers."""
    means = [F.avg(F.col(c).cast("double")).alias(f"avg_{c}") for c in ("keyword_coverage", "article_match", "structure_ok", "overall")]
    return scored.agg(F.count("*").alias("count"), *means)


def unstable(observations: DataFrame) -> DataFrame:
    """(id, observations, unstable) of observed flips (id, unanimous; null where none was rerun): unstable with two of
    them, or with a rerun that was not unanimous."""
    n = F.count("*")
    split = F.coalesce(F.bool_or(~F.col("unanimous")), F.lit(False))
    return observations.groupBy("id").agg(n.alias("observations"), ((n >= 2) | split).alias("unstable"))


def query_status(record: DataFrame) -> DataFrame:
    """record (category, rejection_correct, hit) with status: pass, fail, or skipped in scope without a hit rate."""
    outside = F.coalesce(F.col("category") == "out_of_scope", F.lit(False))
    status = (
        F.when(outside, F.when(F.coalesce("rejection_correct", F.lit(False)), "pass").otherwise("fail"))
        .when(F.col("hit").isNull(), "skipped").when(F.col("hit") > 0, "pass").otherwise("fail")
    )
    return record.withColumn("status", status)


def verdict(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """metrics (evaluated, ...) with verdict: pass if every gated metric reaches its least value, inconclusive if nothing
    was evaluated."""
    good = F.lit(True)
    for name, value in least.items():
        good = good & (F.col(name) >= value)
    return metrics.withColumn("verdict", F.when(F.col("evaluated") == 0, "inconclusive").when(good, "pass").otherwise("fail"))


def snapshot_check(snapshot: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) of a snapshot (path, sha256) against files: missing or mismatched."""
    both = snapshot.select("path", F.col("sha256").alias("a")).join(files.select("path", F.col("sha256").alias("b")), "path", "left")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "mismatched")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def retrieved_article(article_id: Column, text: Column) -> Column:
    """第N條 of a retrieved row: its own article, or the first one that its text names; empty without any."""
    own = F.when(article_id.isNotNull() & ~article_id.isin("", "preamble", "whole_document"), article_id)
    number = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?U)第\s*([0-9一二三四五六七八九十百零兩]+)\s*條", 1)
    named = F.when(number != "", F.concat(F.lit("第"), number, F.lit("條"))).otherwise("")
    return F.when(own.startswith("第"), own).when(own.isNotNull(), F.concat(F.lit("第"), own, F.lit("條"))).otherwise(named)


def strict_flips(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, was, now) of the queries of both runs (id, hit) whose result turned; only a hit rate of 1 passes here."""
    a, b = (rows.select(F.col("id").cast("string").alias("id"), F.coalesce(F.col("hit") == 1.0, F.lit(False)).alias(c)) for rows, c in ((old, "was"), (new, "now")))
    return a.join(b, "id").where("was <> now")


def already_stored(files: DataFrame, stored: DataFrame) -> DataFrame:
    """The files (sha256) whose content is stored."""
    return files.join(stored.select("sha256").distinct(), "sha256", "left_semi")
