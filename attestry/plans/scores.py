"""Queries over answers and their judges, routes, and the small rules of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from .queries import audit, query, table

REFUSALS = ("outside the scope", "only answers questions of law")
GAPS = ("尚未收錄", "nothing on record")


def pick(i, *values):
    """The value that a number picks from a list, as text."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for n, v in enumerate(values):
        out = out.when(i % len(values) == n, F.lit(v).cast("string"))
    return out


@query("""SELECT i, class, status, CASE WHEN status = 'ok' THEN CASE i % 9 WHEN 0 THEN 0.75 ELSE 0.3333 END END AS score,
    CASE WHEN class = 'answer' THEN CASE i % 7 WHEN 0 THEN 0.9 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 5 THEN 0.1235 END END AS relevancy,
    CASE WHEN class = 'answer' AND i % 5 <> 1 AND i % 3 > 0 THEN CASE i % 7 WHEN 0 THEN 0.9 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 5 THEN 0.1235 END END AS "precision"
    FROM (SELECT i, class, CASE WHEN class = 'empty' THEN 'unavailable' WHEN class <> 'answer' THEN class WHEN i % 5 = 1 THEN 'no_context'
            ELSE CASE i % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'abstention' WHEN 3 THEN 'abstention' WHEN 7 THEN 'abstention' ELSE 'unavailable' END END AS status
        FROM (SELECT event_id AS i, CASE event_id % 11 WHEN 0 THEN 'rejection_oos' WHEN 1 THEN 'no_coverage' WHEN 2 THEN 'empty' WHEN 3 THEN 'empty' ELSE 'answer' END AS class FROM events))""")
def z18_scored_answers(spark, sf_dir):
    """Answers of each class, with judges that reply well, badly or not at all."""
    i = F.col("event_id")
    faith = pick(
        i, '```json\n{"grounded_claims": 3, "ungrounded_claims": 1, "score": 0.1}\n```', 'So: {"grounded_claims": 1, "ungrounded_claims": 2}', '{"grounded_claims": 0, "ungrounded_claims": 0}',
        '{"grounded_claims": 2, "ungrounded_claims": 2, "is_abstention": true}', '{"grounded_claims": true, "ungrounded_claims": 1}', '{"grounded_claims": 2.0, "ungrounded_claims": -1}', "no object",
        '{"is_abstention": "yes"}', None,
    )
    plain = pick(i, 'x {"score": 0.9} y', '{"score": 7}', '{"score": -2}', '{"score": "0.5"}', '{"score": true}', '{"score": 0.12345678}', "none")
    answer = pick(
        i, "This is outside the scope.", "There is nothing on record.", "  \n", None, *["An answer of some length, with what the statute says."] * 7
    )
    rows = table(spark, sf_dir, "events").select(
        i.alias("i"), answer.alias("answer"), F.when(i % 5 == 1, F.when(i % 2 == 0, " \t").otherwise(F.lit(None))).otherwise("context").alias("context"),
        F.when(i % 3 > 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("retrieved"), faith.alias("faithfulness_reply"),
        plain.alias("relevancy_reply"), plain.alias("precision_reply"),
    )
    out = S.scored_answers(rows, REFUSALS, GAPS)
    return out.select("i", "class", "faithfulness.status", "faithfulness.score", "relevancy", "precision")


@query("""SELECT event_id AS i, CASE event_id % 6 WHEN 0 THEN 'reject' WHEN 1 THEN 'passthrough' ELSE 'legal' END AS scope,
    CASE event_id % 6 WHEN 0 THEN 'reject' WHEN 1 THEN 'passthrough' ELSE 'retrieve' END AS next,
    event_id % 7 = 3 AS needs_retry,
    CASE event_id % 7 WHEN 0 THEN 'non_substantive' WHEN 1 THEN 'honest_no_info' WHEN 2 THEN 'no_json' WHEN 3 THEN 'cites nothing' WHEN 4 THEN '' WHEN 5 THEN 'verify_error' ELSE repeat('r', 100) END AS reason,
    CASE WHEN event_id % 7 = 3 THEN 'generate' ELSE 'end' END AS after FROM events""")
def z4_z9_checks(spark, sf_dir):
    """Routes before and after an answer, from replies of a classifier and a verifier."""
    i = F.col("event_id")
    scope = S.classified(pick(i, 'Sure: {"scope": " Reject "}', '```{"scope": "passthrough", "n": 1}```', '{"scope": "other"}', "legal", '{"scope": ', None))
    long = "An answer that is long enough to be looked at by a verifier, 第3條."
    answer = pick(i, "short", long + "未檢索到", *[long] * 5)
    reply = pick(i, '{"needs_retry": true}', '{"needs_retry": true}', "all is well", '{"needs_retry": 1, "reason": "cites nothing"}', '{"needs_retry": 0}', '{"needs_retry": tru}', '{"needs_retry": null, "reason": "' + "r" * 120 + '"}')
    check = S.post_check(answer, reply, "out of scope")
    rows = table(spark, sf_dir, "events").select(i.alias("i"), scope.alias("scope"), S.route(scope).alias("next"), check.alias("c"))
    return rows.select("i", "scope", "next", "c.needs_retry", "c.reason", S.route_after(F.when(F.col("c.needs_retry"), "needs_retry").otherwise("verified")).alias("after"))


@query("""SELECT event_id AS i, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '7' WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE '12' END ELSE '5,7' END AS extra FROM events""")
def z7_z8_evidence(spark, sf_dir):
    """Articles that an answer names, against those of source ids and of texts."""
    i = F.col("event_id")
    answer = pick(i, "第5條 and 第十二條", "第5條、第7條", "第12條", "第5條 第七條")
    sources = F.when(i % 4 < 2, F.array(F.lit("law.md#第5條"), F.lit("law.md"))).otherwise(F.lit(None).cast("array<string>"))
    texts = F.when(i % 4 == 0, F.array(F.lit("text of 第 12 條"))).when((i % 4 == 2) & (i % 3 == 0), F.array(F.lit("第十二條"))).otherwise(F.array().cast("array<string>"))
    extra = F.array_join(F.array_sort(S.ungrounded_citations(answer, sources, texts)), ",")
    return table(spark, sf_dir, "events").select(i.alias("i"), extra.alias("extra"))


@query("""SELECT session_id AS series, strftime(max(ts), '%Y-%m') AS month, count(*) FILTER (CASE WHEN k % 3 = 0 THEN k % 2 = 0 ELSE k % 5 = 0 END) AS up,
    CAST(sum(CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END) AS BIGINT) AS ranks, count(*) FILTER (k % 7 > 1 AND k % 2 = 0) AS passed,
    count(*) FILTER (k % 7 > 1 AND k % 3 = 0) AS hits, count(*) FILTER (k % 7 < 2) AS empty FROM ev GROUP BY 1""")
def z21_z26_rules(spark, sf_dir):
    """Ranks of severities, critical dependencies, months of last records, reruns and answers that were empty."""
    k = F.col("k")
    deps = F.when(k % 3 == 0, F.create_map(F.lit("db"), k % 2 == 0, F.lit("cache"), F.lit(False))).otherwise(F.create_map(F.lit("web"), k % 5 == 0, F.lit("disk"), F.lit(True)))
    answer = F.when(k % 7 == 0, "").when(k % 7 > 1, "text")
    rows = audit(spark, sf_dir).select(
        F.col("session_id").alias("series"), "position", "timestamp", S.critical_ok(deps, F.array(F.lit("db"), F.lit("llm"))).alias("up"),
        S.severity_rank(pick(k, "info", "warning", "critical", "other")).alias("rank"), S.rerun_passed(answer, k % 2 == 0).alias("passed"),
        S.ab_hit(answer, F.array((k % 3).cast("string")), F.array(F.lit("0"), F.lit("9"))).alias("hit"),
    )
    counts = rows.groupBy("series").agg(
        F.count(F.when(F.col("up"), 1)).alias("up"), F.sum("rank").cast("long").alias("ranks"), F.count(F.when(F.col("passed"), 1)).alias("passed"),
        F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(F.col("hit").isNull(), 1)).alias("empty"),
    )
    return S.last_month(rows).join(counts, "series")


@query("""SELECT doc_id AS source, doc_id % 5 > 0 AS converted, doc_id % 5 > 0 AND doc_id % 3 > 0 AS indexed,
    CASE WHEN doc_id % 5 = 0 THEN 'Conversion failed: broken' WHEN doc_id % 3 > 0 THEN 'Successfully converted and indexed: ' || doc_id ELSE 'Indexing failed: ' || doc_id END AS message,
    CASE WHEN n < 1024 THEN printf('%.2f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0)
         WHEN n < 1099511627776 THEN printf('%.2f GB', n / 1073741824.0) ELSE printf('%.2f TB', n / 1099511627776.0) END AS size
    FROM (SELECT *, doc_id * doc_id AS n FROM documents)""")
def z16_z30_conversions(spark, sf_dir):
    """What became of each file, and its size as reports show it."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    converted = docs.select(d.cast("string").alias("source"), F.when(d % 5 == 0, "broken").alias("problem"), d)
    found = S.conversion_records(converted, docs.where("doc_id % 3 > 0").select(d.cast("string").alias("source")))
    sizes = docs.select(d.cast("string").alias("own"), S.shown_size(d * d).alias("size"))
    return found.join(sizes, found["source"] == sizes["own"]).select(F.col("source").cast("long").alias("source"), "converted", "indexed", "message", "size")


@query("""SELECT session_id AS case_id, round(avg(CASE WHEN k % 4 < 2 THEN 1.0 ELSE 0.0 END), 4) AS valid_rate FROM ev GROUP BY 1""")
def a27_valid_replies(spark, sf_dir):
    """The share of a judge's replies that hold JSON."""
    rows = audit(spark, sf_dir)
    return S.valid_replies(rows.select(F.col("session_id").alias("case_id"), pick(F.col("k"), '{"score": 1}', 'Well: {"score": 0.5}.', "{not json}", "none").alias("reply")))
