"""Queries whose inputs are composed from the given tables: articles, evaluation records, attribution and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import text as X
from ..operators import evaluate as E, records as C, retrieve as R, scoring as SC
from .queries import BM25, COSINE, VECTORS, audit, query, table, vectors


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def article(number: Column) -> Column:
    return F.concat(F.lit("第"), number.cast("string"), F.lit("條"))


def said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""SELECT doc_id, n, article_id, sha256(text) AS text_sha256 FROM (
        SELECT doc_id, 0 AS n, 'whole_document' AS article_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 4 = 0
        UNION ALL SELECT doc_id, 0, 'preamble', 'before ' || doc_id FROM documents WHERE doc_id % 4 > 1
        UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 > 1 THEN 1 ELSE 0 END, '第' || (doc_id % 90) || '條',
            '第 ' || (doc_id % 90) || ' 條 ' || chr(10) || 'one ' || coalesce(text, '') || ' end' FROM documents WHERE doc_id % 4 > 0
        UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 > 1 THEN 2 ELSE 1 END, '第十五條', '第十五條' || chr(10) || 'two 第3條 inside' FROM documents WHERE doc_id % 4 > 0)""")
def r1_articles(spark, sf_dir):
    d = F.col("doc_id")
    body = said("  第 ", d % 90, " 條 \n", "one ", F.col("text"), " end\n\n\n第十五條\ntwo 第3條 inside\n")
    text = F.when(d % 4 == 0, F.col("text")).when(d % 4 == 1, body).otherwise(F.concat(said("before ", d, "\n"), body))
    found = R.articles(documents(spark, sf_dir).withColumn("text", text))
    return found.select("doc_id", F.col("n").cast("int").alias("n"), "article_id", F.sha2("text", 256).alias("text_sha256"))


def chinese(n: Column) -> Column:
    """A number from 1 to 999 as it is written in Chinese."""
    digit = lambda x: F.element_at(F.array(*[F.lit(c) for c in X.ZH_DIGITS]), x.cast("int"))
    h, t, o = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
    hundreds = F.when(h > 0, F.concat(digit(F.greatest(h, F.lit(1))), F.lit("百"))).otherwise("")
    tens = F.when((t == 1) & (h == 0), "十").when(t > 0, F.concat(digit(F.greatest(t, F.lit(1))), F.lit("十"))).when((h > 0) & (o > 0), "零").otherwise("")
    return F.concat(hundreds, tens, F.when(o > 0, digit(F.greatest(o, F.lit(1)))).otherwise(""))


@query("""SELECT doc_id, CAST(n AS INT) AS number, '第' || n || '條' AS name, CASE WHEN n <= 20 THEN CAST(n AS VARCHAR) ELSE 'more' END AS small,
        '第' || n || '條,第' || (n + 1) || '條' AS cited, CAST(m AS INT) AS asked FROM (SELECT doc_id, doc_id % 999 + 1 AS n, doc_id % 99 + 1 AS m FROM documents)""")
def n1_n5_numerals(spark, sf_dir):
    n = F.col("doc_id") % 999 + 1
    zh, answer = chinese(n), said("依第", chinese(n), "條、第 ", n, " 條與第", n + 1, "條")
    return documents(spark, sf_dir).select(
        "doc_id", X.numeral(zh).alias("number"), X.article_name(said("第 ", zh, " 條")).alias("name"),
        F.when(n <= 20, X.small_numeral(zh)).otherwise("more").alias("small"), F.array_join(X.cited_articles(answer), ",").alias("cited"),
        F.get(X.question_articles(said("第", chinese(F.col("doc_id") % 99 + 1), "條")), F.lit(0)).alias("asked"),
    )


SCORED = """SELECT *, CASE WHEN outside THEN doc_id % 5 = 0 END AS rejection_correct, CASE WHEN NOT outside AND doc_id % 4 > 0 THEN hits / 2 END AS part FROM (
    SELECT doc_id, doc_id % 6 = 0 AS outside, CAST(doc_id % 5 + 1 IN (doc_id % 7 + 1, doc_id % 7 + 2) AS INT) + CAST(doc_id % 5 + 3 IN (doc_id % 7 + 1, doc_id % 7 + 2) AS INT) AS hits
    FROM documents)"""


def answers(spark, sf_dir):
    d = F.col("doc_id")
    answer = said("依第", d % 5 + 1, "條與第 ", d % 5 + 3, " 條", F.when(d % 5 == 0, "無法回答").otherwise(""))
    wanted = F.when(d % 4 > 0, F.array(article(d % 7 + 1), article(d % 7 + 2))).otherwise(F.array().cast("array<string>"))
    rows = documents(spark, sf_dir).select(
        d.alias("id"), F.when(d % 6 == 0, "out_of_scope").otherwise("law").alias("category"), wanted.alias("expected_articles"),
        X.cited_articles(answer).alias("cited_articles"), answer.alias("answer"),
    )
    return E.online_scores(rows, ("無法回答",))


@query(f"""SELECT count(part) AS evaluated, count(*) - count(part) - count(*) FILTER (outside) AS skipped, avg(CAST(part > 0 AS INT)) AS hit, avg(part) AS "precision",
    avg(part) AS recall, avg(part) AS f1, count(*) FILTER (outside) AS outside_total, count(*) FILTER (rejection_correct) AS outside_refused,
    count(*) FILTER (rejection_correct) / count(*) FILTER (outside) AS rejection_accuracy FROM ({SCORED})""")
def a14_online_summary(spark, sf_dir):
    return E.online_summary(answers(spark, sf_dir))


@query(f"""SELECT doc_id AS id, CASE WHEN outside THEN CASE WHEN rejection_correct THEN 'pass' ELSE 'fail' END WHEN part IS NULL THEN 'skipped' WHEN part > 0 THEN 'pass' ELSE 'fail' END AS status
    FROM ({SCORED})""")
def m16_query_status(spark, sf_dir):
    return E.query_status(answers(spark, sf_dir)).select("id", "status")


@query(f"""SELECT grp, evaluated, CASE WHEN evaluated = 0 THEN 'inconclusive' WHEN hit >= 0.3 AND "precision" >= 0.25 THEN 'pass' ELSE 'fail' END AS verdict
    FROM (SELECT doc_id % 12 AS grp, count(part) AS evaluated, avg(CAST(part > 0 AS INT)) AS hit, avg(part) AS "precision" FROM ({SCORED}) GROUP BY 1)""")
def m18_verdict(spark, sf_dir):
    rows = answers(spark, sf_dir).groupBy((F.col("id") % 12).alias("grp")).agg(F.count("hit").alias("evaluated"), F.avg("hit").alias("hit"), F.avg("precision").alias("precision"))
    return E.verdict(rows, {"hit": 0.3, "precision": 0.25}).select("grp", "evaluated", "verdict")


@query("""SELECT count(*) AS count, avg(kw) AS avg_keyword_coverage, avg(art) AS avg_article_match, avg(CAST(ok AS INT)) AS avg_structure_ok,
    avg(CASE WHEN refused THEN 1.0 ELSE 0.5 * kw + 0.3 * art + 0.2 * CAST(ok AS INT) END) AS avg_overall FROM (
        SELECT (CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'of') AS INT)) / 2 AS kw, CAST(contains(text, 'a') AS INT) AS art,
               contains(text, chr(10)) AS ok, turn % 7 = 0 AS refused FROM conversations WHERE text IS NOT NULL)""")
def a15_answer_means(spark, sf_dir):
    text = F.col("text")
    rows = table(spark, sf_dir, "conversations").where("text is not null").select(
        E.keyword_coverage(text, F.array(F.lit("The"), F.lit("of"))).alias("keyword_coverage"), text.contains("a").cast("double").alias("article_match"),
        text.contains("\n").alias("structure_ok"), (F.col("turn") % 7 == 0).alias("refused"),
    )
    overall = E.answer_score(F.col("keyword_coverage"), F.col("article_match"), F.col("structure_ok").cast("double"), F.col("refused"), F.lit(True))
    return E.answer_means(rows.withColumn("overall", overall))


@query("""SELECT session_id AS id, count(*) AS observations, count(*) >= 2 OR coalesce(bool_or(NOT unanimous), FALSE) AS unstable
    FROM (SELECT session_id, CASE WHEN k % 4 > 0 THEN k % 5 > 0 END AS unanimous FROM ev WHERE event_type = 'security_alert') GROUP BY 1""")
def a24_unstable(spark, sf_dir):
    k = F.col("k")
    rows = audit(spark, sf_dir).where("event_type = 'security_alert'").select(F.col("session_id").alias("id"), F.when(k % 4 > 0, k % 5 > 0).alias("unanimous"))
    return E.unstable(rows)


@query(""", seen AS (SELECT asked, arg_max(k, position) AS k FROM (SELECT *, 'q' || (k % 50) AS asked FROM ev WHERE event_type = 'query') GROUP BY 1),
    r AS (SELECT d.doc_id, d.doc_id % 5 + 1 AS want, d.doc_id % 4 + 1 AS cited, d.doc_id % 3 = 0 AS lawful, d.doc_id % 2 AS law, d.doc_id % 11 = 0 AS is_hit, s.k,
        d.doc_id % 3 > 0 AND d.doc_id % 13 = 0 AS nothing FROM documents d LEFT JOIN seen s ON s.asked = 'q' || (d.doc_id % 60) WHERE d.doc_id % 6 > 0 OR d.doc_id % 12 = 0),
    m AS (SELECT *, k % 6 + 1 AS one, k % 4 + 2 AS two FROM r)
    SELECT doc_id AS id, label, label IN ('hit', 'G-miss', 'R-miss') AND NOT is_hit AND cited NOT IN (one, two) AS hallucinated FROM (
        SELECT *, CASE WHEN nothing THEN 'skipped' WHEN k IS NULL THEN 'no-audit-match' WHEN is_hit OR want = cited THEN 'hit'
            WHEN CASE WHEN lawful THEN (want = one AND law = k % 2) OR (want = two AND law = 1) ELSE want IN (one, two) END THEN 'G-miss' ELSE 'R-miss' END AS label FROM m)""")
def j4_j5_attribution(spark, sf_dir):
    d, k = F.col("doc_id"), F.col("k")
    none = F.array().cast("array<string>")
    docs = documents(spark, sf_dir)
    report = docs.select(
        d.alias("id"), said("  q", d % 60, "\t").alias("query"), F.when((d % 6 == 0) & (d % 12 > 0), "out_of_scope").when(d % 12 > 0, "law").alias("category"),
        F.when(d % 13 > 0, F.array(said("第 ", d % 5 + 1, " 條"))).otherwise(none).alias("expected_articles"), F.array(article(d % 4 + 1)).alias("cited_articles"), (d % 11 == 0).alias("is_hit"),
    )
    golden = docs.where("doc_id % 3 = 0 or doc_id % 2 = 0").select(
        d.alias("id"), F.when(d % 3 == 0, F.array(said("law", d % 2, ".md#第", d % 5 + 1, "條"))).otherwise(none).alias("expected_docs")
    )
    seen = audit(spark, sf_dir).withColumns({
        "user_query": said("q", k % 50, " "),
        "retrieved_docs": F.array(said("law", k % 2, ".md#第 ", k % 6 + 1, " 條"), said("law1.md#第", k % 4 + 2, "條"), F.lit("no label")),
    })
    return E.attributed(E.with_evidence(report, golden, seen)).select("id", "label", "hallucinated")


@query("""SELECT d.doc_id AS id, sha256(substr('- plain ' || d.doc_id || chr(10) || chr(10) || CASE WHEN b.text <> '' THEN '【law' || (d.doc_id % 7) || ' 第' || (d.doc_id % 60) || '條】' || chr(10) || b.text
        ELSE '- law' || (d.doc_id % 7) || ' 第' || (d.doc_id % 60) || '條（條文未解析）' END, 1, 200)) AS context_sha256
    FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 60 AND b.item_id % 7 = d.doc_id % 7""")
def j6_contexts(spark, sf_dir):
    d, i = F.col("doc_id"), F.col("item_id")
    index = table(spark, sf_dir, "benchmark").select(said("law", i % 7).alias("law"), article(i).alias("article"), F.col("text").alias("content"))
    rows = documents(spark, sf_dir).select(d.alias("id"), F.array(said("plain ", d), said("law", d % 7, ".md#第 ", d % 60, " 條")).alias("retrieved_docs"))
    return E.resolved_context(rows, index, 200).select("id", F.sha2("context", 256).alias("context_sha256"))


@query("""SELECT a.path, CASE WHEN b.path IS NULL THEN 'missing' ELSE 'mismatched' END AS problem
    FROM (SELECT doc_id // 2 AS path, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0) a
    LEFT JOIN (SELECT doc_id // 2 AS path, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1 AND doc_id % 3 > 0) b ON a.path = b.path WHERE b.path IS NULL OR a.h <> b.h""")
def j13_snapshot_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("path"), F.sha2("text", 256).alias("sha256"))
    return E.snapshot_check(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and doc_id % 3 > 0"))


@query(f"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{X.LEGAL}', 'i') THEN 'legal' WHEN regexp_matches(text, '^(?:{X.SMALL_TALK})', 'i') THEN 'reject' ELSE 'legal' END AS scope,
    coalesce(regexp_matches(text, '{X.HARD_BLOCK}'), FALSE) AS blocked FROM conversations""")
def f11_f12_scope(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.scope(text).alias("scope"), F.coalesce(X.hard_blocked(text), F.lit(False)).alias("blocked"))


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, trim(substr(coalesce(text, ''), 1, 80)) ORDER BY doc_id % 2 DESC, doc_id) AS nth FROM documents) WHERE nth = 1""")
def u1_u8_merged(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("pos", F.col("doc_id"))
    return R.merged([rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0")], ["source"], 80).select("doc_id")


def questions(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("articles", F.when(F.col("query_id") % 2 == 0, F.array((F.col("query_id") % 9 + 1).cast("int"))).otherwise(F.array().cast("array<int>")))


def word_hits(spark, sf_dir, k):
    """BM25 hits of the items over the documents, with an article at the end of each text."""
    found = R.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), questions(spark, sf_dir), k)
    docs = documents(spark, sf_dir).select("doc_id", "source", said(F.col("text"), " 第 ", F.col("doc_id") % 9 + 1, " 條").alias("text"))
    return found.select("query_id", "doc_id", F.col("rank").alias("pos")).join(docs, "doc_id")


@query(f"""WITH {BM25} SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
    WHERE rank <= 30 AND query_id % 2 = 0 AND doc_id % 9 = query_id % 9""")
def f9_article_hits(spark, sf_dir):
    asked = questions(spark, sf_dir).select("query_id", "articles")
    return R.article_hits(word_hits(spark, sf_dir, 30), asked).select("query_id", "doc_id")


@query(f"""{VECTORS}, {BM25}, every AS (
        SELECT query_id // 50 AS query_id, 0 AS stage, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS pos FROM ({COSINE}) WHERE query_id // 50 IN (SELECT item_id FROM benchmark)
        UNION ALL SELECT query_id, 1, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) FROM s),
    placed AS (SELECT query_id, source, text, e.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY stage, pos) AS pos FROM every e
        JOIN (SELECT doc_id, source, coalesce(text, '') || ' 第 ' || (doc_id % 9 + 1) || ' 條' AS text FROM documents) d ON d.doc_id = e.doc_id WHERE pos <= 10),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, trim(substr(text, 1, 100)) ORDER BY pos) AS nth FROM placed) WHERE nth = 1)
    SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY turn, first) AS INT) AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY query_id, source) AS first FROM once)""")
def r8_hybrid(spark, sf_dir):
    rows, asked = vectors(spark, sf_dir)
    asked = asked.withColumn("query_id", F.floor(F.col("query_id") / 50)).join(questions(spark, sf_dir).select("query_id"), "query_id", "left_semi")
    docs = documents(spark, sf_dir).select("doc_id", "source", said(F.col("text"), " 第 ", F.col("doc_id") % 9 + 1, " 條").alias("text"))
    near = R.cosine_top_k(rows, asked, 10).select("query_id", F.col("vec_id").alias("doc_id"), F.col("rank").alias("pos")).join(docs, "doc_id")
    return R.hybrid(near, word_hits(spark, sf_dir, 10), ["query_id"]).select("query_id", "doc_id", "pos")


def requests(spark, sf_dir):
    """Requests with headers that differ by page: an id, a frontend's ids, a user agent, or none at all."""
    i = F.col("page_id")
    entry = lambda on, name, value: F.when(on, F.array(F.struct(F.lit(name).alias("k"), value.alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    headers = F.map_from_entries(F.concat(
        entry(i % 3 == 0, "x-request-id", said(" -r/", i, "- ")), entry(i % 4 == 1, "x-openwebui-chat-id", said("c", i)), entry(i % 4 == 2, "x-chat-id", said("d", i)),
        entry(i % 5 == 0, "user-agent", F.when(i % 10 == 0, "OpenWebUI/1").otherwise("curl/8")),
    ))
    return table(spark, sf_dir, "pages").select("page_id", headers.alias("headers"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'r-' || page_id ELSE 'made-' || page_id END AS request_id,
    CASE page_id % 4 WHEN 1 THEN 'c' || page_id WHEN 2 THEN 'd' || page_id ELSE '' END AS frontend_chat_id,
    CASE WHEN page_id % 4 = 1 OR page_id % 10 = 0 THEN 'openwebui' WHEN page_id % 3 = 0 OR page_id % 4 = 2 OR page_id % 5 = 0 THEN 'http_api' ELSE 'unknown' END AS source_app FROM pages""")
def z1_request_context(spark, sf_dir):
    return C.request_context(requests(spark, sf_dir), said("made ", F.col("page_id"))).select("page_id", "request_id", "frontend_chat_id", "source_app")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 4 > 0 THEN '10.0.0.' || (page_id % 200) WHEN page_id % 5 = 0 THEN 'unknown' WHEN page_id % 3 = 0 THEN '127.0.0.1' ELSE '192.0.2.' || (page_id % 200) END AS ip,
    CASE WHEN page_id % 7 = 0 THEN 200 ELSE 401 END AS status, CASE WHEN page_id % 7 = 0 THEN 'key one' END AS identity FROM pages""")
def f17_z15_identity(spark, sf_dir):
    """Peers that are trusted proxies or not, what they forward (or nothing, or no address), and keys that are valid or not."""
    i = F.col("page_id")
    peer = F.when(i % 3 == 0, F.when((i % 5 == 0) & (i % 4 == 0), F.lit(None)).otherwise("127.0.0.1")).when(i % 5 == 0, F.lit(None)).otherwise(said("192.0.2.", i % 200))
    forwarded = F.when(i % 4 == 0, F.when(i % 8 == 0, "not an address").otherwise("")).otherwise(said("203.0.113.9, 10.0.0.", i % 200, " "))
    trusted = F.when(i % 3 == 0, F.coalesce(peer, F.when(i % 4 > 0, "127.0.0.1"))).otherwise(peer)
    ip = C.client_ip(trusted, forwarded, ("127.0.0.1", "172.16.0.0/12"))
    who = C.identity(F.when(i % 7 == 0, "key one").when(i % 7 == 1, "key"), ip, ("key one", "key two"), False)
    rows = table(spark, sf_dir, "pages").select("page_id", ip.alias("ip"), who.alias("who"))
    return rows.select("page_id", "ip", "who.status", "who.identity")


@query("""SELECT conv_id, turn, 'security_alert' AS event_type, 'unknown' AS client_ip, substr(text, 1, 200) AS user_query, 'input' AS stage FROM conversations""")
def sk2_security_alerts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.to_json(F.struct("conv_id", "turn")).alias("session_id"), F.lit("").alias("client_ip"), F.col("text").alias("user_query"), F.lit("x").alias("threat_type"),
        F.lit("y").alias("reason"), F.col("turn").alias("message_index"), F.lit("user").alias("message_role"),
    )
    out = C.security_alerts(rows).withColumn("s", F.from_json("session_id", "conv_id bigint, turn bigint"))
    kinds = dict(table(spark, sf_dir, "conversations").dtypes)
    return out.select(*[F.col(f"s.{c}").cast(kinds[c]).alias(c) for c in ("conv_id", "turn")], "event_type", "client_ip", "user_query", "stage")


@query("""SELECT doc_id, concat_ws(' | ', 'session=' || substr('session-' || doc_id, 1, 8), CASE WHEN length(text) > 0 THEN 'query="' || substr(text, 1, 60) || CASE WHEN length(text) > 60 THEN '...' ELSE '' END || '"' END,
    CASE WHEN doc_id % 3 > 0 THEN 'docs=' || (doc_id % 3) END, CASE WHEN doc_id % 5 > 0 THEN 'time=' || (doc_id % 5) || 'ms' END) AS line FROM documents""")
def n12_summary_lines(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", said("session-", d).alias("session_id"), F.col("text").alias("user_query"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (d % 3).cast("int")).alias("retrieved_docs"),
        (d % 5).alias("response_time_ms"),
    )
    return rows.select("doc_id", C.summary_line(rows).alias("line"))


@query("""SELECT doc_id, len(pieces) AS pieces, array_to_string(pieces, '') = coalesce(text, '') AS whole,
    CASE WHEN doc_id % 7 = 0 THEN '—' WHEN doc_id >= 500 THEN CAST(2 * doc_id AS VARCHAR) || '' ELSE 'small' END AS shown, answer, 'src-' || (doc_id % 9) || '.md#第' || (doc_id % 5 + 1) || '條,b.md' AS sources
    FROM (SELECT doc_id, text, 'answer ' || doc_id AS answer, CASE WHEN length(text) > 0 THEN list_transform(range(CAST(ceil(length(text) / 8.0) AS BIGINT)), lambda i: substr(text, i * 8 + 1, 8)) ELSE [] END AS pieces FROM documents)""")
def n11_n13_x15_r18_text(spark, sf_dir):
    d = F.col("doc_id")
    pieces = X.chunks_of(F.coalesce("text", F.lit("")))
    number = F.when(d % 7 != 0, 2.0 * d)
    seen = said("來源: src-", d % 9, ".md (第", d % 5 + 1, "條)\n來源: b.md (preamble) 來源: b.md")
    answer = X.without_disclaimer(said("answer ", d, "\n\n---\n\n", X.DISCLAIMER, "。"))
    return documents(spark, sf_dir).select(
        "doc_id", F.size(pieces).cast("long").alias("pieces"), (F.array_join(pieces, "") == F.col("text")).alias("whole"),
        F.when(number.isNull() | (d >= 500), X.shown_number(number)).otherwise("small").alias("shown"), answer.alias("answer"), F.array_join(X.tool_sources(seen), ",").alias("sources"),
    )


@query("""SELECT name, expected, current, CASE WHEN name = 'documents' THEN current = expected ELSE current >= expected END AS ok FROM (
        SELECT 'documents' AS name, count(*) AS expected, count(*) FILTER (doc_id % 2 = 0) AS current FROM documents UNION ALL SELECT 'pages', count(*) - 1, count(*) FROM pages
        UNION ALL SELECT 'labels', count(*), 0 FROM labels)""")
def a28_moved(spark, sf_dir):
    now = {n: table(spark, sf_dir, n) for n in ("documents", "pages", "labels")}
    before = C.table_counts(now).withColumn("rows", F.col("rows") - (F.col("name") == "pages").cast("int"))
    after = C.table_counts({"documents": now["documents"].where("doc_id % 2 = 0"), "pages": now["pages"]})
    return C.moved(before, after, ("documents",))


@query("""SELECT n_name AS collection, count(c_custkey) AS chunks FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def j11_collection_counts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("collection"), "n_nationkey")
    chunks = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("collection")
    return C.collection_counts(nation, chunks)


@query("""SELECT item_id, 'law' || (item_id % 4) AS law, item_id % 2 = 0 AS cross_reference, CASE WHEN item_id % 3 > 0 THEN 'draft of ' || item_id || ' items' END AS draft FROM benchmark""")
def r11_r12_generated(spark, sf_dir):
    """Filters and drafts as a text generator would give them."""
    i = F.col("item_id")
    reply = said("Here:\n```json\n{\"law_names\": [\"law", i % 4, "\"], \"cross_reference\": ", F.when(i % 2 == 0, "true").otherwise("false"), "}\n```")
    text = F.when(i % 3 > 0, said("  Answer: draft of ", i, " items ")).otherwise("short")
    found = table(spark, sf_dir, "benchmark").select("item_id", X.query_filters(reply).alias("f"), X.draft(text).alias("draft"))
    return found.select("item_id", F.get("f.law_names", F.lit(0)).alias("law"), "f.cross_reference", "draft")


@query(f"""{VECTORS} SELECT query_id, vec_id, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({COSINE}) WHERE label = 3) WHERE rank <= 10""")
def f7_r13_one_source(spark, sf_dir):
    rows, asked = vectors(spark, sf_dir)
    return R.cosine_top_k(rows.where("label = 3"), asked, 10).select("query_id", "vec_id", "rank")


@query("""SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)""")
def f8_already_stored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return E.already_stored(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0")).select("doc_id")


@query("""SELECT CAST(a.id AS VARCHAR) AS id, a.h = 1 AS was, b.h = 1 AS now FROM (SELECT session_id AS id, max(k % 5) / 4 AS h FROM ev WHERE event_type = 'rejection' GROUP BY 1) a
    JOIN (SELECT session_id AS id, max(k % 5) / 4 AS h FROM ev WHERE event_type = 'security_alert' GROUP BY 1) b ON a.id = b.id WHERE (a.h = 1) <> (b.h = 1)""")
def j3_strict_flips(spark, sf_dir):
    rows = audit(spark, sf_dir)
    run = lambda kind: rows.where(F.col("event_type") == kind).groupBy(F.col("session_id").alias("id")).agg((F.max(F.col("k") % 5) / 4).alias("hit"))
    return E.strict_flips(run("rejection"), run("security_alert"))


@query("""SELECT coalesce(event_type, 'unknown') AS event_type, count(*) AS n FROM ev GROUP BY 1""")
def a8_by_type(spark, sf_dir):
    return SC.by_type(audit(spark, sf_dir))
