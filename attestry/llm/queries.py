"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontamination import contaminated
from .exact_dedup import exact_dedup
from .lm import lm_scores
from .mixing import mix_documents
from .near_dup import near_duplicates
from .phrases import collocations
from .quality import quality_scores
from .repeats import repeated_passages
from .secrets import scan_secrets
from .token_files import token_digests
from .toxicity import toxicity_scores
from .warc import archived_pages
from .whitening import whitened


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=90).drop("text_hash")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_suffix_dedup, op3_source_mixing, op4_ngram_jaccard, op5_decontamination, op6_toxicity, op7_warc,
        op8_exact_dedup, op9_secret_scan, op10_lm_scoring, op11_collocations,
        op12_token_ids, op13_whitening,
    )
}

ORACLES = {
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS h FROM p),
        g AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS f FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
               CASE WHEN f IS NOT NULL AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> f THEN f END AS refers_to
        FROM g
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_collocations": r"""
        WITH p AS (
            SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM (
                SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        ),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
        f AS (
            SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a
            FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3), (4), (5)) v(m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 100
        ),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
        cut AS (
            SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest
            FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
        ),
        s AS (
            SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, n, CAST(1000::HUGEINT * cut.a * n // (x.a::HUGEINT * y.a) AS BIGINT) AS score
            FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first_part JOIN f y ON y.lang = cut.lang AND y.phrase = rest JOIN total ON total.lang = cut.lang
            QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, k) = 1
        ),
        maximal AS (
            SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = s.lang AND c.a >= s.a AND len(c.phrase) > len(s.phrase) AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM maximal QUALIFY rank <= 2000
    """,
}
