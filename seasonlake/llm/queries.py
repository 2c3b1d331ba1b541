"""Registered queries of the training-data operators and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seasonlake.llm import alignment, bpe, filter_audit, html_text, line_dedup, max_score, packing, parity_join, pii, quality, rotated_codes, token_counts, url_filter
from seasonlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(
        table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")
    )


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")
    )


RULES = [
    url_filter.Rule("block", "net"), url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"),
]

URL_SQL = """
WITH parts AS (
    SELECT page_id,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), split AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts
), judged AS (
    SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
    FROM split
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query("op4_url_filter", URL_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


NEAREST_SQL = """
WITH v AS (
    SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY vec_id
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


@query("op5_nearest", NEAREST_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.search_embeddings(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


PRODUCT_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(min(embedding::DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    GROUP BY vec_id
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


@query("op8_max_score", PRODUCT_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_score.search_products(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query("op7_parity_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"),
    )
    return scored.select("row.doc_id", "expected_grade", "tail", "keep")


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


AUDIT_SQL = """
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
    FROM documents
), known AS (
    SELECT doc_id AS id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failed AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * len(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
    FROM texts LEFT JOIN known ON doc_id = id
), cells AS (
    SELECT part, fails, good, toxic, count(*) AS n FROM failed GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), walked AS (
    SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, good, toxic, n,
        strpos(fails, substr(filter_order, step, 1)) > 0 AS failing,
        fails = substr(filter_order, step, 1) AS only_this,
        len(translate(substr(filter_order, 1, step - 1), fails, '')) < step - 1 AS gone
    FROM cells, orders, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)
), counted AS (
    SELECT part, filter_order, step, f,
        sum(n * (NOT gone AND NOT failing)::INT)::BIGINT AS kept,
        sum(n * (NOT gone AND failing)::INT)::BIGINT AS removed,
        sum(n * (gone AND failing)::INT)::BIGINT AS redundant,
        sum(n * only_this::INT)::BIGINT AS unique_fails,
        sum(n * (NOT gone AND failing AND good = 1)::INT)::BIGINT AS good_lost,
        sum(n * (NOT gone AND failing AND toxic = 1)::INT)::BIGINT AS toxic_lost
    FROM walked GROUP BY ALL
)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted
"""


@query("op11_filter_audit", AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(
        table(spark, sf_dir, "documents", "doc_id", "text", "source"),
        table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"),
    )


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
    )


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")
    )
