"""The jobs as queries over the standard tables, with SQL: each runs twice into one new folder, and what stands there then is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.session import scratch

from . import answer_report, index_feed
from .common import config_of


def job1_index_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "job1_index_feed")
    for _ in range(2):
        segments = index_feed.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint", config_of("index_feed") | {"stems": False})
    return index_feed.index_rows(segments)


def job2_answer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "job2_answer_report")
    for _ in range(2):
        answers = answer_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder, config_of("answer_report"))
    return answers.withColumns({c: F.round(c, 9) for c in ("score", "confidence", "coverage")})


QUERIES = {"job1_index_feed": job1_index_feed, "job2_answer_report": job2_answer_report}

_WORDS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
_RANKED = """(1.0::DOUBLE / (60 + r) / (2.0::DOUBLE / 61))"""

ORACLES = {
    "job1_index_feed": rf"""WITH t AS (SELECT 'd' || doc_id AS chunk_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM t) GROUP BY ALL)
    SELECT 'posting' AS kind, term, chunk_id, tf AS n, NULL::BIGINT AS total FROM p UNION ALL SELECT 'term', term, NULL, count(*), NULL FROM p GROUP BY term
    UNION ALL SELECT 'chunk', NULL, chunk_id, len(w), NULL FROM t UNION ALL SELECT 'corpus', NULL, NULL, count(*), sum(len(w))::BIGINT FROM t""",
    "job2_answer_report": rf"""WITH c AS (SELECT 'd' || doc_id AS chunk_id, text AS content, coalesce(lang, 'none') AS language, source AS repo, '/' || source || '/' || lang AS path, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM c), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    q AS (SELECT item_id, 0 AS l, unnest(w[1:5]) AS term FROM i UNION ALL SELECT item_id, 1, unnest(w[greatest(len(w) - 4, 1):]) FROM i),
    p AS (SELECT chunk_id, term, len(w) AS dl, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS term FROM c) WHERE term IN (SELECT term FROM q) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    b AS (SELECT item_id, l, chunk_id, count(*) AS m, sum((CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
      FROM p JOIN q USING (term) JOIN d USING (term), s GROUP BY ALL),
    k AS (SELECT item_id, l, chunk_id, row_number() OVER (PARTITION BY item_id, l ORDER BY round(b.score, 9) DESC, chunk_id) AS r FROM b JOIN (SELECT item_id, l, count(*) AS m FROM q GROUP BY ALL) USING (item_id, l, m) QUALIFY r <= 10),
    f AS (SELECT item_id, chunk_id, least(1, sum({_RANKED}) + CASE WHEN count(*) > 1 THEN 0.1::DOUBLE ELSE 0 END) AS score, min(l * 1000000 + r) AS src_order FROM k GROUP BY ALL),
    g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, src_order) AS rank FROM f QUALIFY rank <= 10),
    u AS (SELECT item_id, max(score) AS top, avg(score) AS mean, count(*) AS n_hits FROM g GROUP BY item_id),
    v AS (SELECT g.item_id, len(list_filter(list_distinct(i.w), lambda x: contains(lower(content), x))) / len(list_distinct(i.w)) AS coverage FROM g JOIN i USING (item_id) JOIN c USING (chunk_id) WHERE rank = 1)
    SELECT i.item_id, rank::INT AS rank, chunk_id, round(score, 9) AS score, repo, path, substr(content, 1, 200) AS snippet, coalesce(n_hits, 0) AS n_hits,
      round(coalesce(CASE WHEN top IS NULL THEN 0 WHEN top >= 0.5 AND n_hits >= 3 THEN least(0.95, 0.6 + mean * 0.3 + least(n_hits / 15, 0.15)) WHEN top >= 0.1 THEN least(0.7, 0.3 + mean * 0.3 + least(n_hits / 20, 0.1)) ELSE greatest(0.05, 0.1 + mean * 0.2) END, 0), 9) AS confidence,
      round(coalesce(coverage, 0), 9) AS coverage, coalesce(language, 'none') AS language
    FROM i LEFT JOIN g USING (item_id) LEFT JOIN c USING (chunk_id) LEFT JOIN u USING (item_id) LEFT JOIN v USING (item_id) WHERE len(i.w) > 0""",
}
