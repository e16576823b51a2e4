"""One query for each operator, and the pipeline, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def tokenizer_file(name: str) -> str:
    """Where this machine keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id", "n_links")


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import document_token_counts

    return document_token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_documents

    return media_documents(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    return shard_rows(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bytebpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import middle_digests

    return middle_digests(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_quality_resampling": op3_quality_resampling,
        "op4_token_counts": op4_token_counts,
        "op5_imatch": op5_imatch,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_media": op7_media,
        "op8_sharding": op8_sharding,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_html_text": op10_html_text,
        "op11_fill_middle": op11_fill_middle,
        "op12_decontamination": op12_decontamination,
    }


#: Links between different sets by a self-join on whole shingles, components by recursion: slow, and plain.
NGRAM_JOIN_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS rep, g FROM s),
x AS (SELECT rep, unnest(g) AS g FROM n WHERE doc_id = rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i FROM x a JOIN x b USING (g) WHERE a.rep <> b.rep GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS c FROM n WHERE doc_id = rep UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.c),
c AS (SELECT a, min(c) AS c FROM r GROUP BY a), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, c.c AS component_id, coalesce(k.n_links, 0) AS n_links FROM n JOIN c ON c.a = n.rep LEFT JOIN k ON k.a = n.rep"""


def oracle_sql() -> dict[str, str]:
    from .decontaminate import contamination_sql
    from .fill_middle import middle_sql
    from .sharding import sharding_sql

    return {"op2_ngram_jaccard_join": NGRAM_JOIN_SQL, "op8_sharding": sharding_sql(), "op11_fill_middle": middle_sql(), "op12_decontamination": contamination_sql()}
