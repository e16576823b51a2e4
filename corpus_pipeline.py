"""The corpus pipeline: language ID, quality, near duplicates, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
as the next one's docs. All but the last return the columns of documents.

Defined results of every stage: rows are kept or dropped whole, other columns pass through unread whatever their names, an empty table gives an empty one, and rows
that are equal in id and text share a fate but for near_duplicates, which keeps one of them. A null id is an id of its own kind: null ids take part like others, and
rows with a null id are told apart by their texts. Null and empty texts: language_id drops them (no language), quality_filter drops them (no weight), near_duplicates keeps
them (they link with nothing), best_fit_packing packs the end id alone. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.llm import langid, ngram_join, packing, quality
from gleanstone.llm.queries import tokenizer_file
from gleanstone.llm.storage import held_id, written

#: A document whose language is less sure than this goes.
LEAST_SCORE = 0.4
BROADCAST_IDS = 1_000_000


def _filtered(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that decide keeps; it sees the columns but text under other names, so that those it adds clash with none."""
    held = docs.toDF(*["text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)])
    return decide(held).select(held.columns).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the model knows, with a calibrated probability of LEAST_SCORE or more."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    sure = (F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)
    return _filtered(docs, lambda rows: langid.identify(rows, model).filter(sure))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance weight does not mark as bad."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _filtered(docs, lambda rows: quality.weigh(rows, model).filter(F.col("weight") >= model.threshold))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one document: that with the smallest id, null ids last, and the smallest hash of its text in a tie.

    Rows are told apart by id and hash of the text, so rows with equal ids and different texts are different documents.
    """
    found = ngram_join.near_duplicates(docs.select("doc_id", "text"), k=5, num=80, den=100).filter("component_key is not null")
    each = found.groupBy("component_key", held_id("doc_id").alias("i"), F.col("text_hash").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    each = written(each, "pipeline-near")
    first = each.groupBy("component_key").agg(F.min(F.struct("i", "h")).alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    gone = written(each.join(first, "component_key").filter(F.struct("i", "h") != F.col("first")).select("i", "h"), "pipeline-gone")
    again = written(each.filter("n > 1").select("i", "h"), "pipeline-again")
    few = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids  # noqa: E731  16 MB; beyond that the join shuffles

    def decide(rows: DataFrame) -> DataFrame:
        id_ = rows.columns[docs.columns.index("doc_id")]
        keyed = rows.withColumns({"i": held_id(id_), "h": F.xxhash64(F.col("text").cast("string"))}).join(few(gone), ["i", "h"], "left_anti")
        if again.isEmpty():
            return keyed
        repeated = keyed.join(few(again), ["i", "h"], "left_semi").dropDuplicates(["i", "h"])
        return keyed.join(few(again), ["i", "h"], "left_anti").unionByName(repeated)

    return _filtered(docs, decide)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: Models and packings are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
