"""Job: answer many questions from a corpus at once, and say how far each answer can be trusted.

    python -m jobs.answer_report --documents FOLDER --questions FOLDER --out FOLDER [--config FILE]

The documents (doc_id, text, lang, source) are indexed in blocks below out/index. Each question (item_id, text) is asked twice, with its first and its last words; both ranked lists are fused by reciprocal ranks, a hit of
both lists gets its bonus, and the best `limit` hits of a question stay. A row of out/answers is a hit with its place, score, source and snippet, and says of its question how confident the hit list is and which share of
the question's words the best hit covers. A question without hits has one row without a chunk. The table is partitioned by the language of the hits.

A rerun writes the same rows over the old ones. Questions with equal ids are one question (of their texts the greatest); those without an id or words, and documents without id or text, are left out and counted.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanstone.functions.scoring import confidence
from gleanstone.functions.text import snippet, words
from gleanstone.operators.fusion import adjust, fuse
from gleanstone.operators.text_index import block_search, load_blocks, save_blocks
from gleanstone.schema import struct
from gleanstone.session import scratch

from .common import command_line

NAME = "answer_report"
#: So many hits at most are sent to all executors; more are joined by a shuffle.
LISTED = 200_000
log = logging.getLogger(f"jobs.{NAME}")
ANSWERS = struct("item_id long, rank int, chunk_id string, score double, repo string, path string, snippet string, n_hits long, confidence double, coverage double, language string")


def chunks_of(documents: DataFrame) -> DataFrame:
    rows = documents.filter("doc_id is not null and text is not null")
    return rows.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("text").alias("content"), F.coalesce("lang", F.lit("none")).alias("language"),
        F.col("source").alias("repo"), F.concat_ws("/", F.lit(""), "source", "lang").alias("path"), F.lit(None).cast("timestamp").alias("indexed_at"),
    )


def kept(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Rows as a table, so that what follows does not search or read texts again."""
    path = scratch(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def run(spark: SparkSession, documents: str, questions: str, out: str, config: dict) -> DataFrame:
    """Write the answers, and return them as read back."""
    docs, asked = spark.read.parquet(documents), spark.read.parquet(questions)
    chunks = chunks_of(docs)
    save_blocks(chunks, f"{out}/index", stems=False)
    index = load_blocks(spark, f"{out}/index", stems=False)
    cases = kept(spark, asked.filter("item_id is not null").groupBy(F.col("item_id").cast("long").alias("query_id")).agg(words(F.max("text")).alias("w")).filter("size(w) > 0"), "questions")
    n = config["words"]
    first, last = F.slice("w", 1, n), F.slice("w", F.greatest(F.size("w") - n + 1, F.lit(1)), n)
    lists = F.explode(F.array(*[F.struct(F.lit(k).alias("list"), F.array_join(part, " ").alias("query")) for k, part in enumerate((first, last))]))
    queries = cases.select("query_id", lists.alias("_l")).select(F.concat_ws("/", F.col("query_id").cast("string"), "_l.list").alias("query_id"), "_l.query")
    named = F.split("query_id", "/")
    hits = block_search(index, queries, config["limit"]).select(named[0].cast("long").alias("query_id"), "chunk_id", "rank", named[1].cast("int").alias("list"))
    fused = adjust(fuse(hits).withColumns({"content": F.lit(""), "indexed_at": F.lit(None).cast("timestamp")}), F.lit(""), F.current_timestamp()).drop("content", "indexed_at")  # no symbols are asked for, so texts do not count
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "src_order")
    best = kept(spark, fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config["limit"]), "hits")
    summary = best.groupBy("query_id").agg(F.max("score").alias("top"), F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n_hits"))
    summary = summary.select("query_id", "n_hits", confidence(F.col("top"), F.col("mean"), F.col("n_hits")).alias("confidence"))
    asked_of = best.filter("rank = 1").join(cases, "query_id").select("chunk_id", "query_id", "rank", F.array_distinct("w").alias("w"))
    wanted = best.join(asked_of, ["query_id", "chunk_id", "rank"], "left")
    wanted = F.broadcast(wanted) if wanted.count() <= LISTED else wanted
    texts = kept(spark, wanted.join(chunks, "chunk_id").select(  # texts are read once, and only what is shown of them is kept
        "query_id", "chunk_id", "rank", "score", "repo", "path", "language", snippet(F.col("content"), config["snippet"]).alias("snippet"),
        (F.size(F.filter("w", lambda x: F.lower("content").contains(x))) / F.size("w")).alias("coverage"),
    ), "texts")
    covered = texts.filter("rank = 1").select("query_id", "coverage")
    rows = cases.select("query_id").join(summary, "query_id", "left").join(covered, "query_id", "left").join(texts.drop("coverage"), "query_id", "left")
    rows = rows.select(
        F.col("query_id").alias("item_id"), F.col("rank").cast("int").alias("rank"), "chunk_id", "score", "repo", "path", "snippet", F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("language", F.lit("none")).alias("language"),
    )
    rows.repartition("language", F.pmod(F.xxhash64("item_id"), F.lit(16))).sortWithinPartitions("item_id", "rank").write.mode("overwrite").partitionBy("language").parquet(f"{out}/answers")
    answers = spark.read.schema(ANSWERS).parquet(f"{out}/answers")
    log.info("read %d documents from %s (%d indexed) and %d questions from %s (%d asked)", docs.count(), documents, chunks.count(), asked.count(), questions, cases.count())
    for r in answers.groupBy("language").agg(F.count("chunk_id").alias("hits"), F.countDistinct("item_id").alias("questions")).orderBy("language").collect():  # a row for each language
        log.info("wrote language %s: %d hits of %d questions to %s", r["language"], r["hits"], r["questions"], f"{out}/answers")
    return answers


if __name__ == "__main__":
    command_line(NAME, {"documents": "Parquet table of documents", "questions": "Parquet table of questions", "out": "folder of index and answers"}, run)
