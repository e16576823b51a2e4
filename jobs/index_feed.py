"""Job: keep a full-text index in step with a folder of documents that grows.

    python -m jobs.index_feed --documents FOLDER --out FOLDER --checkpoint FOLDER [--config FILE]

New Parquet files of the folder are read as a stream that ends when nothing is left (availableNow); its checkpoint knows what was read. Each batch becomes one segment of the index below `out`: postings, lengths,
and by how much it changed document frequencies and corpus statistics, partitioned by segment. A document that comes again replaces its older text; one that comes with a null text is taken out of the index.
Of rows with one id in a batch, the greatest version counts (if a column is named for it), then the greatest text, and any text before none. Rows without an id cannot be addressed: they are counted and left out.

A batch that is repeated after a failure writes the same segment over what it had begun, so a rerun gives the same index, and a run without new files changes nothing.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.operators.text_index import TextSegments

from .common import command_line

NAME = "index_feed"
#: Ids that are met twice in a batch are broadcast up to this number.
BROADCAST_IDS = 1_000_000
log = logging.getLogger(f"jobs.{NAME}")


def chunk_id(doc_id):
    return F.concat(F.lit("d"), doc_id.cast("string"))


def latest_texts(rows: DataFrame, config: dict) -> DataFrame:
    """chunk_id, content: one row for each id."""
    version = F.col(config["version"]) if config["version"] else F.lit(0)
    one = rows.filter(F.col(config["id"]).isNotNull()).groupBy(chunk_id(F.col(config["id"])).alias("chunk_id"))
    return one.agg(F.max(F.struct(version.alias("v"), F.col(config["text"]).alias("content"))).alias("_last")).select("chunk_id", "_last.content")


def batch_texts(rows: DataFrame, config: dict, n_twice: int) -> DataFrame:
    """What latest_texts() gives. n_twice: how many ids are met more than once; only texts of these are sorted to be compared."""
    named = rows.filter(F.col(config["id"]).isNotNull()).withColumn("_chunk", chunk_id(F.col(config["id"])))
    if n_twice:
        twice = named.groupBy("_chunk").count().filter("count > 1").select("_chunk")
        twice = F.broadcast(twice) if n_twice <= BROADCAST_IDS else twice
        several = latest_texts(named.join(twice, "_chunk", "left_semi"), config)
        named = named.join(twice, "_chunk", "left_anti")
    texts = named.select(F.col("_chunk").alias("chunk_id"), F.col(config["text"]).alias("content"))
    return texts.unionByName(several) if n_twice else texts


def any_table(path: str) -> str:
    """path as a pattern that matches only itself: a stream reads a plain path as a folder, a pattern's match may also be one file."""
    return path if any(c in path for c in "*?[{") else f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict) -> TextSegments:
    """Index what is new, and return the index."""
    segments = TextSegments(spark, out, config["stems"])
    before = segments.numbers()
    schema = spark.read.parquet(documents).schema
    columns = [c for c in (config["id"], config["text"], config["version"]) if c]

    def index(batch: DataFrame, number: int) -> None:
        ids = batch.groupBy(chunk_id(F.col(config["id"])).alias("id")).agg(F.count(F.lit(1)).alias("k"))
        named = F.col("id").isNotNull()
        found = ids.agg(*[F.coalesce(c, F.lit(0)).alias(name) for name, c in {"n": F.sum("k"), "unnamed": F.sum(F.when(~named, F.col("k"))), "twice": F.count_if(named & (F.col("k") > 1))}.items()]).first()
        rows = batch_texts(batch, config, found["twice"])
        segments.put(rows.filter("content is not null"), rows.filter("content is null"), number)
        log.info("batch %d: read %d rows of %s, of which %d without an id were left out", number, found["n"], documents, found["unnamed"])

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(any_table(documents)).select(*columns)
    query = stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    new = segments.table("corpus").filter(~F.col("segment").isin(before)).orderBy("segment").collect()  # a row for each batch
    for r in new:
        log.info("segment %d: %+d chunks, %+d words", r["segment"], r["docs"], r["total"])
    log.info("wrote %d segments to %s, which has %d", len(new), out, len(before) + len(new))
    return segments


def index_rows(segments: TextSegments) -> DataFrame:
    """The whole index as rows (kind, term, chunk_id, n, total): postings (uses of a term in a chunk), terms (chunks with it), chunks (words), and one row for the corpus (chunks, words)."""
    index = segments.index()
    none, no_sum = F.lit(None).cast("string"), F.lit(None).cast("long")
    postings = index.postings.select(F.lit("posting").alias("kind"), "term", "chunk_id", F.col("tf").alias("n"), no_sum.alias("total"))
    terms = index.terms.select(F.lit("term").alias("kind"), "term", none.alias("chunk_id"), F.col("df").alias("n"), no_sum.alias("total"))
    chunks = index.lengths.select(F.lit("chunk").alias("kind"), none.alias("term"), "chunk_id", F.col("dl").alias("n"), no_sum.alias("total"))
    corpus = index.corpus.select(F.lit("corpus").alias("kind"), none.alias("term"), none.alias("chunk_id"), F.col("docs").alias("n"), F.round(F.col("docs") * F.col("mean")).cast("long").alias("total"))
    return postings.unionByName(terms).unionByName(chunks).unionByName(corpus)


if __name__ == "__main__":
    command_line(NAME, {"documents": "folder of Parquet files", "out": "folder of the index", "checkpoint": "folder of the stream's checkpoint"}, run)
