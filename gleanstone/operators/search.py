"""The two searches: exact cosine top-k, and BM25 over postings derived from the chunk table."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import bm25, idf
from ..functions.stemming import porter
from ..functions.text import words
from .vector_index import nearest_by_scan

#: Columns that are compared for equality, by prefix, and by membership.
EQUAL = ("repo", "content_type", "foundational_class", "language", "domain", "execution_mode", "method_name", "chunk_type", "is_dataclass")
PREFIX = ("path", "class_name", "module_path")
MEMBER = ("yields", "calls")


def matches(filters: dict) -> Column:
    """One predicate for all filters; each kind is pushed to the scan where the format allows."""
    out = F.lit(True)
    for key, value in filters.items():
        if key == "chunk_id" or key in EQUAL:
            out &= F.col(key) == F.lit(value)
        elif key in PREFIX:
            out &= F.coalesce(F.col(key), F.lit("")).startswith(value)
        elif key in MEMBER:
            out &= F.coalesce(F.array_contains(key, value), F.lit(False))
        elif key == "capability_tags":
            wanted = [value] if isinstance(value, str) else list(value)
            out &= F.size(F.array_except(F.array(*[F.lit(v) for v in wanted]).cast("array<string>"), F.coalesce(F.col(key), F.array()))) == 0
        else:
            raise ValueError(f"no such filter: {key}")
    return out


def vector_search(chunks: DataFrame, queries: DataFrame, limit: int, filters: dict | None = None, block: int = 10_000) -> DataFrame:
    """query_id, chunk_id, rank, score: for each of queries (query_id, vector), the `limit` nearest rows of chunks (chunk_id, embedding) by cosine, of all that pass the filters.

    Every row is scored; with cells that were saved (vector_index.nearest) most are not read.
    """
    return nearest_by_scan(chunks.filter(matches(filters or {})).select("chunk_id", "embedding"), queries.select("query_id", "vector"), limit, block)


def stemmed(vocabulary: DataFrame) -> DataFrame:
    """term, stem for each distinct term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(stem=[porter(t) for t in batch["term"]])

    return vocabulary.select("term").distinct().mapInPandas(run, "term string, stem string")


@dataclass
class TextIndex:
    """postings (term, chunk_id, tf, positions), lengths (chunk_id, dl), terms (term, df), corpus (docs, mean)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame
    stems: bool


def build_text_index(chunks: DataFrame, stems: bool = True, content: str = "content") -> TextIndex:
    """All tables of a text index, derived from chunks (chunk_id, content); statistics are those of the whole table."""
    token = chunks.select("chunk_id", F.posexplode(words(F.col(content))).alias("pos", "term"))
    lengths = chunks.select("chunk_id", F.size(words(F.coalesce(F.col(content), F.lit("")))).alias("dl"))
    if stems:
        token = token.join(stemmed(token), "term").select("chunk_id", "pos", F.col("stem").alias("term"))
    postings = token.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("mean"))
    return TextIndex(postings, lengths, terms, corpus, stems)


def save_text_index(index: TextIndex, folder: str) -> None:
    """The tables as Parquet, postings in ranges of terms, so that a query reads the row groups of its terms."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    for name in ("lengths", "terms", "corpus"):
        getattr(index, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def load_text_index(spark: SparkSession, folder: str, stems: bool = True) -> TextIndex:
    return TextIndex(*[spark.read.parquet(f"{folder}/{name}") for name in ("postings", "lengths", "terms", "corpus")], stems)


def changed_postings(index: TextIndex, chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """The postings after the rows named in changed (chunk_id) were added, replaced or removed: only theirs are made anew."""
    kept = index.postings.join(changed.select("chunk_id").distinct(), "chunk_id", "left_anti")
    fresh = build_text_index(chunks.join(changed.select("chunk_id").distinct(), "chunk_id", "left_semi"), index.stems).postings
    return kept.unionByName(fresh.select(kept.columns))


def phrases(query: str, stems: bool = True) -> list[list[str]]:
    """A query's words without quotes, each a phrase of its tokens; all phrases must occur. Words without letters or digits match anything."""
    from ..functions.text import _ACCENTED, _PLAIN

    table = str.maketrans(_ACCENTED, _PLAIN)
    out = []
    for word in query.split():
        tokens = re.findall(r"[^\W_]+", word.replace('"', "").lower().translate(table))
        if tokens:
            out.append([porter(t) if stems else t for t in tokens])
    return out


def text_search(index: TextIndex, queries: Sequence[tuple[int, str]], limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, rank, score of each query's best chunks by BM25; a chunk must hold every phrase, its tokens side by side.

    allowed (chunk_id) restricts the result after scoring: statistics stay those of the whole table.
    """
    spark = index.postings.sparkSession
    asked = [(q, phrases(text, index.stems)) for q, text in queries]
    rows = [(q, p, k, t, len(phrase), len(all_of)) for q, all_of in asked for p, phrase in enumerate(all_of) for k, t in enumerate(phrase)]
    wanted = F.broadcast(spark.createDataFrame(rows, "query_id long, phrase int, at int, term string, n int, phrases int"))
    # The terms are literals, so the filter goes below the aggregation of postings, or to the scan of a saved index.
    terms = sorted({r[3] for r in rows})
    hit = index.postings.filter(F.col("term").isin(terms) if terms else F.lit(False)).join(wanted, "term")
    key = ["query_id", "phrase", "phrases", "chunk_id"]
    tf = hit.filter("n = 1").select(*key, "tf")
    if any(r[4] > 1 for r in rows):  # tokens side by side: each would start the phrase at the same place
        starts = hit.filter("n > 1").withColumn("start", F.explode(F.transform("positions", lambda p: p - F.col("at"))))
        found = starts.groupBy(*key, "n", "start").agg(F.countDistinct("at").alias("seen")).filter("seen = n")
        tf = tf.unionByName(found.groupBy(*key).agg(F.count(F.lit(1)).alias("tf")))
    df = tf.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(F.broadcast(df), ["query_id", "phrase"]).join(index.lengths, "chunk_id").join(F.broadcast(index.corpus))  # df: a row for each phrase
    part = bm25(F.col("tf"), F.col("dl"), F.col("mean"), idf(F.col("docs"), F.col("df")))
    total = scored.groupBy("query_id", "chunk_id", "phrases").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("m")).filter("m = phrases")
    if allowed is not None:
        total = total.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")  # sums of equal parts may differ in the last bits
    return total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "chunk_id", "rank", "score")


#: The columns that a free text is looked for in, as far as a table has them.
TEXT_FIELDS = ("chunk_id", "content", "title", "repo", "path", "language", "chunk_type")


def free_text(chunks: DataFrame, asked: str, content_types: Sequence[str] | None = None) -> DataFrame:
    """Rows that hold `asked`, in any case, in one of TEXT_FIELDS; a blank text holds everywhere. content_types: the kinds that are shown, all if none are named."""
    fields = [F.col(c).cast("string") for c in TEXT_FIELDS if c in chunks.columns]
    rows = chunks.filter(F.col("content_type").isin(list(content_types))) if content_types is not None else chunks
    return rows.filter(F.exists(F.array(*fields), lambda f: F.coalesce(F.lower(f).contains(asked.strip().lower()), F.lit(False)))) if asked.strip() else rows


def lookup(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id).limit(1).withColumn("score", F.lit(1.0))


def filter_only(chunks: DataFrame, filters: dict, limit: int) -> DataFrame:
    """Rows in the order they were stored; no filter, no rows."""
    rows = chunks.filter(matches(filters)) if filters else chunks.limit(0)
    return rows.orderBy("seq").limit(limit).withColumn("score", F.lit(1.0))
