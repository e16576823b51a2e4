"""What a result list tells: known and unknown items, confidence, and what to ask next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import CONFIDENCE_FLOOR, LOW_CONFIDENCE, LOW_SCORE, confidence
from ..functions.text import statement

#: What to try when a kind of content has nothing.
ELSEWHERE = {"doc": "Try search_examples for working code: ", "source": "Try search_docs for conceptual guidance: ", "code": "Try search_api for framework internals: "}


def citation(section: Column | None = None) -> Column:
    return F.struct("source_url", "repo", "path", "commit_sha", (section if section is not None else F.lit(None).cast("string")).alias("section"), "indexed_at")


def next_queries(query: Column, n: Column, top_repo: Column, filters: dict) -> Column:
    """At most five suggestions, in a fixed order."""
    said = F.split(F.trim(F.regexp_replace(query, r"\s+", " ")), " ")
    made = [F.when((n < 3) & (F.size(said) > 2), F.concat(F.lit("Broaden search: "), F.array_join(F.slice(said, 1, 2), " ")))]
    if "repo" in filters:
        made.append(F.concat(F.lit("Search across all repos: "), query))
    if filters.get("content_type") in ELSEWHERE:
        made.append(F.when(n == 0, F.concat(F.lit(ELSEWHERE[filters["content_type"]]), query)))
    if "content_type" in filters:
        made.append(F.concat(F.lit("Search all content types: "), query))
    made += [F.when(n < 5, F.concat(F.lit("Related: "), query, F.lit(f" {kind}"))) for kind in ("tutorial", "example")]
    made.append(F.when(F.coalesce(top_repo, F.lit("")) != "", F.concat(F.lit("More from "), top_repo, F.lit(": "), query)))
    return F.slice(F.filter(F.array(*made), lambda s: s.isNotNull()), 1, 5)


def rationale(top: Column, mean: Column, n: Column) -> Column:
    numbers = F.format_string("(top score: %.2f, avg: %.2f).", top, mean)
    count = F.concat(F.lit("Found "), n.cast("string"))
    return (
        F.when(n == 0, "No results found for the query.")
        .when((top >= 0.5) & (n >= 3), F.concat(count, F.lit(" results with strong relevance "), numbers))
        .when(top >= LOW_SCORE, F.concat(count, F.lit(" results with moderate relevance "), numbers))
        .otherwise(F.concat(count, F.lit(" results but relevance scores are low "), numbers, F.lit(" Results may not fully address the query.")))
    )


def assemble(queries: DataFrame, results: DataFrame, filters: dict | None = None) -> DataFrame:
    """One row for each of queries (query_id, query): known, unknown, confidence, low_confidence, confidence_rationale, next_retrieval_queries.

    results: (query_id, rank, score, content, repo and the columns of a citation), short lists.
    """
    filters = filters or {}
    item = F.struct(
        "rank", statement(F.col("content")).alias("statement"), citation().alias("citation"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("confidence")
    )
    grouped = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.avg("score").alias("mean"), F.min_by("repo", "rank").alias("top_repo"), F.sort_array(F.collect_list(item)).alias("items")
    )
    rows = queries.join(grouped, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    q, n = F.col("query"), F.col("n")
    rows = rows.withColumn("confidence", confidence(F.col("top"), F.col("mean"), n)).withColumn("ask", next_queries(q, n, F.col("top_repo"), filters))

    def unknown(when: Column, question: str, reason: str, ask: Column) -> Column:
        return F.when(when, F.struct(F.concat(F.lit(question), q).alias("question"), F.lit(reason).alias("reason"), ask.alias("suggested_queries")))

    gaps = F.array(
        unknown(n == 0, "No content found for: ", "The index returned zero results for this query.", F.col("ask")),
        unknown((n > 0) & (F.col("top") < LOW_SCORE), "Low relevance results for: ", "All results had low relevance scores, suggesting the query may not match indexed content well.", F.col("ask")),
        unknown((n > 0) & (F.col("confidence") < CONFIDENCE_FLOOR), "Weak matches for: ", "The index has no strong matches for this query.", F.slice("ask", 1, 3)),
    )
    return rows.select(
        "query_id",
        "query",
        F.col("items").alias("known"),
        F.filter(gaps, lambda g: g.isNotNull()).alias("unknown"),
        "confidence",
        (F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence"),
        rationale(F.col("top"), F.col("mean"), n).alias("confidence_rationale"),
        F.col("ask").alias("next_retrieval_queries"),
    )


def single_item(found: Column, item_id: Column, kind: str) -> Column:
    """Evidence of a direct lookup: 1 or 0."""
    there = F.concat(F.lit(f"Direct lookup for {kind} '"), item_id, F.lit("' succeeded."))
    ask = F.concat(F.lit(f"Search for {kind}s related to: "), item_id)
    return F.struct(
        F.when(found, 1.0).otherwise(0.0).alias("confidence"),
        F.when(found, there).otherwise(f"The requested {kind} was not found in the index.").alias("confidence_rationale"),
        F.when(found, F.array().cast("array<string>")).otherwise(F.array(ask)).alias("next_retrieval_queries"),
    )
