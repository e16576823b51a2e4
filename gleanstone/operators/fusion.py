"""Fusion of ranked lists, score adjustments, and diversity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import DUAL_BONUS, RRF_K, adjusted, reciprocal_rank, staleness, symbol_boost, type_preference
from ..functions.text import query_symbols

RUN = 3


def fuse(ranked: DataFrame, lists: int = 2, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, rrf, n_lists, src_order from rows (query_id, chunk_id, list 0..lists-1, rank): one shuffle in place of an outer join.

    Lists count in the normalisation even if they are empty. src_order is where a chunk is first met, list by list.
    """
    return ranked.groupBy("query_id", "chunk_id").agg(
        F.sum(reciprocal_rank(F.col("rank"), lists, k)).alias("rrf"),
        F.countDistinct("list").alias("n_lists"),
        F.min(F.struct("list", "rank")).alias("_first"),
    ).select("query_id", "chunk_id", "rrf", "n_lists", (F.col("_first.list") * 1_000_000 + F.col("_first.rank")).alias("src_order"))


def adjust(fused: DataFrame, query: Column, now: Column, penalty: Column | None = None) -> DataFrame:
    """fused rows with content and indexed_at get `score`: boosts for symbols and double hits, less capped penalties, within 0..1."""
    boost = symbol_boost(F.col("content"), query_symbols(query)) + F.when(F.col("n_lists") > 1, DUAL_BONUS).otherwise(0.0)
    lost = staleness(F.col("indexed_at"), now) + (penalty if penalty is not None else F.lit(0.0))
    return fused.withColumn("score", adjusted(F.col("rrf"), boost, lost))


def prefer_types(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", type_preference(F.col("score"), F.coalesce("chunk_type", F.lit(""))))


def spread(repos: list[str], paths: list[str], run: int = RUN) -> list[int]:
    """An order of the items, best first: each time the first that would not be one more than `run` in a row of its repo or path, else the first."""
    left, out = list(range(len(repos))), []
    while left:
        tail = out[-run:]

        def full(values: list[str], i: int, tail: list[int] = tail) -> bool:
            return len(tail) == run and all(values[t] == values[i] for t in tail)

        pick = next((i for i in left if not (full(repos, i) or full(paths, i))), left[0])
        left.remove(pick)
        out.append(pick)
    return out


def diversify(rows: DataFrame) -> DataFrame:
    """rows (query_id, score, src_order, repo, path, ...) with `rank`: result lists are short (the limits of both searches), so a list is one group."""
    shape = rows.select("query_id", "chunk_id", F.lit(1).alias("rank"))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "src_order"], ascending=[False, True], kind="stable").reset_index(drop=True)
        picked = pdf.iloc[spread(pdf["repo"].fillna("").tolist(), pdf["path"].fillna("").tolist())]
        return pd.DataFrame({"query_id": picked["query_id"].to_numpy(), "chunk_id": picked["chunk_id"].to_numpy(), "rank": range(1, len(picked) + 1)})

    slim = rows.select("query_id", "chunk_id", "score", "src_order", "repo", "path")
    ranks = slim.groupBy("query_id").applyInPandas(order, shape.schema)
    return rows.join(ranks, ["query_id", "chunk_id"])


def interleave(rows: DataFrame, limit: int) -> DataFrame:
    """rows (query_id, concept, rank, chunk_id): the first of each concept, then the second, and so on; a chunk once; final `rank` by position."""
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank", "concept")
    kept = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "concept"))
    return kept.withColumn("place", place).filter(F.col("place") <= limit)


def rescored(rows: DataFrame, scores: Column, top: int = 20) -> DataFrame:
    """A second scorer orders the first `top` ranks; the others keep their order behind them."""
    inside = F.col("rank") <= top
    out = rows.withColumn("ce_score", F.when(inside, scores))
    order = Window.partitionBy("query_id").orderBy(inside.desc(), F.desc_nulls_last("ce_score"), "rank")
    return out.withColumn("rank", F.row_number().over(order)).withColumn("score", F.coalesce("ce_score", "score"))
