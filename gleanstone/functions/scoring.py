"""Score arithmetic of ranking and evidence, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ranking.
RRF_K = 60
STALE_MOST, STALE_DAYS = 0.10, 365
SYMBOL_BOOST, DUAL_BONUS, VERSION_PENALTY, PENALTY_CAP = 0.15, 0.10, 0.05, 0.10
TYPE_PREFERENCE = {"method": 0, "function": 1, "type_definition": 2, "class_overview": 3, "module_overview": 4}
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
HIGH_SCORE, LOW_SCORE, LOW_CONFIDENCE, CONFIDENCE_FLOOR = 0.5, 0.1, 0.3, 0.15


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """(1 + cos) / 2: 1 minus half the cosine distance."""
    return (F.lit(1.0) + dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))) / 2


def reciprocal_rank(rank: Column, lists: int, k: int = RRF_K) -> Column:
    """One list's share of the fused score, of which being first in every list makes 1."""
    return (F.lit(1.0) / (F.lit(k) + rank)) / F.lit(lists / (k + 1))


def idf(docs: Column, df: Column) -> Column:
    raw = F.log((docs - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)


def bm25(tf: Column, length: Column, mean: Column, weight: Column) -> Column:
    return weight * (tf * (BM25_K1 + 1)) / (tf + F.lit(BM25_K1) * (1 - BM25_B + F.lit(BM25_B) * length / mean))


def symbol_boost(content: Column, symbols: Column) -> Column:
    low = F.lower(content)
    return F.when(F.coalesce(F.exists(symbols, lambda s: low.contains(F.lower(s))), F.lit(False)), SYMBOL_BOOST).otherwise(0.0)


def staleness(indexed_at: Column, now: Column) -> Column:
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(indexed_at)) / 86400)
    return F.when(days > 0, F.least(F.lit(STALE_MOST), days / STALE_DAYS * STALE_MOST)).otherwise(0.0)


def adjusted(score: Column, boost: Column, penalty: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + boost - F.least(penalty, F.lit(PENALTY_CAP))))


def type_preference(score: Column, chunk_type: Column) -> Column:
    pref = F.lit(4)
    for name, rank in TYPE_PREFERENCE.items():
        pref = F.when(chunk_type == name, rank).otherwise(pref)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + (4 - pref) * 0.005))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (1 + F.exp(-x))


def confidence(top: Column, mean: Column, n: Column) -> Column:
    """How far a result list can be trusted, by its best and mean score and its length."""
    return (
        F.when(n == 0, 0.0)
        .when((top >= HIGH_SCORE) & (n >= 3), F.least(F.lit(0.95), 0.6 + mean * 0.3 + F.least(n / 15.0, F.lit(0.15))))
        .when(top >= LOW_SCORE, F.least(F.lit(0.7), 0.3 + mean * 0.3 + F.least(n / 20.0, F.lit(0.1))))
        .otherwise(F.greatest(F.lit(0.05), 0.1 + mean * 0.2))
    )
