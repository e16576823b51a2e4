"""Embeddings: a pluggable model behind an iterator function that loads it once for each worker; the default hashes words.

No model files are installed here, so the default is a deterministic signed hash of words and their three-letter parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384


def hashed_embedding(text: str, n: int = DIMENSIONS) -> list[float]:
    out = np.zeros(n, np.float64)
    for word in text.lower().split():
        for part in (word, *(word[i : i + 3] for i in range(len(word) - 2))):
            h = zlib.crc32(part.encode())
            out[h % n] += 1.0 if h & 0x10000 else -1.0
    norm = float(np.sqrt((out * out).sum()))
    return (out / norm if norm else out).astype(np.float32).tolist()


def _hashing() -> Callable[[list[str]], list[list[float]]]:
    return lambda texts: [hashed_embedding(t) for t in texts]


def embed(rows: DataFrame, model: Callable[[], Callable[[list[str]], list[list[float]]]] = _hashing, text: str = "content", out: str = "embedding") -> DataFrame:
    """rows with the column out where it is missing or null; model() loads a model in a worker and returns its function."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for batch in batches:
            there = batch.notna().tolist()
            found = iter(encode([t for t, known in zip(batch, there) if known]) if any(there) else ())
            yield pd.Series([next(found) if known else None for known in there], dtype=object)

    if out not in rows.columns:
        return rows.withColumn(out, run(F.col(text)))
    return rows.withColumn(out, F.coalesce(F.col(out), run(F.when(F.col(out).isNull(), F.col(text)))))


def score_pairs(rows: DataFrame, model: Callable[[], Callable[[list[str], list[str]], list[float]]], query: str = "query", text: str = "content", most: int = 1000) -> DataFrame:
    """rows with ce_logit from a pair scorer over (query, first `most` characters of text)."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = model()
        for q, t in batches:
            yield pd.Series(score(q.tolist(), t.tolist()), index=q.index, dtype=float)

    return rows.withColumn("ce_logit", run(F.col(query), F.substring(F.col(text), 1, most)))
