"""Substring search that reads little: groups of rows with a bitmap of the trigrams that occur in them.

A text can only be in a group whose bitmap has all of its trigrams. Bitmaps have a fixed size for a group of about EACH rows, so the index is a small share of the table; groups that pass are read and
verified, so the answer is that of a full scan. Texts are compared in lower case, as bytes of UTF-8. A text of fewer than three bytes has no trigram and is looked for everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import TEXT_FIELDS, free_text

EACH, BITS = 512, 1 << 17
#: So many groups at most are compared with a literal list, which the scan of rows can use; more are joined.
LISTED = 10_000


def gram_places(text: bytes) -> np.ndarray:
    """The places in a bitmap of a text's trigrams."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    mixed = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)
    return np.unique(mixed >> np.uint32(15)).astype(np.int64)


@dataclass
class SubstringIndex:
    """rows with their group `grp`, and grams (grp, bits)."""

    rows: DataFrame
    grams: DataFrame


def save_substrings(chunks: DataFrame, folder: str) -> None:
    """The rows of chunks (chunk_id, ...) below a folder, in ranges of groups, and the groups' bitmaps."""
    groups = max(1, -(-chunks.count() // EACH))
    dealt = chunks.withColumn("grp", F.pmod(F.xxhash64("chunk_id"), F.lit(groups)))
    dealt.repartitionByRange("grp", "chunk_id").sortWithinPartitions("grp").write.mode("overwrite").parquet(f"{folder}/rows")
    rows = chunks.sparkSession.read.parquet(f"{folder}/rows")
    hay = F.lower(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in TEXT_FIELDS if c in chunks.columns])).cast("binary")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bitmap for each group of a batch: what is shuffled is bounded by the batches, not by the texts."""
        for batch in batches:
            held: dict[int, np.ndarray] = {}
            for grp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(grp, np.zeros(BITS, bool))[gram_places(text)] = True
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(m).tobytes() for m in held.values()], pa.binary())], names=["grp", "bits"])

    def united(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(BITS // 8, np.uint8)
        for part in parts:
            for bits in part.column(1).to_pylist():
                out |= np.frombuffer(bits, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["grp", "bits"])

    shape = "grp long, bits binary"
    rows.select("grp", hay.alias("hay")).mapInArrow(places, shape).groupBy("grp").applyInArrow(united, shape).write.mode("overwrite").parquet(f"{folder}/grams")


def load_substrings(spark: SparkSession, folder: str) -> SubstringIndex:
    return SubstringIndex(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/grams"))


def possible_groups(index: SubstringIndex, asked: str) -> DataFrame:
    """grp of the groups that can hold a text."""
    wanted = gram_places(asked.strip().lower().encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = [all(bits[p >> 3] & (0x80 >> (p & 7)) for p in wanted.tolist()) for bits in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(there, pa.bool_()))], names=["grp"])

    return index.grams.select("grp", "bits").mapInArrow(run, "grp long")


def find_text(index: SubstringIndex, asked: str, content_types: Sequence[str] | None = None) -> DataFrame:
    """The rows that free_text finds, from the groups that can hold them."""
    groups = possible_groups(index, asked)
    some = [r[0] for r in groups.limit(LISTED + 1).collect()]
    rows = index.rows.filter(F.col("grp").isin(some)) if len(some) <= LISTED else index.rows.join(groups, "grp", "left_semi")
    return free_text(rows, asked, content_types).drop("grp")
