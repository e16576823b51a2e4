"""Best-fit packing with exact-complement hashing.

Documents are cut into pieces of at most `capacity` tokens. What decides a packing is the number of
pieces of each length, at most `capacity` numbers whatever the input; the plan is made from that table:

1. a length opens sequences, the longest first, as many at a time as the counts allow;
2. the gap is looked up in an index of the lengths still there: one piece of that length, else a pair
   with that sum, else a triple; such combinations fill the gap exactly and are consumed as often as
   the counts of all their lengths allow;
3. what no combination fills takes the longest piece that fits (best fit), and its smaller gap is looked up again.

Every step uses up a length or closes its sequences, so a plan has a few rows for each length. Pieces are numbered within
their length (in salted buckets, so that a length with a third of all pieces is no single task's) and find
their sequence and place by a join with the plan.

Defined results: a null text is an empty one (the end id alone); equal rows are packed as separate pieces,
in any order; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import given_id, held_id, parts, small_batches, written
from .wordbpe import word_bpe

Pattern = tuple[list[tuple[int, int]], int]


class _Index:
    """Which lengths are there, and combinations of them by their sum."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.there = counts > 0

    def take(self, length: int, times: int) -> None:
        self.counts[length] -= times
        self.there[length] = self.counts[length] > 0

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.there[gap] else None

    def pair(self, gap: int, least: int = 1) -> tuple[int, ...] | None:
        """Two lengths a >= b >= least with the sum gap, the longest a first."""
        if gap < 2 * least:
            return None
        a = np.arange((gap + 1) // 2, gap - least + 1)
        fits = self.there[a] & self.there[gap - a]
        if gap % 2 == 0 and len(fits) and self.counts[gap // 2] < 2:
            fits[0] = False
        found = np.flatnonzero(fits)
        return (int(a[found[-1]]), int(gap - a[found[-1]])) if len(found) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Three lengths with the sum gap, the longest first."""
        for a in np.flatnonzero(self.there[: max(gap - 1, 0)])[::-1].tolist():
            if 3 * a < gap:
                return None
            self.there[a] = self.counts[a] > 1
            rest = self.pair(gap - a)
            if rest and rest.count(a) + 1 > self.counts[a]:
                rest = None
            self.there[a] = True
            if rest:
                return (a, *rest)
        return None

    def longest(self, gap: int) -> int:
        found = np.flatnonzero(self.there[: gap + 1])
        return int(found[-1]) if len(found) else 0


def plan_packing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns (lengths in a sequence as (length, times), number of such sequences) that use up counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit")
        left[length] += n
    index, done = _Index(left), []
    while (first := index.longest(capacity)) > 0:
        open_now = [([first], int(left[first]))]
        index.take(first, int(left[first]))
        while open_now:
            held, n = open_now.pop()
            gap = capacity - sum(held)
            fill = None
            if gap:
                fill = index.single(gap) or index.pair(gap) or index.triple(gap)
                if fill is None and (best := index.longest(gap)):
                    fill = (best,)
            if not fill:
                if gap > held[0] or (gap == held[0]):  # its own length still fits: sequences of the same kind share
                    share = min(capacity // held[0], n) if len(held) == 1 else 1
                    if share > 1:
                        whole, rest = divmod(n, share)
                        done.append(([held[0]] * share, whole))
                        if rest:
                            done.append(([held[0]] * rest, 1))
                        continue
                done.append((held, n))
                continue
            times = {x: fill.count(x) for x in fill}
            take = min(n, *(int(left[x]) // k for x, k in times.items()))
            for x, k in times.items():
                index.take(x, k * take)
            if take < n:
                open_now.append((held, n - take))
            open_now.append(([*held, *fill], take))
    return [([(x, held.count(x)) for x in dict.fromkeys(held)], n) for held, n in done]


def _plan_rows(patterns: list[Pattern]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(length, first ordinal, end ordinal, first sequence, pieces of it in a sequence, offset) of each part of each pattern."""
    sequence, used = 0, {}
    for held, n in patterns:
        offset = 0
        for length, times in held:
            start = used.get(length, 0)
            used[length] = start + n * times
            yield length, start, used[length], sequence, times, offset
            offset += length * times
        sequence += n


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of all documents, each with the CRC of its ids."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = word_bpe(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, raw in zip(batch["doc_id"], encoder.ids([t or "" for t in batch["text"]])):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    pieces = docs.select(held_id("doc_id").alias("doc_id"), F.col("text").cast("string")).mapInPandas(cut, PIECES)
    return pieces.withColumn("doc_id", given_id("doc_id"))


def packed(pieces: DataFrame, capacity: int, plan: Callable[[dict[int, int], int], list[Pattern]] = plan_packing) -> DataFrame:
    """pieces (any columns, among them length; read more than once) with sequence_id and offset."""
    spark = pieces.sparkSession
    salts = max(1, parts(spark))
    keys = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    counts = written(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "packing-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    names = "length int, _from long, _to long, _sequence long, _times long, _offset long"
    rows = pd.DataFrame(list(_plan_rows(plan(totals, capacity))), columns=[x.split()[0] for x in names.split(", ")])
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)) - 1
    ranked = salted.withColumn("_local", local).join(starts, ["length", "_salt"]).withColumn("_ordinal", F.col("_before") + F.col("_local"))
    places = spark.createDataFrame(rows, names)
    joined = ranked.join(  # a few rows for each length
        F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("_ordinal") >= F.col("_from")) & (F.col("_ordinal") < F.col("_to"))
    ).drop(places["length"])
    nth = F.col("_ordinal") - F.col("_from")
    return joined.select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(nth / F.col("_times"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (nth % F.col("_times")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    pieces = written(token_pieces(docs, path, capacity, end_id), "packing-pieces")
    return packed(pieces, capacity).withColumn("length", F.col("length").cast("long"))
