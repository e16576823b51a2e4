"""Quality by importance resampling: the ratio of two hashed n-gram models, for target and for raw text, sampled by Gumbel top-k.

Texts are cut into runs of word characters and runs of other visible characters; single tokens and adjacent pairs count in 2**bits counters. The
raw model is counted over all documents, the target model over documents labelled good, a bounded sample of them; both are smoothed. A document's weight is the mean
log ratio of its n-grams, shrunk by `prior` n-grams of ratio 1, so that length alone neither lifts nor sinks it.

* `keep` is the classifier's decision: the mean is at least `threshold`, which lies where labelled bad and good documents are best told apart,
  but never so high that more than `spare` of the labelled good ones would go.
* `sampled` is the resample: the k = round(fraction * rows) largest values of log weight + Gumbel noise of the document's id, exactly k of them. The log weight is the log of the
  importance weight, the sum of the document's log ratios, divided by `temperature` (1: as it is).

Defined results: null and empty texts, or texts without a visible character, have no n-grams, weight null, and are neither kept nor sampled ahead of others;
without good labels the target equals the raw model and all weights are 0; rows that tie in everything are sampled in any order; several labels
of a document count each; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import kept_in_worker, small_batches, with_columns, written

TOKEN = re.compile(r"\w+|[^\w\s]+")
_K = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Counter indices of a text's n-grams; token hashes are remembered up to a bound."""

    def __init__(self, bits: int, keep: int = 400_000):
        self.bits, self.keep, self.memory = np.uint64(64 - bits), keep, {}

    def _hash(self, token: str) -> int:
        import xxhash

        if len(self.memory) >= self.keep:
            self.memory.clear()
        h = self.memory[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall(text.lower()) if text else []
        if not tokens:
            return np.zeros(0, np.int64)
        get, own = self.memory.get, self._hash
        h = np.array([get(t) or own(t) for t in tokens], np.uint64)
        pairs = (h[:-1] * _K + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        return (np.concatenate((h * _K, pairs)) >> self.bits).astype(np.int64)


@dataclass
class Ratio:
    """Log ratio by counter; the classifier's threshold."""

    table: np.ndarray
    bits: int
    prior: float
    threshold: float = 0.0

    def weights(self, grams: np.ndarray) -> tuple[float | None, float | None]:
        """The shrunk mean of the log ratios, and their sum."""
        total = float(self.table[grams].sum())
        return (total / (len(grams) + self.prior), total) if len(grams) else (None, None)


def _summed(rows: DataFrame, bits: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Counters over all rows (text, good), and over the rows that are good."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, total, salt = kept_in_worker(("quality", bits), lambda: Hasher(bits)), np.zeros((2, 1 << bits), np.int64), 0
        for batch in batches:
            waiting: tuple[list, list] = ([], [])
            for text, good in zip(batch["text"], batch["good"]):
                if len(grams := hasher(text)):
                    waiting[0].append(grams)
                    salt = (salt * 31 + len(grams)) % 64
                    waiting[1].extend([grams] * int(good or 0))
            for k in (0, 1):
                if waiting[k]:
                    total[k] += np.bincount(np.concatenate(waiting[k]), minlength=1 << bits)
        if total[0].any():
            for b in range((1 << bits) // block):
                yield pd.DataFrame({"block": [b], "salt": [salt], "counts": [total[:, b * block : (b + 1) * block].tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(2 * block, np.int64)
        for raw in pdf["counts"]:
            out += np.frombuffer(raw, np.int64)
        return pd.DataFrame({"block": pdf["block"][:1], "salt": pdf["salt"][:1], "counts": [out.tobytes()]})

    shape = "block int, salt int, counts binary"
    out = np.zeros((2, 1 << bits), np.int64)
    each = rows.select("text", "good").mapInPandas(count, shape)
    for r in each.groupBy("block", "salt").applyInPandas(add, shape).groupBy("block").applyInPandas(add, shape).collect():  # 2 * 2**bits counters
        out[:, r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["counts"], np.int64).reshape(2, block)
    return out[0], out[1]


def _threshold(weights: DataFrame, spare: float, step: float = 0.01) -> float:
    """The best cut between labelled bad and good weights, from a histogram of both."""
    bins = F.floor(F.greatest(F.least("weight", F.lit(20.0)), F.lit(-20.0)) / step).cast("int")
    rows = weights.filter("weight is not null").groupBy(bins.alias("bin")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()  # 4,001 bins
    if not rows or not sum(r["good"] for r in rows) or not sum(r["bad"] for r in rows):
        return -20.0
    rows.sort(key=lambda r: r["bin"])
    good, bad = (np.array([r[c] for r in rows], float) for c in ("good", "bad"))
    below_good, below_bad = (np.concatenate(([0], np.cumsum(x))) / x.sum() for x in (good, bad))
    score = np.where(below_good <= spare, below_bad - below_good, -1)
    cut = int(score.argmax())  # bins below it are bad
    if cut == 0:
        return float(rows[0]["bin"] * step)
    if cut == len(rows):
        return float((rows[-1]["bin"] + 1) * step)
    low, high = (rows[cut - 1]["bin"] + 1) * step, rows[cut]["bin"] * step
    return float(low + (high - low) / 4)  # in the gap, nearer to the bad: what is in doubt stays


def fit(docs: DataFrame, labels: DataFrame, bits: int = 16, prior: float = 8.0, spare: float = 0.02, labelled: int = 20_000, seed: int = 3) -> Ratio:
    """The raw model over all of docs (doc_id, text); the target model, and the threshold, over about `labelled` rows of labels (doc_id, quality: 1 good, 0 bad).

    The labelled rows are chosen by a hash of their id. Their ids and labels are all that is broadcast (less than 1 MB for each 20,000), and the texts stay where they are.
    """
    small_batches(docs.sparkSession)
    own = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    share = min(1.0, labelled / max(1, own.count()))
    chosen = own.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(10**9)) < int(share * 10**9))
    known = chosen.groupBy("doc_id").agg(F.sum("quality").cast("long").alias("good"), F.sum(1 - F.col("quality")).cast("long").alias("bad"))
    known = written(known, "quality-labels")
    if known.count() > 2 * labelled:  # a hash does not do that
        raise RuntimeError("more labelled rows than the bound")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw, target = _summed(texts.join(F.broadcast(known), "doc_id", "left").fillna(0, ["good", "bad"]), bits)
    if not target.any():
        return Ratio(np.zeros(1 << bits), bits, prior, -20.0)
    n = len(raw)
    model = Ratio(np.log((target + 1) / (target.sum() + n)) - np.log((raw + 1) / (raw.sum() + n)), bits, prior)
    weighed = weigh(texts.join(F.broadcast(known), "doc_id"), model, ["good", "bad"])
    model.threshold = _threshold(weighed, spare)
    return model


def weigh(docs: DataFrame, model: Ratio, keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (all, if none are named) with weight, the mean log ratio, and log_weight, their sum (null without n-grams)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits numbers

    def start() -> Callable:
        hasher = kept_in_worker(("quality", shared.value.bits), lambda: Hasher(shared.value.bits))
        return lambda texts: zip(*[shared.value.weights(hasher(t)) for t in texts]) if texts else ((), ())

    return with_columns(docs, start, "weight double, log_weight double", keep)


def _nth(rows: DataFrame, column: str, n: int, digits: int) -> tuple[int, int, int]:
    """The n-th largest value of a column of longs below 2**63, how many rows are above it, and how many equal it.

    Each pass counts the rows by the next `digits` bits below the prefix that holds it: at most 2**digits counters reach the driver.
    """
    prefix, above, done = 0, 0, 0
    while done < 63:
        width = min(digits, 63 - done)
        inside = rows if not done else rows.filter(F.shiftright(column, 63 - done) == prefix)
        found = inside.groupBy(F.shiftright(column, 63 - done - width).alias("p")).count().collect()
        for r in sorted(found, key=lambda r: -r["p"]):
            if above + r["count"] >= n:
                prefix, equal = r["p"], r["count"]
                break
            above += r["count"]
        done += width
    return prefix, above, equal


def gumbel_top(rows: DataFrame, key: str, k: int, digits: int = 12) -> DataFrame:
    """rows with `sampled`: whether key (double, no nulls) is among the k largest; exactly k of them, or all rows if there are fewer.

    The key becomes a number of 62 bits that orders as it does. Rows equal in all bits are ordered by a hash of doc_id, and rows that are equal in that, too, by a number of their own.
    """
    numbered = rows.withColumn("_a", _ordered_bits(key)).withColumn("_b", F.shiftrightunsigned(F.xxhash64("doc_id"), 1)).withColumn("_c", F.monotonically_increasing_id())
    rows = written(numbered, "quality-keys")  # the numbers stay as they are written
    plain = rows.drop("_a", "_b", "_c")
    if k <= 0 or k >= rows.count():
        return plain.withColumn("sampled", F.lit(k > 0))
    sampled, equal, left, inside = F.lit(False), F.lit(True), k, rows
    for column in ("_a", "_b", "_c"):
        value, above, n = _nth(inside, column, left, digits)
        sampled |= equal & (F.col(column) > value)
        equal &= F.col(column) == value
        left -= above
        if n == left:
            break
        inside = inside.filter(F.col(column) == value)
    return rows.withColumn("sampled", sampled | equal).drop("_a", "_b", "_c")


def _ordered_bits(key: str) -> Column:
    """A long of 0..2**63-1 that orders as the double does, to 2**-40 between -2**20 and 2**20."""
    bounded = F.greatest(F.least(F.col(key), F.lit(2.0**20)), F.lit(-(2.0**20)))
    return ((bounded + F.lit(2.0**20)) * F.lit(2.0**40)).cast("long")


def resample(docs: DataFrame, labels: DataFrame, fraction: float = 0.5, temperature: float = 1.0, seed: int = 5, model: Ratio | None = None) -> DataFrame:
    """doc_id, weight, log_weight, keep, gumbel_key, sampled for every row of docs (doc_id, text)."""
    model = model or fit(docs, labels)
    weighed = weigh(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), model, ["doc_id"])
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) + 0.5) / F.lit(2.0**53)
    key = F.coalesce(F.col("log_weight") / temperature, F.lit(-1e5)) - F.log(-F.log(uniform))
    rows = weighed.withColumn("gumbel_key", key).withColumn("keep", F.coalesce(F.col("weight") >= model.threshold, F.lit(False)))
    rows = written(rows, "quality-weights")
    out = gumbel_top(rows, "gumbel_key", round(fraction * rows.count()))
    return out.select("doc_id", "weight", "log_weight", "keep", "gumbel_key", "sampled")
