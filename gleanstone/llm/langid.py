"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

1. A bounded sample of labelled training rows, `per_language` for each language, is chosen by hash.
2. Document frequencies of hashed n-grams (1 to 4 characters, words padded by spaces) are counted over all training rows.
3. FTRL-proximal with an L1 and an L2 penalty (elastic net) fits the weights; most stay exactly zero.
4. A temperature, fitted on a held-back quarter of the sample, calibrates the probabilities.
5. Whole texts are scored in batches: the logits are sums over positions of idf * weight, divided by the number of n-grams.

The frequencies add up in a table of 2**bits counters for each task, summed by block of counters in two steps, so what
reaches the driver has a fixed size.

Defined results: a null text, or one without a letter, is `und` with score 0; an empty or unlabelled training table
gives `und` for all; null languages and null ids are not learned; of training rows with equal ids the one of the least language and text counts;
equal texts get equal results; only the named columns are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import forget, small_batches, with_columns

UND = "und"
SIZES = (1, 2, 3, 4)
_MULT = np.uint32(0x9E3779B1)
_SIZE_SEED = (0, 0x2545F491, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def _class_of(c: int) -> tuple[int, bool]:
    """The code that a code point counts as (a letter's lower case, a mark itself, else a space), and whether it is a letter."""
    ch = chr(c)
    kind = unicodedata.category(ch)[0]
    low = ch.lower() if kind == "L" else ch
    return (ord(low) if len(low) == 1 else c) if kind in "LM" else 32, kind == "L"


_TABLE: list[tuple[np.ndarray, np.ndarray]] = []


def codes(text: str) -> np.ndarray:
    """Lower-case letters and marks, with one space for each run of anything else, and at both ends; empty without a letter of any plane."""
    if not _TABLE:
        pairs = [_class_of(c) for c in range(1 << 16)]
        _TABLE.append((np.array([c for c, _ in pairs], np.uint32), np.array([own for _, own in pairs])))
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = np.minimum(raw, 0xFFFF)
    out, letter = _TABLE[0][0][low], _TABLE[0][1][low]
    high = np.flatnonzero(raw > 0xFFFF)
    if len(high):
        few, place = np.unique(raw[high], return_inverse=True)
        pairs = [_class_of(c) for c in few.tolist()]
        out[high], letter[high] = np.array([c for c, _ in pairs], np.uint32)[place], np.array([own for _, own in pairs])[place]
    if not letter.any():
        return out[:0]
    space = out == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    out = out[keep]
    return np.pad(out, (int(out[0] != 32), int(out[-1] != 32)), constant_values=32)


def hashed(c: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """For each n, the counter of the n-gram at each position."""
    acc = np.zeros(len(c), np.uint32)
    for n in SIZES:
        if len(c) < n:
            return
        acc = acc[: len(c) - n + 1] * _MULT + c[n - 1 :]
        h = acc ^ np.uint32(_SIZE_SEED[n])
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
        yield h >> np.uint32(32 - bits)


def grams_of(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters of a text's n-grams, sorted, and how often each occurs."""
    c = codes(text) if text else np.zeros(0, np.uint32)
    if not len(c):
        return np.zeros(0, np.uint32), np.zeros(0)
    counts = np.bincount(np.concatenate(list(hashed(c, bits))), minlength=1 << bits)
    f = np.flatnonzero(counts)
    return f.astype(np.uint32), counts[f].astype(np.float64)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # idf * weight by counter and label
    bias: np.ndarray
    temperature: float
    bits: int

    def logits(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of texts given by their counters and how often each occurs; without any, the biases."""
        out = np.tile(self.bias, (len(grams), 1))
        for i, (f, c) in enumerate(grams):
            if len(f):
                out[i] += SCALE * (c @ self.table[f]) / c.sum()
        return out

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if not self.labels:
            return np.full(len(texts), UND, object), np.zeros(len(texts))
        grams = [grams_of(t, self.bits) for t in texts]
        there = np.array([len(f) > 0 for f, _ in grams], bool)
        p = _softmax(self.logits(grams) / self.temperature)
        best = p.argmax(1)
        return np.where(there, np.array(self.labels, object)[best], UND), np.where(there, p[np.arange(len(p)), best], 0.0)


#: Relative frequencies are small; this brings them to the order of 1.
SCALE = 20.0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, width: int, l1: float, l2: float, alpha: float, beta: float = 1.0, epochs: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (width x k) and biases by FTRL-proximal, one row at a time: rows are (features, values)."""
    z, n = np.zeros((width + 1, k)), np.zeros((width + 1, k))
    order = np.random.default_rng(seed)

    def weights(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        w = -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(n[f])) / alpha + l2)
        return np.where(np.abs(zf) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            f, v = rows[i]
            w = weights(f)
            p = _softmax((v @ w)[None])[0]
            p[y[i]] -= 1
            g = v[:, None] * p
            step = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - step * w
            n[f] += g * g
    w = weights(np.arange(width + 1))
    return w[:width], w[width]


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(_softmax(z / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()) + 1e-4 * t * t

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(texts: DataFrame, bits: int, block: int = 4096) -> tuple[np.ndarray, int]:
    """How many of the texts (column text) hold the n-grams of each counter, and how many texts have a letter."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        df, docs, salt = np.zeros(1 << bits, np.int64), 0, 0
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            for text in batch["text"]:
                c = codes(text) if text else ()
                if not len(c):
                    continue
                salt = (salt * 31 + len(c)) % 64
                docs += 1
                for h in hashed(c, bits):
                    seen[h] = True
                own = np.flatnonzero(seen)
                df[own] += 1
                seen[own] = False
        if docs:
            yield pd.DataFrame({"block": range((1 << bits) // block), "salt": salt, "counts": [x.tobytes() for x in df.reshape(-1, block)], "docs": docs})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, np.int64)
        for raw in pdf["counts"]:
            total += np.frombuffer(raw, np.int64)
        return pd.DataFrame({"block": pdf["block"][:1], "salt": pdf["salt"][:1], "counts": [total.tobytes()], "docs": [int(pdf["docs"].sum())]})

    shape = "block int, salt int, counts binary, docs long"
    each = texts.select("text").mapInPandas(count, shape)
    summed = each.groupBy("block", "salt").applyInPandas(add, shape).groupBy("block").applyInPandas(add, shape)
    out, docs = np.zeros((1 << bits) // block * block, np.int64), 0
    for r in summed.collect():  # 2**bits counters, whatever the input
        out[r["block"] * block : (r["block"] + 1) * block], docs = np.frombuffer(r["counts"], np.int64), r["docs"]
    return out, docs


def fit(train: DataFrame, bits: int = 16, per_language: int = 320, l1: float = 0.02, l2: float = 0.5, alpha: float = 0.5, seed: int = 13) -> Model:
    """A model from the labelled rows of train (doc_id, text, lang); per_language bounds the sample that weights are fitted on."""
    labelled = train.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keys = labelled.select("doc_id", "lang", F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_h"))
    few = keys.withColumn("_r", F.row_number().over(Window.partitionBy("lang", F.pmod("_h", F.lit(64))).orderBy("_h", "doc_id"))).filter(F.col("_r") <= per_language)
    top = few.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).filter(F.col("_r") <= per_language)
    sample = labelled.join(F.broadcast(top.select("doc_id").distinct()), "doc_id", "left_semi")  # languages * per_language ids
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.lang", "r.text")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for batch in batches:
            found = [grams_of(t, bits) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "f": [f.tobytes() for f, _ in found], "c": [c.astype(np.uint32).tobytes() for _, c in found]})

    small_batches(train.sparkSession)
    rows = sample.mapInPandas(features, "doc_id long, lang string, f binary, c binary").orderBy("doc_id").collect()  # 8 bytes for each of at most 2**bits counters of a row
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), 1.0, bits)
    df, docs = document_frequencies(labelled.select("text"), bits)
    idf = np.log((1 + docs) / (1 + df)) + 1
    y = np.array([labels.index(r["lang"]) for r in rows])
    grams = [(np.frombuffer(r["f"], np.uint32).astype(np.int64), np.frombuffer(r["c"], np.uint32).astype(np.float64)) for r in rows]
    made = [(np.append(f, 1 << bits), np.append(SCALE * idf[f] * c / c.sum(), 1.0)) for f, c in grams]
    held = np.arange(len(rows)) % 4 == 3 if len(rows) >= 8 else np.zeros(len(rows), bool)
    w, b = fit_ftrl([x for x, no in zip(made, held) if not no], y[~held], len(labels), 1 << bits, l1, l2, alpha)
    model = Model(labels, (idf[:, None] * w).astype(np.float32), b, 1.0, bits)
    model.temperature = fit_temperature(model.logits([g for g, own in zip(grams, held) if own]), y[held])
    return model


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (all, if none are named) with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits * labels numbers
    return with_columns(docs, lambda: forget() or shared.value.predict, "lang_pred string, score double", keep)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def predict_languages(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows with crc32(doc_id) mod 3 = 1 are never learned from."""
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"), **options)
    slim = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(slim, model, ["doc_id", "held_out"])
