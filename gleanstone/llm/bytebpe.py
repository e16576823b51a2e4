"""Byte-level BPE: corpus-level merge replay, and decoding.

The corpus of a replay is the distinct pre-tokens of a block of documents that a worker has not met yet. Each is a chain of symbols, first its bytes; an inverted index
maps a pair of adjacent symbols to the positions in words that hold it, and a heap orders the pairs by the rank of the token
they make. The pair of lowest rank is merged at all its positions, left to right, and only the pairs of the touched neighbours enter the index anew.
Words do not influence each other, so every word sees its merges in the order of their rank, as one by one.

A document's ids are those of its pre-tokens, of which a worker keeps a bounded number. Decoding joins the bytes of the ids.

Defined results: a null text is an empty one (no ids; the digest of no bytes); equal texts get equal results; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import given_id, held_id, kept_in_worker, small_batches

_LETTERS = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_DIGITS = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = rb"\t-\r \x85\xa0"
#: The pattern for texts in Latin-1 bytes.
PLAIN = re.compile(
    rb"'s|'t|'re|'ve|'m|'ll|'d| ?[%b]+| ?[%b]+| ?[^%b%b%b]+|[%b]+(?![^%b])|[%b]+" % (_LETTERS, _DIGITS, _SPACES, _LETTERS, _DIGITS, _SPACES, _SPACES, _SPACES)
)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """encode(words): the ids of many words at once. Ids must be below 2**16; a pair of ids is the number a * 2**16 + b."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        get = ranks.get
        self.made = {  # of each pair of tokens that makes a token, that token's id, which is its rank
            (a << 16) | b: i
            for t, i in ranks.items()
            for cut in range(1, len(t))
            if (a := get(t[:cut])) is not None and (b := get(t[cut:])) is not None
        }
        self.byte = np.array([ranks[bytes([x])] for x in range(256)], np.int64)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        ranks = self.ranks
        out: list = [[ranks[w]] if w in ranks else [] for w in words]
        todo = [k for k, ids in enumerate(out) if not ids and words[k]]
        if not todo:
            return out
        # One chain for all words; -1 stands before, between and behind them.
        sizes = np.array([len(words[k]) for k in todo])
        first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) + 1
        chain_ = np.full(int(sizes.sum()) + len(todo) + 1, -1, np.int64)
        at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(todo)), sizes) + 1
        chain_[at] = self.byte[np.frombuffer(b"".join([words[k] for k in todo]), np.uint8)]
        key = np.where((chain_[:-1] >= 0) & (chain_[1:] >= 0), (chain_[:-1] << 16) | chain_[1:], -1)
        by = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.diff(key[by], prepend=-2))
        made = self.made
        index: dict[int, list[int]] = {}
        heap = []
        for k, lo, hi in zip(key[by[new]].tolist(), new.tolist(), [*new[1:].tolist(), len(by)]):
            if k >= 0 and (r := made.get(k)) is not None:
                index[k] = by[lo:hi].tolist()
                heap.append((r << 32) | k)
        heapq.heapify(heap)
        symbol = chain_.tolist()
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
        pop, push, get, known = heapq.heappop, heapq.heappush, made.get, index.get
        while heap:
            least = pop(heap)
            k, rank = least & 0xFFFFFFFF, least >> 32
            a, b = k >> 16, k & 0xFFFF
            places = index.pop(k)
            places.sort()
            for at in places:
                if symbol[at] != a:
                    continue
                nxt = after[at]
                if symbol[nxt] != b:
                    continue
                symbol[at], symbol[nxt] = rank, -2
                after[at] = right = after[nxt]
                before[right] = at
                x = symbol[left := before[at]]
                if x >= 0 and (r := get(k := (x << 16) | rank)) is not None:
                    if (there := known(k)) is None:
                        index[k] = [left]
                        push(heap, (r << 32) | k)
                    else:
                        there.append(left)
                y = symbol[right]
                if y >= 0 and (r := get(k := (rank << 16) | y)) is not None:
                    if (there := known(k)) is None:
                        index[k] = [at]
                        push(heap, (r << 32) | k)
                    else:
                        there.append(at)
        rest = np.array(symbol)
        alive = rest >= 0
        ids = rest[alive].tolist()
        stops = np.cumsum(alive)[first + sizes - 1].tolist()
        lo = 0
        for k, hi in zip(todo, stops):
            out[k] = ids[lo:hi]
            lo = hi
        return out


class ByteBpe:
    """ids(texts) with a memory of at most `keep` pre-tokens; beyond that it starts anew."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 800_000):
        import public_tokenizers
        import regex

        self.replay, self.keep = MergeReplay(ranks), keep
        self.find = regex.compile(pattern).findall
        self.plain = PLAIN.findall if pattern == public_tokenizers.PATTERN else None
        self.memory: dict[str | bytes, tuple[int, ...]] = {}

    def cut(self, text: str) -> list:
        """Pre-tokens: of a Latin-1 text as Latin-1 bytes, of another as strings."""
        if self.plain:
            try:
                return self.plain(text.encode("latin-1"))
            except UnicodeEncodeError:
                pass
        return self.find(text)

    def ids(self, texts: list[str]) -> list[list[int]]:
        parts = [self.cut(t) for t in texts]
        new = set(chain.from_iterable(parts)).difference(self.memory)
        if len(self.memory) + len(new) > self.keep:
            self.memory.clear()
            new = set(chain.from_iterable(parts))
        words = list(new)
        raw = [(w.decode("latin-1") if isinstance(w, bytes) else w).encode("utf-8", "surrogatepass") for w in words]
        self.memory.update(zip(words, map(tuple, self.replay.encode(raw))))
        get = self.memory.__getitem__
        return [list(chain.from_iterable(map(get, p))) for p in parts]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.replay.token.__getitem__, ids))


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One for a worker process."""
    return kept_in_worker(("byte-bpe", path, pattern), lambda: ByteBpe(read_ranks(path), pattern))


def encode_table(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary) for every row of docs: the general interface."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            ids = bpe.ids([t or "" for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": [bpe.decode(x) for x in ids]})

    rows = docs.select(held_id("doc_id").alias("doc_id"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, ids array<int>, decoded binary")
    return rows.withColumn("doc_id", given_id("doc_id"))


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs, without moving ids out of the worker."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(path, pattern)
        name = [str(i) for i in range(max(bpe.replay.token) + 1)]
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], bpe.ids([t or "" for t in batch["text"]])):
                listed = ",".join(map(name.__getitem__, ids)).encode()
                rows.append((doc_id, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(held_id("doc_id").alias("doc_id"), F.col("text").cast("string"))
    return slim.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumn("doc_id", given_id("doc_id"))
