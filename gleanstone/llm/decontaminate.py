"""Benchmark decontamination: Wu-Manber search for many test strings at once, over words.

A test string (window) is a sequence of words. For windows of one length L, blocks of three words (fewer, if L is less) index a shift table: how far the end of a window may move
on from a place where that block ends, which is L - 2 where no window holds the block and 0 where one ends with it. Places between are never looked at.
Where the shift is 0, the hash of that last block and of the words before it selects a bucket of windows, and a comparison word by word confirms an occurrence. Words are numbers from the
windows' own vocabulary, so equal numbers are equal words, and a word that is in no window moves every window past it.

A document's words are searched in lanes of equal size, each looking back into the one before, so that long and short texts advance together in one array.

Windows are dealt to blocks of about `most` words. A block is collected, built into tables and broadcast, so what a task holds is bounded however many items there are. With one block documents are
read once and not shuffled; with more, each block reads them again, and only what was found is joined back by id and hash of the text.

Defined results: a null or empty text has no words and no hits; a null item is no item, and one without an id has the empty text as id; items with equal ids are one item; an item shorter than a window is one window; no items, no hits;
equal rows get equal results; an empty table gives an empty result; other columns pass through occurrences unless they bear a new column's name, which the new one takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import small_batches, text_blocks, written

#: Words between the starts of two pieces of a long item, and positions of a lane.
PIECE, LANE = 4096, 128
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "".join(map(chr, range(65, 91)))
#: Of each byte of UTF-8, what stands for it: small letters, digits and bytes beyond ASCII are themselves, all else parts words.
BYTES = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or 48 <= b < 58 or b > 127 else 32 for b in range(256))
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
NEW = {"n_words": pa.int64(), "begins": pa.list_(pa.int64()), "stops": pa.list_(pa.int64()), "item_ids": pa.list_(pa.string())}


def words(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


class Windows:
    """All windows of one length, and where they occur."""

    def __init__(self, rows: np.ndarray, owners: np.ndarray):
        """rows: a window's words in each row; owners: the piece that each is of."""
        whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
        _, at, which = np.unique(whole, return_index=True, return_inverse=True)
        self.rows = rows[at]
        self.length = rows.shape[1]
        self.block = min(3, self.length)
        pairs = np.unique(np.stack([which.ravel(), owners], 1), axis=0)
        self.owners, self.owned = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.bits = max(12, min(22, int(len(self.rows) * 4).bit_length()))
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.int64)
        for end in range(self.block - 1, self.length):  # later ends allow shorter shifts, which stay
            self.shift[self._hash([self.rows[:, end - k] for k in range(self.block)])] = self.length - 1 - end
        keys = self._keys(lambda back: self.rows[:, self.length - 1 - back])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def _hash(self, back: list[np.ndarray]) -> np.ndarray:
        """The place in the shift table of the blocks whose last words, last but one, ... these are."""
        mixed = sum(w.astype(np.uint64) * m for w, m in zip(back, MIX))
        return ((mixed ^ (mixed >> np.uint64(29))) * MIX[0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def _keys(self, word) -> np.ndarray:
        """Bucket numbers: the last block's hash above that of the words before it."""
        last = self._hash([word(k) for k in range(self.block)]).astype(np.uint64)
        rest = np.zeros(len(last), np.uint64)
        for k in range(self.block, self.length):
            rest = (rest + word(k).astype(np.uint64)) * MIX[1]
            rest ^= rest >> np.uint64(31)
        return last << np.uint64(42) | rest >> np.uint64(22)

    def find(self, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the occurrences in texts, each of `size` words from `begin` on in ids, and their windows."""
        places = np.maximum(0, size - self.length + 1)
        lanes = -(-places // LANE)
        own = np.repeat(np.arange(len(size)), lanes)
        at = begin[own] + self.length - 1 + LANE * (np.arange(len(own)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(at + LANE, (begin + size)[own])
        ends = []
        while len(at):
            shift = self.shift[self._hash([ids[at - k] for k in range(self.block)])]
            ends.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        end = np.concatenate(ends) if ends else np.empty(0, np.int64)
        keys = self._keys(lambda back: ids[end - back])
        low, high = np.searchsorted(self.keys, keys, side="left"), np.searchsorted(self.keys, keys, side="right")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        span = np.arange(self.length)
        while (going := low < high).any():
            end, low, high = end[going], low[going], high[going]
            window, first = self.order[low], end - self.length + 1
            same = (ids[first[:, None] + span] == self.rows[window]).all(1)
            found.append((first[same], window[same]))
            low = low + 1
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


class Patterns:
    """The tables of a block of pieces (item id, words)."""

    def __init__(self, pieces: list[tuple[str, list[str]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_text: dict[tuple, int] = {}
        self.items: list[set[str]] = []  # of each distinct piece
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, spelled in pieces:
            own = tuple(self.vocabulary.setdefault(w.encode(), len(self.vocabulary) + 1) for w in spelled)
            if own in by_text:
                self.items[by_text[own]].add(item)
                continue
            by_text[own] = len(self.items)
            length = min(window, len(own))
            made = np.lib.stride_tricks.sliding_window_view(np.array(own, np.int32), length)
            rows.setdefault(length, []).append(made)
            owners.setdefault(length, []).append(np.full(len(made), len(self.items)))
            self.items.append({item})
        self.lengths = [Windows(np.concatenate(rows[k]), np.concatenate(owners[k])) for k in sorted(rows)]

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, list[int], list[int], list[str]]]:
        """Of each text the number of its words, the runs of hit words (begin, stop), and the items."""
        spelled = [words(t) for t in texts]
        size = np.array([len(s) for s in spelled], np.int64)
        begin = np.cumsum(size) - size
        known = self.vocabulary.get
        ids = np.fromiter((known(w, 0) for s in spelled for w in s), np.int32, int(size.sum()))
        change = np.zeros(len(ids) + 1, np.int64)
        pieces: dict[int, set[int]] = {}
        for table in self.lengths:
            first, window = table.find(ids, begin, size)
            np.add.at(change, first, 1)
            np.add.at(change, first + table.length, -1)
            text = np.searchsorted(begin, first, side="right") - 1
            for k, w in np.unique(np.stack([text, window], 1), axis=0).tolist():
                pieces.setdefault(k, set()).update(table.owners[table.owned[w] : table.owned[w + 1]].tolist())
        hit = np.cumsum(change[:-1]) > 0
        for k, n in enumerate(size.tolist()):
            if k not in pieces:
                yield n, [], [], []
                continue
            edge = np.diff(hit[begin[k] : begin[k] + n].astype(np.int8), prepend=0, append=0)
            yield n, np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), sorted(set().union(*(self.items[p] for p in pieces[k])))


def pattern_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10, most: int = 1 << 20) -> Iterator[list[tuple[str, list[str]]]]:
    """All items in pieces that overlap by window - 1 words, as lists of about `most` words; one list at least."""
    spelled = F.regexp_extract_all(F.translate(F.col(text), UPPER, UPPER.lower()), F.lit(WORD), 0)
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), spelled.alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window), F.lit(PIECE))
    pieces = rows.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, PIECE + window - 1).alias("w")).distinct()
    pieces = written(pieces, "decontaminate-pieces")
    blocks = max(1, -(-(pieces.agg(F.sum(F.size("w"))).first()[0] or 0) // most))
    dealt = F.pmod(F.xxhash64("item", "w"), F.lit(blocks))
    for b in range(blocks):
        yield [(r["item"], r["w"]) for r in pieces.filter(dealt == b).collect()]  # a bounded part


def _scan(docs: DataFrame, text: str, kept: list[str], tables: Broadcast) -> DataFrame:
    """docs' columns kept, n_words, hits and item_ids for the windows of one block."""
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("n_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [found for block in text_blocks(batch.column(len(kept)).to_pylist()) for found in tables.value.search(block)]
            new = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(NEW.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=[*kept, *NEW])

    out = T.StructType([*docs.select(*kept).schema, *T._parse_datatype_string("n_words long, begins array<long>, stops array<long>, item_ids array<string>")])
    found = rows.mapInArrow(run, out)
    return found.select(*kept, "n_words", F.zip_with("begins", "stops", lambda b, e: F.struct(b.alias("begin"), e.alias("stop"))).alias("hits"), "item_ids")


def merged(hits: Column) -> Column:
    """Runs of words, those that touch or overlap as one."""

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["stop"], run["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (run["begin"] <= F.get(done, F.size(done) - 1)["stop"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.sort_array(hits), F.array().cast("array<struct<begin:bigint,stop:bigint>>"), add)


def occurrences(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_id: str = "item_id", window: int = 10, most: int = 1 << 20) -> DataFrame:
    """docs with n_words, hits (runs of words inside windows of items: begin, stop) and item_ids (items with a window in the text, sorted)."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in docs.columns if c not in ("n_words", "hits", "item_ids", "begins", "stops")]
    blocks = (spark.sparkContext.broadcast(Patterns(pieces, window)) for pieces in pattern_blocks(items, item_id, text, window, most))
    first = next(blocks)
    rest = list(blocks)
    if not rest:
        return _scan(docs, text, kept, first)
    by = ["_row_key", "_row_hash", "_row_hash2"]
    keyed = docs.withColumns({"_row_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "_row_hash": F.xxhash64(text), "_row_hash2": F.xxhash64(F.lit(1), text)})
    more = reduce(DataFrame.unionByName, [_scan(keyed, text, by, tables).filter(F.size("item_ids") > 0) for tables in rest])
    more = more.groupBy(*by).agg(F.flatten(F.collect_set("hits")).alias("_hits"), F.flatten(F.collect_set("item_ids")).alias("_ids"))  # a set for each block at most
    both = _scan(keyed, text, [*kept, *by], first).join(more, by, "left")
    hits = F.when(F.col("_hits").isNull(), F.col("hits")).otherwise(merged(F.concat("hits", "_hits")))
    ids = F.when(F.col("_ids").isNull(), F.col("item_ids")).otherwise(F.array_sort(F.array_distinct(F.concat("item_ids", "_ids"))))
    return both.select(*kept, "n_words", hits.alias("hits"), ids.alias("item_ids"))


def contamination(docs: DataFrame, items: DataFrame, most: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    rows = occurrences(docs.select("doc_id", "text"), items.select("item_id", "text"), most=most)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["stop"] - h["begin"])
    rows = rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


def contamination_sql() -> str:
    """The same in DuckDB SQL, by a join on all windows."""
    spelled = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}')"
    return rf"""WITH d AS (SELECT doc_id, {spelled} AS w FROM documents), b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {spelled} AS w FROM benchmark),
i AS (SELECT item, least(10, len(w)) AS k, w FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM i)),
x AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
o AS (SELECT DISTINCT doc_id, k, s, item FROM x JOIN p USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS place FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM o GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
