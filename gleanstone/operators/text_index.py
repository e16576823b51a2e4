"""Text indexes that are kept: segments that follow a changing chunk table, and blocks with upper bounds for top-k search."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import BM25_B, BM25_K1, IDF_FLOOR, bm25
from ..functions.stemming import porter
from ..functions.text import _ACCENTED, _PLAIN, words
from ..schema import struct
from ..session import scratch, small_batches
from .search import TextIndex, stemmed

#: Rows of a batch that are looked at, and bytes of texts whose tokens are grouped, at a time.
ROWS, RUN_BYTES = 256, 1 << 23
#: Bytes of texts that a task of a segment indexes, about: as rows that are sorted, their postings are ten times as many.
TASK_BYTES = 1 << 24
#: Postings that go from Python to Spark at a time.
OUT_ROWS = 1 << 15
#: Characters that stay are named, too: those without an entry take several times as long.
_FOLD = {c: c for c in range(0x250)} | str.maketrans(_ACCENTED, _PLAIN)
#: ASCII in lower case, and spaces for what is neither letter nor digit.
_LOWER = {c: chr(c).lower() if chr(c).isalnum() else " " for c in range(128)}


def _spelled(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; folding makes no letter another kind of character, so it may come after."""
    text = text or ""
    return text.translate(_LOWER).split() if text.isascii() else re.findall(r"[^\W_]+", text.lower())


def tokens_of(text: str | None) -> list[str]:
    """Runs of letters and digits, folded: what functions.text.words gives, for whole tables several times as fast."""
    return [t if t.isascii() else t.translate(_FOLD) for t in _spelled(text)]


class _Grouped:
    """The tokens of some texts by term: names (of terms, ascending), and of each posting, by term and text, its term, text, number of uses and first place in positions."""

    def __init__(self, texts: list[str | None], stem: Callable[[str], str] | None):
        spelled = [_spelled(t) for t in texts]
        self.sizes = np.array([len(s) for s in spelled], np.int64)
        coded = pa.array(list(chain.from_iterable(spelled)), pa.string()).dictionary_encode()
        self.names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        other = pc.invert(pc.string_is_ascii(self.names))
        folded = pa.array([t.translate(_FOLD) for t in self.names.filter(other).to_pylist()], pa.string())
        if stem or len(folded):
            names = pc.replace_with_mask(self.names, other, folded)
            again = (pa.array([stem(t) for t in names.to_pylist()], pa.string()) if stem else names).dictionary_encode()
            self.names, code = again.dictionary, again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]
        ascending = pc.sort_indices(self.names)
        rank = np.empty(len(ascending), np.int64)
        rank[ascending.to_numpy()] = np.arange(len(ascending))
        self.names, code = self.names.take(ascending), rank[code]
        text = np.repeat(np.arange(len(spelled)), self.sizes)
        place = np.arange(len(text)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        key = code * max(1, len(spelled)) + text
        order = np.argsort(key, kind="stable")
        self.first = np.flatnonzero(np.diff(key[order], prepend=-1))
        self.term, self.text, self.positions = code[order[self.first]], text[order[self.first]], place[order]
        self.tf = np.diff(np.append(self.first, len(text)))


def _lists(edges: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches, in tables of about RUN_BYTES."""
    held, size = [], 0
    for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        held.append(part)
        size += part.nbytes
        if size >= RUN_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def posting_rows(chunks: DataFrame, stems: bool) -> DataFrame:
    """chunk_id, term, tf, positions: a row for each distinct term of each chunk (chunk_id, content), and one for the chunk itself, that has no term and all its tokens as tf.

    A chunk's tokens are together, so nothing is shuffled. Rows come in runs in the order of their terms, first those without.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = cache(porter) if stems else None
        for table in _runs(batches):
            ids, contents = (table.column(c).combine_chunks() for c in ("chunk_id", "content"))
            g, n = _Grouped(contents.to_pylist(), stem), len(ids)
            yield pa.RecordBatch.from_arrays([ids, pa.nulls(n, pa.string()), pa.array(g.sizes), pa.nulls(n, pa.list_(pa.int32()))], names=["chunk_id", "term", "tf", "positions"])
            places = _lists(np.append(g.first, len(g.positions)), pa.array(g.positions, pa.int32()))
            rows = pa.RecordBatch.from_arrays([ids.take(pa.array(g.text)), g.names.take(pa.array(g.term)).cast(pa.string()), pa.array(g.tf), places], names=["chunk_id", "term", "tf", "positions"])
            yield from (rows.slice(at, OUT_ROWS) for at in range(0, rows.num_rows, OUT_ROWS))

    return chunks.select("chunk_id", "content").mapInArrow(run, "chunk_id string, term string, tf long, positions array<int>")


SEGMENTS = {
    "postings": struct("term string, chunk_id string, tf long, positions array<int>, segment long"),
    "lengths": struct("chunk_id string, dl long, segment long"),
    "gone": struct("chunk_id string, dl long, of long, segment long"),
    "terms": struct("term string, df long, segment long"),
    "corpus": struct("docs long, total long, segment long"),
}


class TextSegments:
    """A text index below a folder, as segments: one for each change of the chunk table.

    A segment holds the postings (and a row without a term for each chunk, see posting_rows) and lengths of the chunks that came with it, marks of the older rows that they replace or that were removed (gone: chunk and segment), and by how much it changed each term's
    document frequency, the number of chunks and their total length. So an upsert writes in proportion to what it brings, and nothing is written anew until merged_to().
    Every table is partitioned by segment. A segment counts once its row of `corpus` is there, which is written last; a segment that is written again replaces itself, and sees only those before it.
    """

    def __init__(self, spark: SparkSession, folder: str, stems: bool = True):
        self.spark, self.folder, self.stems = spark, folder.rstrip("/"), stems

    def table(self, name: str) -> DataFrame:
        """All rows of a table, those of unfinished segments too."""
        try:
            return self.spark.read.schema(SEGMENTS[name]).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SEGMENTS[name])

    def numbers(self) -> list[int]:
        """The finished segments, a row for each change."""
        return sorted(r[0] for r in self.table("corpus").select("segment").distinct().collect())

    def _write(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        columns = [f.name for f in SEGMENTS[name] if f.name != "segment"]
        with small_batches(rows.sparkSession):  # a stream's batch has a session of its own
            out = rows.select(*[F.col(c).cast(SEGMENTS[name][c].dataType).alias(c) for c in columns], F.lit(number).cast("long").alias("segment"))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(f"{self.folder}/{name}")
        return self.table(name).filter(F.col("segment") == number)

    def _alive(self, name: str, numbers: list[int]) -> DataFrame:
        gone = self.table("gone").filter(F.col("segment").isin(numbers)).select(F.col("chunk_id").alias("_id"), "of")
        rows = self.table(name).filter(F.col("segment").isin(numbers))
        rows = rows.filter("term is not null") if name == "postings" else rows
        return rows.join(gone, (F.col("chunk_id") == F.col("_id")) & (F.col("segment") == F.col("of")), "left_anti")

    def index(self, numbers: list[int] | None = None) -> TextIndex:
        """The index as it stands, or stood after the segments named."""
        numbers = self.numbers() if numbers is None else numbers
        own = F.col("segment").isin(numbers)
        terms = self.table("terms").filter(own).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        corpus = self.table("corpus").filter(own).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), (F.sum("total") / F.nullif(F.sum("docs"), F.lit(0))).alias("mean"))
        return TextIndex(self._alive("postings", numbers).drop("segment"), self._alive("lengths", numbers).drop("segment"), terms, corpus, self.stems)

    def put(self, changed: DataFrame, removed: DataFrame | None = None, number: int | None = None) -> int:
        """Add or replace the chunks of changed (chunk_id, content; one row for each), take away those of removed (chunk_id), as segment `number` (the next, if none is given)."""
        before = [n for n in self.numbers() if number is None or n < number]
        number = max(before, default=-1) + 1 if number is None else number
        # Texts are split once, here; what follows comes from what was written. A file has its own terms in order, so a term of many chunks is in many files and not in one task.
        size = changed.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
        dealt = changed.repartition(1 + size // TASK_BYTES, "chunk_id")
        rows = self._write(posting_rows(dealt, self.stems).sortWithinPartitions("term"), "postings", number)
        postings = rows.filter("term is not null")
        lengths = self._write(rows.filter("term is null").select("chunk_id", F.col("tf").alias("dl")), "lengths", number)
        ids = lengths.select("chunk_id")
        ids = (ids.unionByName(removed.select("chunk_id")) if removed is not None else ids).distinct()
        gone = self._write(self._alive("lengths", before).join(ids, "chunk_id", "left_semi").withColumn("of", F.col("segment")), "gone", number)
        old = self._alive("postings", before).join(gone.select("chunk_id"), "chunk_id", "left_semi")
        delta = postings.select("term", F.lit(1).alias("k")).unionByName(old.select("term", F.lit(-1).alias("k")))
        self._write(delta.groupBy("term").agg(F.sum("k").alias("df")).filter("df <> 0"), "terms", number)
        both = lengths.select("dl", F.lit(1).alias("k")).unionByName(gone.select("dl", F.lit(-1).alias("k")))
        self._write(both.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.col("k") * F.col("dl")), F.lit(0)).alias("total")), "corpus", number)
        return number

    def merged_to(self, folder: str) -> TextSegments:
        """All that is alive, as one segment of an index below another folder."""
        out, now = TextSegments(self.spark, folder, self.stems), self.index()
        out._write(now.lengths, "lengths", 0)
        out._write(now.postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term"), "postings", 0)
        out._write(self.table("gone").limit(0), "gone", 0)
        out._write(now.terms, "terms", 0)
        out._write(now.lengths.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")), "corpus", 0)
        return out


#: Chunks of a slice and its bytes, about; folders of an index by hash of terms; slices of a query that are scored first, for a score that others must reach.
SLICE, SLICE_BYTES, BUCKETS, FIRST = 2048, 1 << 23, 16, 4
#: Pairs of a question and a chunk that are scored at a time.
PAIRS = 1 << 20

BLOCKS = struct("term string, slice long, held long, most_tf long, least_dl long, docs binary, tfs binary, positions binary, ids array<string>, dls array<int>, bucket int")


@dataclass
class BlockIndex:
    """blocks (term, slice, held, most_tf, least_dl, and of the `held` chunks their numbers in the slice, uses and positions, each as packed numbers), chunks (slice, and of all its chunks ids and dls, by number), corpus (docs, mean); blocks are
    partitioned by bucket.

    A slice holds about SLICE chunks of nearly one length, so the most frequent use of a term and the least length in a block bound the scores of its chunks closely.
    """

    blocks: DataFrame
    chunks: DataFrame
    corpus: DataFrame
    stems: bool


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int")


def _sliced(chunks: DataFrame) -> DataFrame:
    """chunk_id, content, slice: chunks of a quarter of an octave of bytes are dealt by hash to so many slices that one has about SLICE chunks or SLICE_BYTES bytes."""
    rows = chunks.filter("chunk_id is not null").select("chunk_id", "content", F.floor(F.log2(F.coalesce(F.octet_length("content"), F.lit(0)) + 1) * 4).alias("_octave"))
    most = F.greatest(F.count(F.lit(1)) / SLICE, F.sum(F.octet_length("content")) / SLICE_BYTES)
    found = rows.groupBy("_octave").agg(F.ceil(most).alias("_slices")).collect()  # 128 rows at most
    sizes = F.broadcast(rows.sparkSession.createDataFrame(found, "_octave long, _slices long"))
    return rows.join(sizes, "_octave").select("chunk_id", "content", (F.col("_octave") * F.lit(1 << 40) + F.pmod(F.xxhash64("chunk_id"), "_slices")).alias("slice"))


def _packed(numbers: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Numbers between edges as bytes, in the least width that holds all of a slice: so the width follows from the length."""
    width = next(w for w in (1, 2, 4) if not len(numbers) or numbers.max() < 1 << 8 * w)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype("<i4")), pa.py_buffer(numbers.astype(f"<u{width}"))])


def _numbers(packed: Sequence[bytes], count: int) -> np.ndarray:
    data = b"".join(packed)
    return np.frombuffer(data, f"<u{len(data) // count}").astype(np.int64) if count else np.empty(0, np.int64)


def _slice_blocks(stems: bool) -> Callable[[pa.Table], pa.Table]:
    """A slice's chunks (chunk_id, content, slice) as rows of BLOCKS, with one of bucket -1 that has the chunks. Chunks are numbered in the order of their ids."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_id")
        g = _Grouped(table.column("content").to_pylist(), cache(porter) if stems else None)
        begin = np.flatnonzero(np.diff(g.term, prepend=-1))  # the first posting of each term
        names = g.names.take(pa.array(g.term[begin])).cast(pa.string())
        edges = np.append(begin, len(g.term))
        most, least = (f.reduceat(x, begin) if len(begin) else begin for f, x in ((np.maximum, g.tf), (np.minimum, g.sizes[g.text])))
        bucket = np.array([zlib.crc32(t.encode()) % BUCKETS for t in names.to_pylist()], np.int32)
        n, number = len(names), table.column("slice")[0].as_py()
        packed = [_packed(g.text, edges), _packed(g.tf, edges), _packed(g.positions, np.append(g.first, len(g.positions))[edges])]
        blocks = [names, pa.array(np.full(n, number)), pa.array(np.diff(edges)), pa.array(most), pa.array(least), *packed, pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int32())), pa.array(bucket)]
        kinds = [c.type for c in blocks]
        own = [None, number, table.num_rows, 0, 0, None, None, None, table.column("chunk_id").to_pylist(), g.sizes, -1]
        return pa.table([pa.chunked_array([c, pa.array([x], kind)]) for c, x, kind in zip(blocks, own, kinds)], names=BLOCKS.names)

    return build


#: Packed numbers are hardly ever equal, so no dictionary is tried for them.
_PACKED = {"compression": "zstd", **{f"parquet.enable.dictionary#{c}": "false" for c in ("docs", "positions")}}


def save_blocks(chunks: DataFrame, folder: str, stems: bool = True) -> None:
    """Index chunks (chunk_id, content) in blocks below a folder, those of a term in the folder of its bucket and in order within a file, so that a query reads only the row groups of its terms.

    Texts are shuffled once, to their slices; a task writes the blocks of its slices.
    """
    with small_batches(chunks.sparkSession, 16):
        blocks = _sliced(chunks).groupBy("slice").applyInArrow(_slice_blocks(stems), BLOCKS)
        blocks.sortWithinPartitions("bucket", "term", "slice").write.mode("overwrite").options(**_PACKED).partitionBy("bucket").parquet(f"{folder}/blocks")
    written = chunks.sparkSession.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    lengths = F.aggregate("dls", F.lit(0).cast("long"), lambda s, x: s + x)
    corpus = written.filter("bucket < 0").agg(F.coalesce(F.sum("held"), F.lit(0)).alias("docs"), (F.sum(lengths) / F.sum("held")).alias("mean"))
    corpus.write.mode("overwrite").parquet(f"{folder}/corpus")


def load_blocks(spark: SparkSession, folder: str, stems: bool = True) -> BlockIndex:
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    return BlockIndex(blocks.filter("bucket >= 0"), blocks.filter("bucket < 0").select("slice", "ids", "dls"), spark.read.schema("docs long, mean double").parquet(f"{folder}/corpus"), stems)


def query_terms(queries: DataFrame, stems: bool) -> DataFrame:
    """query_id, phrase, at, term, n, phrases of queries (query_id, query): the tokens of each word between white space are a phrase of n; words without letters or digits, and quotes, match anything."""
    spaced = F.split(F.col("query"), r"(?U)\s+")
    tokens = F.filter(F.transform(spaced, lambda w: words(F.replace(w, F.lit('"'), F.lit("")))), lambda t: F.size(t) > 0)
    phrase = queries.select("query_id", tokens.alias("t")).select("query_id", F.size("t").alias("phrases"), F.posexplode("t").alias("phrase", "p"))
    rows = phrase.select("query_id", "phrases", "phrase", F.size("p").alias("n"), F.posexplode("p").alias("at", "term"))
    if stems:
        rows = rows.join(stemmed(rows), "term").withColumn("term", F.col("stem")).drop("stem")
    return rows.select("query_id", "phrase", "at", "term", "n", "phrases")


@dataclass
class _Found:
    """The phrases of a slice, ascending, and of each, between its edges, the chunks (ascending) and how often each has it."""

    phrase: np.ndarray
    edges: np.ndarray
    docs: np.ndarray
    tfs: np.ndarray


class _Phrases:
    """Phrases, by number: single words, and a tree of those with more tokens, so that all are found in one walk over a slice's tokens."""

    def __init__(self, phrases: Sequence[tuple[str, ...]]):
        self.code = {t: k for k, t in enumerate(sorted({t for p in phrases for t in p}))}
        self.single, self.first = (np.full(len(self.code) + 1, -1, np.int64) for _ in range(2))  # the last place is that of no token, -1
        number = {p: k for k, p in enumerate(phrases)}
        for p, k in number.items():
            if len(p) == 1:
                self.single[self.code[p[0]]] = k
        multi = [p for p in phrases if len(p) > 1]
        state = {p: k for k, p in enumerate(sorted({p[:1] for p in multi}))}
        for p, k in state.items():
            self.first[self.code[p[0]]] = k
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []  # after each further token: state before and token as one number, ascending, and the phrase that ends there or -1
        for n in range(2, max(map(len, multi), default=1) + 1):
            key = {p: state[p[:-1]] * len(self.code) + self.code[p[-1]] for p in {p[:n] for p in multi if len(p) >= n}}
            state = {p: k for k, p in enumerate(sorted(key, key=key.__getitem__))}
            self.steps.append((np.array([key[p] for p in state], np.int64), np.array([number.get(p, -1) for p in state], np.int64)))

    def found(self, blocks: pa.Table, lengths: np.ndarray) -> _Found:
        """blocks: term, docs, tfs, held, and positions where a phrase of several tokens has the term."""
        code = np.array([self.code[t] for t in blocks.column("term").to_pylist()], np.int64)
        held = blocks.column("held").to_numpy()
        docs, tfs = (_numbers(blocks.column(c).to_pylist(), held.sum()) for c in ("docs", "tfs"))
        word = np.repeat(self.single[code], held)
        phrase, doc, tf = [word[word >= 0]], [docs[word >= 0]], [tfs[word >= 0]]
        if self.steps:
            packed = blocks.column("positions").to_pylist()
            placed = np.repeat(np.array([p is not None for p in packed], bool), held)
            uses = tfs[placed]
            at = _numbers([p for p in packed if p is not None], uses.sum())
            begin = np.cumsum(lengths + 1) - lengths - 1
            tokens = np.full(begin[-1] + lengths[-1] + 1 + len(self.steps), -1, np.int64) if len(lengths) else np.empty(0, np.int64)
            tokens[np.repeat(begin[docs[placed]], uses) + at] = np.repeat(np.repeat(code, held)[placed], uses)
            at = np.flatnonzero(self.first[tokens] >= 0)
            state = self.first[tokens[at]]
            ends, starts = [], []
            for k, (keys, end) in enumerate(self.steps, 1):
                at, state = at[tokens[at + k] >= 0], state[tokens[at + k] >= 0]
                key = state * len(self.code) + tokens[at + k]
                state = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                at, state = at[keys[state] == key], state[keys[state] == key]
                ends.append(end[state][end[state] >= 0])
                starts.append(at[end[state] >= 0])
            where = np.searchsorted(begin, np.concatenate(starts), side="right") - 1
            pairs, uses = np.unique(np.concatenate(ends) * len(lengths) + where, return_counts=True)
            phrase, doc, tf = [*phrase, pairs // max(1, len(lengths))], [*doc, pairs % max(1, len(lengths))], [*tf, uses]
        number, doc, tf = (np.concatenate(x) for x in (phrase, doc, tf))
        order = np.argsort(number, kind="stable")
        begin = np.flatnonzero(np.diff(number[order], prepend=-1))
        return _Found(number[order][begin], np.append(begin, len(number)), doc[order], tf[order])


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... : `count` numbers for each."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


class _Questions:
    """Questions, by number: each the numbers of its phrases, which must all be in a chunk."""

    def __init__(self, asked: Sequence[Sequence[int]], weights: np.ndarray, mean: float, limit: int | None):
        self.n = np.array([len(a) for a in asked], np.int64)
        self.begin = np.cumsum(self.n) - self.n
        self.numbers = np.array([k for a in asked for k in a], np.int64)
        self.weights, self.mean, self.limit = weights, mean, limit

    def best(self, found: _Found, lengths: np.ndarray, who: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the questions `who`: question, chunk and score of the `limit` best, equal scores in the order of ids, or of all. least: the score that each must reach."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if not len(found.phrase) or not len(who):
            return none
        part = found.tfs * (BM25_K1 + 1) / (found.tfs + BM25_K1 * (1 - BM25_B + BM25_B * lengths[found.docs] / self.mean))
        floor = np.full(len(who), -np.inf) if least is None else least[who] - 1e-8
        n = self.n[who]
        numbers = self.numbers[_ranges(self.begin[who], n)]
        place = np.minimum(np.searchsorted(found.phrase, numbers), len(found.phrase) - 1)
        begin = np.cumsum(n) - n
        bound = np.add.reduceat(self.weights[numbers] * np.maximum.reduceat(part, found.edges[:-1])[place], begin)
        live = np.flatnonzero(np.logical_and.reduceat(found.phrase[place] == numbers, begin) & (bound >= floor))
        if not len(live):
            return none
        flat = _ranges(begin[live], n[live])
        place, weight, who, floor, n = place[flat], self.weights[numbers[flat]], who[live], floor[live], n[live]
        begin = np.cumsum(n) - n
        held = np.diff(found.edges)
        rare = np.flatnonzero(held[place] == np.repeat(np.minimum.reduceat(held[place], begin), n))
        lead = place[rare[np.unique(np.repeat(np.arange(len(n)), n)[rare], return_index=True)[1]]]  # of each question a phrase in the fewest chunks
        size = len(lengths)
        keys = np.repeat(np.arange(len(held)), held) * size + found.docs
        out = []
        group = np.cumsum(held[lead]) // PAIRS
        for some in np.split(np.arange(len(who)), np.flatnonzero(np.diff(group)) + 1):
            q = np.repeat(some, held[lead[some]])
            doc = found.docs[_ranges(found.edges[lead[some]], held[lead[some]])]
            score = np.zeros(len(q))
            for j in range(n[some].max()):
                has = n[q] > j
                nth = begin[q[has]] + j
                key = place[nth] * size + doc[has]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                score[has] += weight[nth] * part[at]
                there = np.ones(len(q), bool)
                there[has] = keys[at] == key
                q, doc, score = q[there], doc[there], score[there]
            high = score >= floor[q]
            q, doc, score = q[high], doc[high], score[high]
            order = np.lexsort((doc, -np.round(score, 9), q))
            q, doc, score = q[order], doc[order], score[order]
            if self.limit is not None:
                top = np.arange(len(q)) - np.searchsorted(q, q) < self.limit
                q, doc, score = q[top], doc[top], score[top]
            out.append((who[q], doc, score))
        return tuple(np.concatenate(x) for x in zip(*out))


def _parted(table: pa.Table) -> tuple[pa.Table, pa.Array, np.ndarray]:
    """A slice's blocks, and its chunks' ids and lengths by number."""
    named = table.column("term").is_valid()
    own = table.filter(pc.invert(named))
    if not own.num_rows:
        return table.slice(0, 0), pa.array([], pa.string()), np.empty(0, np.int64)
    return table.filter(named), own.column("ids")[0].values, own.column("dls")[0].values.to_numpy().astype(np.int64)


class BlockSearch:
    """The steps of a search for a block of queries. All phrases of a query must occur in a chunk, a phrase's tokens side by side.

    parts: of each phrase and slice the number of chunks, the most uses and the least length; of single words from the names of blocks, without their postings. bounds: for each query the slices that hold all its
    phrases, with the most a chunk in them can score. least: the FIRST best of these are scored, and the score of rank `limit` is what a chunk elsewhere must reach. open: the slices whose bound reaches it. The others are
    never scored, and the result is that of scoring all. A slice is scored in one task for all queries that are open in it, and gives each query's best.

    What the driver holds is bounded by the queries: their terms with document frequencies, and a score for each.
    """

    def __init__(self, index: BlockIndex, queries: DataFrame, limit: int, allowed: DataFrame | None = None):
        self.index, self.limit, self.allowed, self.spark = index, limit, allowed, index.blocks.sparkSession
        rows = query_terms(queries.select("query_id", "query"), index.stems).select("*", _bucket(F.col("term")).alias("bucket")).collect()
        spelled: dict = {}
        for r in rows:
            spelled.setdefault(r["query_id"], {}).setdefault(r["phrase"], {})[r["at"]] = r["term"]
        number: dict[tuple[str, ...], int] = {}
        self.ids = list(spelled)
        self.asked = [[number.setdefault(tuple(t for _, t in sorted(p.items())), len(number)) for _, p in sorted(phrases.items())] for phrases in spelled.values()]
        self.phrases = list(number)
        self.multi = any(len(p) > 1 for p in self.phrases)
        self.kind = dict(queries.dtypes)["query_id"]
        listed = F.col("bucket").isin(sorted({r["bucket"] for r in rows})) & F.col("term").isin(sorted({r["term"] for r in rows})) if rows else F.lit(False)
        self.blocks = index.blocks.filter(listed)
        self.docs, self.mean = index.corpus.first() or (0, None)
        df = {r["term"]: r["df"] for r in self.blocks.groupBy("term").agg(F.sum("held").alias("df")).collect()}
        if self.multi:
            self.found = self._found()
            together = {r["phrase"]: r["df"] for r in self.found.groupBy("phrase").agg(F.sum("held").alias("df")).collect()}
        self.weights = [self._weight(df.get(p[0], 0) if len(p) == 1 else together.get(k, 0)) for k, p in enumerate(self.phrases)]

    def _weight(self, df: int) -> float:
        """The idf, as functions.scoring.idf gives it."""
        raw = math.log((self.docs - df + 0.5) / (df + 0.5)) if df else 0.0
        return raw if raw > 0 else IDF_FLOOR

    def _tables(self, wanted: DataFrame | None = None) -> DataFrame:
        """The blocks of the terms, and for each slice a row with its chunks."""
        rows = self.blocks.select("slice", "term", "held", "docs", "tfs", *(["positions"] if self.multi else []))
        rows = rows.unionByName(self.index.chunks, allowMissingColumns=True)
        return rows.join(wanted.select("slice").distinct(), "slice", "left_semi") if wanted is not None else rows

    def _found(self) -> DataFrame:
        """phrase, slice, held, tf (most), dl (least) of the phrases of several tokens, from their positions; written, as their document frequencies come from it, too."""
        multi = _Phrases([p if len(p) > 1 else () for p in self.phrases])
        terms = list(multi.code)

        def count(table: pa.Table) -> pa.Table:
            blocks, _, lengths = _parted(table)
            found = multi.found(blocks, lengths)
            begin = found.edges[:-1]
            most, least = (f.reduceat(x, begin) if len(begin) else begin for f, x in ((np.maximum, found.tfs), (np.minimum, lengths[found.docs])))
            return pa.table([pa.array(c, pa.int64()) for c in (found.phrase, np.full(len(begin), table.column("slice")[0].as_py()), np.diff(found.edges), most, least)], names=["phrase", "slice", "held", "tf", "dl"])

        path = scratch(self.spark, "phrases")
        self._tables().filter(F.col("term").isNull() | F.col("term").isin(terms)).groupBy("slice").applyInArrow(count, "phrase long, slice long, held long, tf long, dl long").write.parquet(path)
        return self.spark.read.schema("phrase long, slice long, held long, tf long, dl long").parquet(path)

    def bounds(self) -> DataFrame:
        """query (its number), slice, bound."""
        asked = [(q, k, self.weights[k], len(numbers)) for q, numbers in enumerate(self.asked) for k in numbers]
        asked = F.broadcast(self.spark.createDataFrame(asked, "query long, phrase long, weight double, m long"))  # as many as the queries have words
        names = F.broadcast(self.spark.createDataFrame([(p[0], k) for k, p in enumerate(self.phrases) if len(p) == 1], "term string, phrase long"))
        parts = self.blocks.select("term", "slice", F.col("most_tf").alias("tf"), F.col("least_dl").alias("dl")).join(names, "term").select("phrase", "slice", "tf", "dl")
        if self.multi:
            parts = parts.unionByName(self.found.select("phrase", "slice", "tf", "dl"))
        part = bm25(F.col("tf"), F.col("dl"), F.lit(self.mean).cast("double"), F.col("weight"))
        return parts.join(asked, "phrase").groupBy("query", "slice", "m").agg(F.sum(part).alias("bound"), F.count(F.lit(1)).alias("n")).filter("n = m").select("query", "slice", "bound")

    def scored(self, slices: DataFrame) -> DataFrame:
        """query, chunk_id, score of slices (query, slice): each slice's best chunks, or all that match and are allowed."""
        phrases = _Phrases(self.phrases)
        questions = _Questions(self.asked, np.array(self.weights), self.mean, self.limit if self.allowed is None else None)

        def score(table: pa.Table, wanted: pa.Table) -> pa.Table:
            blocks, ids, lengths = _parted(table)
            query, doc, scores = questions.best(phrases.found(blocks, lengths), lengths, np.sort(wanted.column("queries")[0].values.to_numpy()) if wanted.num_rows else np.empty(0, np.int64))
            return pa.table([pa.array(query, pa.int64()), ids.take(pa.array(doc)), pa.array(scores)], names=["query", "chunk_id", "score"])

        wanted = slices.groupBy("slice").agg(F.collect_set("query").alias("queries")).select(F.col("slice").alias("at"), "queries")  # a block of queries at most
        out = self._tables(slices).groupBy("slice").cogroup(wanted.groupBy("at")).applyInArrow(score, "query long, chunk_id string, score double")
        return out if self.allowed is None else out.join(self.allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def best(self, scored: DataFrame) -> DataFrame:
        return ranked(scored, self.limit)

    def least(self, bounds: DataFrame) -> DataFrame:
        """query, least: the score of rank `limit` among the first slices, for queries that have so many hits there."""
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "slice")
        first = bounds.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= FIRST).select("query", "slice")
        begun = self.best(self.scored(first)).groupBy("query").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("least"))
        return begun.filter(F.col("_n") >= self.limit).select("query", "least")

    def open(self, bounds: DataFrame, least: DataFrame) -> DataFrame:
        """query, slice: what can hold one of the best."""
        held = bounds.join(F.broadcast(least), "query", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-8))
        return held.select("query", "slice")

    def result(self) -> DataFrame:
        """query_id, chunk_id, rank, score."""
        if not self.ids or not self.docs:
            return self.spark.createDataFrame([], f"query_id {self.kind}, chunk_id string, rank int, score double")
        bounds = self.bounds()
        begun = self.least(bounds)
        least = self.spark.createDataFrame(begun.collect(), begun.schema)  # a row for each query of a block
        names = self.spark.createDataFrame(list(enumerate(self.ids)), f"query long, query_id {self.kind}")
        return self.best(self.scored(self.open(bounds, least))).join(F.broadcast(names), "query").select("query_id", "chunk_id", "rank", "score")


#: More questions than these are asked in one walk over all slices; so many of them at a time, at most. Of how many slices one gives the first scores that others must reach.
FEW, TOGETHER, SOME = 64, 250_000, 16
PARTS = struct("slice long, phrases array<long>, held array<long>, docs array<int>, tfs array<int>, ids array<string>, dls array<int>")
PARTS_ARROW = [pa.int64(), *(pa.list_(kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32()))]


class ManySearch:
    """The same search for many questions (asked: their texts, with blanks between tokens and lines between phrases), each slice met for all of them at once.

    parts: of each slice what is needed for the questions: the chunks and uses of their phrases; written, so blocks are shuffled once. least: the scores of rank `limit` among one of SOME slices, which a chunk elsewhere must
    reach. A slice gives the best of each question whose bound there reaches it, so what is ranked at the end grows with the questions, not with their matches; and the result is that of scoring all.
    """

    def __init__(self, index: BlockIndex, asked: list[str], limit: int):
        self.index, self.limit, self.spark = index, limit, index.blocks.sparkSession
        number: dict[tuple[str, ...], int] = {}
        self.asked = [[number.setdefault(tuple(p.split(" ")), len(number)) for p in a.split("\n")] for a in asked]
        self.phrases = list(number)

    def parts(self) -> DataFrame:
        placed = {t for p in self.phrases if len(p) > 1 for t in p}
        terms = self.spark.createDataFrame([(t, t in placed) for t in sorted({t for p in self.phrases for t in p})], "term string, placed boolean")
        blocks = self.index.blocks.join(F.broadcast(terms), "term")  # as many as the questions have words
        rows = blocks.select("slice", "term", "held", "docs", "tfs", F.when(F.col("placed"), F.col("positions")).alias("positions")).unionByName(self.index.chunks, allowMissingColumns=True)
        given = self.spark.sparkContext.broadcast(_Phrases(self.phrases))

        def find(table: pa.Table) -> pa.Table:
            blocks, ids, lengths = _parted(table)
            f = given.value.found(blocks, lengths)
            return pa.table([pa.array([c], kind) for c, kind in zip((table.column("slice")[0].as_py(), f.phrase, np.diff(f.edges), f.docs, f.tfs, ids.to_pylist(), lengths), PARTS_ARROW)], names=PARTS.names)

        path = scratch(self.spark, "parts")
        rows.groupBy("slice").applyInArrow(find, PARTS).write.parquet(path)
        return self.spark.read.schema(PARTS).parquet(path)

    def _questions(self, parts: DataFrame, docs: int, mean: float) -> _Questions:
        held = parts.select(F.explode(F.arrays_zip("phrases", "held")).alias("_p")).groupBy("_p.phrases").agg(F.sum("_p.held").alias("df")).collect()
        df = np.zeros(len(self.phrases))
        for r in held:  # as many as the questions have phrases
            df[r[0]] = r[1]
        raw = np.log((docs - df + 0.5) / (df + 0.5))
        return _Questions(self.asked, np.where((raw > 0) & (df > 0), raw, IDF_FLOOR), mean, self.limit)

    def result(self) -> DataFrame:
        """query (its number), chunk_id, rank, score."""
        shape = "query long, chunk_id string, score double"
        docs, mean = self.index.corpus.first() or (0, None)
        if not self.asked or not docs or not mean:
            return self.spark.createDataFrame([], "query long, chunk_id string, rank int, score double")
        parts = self.parts()
        given = self.spark.sparkContext.broadcast(self._questions(parts, docs, mean))

        def scored(least) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                questions = given.value
                everyone = np.arange(len(questions.n))
                for batch in batches:
                    for k in range(batch.num_rows):
                        phrase, held, docs, tfs, lengths = (batch.column(c)[k].values.to_numpy().astype(np.int64) for c in ("phrases", "held", "docs", "tfs", "dls"))
                        found = _Found(phrase, np.append(0, np.cumsum(held)), docs, tfs)
                        query, doc, score = questions.best(found, lengths, everyone, least.value if least else None)
                        yield pa.RecordBatch.from_arrays([pa.array(query), batch.column("ids")[k].values.take(pa.array(doc)), pa.array(score)], names=["query", "chunk_id", "score"])

            return run

        with small_batches(self.spark, 4):
            n = parts.count()
            least = np.full(len(self.asked), -np.inf)
            if n >= 2 * SOME:
                first = parts.filter(F.pmod(F.xxhash64("slice"), F.lit(SOME)) == 0).mapInArrow(scored(None), shape)
                order = Window.partitionBy("query").orderBy(F.desc("score"))
                for r in first.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == self.limit).select("query", "score").collect():  # a row for each question
                    least[r[0]] = r[1]
            found = parts.mapInArrow(scored(self.spark.sparkContext.broadcast(least)), shape)
            path = scratch(self.spark, "best")
            ranked(found, self.limit).write.parquet(path)
        return self.spark.read.schema("query long, chunk_id string, rank int, score double").parquet(path)


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """query, chunk_id, rank, score."""
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "chunk_id")  # sums of equal parts may differ in the last bits
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query", "chunk_id", "rank", "score")


def many_search(index: BlockIndex, queries: DataFrame, limit: int) -> DataFrame:
    """query_id, chunk_id, rank, score of many queries (query_id, query): those that come to the same phrases are asked once."""
    spark, kind = index.blocks.sparkSession, dict(queries.dtypes)["query_id"]
    phrase = query_terms(queries, index.stems).groupBy("query_id", "phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda t: t["term"]), " ").alias("p"))
    spelled = phrase.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("phrase", "p"))), lambda p: p["p"]), "\n").alias("asked"))
    path = scratch(spark, "asked")
    spelled.write.parquet(path)
    spelled = spark.read.schema(f"query_id {kind}, asked string").parquet(path)
    distinct = spelled.select("asked").distinct()
    blocks = -(-distinct.count() // TOGETHER)
    found = []
    for b in range(blocks):
        asked = sorted(r[0] for r in distinct.filter(F.pmod(F.xxhash64("asked"), F.lit(blocks)) == b).collect())  # about TOGETHER
        names = F.broadcast(spark.createDataFrame(list(enumerate(asked)), "query long, asked string"))
        found.append(ManySearch(index, asked, limit).result().join(names, "query"))
    if not found:
        return spark.createDataFrame([], f"query_id {kind}, chunk_id string, rank int, score double")
    return reduce(DataFrame.unionByName, found).join(spelled, "asked").select("query_id", "chunk_id", "rank", "score")


def block_search(index: BlockIndex, queries: DataFrame | Sequence[tuple[int, str]], limit: int, allowed: DataFrame | None = None, block: int = 10_000) -> DataFrame:
    """query_id, chunk_id, rank, score of each query's best chunks by BM25, as text_search gives them. allowed (chunk_id) restricts the result; statistics stay those of the whole table.

    More than FEW queries over the whole table are asked in one walk over it; of others more than `block` are dealt by their ids to blocks of about half that many.
    """
    if not isinstance(queries, DataFrame):
        queries = index.blocks.sparkSession.createDataFrame(list(queries), "query_id long, query string")
    elif not queries.isEmpty():
        path = scratch(index.blocks.sparkSession, "queries")
        queries.select("query_id", "query").write.parquet(path)
        queries = index.blocks.sparkSession.read.schema(queries.select("query_id", "query").schema).parquet(path)
    n = queries.count()
    if n > FEW and allowed is None:
        return many_search(index, queries, limit)
    blocks = -(-2 * n // block) if n > block else 1
    dealt = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [BlockSearch(index, queries.filter(dealt == b) if blocks > 1 else queries, limit, allowed).result() for b in range(blocks)])
