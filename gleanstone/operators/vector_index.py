"""Exact nearest vectors by cosine: a scan with matrix products, and cells around centres that let most of the table be skipped.

Vectors count by their direction, so distances are between unit vectors: d * d = 2 - 2 cos. Each row lies in the cell of its nearest centre and keeps its distance to it (gap); a cell has the largest gap as its radius.
A query at distance D from a centre is at least D - radius from all rows of the cell, and at least |D - gap| from a row. A query's nearest cells give a score that its answers must reach; every cell and row
whose bound is worse is passed over, so the answer is that of a full scan. Rows without a direction (all zeros) have the cosine 0 with everything and lie in a cell of their own that every query visits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import struct

#: The centres are fitted on the rows of the smallest hashes: so many for each cell, and so many in all.
SAMPLE, SAMPLE_MOST, CELLS_MOST = 32, 16_384, 1024
#: Rows that are scored at a time, pairs that a task holds before it drops all but the best, and what rounding may take from a bound.
ROWS, PAIRS, SLACK = 256, 200_000, 1e-6
FOUND = struct("query long, chunk_id string, score double")


def _units(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix of doubles."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != dim).any():
        raise ValueError(f"a vector has not {dim} numbers")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class _Best:
    """The best pairs of each query that a task has met."""

    def __init__(self, queries: int, limit: int, least: np.ndarray):
        self.limit, self.least = limit, least.copy()
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((query, score, ids))
        self.n += len(query)
        if self.n > PAIRS:
            self.held = [self.kept()]
            query, score, _ = self.held[0]
            self.n = 0  # what is kept is bounded by queries * limit
            edge = np.flatnonzero(np.bincount(query, minlength=len(self.least)) == self.limit)
            worst = np.full(len(self.least), np.inf)
            np.minimum.at(worst, query, score)
            self.least[edge] = np.maximum(self.least[edge], worst[edge])

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, score, ids = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = order[place < self.limit]
        return query[place < self.limit], score[top], ids[top]


def _scored(rows: DataFrame, asked: np.ndarray, limit: int, visits: list[np.ndarray] | None = None, least: np.ndarray | None = None, gaps: np.ndarray | None = None) -> DataFrame:
    """query (its number), chunk_id, score: each task's best rows (chunk_id, embedding, and with visits cell, gap) for each query.

    visits: the queries that visit each cell. least: the score that each must reach. gaps: of each query and cell, the distance to the centre.
    """
    spark = rows.sparkSession
    units = _units(asked)
    squares = (asked * asked).sum(1)
    floor = np.full(len(asked), -1.0) if least is None else least
    given = spark.sparkContext.broadcast((asked, units, squares, visits, floor, gaps))  # as many queries as a block has
    columns = ["chunk_id", "embedding", *(["cell", "gap"] if visits is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, units, squares, visits, floor, gaps = given.value
        best = _Best(len(asked), limit, floor)
        everyone = np.arange(len(asked))
        far = np.sqrt(np.maximum(0.0, 4 - 4 * floor)) + SLACK
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = _matrix(part.column(1), asked.shape[1])
                ids = np.array(part.column(0).to_pylist(), object)
                cells = part.column(2).to_numpy(zero_copy_only=False) if visits is not None else np.zeros(len(ids), np.int64)
                gap = part.column(3).to_numpy(zero_copy_only=False) if visits is not None else None
                for cell in np.unique(cells):
                    who = everyone if visits is None else visits[cell]
                    own = np.flatnonzero(cells == cell)
                    if gaps is not None and len(who):  # rows that no visitor can want
                        centre = gaps[who, cell]
                        own = own[(gap[own] >= (centre - far[who]).min()) & (gap[own] <= (centre + far[who]).max())]
                    if not len(who) or not len(own):
                        continue
                    near = (_units(vectors[own]) @ units[who].T + 1) / 2
                    r, q = np.nonzero(near >= best.least[who] - SLACK)
                    r, q = own[r], who[q]
                    norm = np.sqrt((vectors[r] * vectors[r]).sum(1) * squares[q])
                    dot = (vectors[r] * asked[q]).sum(1)  # the same for equal rows, wherever they lie
                    best.add(q, (1 + np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)) / 2, ids[r])
        if best.held:
            query, score, ids = best.kept()
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids.tolist(), pa.string()), pa.array(score)], names=FOUND.names)

    return rows.select(*columns).mapInArrow(run, FOUND)


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def _named(ranked: DataFrame, ids: list, kind: str) -> DataFrame:
    """query_id, chunk_id, rank, score."""
    names = ranked.sparkSession.createDataFrame(list(enumerate(ids)), f"query long, query_id {kind}")
    return ranked.join(F.broadcast(names), "query").select("query_id", "chunk_id", "rank", "score")  # as many as a block has


def blocks_of(queries: DataFrame, block: int) -> Iterator[tuple[list, np.ndarray]]:
    """The ids and vectors of queries (query_id, vector), about half a block at a time if there are more than one holds. Queries without a vector get no answer."""
    asked = queries.filter("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    n = asked.count()
    blocks = 1 if n <= block else -(-2 * n // block)
    dealt = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    for b in range(blocks):
        rows = asked.filter(dealt == b).collect()  # a block at most
        if rows:
            yield [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)


def nearest_by_scan(rows: DataFrame, queries: DataFrame, limit: int, block: int = 10_000) -> DataFrame:
    """query_id, chunk_id, rank, score of the `limit` nearest rows (chunk_id, embedding) of each query, by scoring all: one pass for each block of queries, in which a task keeps its best."""
    kind = dict(queries.dtypes)["query_id"]
    rows = rows.filter("embedding is not null")
    found = [_named(_ranked(_scored(rows, asked, limit), limit), ids, kind) for ids, asked in blocks_of(queries, block)]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], f"query_id {kind}, chunk_id string, rank int, score double")


@dataclass
class CellIndex:
    """rows (cell, chunk_id, embedding, gap), and of all cells centre, radius and number of rows."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray


def fitted_centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of a sample of unit vectors: each next seed is the row farthest from those before, then rounds of means."""
    sample = np.unique(sample, axis=0)
    seeds = [0]
    gap = np.full(len(sample), np.inf)
    while len(seeds) < min(cells, len(sample)):
        gap = np.minimum(gap, 2 - 2 * sample @ sample[seeds[-1]])
        seeds.append(int(np.argmax(gap)))
    centres = sample[seeds]
    for _ in range(rounds):
        own = np.argmin((centres * centres).sum(1) - 2 * sample @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def save_cells(chunks: DataFrame, folder: str, cells: int | None = None) -> None:
    """Index chunks (chunk_id, embedding) below a folder: rows in ranges of cells, so that a large cell is in many files, and a table of the cells.

    The number of cells is the root of the number of rows, up to CELLS_MOST. Centres are fitted on a bounded sample; every row is indexed.
    """
    rows = chunks.filter("embedding is not null").select("chunk_id", "embedding")
    n = rows.count()
    cells = cells or int(min(CELLS_MOST, max(1, round(n**0.5))))
    some = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(min(SAMPLE_MOST, SAMPLE * cells)).select(F.col("embedding").cast("array<double>")).collect()
    sample = _units(np.array([r[0] for r in some], np.float64)) if some else np.zeros((0, 1))
    sample = sample[(sample * sample).sum(1) > 0]
    centres = fitted_centres(sample, cells) if len(sample) else np.zeros((0, sample.shape[1]))
    given = rows.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = given.value
        squares = (centres * centres).sum(1)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):  # a batch by all centres would be large
                batch = whole.slice(at, ROWS)
                unit = _units(_matrix(batch.column(1), centres.shape[1]))
                there = (unit * unit).sum(1) > 0
                cell = np.argmin(squares - 2 * unit @ centres.T, axis=1) if len(centres) else np.zeros(len(unit), np.int64)
                gap = np.sqrt(((unit - centres[cell]) ** 2).sum(1)) if len(centres) else np.zeros(len(unit))
                cell, gap = np.where(there, cell, len(centres)), np.where(there, gap, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0), batch.column(1), pa.array(gap)], names=["cell", "chunk_id", "embedding", "gap"])

    placed = rows.mapInArrow(place, f"cell int, chunk_id string, embedding {dict(rows.dtypes)['embedding']}, gap double")
    placed.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "gap").write.mode("overwrite").parquet(f"{folder}/rows")
    held = rows.sparkSession.read.parquet(f"{folder}/rows").groupBy("cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("size"))
    table = rows.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)] + [(len(centres), None)], "cell int, centre array<double>")  # CELLS_MOST and one
    table.join(held, "cell").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")


def load_cells(spark: SparkSession, folder: str) -> CellIndex:
    cells = spark.read.parquet(f"{folder}/cells").collect()  # CELLS_MOST and one
    n, dim = max((r["cell"] for r in cells), default=-1) + 1, max((len(r["centre"] or []) for r in cells), default=0)
    centres, radius, size = np.zeros((n, dim)), np.full(n, -np.inf), np.zeros(n, np.int64)
    for r in cells:
        centres[r["cell"]] = r["centre"] or 0.0
        radius[r["cell"]] = np.inf if r["centre"] is None else r["radius"]
        size[r["cell"]] = r["size"]
    return CellIndex(spark.read.parquet(f"{folder}/rows"), centres, radius, size)


class CellSearch:
    """A block of queries against an index. allowed (chunk_id) restricts the rows before they are ranked, so a filtered search is exact, too."""

    def __init__(self, index: CellIndex, asked: np.ndarray, limit: int, allowed: DataFrame | None = None):
        self.index, self.asked, self.limit = index, asked, limit
        self.rows = index.rows if allowed is None else index.rows.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
        unit = _units(asked)
        centres = index.centres if index.centres.shape[1] else np.zeros((len(index.size), asked.shape[1]))
        squares = (unit * unit).sum(1)[:, None] - 2 * unit @ centres.T + (centres**2).sum(1)
        self.gaps = np.sqrt(np.maximum(0.0, squares))
        self.gaps[:, np.isinf(index.radius)] = 0.0

    def _run(self, visited: np.ndarray, least: np.ndarray) -> DataFrame:
        visits = [np.flatnonzero(visited[:, c]) for c in range(visited.shape[1])]
        wanted = [c for c, who in enumerate(visits) if len(who)]
        return _ranked(_scored(self.rows.filter(F.col("cell").isin(wanted)), self.asked, self.limit, visits, least, self.gaps), self.limit)

    def first(self) -> np.ndarray:
        """The nearest cells of each query (queries x cells) that hold twice as many rows as it wants."""
        order = np.argsort(self.gaps, axis=1)
        before = np.cumsum(self.index.size[order], axis=1) - self.index.size[order]
        out = np.zeros_like(self.gaps, bool)
        np.put_along_axis(out, order, before < 2 * self.limit, axis=1)
        return out

    def least(self) -> np.ndarray:
        """The score of rank `limit` in each query's first cells, -1 where they have fewer rows."""
        out = np.full(len(self.asked), -1.0)
        for r in self._run(self.first(), out).filter(F.col("rank") == self.limit).select("query", "score").collect():  # a row for each query
            out[r[0]] = r[1]
        return out

    def visited(self, least: np.ndarray) -> np.ndarray:
        """The cells (queries x cells) that can hold an answer."""
        far = np.sqrt(np.maximum(0.0, 4 - 4 * least)) + SLACK
        return (self.gaps - self.index.radius <= far[:, None]) & (self.index.size > 0)

    def result(self) -> DataFrame:
        least = self.least()
        return self._run(self.visited(least), least)


def nearest(index: CellIndex, queries: DataFrame, limit: int, allowed: DataFrame | None = None, block: int = 10_000) -> DataFrame:
    """query_id, chunk_id, rank, score of the `limit` nearest rows of each of queries (query_id, vector); equal scores go by chunk_id."""
    kind = dict(queries.dtypes)["query_id"]
    found = [_named(CellSearch(index, asked, limit, allowed).result(), ids, kind) for ids, asked in blocks_of(queries, block) if len(index.size)]
    return reduce(DataFrame.unionByName, found) if found else index.rows.sparkSession.createDataFrame([], f"query_id {kind}, chunk_id string, rank int, score double")
