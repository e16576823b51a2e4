"""Nearest vectors through cells against a full scan."""

import numpy as np
import pytest

from gleanstone.operators import search, vector_index
from gleanstone.operators.vector_index import CellSearch


def table(spark, vectors, name="v"):
    return spark.createDataFrame([(f"{name}{i}", [float(x) for x in v]) for i, v in enumerate(vectors)], "chunk_id string, embedding array<float>").repartition(4)


def asked(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id long, vector array<float>")


def brute(vectors, queries, limit, ids=None):
    rows, out = np.array(vectors, np.float32).astype(float), set()
    ids = ids or [f"v{i}" for i in range(len(rows))]
    for q, v in enumerate(np.array(queries, np.float32).astype(float)):
        norm = np.sqrt((rows * rows).sum(1) * (v * v).sum())
        score = (1 + np.divide((rows * v).sum(1), norm, out=np.zeros(len(rows)), where=norm > 0)) / 2
        best = sorted(range(len(rows)), key=lambda i: (-score[i], ids[i]))[:limit]
        out |= {(q, ids[i], k + 1, round(float(score[i]), 9)) for k, i in enumerate(best)}
    return out


def got(rows):
    return {(r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 9)) for r in rows.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_give_the_answer_of_a_scan(spark, tmp_path, seed):
    rnd = np.random.default_rng(seed)
    vectors = rnd.normal(size=(700, 12))
    vectors[100:300] = vectors[100]  # a large group of equal rows: ties go by id
    vectors[5] = vectors[6] = 0  # no direction
    vectors[400:410] *= 1000
    queries = np.concatenate([rnd.normal(size=(20, 12)), vectors[[100, 5, 400]], -vectors[[100]]])
    rows = table(spark, vectors)
    vector_index.save_cells(rows, f"file://{tmp_path}/i")
    index = vector_index.load_cells(spark, f"file://{tmp_path}/i")
    assert index.size.sum() == 700 and index.rows.count() == 700
    for limit in (1, 7, 250):
        want = brute(vectors, queries, limit)
        assert got(vector_index.nearest(index, asked(spark, queries), limit)) == want
        assert got(search.vector_search(rows, asked(spark, queries), limit)) == want
    assert got(vector_index.nearest(index, asked(spark, queries), 5, block=6)) == brute(vectors, queries, 5)
    some = [i for i in range(700) if i % 9 == 0]
    allowed = spark.createDataFrame([(f"v{i}",) for i in some], "chunk_id string")
    assert got(vector_index.nearest(index, asked(spark, queries), 5, allowed)) == brute(vectors[some], queries, 5, [f"v{i}" for i in some])


def test_fewer_than_half_of_clustered_rows_are_scored(spark, tmp_path):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(20, 16)) * 5
    vectors = np.concatenate([c + rnd.normal(size=(100, 16)) * 0.3 for c in centres])
    vector_index.save_cells(table(spark, vectors), f"file://{tmp_path}/i")
    index = vector_index.load_cells(spark, f"file://{tmp_path}/i")
    queries = vectors[::40]
    s = CellSearch(index, queries, 10)
    visited = s.visited(s.least())
    assert (visited * index.size).sum() < len(queries) * len(vectors) / 2
    found = vector_index.nearest(index, asked(spark, queries), 10)
    assert got(found) == brute(vectors, queries, 10)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_empty_and_odd(spark, tmp_path):
    none = table(spark, [[1.0, 2.0]]).limit(0)
    vector_index.save_cells(none, f"file://{tmp_path}/n")
    index = vector_index.load_cells(spark, f"file://{tmp_path}/n")
    queries = asked(spark, [[1, 0], [0, 0]])
    assert vector_index.nearest(index, queries, 3).count() == 0 and search.vector_search(none, queries, 3).count() == 0
    zeros = table(spark, [[0, 0], [0, 0]])
    vector_index.save_cells(zeros, f"file://{tmp_path}/z")
    assert got(vector_index.nearest(vector_index.load_cells(spark, f"file://{tmp_path}/z"), queries, 3)) == brute([[0, 0], [0, 0]], [[1, 0], [0, 0]], 3)
    nulls = table(spark, [[3, 4]]).unionByName(spark.createDataFrame([("n", None)], "chunk_id string, embedding array<float>"))
    assert [r["chunk_id"] for r in search.vector_search(nulls, queries.limit(1), 3).collect()] == ["v0"]
    with pytest.raises(Exception, match="has not 2 numbers"):
        search.vector_search(table(spark, [[1, 2, 3]]), queries, 1).collect()
