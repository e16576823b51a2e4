"""Kept text indexes against those built anew, and block-max search against full scoring."""

import random

import pytest
from pyspark.sql import functions as F

from gleanstone.operators import search, text_index
from gleanstone.operators.text_index import TextSegments

WORDS = "alpha beta gamma delta run running runs bot pipeline frame zürich l'été".split()


def texts(spark, ids, seed, n=40):
    rnd = random.Random(seed)
    rows = [(f"d{i}", " ".join(rnd.choices(WORDS, [8, 5, 3, 2, 2, 2, 1, 1, 1, 1, 1, 1], k=rnd.randrange(n)))) for i in ids]
    return spark.createDataFrame(rows, "chunk_id string, content string")


def tables(index):
    rows = {
        "postings": index.postings.select("term", "chunk_id", F.col("tf").cast("long"), "positions"), "lengths": index.lengths.select("chunk_id", F.col("dl").cast("long")),
        "terms": index.terms.select("term", F.col("df").cast("long")), "corpus": index.corpus.select(F.col("docs").cast("long"), F.round("mean", 9)),
    }
    return {k: sorted(map(str, map(tuple, v.collect()))) for k, v in rows.items()}


@pytest.mark.parametrize("stems", [True, False])
def test_segments_are_a_fresh_index(spark, tmp_path, stems):
    kept = TextSegments(spark, f"file://{tmp_path}/s", stems)
    assert kept.numbers() == [] and kept.index().postings.count() == 0
    first, second = texts(spark, range(60), 1), texts(spark, range(40, 90), 2)
    kept.put(first)
    assert tables(kept.index()) == tables(search.build_text_index(first, stems))
    gone = spark.createDataFrame([("d3",), ("d85",), ("nobody",)], "chunk_id string")
    assert kept.put(second.filter("chunk_id <> 'd85'"), gone) == 1
    now = first.join(second, "chunk_id", "left_anti").unionByName(second).filter("chunk_id not in ('d3', 'd85')")
    assert tables(kept.index()) == tables(search.build_text_index(now, stems))
    kept.put(first.limit(0), now.select("chunk_id").filter("chunk_id < 'd5'"))
    kept.put(texts(spark, [5], 3), None)
    now = now.filter("chunk_id >= 'd5'").filter("chunk_id <> 'd5'").unionByName(texts(spark, [5], 3))
    assert tables(kept.index()) == tables(search.build_text_index(now, stems))
    merged = kept.merged_to(f"file://{tmp_path}/m")
    assert merged.numbers() == [0] and tables(merged.index()) == tables(kept.index()) and merged.table("gone").count() == 0


def test_a_repeated_segment_replaces_itself(spark, tmp_path):
    kept = TextSegments(spark, f"file://{tmp_path}/s")
    first, second = texts(spark, range(20), 1), texts(spark, range(10, 30), 2)
    kept.put(first, None, 0)
    kept.put(second, None, 1)
    want = tables(kept.index())
    kept.put(second, None, 1)
    assert tables(kept.index()) == want and kept.numbers() == [0, 1]
    assert tables(kept.index([0])) == tables(search.build_text_index(first))


def test_an_upsert_writes_what_it_brings(spark, tmp_path):
    kept = TextSegments(spark, f"file://{tmp_path}/s", stems=False)
    kept.put(texts(spark, range(3000), 1))
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    before = size()
    kept.put(texts(spark, range(10), 2))
    assert size() - before < before / 10


def test_texts_are_split_once_and_a_common_term_has_no_task_of_its_own(spark, tmp_path, monkeypatch):
    def noted(batches):
        for b in batches:
            with open(f"{tmp_path}/rows", "a") as f:
                f.write("." * len(b))
            yield b

    kept = TextSegments(spark, f"file://{tmp_path}/s", stems=False)
    rows = texts(spark, range(400), 1).persist()
    size = rows.agg(F.sum(F.octet_length("content"))).first()[0]
    monkeypatch.setattr(text_index, "TASK_BYTES", size // 4 + 1, raising=False)  # four tasks
    monkeypatch.setattr(text_index, "posting_rows", lambda chunks, stems, split=text_index.posting_rows: split(chunks.mapInPandas(noted, rows.schema), stems))
    kept.put(rows)
    rows.unpersist()
    assert len((tmp_path / "rows").read_text()) == 400
    found = kept.table("postings").filter("term = 'alpha'")
    assert found.select(F.input_file_name()).distinct().count() == 4
    want = tables(search.build_text_index(rows, stems=False))
    assert tables(kept.index()) == want and tables(kept.merged_to(f"file://{tmp_path}/m").index()) == want
    shown = kept.table("postings").select("term", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("k")).collect()
    for f in {r["f"] for r in shown}:
        terms = [r["term"] or "" for r in sorted(shown, key=lambda r: r["k"]) if r["f"] == f]
        assert terms == sorted(terms)


def test_runs_of_texts_give_the_postings_of_all(spark, monkeypatch):
    rows = texts(spark, range(90), 4).unionByName(spark.createDataFrame([("e1", ""), ("e2", None), ("e3", "Ünïcode ünicode ONLY_here ½ x1")], "chunk_id string, content string")).coalesce(1)
    monkeypatch.setattr(text_index, "ROWS", 7)
    monkeypatch.setattr(text_index, "RUN_BYTES", 500)
    monkeypatch.setattr(text_index, "OUT_ROWS", 9)
    index = search.build_text_index(rows, stems=False)
    got = text_index.posting_rows(rows, False)
    assert sorted(map(str, got.filter("term is not null").select("term", "chunk_id", "tf", "positions").collect())) == sorted(map(str, index.postings.collect()))
    assert sorted(got.filter("term is null and positions is null").select("chunk_id", "tf").collect()) == sorted(index.lengths.collect())


def test_blocks_find_what_full_scoring_finds(spark, tmp_path, monkeypatch):
    stems = True
    monkeypatch.setattr(text_index, "SLICE", 16)
    rows = texts(spark, range(700), 5, 80).unionByName(spark.createDataFrame([("e1", ""), ("e2", None), ("e3", "only here once"), ("e4", "run " * 500)], "chunk_id string, content string"))
    text_index.save_blocks(rows, f"file://{tmp_path}/b", stems)
    search.save_text_index(search.build_text_index(rows, stems), f"file://{tmp_path}/w")
    blocks, whole = text_index.load_blocks(spark, f"file://{tmp_path}/b", stems), search.load_text_index(spark, f"file://{tmp_path}/w", stems)
    queries = [(1, "alpha"), (2, "alpha beta run"), (3, "alpha-beta gamma"), (4, '"run run"'), (5, "bot-bot"), (6, "nothing at all"), (7, ""), (8, "%% once"), (9, "ZÜRICH L'ÉTÉ"), (10, "run  run")]
    for limit in (7,):
        got, want = (f.select("query_id", "chunk_id", "rank", F.round("score", 9)).collect() for f in (text_index.block_search(blocks, queries, limit), search.text_search(whole, queries, limit)))
        assert sorted(got) == sorted(want) and len(got) > 9
    some = rows.filter("chunk_id < 'd3'").select("chunk_id")
    assert sorted(text_index.block_search(blocks, queries, 5, some).drop("score").collect()) == sorted(search.text_search(whole, queries, 5, some).drop("score").collect())
    assert sorted(text_index.block_search(blocks, queries[:4], 5, block=3).drop("score").collect()) == sorted(search.text_search(whole, queries[:4], 5).drop("score").collect())
    assert text_index.block_search(blocks, [], 5).count() == 0


def test_slices_below_the_score_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "SLICE", 16)
    rnd = random.Random(9)
    rows = [(f"d{i}", "alpha beta " + "pad " * rnd.randrange(20, 400)) for i in range(600)] + [(f"z{i}", "other words " * 9) for i in range(900)] + [(f"s{i}", "alpha beta") for i in range(12)]
    text_index.save_blocks(spark.createDataFrame(rows, "chunk_id string, content string"), f"file://{tmp_path}/b", False)
    s = text_index.BlockSearch(text_index.load_blocks(spark, f"file://{tmp_path}/b", False), spark.createDataFrame([(1, "alpha beta")], "query_id long, query string"), 10)
    bounds = s.bounds()
    assert s.open(bounds, s.least(bounds)).count() < bounds.count() / 4
    plan = s.blocks.select("term", "slice", "most_tf", "least_dl")._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan.split("ReadSchema")[1] and "PartitionFilters: [isnotnull(bucket" in plan and "term" in plan.split("PushedFilters")[1].split("ReadSchema")[0]


def test_tokens_are_those_of_the_column_function(spark):
    odd = ["", None, "a_b-c", "Zürich L'ÉTÉ ÀÇñ", "日本語 x１２ ½ Ⅷ", "ΣΑΣ İstanbul", "e\u0301 \u0301", "naïve ǅ ß ẞ", "x\x00y\u2028z", "😀a😀"]
    from gleanstone.functions.text import words

    df = spark.createDataFrame(list(enumerate(odd)), "k int, t string").select("k", words(F.coalesce("t", F.lit(""))).alias("w"))
    assert {r["k"]: list(r["w"]) for r in df.collect()} == {k: text_index.tokens_of(t) for k, t in enumerate(odd)}


def test_blocks_are_written_where_a_slice_is_made(spark, tmp_path, monkeypatch):
    """Texts are dealt to slices, and nothing is dealt again; a posting is a few bytes, without its chunk's name."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "repartition", lambda *_: pytest.fail("a second shuffle"))
    long = "a-name-that-is-longer-than-its-text-" * 4
    rows = [(f"{long}{i}", "Zürich zurich run " + "pad " * (i % 300)) for i in range(600)] + [("none", None), ("empty", "%")]
    text_index.save_blocks(spark.createDataFrame(rows, "chunk_id string, content string"), f"file://{tmp_path}/b", False)
    index = text_index.load_blocks(spark, f"file://{tmp_path}/b", False)
    assert {r[0]: tuple(r[1:]) for r in index.blocks.groupBy("term").agg(F.sum("held"), F.max("most_tf")).collect()} == {"zurich": (600, 2), "run": (600, 1), "pad": (598, 299)}
    assert index.blocks.agg(F.max((F.length("docs") + F.length("tfs")) / F.col("held"))).first()[0] <= 4 and index.chunks.select(F.sum(F.size("ids"))).first()[0] == 602
    assert tuple(index.corpus.first())[0] == 602


def test_many_questions_are_asked_in_one_walk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "SLICE", 8)
    rows = texts(spark, range(500), 11, 60).unionByName(spark.createDataFrame([("e1", ""), ("e2", None), ("e4", "run " * 300)], "chunk_id string, content string"))
    text_index.save_blocks(rows, f"file://{tmp_path}/b", False)
    search.save_text_index(search.build_text_index(rows, False), f"file://{tmp_path}/w")
    blocks, whole = text_index.load_blocks(spark, f"file://{tmp_path}/b", False), search.load_text_index(spark, f"file://{tmp_path}/w", False)
    assert blocks.chunks.count() > 2 * text_index.SOME
    rnd = random.Random(3)
    queries = [(k, rnd.choice([" ", "-"]).join(rnd.choices(WORDS, k=rnd.randrange(1, 4)))) for k in range(60)]
    queries += [(60 + k, q) for k, q in enumerate(["run-run-run", "run-run alpha", "alpha-beta gamma-delta", "alpha  alpha", "zzz alpha", "", "%%", "alpha beta-zzz", "gamma-delta-alpha run", "ALPHA beta", "alpha beta", "alpha beta"])]
    want = sorted(search.text_search(whole, queries, 5).withColumn("score", F.round("score", 8)).collect())
    monkeypatch.setattr(text_index, "BlockSearch", lambda *_: pytest.fail("blocks of questions read the index again"))
    for pairs in (1 << 20, 40):
        monkeypatch.setattr(text_index, "PAIRS", pairs)
        got = text_index.block_search(blocks, queries, 5, block=10)
        assert sorted(got.withColumn("score", F.round("score", 8)).collect()) == want and len(want) > 150
