import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from gleanstone.functions.embedding import embed
from gleanstone.operators import aggregates, evidence, fusion, search, store
from gleanstone.plans import dashboard, refresh, tools
from gleanstone.schema import CHUNKS, conform, from_metadata, to_metadata
from gleanstone.streaming import incremental

NOW = datetime(2026, 2, 17, tzinfo=timezone.utc)


def chunk_rows(spark):
    rows = []
    for i in range(12):
        rows.append({"chunk_id": f"d{i}", "seq": i, "content": f"guide about transports and frames number {i}", "content_type": "doc", "path": f"/guides/{i % 3}", "source_url": f"https://d/{i}", "section": "S"})
        rows.append(
            {
                "chunk_id": f"s{i}", "seq": 100 + i, "content": f"def run_bot_{i}(self): pipeline frames\nline two\nline three", "content_type": "source", "repo": "org/r", "path": "src/a.py", "class_name": "Bot" if i < 6 else "Other",
                "method_name": f"run_bot_{i}", "chunk_type": "method", "line_start": 10 * i + 1, "line_end": 10 * i + 3, "calls": ["go", "X.y"], "yields": ["Frame"], "base_classes": ["Base"], "imports": ["from p import q"],
                "pipeline_version_pin": ">=9.0" if i % 2 else "0.1",
            }
        )
        rows.append({"chunk_id": f"c{i}", "seq": 200 + i, "content": f"example code for a voice bot {i}", "content_type": "code", "repo": f"org/r{i % 4}", "path": f"examples/{i}.py", "language": "python", "capability_tags": ["tts", "stt"] if i % 2 else ["tts"], "line_start": 1, "line_end": 1, "pipeline_version_pin": ">=9.0" if i % 2 else None})
    for r in rows:
        r["indexed_at"] = NOW
    return embed(conform(spark.createDataFrame([tuple(r.get(f.name) for f in CHUNKS) for r in rows], CHUNKS)))


@pytest.fixture(scope="module")
def hub(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hub") / "chunks")
    chunk_rows(spark).write.parquet(path)
    return tools.Hub.of(spark.read.parquet(path), now=F.lit("2026-02-17 00:00:00").cast("timestamp"))


def test_search_docs(hub):
    answer = hub.search_docs("transports frames", area="guides/1", limit=3)
    hits = answer.hits.orderBy("rank").collect()
    assert len(hits) == 3 and all(h["citation"]["path"] == "/guides/1" and h["title"] == "/guides/1" for h in hits) and [h["rank"] for h in hits] == [1, 2, 3]
    said = answer.evidence.first()
    assert said["confidence"] > 0.5 and not said["low_confidence"] and said["next_retrieval_queries"][0].startswith("Search all content types")
    assert json.loads(answer.to_json())["hits"][0]["rank"] == 1
    assert hub.search_docs("   ").hits.count() == 0 and hub.search_docs("   ").evidence.first()["confidence"] == 0.0
    with pytest.raises(ValueError):
        hub.search_docs("x", limit=51)


def test_search_examples_and_api(hub):
    hits = hub.search_examples("voice bot", limit=4, capability_tags=["stt"], version="1.0", version_filter="compatible_only").hits
    assert hits.count() == 0
    hits = hub.search_examples("voice bot", limit=4, language="python", version="1.0", version_filter="compatible_only").hits.collect()
    assert len(hits) == 4 and {h["version_compatibility"] for h in hits} == {"unknown"}
    api = hub.search_api("run_bot_3 pipeline", limit=5, class_name="Bot", calls="go").hits.orderBy("rank").collect()
    assert len(api) == 5 and all(h["class_name"] == "Bot" for h in api) and api[0]["yields"] == ["Frame"]


def test_concepts_are_interleaved(hub):
    hits = hub.search_api("run_bot_1 + run_bot_7", limit=4).hits.orderBy("rank").collect()
    assert {hits[0]["method_name"], hits[1]["method_name"]} == {"run_bot_1", "run_bot_7"} and len({h["chunk_id"] for h in hits}) == 4


def test_code_snippets(hub):
    by_class = hub.get_code_snippet(symbol="Bot").hits.collect()
    assert by_class and all(h["interface_expectations"] == ["Yields: Frame", "Implements: Base"] and h["companion_snippets"] == ["Bot.go", "X.y"] for h in by_class)
    by_method = hub.get_code_snippet(symbol="run_bot_9").hits.collect()
    assert len(by_method) == 1 and by_method[0]["line_start"] == 91
    cut = hub.get_code_snippet(symbol="run_bot_9", max_lines=2).hits.first()
    assert cut["content"].count("\n") == 1 and cut["line_end"] == 92 and cut["dependency_notes"]
    part = hub.get_code_snippet(path="src/a.py", line_start=92, line_end=92, content_type="source").hits.collect()
    assert all(h["content"] == "line two" and h["dependency_notes"] == [] for h in part)
    for bad in ({}, {"symbol": "a", "intent": "b"}, {"path": "x"}, {"symbol": "a", "max_lines": 501}):
        with pytest.raises(ValueError):
            hub.get_code_snippet(**bad)


def test_lookups(hub, spark):
    doc = hub.get_doc(doc_id="d3").first()
    assert doc["content"].endswith("number 3") and doc["evidence"]["confidence"] == 1.0
    page = hub.get_doc(path="/guides/0").first()
    assert page["content"].count("\n\n") == 3
    missing = hub.get_doc(path="/nope").first()
    assert missing["title"] == "Not Found" and missing["indexed_at"].year == 1970 and missing["evidence"]["confidence"] == 0.0
    assert hub.get_example("c1").first()["files"][0]["path"] == "examples/1.py" and hub.get_example("zz").first()["files"] == []
    assert hub.check_deprecation("x").first()["deprecated"] is False
    status = {r["name"]: r["value"] for r in hub.get_hub_status().collect()}
    assert status["count:doc"] == "12" and status["total"] == "36" and status["reranker"] == "off"
    with pytest.raises(ValueError):
        hub.get_doc()


def test_phrases_and_bm25(spark, tmp_path):
    rows = spark.createDataFrame([("a", "foo bar baz"), ("b", "bar foo foo"), ("c", "Running runs"), ("d", "")], "chunk_id string, content string")
    index = search.build_text_index(rows)
    found = search.text_search(index, [(1, '"foo-bar"'), (2, "foo bar"), (3, "run"), (4, '"" %%')], 10).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {1: ["a"], 2: ["b", "a"], 3: ["c"]} or got == {1: ["a"], 2: ["a", "b"], 3: ["c"]}
    search.save_text_index(index, f"{tmp_path}/index")
    again = search.text_search(search.load_text_index(spark, f"{tmp_path}/index"), [(2, "foo bar")], 10)
    assert {r["chunk_id"] for r in again.collect()} == {"a", "b"}
    changed = rows.filter("chunk_id <> 'a'").unionByName(spark.createDataFrame([("e", "new words")], "chunk_id string, content string"))
    post = search.changed_postings(index, changed, spark.createDataFrame([("a",), ("e",)], "chunk_id string"))
    want = search.build_text_index(changed).postings
    key = ["term", "chunk_id", "tf"]
    assert sorted(map(tuple, post.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_spread():
    assert fusion.spread(["a"] * 5 + ["b"], list("123456")) == [0, 1, 2, 5, 3, 4]
    assert fusion.spread(["a"] * 5, list("12345")) == [0, 1, 2, 3, 4]
    assert fusion.spread(list("abcde"), ["p"] * 4 + ["q"]) == [0, 1, 2, 4, 3]


def test_second_scorer_orders_only_the_top(spark):
    rows = spark.createDataFrame([(0, i, 1.0 / i, float(i)) for i in range(1, 6)], "query_id int, rank int, score double, s double")
    got = [r["s"] for r in fusion.rescored(rows, F.col("s"), 3).orderBy("rank").collect()]
    assert got == [3.0, 2.0, 1.0, 4.0, 5.0]


def test_evidence_of_weak_results(spark):
    asked = spark.createDataFrame([(0, "one two three")], "query_id int, query string")
    rows = spark.createDataFrame([(0, 1, 0.05, "x" * 300, "org/r", "p", "c", "u", NOW)], "query_id int, rank int, score double, content string, repo string, path string, commit_sha string, source_url string, indexed_at timestamp")
    said = evidence.assemble(asked, rows, {"repo": "org/r"}).first()
    assert abs(said["confidence"] - 0.11) < 1e-9 and said["low_confidence"] and len(said["known"][0]["statement"]) == 203
    assert [u["question"].split(":")[0] for u in said["unknown"]] == ["Low relevance results for", "Weak matches for"]
    assert said["next_retrieval_queries"] == ["Broaden search: one two", "Search across all repos: one two three", "Related: one two three tutorial", "Related: one two three example", "More from org/r: one two three"]


def test_store(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store")
    rows = chunk_rows(spark)
    assert s.read().count() == 0 and s.upsert(rows) == 36
    more = conform(rows.filter("chunk_id in ('d1', 'd2')").withColumn("content", F.lit("new"))).unionByName(conform(rows.limit(1)).withColumn("chunk_id", F.lit("fresh")))
    s.upsert(more)
    now = {r["chunk_id"]: (r["content"], r["seq"]) for r in s.read().select("chunk_id", "content", "seq").collect()}
    before = {r["chunk_id"]: r["seq"] for r in s.read().select("chunk_id", "seq").collect()}
    assert len(now) == 37 and now["d1"][0] == "new" and now["fresh"][1] == max(v for _, v in now.values()) and len(set(before.values())) == 37
    assert s.delete("content_type", "code") == 12 and s.delete("repo", "none") == 0 and s.read().count() == 25
    assert store.vector_rows(s.read()).count() == 25
    s.clear()
    assert s.read().count() == 0
    s.reset()
    assert s.read().count() == 0


def test_new_rows_follow_in_order_of_the_batch(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store")
    pages = spark.createDataFrame([(f"https://d/p{p}", "\n".join(f"## H{h}\n\ntext {h}" for h in range(12))) for p in range(3)], "source_url string, body string")
    from gleanstone.sources import markdown

    rows = conform(markdown.chunk_pages(pages))
    s.upsert(rows.repartition(5))
    got = s.read().orderBy("seq").select("path", "chunk_index", "seq").collect()
    assert [tuple(r) for r in got] == [(f"/p{p}", h, p * 12 + h) for p in range(3) for h in range(12)]
    page = tools.Hub.of(s.read()).get_doc(path="/p1").first()
    assert page["sections"] == [f"H{h}" for h in range(12)] and page["content"].index("text 3") < page["content"].index("text 11")
    many = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("chunk_id"), F.col("id").alias("seq"), F.lit("c").alias("content"))
    s.upsert(many)
    tail = s.read().filter("chunk_id like 'k%'").selectExpr("seq - 36 as n", "cast(substr(chunk_id, 2) as long) as k")
    assert tail.filter("n <> k").count() == 0 and tail.count() == 5000


def test_a_writer_that_dies_leaves_the_last_version(spark, tmp_path, monkeypatch):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store")
    s.upsert(chunk_rows(spark))
    reader = s.read()

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store.ChunkStore, "_point", dies)
        with pytest.raises(KeyboardInterrupt):
            s.delete("content_type", "code")
    assert s.read().count() == 36
    assert s.delete("content_type", "code") == 12 and s.read().count() == 24
    assert reader.count() == 36  # the version before stays for readers that began with it
    with pytest.raises(RuntimeError):
        s._point(s._pointers()[-1], "v-other", True, False, 0)


def test_changes_are_small_and_merge(spark, tmp_path, monkeypatch):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store")
    many = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("chunk_id"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("content"), F.lit("doc").alias("content_type"))
    s.upsert(many)
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    first = size()
    few = spark.createDataFrame([(f"k{i}", f"new {i}", "code") for i in range(3995, 4005)], "chunk_id string, content string, content_type string")
    assert s.upsert(few) == 10 and size() - first < first / 8
    assert s.delete("chunk_id", "k7") == 1 and s.delete("chunk_id", "k7") == 0
    got = {r["chunk_id"]: (r["seq"], r["content_type"]) for r in s.read().select("chunk_id", "seq", "content_type").collect()}
    assert len(got) == 4004 and got["k3996"] == (3996, "code") and sorted(v[0] for v in got.values()) == [i for i in range(4005) if i != 7]
    assert [got[f"k{i}"][0] for i in range(4000, 4005)] == list(range(4000, 4005))
    s.upsert(spark.createDataFrame([("k7", "again", "doc")], "chunk_id string, content string, content_type string"))
    assert s.read().filter("chunk_id = 'k7'").first()["seq"] == 4005 and len(s._changes()) == 4 and not s._changes()[-1]["base"]
    before = sorted(map(str, s.read().collect()))
    reader = s.read()
    monkeypatch.setattr(store.ChunkStore, "MOST_CHANGES", 4)
    s.upsert(few)
    assert len(s._changes()) == 1 and s._changes()[0]["base"] and sorted(map(str, s.read().collect())) == before and reader.count() == 4005
    s.compact()
    assert len(s._pointers()) == 2 and sorted(map(str, s.read().collect())) == before


def test_key_values(spark):
    table = spark.createDataFrame([("a", "1", NOW)], store.KEY_VALUES)
    later = spark.createDataFrame([("a", "2", datetime(2027, 1, 1, tzinfo=timezone.utc)), ("b", "3", NOW)], store.KEY_VALUES)
    both = store.set_values(table, later)
    assert store.get_value(both, "a").first()[0] == "2" and store.without_key(both, "a").count() == 1


def test_metadata_round_trip(spark):
    rows = chunk_rows(spark).drop("embedding")
    flat = rows.select("chunk_id", "seq", "content", "content_type", "source_url", "repo", "path", "commit_sha", "indexed_at").join(to_metadata(rows), "chunk_id")
    again = from_metadata(flat).drop("embedding")
    assert sorted(map(str, again.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    legacy = spark.createDataFrame([("a", '{"capability_tags": "x, y", "line_start": 3, "is_dataclass": true}')], "chunk_id string, metadata string")
    row = from_metadata(legacy).first()
    assert row["capability_tags"] == ["x", "y"] and row["line_start"] == 3 and row["is_dataclass"] is True


def test_refresh(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store")
    rows = chunk_rows(spark).drop("embedding")
    docs, src = rows.filter("content_type = 'doc'"), rows.filter("repo = 'org/r'")
    none = spark.createDataFrame([], "name string, fingerprint string")

    def broken():
        raise RuntimeError("no network")

    sources = [refresh.Source("docs", docs.select("content"), lambda: docs), refresh.Source("org/r", src.select("content"), lambda: src), refresh.Source("org/x", src.select("content"), broken)]
    first = refresh.refresh(spark, s, sources, none)
    assert {r["name"]: r["status"] for r in first.summary.collect()} == {"docs": "updated", "org/r": "updated", "org/x": "error"} and first.errors == {"org/x": "no network"}
    assert s.read().filter("embedding is not null").count() == 24
    second = refresh.refresh(spark, s, sources[:1], first.fingerprints)
    assert {r["name"]: (r["status"], r["existing"]) for r in second.summary.collect()} == {"docs": ("skipped", 12), "org/r": ("removed", 12)} and s.read().count() == 12
    assert second.totals().first()["records"] == 12


def test_dashboard(spark):
    rows = chunk_rows(spark)
    placed = dashboard.points(rows)
    members, summary = dashboard.clusters(placed, 4)
    assert members.count() == 36 and sum(r["n"] for r in summary.collect()) == 36 and all(r["label"] for r in summary.collect())
    stats = dashboard.statistics(rows)
    assert {r["content_type"]: r["n"] for r in stats["content_types"].collect()} == {"doc": 12, "source": 12, "code": 12}
    assert stats["method_lengths"].first()["n"] == 12


def test_tags_and_quality(spark):
    tags = spark.createDataFrame([("k", "t", 0.9, "readme", 1), ("k", "t", 0.9, "code", 2), ("k", "u", 0.5, "manual", 3)], "k string, name string, confidence double, source string, ord long")
    assert {(r["name"], r["source"]) for r in aggregates.best_tags(tags, "k").collect()} == {("t", "code"), ("u", "manual")}


def test_stream(spark, tmp_path):
    rows = conform(chunk_rows(spark))
    rows.repartition(2).write.parquet(f"{tmp_path}/in")
    s = store.ChunkStore(spark, f"file://{tmp_path}/store")
    incremental.merge_into(incremental.chunk_stream(spark, f"{tmp_path}/in", 1), s, f"{tmp_path}/ck").awaitTermination()
    assert s.read().count() == 36
    rows.limit(3).write.mode("append").parquet(f"{tmp_path}/in")
    incremental.merge_into(incremental.chunk_stream(spark, f"{tmp_path}/in"), s, f"{tmp_path}/ck").awaitTermination()
    assert s.read().count() == 36
    q = incremental.ingest_rates(incremental.chunk_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from rates").first()[0] == 39


def test_vector_search_of_many_queries(spark):
    chunks = spark.createDataFrame([(f"v{i}", [1.0, float(i)]) for i in range(3)], "chunk_id string, embedding array<float>")
    queries = spark.range(10_001).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).cast("array<float>").alias("vector"))
    got = search.vector_search(chunks, queries, 2)
    assert got.filter("rank = 1").filter("chunk_id = concat('v', query_id % 3)").count() == 10_001 and got.count() == 20_002
    few = queries.filter("query_id < 20")
    assert sorted(search.vector_search(chunks, few, 2, block=5).collect()) == sorted(search.vector_search(chunks, few, 2).collect())


def test_no_task_ranks_the_whole_table(spark):
    from gleanstone.plans import table_queries

    plan = table_queries.QUERIES["join_rrf_fusion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" in plan and "windowspecdefinition(content" not in plan and "windowspecdefinition(n_chars" not in plan
