"""The jobs over copies of the given tables: growing input, reruns, command lines."""

import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from gleanstone.operators import search
from jobs import answer_report, index_feed
from jobs.common import config_of

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows_of(segments):
    return sorted(map(str, index_feed.index_rows(segments).collect()))


def fresh(rows):
    """What index_rows() gives for an index that is built at once."""
    index = search.build_text_index(rows, stems=False)

    class Whole:
        def index(self):
            return index

    return rows_of(Whole())


def test_the_feed_takes_only_what_is_new(spark, tmp_path, caplog):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at = {k: f"file://{tmp_path}/{k}" for k in ("in", "out", "check")}
    config = config_of("index_feed") | {"stems": False, "files_per_batch": 1}
    docs.filter("doc_id < 120").coalesce(1).write.parquet(at["in"])
    with caplog.at_level("INFO"):
        first = index_feed.run(spark, at["in"], at["out"], at["check"], config)
    plain = docs.select(index_feed.chunk_id(F.col("doc_id")).alias("chunk_id"), F.col("text").alias("content"))
    assert first.numbers() == [0] and rows_of(first) == fresh(plain.filter("cast(substr(chunk_id, 2) as int) < 120"))
    assert "read 120 rows" in caplog.text and "wrote 1 segments" in caplog.text
    again = index_feed.run(spark, at["in"], at["out"], at["check"], config)
    assert again.numbers() == [0] and rows_of(again) == rows_of(first)
    # New rows, a changed text, one that goes, one without an id, one twice.
    new = docs.filter("doc_id >= 120")
    changed = docs.filter("doc_id = 3").withColumn("text", F.lit("quite another text"))
    more = new.unionByName(changed).unionByName(docs.filter("doc_id = 5").withColumn("text", F.lit(None).cast("string"))).unionByName(changed.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(new.limit(1))
    more.coalesce(1).write.mode("append").parquet(at["in"])
    caplog.clear()
    with caplog.at_level("INFO"):
        second = index_feed.run(spark, at["in"], at["out"], at["check"], config)
    want = plain.filter("chunk_id not in ('d3', 'd5')").unionByName(spark.createDataFrame([("d3", "quite another text")], "chunk_id string, content string"))
    assert second.numbers() == [0, 1] and rows_of(second) == fresh(want)
    assert f"read {more.count()} rows" in caplog.text and "of which 1 without an id" in caplog.text
    assert second.table("lengths").filter("segment = 1").count() == new.count() + 1
    assert rows_of(index_feed.run(spark, at["in"], at["out"], at["check"], config)) == rows_of(second)


def test_the_feed_repeats_a_batch_that_was_not_committed(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(50)
    at = {k: f"file://{tmp_path}/{k}" for k in ("in", "out", "check")}
    docs.coalesce(1).write.parquet(at["in"])
    config = config_of("index_feed")
    want = rows_of(index_feed.run(spark, at["in"], at["out"], at["check"], config))
    for f in (tmp_path / "check" / "commits").iterdir():  # as if the driver had died before the batch was marked
        f.unlink()
    assert rows_of(index_feed.run(spark, at["in"], at["out"], at["check"], config)) == want


def test_a_version_decides(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, None, 0), (2, "x", 1), (2, None, 2), (None, "n", 9)], "doc_id long, text string, v int")
    got = {r["chunk_id"]: r["content"] for r in index_feed.latest_texts(rows, config_of("index_feed") | {"version": "v"}).collect()}
    assert got == {"d1": "a", "d2": None}


def test_only_texts_that_are_met_twice_are_sorted(spark, monkeypatch):
    config = config_of("index_feed")
    rows = spark.createDataFrame([(1, "b"), (2, "x"), (3, None), (None, "n"), (None, "m")], "doc_id long, text string")
    met = lambda df: sorted(map(str, df.collect()))
    once = index_feed.batch_texts(rows, config, 0)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and met(once) == met(index_feed.latest_texts(rows, config))
    more = rows.unionByName(spark.createDataFrame([(1, "a"), (1, "b"), (3, "z"), (4, "y"), (5, None), (5, None)], "doc_id long, text string"))
    for most in (10, 1):
        monkeypatch.setattr(index_feed, "BROADCAST_IDS", most)
        assert met(index_feed.batch_texts(more, config, 3)) == met(index_feed.latest_texts(more, config))


def test_answers(spark, tmp_path):
    docs = [(1, "the quick brown fox jumps over the lazy dog and sleeps", "en", "s1"), (2, "der schnelle braune fuchs", "de", "s2"), (3, "the quick brown fox again", None, None), (4, None, "en", "s1"), (None, "the quick", "en", "s1")]
    questions = [(1, "The quick brown fox jumps OVER the lazy dog"), (2, "schnelle fuchs"), (3, "nobody knows"), (4, ""), (5, None), (None, "x"), (2, "fuchs")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/d")
    spark.createDataFrame(questions, "item_id long, text string").write.parquet(f"file://{tmp_path}/q")
    run = lambda: answer_report.run(spark, f"file://{tmp_path}/d", f"file://{tmp_path}/q", f"file://{tmp_path}/o", config_of("answer_report"))
    rows = sorted(run().collect(), key=lambda r: (r["item_id"], r["rank"] or 0))
    assert [(r["item_id"], r["rank"], r["chunk_id"], r["language"]) for r in rows] == [(1, 1, "d1", "en"), (2, 1, "d2", "de"), (3, None, None, "none")]
    assert rows[0]["coverage"] == 1.0 and rows[0]["n_hits"] == 1 and rows[2]["confidence"] == 0.0 and rows[0]["score"] == 1.0
    assert sorted(run().collect()) == sorted(rows) and {p.name for p in (tmp_path / "o" / "answers").glob("language=*")} == {"language=en", "language=de", "language=none"}


def test_command_lines(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"stems": False}))
    env = os.environ | {"PYTHONPATH": ROOT}
    feed = [sys.executable, "-m", "jobs.index_feed", "--documents", f"{DATA}/documents.parquet", "--out", f"file://{tmp_path}/o", "--checkpoint", f"file://{tmp_path}/k", "--config", str(tmp_path / "c.json")]
    done = subprocess.run(feed, env=env, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "wrote 1 segments" in done.stderr and (tmp_path / "o" / "postings" / "segment=0").is_dir()
    (tmp_path / "c.json").write_text(json.dumps({"stem": False}))
    assert subprocess.run(feed, env=env, cwd=ROOT, capture_output=True, text=True, timeout=300).returncode != 0


def test_texts_are_not_shuffled_for_answers(spark, tmp_path, monkeypatch):
    """Hits are sent to the texts, and texts are read once for them; so what is shuffled for the answers is small beside them."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(answer_report, "save_blocks", lambda *a, save=answer_report.save_blocks, **k: (save(*a, **k), spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")))
    plans, join = [], DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda self, other, *a, **k: plans.append(join(self, other, *a, **k)) or plans[-1])
    try:
        answer_report.run(spark, f"{DATA}/documents.parquet", f"{DATA}/benchmark.parquet", f"file://{tmp_path}/o", config_of("answer_report"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    said = [p._jdf.queryExecution().executedPlan().toString() for p in plans if "content" in p.columns]
    assert len(said) == 2 and all("BroadcastHashJoin" in p and "hashpartitioning(chunk_id" not in p for p in said)
