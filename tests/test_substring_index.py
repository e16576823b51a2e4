"""Substring search through bitmaps against a full scan."""

import random

from gleanstone.operators import search, substring_index


def test_groups_prune_and_nothing_is_lost(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_index, "EACH", 16)
    rnd = random.Random(1)
    rows = [(f"c{i}", " ".join("".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(30)), rnd.choice(["doc", "code"]), f"/p/{i % 7}", None) for i in range(600)]
    rows += [("n1", None, "doc", None, None), ("n2", "", "doc", None, "Title"), ("n3", "The NEEDLE’s ÉTÉ here", "code", "/x", None), ("n4", "needl", "doc", None, "e")]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, content_type string, path string, title string")
    substring_index.save_substrings(chunks, f"file://{tmp_path}/i")
    index = substring_index.load_substrings(spark, f"file://{tmp_path}/i")
    assert index.rows.count() == len(rows) and index.grams.count() > 20
    for asked in ("needle", "’s été", "/p/3", "abc", "ab", "", "c59", "zzz", "title", rows[5][1][3:20]):
        for kinds in (None, ["doc"]):
            got = sorted(r["chunk_id"] for r in substring_index.find_text(index, asked, kinds).collect())
            assert got == sorted(r["chunk_id"] for r in search.free_text(chunks, asked, kinds).collect())
    assert substring_index.possible_groups(index, "needle’s").count() < index.grams.count() / 4
    monkeypatch.setattr(substring_index, "LISTED", 1)
    assert substring_index.find_text(index, "abc").count() == search.free_text(chunks, "abc").count()
    substring_index.save_substrings(chunks.limit(0), f"file://{tmp_path}/n")
    assert substring_index.find_text(substring_index.load_substrings(spark, f"file://{tmp_path}/n"), "abc").count() == 0
