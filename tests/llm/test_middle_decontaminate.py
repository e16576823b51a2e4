"""Fill-in-middle and decontamination against brute force, and odd input."""

import hashlib
import random
import re

import numpy as np
import pytest
from conftest_rows import prose
from pyspark.sql import functions as F

from gleanstone.llm import decontaminate, fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["", " ", "\n\t ", "a", "a ", " a", "ä", "日本 語　x ", "x" * 100_000, " " * 70_000, "ab " * 40_000, "\x1f \x0b\x00b", "é" * 16384 + " y", "ends <P", "<P> in it", "<S", "<M>", "a<" * 9, "😀 😀  "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = [int(sha(f"42:{'' if doc_id is None else doc_id}")[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, sha(text), sha(text))
    spm = h[3] % 100 < 80
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return (doc_id, len(units), "spm" if spm else "psm", len(pre), len(mid), sha(out), sha(text))


def test_middle_is_that_of_the_pattern(spark, odd, none):
    rnd = random.Random(3)
    data = [(i, t) for i, t in enumerate(ODD * 6)] + [(1000 + i, "".join(rnd.choice("ab \n\té😀<PSM>") for _ in range(rnd.randrange(60)))) for i in range(300)] + [(None, "no id here"), (7, None), (7, None)]
    got = fill_middle.middle_digests(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(middle(*r)) for r in data)
    assert {"plain", "spm", "psm"} == {r["form"] for r in got}
    got = fill_middle.middle_digests(odd).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(middle(r["doc_id"], r["text"])) for r in odd.collect())
    assert fill_middle.middle_digests(none).count() == 0


def test_cuts_on_chunk_edges():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aé \n") for _ in range(rnd.randrange(40))) for _ in range(200)]
    for chunk in (1, 2, 3, 7, 64):
        counts = fill_middle.UnitCounts([t.encode() for t in texts], chunk)
        for k, t in enumerate(texts):
            units = UNIT.findall(t)
            assert counts.n[k] == len(units)
            for r in range(len(units) + 1):
                head = "".join(units[:r])
                assert counts.cut(k, r) == (len(head.encode()), len(head))


def test_middle_passes_columns_through(spark):
    df = spark.createDataFrame([(1, "a b c d", "mine", 5)], "doc_id long, text string, form string, extra int")
    row = fill_middle.fill_in_middle(df, rate=100, spm=0).first()
    assert row["extra"] == 5 and row["form"] == "psm" and row["text"] == "a b c d" and row["output"].startswith("<P>")
    assert fill_middle.fill_in_middle(df, rate=0).first()["output"] == "a b c d"


WORD = re.compile(decontaminate.WORD)
LOWER = str.maketrans(decontaminate.UPPER, decontaminate.UPPER.lower())


def brute(docs, items, n=10):
    spelled = [(("" if i is None else str(i)), WORD.findall((t or "").translate(LOWER))) for i, t in items]
    out = []
    for doc_id, text in docs:
        w, hit, ids = WORD.findall((text or "").translate(LOWER)), set(), set()
        for item, v in spelled:
            k = min(n, len(v))
            grams = {tuple(v[s : s + k]) for s in range(len(v) - k + 1)} if v else set()
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in grams:
                    hit.update(range(s, s + k))
                    ids.add(item)
        out.append((doc_id, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1 << 20, 120])
def test_hits_are_those_of_all_windows(spark, odd, none, most):
    rnd = random.Random(6)
    items = [(i, prose(rnd, "en", rnd.choice([12, 30, 60]))) for i in range(12)]
    items += [(3, items[0][1]), (20, items[1][1]), (21, items[1][1].upper() + "!"), (30, "Zürich 1st"), (31, "日本語"), (32, "one two three four"), (33, None), (34, ""), (35, "... !"), (None, "an item that has no id of its own but a good many words")]
    docs = [(i, prose(rnd, "en", 80)) for i in range(20)]
    for i in range(30):
        w = prose(rnd, "en", 50).split()
        for _ in range(rnd.randrange(3)):
            v = rnd.choice(items[:15])[1].split()
            s = rnd.randrange(len(v))
            at = rnd.randrange(len(w))
            w[at:at] = v[s : s + rnd.randrange(8, 40)]
        docs.append((100 + i, rnd.choice([" ", "-", ", "]).join(w)))
    docs += [(200, None), (201, ""), (202, "in zürich 1st and 日本語"), (203, "one two three four " * 50), (203, "one two three four " * 50), (None, items[0][1]), (204, " ".join(t for _, t in items[:12])), (205, items[2][1] + " " + prose(rnd, "de", 40_000) + " " + items[4][1])]
    df, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, b, most=most)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, decontaminate.contamination(odd, b, most=most).collect()), key=str) == brute(rows, items)
    assert decontaminate.contamination(none, b, most=most).count() == 0
    assert not decontaminate.contamination(df, b.limit(0), most=most).filter("contaminated or n_items > 0").count()


def test_long_items_and_lanes(spark):
    rnd = random.Random(8)
    long = [f"w{rnd.randrange(400)}" for _ in range(9_000)]
    items = [(1, " ".join(long)), (2, " ".join(long[4090:4110]))]
    docs = [(1, " ".join(long)), (2, " ".join(long[4085:4125])), (3, " ".join(long[100:109])), (4, " ".join(["x"] * 5000 + long[8990:9000] + ["x"] * 300)), (5, " ".join(long[:200] + long[4000:]))]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most=5000)
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == brute(docs, items)


def test_windows_skip_and_runs_are_reported(spark):
    table = decontaminate.Windows(np.arange(1, 31).reshape(3, 10), np.arange(3))
    assert table.shift.max() == 8 and (table.shift == 0).sum() == 3
    df = spark.createDataFrame([(1, "a b c d e f", "x")], "doc_id long, text string, hits string")
    row = decontaminate.occurrences(df, spark.createDataFrame([(9, "c d")], "item_id long, text string")).first()
    assert [tuple(h) for h in row["hits"]] == [(2, 4)] and row["item_ids"] == ["9"]
    runs = spark.sql("SELECT array(named_struct('begin', 5L, 'stop', 9L), named_struct('begin', 0L, 'stop', 2L), named_struct('begin', 2L, 'stop', 3L), named_struct('begin', 6L, 'stop', 7L)) AS r")
    assert [tuple(h) for h in runs.select(decontaminate.merged(F.col("r"))).first()[0]] == [(0, 3), (5, 9)]
