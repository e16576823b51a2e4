"""What the queries promise, recomputed by brute force; and odd input: planes, long runs, ties, repeated rows, broken pages."""

import io
import math
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from conftest_rows import prose
from pyspark.sql import functions as F

from gleanstone.llm import fingerprint, html_text, langid, media, quality, sharding, token_counts, wordbpe
from gleanstone.llm.queries import tokenizer_file

WORD, BYTE = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.tiktoken")


def test_only_letters_make_a_language(spark):
    rnd = random.Random(1)
    data = [(i, prose(rnd, ("en", "de")[i % 2], 60), ("en", "de")[i % 2]) for i in range(60)]
    odd = {900: "\U0001f600\U0001f601", 901: "́", 902: "́ ̂ 12", 903: "12 !?", 904: "", 905: None}
    data += [(i, t, None) for i, t in odd.items()] + [(906, "\U0001d49c the of and", None), (907, "\U0001f600 der die und", None), (7, "ein anderer text", "de"), (None, "the of", "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.predict_languages(df).collect()}
    assert all(got.get((i, "und")) == 0.0 for i in odd)
    assert (906, "en") in got and (907, "de") in got
    assert langid.codes("\U00010400b").tolist() == [32, 0x10428, ord("b"), 32]


def test_weights_are_those_of_the_two_models(spark):
    rnd = random.Random(5)
    docs = [(i, prose(rnd, "en", 40) + " x" * (i % 3)) for i in range(40)] + [(100 + i, " ".join("%%" + w for w in prose(rnd, "de", 30).split())) for i in range(10)] + [(200, None), (201, " ")]
    labels = [(i, 1) for i in range(0, 40, 2)] + [(100 + i, 0) for i in range(0, 10, 2)] + [(0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in quality.resample(df, spark.createDataFrame(labels, "doc_id long, quality int"), fraction=0.3).collect()}
    bits, whole = 16, (1 << 64) - 1

    def grams(text):
        h = [xxhash.xxh64_intdigest(t) for t in quality.TOKEN.findall((text or "").lower())]
        pairs = [((a * 0x9E3779B97F4A7C15 + b) * 0xBF58476D1CE4E5B9) & whole for a, b in zip(h, h[1:])]
        return [x >> (64 - bits) for x in [(a * 0x9E3779B97F4A7C15) & whole for a in h] + pairs]

    raw, target, texts = Counter(), Counter(), dict(docs)
    for _, t in docs:
        raw.update(grams(t))
    for i, q in labels:
        target.update(grams(texts[i]) * q)
    ratio = lambda g: math.log((target[g] + 1) / (target.total() + 2**bits)) - math.log((raw[g] + 1) / (raw.total() + 2**bits))
    for i, t in docs:
        own = [ratio(g) for g in grams(t)]
        if not own:
            assert got[i]["weight"] is None and not got[i]["keep"]
            continue
        assert got[i]["weight"] == pytest.approx(sum(own) / (len(own) + 8)) and got[i]["log_weight"] == pytest.approx(sum(own))
    bad, good = [got[i]["weight"] for i, q in labels if not q], [got[i]["weight"] for i, q in labels if q]
    assert max(bad) < min(good) and all(r["keep"] == (r["weight"] > max(bad)) for r in got.values() if r["weight"] is not None and not max(bad) < r["weight"] < min(good))
    top = sorted(got.values(), key=lambda r: -r["gumbel_key"])[: round(0.3 * len(docs))]
    assert {r["doc_id"] for r in top} == {r["doc_id"] for r in got.values() if r["sampled"]}


def test_gumbel_top_with_equal_ids(spark):
    for ids in ([7] * 10, [None] * 10, [7, 7, 7, None, None, 1, 2, 3, 4, 5]):
        df = spark.createDataFrame([(i, 1.0) for i in ids], "doc_id long, x double").repartition(3)
        for k in (0, 1, 3, 10, 12):
            assert quality.gumbel_top(df, "x", k).filter("sampled").count() == min(k, 10)


def test_tokens_of_long_white_space():
    enc = token_counts.encoder(BYTE, P.PATTERN)[0]
    rnd = random.Random(2)
    for end in ("", "x", "1", "!", "\nq", "　z"):
        text = "ab" + "".join(rnd.choice(" \n\t　") for _ in range(10_050)) + end
        assert token_counts.token_ids(text, BYTE, P.PATTERN).tolist() == enc.encode_ordinary(text)
    text = "a" + " " * 1_200_000 + "b" + "\n" * 1_200_000
    first, stop = token_counts.token_spans(text, BYTE, P.PATTERN)
    assert first[0] == 0 and stop[-1] == len(text) and (first[1:] == stop[:-1]).all()
    for n in (1, 198, 199, 200, 201, 202, 4_999):  # around the length from which runs are cut out
        for made in (" " * n, "\n" * n, "".join(rnd.choice(" \n\t\u3000\x85") for _ in range(n))):
            for text in (made, "a" + made, made + "b", "a" + made + "b" + made + "\nc", "x " + made + "  9"):
                assert token_counts.token_ids(text, BYTE, P.PATTERN).tolist() == enc.encode_ordinary(text)
    began, text = time.perf_counter(), ("a" + " " * 9_999) * 200
    assert len(token_counts.token_ids(text, BYTE, P.PATTERN)) > 400 and time.perf_counter() - began < 5


def test_word_bpe_reads_added_tokens_as_the_library_does():
    from tokenizers import Tokenizer

    fresh, own = Tokenizer.from_file(WORD), wordbpe.WordBpe(WORD)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x <|ENDOFTEXT|>", "plain", "<|startoftext|>é中", "", "<|endoftext"]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.ids(texts)] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_equal_brute_force(spark):
    rnd = random.Random(3)
    docs = [(i, " ".join(f"{rnd.choice('abcdefg')}{rnd.randrange(12)}" for _ in range(rnd.randrange(0, 60)))) for i in range(80)] + [(90, "rare1 rare2"), (91, None), (92, "Rare2, rare1!")]
    low, high = 0.05, 0.5
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), low, high).collect()}
    import regex

    hashes = lambda text: sorted({signed(xxhash.xxh64_intdigest(t, 42)) for t in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if t})
    df = Counter(h for _, t in docs for h in hashes(t))
    n = sum(t is not None for _, t in docs)
    bit = lambda h: h % (1 << fingerprint.LEXICON_BITS)
    lexicon = {bit(h) for h, c in df.items() if low * n <= c <= max(2, high * n)}

    def parts(text):
        every = hashes(text)
        kept = [h for h in every if bit(h) in lexicon]
        kept = every if len(kept) < fingerprint.FEW else kept

        def chained(values, last):
            seed = 42
            for v in values:
                seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
            return xxhash.xxh64_intdigest(struct.pack("<i", last), seed)

        chosen = [(rate * 100 + k, [h for h in kept if (h >> (8 * k)) % rate == 0]) for rate in fingerprint.RATES for k in range(fingerprint.EACH)]
        if kept and not any(c for _, c in chosen):
            return [chained(kept, last) for last, _ in chosen]
        return [chained(c, last) if c else 0 for last, c in chosen]

    def alike(a, b):
        shares = []
        for g in range(0, len(a), fingerprint.EACH):
            pairs = [(x, y) for x, y in zip(a[g : g + fingerprint.EACH], b[g : g + fingerprint.EACH]) if x or y]
            if pairs:
                shares.append(sum(x == y for x, y in pairs) / len(pairs))
        return max(shares, default=1.0)

    texts = [t or "" for _, t in docs]
    for (i, t), nxt in zip(docs, texts[1:] + texts[:1]):
        t = t or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        own, other, follow = parts(t), parts(edited), parts(nxt)
        assert got[i]["fingerprint"] == "".join(f"{x:016x}" for x in own) and got[i]["edited_fingerprint"] == "".join(f"{x:016x}" for x in other)
        assert got[i]["near_edited"] == pytest.approx(alike(own, other)) and got[i]["near_next"] == pytest.approx(alike(own, follow))
    assert got[90]["fingerprint"] == got[92]["fingerprint"]


def test_media_equal_brute_force(spark):
    rnd = random.Random(4)
    texts = ["", "short", prose(rnd, "fr", 150), "日本" * 900, prose(rnd, "en", 2000), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def brute_hash(image):
        def mean(y0, y1, x0, x1):
            total = 0.0
            for y in range(int(y0), math.ceil(y1)):
                for x in range(int(x0), math.ceil(x1)):
                    total += (min(y1, y + 1) - max(y0, y)) * (min(x1, x + 1) - max(x0, x)) * float(image[y, x])
            return total / ((y1 - y0) * (x1 - x0))

        h, w = image.shape
        small = [[mean(r * h / 8, (r + 1) * h / 8, c * w / 9, (c + 1) * w / 9) for c in range(9)] for r in range(8)]
        bits = "".join("1" if row[c + 1] - row[c] > 1e-9 else "0" for row in small for c in range(8))
        return f"{int(bits, 2):016x}"

    stored = {r["doc_id"]: r for r in media.media_table(df).collect()}
    for r in media.media_documents(df).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        full = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        tiles = np.frombuffer(full, np.uint8).reshape(-1, 24, 24)
        out = io.BytesIO()
        np.save(out, tiles)
        assert bytes(stored[r["doc_id"]]["media"]) == out.getvalue() and r["media_bytes"] == len(out.getvalue())
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(full), zlib.crc32(full[-32:]))
        assert r["feature"] == brute_hash(tiles.reshape(-1, 24)) + brute_hash(tiles.mean(axis=0))
    grey = np.arange(24 * 48, dtype=np.uint8).reshape(48, 24)
    assert (media.decode(media.encode_bmp(grey))[..., 1] == grey).all()


def test_shards_depend_on_values_alone(spark):
    data = [(i % 400, f"t{i % 400}") for i in range(500)] + [(5, "other"), (None, "a"), (None, "a"), (None, None)] + [(1000, "same")] * 300
    df = spark.createDataFrame(data, "doc_id long, text string")
    before, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    chunk, sharding.CHUNK = sharding.CHUNK, 70
    try:
        for n in (3, 5):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            out.append(sorted(map(str, sharding.shard_rows(df.repartition(n)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        sharding.CHUNK = chunk
    assert out[0] == out[1] and len(out[0]) == len(data)
    rows = sharding.shard_rows(df).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])
    assert [r["row_number"] for r in sorted(rows, key=lambda r: (key(r), r["row_number"]))] == list(range(len(data)))
    a, b = sharding.network(len(data))

    def place(x):
        left, right = divmod(x, b)
        for i, (u, v, w) in enumerate(sharding.round_keys(20_011)):
            mix = lambda h: ((h * u + v) % sharding.PRIME) * ((h + w) % sharding.PRIME) % sharding.PRIME  # noqa: B023, E731
            if i % 2 == 0:
                left = (left + mix(right)) % a
            else:
                right = (right + mix(left)) % b
        x = left * b + right
        return x if x < len(data) else place(x)

    assert all((r["shard"], r["slot"]) == (place(r["row_number"]) % 16, place(r["row_number"]) // 16) for r in rows)


def test_the_suffix_array_decides_what_structure_does_not(spark):
    notice = "home news about contact us terms and conditions apply to all visitors"
    data = [(i, f"http://a.org/{i}", f"<div>{notice}</div><main><h1>Title {i}</h1><article><p>body {i}</p></article></main><div>{notice}</div>") for i in range(5)]
    data += [(10 + i, f"http://b.org/{i}", f"<div>{notice}</div><article><p>body {i}</p></article>") for i in range(2)]
    data += [(20, "http://a.org/x", "<article><p>only</p></article><footer>f</footer>"), (20, "http://a.org/x", "<article><p>only</p></article>"), (None, None, "<p>plain</p>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = [(r["page_id"], r["text"], r["n_covered"]) for r in html_text.main_texts(df, pages_each=2).collect()]
    by = {i: (t, n) for i, t, n in got}
    assert len(got) == len(data) and all(by[i] == (f"Title {i}\nbody {i}", 24) for i in range(5))
    assert all(by[10 + i] == (f"{notice}\nbody {i}", 0) for i in range(2))  # two pages are no proof
    assert by[20] == ("only", 0) and by[None] == ("plain", 0)


def test_the_suffix_array_sees_every_page_and_leaves_articles_whole(spark):
    notice = "this page is kept by volunteers who ask for help with the costs of running it"
    n = len(notice.split())
    data = [(i, f"http://n.org/{i}", f"<article><p>story {i}</p><p>{notice}</p></article><footer>{notice}</footer>") for i in range(6)]
    data += [(10, "http://n.org/10", f"<article><p>as said: {notice}</p></article>"), (11, "http://m.org/1", f"<article><p>{notice}</p></article>"), (12, "http://n.org/12", f"<div>{notice}</div><p>unique words</p>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    for each in (2, 512):
        got = {r["page_id"]: (r["text"], r["n_covered"], r["n_repeated"]) for r in html_text.main_texts(df, pages_each=each).collect()}
        assert all(got[i] == (f"story {i}\n{notice}", 0, n) for i in range(6))
        assert got[10] == (f"as said: {notice}", 0, 0) and got[11] == (notice, 0, 0) and got[12] == ("unique words", n, n)


def test_pages_of_odd_markup():
    text = lambda page: [t for k, t in html_text.page_blocks(page) if k != html_text.RULED_OUT]
    assert text('<article><div class="article-header"><h1>T</h1></div><p class="ad-hoc">a <math><mi>x</mi></math> b</p><div class="ad-slot">no</div><p id="comments">c</p></article>') == ["T", "a x b"]
    assert text('<article><div class="site-footer">f</div><div class="cookie-bar">g</div><div class="nav-list">h</div><p class="related-posts">i</p><p>5 < 6 "q</p>') == ['5 < 6 "q']
    for piece in ('<a "x ', '<a "" ', '<a ">" ', "<script ", "<!-- ", "<a '>\" ", "<svg>", '<p class="x', "<", "</", "<a \"x\" ><b 'y "):
        began = time.perf_counter()
        html_text.page_blocks(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - began < 8, piece


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as c

    rnd = random.Random(12)
    shape = "doc_id long, text string, lang string, source string, n_chars long, lang_pred int, score string, weight int, i int, h int, component_id int, _c0 int"
    base, other = prose(rnd, "en", 90), prose(rnd, "de", 90)
    texts = [(i, prose(rnd, ("en", "de")[i % 2], 70), ("en", "de")[i % 2]) for i in range(40)]
    texts += [(100, base, "en"), (101, base + " tail", "en"), (101, other, "de"), (101, other, "de"), (None, base + " end", "en"), (None, prose(rnd, "de", 60), "de"), (200, None, "en"), (201, "", "de"), (202, prose(rnd, "en", 30_000), "en")]
    df = spark.createDataFrame([(*t, "s", 1, 1, "x", 2, 3, 4, 5, 6) for t in texts], shape)
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    near = c.near_duplicates(spark, df, str(tmp_path))
    assert near.columns == df.columns
    kept = Counter((r["doc_id"], r["text"]) for r in near.collect())
    assert kept == Counter({(i, t) for i, t, _ in texts} - {(101, base + " tail"), (None, base + " end")})
    for name, stage in c.STAGES[:2]:
        out = stage(spark, df, str(tmp_path))
        ids = {r["doc_id"] for r in out.collect()}
        assert out.columns == df.columns and ids >= {*range(40), 100, 101, 202, None} and not ids & {200, 201}, name
    for _, stage in c.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
