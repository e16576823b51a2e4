"""Each operator against brute force, round trips or held-out rows, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from conftest_rows import prose, rows
from pyspark.sql import functions as F

from gleanstone.llm import bytebpe, fingerprint, graph, html_text, langid, media, ngram_join, packing, quality, sharding, token_counts, wordbpe
from gleanstone.llm.queries import tokenizer_file

WORD, BYTE, MULTI = (tokenizer_file(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"))


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_language_id(odd, none):
    found = langid.predict_languages(odd, per_language=40).toPandas()
    assert len(found) == odd.count() and found.score.between(0, 1).all()
    both = found.merge(pd.DataFrame(rows(), columns=["doc_id", "text", "lang"]).dropna(subset=["doc_id"]).drop_duplicates("doc_id"), on="doc_id")
    held = both[(both.doc_id < 60) & both.held_out]
    assert len(held) > 5 and (held.lang_pred == held.lang).mean() > 0.9
    for i in (300, 301, 302, 305, 310):
        assert (both.lang_pred[both.doc_id == i] == "und").all() and (both.score[both.doc_id == i] == 0).all()
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(int(i)).encode()) % 3 == 1)).all()
    assert langid.predict_languages(none).count() == 0
    unlabelled = langid.predict_languages(odd.withColumn("lang", F.lit(None).cast("string"))).toPandas()
    assert (unlabelled.lang_pred == "und").all()


def test_ftrl_is_sparse_and_temperature_calibrates():
    rnd = np.random.default_rng(0)
    y = rnd.integers(0, 2, 300)
    data = [(np.array([int(c), 2 + int(rnd.integers(0, 40))]), np.ones(2)) for c in y]
    w, _ = langid.fit_ftrl(data, y, 2, 64, l1=1.0, l2=0.1, alpha=0.5)
    assert (w == 0).mean() > 0.5 and w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    z = np.stack([np.where(y == 0, 8.0, -8.0), np.where(y == 1, 8.0, -8.0)], 1)
    z[:60] = -z[:60]
    t = langid.fit_temperature(z, y)
    p = langid._softmax(z / t).max(1).mean()
    assert t > 1 and abs(p - 0.8) < 0.05


def brute_components(data, k, num, den):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(data):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(data, sets))}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_ngram_join_equals_brute_force(spark, odd, k, num):
    rnd = random.Random(k)
    data = [(r[0], r[1]) for r in rows() if r[0] is not None][:-1]
    for g in range(8):  # groups whose members differ by more and more edits, so that links form chains
        w = prose(rnd, "de", rnd.randrange(20, 400)).split()
        for j in range(12):
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            data.append((1000 + 20 * g + j, " ".join(w)))
    want = brute_components(data, k, num, 100)
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("k1", F.lit(2)).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, k, num, 100, bits=16).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_ngram_join_finds_every_link(spark, none):
    rnd = random.Random(3)
    data = []
    for g in range(4):
        w = prose(rnd, "de", 150).split()
        for j in range(14):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            data += [(100 * g + j, " ".join(w))] + ([(1000 + 100 * g + j, " ".join(w))] if j % 5 == 0 else [])
    sets = {i: {tuple(t.split()[x : x + 4]) for x in range(len(t.split()) - 3)} for i, t in data}
    firsts = [i for i in sets if i < 1000]
    want = {(a, b, len(sets[a] & sets[b])) for a in firsts for b in firsts if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = ngram_join.near_links(df, 4, 80, 100, bits=16).collect()
    assert len(got) == len(want) and {(r["a"], r["b"], r["n_shared"]) for r in got} == want
    assert len(want) > 2 * len(firsts)
    for parts in ({"block": 5, "together": 200}, {"shingles": 400}):
        found = ngram_join.near_links(df, 4, 80, 100, bits=16, **parts).collect()
        assert len(found) == len(want) and {(r["a"], r["b"], r["n_shared"]) for r in found} == want
    n_links = Counter(x for a, b, _ in want for x in (a, b))
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(df, 4, 80, 100, bits=16).collect()} == {i: n_links[i % 1000] for i in sets}
    assert ngram_join.near_links(none, bits=16).count() == 0


@pytest.mark.parametrize("block", [1024, 40])
def test_ngram_join_of_a_large_family(spark, block):
    rnd = random.Random(9)
    base = prose(rnd, "en", 120).split()
    data = []
    for i in range(400):  # sizes and edits vary, so that some link, some do so over others, and some do not
        w = [f"{x}{j}" for j, x in enumerate(base)][: rnd.randrange(60, 121)]
        for _ in range(rnd.randrange(0, 7)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        data.append((i, " ".join(w)))
    sets = [frozenset(zip(*[t.split()[x:] for x in range(4)])) for _, t in data]
    groups = defaultdict(list)
    for i, x in enumerate(sets):
        groups[x].append(i)
    firsts = [v[0] for v in groups.values()]
    n_links = {i: sum(j != i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for j in firsts) for i in firsts}
    want = brute_components(data, 4, 85, 100)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = ngram_join.near_duplicates(df, 4, 85, 100, block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert {r["doc_id"]: r["n_links"] for r in got if r["doc_id"] in n_links} == n_links
    assert len({c for _, c in want.values()}) > 20 and max(n_links.values()) > 20


def test_ngram_join_odd_rows(odd, none):
    got = ngram_join.near_duplicates(odd, bits=16).toPandas()
    assert len(got) == odd.count()
    assert (got.component_id[got.doc_id.isin([300, 301, 302, 310])] == got.doc_id[got.doc_id.isin([300, 301, 302, 310])]).all()
    assert got[(got.n_shingles == 0)].shape[0] == 4
    assert ngram_join.near_duplicates(none, bits=16).count() == 0
    words = [f"w{i}" for i in range(60)]
    same_id = [(2**60 + 1, " ".join(words)), (2**60 + 1, "other text altogether with few words"), (2**60 + 3, " ".join([*words, "end"])), (None, " ".join(["lead", *words]))]
    got = ngram_join.near_duplicates(odd.sparkSession.createDataFrame(same_id, "doc_id long, text string"), bits=16).toPandas()
    assert sorted(got.component_id) == [2**60 + 1] * 4


def test_signatures_never_miss_a_link():
    rnd = np.random.default_rng(5)
    U = np.uint64
    for _ in range(400):
        n = int(rnd.integers(6, 900))
        base = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        counts = {int(x): int(c) for x, c in zip(base, rnd.integers(1, 60, n))}
        gone = int(rnd.integers(0, max(1, n // 7)))
        other = np.unique(np.concatenate((rnd.permutation(base)[gone:], rnd.integers(0, 2**63, int(rnd.integers(0, 1 + n // 8)), dtype=np.uint64))))
        both = len(np.intersect1d(base, other))
        if 100 * both >= 85 * (len(base) + len(other) - both) and len(base) != both != len(other):
            a, b = (ngram_join.signatures(s, np.array([counts.get(int(x), 1) for x in s]), 30, 85, 100) for s in (base, other))
            assert len(np.intersect1d(a, b)), (len(base), len(other), both)
            assert ngram_join.sketch_difference(ngram_join.sketch(base), ngram_join.sketch(other)) <= len(base) + len(other) - 2 * both
    assert U(1)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in list(up)}


def test_quality(spark, odd, none):
    rnd = random.Random(2)
    bad = [(2000 + i, " ".join(w + "%%%" for w in prose(rnd, "en", 60).split()), 0) for i in range(30)]
    good = [(3000 + i, prose(rnd, "en", 60), 1) for i in range(60)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t, _ in bad + good], "doc_id long, text string")).withColumn("weight", F.lit(1))
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in bad[::2] + good[::2]] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.resample(docs, labels, fraction=0.4).toPandas()
    assert len(got) == docs.count() and got.sampled.sum() == round(0.4 * len(got))
    by = got.set_index("doc_id")
    assert not by.keep[[i for i, _, _ in bad]].any() and by.keep[[i for i, _, _ in good]].mean() > 0.9
    assert by.weight[[300, 301, 302, 310]].isna().all() and not by.keep[[300, 301, 302, 310]].any()
    cut = got.gumbel_key[got.sampled].min()
    assert (got.gumbel_key[~got.sampled] <= cut).all()
    assert quality.resample(none, labels).count() == 0
    assert quality.resample(docs, labels.limit(0)).count() == docs.count()


def test_gumbel_top_is_exact_with_ties(spark):
    for k in (0, 1, 7, 20, 40, 50):
        df = spark.createDataFrame([(i, float(i // 5)) for i in range(40)], "doc_id long, x double")
        got = quality.gumbel_top(df, "x", k).toPandas()
        assert got.sampled.sum() == min(k, 40)
        assert not got.sampled.any() or got.x[got.sampled].min() >= got.x[~got.sampled].max() if k < 40 else True


def test_token_counts(spark, odd, none):
    import tiktoken

    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(BYTE), special_tokens={})
    got = token_counts.document_token_counts(odd, BYTE, P.PATTERN).toPandas()
    sums = got.groupby("doc_id", dropna=False).agg(n=("n_tokens", "sum"), size=("length", "sum"))
    for r in odd.collect():
        parts = [x for x in (r["source"], r["lang"], r["text"]) if x is not None]
        times = sum(x["doc_id"] == r["doc_id"] for x in odd.collect()) if r["doc_id"] == 0 else 1
        key = sums.loc[r["doc_id"]] if r["doc_id"] is not None else sums[sums.index.isna()].iloc[0]
        assert key.n == times * len(e.encode_ordinary("\n".join(parts))), r["doc_id"]
        assert key["size"] == times * len("\n".join(parts))
    assert token_counts.document_token_counts(none, BYTE, P.PATTERN).count() == 0
    table = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "", "x")], "doc_id long, a string, b string")
    rows_ = token_counts.count_tokens(table, ["a", "b"], BYTE, P.PATTERN).toPandas()
    assert rows_.id.tolist() == [1, 3, 3]
    with pytest.raises(ValueError):
        token_counts.count_tokens(table, ["a"], BYTE, P.PATTERN, rule="other")


def test_crossing_tokens_follow_the_rule():
    first, stop, starts = np.array([0, 3, 8]), np.array([3, 8, 9]), np.array([0, 4, 4, 9])
    assert token_counts.attributed(first, stop, starts, 9, "start")[0].tolist() == [2, 0, 1, 0]
    tokens, crossing = token_counts.attributed(first, stop, starts, 9, "most")
    assert tokens.tolist() == [1, 0, 2, 0] and crossing.sum() == 1


def test_fingerprints(spark, odd, none):
    data = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda x: (-1 if x[0] is None else x[0], x[1]))
    got = fingerprint.fingerprint_documents(odd, low=0.02, high=0.9).toPandas()
    want = Counter()
    for (i, t), (_, nxt) in zip(data, data[1:] + data[:1]):
        want[(i, len(t), sha((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode("utf-8")))] += 1
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_chars, r.edited_sha256) for r in got.itertuples()) == want
    texts = {i: t for i, t in data}
    by = defaultdict(set)
    for r in got.dropna(subset=["doc_id"]).itertuples():
        by[texts[int(r.doc_id)]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    prose_rows = got[got.doc_id < 60]
    assert prose_rows.near_edited.mean() > prose_rows.near_next.mean()
    assert fingerprint.fingerprint_documents(none).count() == 0
    one = fingerprint.fingerprint_documents(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == sha(b"abab") and one["near_next"] == 1.0


def test_fingerprints_of_texts_outside_the_lexicon(spark):
    data = [(i, " ".join(f"common{(i + x) % 40}" for x in range(12))) for i in range(400)]
    data += [(1000 + i, " ".join(f"rare{i}x{x}" for x in range(1 + 5 * i))) for i in range(8)] + [(1100, "rare3x0 " * 2 + " ".join(f"rare3x{x}" for x in range(16)))]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(spark.createDataFrame(data, "doc_id long, text string"), low=0.02, high=0.9).collect()}
    rare = [got[1000 + i]["fingerprint"] for i in range(8)]
    assert len(set(rare)) == 8 and not any(set(f) == {"0"} for f in rare)
    assert got[1100]["fingerprint"] == rare[3]
    assert all(got[1000 + i]["near_next"] < 1 for i in range(7))


def test_next_rows_over_many_buckets(spark):
    ids = random.Random(1).sample(range(10**6), 2500)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    rows_ = fingerprint.with_next(df, "own", F.length("text"), per_range=100).collect()
    assert all(r["own"] == len(r["text"]) and r["next_own"] == len(r["next_text"]) for r in rows_)
    got = {r["doc_id"]: r["next_text"] for r in rows_}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


def test_word_bpe_equals_the_library():
    w = wordbpe.WordBpe(WORD, keep=400)
    rnd = random.Random(4)
    pools = ["".join(map(chr, range(256))) + "'s't're've'll", "aB'stre  \n\x1c\x85\xa0éßÀ²½9!?.µΣσİ日ﬁ́ \x01"]
    for pool in pools:
        texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(30))) for _ in range(600)] + ["<|endoftext|>", ""]
        want = [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(b, "<u4").tolist() for b in w.ids(texts)] == want


def test_plans_use_every_piece_once():
    rnd = random.Random(6)
    for _ in range(200):
        counts = {rnd.randrange(1, 65): rnd.randrange(1, 9) for _ in range(rnd.randrange(12))}
        plan, used = packing.plan_packing(counts, 64), Counter()
        for held, n in plan:
            assert n > 0 and sum(a * k for a, k in held) <= 64
            for a, k in held:
                used[a] += k * n
        assert used == Counter(counts)
    exact = packing.plan_packing({40: 10, 24: 10, 30: 5, 20: 5, 14: 5, 10: 3, 8: 3, 33: 3, 13: 3}, 64)
    assert sum(n for _, n in exact) == 18  # all filled exactly
    with pytest.raises(ValueError):
        packing.plan_packing({65: 1}, 64)


def test_packing(odd, none):
    got = packing.pack_documents(odd, WORD).toPandas()
    t = wordbpe.WordBpe(WORD).tokenizer
    want = Counter()
    for r in odd.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[(r["doc_id"], k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 4096 and s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1
    assert packing.pack_documents(none, WORD).count() == 0


def test_media(odd, none):
    got = media.media_documents(odd).toPandas()
    assert len(got) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        raw = (texts[int(r.doc_id)] or "").encode()
        full = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), sha(full), zlib.crc32(full[-32:]))
    assert media.media_documents(none).count() == 0


def test_decoders(spark):
    import struct

    rnd = np.random.default_rng(1)
    grey = rnd.integers(0, 256, (5, 7), dtype=np.uint8)
    assert (media.decode_netpbm(media.encode_pgm(grey))[..., 0] == grey).all()
    assert (media.decode_netpbm(b"P2 # note\n7 5\n255\n" + b" ".join(str(x).encode() for x in grey.ravel()))[..., 0] == grey).all()
    rgb = rnd.integers(0, 256, (3, 5, 3), dtype=np.uint8)
    assert (media.decode_netpbm(b"P6\n5 3\n255\n" + rgb.tobytes()) == rgb).all()
    bits = rnd.integers(0, 2, (3, 11), dtype=np.uint8)
    assert (media.decode_netpbm(b"P4\n11 3\n" + np.packbits(bits, axis=1).tobytes())[..., 0] == (1 - bits) * 255).all()
    assert (media.decode_netpbm(b"P1\n11 3\n" + b"".join(b"%d" % b for b in bits.ravel()))[..., 0] == (1 - bits) * 255).all()
    deep = rnd.integers(0, 65536, (2, 3)).astype(np.uint16)
    assert (media.decode_netpbm(b"P5\n3 2\n65535\n" + deep.astype(">u2").tobytes())[..., 0] == deep).all()
    rows_ = b"".join(r[:, ::-1].tobytes().ljust(16, b"\0") for r in rgb[::-1])
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(rows_), 0, 0, 54, 40, 5, 3, 1, 24, 0, len(rows_), 0, 0, 0, 0)
    assert (media.decode_bmp(head + rows_) == rgb).all()
    palette = bytes(x for i in range(256) for x in (i, 255 - i, 7, 0))
    body = b"".join(r.tobytes().ljust(8, b"\0") for r in grey[::-1])
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54 + 1024, 40, 7, 5, 1, 8, 0, len(body), 0, 0, 256, 0)
    shown = media.decode_bmp(head + palette + body)
    assert (shown[..., 2] == grey).all() and (shown[..., 0] == 7).all()
    for broken in (b"", b"P5\n9 9\n255\n12", b"P7\n", b"BM123", head[:60]):
        assert media.decode(broken) is None
    big = rnd.integers(0, 256, (30, 45, 1)).astype(np.uint8)
    assert np.allclose(media.area_resize(big, 10, 9)[..., 0], big[..., 0].reshape(10, 3, 9, 5).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(big, 7, 11).mean(), big.mean())
    ramp = np.tile(np.arange(90), (80, 1)).astype(np.uint8)[..., None]
    assert media.difference_hash(ramp) == "ff" * 8 and media.difference_hash(ramp[:, ::-1]) == "00" * 8
    tiles = media.decode_table(spark.createDataFrame([(1, bytearray(media.encode_pgm(grey))), (2, bytearray(b"no")), (3, None)], "f int, d binary"), "f", "d", 4).toPandas()
    assert sorted(tiles.id) == [1, 1, 1, 1, 2, 3] and tiles[tiles.id > 1].npy.isna().all()
    import io

    assert np.load(io.BytesIO(tiles.npy[0])).shape == (4, 4, 1)


def test_sharding(spark, odd, none):
    got = sharding.shard_rows(odd).toPandas()
    assert len(got) == odd.count()
    counts = got.groupby("shard").slot
    assert counts.count().max() - counts.count().min() <= 1 and (counts.max() + 1 == counts.count()).all() and (counts.nunique() == counts.count()).all()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd.collect())
    own = zip(got.doc_id, got["size"], got.text_crc32)
    assert Counter((None if pd.isna(i) else int(i), n, c) for i, n, c in own) == want
    again = sharding.shard_rows(odd.repartition(7)).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert sharding.shard_rows(none).count() == 0
    assert sharding.shard_rows(spark.createDataFrame([(1, "a")], "doc_id long, text string")).first()["shard"] == 0


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        places = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 3)).collect()]
        assert sorted(places) == list(range(n))
        assert n < 100 or places != list(range(n))


def test_byte_bpe_equals_the_library(odd, none):
    import tiktoken

    ranks = bytebpe.read_ranks(MULTI)
    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = bytebpe.ByteBpe(ranks, P.PATTERN, keep=300)
    rnd = random.Random(8)
    pool = "aab'stre  \n\t\x1c\x85\xa0éß١9½!?.,<|>日本語ا́\U0001f600\x00​İ"
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(40))) for _ in range(1500)] + ["a" * 3000, " " * 50, "ab" * 500]
    ids = b.ids(texts)
    assert ids == [e.encode_ordinary(t) for t in texts] and [b.decode(i) for i in ids] == [t.encode() for t in texts]
    got = bytebpe.encode_digests(odd, MULTI, P.PATTERN).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        want = e.encode_ordinary(texts[int(r.doc_id)])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(",".join(map(str, want)).encode()), sha(texts[int(r.doc_id)].encode()))
    assert bytebpe.encode_digests(none, MULTI, P.PATTERN).count() == 0 and bytebpe.encode_table(none, MULTI, P.PATTERN).count() == 0
    table = bytebpe.encode_table(odd.filter("doc_id = 303"), MULTI, P.PATTERN).first()
    assert bytes(table["decoded"]) == b"one"


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu {i}</a></li></ul></nav><!-- ad -->"
    "<div class=\"ad\">Buy</div><article><h1>Head {i} &amp; more</h1><p><b>First   {i}.<br><p>Second&nbsp;x</p><div class='comments'><p>Nice!</p></div></article><footer>&copy; x</footer>"
)


def test_html(spark):
    data = [(i, f"https://h{i % 2}.example.com/{i}", PAGE.format(i=i)) for i in range(12)]
    data += [(100, None, None), (101, "http://u@H0.example.com:80/", ""), (102, "x", "just text < 3 &lt;b&gt;"), (0, data[0][1], data[0][2])]
    plain = "home news about contact us terms and conditions apply to all visitors"
    data += [(200 + i, f"http://plain.org/{i}", f"<body><div>{plain}</div><p>q{i} r{i} s{i} t{i}</p><form>f</form>") for i in range(6)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("host", F.lit(1))
    got = html_text.main_texts(df, pages_each=8).toPandas()
    assert len(got) == len(data)
    by = got.drop_duplicates("page_id").set_index("page_id").text
    assert by[3] == "Head 3 & more\nFirst 3.\nSecond x" and by[100] == "" and by[101] == "" and by[102] == "just text < 3 <b>"
    assert [by[200 + i] for i in range(6)] == [f"q{i} r{i} s{i} t{i}" for i in range(6)]
    assert (got.n_chars == got.text.str.len()).all()
    assert html_text.main_texts(df.limit(0)).count() == 0


def test_html_keeps_what_an_article_says():
    def text(inner):
        return [t for k, t in html_text.page_blocks(f"<html><body>{inner}</body></html>") if k == html_text.ARTICLE]

    assert text('<article><p class="ad">buy<p>real one</p><p>two</p></article>') == ["real one", "two"]
    assert text('<article><p>a</p><div class="ad">buy <b>now</b></article><article><p>b</p></article>') == ["a", "b"]
    assert text('<article><div class="ad"><article>nested ad</article></div><p>b</p></article>') == ["b"]
    assert text('<article><h2 id="social-sciences">S</h2><section id="related-work"><h2>R</h2><p>x</p></section><p id="comment-on-the-text">c</p><p class="share-price">9</p></article>') == ["S", "R", "x", "c", "9"]
    assert text('<article><p>a</p><div class="share-buttons">s</div><div class="related-posts">r</div><div id="comments">c</div><p class="promo">p</p><section class="comments">k</section></article>') == ["a"]
    assert text('<article><ul><li class="ad"><p>buy</p><ul><li>x<li>y</ul></li><li>kept</li><li class="ad">buy</ul><p>z</p></article>') == ["kept", "z"]
    assert text('<article><ul><li class="ad">buy<li>kept</ul><p>z</p></article>') == ["kept", "z"]


def test_html_counts_runs_over_the_whole_host(spark):
    notice = "this section is closed until further notice please come back"
    data = [(i, f"http://big.org/{i}", f"<body><p>q{i} r{i} s{i} t{i}</p>" + (f"<div>{notice}</div>" if i % 20 == 0 else "") + "</body>") for i in range(80)]
    data += [(0, "http://big.org/again", data[0][2]), (1, "http://small.org/1", f"<p>{notice}</p>"), (2, "http://small.org/2", f"<p>{notice}</p>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    for each in (8, 512):
        got = {r["url"]: r["text"] for r in html_text.main_texts(df, pages_each=each).collect()}
        assert len(got) == len(data)
        assert all(got[f"http://big.org/{i}"] == f"q{i} r{i} s{i} t{i}" for i in range(80))
        assert got["http://small.org/1"] == notice


def test_suffix_array_and_coverage():
    rnd = np.random.default_rng(2)
    for _ in range(40):
        text = rnd.integers(0, 4, int(rnd.integers(1, 60)))
        order, classes = html_text.suffix_array(text, 4)
        tails = [tuple(text[i:]) for i in range(len(text))]
        assert [tails[i] for i in order] == sorted(tails) or len(text) < 2
        for i in range(len(text)):
            for j in range(len(text)):
                if i + 4 <= len(text) and j + 4 <= len(text):
                    assert (classes[i] == classes[j]) == (tails[i][:4] == tails[j][:4])


def test_corpus_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    rnd = random.Random(11)
    docs = [(i, prose(rnd, "en" if i % 2 else "de", 80), "en" if i % 2 else "de", "s", 1) for i in range(80)]
    docs += [(100 + i, docs[i][1] + " tail", docs[i][2], "s", 1) for i in range(10)] + [(200 + i, " ".join(w + "&&&" for w in prose(rnd, "en", 80).split()), "en", "s", 1) for i in range(20)]
    docs += [(300, None, None, "s", None), (301, "?!", "en", "s", 2)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, shape).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)] + [(200 + i, 0, 0) for i in range(0, 20, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows_, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, rows_, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        rows_ = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"] for r in rows_.select("doc_id").collect()})
        if k < len(c.STAGES) - 1:
            assert rows_.columns == [x.split()[0] for x in shape.split(", ")]
    assert kept[0] == {d[0] for d in docs} - {300, 301}
    assert not kept[1] & {200 + i for i in range(20)} and len(kept[1] & set(range(80))) > 75
    assert kept[2] == kept[1] - {100 + i for i in range(10)} and kept[3] == kept[2]
    assert {r["doc_id"] for r in c.run(spark, str(tmp_path)).collect()} == kept[3]
