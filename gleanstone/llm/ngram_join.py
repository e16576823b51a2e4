"""Near duplicates by the Jaccard similarity of word n-grams, with token-combination prefixes.

The shingles of a text are put in one global order, rare ones first. A prefix of that order is indexed: rare shingles each by themselves,
frequent ones as pairs out of the same cell (a hash class of frequent shingles). A prefix is extended until

    rare shingles in it + sum over cells of max(0, shingles of the cell in it - 1)  >=  n - least overlap + 1.

If two texts overlapped enough and had no signature in common, then of the prefix that ends first in the global order
at most one shingle for each cell would be shared, and the rest of it, at least n - least overlap + 1 shingles, would be missing in the other text:
a contradiction. So every link has a common signature. Cells grow with the size of a text so that cells hold a few
shingles: sizes are cut into bands, and a text just above a band's start is also indexed in the band below it.

The order comes from a table of 2**bits counters over all texts (a shingle's counter may be shared; any order is right, a rare-first
one is fast); bits grow with the bytes of text, up to MOST_BITS. Equal sets are collapsed before. Candidates are verified exactly, on 64-bit shingle hashes, in one of two ways:

* A signature of at most SMALL texts gives their pairs, so candidates grow with the number of texts. Sketches (parities of hashed members) rule out most of them, the sets of the others are compared.
* Signatures of more texts join these to clusters (families of near copies). Within a cluster sets are compared block by block, as matrix products inside a task, and
  only blocks whose sizes allow a link meet. A task gives back, for each text, its number of links and one text that it is connected with: linear in the block, however many links there are.

Small clusters are dealt to tasks together; a large one is cut into blocks, with a task for each two of them.

Defined results: null and wordless texts have an empty set and link with nothing; texts of fewer than k words are one shingle;
repeated rows are kept, each with its component; null ids stay null (a component that has no other id is null); an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .storage import NO_ID, dropped, forget, given_id, held_id, part_dropped, small_batches, written

U = np.uint64
_rng = np.random.default_rng(99)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STEP, _A, _B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

#: Sizes of sets from which a band of cells starts, and its number of cells; below the first, all shingles count as rare.
BANDS = ((48, 16), (512, 128), (4096, 1024), (32768, 8192))
BLOCK = 1 << 15
BROADCAST_IDS = 1_000_000
#: Signatures of more texts than this make clusters.
SMALL = 8
LEAST_BITS, MOST_BITS = 16, 26
#: Signatures are grouped in so many slices of their values, one after the other: shuffle files of one slice are on disk at a time.
SLICES = 4


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _A
    x = (x ^ (x >> U(27))) * _B
    return x ^ (x >> U(31))


def shingle_sets(texts: list[str | None], k: int, most: int = 1 << 20) -> list[np.ndarray]:
    """Of each text, its sorted distinct 64-bit shingle hashes; texts of about `most` bytes are worked on at a time, so memory is bounded by that or by a text."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > most:
            out += _sets_of(held, k)
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    return out + _sets_of(held, k) if held else out


def _sets_of(raw: list[bytes], k: int) -> list[np.ndarray]:
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    stops = np.cumsum([len(r) + 1 for r in raw])
    word = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return [np.zeros(0, U) for _ in raw]
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    power = np.cumprod(np.full(int(sizes.max()), _STEP, U))
    within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    h = mixed(np.add.reduceat(_BYTE[buf[word]] * power[within], first) + sizes.astype(U) * _A)
    upto = np.searchsorted(starts, stops)
    n = len(h)
    full = np.zeros(n, U)
    if n >= k:
        acc = h[: n - k + 1].copy()
        for j in range(1, k):
            acc = mixed(acc * _STEP + h[j : n - k + 1 + j])
        full[: n - k + 1] = acc
    out, lo = [], 0
    for hi in upto.tolist():
        m = hi - lo
        if m == 0:
            out.append(np.zeros(0, U))
        elif m < k:
            acc = h[lo : lo + 1] + U(m)
            for j in range(1, m):
                acc = mixed(acc * _STEP + h[lo + j : lo + j + 1])
            out.append(mixed(acc))
        else:
            own = np.sort(full[lo : hi - k + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        lo = hi
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits for a set: sums of two hashes of its members."""
    a, b = mixed(s * _A + U(1)), mixed(s * _B + U(7))
    return int(np.add.reduce(a, dtype=U).astype(np.int64)), int((np.add.reduce(b, dtype=U) ^ np.bitwise_xor.reduce(a)).astype(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """Parities in at least twice as many bits as members, a power of two: a 32nd of the set's size."""
    bits = max(512, 1 << int(2 * len(s) - 1).bit_length())
    odd = np.bincount((mixed(s ^ _B) % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_difference(x: bytes, y: bytes) -> int:
    """In how many members two sets differ at least. A longer sketch is folded to the size of the other: parities of halves add up."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    elif len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def signatures(s: np.ndarray, counts: np.ndarray, frequent: float, num: int, den: int) -> np.ndarray:
    """The signatures of a set: counts are its shingles' counters; a link needs intersection * den >= num * union."""
    n = len(s)
    if n * den < num * (n + 1):  # no other set of any size can link with it
        return np.zeros(0, U)
    need = n - -(-num * n // den) + 1
    order = np.lexsort((s, counts))
    h, often = s[order], counts[order] > frequent
    out = []
    for band in range(len(BANDS) + 1):
        least = BANDS[band - 1][0] if band else 0
        above = BANDS[band][0] if band < len(BANDS) else None
        if n < least or (above is not None and n * num >= above * den):
            continue
        tag = mixed(np.array([band + 1], U))
        if not band or not often[:need].any():
            out.append(mixed(h[:need] ^ tag))
            continue
        cells = (mixed(h ^ _STEP) % U(BANDS[band - 1][1])).astype(np.int64)
        cells[~often] = -1
        rank = np.zeros(n, np.int64)  # of a frequent shingle among those of its cell
        at = np.flatnonzero(often)
        by = at[np.argsort(cells[at], kind="stable")]
        new = np.flatnonzero(np.diff(cells[by], prepend=-2))
        rank[by] = np.arange(len(by)) - np.repeat(new, np.diff(np.append(new, len(by))))
        gain = np.cumsum(np.where(often, rank > 0, True))
        stop = min(int(np.searchsorted(gain, need)) + 1, n)
        out.append(mixed(h[:stop][~often[:stop]] ^ tag))
        by = by[by < stop]
        for apart in range(1, int(rank[by].max(initial=0)) + 1):
            i, j = by[:-apart], by[apart:]
            same = cells[i] == cells[j]
            out.append(mixed(h[i[same]] * _STEP + mixed(h[j[same]] ^ tag)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def counter_bits(docs: DataFrame) -> int:
    """About a counter for every 32 bytes of text, so that the mean load stays the same until MOST_BITS (64 MB) is reached."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(math.ceil(math.log2(max(size, 1) / 32 + 1)), LEAST_BITS), MOST_BITS)


def _described(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """A row (doc_id, h: hash of the text, n, k1, k2, sketch) for each document; rows with a block hold counters of shingles, a task's distinct sets counted once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        counts, seen, waiting, held, salt = np.zeros(1 << bits, np.uint8), set(), [], 0, 0

        def settle() -> None:
            nonlocal held
            if waiting:
                at, times = np.unique((np.concatenate(waiting) >> U(64 - bits)).astype(np.uint32), return_counts=True)
                counts[at] = np.minimum(counts[at] + times, 255)
            waiting.clear()
            held = 0

        for batch in batches:
            rows = []
            for doc_id, h, s in zip(batch["doc_id"], batch["h"], shingle_sets(list(batch["text"]), k)):
                k1, k2 = set_key(s) if len(s) else (0, 0)
                rows.append((doc_id, h, len(s), k1, k2, sketch(s)))
                if len(s) and k1 not in seen:
                    seen.add(k1)
                    waiting.append(s)
                    held += len(s)
                    salt = k1 % 16
                    if held > 1 << 20:
                        settle()
            yield pd.DataFrame(rows, columns=["doc_id", "h", "n", "k1", "k2", "sketch"]).assign(block=pd.array([None] * len(rows), "Int32"), counts=None)
        settle()
        for b in range(-(-len(counts) // BLOCK) if seen else 0):
            part = counts[b * BLOCK : (b + 1) * BLOCK]
            if part.any():
                yield pd.DataFrame({"doc_id": [salt], "h": 0, "n": 0, "k1": 0, "k2": 0, "sketch": None, "block": pd.array([b], "Int32"), "counts": [zlib.compress(part.tobytes(), 1)]})

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInPandas(run, "doc_id long, h long, n long, k1 long, k2 long, sketch binary, block int, counts binary")


def level(count: np.ndarray | float) -> np.ndarray:
    """A count as one byte that orders as it does: eight steps for each doubling."""
    return np.minimum(8 * np.log2(1 + np.asarray(count, np.float64)), 255).astype(np.uint8)


def _counters(described: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """The levels of the counters of all tasks, summed by block in two steps, and their mean count."""

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(BLOCK, 1 << bits), np.uint32)
        for raw in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(raw), np.uint8)
        return pd.DataFrame({"block": pdf["block"][:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(BLOCK, 1 << bits), np.uint64)
        for raw in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(raw), np.uint32)
        return pd.DataFrame({"block": pdf["block"][:1], "counts": [zlib.compress(level(total).tobytes(), 1)], "total": [int(total.sum())]})

    part = described.filter("block is not null").groupBy("block", "doc_id").applyInPandas(first, "block int, counts binary")
    out, load = np.zeros(1 << bits, np.uint8), 0
    for r in part.groupBy("block").applyInPandas(rest, "block int, counts binary, total long").toLocalIterator():  # 2**bits bytes in all
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
        load += r["total"]
    return out, load / len(out)


def _signed(docs: DataFrame, k: int, counters: np.ndarray, load: float, bits: int, num: int, den: int) -> DataFrame:
    """(sig, k1), each set once for each task."""
    frequent = float(level(load + 4 * load**0.5 + 24))
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        seen: set[int] = set()
        for batch in batches:
            sigs, keys = [], []
            for s in shingle_sets(list(batch["text"]), k):
                if len(s) and (key := set_key(s)[0]) not in seen:
                    seen.add(key)
                    own = signatures(s, shared.value[(s >> U(64 - bits)).astype(np.int64)], frequent, num, den)
                    sigs.append(own)
                    keys.append(np.full(len(own), key, np.int64))
            if sigs:
                yield pd.DataFrame({"sig": np.concatenate(sigs).astype(np.int64), "k1": np.concatenate(keys)})

    return docs.select("text").mapInPandas(run, "sig long, k1 long")


def _few(table: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written table of numbers, marked for broadcast if it has few rows; beyond that the join shuffles."""
    return F.broadcast(table) if table.count() <= most else table


def _shared(sigs: DataFrame) -> DataFrame:
    """(sig, k1, m) of signatures that m > 1 texts hold; of signatures that the same texts hold one stays. sigs is used up, slice by slice."""
    spark = sigs.sparkSession
    held = []
    for i in range(SLICES):
        part = sigs.filter(F.col("slice") == i).select("sig", "k1")
        spans = part.groupBy("sig").agg(F.min("k1").alias("_lo"), F.max("k1").alias("_hi")).filter("_lo <> _hi").select("sig")
        spans = written(spans, "ngram-spans")
        held.append(written(part.join(_few(spans), "sig").distinct(), "ngram-held"))
        dropped(spark, spans)
        part_dropped(sigs, "slice", i)
    dropped(spark, sigs)
    whole = reduce(DataFrame.unionByName, held)
    # 128 bits stand for a set of texts.
    member = whole.groupBy("sig").agg(F.bit_xor(F.xxhash64("k1")).alias("x"), F.bit_xor(F.xxhash64("k1", F.lit(7))).alias("y"), F.count(F.lit(1)).alias("m"))
    one = written(member.groupBy("x", "y", "m").agg(F.min("sig").alias("sig")).select("sig", "m"), "ngram-one")
    shared = written(whole.join(_few(one), "sig").select("sig", "k1", "m"), "ngram-shared")
    dropped(spark, one, *held)
    return shared


def _clusters(shared: DataFrame) -> DataFrame:
    """(k1, cluster) of the texts that signatures of more than SMALL texts connect."""
    large = shared.filter(F.col("m") > SMALL).select("sig", "k1")
    hubs = large.groupBy("sig").agg(F.min("k1").alias("b"))
    return components(large.join(hubs, "sig").select(F.col("k1").alias("a"), "b")).select(F.col("node").alias("k1"), F.col("component").alias("cluster"))


def _candidates(shared: DataFrame, clusters: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of texts out of signatures of at most SMALL texts, not of one cluster, that sizes and sketches allow to link."""
    spark = shared.sparkSession
    few = shared.filter(F.col("m") <= SMALL).groupBy("sig").agg(F.sort_array(F.collect_list("k1")).alias("t"))  # at most SMALL each
    # The pairs of positions are written out for the largest group; those beyond a group's size give null.
    places = [F.when(F.size("t") > j, F.struct(F.get("t", F.lit(i)).alias("a"), F.get("t", F.lit(j)).alias("b"))) for j in range(1, SMALL) for i in range(j)]
    pairs = few.select(F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("p")).select("p.a", "p.b").distinct()
    of = _few(clusters)
    pairs = pairs.join(of.select(F.col("k1").alias("a"), F.col("cluster").alias("_ca")), "a", "left").join(of.select(F.col("k1").alias("b"), F.col("cluster").alias("_cb")), "b", "left")
    pairs = written(pairs.filter("_ca is null or _cb is null or _ca <> _cb").select("a", "b"), "ngram-pairs")
    ends = pairs.select(F.col("a").alias("k1")).union(pairs.select("b")).distinct()
    drawn = written(reps.join(ends, "k1").select("k1", "n", "sketch"), "ngram-sketches")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for batch in batches:
            keep = [sketch_difference(x, y) * (den + num) <= (n + m) * (den - num) for x, y, n, m in zip(batch["xa"], batch["xb"], batch["na"], batch["nb"])]
            yield batch.loc[keep, ["a", "b"]]

    # A link needs den * I >= num * (na + nb - I), so the sets differ in na + nb - 2 * I <= (na + nb) * (den - num) / (den + num) members.
    sides = [drawn.select(F.col("k1").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"x{s}")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").filter(f"least(na, nb) * {den} >= greatest(na, nb) * {num}")
    out = written(both.select("a", "b", "xa", "xb", "na", "nb").mapInPandas(near, "a long, b long"), "ngram-pairs")
    dropped(spark, pairs, drawn)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(k1, members) of the texts in wanted (k1, doc_id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for batch in batches:
            sets = [(key, s) for key, s in zip(batch["k1"], shingle_sets(list(batch["text"]), k)) if len(s) and set_key(s)[0] == key]  # ids may repeat
            if sets:
                yield pd.DataFrame({"k1": [key for key, _ in sets], "members": [s.tobytes() for _, s in sets]})

    found = docs.join(_few(wanted), "doc_id").select("k1", "text").mapInPandas(run, "k1 long, members binary")
    return written(found, "ngram-sets")


def _linked_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that link: (a, b, n_shared)."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for batch in batches:
            keep, shared = [], []
            for x, y in zip(batch["mine"], batch["members"]):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                z = np.sort(np.concatenate((x, y)), kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                shared.append(both)
                keep.append(den * both >= num * (len(z) - both))
            yield batch.assign(n_shared=shared).loc[keep, ["a", "b", "n_shared"]]

    left = pairs.join(sets.select(F.col("k1").alias("b"), F.col("members").alias("mine")), "b")
    both = left.join(sets.withColumnRenamed("k1", "a"), "a").select("a", "b", "mine", "members")
    found = both.mapInPandas(compare, "a long, b long, n_shared long").dropDuplicates(["a", "b"])  # equal ids may give a set twice
    return written(found, "ngram-linked")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many members each set of left has in common with each of right, exactly; `width` members at a time. left may be right: only two different ones count then."""
    out = np.zeros((len(left), len(right)), np.int64)
    x, y = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(x, y)
    if left is right:
        values, times = np.unique(x, return_counts=True)
        common = values[times > 1]  # sizes are known without them: only what two sets share counts

    def placed(sets: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
        there = common[at] == values if len(common) else np.zeros(len(values), bool)
        order = np.argsort(at[there], kind="stable")
        return owner[there][order], at[there][order]

    (ox, ax), (oy, ay) = placed(left, x), placed(right, y)
    for lo in range(0, len(common), width):
        part = []
        for owner, at, n in ((ox, ax, len(left)), (oy, ay, len(right))):
            here = slice(*np.searchsorted(at, (lo, lo + width)))
            one = np.zeros((n, min(width, len(common) - lo)), np.float32)
            one[owner[here], at[here] - lo] = 1
            part.append(one)
        out += (part[0] @ part[1].T).astype(np.int64)  # sums of up to `width` ones are exact
    return out


def roots(hit: np.ndarray) -> np.ndarray:
    """Of each node of a symmetric matrix, the first node that it is connected with."""
    label = np.arange(len(hit))
    while True:
        least = np.where(hit, label[None, :], len(hit)).min(axis=1, initial=len(hit))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cluster_blocks(clusters: DataFrame, reps: DataFrame, num: int, den: int, block: int, shingles: int, together: int) -> DataFrame:
    """(k1, the key of a task, size class, part) for every task that a text of a cluster is compared in.

    Size classes are such that a link joins sizes of the same or of adjacent classes; a class of a cluster is cut into parts of about `block` texts or `shingles` shingles.
    """
    step = max(math.log(den / num), 1e-9) * (1 + 1e-9)
    nodes = reps.select("k1", "n").join(_few(clusters), "k1").withColumn("_k", F.floor(F.log("n") / step).cast("long"))
    nodes = written(nodes, "ngram-nodes")
    of = nodes.groupBy("cluster", "_k").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_w"))
    of = of.withColumn("_g", F.greatest(F.ceil(F.col("_m") / block), F.ceil(F.col("_w") / shingles)).cast("long"))
    all_of = Window.partitionBy("cluster")  # a row for each size class
    of = of.select("cluster", "_k", "_g", F.sum("_m").over(all_of).alias("_all"), F.sum("_w").over(all_of).alias("_weight"))
    alone = (F.col("_all") <= block) & (F.col("_weight") <= shingles)
    buckets = int((nodes.agg(F.sum("n")).first()[0] or 0) // together) + 1
    near = [of.select("cluster", (F.col("_k") + by).alias("_k"), F.col("_g").alias(name)) for by, name in ((-1, "_up"), (1, "_down"))]
    of = of.join(near[0], ["cluster", "_k"], "left").join(near[1], ["cluster", "_k"], "left").fillna(0, ["_up", "_down"])
    dealt = nodes.join(of, ["cluster", "_k"]).withColumn("_p", F.pmod(F.xxhash64("k1"), F.col("_g")))

    def upto(n: str, task) -> Column:
        numbers = F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))
        return F.transform(numbers, lambda j: F.struct(*[x.cast("long").alias(name) for x, name in zip(task(j), ("k", "p", "l", "q"))]))

    k, p = F.col("_k"), F.col("_p")
    tasks = F.concat(upto("_g", lambda j: (k, F.least(p, j), k, F.greatest(p, j))), upto("_up", lambda j: (k, p, k + 1, j)), upto("_down", lambda j: (k - 1, j, k, p)))
    single = F.array(F.struct(*[F.lit(0).cast("long").alias(x) for x in ("k", "p", "l", "q")]))
    dealt = dealt.withColumn("_u", F.when(alone, F.pmod(F.xxhash64("cluster"), F.lit(buckets))).otherwise(F.col("cluster")))
    return dealt.select("k1", "cluster", "_k", "_p", alone.alias("_s"), "_u", F.explode(F.when(alone, single).otherwise(tasks)).alias("_t"))


PAIRS = "a long, b long, n_shared long"
COUNTED = "k1 long, root long, n_links long"


def _cluster_links(sets: DataFrame, blocks: DataFrame, num: int, den: int, shape: str = COUNTED) -> DataFrame:
    """For each two blocks of a cluster, by COUNTED: texts that link, how often, and one text that each is connected with; by PAIRS: every link."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        found = []
        task = pdf.iloc[0]
        for _, part in pdf.drop_duplicates(["k1"]).groupby("cluster", sort=False):
            keys, sets = part["k1"].to_numpy(np.int64), [np.frombuffer(m, U) for m in part["members"]]
            first = np.ones(len(part), bool) if task["_s"] else ((part["_k"] == task["k"]) & (part["_p"] == task["p"])).to_numpy()
            one = task["_s"] or (task["k"], task["p"]) == (task["l"], task["q"])
            at = np.flatnonzero(first), np.flatnonzero(first if one else ~first)
            if not len(at[0]) or not len(at[1]):
                continue
            left = [sets[x] for x in at[0]]
            right = left if one else [sets[x] for x in at[1]]
            both = overlaps(left, right)
            union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - both
            hit = den * both >= num * union
            if one:
                np.fill_diagonal(hit, False)
            if shape == PAIRS:
                i, j = np.nonzero(np.triu(hit) if one else hit)
                found.append(pd.DataFrame({"a": keys[at[0][i]], "b": keys[at[1][j]], "n_shared": both[i, j]}))
                continue
            whole = np.zeros((len(part), len(part)), bool)
            whole[np.ix_(at[0], at[1])] = hit
            whole |= whole.T
            links = whole.sum(axis=1)
            out = pd.DataFrame({"k1": keys, "root": keys[roots(whole)], "n_links": links})
            found.append(out[links > 0])
        return pd.concat(found) if found else pd.DataFrame({c.split()[0]: np.zeros(0, np.int64) for c in shape.split(", ")})

    own = blocks.select("*", "_t.*").drop("_t").join(sets, "k1")
    found = own.groupBy("_u", "_s", "k", "p", "l", "q").applyInPandas(compare, shape)
    return written(found, "ngram-cluster-links")


class Links:
    """What near_duplicates and near_links need: docs as read, a described row for each, each different set, and its verified links."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, bits: int | None, shape: str, block: int = 1024, shingles: int = 1 << 21, together: int = 1 << 18):
        if not 3 * den < 4 * num or num > den:
            raise ValueError("the threshold must be above 3/4 and at most 1")
        spark = docs.sparkSession
        small_batches(spark)
        docs = docs.select(held_id("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
        bits = bits or counter_bits(docs)
        described = written(_described(docs, k, bits), "ngram-described")
        self.rows = described.filter("block is null").drop("block", "counts")
        sets = self.rows.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
        self.reps = written(sets, "ngram-reps")
        sigs = _signed(docs, k, *_counters(described, bits), bits, num, den)
        shared = _shared(written(sigs.withColumn("slice", F.pmod("sig", F.lit(SLICES)).cast("int")), "ngram-signatures", "slice"))
        clusters = _clusters(shared)
        pairs = _candidates(shared, clusters, self.reps, num, den)
        dropped(spark, shared)
        ends = pairs.select(F.col("a").alias("k1")).union(pairs.select("b")).union(clusters.select("k1")).distinct()
        wanted = written(self.reps.join(ends, "k1").select("k1", F.col("rep").alias("doc_id")), "ngram-wanted")
        members = _sets(docs, wanted, k)
        self.pairs = _linked_pairs(pairs, members, num, den)
        blocks = _cluster_blocks(clusters, self.reps, num, den, block, shingles, together)
        self.in_clusters = _cluster_links(members, blocks, num, den, shape)
        dropped(spark, members, wanted, pairs)


def near_links(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bits: int | None = None, **blocks: int) -> DataFrame:
    """a, b, n_shared: every two different shingle sets that link, named by their smallest doc_ids, a <= b."""
    found = Links(docs, k, num, den, bits, PAIRS, **blocks)
    every = found.pairs.unionByName(found.in_clusters)
    ids = found.reps.select("k1", "rep")
    named = every.join(ids.select(F.col("k1").alias("a"), F.col("rep").alias("_a")), "a").join(ids.select(F.col("k1").alias("b"), F.col("rep").alias("_b")), "b")
    named = named.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "n_shared")
    return named.select(given_id("a").alias("a"), given_id("b").alias("b"), "n_shared")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bits: int | None = None, **blocks: int) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, component_key, text_hash for every row of docs (doc_id long, text string): links need intersection / union >= num / den.

    n_links: with how many different sets the row's set links. component_key: the same for all rows of a component, whatever their ids; null for a text without words.
    text_hash: xxhash64 of the text, which with doc_id tells rows of equal ids apart.
    """
    found = Links(docs, k, num, den, bits, COUNTED, **blocks)
    spark = docs.sparkSession
    edges = found.pairs.select("a", "b").union(found.in_clusters.filter("k1 <> root").select("k1", "root"))
    comp = components(edges).select(F.col("node").alias("k1"), "component")
    ends = found.pairs.select(F.col("a").alias("k1"), F.lit(1).cast("long").alias("n_links")).union(found.pairs.select("b", F.lit(1).cast("long")))
    counts = ends.unionByName(found.in_clusters.select("k1", "n_links")).groupBy("k1").agg(F.sum("n_links").alias("n_links"))
    # Sets without links are a component each; only linked ones need a look at their component.
    named = written(found.reps.select("k1", "k2", "n", "rep").join(comp, "k1").join(counts, "k1"), "ngram-named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = named.join(least, "component").select("k1", "k2", "n", "component_id", "n_links", F.col("component").alias("component_key"))
    single = found.reps.select("k1", "k2", "n", "rep").join(linked.select("k1", "k2", "n"), ["k1", "k2", "n"], "left_anti")
    whole = linked.unionByName(single.select("k1", "k2", "n", F.col("rep").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.col("k1").alias("component_key")))
    shown = found.rows.filter("n > 0").join(written(whole, "ngram-whole"), ["k1", "k2", "n"])
    empty = found.rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_key"), "h")
    shown = shown.select(empty.columns).unionByName(empty)
    dropped(spark, named, found.reps, found.pairs, found.in_clusters)
    return shown.select(given_id("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), given_id("component_id").alias("component_id"), "n_links", "component_key", F.col("h").alias("text_hash"))
