"""I-Match fingerprints (native): terms in a band of inverse document frequency, hashed in randomised lexicon subsets.

The lexicon has the terms that occur in at least the share `low` and at most the share `high` of all texts. It is kept as a bitmap of 2**LEXICON_BITS bits (512 KB, whatever the input): a term is
in it if the bit of its hash is set, so a few rarer terms are in it, too, the same for all texts. The bitmap is a constant of the plan. A subset has each term of the lexicon with a chance of 1 / rate by the bits of its hash; there are
subsets of several rates, rough ones for short texts and fine ones for long texts. The part of a fingerprint for a subset is
a hash of the text's sorted distinct terms in it, 0 if it has none. Two fingerprints' likeness is, for the rate at which it is largest, the share of equal parts among those that are not 0 in both.

A text's terms never leave its row. The next text by doc_id comes from a window over ranges of ids (each with the first row of
the following one), so texts are shuffled once and no task holds more than its range. The ranges' edges come from a sort of the ids alone, are a constant array of at most MOST_RANGES numbers, and are
searched by halving.

A text with fewer than FEW terms of the lexicon (a small language, an odd source) is told by all its terms instead; terms that fall into no subset are hashed together.

Defined results: a null text is an empty one; only texts without any term have the fingerprint of all 0, and two such are alike with 1; equal texts have equal fingerprints; rows with equal doc_id are ordered by text; null ids come first; one row alone is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Of each group of subsets: one term in so many.
RATES = (4, 16, 64, 256)
EACH = 8  # by bytes of a hash: 8 at most
LEXICON_BITS = 22
MOST_RANGES = 100_000
#: A text with fewer lexicon terms is told by all its terms.
FEW = 4


def terms_of(text: Column) -> Column:
    """Distinct runs of letters and digits in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def constant(values: list[int]) -> Column:
    """A literal array of longs: folded from a text, so the plan has one node for it."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _word(h: Column) -> Column:
    """The word of 64 bits that holds the bit of a hash; the bit's place in it is h mod 64."""
    return F.pmod(F.shiftright(h, 6), F.lit(1 << (LEXICON_BITS - 6))).cast("int")


def lexicon(docs: DataFrame, low: float, high: float, text_col: str = "text") -> Column:
    """The bitmap of the terms in the band, an array of longs; document frequencies are counted over all texts."""
    rows = docs.select(F.col(text_col).alias("t")).filter("t is not null")
    n = rows.count()
    df = rows.select(F.explode(F.transform(terms_of(F.col("t")), lambda t: F.xxhash64(t))).alias("h")).groupBy("h").count()
    inside = df.filter((F.col("count") >= low * n) & (F.col("count") <= max(2, high * n)))
    bit = F.expr("shiftleft(1L, cast(pmod(h, 64) as int))")
    out = [0] * (1 << (LEXICON_BITS - 6))
    for r in inside.groupBy(_word(F.col("h")).alias("w")).agg(F.bit_or(bit).alias("bits")).collect():  # so many rows at most
        out[r["w"]] = r["bits"]
    return constant(out)


def kept_of(text: Column, words: Column) -> Column:
    """The sorted hashes of the text's distinct terms in the lexicon; of all its terms if fewer than FEW are."""
    return _once(_once(_hashes(text), lambda every: F.struct(every.alias("every"), _inside(every, words).alias("some"))), lambda x: F.when(F.size(x["some"]) < FEW, x["every"]).otherwise(x["some"]))


def _hashes(text: Column) -> Column:
    return F.array_sort(F.transform(terms_of(text), lambda t: F.xxhash64(t)))


def _inside(hashes: Column, words: Column) -> Column:
    return F.filter(hashes, lambda h: F.bit_get(F.get(words, _word(h)), F.pmod(h, F.lit(64)).cast("int")) == 1)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used: it becomes the variable of a function."""
    return F.get(F.transform(F.array(value), use), 0)


def _part(kept: Column, rate: int, k: int) -> Column:
    chosen = F.filter(kept, lambda h: F.pmod(F.shiftright(h, 8 * k), F.lit(rate)) == 0)
    return F.when(F.size(chosen) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(chosen, F.lit(rate * 100 + k)))


def _in_a_subset(h: Column) -> Column:
    return reduce(lambda x, y: x | y, [F.pmod(F.shiftright(h, 8 * k), F.lit(rate)) == 0 for rate in RATES for k in range(EACH)])


def parts_of(kept: Column) -> Column:
    """A part for each subset; if no subset has a term of kept, each part is a hash of all of kept, so only texts without terms have parts of 0 alone."""
    chosen = F.array(*[_part(kept, rate, k) for rate in RATES for k in range(EACH)])
    whole = F.array(*[F.xxhash64(kept, F.lit(rate * 100 + k)) for rate in RATES for k in range(EACH)])
    return F.when((F.size(kept) > 0) & ~F.exists(kept, _in_a_subset), whole).otherwise(chosen)


def shown(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of the rate that suits the two texts best, the share of equal parts among those not 0 in both; 1 if all parts are 0: both texts have no terms."""
    shares = []
    for group in range(len(RATES)):
        own = range(group * EACH, (group + 1) * EACH)
        there = reduce(lambda x, y: x + y, [((a[i] != 0) | (b[i] != 0)).cast("int") for i in own])
        same = reduce(lambda x, y: x + y, [((a[i] != 0) & (a[i] == b[i])).cast("int") for i in own])
        shares.append(F.when(there > 0, same / there))
    return F.coalesce(F.greatest(*shares), F.lit(1.0))


def with_next(docs: DataFrame, also: str, made: Column, per_range: int = 2_000) -> DataFrame:
    """doc_id, text, the column also (made from a text), and as next_ of the last two those of the next row by (doc_id, text); after the last comes the first."""
    least = -(2**63)
    key = F.coalesce("doc_id", F.lit(least))  # null ids come first
    keys = docs.select(key.alias("k"))
    ranges = min(max(-(-keys.count() // per_range), 1), MOST_RANGES)
    edges = keys.repartitionByRange(ranges, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k")).select("k")
    edges = sorted(r["k"] for r in edges.collect())  # at most MOST_RANGES
    flagged = docs.withColumn("_b", _range_of(key, constant(edges), len(edges)))
    starts = written(flagged.groupBy("_b").agg(F.min(key).alias("_id")), "fingerprint-starts")  # one row for each range
    few = F.broadcast(starts.withColumnRenamed("_b", "_s"))
    first = flagged.join(few, (F.col("_b") == F.col("_s")) & (key == F.col("_id"))).groupBy("_b").agg(F.min("text").alias("text"))
    ring = starts.select("_b", F.lag("_b").over(Window.orderBy("_b")).alias("_to"))
    last = starts.agg(F.max("_b")).first()[0]
    halo = first.join(F.broadcast(ring), "_b").select(F.lit(None).cast("long").alias("doc_id"), "text", F.coalesce("_to", F.lit(last)).alias("_b"), F.lit(1).alias("_halo"))
    rows = flagged.select("doc_id", "text", "_b", F.lit(0).alias("_halo")).unionByName(halo).withColumn(also, made)
    w = Window.partitionBy("_b").orderBy("_halo", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.select("*", F.lead("text").over(w).alias("next_text"), F.lead(also).over(w).alias(f"next_{also}")).filter("_halo = 0")
    return rows.select("doc_id", "text", also, "next_text", f"next_{also}")


def _range_of(key: Column, edges: Column, most: int) -> Column:
    """How many of at most `most` sorted edges are not above key, by halving."""
    begin = F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi"))

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(edges, mid) <= key
        return F.when(s["lo"] >= s["hi"], s).when(below, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(most.bit_length())), begin, half, lambda s: s["lo"])


def fingerprint_documents(docs: DataFrame, low: float = 0.004, high: float = 0.1) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = lexicon(slim, low, high)
    parts = lambda text: _once(kept_of(text, words), parts_of)
    rows = with_next(slim, "own", parts(F.col("text")))
    half = F.expr("length(text) div 2").cast("int")
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "own", "next_own", F.sha2("edited", 256).alias("edited_sha256"), parts(F.col("edited")).alias("edited"))
    made = written(rows, "fingerprint-parts")
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
