"""Sharding by a Feistel permutation with cycle walking over global row numbers (native).

A row's number r is its rank by (doc_id, CRC of the text, size), so it depends on the rows' values alone. Law `rows`: row r of N goes to place
p = permutation(r), to shard p mod n and slot p div n. Counts differ by one at most, slots have no gaps, and place, shard and slot of any row
number can be computed without data, by integer arithmetic that any language has.

Defined results: a null text has size 1 and the CRC of no bytes; equal rows get
different places (which of them gets which is free); null ids come first; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

ROUNDS = 6
WALKS = 128
#: Products of two numbers below it fit in 63 bits.
PRIME = 2**31 - 1
#: Copies of a row that one task writes out from one row.
CHUNK = 10_000


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Of each round the numbers u, v, w: its function of x is (x * u + v) * (x + w) mod PRIME."""
    rnd = random.Random(seed)
    return [tuple(rnd.randrange(1, PRIME) for _ in range(3)) for _ in range(ROUNDS)]


def network(n: int) -> tuple[int, int]:
    """a * b >= n places, as near to n as two numbers near its root get: a * b - n < a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _rounds(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over the pairs (x div b, x mod b), a unique place for each of a * b."""

    def mix(half: Column, key: Column, names: str) -> Column:
        u, v, w = (key[c] for c in names)
        return ((half * u + v) % PRIME) * ((half + w) % PRIME) % PRIME

    def two_rounds(s: Column, key: Column) -> Column:
        left = (s["l"] + mix(s["r"], key, "uvw")) % F.lit(a)
        return F.struct(left.alias("l"), ((s["r"] + mix(left, key, "xyz")) % F.lit(b)).alias("r"))

    keys = round_keys(seed)
    pairs = F.array(*[F.struct(*[F.lit(k).cast("long").alias(c) for c, k in zip("uvwxyz", keys[i] + keys[i + 1])]) for i in range(0, ROUNDS, 2)])
    begin = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).alias("r"))  # exact: x is below 2**52
    return F.aggregate(pairs, begin, two_rounds, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(row: Column, n: int, seed: int) -> Column:
    """The place of row number `row` among n: a permutation of 0..n-1.

    A place of n or more is walked on along its cycle, for at most WALKS steps. More would need WALKS places of the surplus
    in one cycle in a row (below 2**-64 for any n); that raises an error rather than a wrong row.
    """
    if n >= 2**52:
        raise ValueError("row numbers beyond what a double holds exactly")
    a, b = network(n)
    first = _rounds(row, a, b, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda p, _: F.when(p < F.lit(n), p).otherwise(_rounds(p, a, b, seed)))
    return F.when(first < F.lit(n), first).otherwise(
        F.when(walked < F.lit(n), walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))
    )


def numbered(rows: DataFrame, by: list[str], per_part: int = 100_000) -> tuple[DataFrame, int]:
    """The columns `by` of rows with `row_number` 0..N-1, their rank in that order (nulls first), and N.

    Equal rows are counted before anything is sorted. Distinct ones are sorted in ranges, and a range starts where those before it end; what is broadcast has a row
    for each range. Copies are written out last, CHUNK at a time, so a row with a third of all copies is many tasks' work.
    """
    groups = written(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")), "sharding-groups")
    ranges = -(-groups.count() // per_part)
    order = groups.repartitionByRange(max(ranges, 1), *by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    order = written(order.withColumn("_part", F.shiftright("_m", 33)), "sharding-order")
    counts = order.groupBy("_part").agg(F.sum("_c").alias("_n")).withColumn("_start", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    n = order.agg(F.sum("_c")).first()[0] or 0
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = order.withColumn("_before", before).join(F.broadcast(counts.select("_part", "_start")), "_part")
    placed = placed.select(*by, "_c", (F.col("_start") + F.col("_before")).alias("_first"))
    few = placed.filter(F.col("_c") <= CHUNK).select(*by, "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)).alias("_i"))
    many = placed.filter(F.col("_c") > CHUNK).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_c - 1) div {CHUNK}")))).repartition("_first", "_k")
    many = many.select(*by, "_first", F.explode(F.sequence(F.col("_k") * CHUNK, F.least((F.col("_k") + 1) * CHUNK, F.col("_c")) - 1)).alias("_i"))
    return few.unionByName(many).select(*by, (F.col("_first") + F.col("_i")).alias("row_number")), n


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20_011, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number for every row of docs."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.crc32(text).alias("text_crc32"), (F.octet_length(text) + 1).cast("long").alias("size"))
    rows, n = numbered(slim, ["doc_id", "text_crc32", "size"])
    placed = rows.withColumn("_place", permuted(F.col("row_number"), n, seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def sharding_sql(shards: int = 16, seed: int = 20_011) -> str:
    """The same in DuckDB: the CRC by its table, ranks by a window, the network in integers, cycles walked by recursion."""

    def pass_over(x: str) -> str:
        out, left, right = [f"{x} // b AS l0", f"{x} % b AS r0"], "l0", "r0"
        for i, (u, v, w) in enumerate(round_keys(seed)):
            half, other, base = (left, right, "a") if i % 2 == 0 else (right, left, "b")
            name = f"{half[0]}{int(half[1:]) + 1}"
            out.append(f"({half} + (({other} * {u} + {v}) % {PRIME}) * (({other} + {w}) % {PRIME}) % {PRIME}) % {base} AS {name}")
            left, right = (name, right) if i % 2 == 0 else (left, name)
        return ", ".join([*out, f"{left} * b + {right} AS q"])

    return rf"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS e FROM range(256) AS i(i)),
s AS (SELECT doc_id, strlen(t)::BIGINT + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda c, x: xor(e[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS crc FROM t, e),
n AS (SELECT count(*) AS n, CAST(floor(sqrt(greatest(count(*) - 1, 0))) AS BIGINT) + 1 AS a FROM t), m AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM n),
r AS (SELECT doc_id, size, crc, row_number() OVER (ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS r FROM s),
w AS (SELECT r, q AS p FROM (SELECT r, {pass_over("r")} FROM r, m) UNION ALL SELECT r, q FROM (SELECT r, {pass_over("p")} FROM w, m WHERE p >= n))
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (p % {shards})::INT AS shard, p // {shards} AS slot, NULL::INT AS grown_shard, r AS row_number FROM r JOIN w USING (r), m WHERE p < n"""
