"""Changes of the chunk table, as tables derived from tables; and a small key-value table."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CHUNKS, conform, struct


#: What orders the rows of a batch: their own number, then source and place in it.
BATCH_ORDER = ("seq", "repo", "path", "source_url", "chunk_index")
RANGES = 256


def latest(rows: DataFrame, key: str = "chunk_id", order: str | list[str] = "seq") -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in ([order] if isinstance(order, str) else order)])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def numbered(rows: DataFrame, order: list[str], key: str, start: Column | int = 0, name: str = "seq") -> DataFrame:
    """rows with `name`: start, start + 1, ... in the order of `order` and key (nulls first), without one task that sorts everything.

    The rows with the smallest hashes of their keys, 2,047 at most, give the ends of 256 ranges; each range is numbered by itself, from the count of the ranges before it.
    The ends are values in the plan, so it gives the same numbers whenever it is evaluated.
    """
    by = [*dict.fromkeys([*order, key])]
    place = F.struct(*[F.col(c) for c in by])
    some = rows.select(*by).orderBy(F.xxhash64(F.col(key)), *by).limit(RANGES * 8 - 1).orderBy(*by)
    ends = some.select(F.to_json(place).alias("v")).collect()[7::8]  # 255 at most
    listed = F.from_json(F.lit("[" + ",".join(r["v"] for r in ends) + "]"), T.ArrayType(rows.select(*by).schema))
    dealt = rows.withColumn("_range", F.size(F.filter(listed, lambda e: e <= place)))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    begins = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_begin"))  # 256 rows
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1
    out = dealt.withColumn("_nth", nth).join(F.broadcast(begins), "_range")
    return out.withColumn(name, (start if isinstance(start, Column) else F.lit(start)) + F.col("_begin") + F.col("_nth")).drop("_range", "_nth", "_begin")


def placed(new: DataFrame, old: DataFrame, top: Column, key: str = "chunk_id") -> DataFrame:
    """The rows of new with their seq: that of the row of old (key, seq) with the same key, else from top on in the order of BATCH_ORDER, as far as new has those columns.

    Of rows of new with one key, the last counts, in its own place. old's row of the same key comes along as `_old`.
    """
    order = [c for c in BATCH_ORDER if c in new.columns]
    fresh = latest(new, key, order) if order else new.dropDuplicates([key])
    if "seq" not in fresh.columns:
        fresh = fresh.withColumn("seq", F.lit(None).cast("long"))
    joined = fresh.join(old.select(key, F.struct(*old.columns).alias("_old")), key, "left")
    replaced = joined.filter("_old is not null").withColumn("seq", F.col("_old.seq"))
    added = numbered(joined.filter("_old is null").withColumn("_top", top), order, key, F.col("_top")).drop("_top")
    return replaced.unionByName(added.select(replaced.columns))


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """old with the rows of new put in: replaced rows keep their seq, new ones follow the last in the order of BATCH_ORDER."""
    top = old.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("_first"))
    fresh = placed(new.join(F.broadcast(top)), old.select(key, "seq"), F.col("_first"), key)
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(fresh.select(old.columns))


def vector_rows(rows: DataFrame) -> DataFrame:
    """What the vector side takes: rows with an embedding."""
    return rows.filter("embedding is not null")


def deleted(rows: DataFrame, column: str, value) -> tuple[DataFrame, DataFrame]:
    """What stays, and how many rows go (n): an equality delete that never matches nulls."""
    hit = F.col(column).eqNullSafe(F.lit(value))
    return rows.filter(~hit), rows.filter(hit).agg(F.count(F.lit(1)).alias("n"))


#: A row of a change: a chunk, and the number of the change that brought it. And what a change takes away: a chunk, and the number of the change that its row came with.
ROWS = T.StructType([*CHUNKS, T.StructField("change", T.LongType())])
GONE = struct("chunk_id string, of long")


class ChunkStore:
    """A chunk table as changes below a folder: each is a small table of new rows and one of the older rows that they replace or that were deleted; readers merge them.

    Numbered pointer files name the changes. A change may be a base, which holds the whole table, so that no change before it is read; write() makes one, and so does a change that follows MOST_CHANGES others.
    A pointer appears by one rename after its change is whole: readers see a whole table at any time, and a writer that dies leaves the last one. What lies before a base stays for
    readers that began with it until the next base. One writer at a time: a second one that took the same number raises an error.
    """

    MOST_CHANGES = 64

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        """The numbers of all pointers, ascending."""
        jvm, fs = self._fs()
        top = jvm.org.apache.hadoop.fs.Path(self.folder)
        names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-"))

    def _change(self, n: int) -> dict:
        """name, base, gone (whether it takes rows away), top (one more than the largest seq so far)."""
        return json.loads(self.spark.read.text(f"{self.folder}/current-{n:012d}").first()[0])

    def _changes(self) -> list[dict]:
        """The changes that readers merge, the last base first."""
        out: list[dict] = []
        for n in reversed(self._pointers()):
            out.insert(0, self._change(n))
            if out[0]["base"]:
                break
        return out

    def _alive(self, changes: list[dict]) -> DataFrame:
        if not changes:
            return self.spark.createDataFrame([], ROWS)
        rows = self.spark.read.schema(ROWS).parquet(*[f"{self.folder}/{c['name']}/rows" for c in changes])
        if not any(c["gone"] for c in changes):
            return rows
        gone = self.spark.read.schema(GONE).parquet(*[f"{self.folder}/{c['name']}/gone" for c in changes if c["gone"]])
        gone = gone.select(F.col("chunk_id").alias("_id"), "of")
        return rows.join(gone, (F.col("chunk_id") == F.col("_id")) & (F.col("change") == F.col("of")), "left_anti")

    def read(self) -> DataFrame:
        return self._alive(self._changes()).drop("change")

    def _put(self, rows: DataFrame, gone: DataFrame | None, top: int) -> int:
        """Write a change, a base if gone is None; returns the number of its rows."""
        before = self._pointers()
        n, name = (before[-1] + 1 if before else 0), f"v-{uuid.uuid4().hex}"
        conform(rows).withColumn("change", F.lit(n).cast("long")).write.parquet(f"{self.folder}/{name}/rows")
        count, last = self.spark.read.schema(ROWS).parquet(f"{self.folder}/{name}/rows").agg(F.count(F.lit(1)), F.max("seq")).first()
        if gone is not None:
            gone.write.parquet(f"{self.folder}/{name}/gone")
        self._point(n, name, gone is None, gone is not None, max(top, -1 if last is None else last + 1))
        if gone is None:
            self._clear_before(before)
        return count

    def _clear_before(self, pointers: list[int]) -> None:
        """Delete the changes before the last base among pointers."""
        jvm, fs = self._fs()
        stays = True
        for n in reversed(pointers):
            change = self._change(n)
            if not stays:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{change['name']}"), True)
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/current-{n:012d}"), False)
            stays = stays and not change["base"]

    def _point(self, n: int, name: str, base: bool, gone: bool, top: int) -> None:
        jvm, fs = self._fs()
        begun, done = (jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p}") for p in (f"next-{name}", f"current-{n:012d}"))
        out = fs.create(begun)
        out.write(bytearray(json.dumps({"name": name, "base": base, "gone": gone, "top": top}).encode()))
        out.close()
        if fs.exists(done) or not fs.rename(begun, done):
            raise RuntimeError(f"another writer made version {n} of {self.folder}")

    def write(self, rows: DataFrame) -> None:
        """rows are the whole table from now on."""
        self._put(rows, None, 0)

    def compact(self) -> None:
        """All changes as one base."""
        self.write(self.read())

    def change(self, new: DataFrame | None = None, gone: Column | None = None) -> int:
        """Take away the rows for which gone holds, put in those of new by chunk_id, and return how many new rows there are. What is written grows with the rows that come and go."""
        changes = self._changes()
        alive, top = self._alive(changes), max((c["top"] for c in changes), default=0)
        hit = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
        old = alive.filter(~hit).select("chunk_id", "seq", "change")
        rows = self.spark.createDataFrame([], CHUNKS) if new is None else conform(new)
        marks = alive.filter(hit).select("chunk_id", F.col("change").alias("of"))
        if new is not None:
            marks = marks.unionByName(old.join(rows.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", F.col("change").alias("of")))
        count = self._put(placed(rows, old, F.lit(top)) if new is not None else rows, marks, top)
        if len(changes) >= self.MOST_CHANGES:
            self.compact()
        return count

    def upsert(self, rows: DataFrame) -> int:
        return self.change(rows)

    def delete(self, column: str, value) -> int:
        if column not in ("content_type", "repo", "source_url", "path", "chunk_id"):
            raise ValueError(f"no delete by {column}")
        hit = F.col(column) == F.lit(value)
        n = self.read().filter(hit).count()
        if n:
            self.change(gone=hit)
        return n

    def clear(self) -> None:
        self.write(self.spark.createDataFrame([], CHUNKS))

    def reset(self) -> None:
        jvm, fs = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(self.folder), True)


KEY_VALUES = struct("key string, value string, updated_at timestamp")


def set_values(table: DataFrame, new: DataFrame) -> DataFrame:
    """The latest value of each key."""
    both = table.unionByName(new.select(table.columns))
    return both.groupBy("key").agg(F.max_by("value", "updated_at").alias("value"), F.max("updated_at").alias("updated_at"))


def get_value(table: DataFrame, key: str) -> DataFrame:
    return table.filter(F.col("key") == key).select("value")


def without_key(table: DataFrame, key: str) -> DataFrame:
    return table.filter(F.col("key") != key)
