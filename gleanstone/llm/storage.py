"""Tables that cut lineage: written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_OWN: dict[str, str] = {}
_FOLDERS: set[str] = set()
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: Stands for a null id inside Python workers, where a column of integers with nulls would become one of floats.
NO_ID = 2**63 - 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share.

    Where it is unset, a session with a local master (tests) gets a temporary folder; any other raises an error, as executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="gleanstone-")
        path = _OWN[context.applicationId]
    return path.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, kept if executors are lost, deleted when the program ends. by: a column that deals its rows to folders."""
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/gleanstone/{spark.sparkContext.applicationId}"
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    if own not in _FOLDERS:
        _FOLDERS.add(own)
        atexit.register(_clean, spark, own)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # nothing reads this plan's shuffle files again: the table stands for it
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def _clean(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        _delete(spark, folder)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads; others are left."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            _delete(spark, path)


def part_dropped(table: DataFrame, by: str, value: int) -> None:
    """Delete the rows of a value of `by`, the column that written() dealt by; no later plan reads them."""
    if path := _PATHS.get(table):
        _delete(table.sparkSession, f"{path}/{by}={value}")


_KEPT: dict = {}


def forget() -> None:
    """Free what kept_in_worker() holds in this Python worker, and give back what its allocators hold unused."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def kept_in_worker(key: tuple, make: Callable):
    """make(), once for a Python worker and key. A worker serves many operators: only the last key's object stays."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def held_id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def given_id(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(NO_ID))


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of at most so many rows: a batch of long texts then fits a Python worker.

    The session's setting is lowered, never raised.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def text_blocks(texts: list[bytes], size: int = 1 << 22) -> Iterator[list[bytes]]:
    """texts in lists of `size` bytes at most; a longer text is alone."""
    block: list[bytes] = []
    held = 0
    for text in texts:
        if block and held + len(text) > size:
            yield block
            block, held = [], 0
        block.append(text)
        held += len(text)
    if block:
        yield block


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_columns(docs: DataFrame, start: Callable[[], Callable], schema: str, keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (all, if none are named), then those of schema, computed from the column text.

    start runs once in each task and returns a function from a list of texts to a list of values for each new column. Kept columns pass through as Arrow columns.
    """
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    new = T._parse_datatype_string(schema)
    kinds = [{"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            made = compute(batch.column("text").to_pylist())
            arrays = [batch.column(c) for c in keep] + [pa.array(list(v), k) for v, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *new.names])

    out = T.StructType([T.StructField(f.name, f.dataType) for f in docs.select(*keep).schema] + list(new))
    return docs.mapInArrow(run, out)
