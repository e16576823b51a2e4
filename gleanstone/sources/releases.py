"""Release notes as files of JSON, and the deprecation map that follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.deprecation import ENTRIES, FOUND, merged_releases, release_rows
from ..schema import struct

#: A release as release services write it, by either of two spellings.
RELEASE = struct("tag_name string, tagName string, body string, published_at string, publishedAt string")
STORED = T.StructType([*FOUND, T.StructField("batch", T.LongType())])


def _versions(pages: DataFrame) -> DataFrame:
    """version, body, published of the releases that have a tag and a body: the version is the tag without its `v`s."""
    tag: Column = F.coalesce("tag_name", "tagName")
    rows = pages.select(F.regexp_replace(tag, "^v+", "").alias("version"), "body", F.coalesce("published_at", "publishedAt").alias("published"))
    return rows.filter("version <> '' and trim(body) <> ''")


def read_releases(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """version, body, published of all pages (files with a list of releases, or one) below path; a damaged page gives no rows. most: only so many, the newest first."""
    rows = _versions(spark.read.schema(RELEASE).option("multiLine", True).json(path)).dropDuplicates(["version"])
    return rows.orderBy(F.desc("published"), F.desc("version")).limit(most) if most is not None else rows


def follow_releases(spark: SparkSession, path: str, folder: str, checkpoint: str, package: str) -> StreamingQuery:
    """Take the pages that are new below path, and put the entries that their releases of package name below folder, a partition for each batch. A batch that is repeated writes its own partition over."""
    pages = spark.readStream.schema(RELEASE).option("multiLine", True).json(path)

    def put(batch: DataFrame, number: int) -> None:
        rows = release_rows(_versions(batch), package).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(spark: SparkSession, folder: str, existing: DataFrame | None = None) -> DataFrame:
    """The deprecation map of what follow_releases() has put below folder: of a release that came in several batches, the last one's entries count."""
    rows = spark.read.schema(STORED).parquet(folder)
    last = rows.groupBy("version").agg(F.max("batch").alias("batch"))
    merged, _ = merged_releases(rows.join(last, ["version", "batch"], "left_semi").drop("batch"), existing)
    at = Window.orderBy("at", "old_path")  # a row for each deprecated path of one package
    return merged.withColumn("ord", F.row_number().over(at).cast("long")).select(*ENTRIES.names)
