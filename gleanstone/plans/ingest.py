"""From sources to chunk rows: documentation dumps, example code, and the symbols of source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import domain, execution_mode, module_path, source_link
from ..operators import taxonomy
from ..schema import conform
from ..sources import code, markdown, pins, rst, typescript

README_CHARS = 65_536
#: Tags of examples that run in a cloud.
CLOUD_TAGS = ["daily", "twilio", "livekit", "vonage", "azure", "aws", "google"]


def docs_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of documentation dumps."""
    dumps = markdown.read_dump(spark, path).withColumn("dump", F.sha2("value", 256))
    return conform(markdown.chunk_pages(markdown.split_pages(dumps, "dump")).withColumn("indexed_at", F.current_timestamp()))


def example_chunks(files: DataFrame, sha: str, package: str, framework: str | None = None, npm_scope: str | None = None) -> DataFrame:
    """Chunk rows of example code with tags, pins, domain, mode and readme of their example. npm_scope: whose npm packages count as the package. framework: the version for examples without a pin of their own."""
    dirs = code.example_dirs(files)
    entries = taxonomy.entries(files, dirs)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1), "^$", ".")
    readmes = files.filter(name == "README.md").select("repo", folder.alias("_dir"), F.substring("content", 1, README_CHARS).alias("readme_content"))
    nearest = pins.nearest_pins(files.select("repo", folder.alias("dir")), pins.file_pins(files, package, npm_scope)).select("repo", F.col("dir").alias("_dir"), "pin")
    chunks = code.chunk_files(code.code_files(files), sha)
    rows = taxonomy.for_files(chunks, entries).withColumn("_dir", folder).join(readmes, ["repo", "_dir"], "left").join(nearest, ["repo", "_dir"], "left")
    tags = F.coalesce(F.col("entry.tags"), F.array().cast("array<string>"))
    out = rows.select(
        *chunks.columns, "readme_content", tags.alias("capability_tags"), F.col("entry.key_files").alias("key_files"), F.col("entry.foundational_class").alias("foundational_class"),
        F.coalesce("pin", F.lit(framework)).alias("pipeline_version_pin"), domain(F.col("path")).alias("domain"), execution_mode(tags, CLOUD_TAGS).alias("execution_mode"),
        source_link(F.col("repo"), F.col("commit_sha"), F.col("path"), F.col("line_start"), F.col("line_end")).alias("source_url"), F.current_timestamp().alias("indexed_at"),
    )
    return conform(out)


def source_chunks(files: DataFrame, sha: str, package: str, types: DataFrame | None = None) -> DataFrame:
    """Chunk rows of the symbols of Python, stub, TypeScript and RST files."""
    found = code.source_files(files)
    python = found.filter(F.col("kind").isin("python", "stub")).withColumn("module_path", module_path(F.col("path")))
    rows = conform(code.symbol_chunks(code.parse_python(python, package), sha, types))
    rows = rows.unionByName(conform(typescript.parse_ts(found.filter("kind = 'typescript'")).withColumn("commit_sha", F.lit(sha))))
    rows = rows.unionByName(conform(rst.parse_rst(found.filter("kind = 'rst'")).withColumn("commit_sha", F.lit(sha))))
    link = source_link(F.col("repo"), F.col("commit_sha"), F.col("path"), F.col("line_start"), F.col("line_end"))
    return rows.withColumn("source_url", link).withColumn("indexed_at", F.current_timestamp())
