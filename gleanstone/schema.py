"""The chunk table: one row for each part of a page, file or symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(), "double": T.DoubleType(), "float": T.FloatType()}


def struct(listed: str) -> T.StructType:
    """A struct of `name type` pairs, without a session: plain types, and arrays of them."""
    out = T.StructType()
    for pair in listed.split(", "):
        name, kind = pair.split(" ")
        inner = kind.removeprefix("array<").removesuffix(">")
        out.add(name, _PLAIN[kind] if kind in _PLAIN else T.ArrayType(_PLAIN[inner]))
    return out


CHUNKS = struct(
    "chunk_id string, seq long, content string, content_type string, source_url string, repo string, path string, commit_sha string, indexed_at timestamp, "
    "title string, section string, language string, domain string, execution_mode string, foundational_class string, pipeline_version_pin string, "
    "capability_tags array<string>, key_files array<string>, readme_content string, chunk_index int, line_start int, line_end int, module_path string, "
    "class_name string, method_name string, chunk_type string, method_signature string, return_type string, is_dataclass boolean, is_abstract boolean, "
    "base_classes array<string>, imports array<string>, yields array<string>, calls array<string>, rst_refs array<string>, related_types array<string>, "
    "embedding array<float>"
).add("fields", T.ArrayType(struct("key string, value_type string")))


def conform(rows: DataFrame) -> DataFrame:
    """rows with exactly the columns of CHUNKS: missing ones are null, others go."""
    own = set(rows.columns)
    return rows.select(*[(F.col(f.name).cast(f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in CHUNKS])


def from_metadata(rows: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Chunk rows whose further fields are a JSON text, with lists as JSON lists or comma-separated text, as flat columns."""
    out = rows
    for f in CHUNKS:
        if f.name in rows.columns:
            continue
        raw = F.get_json_object(metadata, f"$.{f.name}")
        if f.dataType == T.ArrayType(T.StringType()):
            parsed = F.from_json(raw, "array<string>")
            value = F.when(raw.startswith("["), parsed).otherwise(F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != ""))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType)):
            value = F.from_json(raw, f.dataType)
        else:
            value = raw.cast(f.dataType)
        out = out.withColumn(f.name, value)
    return conform(out)


def to_metadata(rows: DataFrame) -> DataFrame:
    """chunk_id and a JSON text of all further fields that are there."""
    outer = {"chunk_id", "seq", "content", "content_type", "source_url", "repo", "path", "commit_sha", "indexed_at", "embedding"}
    return rows.select("chunk_id", F.to_json(F.struct(*[f.name for f in CHUNKS if f.name not in outer and f.name in rows.columns])).alias("metadata"))
