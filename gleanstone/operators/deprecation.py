"""Deprecations: building the map from source, changelogs and release notes, and looking symbols up in it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bracket_modules, module_path
from ..schema import struct

ENTRIES = struct("old_path string, new_path string, deprecated_in string, removed_in string, note string, ord long")

#: How proxies and symbols are written.
PROXY = r'(?s)DeprecatedModuleProxy\s*\(\s*globals\(\)\s*,\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,?\s*\)'
SYMBOL = re.compile(r"`([A-Z][a-zA-Z0-9]+(?:Service|Processor|Transport|Filter|Strategy|Analyzer|Observer|Frame|Params|Settings))`")
DOTTED = re.compile(r"`([A-Z][a-zA-Z0-9]+(?:\.[A-Z][a-zA-Z0-9]+)+)`")


def check(entries: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol and its entry (nulls without one): the exact key, else the first entry of which symbol is a part, or that is a part of symbol.

    Instead of comparing every pair, both directions are equi-joins on dotted prefixes: of the symbol for its ancestors,
    of the entry for its descendants. A path has as many prefixes as parts.
    """

    def prefixes(path: str, proper: bool) -> Column:
        parts = F.split(path, r"\.")
        n = F.size(parts) - 1 if proper else F.size(parts)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).otherwise(F.array().cast("array<string>"))

    own = symbols.select("symbol").distinct()
    up = own.select("symbol", F.explode(prefixes("symbol", False)).alias("key")).join(entries.withColumn("key", F.col("old_path")), "key")
    down = entries.select("*", F.explode(prefixes("old_path", True)).alias("symbol")).join(own, "symbol")
    found = up.select("symbol", *ENTRIES.names).unionByName(down.select("symbol", *ENTRIES.names))
    w = Window.partitionBy("symbol").orderBy((F.col("old_path") == F.col("symbol")).desc(), "ord")
    best = found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "ord")
    return symbols.join(best, "symbol", "left").withColumn("deprecated", F.col("old_path").isNotNull())


def from_proxies(files: DataFrame) -> DataFrame:
    """Entries of files (path, content): calls of the deprecated-module proxy, in the package that holds the file's module."""
    names = F.regexp_extract_all("content", F.lit(PROXY), 1), F.regexp_extract_all("content", F.lit(PROXY), 2)
    calls = files.select(F.regexp_extract(module_path(F.col("path")), r"^(.*)\.[^.]*$", 1).alias("parent"), F.explode(F.arrays_zip(names[0].alias("old"), names[1].alias("new"))).alias("c"))

    def inside(x: Column) -> Column:
        return F.when(F.col("parent") == "", x).otherwise(F.concat(F.col("parent"), F.lit("."), x))

    new = F.array_join(F.transform(bracket_modules(F.col("c.new")), inside), ", ")
    nothing = F.lit(None).cast("string")
    return calls.select(
        inside(F.col("c.old")).alias("old_path"), new.alias("new_path"), nothing.alias("deprecated_in"), nothing.alias("removed_in"), F.concat(F.lit("Use "), new, F.lit(" instead")).alias("note")
    )


def from_changelog(logs: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Notes of changelogs, whose headings are fixed by their format: items below `### Deprecated` or `### Removed` of a version, by the last headings above them."""
    line = logs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    version, heading = F.regexp_extract("line", r"^##\s+\[([^\]]+)\]", 1), F.regexp_extract("line", r"^###\s+(Deprecated|Removed)", 1)
    is_version = version != ""
    marked = line.withColumn("version", F.last(F.when(is_version, version), ignorenulls=True).over(w)).withColumn(
        "part", F.last(F.when(is_version | F.col("line").startswith("### "), F.when(is_version, "").otherwise(heading)), ignorenulls=True).over(w)
    )
    items = marked.filter(F.col("version").isNotNull() & (F.col("part") != "") & F.trim("line").startswith("- "))
    said = F.substring(F.trim("line"), 3, 2**30)
    return items.select(
        key, "pos", F.substring(said, 1, 80).alias("old_path"),
        F.when(F.col("part") == "Deprecated", F.col("version")).alias("deprecated_in"), F.when(F.col("part") == "Removed", F.col("version")).alias("removed_in"), said.alias("note"),
    )


def release_items(body: str) -> list[tuple[str, str]]:
    """(Deprecated or Removed, item) of a release body; lines without a dash continue an item."""
    out: list[list[str]] = []
    part, opened = "", False
    for line in body.splitlines():
        if line.startswith("###") and (line[3:4].isspace() or line.startswith("### ")):
            word = line[3:].strip()
            part, opened = next((p for p in ("Deprecated", "Removed") if word.startswith(p)), ""), False
        elif part and (said := line.strip()):
            if said.startswith("- "):
                out.append([part, said[2:]])
                opened = True
            elif opened:
                out[-1][1] += " " + said
    return [(p, t) for p, t in out]


def release_entries(version: str, body: str, package: str) -> list[dict]:
    """Entries of a release of package: its module paths before the word `use` are deprecated, those after it replace them; without paths the named symbols, else the item itself."""
    module, out = re.compile(rf"`({re.escape(package)}\.[a-zA-Z0-9_.]+)`"), []
    for part, text in release_items(body):
        use = re.search(r"\b[Uu]se\b", text)
        new = sorted(set(module.findall(text[use.start() :]))) if use else []
        old = [p for p in dict.fromkeys(module.findall(text)) if p not in new]
        keys = old or list(dict.fromkeys(DOTTED.findall(text) + SYMBOL.findall(text))) or [f"release:{version}:{text[:60]}"]
        lifecycle = {"deprecated_in": version if part == "Deprecated" else None, "removed_in": version if part == "Removed" else None}
        out += [{"old_path": k, "new_path": ", ".join(new) or None, **lifecycle, "note": text[:500]} for k in keys]
    return out


FOUND = struct("old_path string, new_path string, deprecated_in string, removed_in string, note string, version string, k int")


def release_rows(releases: DataFrame, package: str) -> DataFrame:
    """The entries of each of releases (version, body), with version and place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(e["old_path"], e["new_path"], e["deprecated_in"], e["removed_in"], e["note"], v, k) for v, b in zip(batch["version"], batch["body"]) for k, e in enumerate(release_entries(v, b or "", package))]
            if rows:
                yield pd.DataFrame(rows, columns=FOUND.names)

    return releases.select("version", "body").mapInPandas(run, FOUND)


def merged_releases(found: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, notes) of release_rows, oldest first by version text, whatever their order; existing entries come before and keep what they have."""
    real = found.filter(~F.col("old_path").startswith("release:")).withColumn("at", F.struct(F.lit(1).alias("s"), F.col("version").alias("v"), F.col("k").cast("long").alias("k")))
    if existing is not None:
        mine = existing.withColumn("at", F.struct(F.lit(0).alias("s"), F.lit("").alias("v"), F.col("ord").alias("k")))
        real = mine.select(*real.drop("version", "k").columns).unionByName(real.drop("version", "k"))

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("at"))).alias(c)

    merged = real.groupBy("old_path").agg(*[first(c) for c in ("new_path", "deprecated_in", "removed_in")], F.min_by("note", "at").alias("note"), F.min("at").alias("at"))
    return merged, found.filter(F.col("old_path").startswith("release:")).drop("version", "k")


def from_releases(releases: DataFrame, package: str, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return merged_releases(release_rows(releases, package), existing)


def load(spark, path: str) -> DataFrame:
    """A saved map (JSON lines or one JSON list); damaged files give no entries."""
    rows = spark.read.schema(T.StructType(list(ENTRIES) + [T.StructField("_bad", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("old_path is not null").select(*ENTRIES.names)


def save(entries: DataFrame, path: str) -> None:
    entries.select(*ENTRIES.names).coalesce(1).write.mode("overwrite").json(path)
