"""Version pins of example folders, from their dependency files or those of the nearest folder above."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The files that are looked at, the first first.
FILES = ("pyproject.toml", "requirements.txt", "package.json")


def _requirement(line: str, package: str) -> str | None:
    """The specifier of a requirement line for package, without extras and markers; an empty text if it has none."""
    m = re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*\(?([^;#)@]*)", line)
    same = m and re.sub(r"[-_.]+", "-", m[1]).lower() == re.sub(r"[-_.]+", "-", package).lower()
    if not same:
        return None
    from packaging.specifiers import InvalidSpecifier, SpecifierSet

    try:
        return str(SpecifierSet(m[2].strip()))
    except InvalidSpecifier:
        return None


def pin_of(name: str, text: str, package: str, npm_scope: str | None = None) -> str | None:
    """The pin in a dependency file; npm ranges stay as written, and any package of npm_scope (such as `@name/`) counts, too; damaged files have none."""
    try:
        if name == "requirements.txt":
            return next((p for line in text.splitlines() if (p := _requirement(line, package))), None)
        if name == "pyproject.toml":
            project = tomllib.loads(text).get("project", {})
            listed = [*project.get("dependencies", []), *(x for group in project.get("optional-dependencies", {}).values() for x in group)]
            return next((p for line in listed if (p := _requirement(line, package))), None)
        if name == "package.json":
            data = json.loads(text)
            found = {**data.get("devDependencies", {}), **data.get("dependencies", {})}
            return next((str(v) for k, v in found.items() if k == package or (npm_scope and k.startswith(npm_scope))), None)
    except (tomllib.TOMLDecodeError, json.JSONDecodeError, AttributeError, TypeError):
        pass
    return None


def file_pins(files: DataFrame, package: str, npm_scope: str | None = None) -> DataFrame:
    """repo, dir, prio, pin of every dependency file that has one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(pin=[pin_of(n, t or "", package, npm_scope) for n, t in zip(batch["name"], batch["content"])]).drop(columns="content")

    name = F.regexp_extract("path", r"([^/]+)$", 1)
    own = files.filter(name.isin(*FILES)).select("repo", F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("dir"), name.alias("name"), "content")
    pins = own.mapInPandas(run, "repo string, dir string, name string, pin string").filter("pin is not null")
    return pins.withColumn("prio", F.array_position(F.array(*[F.lit(f) for f in FILES]), F.col("name")))


def nearest_pins(dirs: DataFrame, pins: DataFrame) -> DataFrame:
    """repo, dir, pin: of the nearest folder upward that has one. A folder has as many ancestors as parts, so this is an equi-join."""
    parts = F.filter(F.split("dir", "/"), lambda p: ~p.isin("", "."))
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("at")))
    up = dirs.select("repo", "dir").distinct().select("repo", "dir", F.explode(ups).alias("u")).select("repo", "dir", "u.depth", F.col("u.at").alias("at"))
    found = up.join(pins.select("repo", F.col("dir").alias("at"), "prio", "pin"), ["repo", "at"])
    w = Window.partitionBy("repo", "dir").orderBy(F.desc("depth"), "prio")
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("repo", "dir", "pin")
