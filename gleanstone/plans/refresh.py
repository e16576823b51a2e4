"""Refresh: fingerprints decide which sources are made anew; their old rows go and the new ones come in one change of the store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import embed
from ..operators.aggregates import refresh_totals, summary_order
from ..operators.store import ChunkStore
from ..schema import conform
from ..sources.releases import follow_releases, followed

STATUS = ("new", "changed", "same", "gone")


def fingerprint(text: DataFrame, key: str, content: str) -> DataFrame:
    """key, fingerprint: of all of a source's content, whatever the order of its rows: their number and sums of four parts of their hashes, so a source of any size is one small state."""
    each = F.sha2(F.coalesce(content, F.lit("")), 256)
    sums = [F.sum(F.conv(F.substring("_h", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    rows = text.select(key, each.alias("_h"))
    return rows.groupBy(key).agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256).alias("fingerprint"))


def plan_changes(stored: DataFrame, now: DataFrame, key: str = "name") -> DataFrame:
    """key, status of each source, by (key, fingerprint) then and now."""
    a, b = stored.select(key, F.col("fingerprint").alias("_then")), now.select(key, F.col("fingerprint").alias("_now"))
    status = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_then") == F.col("_now"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"), F.col("_now").alias("fingerprint"))


@dataclass
class Source:
    """A named source: its text rows for the fingerprint, and how its chunk rows are made."""

    name: str
    content: DataFrame
    chunks: Callable[[], DataFrame]


@dataclass
class Releases:
    """Where the pages of release notes are, where their entries and the mark of what was read are kept, and the package whose paths count. existing: entries found elsewhere, which come first."""

    pages: str
    folder: str
    checkpoint: str
    package: str
    existing: DataFrame | None = None

    def update(self, spark: SparkSession) -> DataFrame:
        follow_releases(spark, self.pages, self.folder, self.checkpoint, self.package).awaitTermination()
        return followed(spark, self.folder, self.existing)


@dataclass
class Refreshed:
    summary: DataFrame
    fingerprints: DataFrame
    errors: dict[str, str] = field(default_factory=dict)

    deprecations: DataFrame | None = None

    def totals(self) -> DataFrame:
        return refresh_totals(self.summary)


def refresh(spark: SparkSession, store: ChunkStore, sources: list[Source], stored: DataFrame, force: bool = False, embedder=None, releases: Releases | None = None) -> Refreshed:
    """Bring the store up to date with sources, and the deprecation map with release notes, of which only new pages are read; stored has (name, fingerprint) of the last run, and a failed source keeps its rows but loses its fingerprint.

    Rows of a source are those whose repo is its name, or, for documentation (name `docs`), whose content_type is doc.
    """
    now = None
    for s in sources:
        one = fingerprint(s.content.select(F.lit(s.name).alias("name"), F.col(s.content.columns[0]).cast("string").alias("c")), "name", "c")
        now = one if now is None else now.unionByName(one)
    now = now if now is not None else spark.createDataFrame([], "name string, fingerprint string")
    plan = {r["name"]: (r["status"], r["fingerprint"]) for r in plan_changes(stored, now).collect()}  # a row for each configured source
    rows = store.read()

    def own(name: str) -> Column:
        return F.coalesce((F.col("content_type") == "doc") & F.col("repo").isNull(), F.lit(False)) if name == "docs" else F.coalesce(F.col("repo") == name, F.lit(False))

    before = {name: rows.filter(own(name)).count() for name in plan}
    goes, added, out, errors = F.lit(False), [], [], {}
    by_name = {s.name: s for s in sources}
    for name, (status, print_) in plan.items():
        if status == "gone":
            goes |= own(name)
            out.append((name, "removed", before[name], 0, None))
        elif status == "same" and not force:
            out.append((name, "skipped", before[name], 0, print_))
        else:
            try:
                fresh = conform(embed(by_name[name].chunks(), *([embedder] if embedder else [])))
                n = fresh.count()
            except Exception as e:  # one source's failure is reported, and the others go on
                errors[name] = str(e).splitlines()[0]
                out.append((name, "error", before[name], 0, None))
                continue
            goes |= own(name)
            added.append(fresh)
            out.append((name, "updated", before[name], n, print_))
    if added or any(o[1] == "removed" for o in out):
        store.change(reduce(DataFrame.unionByName, added) if added else None, goes)
    summary = spark.createDataFrame(out, "name string, status string, existing long, upserted long, fingerprint string")
    prints = summary.filter("fingerprint is not null").select("name", "fingerprint")
    return Refreshed(summary_order(summary.drop("fingerprint")), prints, errors, releases.update(spark) if releases else None)
