"""Statistics of the chunk table and of its clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper ends of the bins of method lengths; the last is open.
LENGTH_BINS = (5, 10, 20, 50, 100, 200, 500)


def index_stats(chunks: DataFrame) -> DataFrame:
    """name, value: rows by content type, all rows, distinct commits."""
    by = chunks.groupBy("content_type").agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.lit("count:"), "content_type").alias("name"), "value")
    whole = chunks.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("commit_sha").alias("commits"))
    return by.unionByName(whole.select(F.lit("total").alias("name"), F.col("total").alias("value"))).unionByName(
        whole.select(F.lit("commits").alias("name"), F.col("commits").alias("value"))
    )


def counts_by_repo(chunks: DataFrame, docs_name: str = "docs") -> DataFrame:
    """repo, n: rows of each repository, and all documentation rows under a name of their own (those with a repository count for both)."""
    own = chunks.filter("repo is not null").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    docs = chunks.filter("content_type = 'doc'").agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(docs_name).alias("repo"), "n")
    return own.unionByName(docs)


def treemap(chunks: DataFrame, docs_name: str = "docs") -> DataFrame:
    return chunks.groupBy(F.coalesce("repo", F.lit(docs_name)).alias("repo"), "content_type").agg(F.count(F.lit(1)).alias("n"))


def length_bin(lines: Column) -> Column:
    out = F.lit(len(LENGTH_BINS))
    for k in reversed(range(len(LENGTH_BINS))):
        out = F.when(lines <= LENGTH_BINS[k], k).otherwise(out)
    return out


def length_histogram(chunks: DataFrame, content: str = "content") -> DataFrame:
    """bin, n, cumulative, share up to the bin: of the number of lines."""
    n_lines = F.size(F.split(content, "\n"))
    counted = chunks.filter(F.col(content).isNotNull()).groupBy(length_bin(n_lines).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # 8 rows
    whole = Window.partitionBy(F.lit(1))
    return counted.select("bin", "n", F.sum("n").over(up).alias("cumulative"), (F.sum("n").over(up) / F.sum("n").over(whole)).alias("share"))


def size_stats(chunks: DataFrame, content: str = "content") -> DataFrame:
    size = F.length(content)
    return chunks.groupBy("content_type").agg(F.min(size).alias("least"), F.bround(F.avg(size), 0).cast("long").alias("mean"), F.max(size).alias("most"))


def best_tags(tags: DataFrame, key: str) -> DataFrame:
    """key, name, confidence, source: each name's most confident tag; ties go to manual, code, readme, directory, then to the first (ord)."""
    prio = F.when(F.col("source") == "manual", 4).when(F.col("source") == "code", 3).when(F.col("source") == "readme", 2).otherwise(1)
    w = Window.partitionBy(key, "name").orderBy(F.desc("confidence"), F.desc(prio), "ord")
    return tags.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(key, "name", "confidence", "source")


def reassembled(chunks: DataFrame, key: str = "path", seq: str = "seq", content: str = "content", sep: str = "\n\n") -> DataFrame:
    """key, content: the parts of a page in order. A page's chunks are bounded by the page."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(content).alias("c"))))
    return chunks.groupBy(key).agg(parts.alias("_p")).select(key, F.array_join(F.transform("_p", lambda p: p["c"]), sep).alias("content"))


def most_common(rows: DataFrame, by: list[str], value: str, n: int, order: str) -> DataFrame:
    """The n most frequent values of each group, ties by first occurrence."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "_first")
    return counted.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).drop("_first")


def cluster_summaries(points: DataFrame) -> DataFrame:
    """Of points (cluster, x, y, z, content_type, repo, ord): count, kinds, top repositories, centroid and mean distance to it, largest cluster first."""
    centre = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"c{a}") for a in "xyz"])
    gap = F.sqrt(sum((F.col(a) - F.col(f"c{a}")) ** 2 for a in "xyz"))
    spread = points.join(centre, "cluster").groupBy("cluster").agg(F.avg(gap).alias("spread"))
    kinds = points.groupBy("cluster", "content_type").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("content_type", "k")))).alias("kinds"))
    top = most_common(points, ["cluster"], "repo", 3, "ord").groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("place", "repo", "n"))).alias("top_repos"))
    return centre.join(spread, "cluster").join(kinds, "cluster").join(top, "cluster", "left")


def cluster_labels(points: DataFrame) -> DataFrame:
    """cluster, label: its two most frequent class names, else ends of module paths, else folders, else content types."""
    choices = {
        "class_name": F.col("class_name"),
        "module": F.regexp_extract("module_path", r"([^.]+)$", 1),
        "folder": F.regexp_extract("path", r"([^/]+)/[^/]*$", 1),
        "content_type": F.col("content_type"),
    }
    out = points.select("cluster").distinct()
    for name, value in choices.items():
        rows = points.select("cluster", "ord", F.nullif(value, F.lit("")).alias("v"))
        two = most_common(rows, ["cluster"], "v", 2, "ord").groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("_t"))
        out = out.join(two.select("cluster", F.array_join(F.transform("_t", lambda t: t["v"]), " / ").alias(name)), "cluster", "left")
    return out.select("cluster", F.coalesce(*choices, F.lit("cluster")).alias("label"))


def group_centroids(points: DataFrame, label: str = "label") -> DataFrame:
    return points.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in "xyz"]).filter("n >= 2")


def blended(colours: DataFrame, by: str) -> DataFrame:
    """The mean colour of each group, weighted by n: columns r, g, b, n."""
    return colours.groupBy(by).agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"])


def refresh_totals(sources: DataFrame) -> DataFrame:
    """Of (name, status, existing, upserted): the totals; skipped sources carry what they had."""
    return sources.agg(
        F.sum(F.when(F.col("status") == "skipped", F.col("existing")).otherwise(F.col("upserted"))).alias("records"),
        F.sum(F.when(F.col("status") == "updated", F.col("upserted")).otherwise(0)).alias("updated"),
        F.sum((F.col("status") == "error").cast("int")).alias("errors"),
    )


def summary_order(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.col("status") == "skipped", "name")


def latency_stats(runs: DataFrame, by: str = "name") -> DataFrame:
    """Of (name, run, ms): median, least and most, the first run of each name aside."""
    w = Window.partitionBy(by).orderBy("run")
    warm = runs.withColumn("_n", F.row_number().over(w)).filter("_n > 1")
    return warm.groupBy(by).agg(F.median("ms").alias("median"), F.min("ms").alias("least"), F.max("ms").alias("most"))


def quality_score(cases: DataFrame) -> DataFrame:
    """Of (name, haystack, alias_groups array<array<string>>): the share of groups of which any alias occurs."""
    hay = F.lower("haystack")
    hits = F.filter("alias_groups", lambda g: F.exists(g, lambda a: hay.contains(F.lower(a))))
    return cases.select("name", (F.size(hits) / F.greatest(F.size("alias_groups"), F.lit(1))).alias("coverage"))
