"""Dashboard jobs: points in three dimensions, clusters with labels, and statistics, as tables or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates


def preview(content: Column, n: int = 200) -> Column:
    return F.regexp_replace(F.substring(content, 1, n), r"[\r\n]+", " ")


def inferred_type(content: Column, chunk_type: Column) -> Column:
    """The chunk type, or what a chunk's first line says it is."""
    first = F.regexp_extract(content, r"^([^\n]*)", 1)
    guess = F.when(first.startswith("# Module:"), "module_overview").when(first.startswith("# class "), "class_overview").when(first.rlike(r"^# \w+\.\w+ in "), "method").when(first.rlike(r"^# \w+ in "), "function").when(first.startswith("# Type:"), "type_definition")
    return F.coalesce(F.nullif(chunk_type, F.lit("")), guess)


def points(chunks: DataFrame, seed: int = 42) -> DataFrame:
    """chunk_id, x, y, z, preview, kind, repo, content_type and what labels need. Principal components stand for the neighbour embedding, which Spark has not."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = chunks.filter("embedding is not null").withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    placed = PCA(k=3, inputCol="_v", outputCol="_p").fit(rows).transform(rows).withColumn("_p", vector_to_array("_p"))
    return placed.select(
        "chunk_id", *[F.col("_p")[k].alias(a) for k, a in enumerate("xyz")], preview(F.col("content")).alias("preview"), inferred_type(F.col("content"), F.col("chunk_type")).alias("kind"),
        "repo", "content_type", "class_name", "module_path", "path", F.col("seq").alias("ord"),
    )


def clusters(placed: DataFrame, k: int = 200, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(members with `cluster`, summaries with labels, the largest first)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = placed.withColumn("_v", array_to_vector(F.array("x", "y", "z")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows)
    members = model.transform(rows).drop("_v")
    summary = aggregates.cluster_summaries(members).join(aggregates.cluster_labels(members), "cluster")
    return members, summary.orderBy(F.desc("n"), "cluster")


def statistics(chunks: DataFrame) -> dict[str, DataFrame]:
    counts = chunks.groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))
    kinds = chunks.filter("content_type = 'source'").groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"))
    methods = chunks.filter(F.col("chunk_type").isin("method", "function"))
    return {
        "content_types": counts,
        "chunk_types": kinds,
        "treemap": aggregates.treemap(chunks).orderBy(F.desc("n"), "repo", "content_type"),
        "method_lengths": aggregates.length_histogram(methods),
        "chunk_sizes": aggregates.size_stats(chunks),
    }


def export(tables: dict[str, DataFrame], folder: str) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")
