"""Connected components of an edge table, as rounds of hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) for every node of edges (a, b: long).

    A round hooks each node to its smallest neighbour if that is smaller, follows the hooks to their roots
    by doubling, and puts roots for nodes in the edges that are left; every component with more than one root
    loses roots, so a logarithmic number of rounds ends it. Nothing is collected.

    Defined results: edges with a null end and loops say nothing; repeated edges count once; nodes without edges are not listed; no edges give an empty table.
    """
    spark = edges.sparkSession
    left = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph-edges")
    mapping = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("component"))
        parent = written(parent, "graph-parent")
        while True:
            up = parent.select(F.col("node").alias("component"), F.col("component").alias("_next"))
            nxt = parent.join(up, "component").select("node", F.col("_next").alias("component"), (F.col("_next") != F.col("component")).alias("_moved"))
            nxt = written(nxt, "graph-parent")
            moved = not nxt.filter("_moved").isEmpty()
            parent = nxt.select("node", "component")
            if not moved:
                break
        if mapping is None:
            mapping = parent
        else:
            up = parent.select(F.col("node").alias("component"), F.col("component").alias("_next"))
            mapping = written(mapping.join(up, "component", "left").select("node", F.coalesce("_next", "component").alias("component")), "graph-mapping")
        root = parent.select(F.col("node").alias("a"), F.col("component").alias("_ra"))
        joined = left.join(root, "a").join(root.select(F.col("a").alias("b"), F.col("_ra").alias("_rb")), "b")
        left = joined.filter("_ra <> _rb").select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b")).distinct()
        left = written(left, "graph-edges")
    if mapping is None:
        return spark.createDataFrame([], "node long, component long")
    return mapping
