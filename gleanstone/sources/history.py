"""Tags and versions from the rows of a repository's history: no cloning, only tables of references, tag objects and commits.

Tables: refs (repo, name, sha) are the tags; tags (repo, sha, target) are annotated tag objects, which may point to each other; commits (repo, sha, parents: an array, the first parent first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch

KEY = ["repo", "sha"]
#: Fixed value: how a tag may be written.
TAG = r"^[A-Za-z0-9][A-Za-z0-9._+/-]*$"


def _kept(rows: DataFrame) -> DataFrame:
    """rows as a table in the shared folder, so that the next round begins there."""
    path = scratch(rows.sparkSession, "history")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def peeled(refs: DataFrame, tags: DataFrame) -> DataFrame:
    """repo, name, sha: the commit behind each tag. Chains of tag objects halve with each round, so their number bounds the rounds; a chain that bites its tail has no end and gives no row."""
    links = _kept(tags.select("repo", "sha", "target").dropDuplicates(KEY))
    for _ in range(links.count().bit_length() + 1):
        up = links.select("repo", F.col("sha").alias("target"), F.col("target").alias("_next"))
        moved = links.join(up, ["repo", "target"], "left")
        if moved.filter("_next is not null").isEmpty():
            break
        links = _kept(moved.select("repo", "sha", F.coalesce("_next", "target").alias("target")))
    ends = links.join(links.select("repo", F.col("sha").alias("target")), ["repo", "target"], "left_anti")
    out = refs.select("repo", "name", "sha").join(ends, KEY, "left").join(tags.select(*KEY, F.lit(True).alias("_object")).distinct(), KEY, "left")
    return out.filter("target is not null or _object is null").select("repo", "name", F.coalesce("target", "sha").alias("sha"))


def resolved(asked: DataFrame, refs: DataFrame, tags: DataFrame) -> DataFrame:
    """asked (repo, tag) with name and sha of the commit: the tag as it is written, else with or without a `v` before it; nulls if there is none or it is not written like a tag."""
    bare = F.when(F.col("tag").startswith("v"), F.substring("tag", 2, 2**30)).otherwise(F.concat(F.lit("v"), "tag"))
    names = asked.select("repo", "tag").distinct().filter(F.col("tag").rlike(TAG)).select("repo", "tag", F.posexplode(F.array("tag", bare)).alias("_nth", "name"))
    found = names.join(peeled(refs, tags), ["repo", "name"]).groupBy("repo", "tag").agg(F.min_by(F.struct("name", "sha"), "_nth").alias("_f"))
    return asked.join(found, ["repo", "tag"], "left").select(*asked.columns, F.col("_f.name").alias("name"), F.col("_f.sha").alias("sha"))


def _further(found: Column, steps: Column | int) -> Column:
    return F.when(found.isNotNull(), F.struct((found["distance"] + steps).cast("long").alias("distance"), found["name"].alias("name")))


#: Steps from the tags go on while each settles at least one in so many of the commits that are left.
SHARE = 16


def described(commits: DataFrame, refs: DataFrame, tags: DataFrame) -> DataFrame:
    """repo, sha, name, distance, version of each commit: the tag with the fewest steps to it over parents (of several the first name), and the name without its `v`s; nulls where no tag is behind it.

    Commits settle by their distance, step by step from the tags, and only those that are left are read again. What settles at a distance has a parent that settled one step before, so the nearest tag and its first name are
    final. Once a step settles few, the rest has long ways, and goes by doubling (_far), with the settled parents as its ends.
    """
    here = peeled(refs, tags).groupBy(*KEY).agg(F.min("name").alias("name"))
    rows = _kept(commits.dropDuplicates(KEY).join(here, KEY, "left").select(*KEY, "parents", "name"))
    front = rows.filter("name is not null").select(*KEY, F.lit(0).cast("long").alias("distance"), "name")
    left, settled = rows.filter("name is null").drop("name"), front
    n, new, step = left.count(), front.count(), 0
    while n and new and (new * SHARE >= n or not step):
        step += 1
        up = front.select("repo", F.col("sha").alias("up"), "name")
        near = left.select(*KEY, F.explode("parents").alias("up")).join(up, ["repo", "up"]).groupBy(*KEY).agg(F.min("name").alias("name"))
        both = _kept(left.join(near, KEY, "left"))
        front = both.filter("name is not null").select(*KEY, F.lit(step).cast("long").alias("distance"), "name")
        left, settled, new = both.filter("name is null").drop("name"), settled.unionByName(front), front.count()
        n -= new
    rest = _far(left, settled) if n and new else left.select(*KEY, F.lit(None).cast("long").alias("distance"), F.lit(None).cast("string").alias("name"))
    return settled.unionByName(rest).select(*KEY, "name", "distance", F.regexp_replace("name", "^v+", "").alias("version"))


def _far(left: DataFrame, settled: DataFrame) -> DataFrame:
    """repo, sha, distance, name of the commits left (repo, sha, parents), given those that are settled (repo, sha, distance, name).

    Tags spread along first parents by doubling: after k rounds a commit knows the nearest tag among 2 ** k ancestors and points to the one behind them, unless a tag is nearer than that one. Then one step over the other
    parents carries them across merges, and both repeat until nothing gets nearer: as often as the nearest path changes over to another line, not once for each commit.
    """
    best = F.struct("distance", "name")
    ends = settled.join(left.select("repo", F.explode("parents").alias("sha")).distinct(), KEY, "left_semi")
    ends = ends.select(*KEY, F.array().cast("array<string>").alias("parents"), best.alias("best"))
    state = _kept(left.select(*KEY, "parents", F.lit(None).cast(ends.schema["best"].dataType).alias("best")).unionByName(ends))
    while True:
        line = _kept(state.select(*KEY, F.get("parents", F.lit(0)).alias("up"), F.lit(1).cast("long").alias("steps"), "best"))
        while not line.filter("up is not null").isEmpty():
            above = line.select("repo", F.col("sha").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("best").alias("_best"))
            both = line.join(above, ["repo", "up"], "left")
            both = both.select(*KEY, F.col("_up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.least("best", _further(F.col("_best"), F.col("steps"))).alias("best"))
            line = _kept(both.withColumn("up", F.when(F.coalesce(F.col("best.distance") >= F.col("steps"), F.lit(True)), F.col("up"))))
        others = state.select(*KEY, F.explode(F.slice("parents", 2, 2**30)).alias("up")).join(line.select("repo", F.col("sha").alias("up"), F.col("best").alias("_best")), ["repo", "up"])
        across = others.groupBy(*KEY).agg(F.min(_further(F.col("_best"), 1)).alias("_best"))
        nearer = line.select(*KEY, "best").join(across, KEY, "left").select(*KEY, F.least("best", "_best").alias("best"), F.coalesce((F.col("_best") < F.col("best")) | (F.col("best").isNull() & F.col("_best").isNotNull()), F.lit(False)).alias("_moved"))
        nearer = _kept(nearer)
        if nearer.filter("_moved").isEmpty():
            break
        state = _kept(state.drop("best").join(nearer.drop("_moved"), KEY))
    return nearer.join(left.select(*KEY), KEY, "left_semi").select(*KEY, "best.distance", "best.name")
