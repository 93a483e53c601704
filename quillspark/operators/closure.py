"""Trees given as rows with a parent: every node's root and depth, and all descendants of chosen nodes, at any depth.

Pointers are doubled: after each round a node knows the ancestor twice as far, so a tree of depth d takes log2(d) rounds, each one join
of the nodes that aren't settled yet, written to a folder between rounds. Nodes on a cycle, or below one, never reach a root: a round
that settles nothing shows that only such are left, and they get a null root and ``cyclic``. A parent that isn't a node makes
a root, as does a null one. Rows that repeat a node count once (the smallest parent); null nodes are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pointers(df: DataFrame, key: str, parent: str, path: str, stops: DataFrame | None = None) -> DataFrame:
    """key, root (nearest strict ancestor that is a root or one of ``stops``; the node itself if it is a root), depth (steps to
    it), cyclic. ``path``: a new folder for the rounds."""
    edges = df.select(F.col(key).alias("key"), F.col(parent).alias("parent")).where("key is not null").groupBy("key").agg(F.min("parent").alias("parent"))
    nodes = edges.select(F.col("key").alias("parent"), F.lit(True).alias("is_node"))
    edges = edges.join(nodes, "parent", "left").select("key", F.when(F.coalesce("is_node", F.lit(False)), F.col("parent")).alias("parent"))
    ends = edges.where("parent is null").select("key")
    ends = ends.union(stops.select(F.col(stops.columns[0]).alias("key"))).distinct() if stops is not None else ends
    start = edges.join(ends.select(F.col("key").alias("parent"), F.lit(True).alias("at_end")), "parent", "left")
    start = start.select("key", F.coalesce("parent", "key").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), (F.col("parent").isNull() | F.coalesce("at_end", F.lit(False))).alias("settled"))
    # settled nodes are kept as they settle; each round joins and writes the others alone
    done, open_ = [_stored(start, f"{path}/0").where("settled")], _stored(start.where("not settled"), f"{path}/open0")
    left, k = open_.count(), 0
    while left:
        k += 1
        known = open_
        for d in done:
            known = known.unionByName(d)
        step = known.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("settled").alias("ends"))
        moved = open_.drop("settled").join(step, "up").select("key", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("settled"))
        moved = _stored(moved, f"{path}/{k}")
        now = moved.where("not settled").count()
        done.append(moved.where("settled"))
        open_ = moved.where("not settled")
        if now == left:
            break
        left = now
    out = open_.select("key", F.lit(None).cast(dict(start.dtypes)["up"]).alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(True).alias("cyclic"))
    for d in done:
        out = out.unionByName(d.select("key", F.col("up").alias("root"), "depth", F.lit(False).alias("cyclic")))
    return out


def descendants(df: DataFrame, key: str, parent: str, chosen: DataFrame, path: str) -> DataFrame:
    """ancestor, key, depth of all nodes below each node of ``chosen`` (its first column).

    Every node points to its nearest chosen ancestor; chosen nodes under chosen ones pass their nodes on, so the rounds follow how deep the
    chosen nest, not the tree. A chosen node on a cycle has its cycle's nodes below it, but itself."""
    picked = chosen.select(F.col(chosen.columns[0]).alias("key")).where("key is not null").distinct()
    near = pointers(df, key, parent, f"{path}/near", picked).where("not cyclic and depth > 0").join(picked.select(F.col("key").alias("root")), "root", "left_semi")
    near = _stored(near.select("key", F.col("root").alias("ancestor"), "depth"), f"{path}/nearest")
    links = near.join(picked, "key", "left_semi").select(F.col("key").alias("via"), F.col("ancestor").alias("above"), F.col("depth").alias("more"))
    found, level, k = near, near, 0
    while True:
        k += 1
        level = level.join(links, F.col("ancestor") == F.col("via")).where(F.col("above") != F.col("key")).select("key", F.col("above").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        level = _stored(level.join(found.select("key", "ancestor"), ["key", "ancestor"], "left_anti"), f"{path}/level{k}")
        if level.isEmpty():
            return found.where("key <> ancestor").select("ancestor", "key", "depth")
        found = found.unionByName(level)
