"""Connected components of an edge table, in rounds of joins with written tables between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component: the smallest node.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond", 2014) until no edge changes, about log(n) rounds. Each step only
    groups by a node to take a minimum, which combines before the shuffle, and joins it back.
    Loops and repeated edges are harmless; no edges give no rows.
    """
    stage = Stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if stage.df.isEmpty():
        return stage.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = Stage(stage.df.select("u").unionByName(stage.df.select(F.col("v").alias("u"))).distinct(), "nodes")
    mark = None
    while True:
        both = stage.df.unionByName(stage.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        lower = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = Stage(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = new.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stage.drop()
        stage = new
        if now == mark:
            break
        mark = now
    return nodes.df.join(stage.df.groupBy("u").agg(F.min("v").alias("v")), "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
