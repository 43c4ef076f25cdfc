"""Graphs of rows: connected components and what can be reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected edges (src, dst): the least node that is reached, itself included.

    Large and small stars in turn, until the edges stay as they are; each round is a partial aggregate and a join, and its edges
    are a checkpoint in the folder that all executors share. Only a count and a checksum come to the driver.
    """
    shared(edges.sparkSession)
    now = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct().checkpoint()
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = small.filter("u <> v").distinct().checkpoint()
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == mark:
            break
        mark = got
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def labelled(rows: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """rows with component; a row without an edge is its own."""
    found = components(edges).withColumnRenamed("node", "__node")
    return rows.join(found, F.col(key) == F.col("__node"), "left").withColumn("component", F.coalesce("component", key)).drop("__node")


def reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, step): what the starts (node) reach along the directed edges (src, dst), and after how many steps; each round is a join
    of the frontier alone."""
    shared(starts.sparkSession)
    front = starts.select("node").distinct().withColumn("step", F.lit(0)).checkpoint()
    seen, step = front, 0
    while not front.isEmpty():
        step += 1
        onward = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = onward.join(seen, "node", "left_anti").withColumn("step", F.lit(step)).checkpoint()
        seen = seen.unionByName(front).checkpoint()
    return seen
