"""Boxes and seeds: semi and anti joins of points with boxes, overlaps of boxes, nearest seeds, labels with a whole domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import AXES

#: Most rows of a table that is broadcast.
SMALL = 100_000


def _slots(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _marked(points: DataFrame, boxes: DataFrame, size: float, margin: float, open_ends: bool) -> DataFrame:
    """ids of the points inside some box (lx, ux, ly, uy grown by margin): both sides meet in square cells."""
    grown = boxes.select(*[(F.col(f"l{a}") - margin).alias(f"l{a}") for a in "xy"], *[(F.col(f"u{a}") + margin).alias(f"u{a}") for a in "xy"])
    sent = grown.withColumn("cx", F.explode(_slots(F.col("lx"), F.col("ux"), size))).withColumn("cy", F.explode(_slots(F.col("ly"), F.col("uy"), size)))
    at = points.select("id", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    low = [F.col(a) > F.col(f"l{a}") if open_ends else F.col(a) >= F.col(f"l{a}") for a in "xy"]
    high = [F.col(a) < F.col(f"u{a}") if open_ends else F.col(a) <= F.col(f"u{a}") for a in "xy"]
    return at.join(sent, ["cx", "cy"]).filter(reduce(Column.__and__, low + high)).select("id").distinct()


def inside_boxes(points: DataFrame, boxes: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """points (id, x, y, ...) in at least one closed box."""
    return points.join(_marked(points, boxes, size, margin, False), "id", "left_semi")


def outside_boxes(points: DataFrame, boxes: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """points in no closed box; without boxes all of them."""
    return points.join(_marked(points, boxes, size, margin, False), "id", "left_anti")


def overlapping_boxes(boxes: DataFrame, size: float) -> DataFrame:
    """(a, b) with a < b: boxes (box, lx, ux, ly, uy, lz, uz) that share a point, touching included.

    Boxes meet in the cells they cover; a pair counts in the one cell that holds the lower corner of their common part, so
    that no pair comes twice and no distinct is needed.
    """
    sent = boxes.withColumn("cx", F.explode(_slots(F.col("lx"), F.col("ux"), size))).withColumn("cy", F.explode(_slots(F.col("ly"), F.col("uy"), size)))
    other = sent.select("cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("box", *[f"{s}{a}" for a in AXES for s in "lu"])])
    meets = [(F.col(f"l{a}") <= F.col(f"o_u{a}")) & (F.col(f"o_l{a}") <= F.col(f"u{a}")) for a in AXES]
    first = [F.floor(F.greatest(f"l{a}", f"o_l{a}") / size) == F.col(f"c{a}") for a in "xy"]
    near = sent.join(other, ["cx", "cy"]).filter(F.col("box") < F.col("o_box"))
    return near.filter(reduce(Column.__and__, meets + first)).select(F.col("box").alias("a"), F.col("o_box").alias("b"))


def nearest_seed(points: DataFrame, seeds: DataFrame, most: float, size: float | None = None) -> DataFrame:
    """(id, seed, dist): the nearest seed (seed, x, y) of each point in the plane, if nearer than most; ties to the lowest.

    Seeds go to the 3 x 3 cells, as wide as the limit, around them, so that a point meets near seeds only.
    """
    size = max(size or most, most)
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    sent = seeds.select("seed", F.col("x").alias("sx"), F.col("y").alias("sy")).withColumn("dx", step).withColumn("dy", step)
    sent = sent.withColumns({f"c{a}": F.floor(F.col(f"s{a}") / size) + F.col(f"d{a}") for a in "xy"}).drop("dx", "dy")
    at = points.select("id", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    near = at.join(sent, ["cx", "cy"]).withColumn("dist", F.sqrt(dx * dx + dy * dy)).filter(F.col("dist") < most)
    best = near.groupBy("id").agg(F.min(F.struct("dist", "seed")).alias("b"))
    return best.select("id", "b.seed", "b.dist")


def domain_counts(labels: DataFrame, label: str, size: int) -> DataFrame:
    """(label, n) for every label from 0 to size - 1, absent ones with 0."""
    whole = labels.sparkSession.range(size).select(F.col("id").alias(label))
    n = labels.groupBy(F.col(label).cast("long").alias(label)).agg(F.count(F.lit(1)).alias("n"))
    return whole.join(n, label, "left").fillna(0, ["n"])


def unknown_ids(asked: DataFrame, known: DataFrame) -> DataFrame:
    """ids asked for that are not known."""
    return asked.select("id").join(known.select("id"), "id", "left_anti")


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """(old, new) of two mappings (old, new) in a row; names that the second doesn't know drop out."""
    return first.select("old", F.col("new").alias("mid")).join(second.select(F.col("old").alias("mid"), "new"), "mid").select("old", "new")
