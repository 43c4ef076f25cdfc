"""Outlines of masks as ordered loops.

Every side of an occupied cell towards an empty one is a directed edge with the cell on its left; sides that follow each other in a
straight line are one segment. At a corner where two cells touch the segment goes on with a left turn, which keeps the cells
apart; where one loop comes through such a corner twice it is cut into two. Loops are the components of "is followed by";
the order along a loop comes from doubling: each round a segment learns how far it is from the end over twice as many steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import shared
from . import graphs

#: Direction of the edge below, right of, above and left of a cell, and where it begins: fixed by "occupied on the left".
_SIDES = ((0, -1, 1, 0, 0, 0), (1, 0, 0, 1, 1, 0), (0, 1, -1, 0, 1, 1), (-1, 0, 0, -1, 0, 1))


def segments(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, ax, ay, bx, by, dx, dy): straight stretches of the outline, from a to b in direction d."""
    one = cells.select(*key, F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy")).distinct()
    sides = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("ox", "oy", "dx", "dy", "sx", "sy"), s, strict=True)]) for s in _SIDES])).alias("m")
    out = one.select(*key, "ix", "iy", sides).select(*key, "ix", "iy", (F.col("ix") + F.col("m.ox")).alias("nx"), (F.col("iy") + F.col("m.oy")).alias("ny"), "m.dx", "m.dy", (F.col("ix") + F.col("m.sx")).alias("x"), (F.col("iy") + F.col("m.sy")).alias("y"))
    out = out.join(one.select(*key, F.col("ix").alias("nx"), F.col("iy").alias("ny")), [*key, "nx", "ny"], "left_anti")
    # Along its line a stretch's places rise by one: their difference to the row's number is the same.
    line, along = F.when(F.col("dx") != 0, F.col("y")).otherwise(F.col("x")), F.when(F.col("dx") != 0, F.col("x")).otherwise(F.col("y"))
    out = out.withColumns({"__line": line, "__at": along})
    run = F.col("__at") - F.row_number().over(Window.partitionBy(*key, "dx", "dy", "__line").orderBy("__at"))
    got = out.withColumn("__run", run).groupBy(*key, "dx", "dy", "__line", "__run").agg(F.min("__at").alias("__low"), F.max("__at").alias("__high"))
    start = F.when(F.col("dx") + F.col("dy") > 0, F.col("__low")).otherwise(F.col("__high"))
    end = F.when(F.col("dx") + F.col("dy") > 0, F.col("__high") + 1).otherwise(F.col("__low") - 1)
    flat = F.col("dx") != 0
    at = lambda c, x: F.when(flat == x, c).otherwise(F.col("__line"))
    return got.select(*key, at(start, True).alias("ax"), at(start, False).alias("ay"), at(end, True).alias("bx"), at(end, False).alias("by"), "dx", "dy")


def _ranked(follows: DataFrame) -> DataFrame:
    """(seg, loop, place) of follows (seg, next, loop), loop being the least seg of a cycle: how many steps it is from loop to seg."""
    # The cycle is cut before its least segment; who comes to the cut has nobody next.
    now = follows.select("seg", "loop", F.when(F.col("next") != F.col("loop"), F.col("next")).alias("to"), F.lit(1).cast("long").alias("far")).checkpoint()
    while not now.filter("to is not null").isEmpty():
        ahead = now.select(F.col("seg").alias("to"), F.col("to").alias("__to"), F.col("far").alias("__far"))
        now = now.join(ahead, "to", "left").select("seg", "loop", F.col("__to").alias("to"), (F.col("far") + F.coalesce("__far", F.lit(0))).alias("far")).checkpoint()
    whole = now.groupBy("loop").agg(F.max("far").alias("__all"))
    return now.join(whole, "loop").select("seg", "loop", (F.col("__all") - F.col("far")).alias("place"))


def loops(cells: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, lx, ly, place, x, y): the corners of each loop in order, occupied cells on the left; straight on is no corner.

    A loop is named by its least corner by x, then y, where it begins; of two loops that touch there each is named so, with `turn` telling
    them apart: the direction (0 to 3, from x on) in which it leaves. Outer loops run against the clock, those of holes with it. A
    number of rounds that grows with the logarithm of the longest loop; no loop is ever one row or one task.
    """
    key = key or []
    shared(cells.sparkSession)
    turn = F.when(F.col("dx") == 1, 0).when(F.col("dy") == 1, 1).when(F.col("dx") == -1, 2).otherwise(3)
    segs = segments(cells, key).withColumn("turn", turn).withColumn("seg", F.struct(*key, F.col("ax").alias("x"), F.col("ay").alias("y"), "turn")).checkpoint()
    ahead = segs.select(*key, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("dx").alias("ox"), F.col("dy").alias("oy"), F.col("seg").alias("next"))
    left = F.col("dx") * F.col("oy") - F.col("dy") * F.col("ox")
    ways = segs.join(ahead, [*key, "bx", "by"]).select("seg", "next", left.alias("left"), F.count(F.lit(1)).over(Window.partitionBy("seg")).alias("ways"), *key, "bx", "by").checkpoint()
    follows = ways.filter("ways = 1 or left > 0")
    found = graphs.components(follows.select(F.col("seg").alias("src"), F.col("next").alias("dst"))).checkpoint()
    # A corner that one loop comes to twice: both of its segments go on to the right instead.
    twice = follows.filter("ways = 2").join(found, F.col("seg") == F.col("node")).groupBy(*key, "bx", "by").agg(F.countDistinct("component").alias("__loops")).filter("__loops = 1")
    cut = ways.join(twice, [*key, "bx", "by"], "left").filter((F.col("ways") == 1) | F.when(F.col("__loops").isNull(), F.col("left") > 0).otherwise(F.col("left") < 0))
    follows = cut.select("seg", "next").checkpoint()
    if not twice.isEmpty():
        found = graphs.components(follows.select(F.col("seg").alias("src"), F.col("next").alias("dst"))).checkpoint()
    placed = _ranked(follows.join(found, F.col("seg") == F.col("node")).select("seg", "next", F.col("component").alias("loop")))
    return placed.select(*[F.col(f"seg.{k}").alias(k) for k in key], F.col("loop.x").alias("lx"), F.col("loop.y").alias("ly"), F.col("loop.turn").alias("turn"), "place", F.col("seg.x").alias("x"), F.col("seg.y").alias("y"))


def areas(corners: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, lx, ly, turn, n, area2): corners of each loop and twice its signed area; a hole's is negative."""
    of = [*(key or []), "lx", "ly", "turn"]
    w = Window.partitionBy(*of).orderBy("place")
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(w)) for c in ("x", "y"))
    return corners.withColumn("__c", F.col("x") * ny - F.col("y") * nx).groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.sum("__c").alias("area2"))
