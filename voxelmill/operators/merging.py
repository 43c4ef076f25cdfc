"""Planes of neighbouring regions made one where their common rows stay flat."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import shared, stored
from .attributes import dot
from .cells import AXES
from .regions import refitted

_NORMAL = ["nx", "ny", "nz"]
_MODEL = ["cluster", *_NORMAL, "offset", "n", "cx", "cy", "cz", "room"]
#: As many planes as a cluster takes in a round at first: all that ask.
ALL = 1 << 40


def region_key(plane: str = "plane"):
    """One number for (tx, ty, plane): regions within a million of the origin, up to 64 planes each."""
    return ((F.col("tx") + (1 << 20)) * (1 << 21) + F.col("ty") + (1 << 20)) * 64 + F.col(plane)


def region_links(planes: DataFrame) -> DataFrame:
    """(a, b), a < b: keys of planes (tx, ty, plane) in one region or in regions that touch."""
    own = planes.select("tx", "ty", region_key().alias("a"))
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("m")
    sent = planes.select(region_key().alias("b"), "tx", "ty", moves).select("b", (F.col("tx") + F.col("m.i")).alias("tx"), (F.col("ty") + F.col("m.j")).alias("ty"))
    return own.join(sent, ["tx", "ty"]).filter("a < b").select("a", "b")


def _verdicts(rows: DataFrame, tolerance: float, quantile: float) -> DataFrame:
    """(cluster, good) of rows (cluster, off): whether the interpolated quantile of off is within the tolerance, from four aggregates."""
    inside = F.col("off") <= tolerance
    seen = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.count_if(inside).alias("c"), F.max(F.when(inside, F.col("off"))).alias("low"), F.min(F.when(~inside, F.col("off"))).alias("high"))
    at = (F.col("m") - 1) * quantile
    k = F.floor(at)
    between = F.col("low") + (at - k) * (F.coalesce("high", "low") - F.col("low"))
    return seen.select("cluster", F.coalesce((F.col("c") >= k + 2) | ((F.col("c") == k + 1) & (between <= tolerance)), F.lit(False)).alias("good"))


def merged_planes(members: DataFrame, planes: DataFrame, links: DataFrame, tolerance: float = 0.04, degrees: float = 2.0, quantile: float = 0.95) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cluster, nx, ny, nz, offset, n), (cluster, id, x, y, z) and (plane, cluster) of planes (plane, nx, ny, nz, offset) with members
    (plane, id, x, y, z) and links (a, b) between planes near each other; a cluster is named for the plane that took the others.

    Two linked clusters may become one if their normals are within the degrees and the centre of the smaller lies within the
    tolerance of the larger's plane, and do if the plane refitted to their common rows has the quantile of distances within the
    tolerance; rows farther off are let go. Links go on between what has become one. In a round many stars are tried: in even ones each
    cluster larger than all it could join takes those for which it is the largest; in odd ones a coin by key tells who takes. A star
    that fails is tried again with half as many, until a pair fails, which rests until one of the two has changed. So rounds grow
    with the logarithm of a plane's pieces, not with their number, and no plane's rows meet in one task. It ends when no
    linked pair may become one. More rows come before fewer, then the greater key. Planes without members are left out; rows
    that a plane lists twice count once, as do those that two planes of a star share. Empty in, empty out.
    """
    shared(members.sparkSession)
    rows = stored(members.select(F.col("plane").alias("cluster"), "id", *AXES).dropDuplicates(["cluster", "id"]), "merge-rows")
    centres = lambda r: r.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"c{a}") for a in AXES])
    given = planes.select(F.col("plane").alias("cluster"), *_NORMAL, "offset").dropDuplicates(["cluster"])
    models = stored(given.join(centres(rows), "cluster").withColumn("room", F.lit(ALL)).select(*_MODEL), "merge-models")
    rows = rows.join(models.select("cluster"), "cluster", "left_semi")
    of = models.select(F.col("cluster").alias("plane"), "cluster")
    ties = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ties = stored(ties.withColumn("tried", F.lit(False)), "merge-links")
    number = 0
    while True:
        side = lambda p: models.select(*[F.col(c).alias(f"{p}_{c}") for c in _MODEL])
        live = ties.filter(~F.col("tried")).join(side("a"), F.col("a") == F.col("a_cluster")).join(side("b"), F.col("b") == F.col("b_cluster"))
        first = F.struct("a_n", "a_cluster") > F.struct("b_n", "b_cluster")
        normal = {p: [F.col(f"{p}_{c}") for c in _NORMAL] for p in "ab"}
        centre = {p: [F.col(f"{p}_c{a}") for a in AXES] for p in "ab"}
        off = F.when(first, dot(normal["a"], centre["b"]) + F.col("a_offset")).otherwise(dot(normal["b"], centre["a"]) + F.col("b_offset"))
        even = (F.abs(dot(normal["a"], normal["b"])) >= math.cos(math.radians(degrees))) & (F.abs(off) <= tolerance)
        judged = stored(live.select("a", "b", "a_n", "b_n", F.coalesce(even, F.lit(False)).alias("even")), "merge-judged")
        fit = judged.filter("even")
        if fit.isEmpty():
            break
        ends = fit.selectExpr("a AS tail", "a_n AS tn", "struct(b_n AS n, b AS cluster) AS to").unionByName(fit.selectExpr("b AS tail", "b_n AS tn", "struct(a_n AS n, a AS cluster) AS to"))
        if number % 2:
            coin = lambda c: F.pmod(F.xxhash64(c, F.lit(number)), F.lit(2))  # noqa: E731, B023
            asks = ends.filter((coin(F.col("tail")) == 0) & (coin(F.col("to.cluster")) == 1)).groupBy("tail", "tn").agg(F.max("to").alias("to"))
        else:
            best = ends.groupBy("tail", "tn").agg(F.max("to").alias("to")).withColumn("top", F.struct(F.col("tn").alias("n"), F.col("tail").alias("cluster")) > F.col("to"))
            asks = best.filter("NOT top").join(best.filter("top").select(F.col("tail").alias("__h")), F.col("to.cluster") == F.col("__h"))
        number += 1
        asks = asks.select("tail", "tn", F.col("to.cluster").alias("head")).join(models.select(F.col("cluster").alias("head"), "room"), "head")
        asks = asks.withColumn("rank", F.row_number().over(Window.partitionBy("head").orderBy(F.desc("tn"), F.desc("tail")))).filter("rank <= room")
        asks = stored(asks.select("head", "tail", F.count(F.lit(1)).over(Window.partitionBy("head")).alias("k")), "merge-asks")
        if asks.isEmpty():
            continue
        into = asks.select(F.col("tail").alias("cluster"), "head").unionByName(asks.select(F.col("head").alias("cluster"), "head").distinct())
        common = stored(rows.join(into, "cluster").dropDuplicates(["head", "id"]).select(F.col("head").alias("cluster"), "id", *AXES), "merge-common")
        plane = stored(refitted(common, ["cluster"]).select("cluster", *_NORMAL, "offset"), "merge-fits")
        apart = common.join(plane, "cluster").withColumn("off", F.abs(dot([F.col(a) for a in AXES], [F.col(c) for c in _NORMAL]) + F.col("offset")))
        stars = stored(_verdicts(apart, tolerance, quantile).join(asks.select(F.col("head").alias("cluster"), "k").distinct(), "cluster"), "merge-verdicts")
        good = stars.filter("good").select("cluster")
        held = stored(apart.filter(F.col("off") <= tolerance).join(good, "cluster", "left_semi").select("cluster", "id", *AXES), "merge-held")
        moved = into.join(good.withColumnRenamed("cluster", "head"), "head", "left_semi")
        rows = stored(rows.join(moved.select("cluster"), "cluster", "left_anti").unionByName(held), "merge-rows")
        room = F.when(F.col("good"), F.least(F.col("room") * 2, F.lit(ALL))).when(F.col("good").isNotNull(), F.greatest(F.floor(F.col("k") / 2), F.lit(1))).otherwise(F.col("room"))
        models = models.join(moved.filter("cluster <> head").select("cluster"), "cluster", "left_anti").join(stars, "cluster", "left").withColumn("room", room)
        made = plane.join(good, "cluster", "left_semi").join(centres(held), "cluster").join(models.select("cluster", "room"), "cluster")
        models = stored(models.join(good, "cluster", "left_anti").select(*_MODEL).unionByName(made.select(*_MODEL)), "merge-models")
        now = lambda c: F.coalesce(F.col(f"{c}_head"), F.col(c))
        named = lambda c: moved.select(F.col("cluster").alias(c), F.col("head").alias(f"{c}_head"))
        of = stored(of.join(named("cluster"), "cluster", "left").select("plane", now("cluster").alias("cluster")), "merge-of")
        failed = asks.join(stars.filter("NOT good AND k = 1").select(F.col("cluster").alias("head")), "head", "left_semi")
        spent = judged.filter("NOT even").select("a", "b").unionByName(failed.select(F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b"))).withColumn("spent", F.lit(True))
        ties = ties.join(spent, ["a", "b"], "left").join(named("a"), "a", "left").join(named("b"), "b", "left")
        changed = F.col("a_head").isNotNull() | F.col("b_head").isNotNull()
        ties = ties.select(F.least(now("a"), now("b")).alias("a"), F.greatest(now("a"), now("b")).alias("b"), (~changed & (F.col("tried") | F.coalesce("spent", F.lit(False)))).alias("tried"))
        ties = stored(ties.filter("a <> b").groupBy("a", "b").agg(F.min("tried").alias("tried")), "merge-links")
    return models.select("cluster", *_NORMAL, "offset", "n"), rows, of
