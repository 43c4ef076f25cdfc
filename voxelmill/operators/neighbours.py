"""Exact neighbours of points: within a radius, the k nearest, and what builds on them.

Points meet through cells as wide as the radius, so a join on the cells around is exact. The k nearest are found in cells of a
size that fits the place; no pair beyond them is made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import shared, stored
from . import crowds, graphs
from .cells import AXES, CELL, with_cells


def _distance2(a: str = "", b: str = "o"):
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in AXES]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(a, b, d2) with a < b: pairs of (id, x, y, z) at most radius apart, the boundary included. One side goes to its own cell and 13
    of the 26 around it, so that two cells meet once."""
    own = with_cells(points.select("id", *AXES), radius)
    half = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]
    moves = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for v, a in zip(o, AXES, strict=True)]) for o in half])
    sent = own.select(F.col("id").alias("oid"), *[F.col(a).alias(f"o{a}") for a in AXES], *CELL, F.explode(moves).alias("m"))
    same = (F.col("m.dx") == 0) & (F.col("m.dy") == 0) & (F.col("m.dz") == 0)
    sent = sent.select("oid", *[f"o{a}" for a in AXES], same.alias("same"), *[(F.col(f"i{a}") + F.col(f"m.d{a}")).alias(f"i{a}") for a in AXES])
    near = own.join(sent, CELL).filter("not same OR id < oid").withColumn("d2", _distance2())
    return near.filter(F.col("d2") <= radius * radius).select(F.least("id", "oid").alias("a"), F.greatest("id", "oid").alias("b"), "d2")


def radius_counts(points: DataFrame, radius: float) -> DataFrame:
    """(id, near): other points at most radius away."""
    both = radius_pairs(points, radius).select(F.explode(F.array("a", "b")).alias("id"))
    return points.select("id").join(both.groupBy("id").agg(F.count(F.lit(1)).alias("near")), "id", "left").fillna(0, ["near"])


def _checked(points: DataFrame) -> DataFrame:
    """(id, x, y, z) in double precision; a coordinate that is null or not finite is refused."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    return points.select("id", *[F.when(ok(c), c + 0.0).otherwise(F.raise_error(F.lit("a coordinate is missing or not finite"))).alias(a) for a in AXES for c in (F.col(a).cast("double"),)])


#: Places whose neighbours one task looks for, where they are spread evenly.
SEARCHED = 1000

#: Points that one task can compare with all: below this the search is one job, 32 bytes a point go to each task.
FEW = 6000


def _compared(points: DataFrame, k: int) -> DataFrame:
    """nearest() of FEW points at most: each task orders the distances of some of them to all."""
    spark = points.sparkSession
    kind = points.schema["id"].dataType.simpleString()
    table = points.orderBy("id").toArrow()  # FEW rows at most, in order of their ids
    at = np.stack([table.column(a).to_numpy() for a in AXES], 1) if table.num_rows else np.zeros((0, 3))
    ids = table.column("id").combine_chunks()
    same = ids.dictionary_encode().indices.to_numpy() if table.num_rows else np.zeros(0, int)

    def search(batches):
        for batch in batches:
            for own in np.array_split(batch.column("id").to_numpy(), max(1, batch.num_rows // 64)):
                d = at[own][:, None] - at[None]
                dist = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])
                dist[same[own][:, None] == same[None]] = np.inf
                order = np.argsort(dist, axis=1, kind="stable")[:, :k]  # ids rise, so ties are in order
                best = np.take_along_axis(dist, order, axis=1)
                row, rank = np.nonzero(best < np.inf)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[row])), ids.take(pa.array(order[row, rank])), pa.array(rank.astype(np.int32) + 1), pa.array(best[row, rank])], names=["id", "nid", "rank", "dist"])

    return spark.range(0, table.num_rows, 1, max(1, min(spark.sparkContext.defaultParallelism, table.num_rows // 64))).mapInArrow(search, f"id {kind}, nid {kind}, rank int, dist double")


def _at_level(rows: DataFrame, low: dict[str, float], wide: float) -> DataFrame:
    """rows with the cell of their level: the side is the cloud's, halved level times."""
    return rows.withColumns({f"i{a}": F.floor((F.col(a) - low[a]) / (F.lit(wide) / F.pow(F.lit(2.0), F.col("level")))) for a in AXES})


def _around(rows: DataFrame) -> DataFrame:
    for a in AXES:
        rows = rows.withColumn("__d", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"i{a}", F.col(f"i{a}") + F.col("__d")).drop("__d")
    return rows


def _fitting(rows: DataFrame, few: int, low: dict[str, float], wide: float, deepest: int) -> DataFrame:
    """(ix, iy, iz, level): for each cell of the deepest level the finest one at which the cell around it holds a few points. Points are
    counted once, at the deepest level; the others follow from those counts."""
    deep = stored(_at_level(rows.withColumn("level", F.lit(deepest)), low, wide).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")), "cells-deep")
    each = deep.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
    each = each.withColumns({f"j{a}": F.floor(F.col(f"i{a}") / F.pow(F.lit(2.0), deepest - F.col("level"))) for a in AXES})
    full = each.groupBy("level", "jx", "jy", "jz").agg(F.sum("n").alias("all")).filter(F.col("all") >= few).drop("all")
    fits = each.join(full, ["level", "jx", "jy", "jz"]).groupBy(*CELL).agg(F.max("level").alias("level"))
    return deep.select(*CELL).join(fits, CELL, "left").fillna(0, ["level"])


def nearest(points: DataFrame, k: int, few_points: int = FEW) -> DataFrame:
    """(id, nid, rank, dist): the k nearest other rows of each (id, x, y, z), ties by id; all there are if fewer.

    Points at one place are searched for once, and a place offers its k + 1 lowest ids only. Each place looks in the 27 cells
    around it, of the finest of the halved grids in which its own cell holds a few points, so a far outlier makes its own
    search coarse and no other. Points go to those cells only in which somebody looks. What the k-th distance may reach beyond goes
    on with cells as wide as that distance; few rounds, each a stored table. A pair beyond the cells is never made. Few points are
    compared with all by numpy, in one job; results are the same.
    """
    spark = points.sparkSession
    shared(spark)
    checked = _checked(points)
    if points.limit(few_points + 1).count() <= few_points:
        return _compared(checked, k)
    w = Window.partitionBy(*AXES).orderBy("id")
    rows = stored(checked.withColumns({"place": F.first("id").over(w), "turn": F.row_number().over(w)}), "places")
    box = rows.agg(F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"l{a}") for a in AXES], *[F.max(a).alias(f"u{a}") for a in AXES]).first()
    low = {a: box[f"l{a}"] or 0.0 for a in AXES}
    wide = max([(box[f"u{a}"] or 0.0) - low[a] for a in AXES]) * (1 + 1e-9) or 1.0
    deepest = min(30, max(1, math.ceil(math.log2(max(2, box.n / k)) / 3) + 4))
    offered = rows.filter(F.col("turn") <= k + 1)
    fits = _fitting(offered, max(2, k // 4), low, wide, deepest)
    asked = _at_level(rows.filter("turn = 1").withColumn("level", F.lit(deepest)), low, wide).drop("level").join(fits, CELL).select("place", *AXES, "level")
    # Shuffled bytes don't tell the pairs that a task makes of them, so the number of partitions follows the places.
    parts = max(1, min(8192, box.n // SEARCHED))
    done = None
    while True:
        there = stored(_around(_at_level(asked, low, wide)), "asked")
        cells = there.select("level", *CELL).distinct()
        levels = [r.level for r in there.select("level").distinct().collect()]  # 31 at most
        others = _at_level(offered.select(F.col("id").alias("nid"), *AXES, F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")).alias("level")), low, wide)
        others = others.join(cells, ["level", *CELL], "left_semi").withColumnsRenamed({a: f"o{a}" for a in AXES})
        near = there.repartition(parts, "level", *CELL).join(others.repartition(parts, "level", *CELL), ["level", *CELL]).withColumn("dist", F.sqrt(_distance2()))
        first = Window.partitionBy("place", "level", *CELL).orderBy("dist", "nid")  # of each cell, before they are sent
        near = near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k + 1).select("place", "level", "nid", "dist").repartition(parts, "place")
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy("dist", "nid"))).filter(F.col("rank") <= k + 1)
        last = near.groupBy("place").agg(F.max("rank").alias("found"), F.max("dist").alias("reach"), F.first("level").alias("level"))
        sure = (F.col("level") == 0) | ((F.col("found") == k + 1) & (F.col("reach") <= F.lit(wide) / F.pow(F.lit(2.0), F.col("level"))))
        near = stored(near.select("place", "nid", "dist").join(last.withColumn("sure", sure), "place"), "near")
        part = near.filter("sure").select("place", "nid", "dist")
        done = part if done is None else done.unionByName(part)
        left = near.filter("not sure").groupBy("place").agg(F.first("level").alias("level"), F.first("found").alias("found"), F.first("reach").alias("reach"))
        if left.isEmpty():
            break
        # With k neighbours known none is farther than the last of them; with fewer the cells are made four times as wide.
        wider = F.floor(F.log2(F.lit(wide) / F.greatest("reach", F.lit(1e-300)))).cast("int")
        coarser = F.when(F.col("found") == k + 1, F.least(wider, F.col("level") - 1)).otherwise(F.col("level") - 2)
        asked = rows.filter("turn = 1").select("place", *AXES).join(left.select("place", F.greatest(coarser, F.lit(0)).alias("level")), "place")
    out = rows.select("id", "place").repartition(parts, "place").join(done.repartition(parts, "place"), "place").filter("id <> nid").repartition(parts, "id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "nid"))).filter(F.col("rank") <= k)
    return out.select("id", "nid", "rank", "dist")


def mean_distances(points: DataFrame, k: int) -> DataFrame:
    """(id, mean_dist) to the k nearest others, a stored table; k rows or fewer are refused."""
    if points.count() <= k:
        raise ValueError(f"{k} neighbours need more than {k} points")
    return stored(nearest(points, k).groupBy("id").agg(F.avg("dist").alias("mean_dist")), "mean-distances")


def statistical_outliers(distances: DataFrame, ratio: float) -> DataFrame:
    """(id, mean_dist) with keep: at most the mean plus ratio sample deviations of all mean distances. Stored distances can be judged
    again with another ratio."""
    limit = distances.agg((F.avg("mean_dist") + F.coalesce(F.stddev_samp("mean_dist"), F.lit(0.0)) * ratio).alias("limit"))
    return distances.join(F.broadcast(limit)).withColumn("keep", F.col("mean_dist") <= F.col("limit")).drop("limit")  # one row


def outlier_factors(points: DataFrame, ks: tuple[int, ...], rows: DataFrame | None = None) -> DataFrame:
    """(id, k, lof): local outlier factors for each k from one search of the largest, which is stored; of the rows (id) only, if they
    are given, among all points."""
    if points.count() <= max(ks):
        raise ValueError(f"{max(ks)} neighbours need more than {max(ks)} points")
    near = stored(nearest(points, max(ks)), "neighbours")
    near = near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("rank <= k")
    kdist = near.filter("rank = k").select(F.col("id").alias("nid"), "k", F.col("dist").alias("kdist"))
    reach = near.join(kdist, ["nid", "k"]).withColumn("reach", F.greatest("dist", "kdist"))
    density = stored(reach.groupBy("id", "k").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd")), "densities")
    other = density.select(F.col("id").alias("nid"), "k", F.col("lrd").alias("olrd"))
    wanted = near if rows is None else near.join(rows.select("id").distinct(), "id", "left_semi")
    mean = wanted.join(other, ["nid", "k"]).groupBy("id", "k").agg(F.avg("olrd").alias("m"))
    return mean.join(density, ["id", "k"]).select("id", "k", (F.col("m") / F.col("lrd")).alias("lof"))


def components(points: DataFrame, radius: float) -> DataFrame:
    """(id, label): smallest id that links of at most radius reach. The links are as many as points and neighbouring cells, not as pairs."""
    return graphs.labelled(points.select("id"), "id", crowds.links(points, radius)).withColumnRenamed("component", "label")


def nested_components(points: DataFrame, radii: tuple[float, ...]) -> DataFrame:
    """(id, radius, label) for rising radii; a component lies in one of the next radius."""
    out = None
    for r in radii:
        part = components(points, r).select("id", F.lit(r).alias("radius"), "label")
        out = part if out is None else out.unionByName(part)
    return out
