"""Masks of cells in the plane: exact distances, discs, holes, repair of masks and of heights.

Cells are rows (key, ix, iy); every key is a plane of its own. A mask is kept as runs of cells wherever that will do, so
what is moved grows with its outline. Distances are separable: along x from the ends of runs, then along y by the lower envelope of
parabolas over each column. A line or a column is one task's, as long as the plane is wide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graphs

_PLACE = ["ix", "iy"]


def runs(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, iy, low, high): stretches of occupied cells along x, none next to another."""
    one = cells.select(*key, *_PLACE).distinct()
    at = F.col("ix") - F.row_number().over(Window.partitionBy(*key, "iy").orderBy("ix"))
    return one.withColumn("__run", at).groupBy(*key, "iy", "__run").agg(F.min("ix").alias("low"), F.max("ix").alias("high")).drop("__run")


def spread(stretches: DataFrame, key: list[str]) -> DataFrame:
    """The cells of stretches (key, iy, low, high), which may overlap, each once."""
    w = Window.partitionBy(*key, "iy").orderBy("low", "high")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = stretches.withColumn("__from", F.greatest(F.col("low"), F.coalesce(before + 1, F.col("low")))).filter("__from <= high")
    return fresh.select(*key, F.explode(F.sequence("__from", "high")).alias("ix"), "iy")


def _envelope(places: list[int], heights: list[int], asked: list[int]) -> list[int]:
    """The least of height + (place - a)² for each asked a, ascending like the places."""
    kept: list[tuple[int, int]] = []
    ends: list[int] = []  # the last place at which a parabola is no higher than the next one
    for q, h in zip(places, heights, strict=True):
        while kept:
            p, k = kept[-1]
            end = (h + q * q - k - p * p) // (2 * (q - p))
            if not ends or end > ends[-1]:
                ends.append(end)
                break
            kept.pop()
            ends.pop()
        kept.append((q, h))
    out, at = [], 0
    for a in asked:
        while at < len(ends) and ends[at] < a:
            at += 1
        p, k = kept[at]
        out.append(k + (a - p) ** 2)
    return out


def _column(table: pa.Table, box: tuple | None) -> pa.Table:
    """Squared distances of one column's cells, from those along x."""
    table = table.sort_by("iy")
    at, flat = table.column("iy").to_pylist(), table.column("flat").to_pylist()
    out: list[int | None] = []
    start = 0
    for i in range(1, len(at) + 1):
        if i < len(at) and at[i] == at[i - 1] + 1:
            continue
        own = at[start:i]
        sites = [(own[0] - 1, 0)] if box is None or own[0] > box[2] else []
        sites += [(p, f * f) for p, f in zip(own, flat[start:i], strict=True) if f is not None]
        if box is None or own[-1] < box[3]:
            sites.append((own[-1] + 1, 0))
        out += _envelope([p for p, _ in sites], [h for _, h in sites], own) if sites else [None] * len(own)
        start = i
    return table.drop_columns(["flat"]).append_column("d2", pa.array(out, pa.int64()))


def distances(cells: DataFrame, key: list[str] | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(key, ix, iy, d2): squared distance, in cells, of each occupied cell to the nearest one that isn't; exact.

    box: least and greatest ix, least and greatest iy; only cells within it count as not occupied, and all that are occupied must
    lie in it. Without a box the plane has no end. d2 is null where the whole box is occupied.
    """
    key = key or []
    one = cells.select(*key, *[F.col(c).cast("long").alias(c) for c in _PLACE]).distinct()
    at = F.col("ix") - F.row_number().over(Window.partitionBy(*key, "iy").orderBy("ix"))
    w = Window.partitionBy(*key, "iy", "__run")
    left, right = F.col("ix") - F.min("ix").over(w) + 1, F.max("ix").over(w) - F.col("ix") + 1
    if box is not None:  # beyond the box there is nothing
        left, right = F.when(F.min("ix").over(w) > box[0], left), F.when(F.max("ix").over(w) < box[1], right)
    flat = one.withColumn("__run", at).withColumn("flat", F.least(left, right)).drop("__run")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in one.schema)
    return flat.groupBy(*key, "ix").applyInArrow(lambda t: _column(t, box), f"{schema}, d2 long")


def dilated_disc(cells: DataFrame, radius2: float, key: list[str] | None = None) -> DataFrame:
    """(key, ix, iy): cells whose squared distance to an occupied one is at most radius2; runs move, not cells."""
    key, reach = key or [], int(math.isqrt(int(radius2)))
    steps = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(math.isqrt(int(radius2 - d * d))).alias("w")) for d in range(-reach, reach + 1)])).alias("m")
    moved = runs(cells, key).select(*key, "iy", "low", "high", steps)
    return spread(moved.select(*key, (F.col("iy") + F.col("m.d")).alias("iy"), (F.col("low") - F.col("m.w")).alias("low"), (F.col("high") + F.col("m.w")).alias("high")), key)


def closed_disc(cells: DataFrame, radius2: float, key: list[str] | None = None) -> DataFrame:
    """(key, ix, iy): the occupied cells and those that no disc of this squared radius reaches without covering one."""
    key = key or []
    inner = distances(dilated_disc(cells, radius2, key), key).filter(F.col("d2") > radius2)
    return inner.select(*key, *_PLACE).unionByName(cells.select(*key, *[F.col(c).cast("long").alias(c) for c in _PLACE])).distinct()


def holes(cells: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, iy, low, high, hole, area): the stretches of empty cells that occupied ones enclose; those of one hole touch along edges.
    hole is the least (iy, low) of it, area its number of cells. Gaps between runs are the nodes of the graph, not cells."""
    key = key or []
    own = runs(cells, key)
    w = Window.partitionBy(*key, "iy").orderBy("low")
    after = F.lead("low").over(w)
    gaps = own.select(*key, "iy", (F.col("high") + 1).alias("low"), (after - 1).alias("high"))
    gaps = gaps.filter("high is not null").withColumn("node", F.struct("iy", "low"))
    if key:
        gaps = gaps.withColumn("node", F.struct(*key, "iy", "low"))
    # A gap is open where a cell above or below it lies outside that line's first and last run.
    ends = own.groupBy(*key, "iy").agg(F.min("low").alias("__low"), F.max("high").alias("__high"))
    near = gaps.withColumn("__d", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("__y", F.col("iy") + F.col("__d"))
    over = near.join(ends.withColumnRenamed("iy", "__y"), [*key, "__y"], "left")
    open_ = over.filter("__low is null or low < __low or high > __high").select("node").distinct()
    below = gaps.select(*key, (F.col("iy") - 1).alias("iy"), F.col("low").alias("olow"), F.col("high").alias("ohigh"), F.col("node").alias("dst"))
    links = _touching(gaps, below, key)
    found = graphs.labelled(gaps, "node", links.select(F.col("node").alias("src"), "dst"))
    outside = found.join(open_, "node", "left_semi").select("component").distinct()
    inside = found.join(outside, "component", "left_anti")
    area = inside.groupBy("component").agg(F.sum(F.col("high") - F.col("low") + 1).alias("area"))
    return inside.join(area, "component").select(*key, "iy", "low", "high", F.struct("component.iy", "component.low").alias("hole"), "area")


def _touching(gaps: DataFrame, below: DataFrame, key: list[str], slot: int = 64) -> DataFrame:
    """Pairs of gaps of neighbouring lines that share an ix; they meet in slots of so many cells, once in the one where they begin to."""
    slots = lambda df, a, b: df.withColumn("__s", F.explode(F.sequence(F.floor(F.col(a) / slot), F.floor(F.col(b) / slot))))
    both = slots(gaps, "low", "high").join(slots(below, "olow", "ohigh"), [*key, "iy", "__s"])
    first = F.greatest("low", "olow")
    return both.filter((first <= F.least("high", "ohigh")) & (F.floor(first / slot) == F.col("__s")))


def segment_cells(segments: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, ix, iy): cells along segments (key, ax, ay, bx, by: cells), one for each step on the longer axis, halves to even."""
    key = key or []
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    steps = F.greatest(F.abs(dx), F.abs(dy))
    at = segments.withColumn("__n", steps).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n").cast("long"))))
    share = F.when(F.col("__n") > 0, F.col("__k") / F.col("__n")).otherwise(F.lit(0.0))
    return at.select(*key, F.rint(F.col("ax") + share * dx).cast("long").alias("ix"), F.rint(F.col("ay") + share * dy).cast("long").alias("iy")).distinct()


def protected_cells(recesses: DataFrame, key: list[str] | None = None, least: int = 3) -> DataFrame:
    """(key, ix, iy): cells of `least` rows or more (key, ix, iy) that lie behind the plane, and the four around each."""
    key = key or []
    return dilated_disc(recesses.groupBy(*key, *_PLACE).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least), 1, key)


def repaired(observed: DataFrame, bridges: DataFrame, protected: DataFrame, reach: float, most: float, key: list[str] | None = None) -> DataFrame:
    """(key, ix, iy, observed, enclosed, bridged): the observed cells, gaps that a disc closes, and holes of at most `most` cells.

    bridges are cells of segments between joined planes; they close gaps like observed ones. reach: radius of the disc in cells, rounded up;
    what is farther than reach + 1 from all observed and bridging cells is left out, but for holes. Protected cells that aren't
    observed stay open. enclosed: in a filled hole; bridged: closed only because of a bridge.
    """
    key, radius2 = key or [], math.ceil(reach) ** 2
    place = [*key, *_PLACE]
    flat = lambda df: df.select(*key, *[F.col(c).cast("long").alias(c) for c in _PLACE]).distinct()
    own = flat(observed).withColumn("observed", F.lit(True))
    seeds = flat(observed.select(*place).unionByName(bridges.select(*place)))
    whole = closed_disc(seeds, radius2, key).withColumn("__closed", F.lit(True)).checkpoint()
    local = closed_disc(observed, radius2, key).withColumn("__local", F.lit(True))
    small = holes(whole, key).filter(F.col("area") <= most)
    filled = small.select(*key, F.explode(F.sequence("low", "high")).alias("ix"), "iy").withColumn("enclosed", F.lit(True))
    near = dilated_disc(seeds, (reach + 1) ** 2, key).withColumn("__near", F.lit(True))
    out = whole.join(filled, place, "full").join(own, place, "left").join(local, place, "left").join(near, place, "left")
    out = out.join(flat(protected).withColumn("__kept", F.lit(True)), place, "left").fillna(False, ["observed", "enclosed", "__closed", "__local", "__near", "__kept"])
    out = out.filter("(not __kept or observed) and (enclosed or __near)")
    return out.select(*place, "observed", "enclosed", (F.col("__closed") & ~F.col("__local") & ~F.col("observed")).alias("bridged"))


def _convolved(raster: DataFrame, line: str, along: str, names: list[str], sigma: float, low: int, high: int) -> DataFrame:
    reach = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by(along)
        if table.num_rows != high - low + 1:
            raise ValueError("the raster has gaps or repeated cells")
        for n in names:
            v = np.pad(table.column(n).to_numpy(), reach, mode="edge")
            table = table.set_column(table.schema.get_field_index(n), n, pa.array(np.convolve(v, k, mode="valid")))
        return table

    return raster.groupBy(line).applyInArrow(one, raster.schema)


def smoothed(raster: DataFrame, names: list[str], sigma: float, box: tuple[int, int, int, int]) -> DataFrame:
    """The raster (ix, iy, names), which fills the box, with Gaussian means of the columns; borders go on as they end."""
    rows = raster.select(*_PLACE, *[F.col(n).cast("double").alias(n) for n in names])
    return _convolved(_convolved(rows, "iy", "ix", names, sigma, box[0], box[1]), "ix", "iy", names, sigma, box[2], box[3])


def repaired_heights(raster: DataFrame, step: float = 0.08, inside: float = 3.0, sigma: float = 15.0, far: float = 45.0, blend: float = 30.0) -> DataFrame:
    """(ix, iy, height, repaired) of a whole rectangle of cells (ix, iy, height, paved): paved heights drawn to their Gaussian mean over
    paved cells near abrupt steps, which lie between neighbours that are both at least `inside` from what isn't paved.

    The share falls from 1 at far - blend from the nearest abrupt cell to 0 at far, and towards the border of what is paved. Cells
    that aren't paved and gentle slopes stay. An empty raster stays empty.
    """
    rows = raster.select(*[F.col(c).cast("long").alias(c) for c in _PLACE], F.col("height").cast("double").alias("height"), F.coalesce("paved", F.lit(False)).alias("paved")).checkpoint()
    got = rows.agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).first()
    if got[0] is None:
        return rows.select(*_PLACE, "height", F.col("height").alias("repaired"))
    box = tuple(got)
    off = distances(rows.filter("paved"), box=box).withColumn("edge", F.coalesce(F.sqrt("d2"), F.lit(math.inf))).drop("d2").checkpoint()
    deep = rows.join(off.filter(F.col("edge") >= inside), _PLACE).select(*_PLACE, "height")
    steep = None
    for axis in _PLACE:
        other = deep.select(*[(F.col(a) - (1 if a == axis else 0)).alias(a) for a in _PLACE], F.col("height").alias("__next"))
        pairs = deep.join(other, _PLACE).filter(F.abs(F.col("__next") - F.col("height")) > step).select(*_PLACE)
        both = pairs.unionByName(pairs.withColumn(axis, F.col(axis) + 1))
        steep = both if steep is None else steep.unionByName(both)
    steep = steep.distinct().checkpoint()
    if steep.isEmpty():
        return rows.select(*_PLACE, "height", F.col("height").alias("repaired"))
    away = distances(rows.join(steep, _PLACE, "left_anti"), box=box).select(*_PLACE, F.sqrt("d2").alias("away"))
    mean = smoothed(rows.select(*_PLACE, F.col("paved").cast("double").alias("__w"), F.when(F.col("paved"), F.col("height")).otherwise(0.0).alias("__v")), ["__w", "__v"], sigma, box)
    all_ = rows.join(off, _PLACE, "left").join(away, _PLACE, "left").join(mean, _PLACE)
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    share = clip((far - F.coalesce("away", F.lit(0.0))) / blend) * clip(F.coalesce("edge", F.lit(0.0)) / inside)
    target = F.col("__v") / F.greatest("__w", F.lit(1e-6))
    return all_.select(*_PLACE, "height", F.when(F.col("paved") & (share > 0), F.col("height") + (target - F.col("height")) * share).otherwise(F.col("height")).alias("repaired"))
