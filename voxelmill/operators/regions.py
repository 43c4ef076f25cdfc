"""Planes and primitives of regions, found by draws that are rows.

A draw is three representatives of a region, chosen by a digest of region, round and number. All draws of all regions are scored
together, a block of representatives at a time, so that a crowded region is many blocks; the best of each region is refitted on all of
its rows. Rounds go on in lockstep until no region has a plane left. Nothing hangs on the order or the place of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import shared, stored
from . import graphs, shapes
from .attributes import dot, oriented
from .cells import AXES

#: Representatives of a block; bins of the first pass to a median.
BLOCK, BINS = 8192, 4096
_NORMAL = ["nx", "ny", "nz"]
_PAIRS = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]


def medians(rows: DataFrame, key: list[str], value: Column) -> DataFrame:
    """(key, median): exact, the mean of the two middle values of an even number. Values are counted in bins between a key's least and
    greatest, then the values of the bins with the middle ranks; no buffer holds a key's values."""
    own = rows.select(*key, value.alias("__v"))
    box = own.groupBy(*key).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("__v") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * BINS), F.lit(0)), F.lit(BINS - 1))
    each = own.join(box, key).withColumn("__b", at).groupBy(*key, "__n", "__b", "__v").agg(F.count(F.lit(1)).alias("__m"))
    bins = each.groupBy(*key, "__n", "__b").agg(F.sum("__m").alias("__m"))
    before = F.sum("__m").over(Window.partitionBy(*key).orderBy("__b")) - F.col("__m")
    low, high = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    bins = bins.withColumn("__before", before).filter((F.col("__before") <= high) & (F.col("__before") + F.col("__m") > low)).select(*key, "__b", "__before")
    ranked = each.join(bins, [*key, "__b"]).withColumn("__last", F.col("__before") + F.sum("__m").over(Window.partitionBy(*key, "__b").orderBy("__v")) - 1)
    first = F.col("__last") - F.col("__m") + 1
    hit = lambda rank: F.max(F.when((first <= rank) & (F.col("__last") >= rank), F.col("__v")))
    return ranked.groupBy(*key).agg(((hit(low) + hit(high)) / 2).alias("median"))


def refitted(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, nx, ny, nz, offset): the plane of each key's rows: the axis of least spread, its largest component positive, and the
    negative median of the rows along it."""
    spread = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in _PAIRS])
    fit = stored(oriented(shapes.spectra(spread), tuple(_NORMAL)).select(*key, "n", *_NORMAL), "region-fits")
    along = dot([F.col(a) for a in AXES], [F.col(n) for n in _NORMAL])
    return fit.join(medians(rows.join(fit, key), key, along), key).withColumn("offset", -F.col("median")).drop("median")


def _scored(own: pa.Table, draws: pa.Table, tolerance: float) -> pa.Table:
    """How many of a block's representatives lie on each drawn plane."""
    if not own.num_rows or not draws.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("tx", "ty", "draw", "hits")})
    p = np.stack([own.column(a).to_numpy() for a in AXES], 1)
    n = np.stack([draws.column(a).to_numpy() for a in _NORMAL])
    hits = (np.abs(p @ n + draws.column("offset").to_numpy()) <= tolerance).sum(0)
    return pa.table({"tx": draws.column("tx"), "ty": draws.column("ty"), "draw": draws.column("draw"), "hits": hits.astype(np.int64)})


def _drawn(reps: DataFrame, number: int, draws: int, seed: int) -> DataFrame:
    """(tx, ty, draw, nx, ny, nz, offset): planes through three representatives each, their rank in the region given; collinear ones
    are left out."""
    sizes = reps.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("m")).filter("m >= 3")
    corner = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("corner")
    asked = sizes.select("tx", "ty", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw")).select("*", corner)
    asked = asked.withColumn("rank", F.pmod(F.xxhash64("tx", "ty", "draw", "corner", F.lit(seed), F.lit(number)), F.col("m")))
    got = asked.join(reps.select("tx", "ty", "rank", *AXES), ["tx", "ty", "rank"])
    pick = [F.max(F.when(F.col("corner") == i, F.col(a))).alias(f"{a}{i}") for i in range(3) for a in AXES]
    got = got.groupBy("tx", "ty", "draw").agg(*pick)
    u, v = ([F.col(f"{a}{i}") - F.col(f"{a}0") for a in AXES] for i in (1, 2))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    got = got.withColumns({f"__{c}": x for c, x in zip(_NORMAL, n, strict=True)})
    length = F.sqrt(dot(w := [F.col(f"__{c}") for c in _NORMAL], w))
    got = got.withColumn("__l", length).filter("__l > 1e-12").withColumns({c: F.col(f"__{c}") / F.col("__l") for c in _NORMAL})
    return got.select("tx", "ty", "draw", *_NORMAL, (-dot([F.col(c) for c in _NORMAL], [F.col(f"{a}0") for a in AXES])).alias("offset"))


def region_planes(points: DataFrame, size: float, voxel: float = 0.1, tolerance: float = 0.04, support: int = 128, most: int = 12, draws: int = 250, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(tx, ty, plane, nx, ny, nz, offset, n) and (tx, ty, plane, id): planes of square regions of points (id, x, y, z), and the rows that
    each owns.

    A round draws planes through representatives, one row a voxel, that no plane has taken, and takes the one that most of them lie on;
    with fewer than `support` the region is done. All rows within the tolerance that no plane owns are fitted, twice, and owned if
    `support` are left; else the plane is passed over. Ties go to the earlier draw. Ids must be unique; a table without rows gives none.
    """
    spark = points.sparkSession
    shared(spark)
    own = points.select("id", *[F.col(a).cast("double").alias(a) for a in AXES]).withColumns({f"t{a}": F.floor(F.col(a) / size) for a in "xy"})
    free = stored(own, "region-rows")
    cell = [F.floor(F.col(a) / voxel).alias(f"v{a}") for a in AXES]
    reps = free.groupBy("tx", "ty", *cell).agg(F.min(F.struct("id", *AXES)).alias("m")).select("tx", "ty", "m.*")
    planes, members, number = [], [], 0
    offcut = F.abs(dot([F.col(a) for a in AXES], [F.col(c) for c in _NORMAL]) + F.col("offset"))
    while number < most:
        # Representatives are as many as a region has voxels, however many rows it has.
        reps = reps.withColumn("rank", F.row_number().over(Window.partitionBy("tx", "ty").orderBy(F.xxhash64("id", F.lit(seed)), "id")) - 1)
        reps = stored(reps, "region-representatives")
        live = reps.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= support)
        reps = reps.join(live.select("tx", "ty"), ["tx", "ty"], "left_semi")
        if live.isEmpty():
            break
        drawn = stored(_drawn(reps, number, draws, seed), "region-draws")
        block = F.floor(F.col("rank") / BLOCK)
        blocks = reps.select("tx", "ty", block.alias("block")).distinct()
        asked = drawn.join(blocks, ["tx", "ty"])
        scored = reps.withColumn("block", block).groupBy("tx", "ty", "block").cogroup(asked.groupBy("tx", "ty", "block"))
        scored = scored.applyInArrow(lambda a, b: _scored(a, b, tolerance), "tx long, ty long, draw long, hits long")
        best = scored.groupBy("tx", "ty", "draw").agg(F.sum("hits").alias("hits")).groupBy("tx", "ty").agg(F.max(F.struct("hits", (-F.col("draw")).alias("d"))).alias("b"))
        best = best.filter(F.col("b.hits") >= support).select("tx", "ty", (-F.col("b.d")).alias("draw"))
        won = stored(drawn.join(best, ["tx", "ty", "draw"]).drop("draw"), "region-best")
        if won.isEmpty():
            break
        # Representatives on the drawn plane are spent, whatever the fit says.
        reps = reps.join(won, ["tx", "ty"]).filter(offcut > tolerance).select("tx", "ty", "id", *AXES)
        held = stored(free.join(won, ["tx", "ty"]).filter(offcut <= tolerance).select("tx", "ty", "id", *AXES), "region-members")
        for _ in range(2):
            enough = held.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= support).select("tx", "ty")
            fit = refitted(held.join(enough, ["tx", "ty"], "left_semi"), ["tx", "ty"]).drop("n")
            fit = stored(fit, "region-plane")
            held = stored(held.join(fit, ["tx", "ty"]).filter(offcut <= tolerance).select("tx", "ty", "id", *AXES), "region-members")
        sizes = held.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
        made = stored(fit.join(sizes, ["tx", "ty"]).withColumn("plane", F.lit(number)), "region-plane")
        planes.append(made.select("tx", "ty", "plane", *_NORMAL, "offset", "n"))
        members.append(held.join(made.select("tx", "ty", "plane"), ["tx", "ty"]).select("tx", "ty", "plane", "id"))
        # Rows near the plane are owned or lie within the tolerance of it: both are gone.
        near = made.select("tx", "ty", *_NORMAL, "offset")
        free = stored(free.join(near, ["tx", "ty"], "left").filter(F.col("nx").isNull() | (offcut > tolerance)).select("tx", "ty", "id", *AXES), "region-rows")
        number += 1
    if not planes:
        empty = ", ".join(["tx long", "ty long", "plane int"])
        return spark.createDataFrame([], f"{empty}, nx double, ny double, nz double, offset double, n long"), spark.createDataFrame([], f"{empty}, id {points.schema['id'].dataType.simpleString()}")
    join = lambda parts: parts[0] if len(parts) == 1 else join([parts[0].unionByName(parts[1]), *parts[2:]])
    return join(planes), join(members)


def basis(n: list[Column]) -> tuple[list[Column], list[Column]]:
    """Two unit vectors at a right angle to the unit normal n and to each other, the first level unless n is upright."""
    flat = F.sqrt(n[0] * n[0] + n[1] * n[1])
    upright = flat < 0.1
    u = [F.when(upright, F.lit(1.0)).otherwise(-n[1] / flat), F.when(upright, F.lit(0.0)).otherwise(n[0] / flat), F.when(upright, -n[0] / n[2]).otherwise(F.lit(0.0))]
    size = F.sqrt(dot(u, u))
    u = [c / size for c in u]
    return u, [n[1] * u[2] - n[2] * u[1], n[2] * u[0] - n[0] * u[2], n[0] * u[1] - n[1] * u[0]]


def primitives(points: DataFrame, size: float = 10.0, cell: float = 0.1, link: float = 0.25, support: int = 128, area: float = 0.5, coverage: float = 0.45, coherence: float = 0.8, **bounds) -> tuple[DataFrame, DataFrame]:
    """(part, tx, ty, plane, nx, ny, nz, offset, n, area, coherence) and (part, id): pieces of the regions' planes that hold together.

    A plane's rows fall into cells of it; cells up to `link` apart are one piece. A piece needs `support` rows, an area of `area`, a share
    `coverage` of its bounding rectangle, and a share `coherence` of rows whose surroundings (16 nearest within 0.3 of the voxels'
    representatives) lie flat within 20 degrees of the piece's own plane. part is its least row.
    """
    voxel, tolerance = bounds.get("voxel", 0.1), bounds.get("tolerance", 0.04)
    planes, members = region_planes(points, size, support=support, **bounds)
    rows = members.join(points.select("id", *AXES), "id").join(planes.select("tx", "ty", "plane", *_NORMAL), ["tx", "ty", "plane"])
    u, v = basis([F.col(c) for c in _NORMAL])
    at = [F.col(a) for a in AXES]
    rows = rows.withColumns({"px": dot(at, u), "py": dot(at, v)}).withColumns({"ix": F.floor(F.col("px") / cell), "iy": F.floor(F.col("py") / cell)})
    rows = stored(rows, "primitive-rows")
    spot = ["tx", "ty", "plane", "ix", "iy"]
    # A cell stands where its first row lies; neighbours are found from cell to cell.
    firsts = rows.groupBy(*spot).agg(F.min(F.struct("id", "px", "py")).alias("m")).select(*spot, "m.px", "m.py").withColumn("node", F.struct(*spot))
    reach = int(np.ceil(link / cell))
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if (a, b) > (0, 0)])).alias("m")
    sent = firsts.select("*", moves).select("tx", "ty", "plane", (F.col("ix") + F.col("m.a")).alias("ix"), (F.col("iy") + F.col("m.b")).alias("iy"), F.col("px").alias("ox"), F.col("py").alias("oy"), F.col("node").alias("src"))
    links = firsts.join(sent, spot).filter((F.col("px") - F.col("ox")) ** 2 + (F.col("py") - F.col("oy")) ** 2 <= link * link).select("src", F.col("node").alias("dst"))
    of = graphs.labelled(firsts.select(*spot, "node"), "node", links).select(*spot, "component")
    pieces = stored(rows.join(of, spot), "primitive-pieces")
    extent = pieces.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("part"), F.countDistinct("ix", "iy").alias("cells"), *[(F.max(c) - F.min(c) + 1).alias(f"w{c}") for c in ("ix", "iy")])
    extent = extent.withColumn("area", F.col("cells") * cell * cell).filter((F.col("rows") >= support) & (F.col("area") >= area) & (F.col("cells") / (F.col("wix") * F.col("wiy")) >= coverage))
    kept = stored(pieces.join(extent.select("component", "part", "area"), "component").select("part", "area", "tx", "ty", "plane", "id", *AXES), "primitive-kept")
    fit = stored(refitted(kept, ["part"]).drop("n"), "primitive-fits")
    # Representatives of the voxels with the plane of their surroundings; a row takes that of its voxel's.
    reps = points.groupBy(*[F.floor(F.col(a) / voxel).alias(f"v{a}") for a in AXES]).agg(F.min(F.struct("id", *AXES)).alias("m")).select("vx", "vy", "vz", "m.*")
    near = shapes.offsets(reps.select("id", *AXES), 0.3, 15)
    flat = shapes.spectra(shapes.moments(near, own=True)).select(F.col("id").alias("__r"), F.col("n").alias("__n"), "l1", "l2", "l3", *[F.col(c).alias(f"s{c}") for c in _NORMAL])
    local = reps.select("vx", "vy", "vz", F.col("id").alias("__r")).join(flat, "__r")
    judged = kept.withColumns({f"v{a}": F.floor(F.col(a) / voxel) for a in AXES}).join(local, ["vx", "vy", "vz"], "left").join(fit, "part")
    even = (F.col("__n") >= 7) & (F.col("l2") > 1e-8) & (F.col("l3") <= 0.05 * (F.col("l1") + F.col("l2") + F.col("l3"))) & (F.abs(dot([F.col(f"s{c}") for c in _NORMAL], [F.col(c) for c in _NORMAL])) >= float(np.cos(np.deg2rad(20))))
    off = F.abs(dot(at, [F.col(c) for c in _NORMAL]) + F.col("offset"))
    judged = stored(judged.select("part", "area", "tx", "ty", "plane", "id", *_NORMAL, "offset", F.coalesce(even, F.lit(False)).alias("even"), (off <= tolerance).alias("on")), "primitive-judged")
    out = judged.groupBy("part", "tx", "ty", "plane", *_NORMAL, "offset", "area").agg(F.count_if("on").alias("n"), F.avg(F.col("even").cast("double")).alias("coherence")).filter((F.col("coherence") >= coherence) & (F.col("n") >= support))
    return out.select("part", "tx", "ty", "plane", *_NORMAL, "offset", "n", "area", "coherence"), judged.filter("on").join(out.select("part"), "part", "left_semi").select("part", "id")
