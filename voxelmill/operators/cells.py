"""Cells: grouping points by integer cells, and what is computed over cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Cells beyond this can't be told apart in double precision.
MOST = float(1 << 53)


def cell_of(value: Column, size: float, divide: bool = False) -> Column:
    """Index of the cell; not finite or too far is an error. divide: floor(v / size), else floor(v * (1 / size))."""
    scaled = value / F.lit(size) if divide else value * F.lit(1.0 / size)
    bad = F.isnan(scaled) | (F.abs(scaled) > MOST)
    return F.when(bad, F.raise_error(F.lit("a coordinate lies outside the cells"))).otherwise(F.floor(scaled))


def with_cells(points: DataFrame, size: float, divide: bool = False) -> DataFrame:
    return points.withColumns({f"i{a}": cell_of(F.col(a), size, divide) for a in AXES})


CELL = ["ix", "iy", "iz"]


def counts(points: DataFrame, size: float, divide: bool = False) -> DataFrame:
    """(ix, iy, iz, n) of the occupied cells."""
    return with_cells(points, size, divide).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))


def distribution(points: DataFrame, size: float) -> DataFrame:
    """(n, cells): how many cells hold n points."""
    return counts(points, size).groupBy("n").agg(F.count(F.lit(1)).alias("cells"))


def summary(points: DataFrame, size: float) -> DataFrame:
    """One row over cells, not over points; nulls if there is none."""
    n = F.col("n")
    return counts(points, size).agg(F.count(n).alias("cells"), F.sum(n).alias("points"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.median(n.cast("double")).alias("middle"))


def populations(points: DataFrame, size: float) -> DataFrame:
    """Every point with n, the points of its cell: an aggregate joined back, so that a crowded cell is no task of its own."""
    own = with_cells(points, size)
    return own.join(own.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")), CELL)


def keep_above(points: DataFrame, size: float, thresholds: tuple[int, ...]) -> DataFrame:
    """populations() with keep_t for every threshold t: kept above it, each on its own."""
    out = populations(points, size)
    return out.withColumns({f"keep_{t}": F.col("n") > t for t in thresholds})


def exposed_faces(cells: DataFrame) -> DataFrame:
    """(ix, iy, iz, axis, side): faces of occupied cells towards empty ones, by an anti-join on neighbours."""
    sides = [(i, s) for i in range(3) for s in (-1, 1)]
    moves = F.array(*[F.struct(F.lit(i).alias("axis"), F.lit(s).alias("side"), *[F.lit(s if j == i else 0).alias(f"d{a}") for j, a in enumerate(AXES)]) for i, s in sides])
    own = cells.select(*CELL, F.explode(moves).alias("m")).select(*CELL, "m.*")
    own = own.withColumns({f"n{a}": F.col(f"i{a}") + F.col(f"d{a}") for a in AXES})
    there = cells.select(*[F.col(f"i{a}").alias(f"n{a}") for a in AXES]).distinct()
    return own.join(there, ["nx", "ny", "nz"], "left_anti").select(*CELL, "axis", "side")


def dense_neighbours(cells: DataFrame, radius: float, least: int) -> DataFrame:
    """(ix, iy, iz, near, keep): occupied cells within radius (in cells, closed, itself included), and whether so many."""
    r = int(radius)
    offsets = [(a, b, c) for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1) if a * a + b * b + c * c <= radius * radius + 1e-10]
    moves = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for v, a in zip(o, AXES, strict=True)]) for o in offsets])
    own = cells.select(*CELL).distinct()
    sent = own.select(*CELL, F.explode(moves).alias("m")).select(*[(F.col(f"i{a}") + F.col(f"m.d{a}")).alias(f"i{a}") for a in AXES])
    near = sent.groupBy(*CELL).agg(F.count(F.lit(1)).alias("near"))
    return own.join(near, CELL).withColumn("keep", F.col("near") >= least)


def covered_boxes(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """boxes (box, lx, ux, ly, uy, lz, uz: closed cell ranges) with covered: whether every cell is occupied."""
    out = boxes
    for a in AXES:
        out = out.withColumn(f"i{a}", F.explode(F.sequence(f"l{a}", f"u{a}")))
    there = cells.select(*CELL).distinct().withColumn("there", F.lit(1))
    return out.join(there, CELL, "left").groupBy("box").agg((F.count("there") == F.count(F.lit(1))).alias("covered"))


def tiles(points: DataFrame, size: float) -> DataFrame:
    """points with tx, ty: half-open tiles by division in double precision of single-precision coordinates."""
    return points.withColumns({f"t{a}": F.floor(F.col(a).cast("float").cast("double") / size) for a in "xy"})


def tile_name(tx: Column, ty: Column) -> Column:
    part = lambda t: F.replace((t + 10000).cast("string"), F.lit("-"), F.lit("m"))
    return F.concat(F.lit("t_"), part(tx), F.lit("_"), part(ty))


def halo(points: DataFrame, size: float, margin: float) -> DataFrame:
    """Every point once for each tile that it lies in or within margin of (half-open): (tx, ty, own)."""
    at = tiles(points, size).withColumnsRenamed({"tx": "hx", "ty": "hy"})
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    out = at.withColumn("dx", near).withColumn("dy", near).withColumns({"tx": F.col("hx") + F.col("dx"), "ty": F.col("hy") + F.col("dy")})
    inside = [(F.col(a) >= F.col(f"t{a}") * size - margin) & (F.col(a) < (F.col(f"t{a}") + 1) * size + margin) for a in "xy"]
    return out.filter(inside[0] & inside[1]).withColumn("own", (F.col("dx") == 0) & (F.col("dy") == 0)).drop("hx", "hy", "dx", "dy")


def pick_in_cell(points: DataFrame, size: float, order: list[str], middle: bool) -> DataFrame:
    """One actual row of each cell: the first in order, by a partial aggregate, or the upper median one, by a window over the cell."""
    own = with_cells(points, size)
    if not middle:
        rest = [c for c in points.columns if c not in order]
        return own.groupBy(*CELL).agg(F.min(F.struct(*order, *rest)).alias("__m")).select(*[F.col(f"__m.{c}").alias(c) for c in points.columns], *CELL)
    w = Window.partitionBy(*CELL)
    place, wanted = F.row_number().over(w.orderBy(*order)), F.floor(F.count(F.lit(1)).over(w) / 2) + 1
    return own.withColumn("__k", place).withColumn("__w", wanted).filter("__k = __w").drop("__k", "__w")
