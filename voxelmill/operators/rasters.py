"""Cells in the plane as masks and counts: morphology, covered faces, angle and offset bins, widths of sections, best shifts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _steps(reach: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])).alias("m")


def dilated(cells: DataFrame, reach: int) -> DataFrame:
    """(ix, iy) of the cells at most reach steps away on either axis from an occupied one."""
    sent = cells.select("ix", "iy", _steps(reach))
    return sent.select((F.col("ix") + F.col("m.dx")).alias("ix"), (F.col("iy") + F.col("m.dy")).alias("iy")).distinct()


def eroded(cells: DataFrame, reach: int) -> DataFrame:
    """(ix, iy) of the occupied cells all of whose neighbours up to reach are occupied."""
    one = cells.select("ix", "iy").distinct()
    sent = one.select((F.col("ix")).alias("sx"), F.col("iy").alias("sy"), _steps(reach))
    near = sent.select((F.col("sx") + F.col("m.dx")).alias("ix"), (F.col("sy") + F.col("m.dy")).alias("iy")).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    return one.join(near.filter(F.col("n") == (2 * reach + 1) ** 2), ["ix", "iy"]).select("ix", "iy")


def closed(cells: DataFrame, reach: int, protected: DataFrame | None = None) -> DataFrame:
    """Cells after filling gaps up to 2 reach wide; protected ones (ix, iy) that weren't occupied stay empty."""
    out = eroded(dilated(cells, reach), reach).unionByName(cells.select("ix", "iy")).distinct()
    return out if protected is None else out.join(protected.join(cells, ["ix", "iy"], "left_anti"), ["ix", "iy"], "left_anti")


def covered_faces(faces: DataFrame, vertices: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """(face, touched, covered): whether any and whether all corners of a face lie in occupied cells."""
    at = vertices.select("id", F.floor(F.col("x") / size).alias("ix"), F.floor(F.col("y") / size).alias("iy"))
    inside = at.join(cells.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi").select("id").withColumn("__in", F.lit(True))
    each = faces.select("face", F.explode(F.array("a", "b", "c")).alias("id")).join(inside, "id", "left")
    flag = F.coalesce("__in", F.lit(False))
    return each.groupBy("face").agg(F.bool_or(flag).alias("touched"), F.bool_and(flag).alias("covered"))


def hough(points: DataFrame, angles: int, width: float) -> DataFrame:
    """(angle, bin, n): how many points lie in each band of the given width along each of so many directions in the plane."""
    k = F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("angle")
    turn = F.col("angle") * (math.pi / angles)
    along = F.col("x") * F.cos(turn) + F.col("y") * F.sin(turn)
    return points.select("x", "y", k).groupBy("angle", F.floor(along / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def section_widths(rows: DataFrame, along: str, across: str, step: float, low: float, high: float) -> DataFrame:
    """(station, n, left, right): the quantiles of `across` in each stretch of `along`."""
    q = F.percentile(across, [low, high])
    out = rows.groupBy(F.floor(F.col(along) / step).alias("station")).agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    return out.select("station", "n", F.col("q")[0].alias("left"), F.col("q")[1].alias("right"))


def shifts(cells: DataFrame, others: DataFrame, reach: int) -> DataFrame:
    """(dx, dy, n): how many cells of the first fall on occupied ones of the second when moved by up to reach steps, none left out."""
    sent = cells.select("ix", "iy", _steps(reach)).select("m.dx", "m.dy", (F.col("ix") + F.col("m.dx")).alias("ix"), (F.col("iy") + F.col("m.dy")).alias("iy"))
    return sent.join(others.select("ix", "iy").distinct(), ["ix", "iy"]).groupBy("dx", "dy").agg(F.count(F.lit(1)).alias("n"))


def creases(pairs: DataFrame) -> DataFrame:
    """pairs with ux, uy, uz and px, py, pz: direction and the point nearest to the origin of the line in which two planes meet (first
    nx, ny, nz, offset, second the same with o_ in front: n · p + offset = 0); null for parallel ones."""
    from .attributes import cross, dot

    n, m = [F.col(f"n{a}") for a in "xyz"], [F.col(f"o_n{a}") for a in "xyz"]
    u = cross(n, m)
    square = dot(u, u)
    # p = ((o_offset n - offset o_n) x u) / |u|²
    v = cross([F.col("o_offset") * a - F.col("offset") * b for a, b in zip(n, m, strict=True)], u)
    real = square > 1e-18
    return pairs.withColumns({**{f"u{a}": F.when(real, c / F.sqrt(square)) for a, c in zip("xyz", u, strict=True)}, **{f"p{a}": F.when(real, c / square) for a, c in zip("xyz", v, strict=True)}})


def plane_audit(points: DataFrame, labels: DataFrame, planes: DataFrame, tolerance: float) -> DataFrame:
    """(plane, n, off, worst, flat): support rows of each plane (labels: id, plane), how many lie farther from it than tolerance, and the
    farthest; flat: none does."""
    from .attributes import dot

    away = F.abs(dot([F.col(a) for a in "xyz"], [F.col(f"n{a}") for a in "xyz"]) + F.col("offset"))
    at = points.join(labels, "id").join(planes.select("plane", "nx", "ny", "nz", "offset"), "plane")
    out = at.groupBy("plane").agg(F.count(F.lit(1)).alias("n"), F.count_if(away > tolerance).alias("off"), F.max(away).alias("worst"))
    return out.withColumn("flat", F.col("off") == 0)
