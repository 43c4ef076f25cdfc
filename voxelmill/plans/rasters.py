"""Queries of masks and counts in the plane, and of lines in which planes meet."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import rasters
from . import adapters as A
from .columns import _r, _rs
from .registry import query
from .shapes import _PB, _planes

_CELLS = "c AS (SELECT CAST(floor(x * 0.5::DOUBLE) AS BIGINT) AS ix, CAST(floor(y * 0.5::DOUBLE) AS BIGINT) AS iy FROM lp GROUP BY ALL HAVING count(*) > 3)"
_D = "(SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)"


def _cells(spark, d):
    return A.line_points(spark, d).groupBy(F.floor(F.col("x") * 0.5).alias("ix"), F.floor(F.col("y") * 0.5).alias("iy")).agg(F.count(F.lit(1)).alias("n")).filter("n > 3").select("ix", "iy")


@query(f"WITH {A.LP}, {_CELLS}, g AS (SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM c, {_D}), e AS (SELECT ix, iy FROM (SELECT ix + dx AS ix, iy + dy AS iy FROM g, {_D}) GROUP BY ix, iy HAVING count(*) = 9), f AS (SELECT e.ix, e.iy FROM e JOIN g USING (ix, iy) UNION SELECT ix, iy FROM c) SELECT ix, iy FROM f WHERE ix % 7 <> 0 OR (ix, iy) IN (SELECT (ix, iy) FROM c)")
def closed_cells(spark, d):
    c = _cells(spark, d)
    wide = rasters.dilated(c, 1)
    return rasters.closed(c, 1, wide.filter("ix % 7 = 0"))


@query(f"WITH {A.EP}, {A.FC}, m AS (SELECT DISTINCT CAST(floor(x / 0.1::DOUBLE) AS BIGINT) AS ix, CAST(floor(y / 0.1::DOUBLE) AS BIGINT) AS iy FROM ep WHERE z > 0.1), i AS (SELECT id, (CAST(floor(x / 0.1::DOUBLE) AS BIGINT), CAST(floor(y / 0.1::DOUBLE) AS BIGINT)) IN (SELECT (ix, iy) FROM m) AS inside FROM ep) SELECT face, p.inside OR q.inside OR r.inside AS touched, p.inside AND q.inside AND r.inside AS covered FROM fc JOIN i p ON p.id = a JOIN i q ON q.id = b JOIN i r ON r.id = c")
def covered_faces(spark, d):
    p = A.vec_points(spark, d)
    mask = p.filter("z > 0.1").select(F.floor(F.col("x") / 0.1).alias("ix"), F.floor(F.col("y") / 0.1).alias("iy"))
    return rasters.covered_faces(A.faces(spark, d), p, mask, 0.1)


@query(f"WITH {A.EP}, h AS (SELECT CAST(k AS INTEGER) AS angle, CAST(floor((x * cos(k * {math.pi / 30!r}::DOUBLE) + y * sin(k * {math.pi / 30!r}::DOUBLE)) / 0.05::DOUBLE) AS BIGINT) AS bin FROM ep, (SELECT unnest(range(30)) AS k)) SELECT angle, bin, count(*) AS n FROM h GROUP BY ALL")
def hough_bins(spark, d):
    return rasters.hough(A.vec_points(spark, d), 30, 0.05)


@query(f"WITH {A.EP} SELECT CAST(floor(x / 0.05::DOUBLE) AS BIGINT) AS station, count(*) AS n, round(quantile_cont(y, 0.1), 7) AS left, round(quantile_cont(y, 0.9), 7) AS right FROM ep GROUP BY 1")
def section_widths(spark, d):
    return rasters.section_widths(A.vec_points(spark, d), "x", "y", 0.05, 0.1, 0.9).withColumns(_r("left right", 7))


@query(f"WITH {A.LP}, {_CELLS}, o AS (SELECT ix + 2 AS ix, iy - 1 AS iy FROM c WHERE (ix + iy) % 5 <> 0), d AS (SELECT unnest(range(-3, 4)) AS dx), e AS (SELECT unnest(range(-3, 4)) AS dy) SELECT CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, count(*) AS n FROM c, d, e JOIN o ON o.ix = c.ix + dx AND o.iy = c.iy + dy GROUP BY ALL")
def raster_shifts(spark, d):
    c = _cells(spark, d)
    other = c.filter("(ix + iy) % 5 <> 0").select((F.col("ix") + 2).alias("ix"), (F.col("iy") - 1).alias("iy"))
    return rasters.shifts(c, other, 3)


_X = "x AS (SELECT a.plane AS a, b.plane AS b, a.ny * b.nz - a.nz * b.ny AS ux, a.nz * b.nx - a.nx * b.nz AS uy, a.nx * b.ny - a.ny * b.nx AS uz, b.off * a.nx - a.off * b.nx AS vx, b.off * a.ny - a.off * b.ny AS vy, b.off * a.nz - a.off * b.nz AS vz FROM po a JOIN po b ON b.plane = a.plane + 1), y AS (SELECT *, ux * ux + uy * uy + uz * uz AS s FROM x)"


@query(f"WITH {A.EX}, {_PB}, {_X} SELECT a, b, {_rs('ux=ux / sqrt(s); uy=uy / sqrt(s); uz=uz / sqrt(s); px=(vy * uz - vz * uy) / s; py=(vz * ux - vx * uz) / s; pz=(vx * uy - vy * ux) / s', 6)} FROM y")
def crease_lines(spark, d):
    p = _planes(spark, d).select("plane", "nx", "ny", "nz", "offset")
    other = p.select((F.col("plane") - 1).alias("plane"), *[F.col(c).alias(f"o_{c}") for c in ("nx", "ny", "nz", "offset")])
    names = ["ux", "uy", "uz", "px", "py", "pz"]
    out = rasters.creases(p.join(other, "plane")).select(F.col("plane").alias("a"), (F.col("plane") + 1).alias("b"), *names)
    return out.withColumns(_r(" ".join(names), 6))


@query(f"WITH {A.EX}, {_PB}, s AS (SELECT e.id % 60 AS plane, abs(e.x * nx + e.y * ny + e.z * nz + off) AS away FROM ex e JOIN po ON po.plane = e.id % 60) SELECT plane, count(*) AS n, count(*) FILTER (WHERE away > 0.1::DOUBLE) AS off, round(max(away), 8) AS worst, count(*) FILTER (WHERE away > 0.1::DOUBLE) = 0 AS flat FROM s GROUP BY plane")
def plane_audit(spark, d):
    p = A.vec_points(spark, d)
    return rasters.plane_audit(p, p.select("id", (F.col("id") % 60).alias("plane")), _planes(spark, d), 0.1).withColumn("worst", F.round("worst", 8))
