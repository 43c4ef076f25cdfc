"""Columns of points: views, normals, colours, moves, boxes and planes as predicates, poses, profiles."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .cells import AXES


def finite(c: Column) -> Column:
    """Whether a floating value is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def total(parts: list[Column]) -> Column:
    """Sum from left to right."""
    return reduce(Column.__add__, parts)


def dot(a: list[Column], b: list[Column]) -> Column:
    return total([x * y for x, y in zip(a, b, strict=True)])


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def xyz_float(points: DataFrame) -> DataFrame:
    """(id, x, y, z) in single precision."""
    return points.select("id", *[F.col(a).cast("float").alias(a) for a in AXES])


def unit_normals(points: DataFrame, names: tuple[str, str, str] | None, least: float = 1e-8) -> DataFrame:
    """points with nx, ny, nz of length one and valid: a normal that is shorter than least or not finite is null and invalid; without
    such columns all are."""
    if names is None:
        return points.withColumns({**{f"n{a}": F.lit(None).cast("double") for a in AXES}, "valid": F.lit(False)})
    n = [F.col(c).cast("double") for c in names]
    length = F.sqrt(dot(n, n))
    valid = F.coalesce(finite(length) & (length > least), F.lit(False))
    return points.withColumns({**{f"n{a}": F.when(valid, c / length) for a, c in zip(AXES, n, strict=True)}, "valid": valid})


def colours(points: DataFrame, rgb: tuple[str, str, str], packed: str, intensity: str, grey: float = 0.65) -> DataFrame:
    """points with red, green, blue from 0 to 1: three integer channels, else a packed 24-bit number, else the intensity, else grey."""
    own = [F.col(c) / 255.0 for c in rgb]
    there = reduce(Column.__and__, [F.col(c).isNotNull() for c in rgb])
    of = lambda shift: F.shiftright(F.col(packed), shift).bitwiseAND(F.lit(255)) / 255.0
    names = zip(("red", "green", "blue"), own, (16, 8, 0), strict=True)
    return points.withColumns({n: F.coalesce(F.when(there, c), of(s), F.col(intensity) / 255.0, F.lit(grey)) for n, c, s in names})


def oriented(points: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """points with the normal's sign chosen so that its largest component (x before y before z in a tie) isn't negative."""
    n = [F.col(c) for c in names]
    size = [F.abs(c) for c in n]
    top = F.when((size[0] >= size[1]) & (size[0] >= size[2]), n[0]).when(size[1] >= size[2], n[1]).otherwise(n[2])
    return points.withColumn("__s", F.when(top < 0, -1.0).otherwise(1.0)).withColumns({c: F.col(c) * F.col("__s") for c in names}).drop("__s")


def moved(points: DataFrame, rotation: list[list[float]], offset: list[float]) -> DataFrame:
    """points with x, y, z = rotation · p + offset."""
    p = [F.col(a) for a in AXES]
    return points.withColumns({a: dot([F.lit(v) for v in row], p) + t for a, row, t in zip(AXES, rotation, offset, strict=True)})


def cropped(points: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """points inside the open box."""
    return points.filter(reduce(Column.__and__, [(F.col(a) > lo) & (F.col(a) < hi) for a, lo, hi in zip(AXES, low, high, strict=True)]))


def in_oriented_box(centre: list[Column], axes: list[list[Column]], size: list[Column], margin: Column | float) -> Column:
    """Whether x, y, z is at most margin away from the box, whose unit axes are given as rows."""
    p = [F.col(a) - c for a, c in zip(AXES, centre, strict=True)]
    out = [F.greatest(F.abs(dot(row, p)) - s / 2, F.lit(0.0)) for row, s in zip(axes, size, strict=True)]
    return F.sqrt(dot(out, out)) <= margin


def on_plane(normal: list[float], offset: float, tolerance: float) -> Column:
    return F.abs(dot([F.lit(v) for v in normal], [F.col(a) for a in AXES]) + offset) <= tolerance


def every(points: DataFrame, step: int) -> DataFrame:
    """Rows whose dense id is a multiple of step."""
    return points.filter(F.col("id") % step == 0)


def evenly(points: DataFrame, most: int) -> DataFrame:
    """At most `most` rows (2 or more), evenly spaced over the dense ids from 0 on, the first and the last one among them."""
    n = points.select((F.max("id") + 1).alias("__n"))
    at = points.join(F.broadcast(n))  # one row
    k = F.ceil(F.col("id") * (most - 1) / (F.col("__n") - 1))
    picked = (F.col("__n") <= most) | (F.floor(k * (F.col("__n") - 1) / (most - 1)) == F.col("id"))
    return at.filter(picked).drop("__n")


def wheel_velocities(linear: Column, angular: Column, radius: float, apart: float) -> tuple[Column, Column]:
    """Of the left and the right wheel of a differential drive."""
    return (linear - angular * apart / 2) / radius, (linear + angular * apart / 2) / radius


def yaw(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def wrapped(angle: Column) -> Column:
    """The angle from -π up to but not including π."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def rotated(v: list[Column], x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """v turned by a unit quaternion."""
    q = [x, y, z]
    t = [2 * c for c in cross(q, v)]
    return [a + w * b + c for a, b, c in zip(v, t, cross(q, t), strict=True)]


def ranged(distance: Column, least: float, most: float) -> Column:
    """The distance where it is finite and within the sensor's range, else infinite."""
    return F.when(finite(distance) & (distance >= least) & (distance <= most), distance).otherwise(F.lit(math.inf))


def polar(distance: Column, azimuth: Column, elevation: Column) -> list[Column]:
    return [distance * F.cos(elevation) * F.cos(azimuth), distance * F.cos(elevation) * F.sin(azimuth), distance * F.sin(elevation)]


def clamped(value: Column, most: float) -> Column:
    return F.greatest(F.least(value, F.lit(most)), F.lit(-most))


def palette(height: Column, up: Column) -> Column:
    """A surface's colour name by rule: flat and low is ground, flat above it roof, upright wall, the rest slope."""
    return F.when((F.abs(up) >= 0.85) & (height < 0.0), "ground").when(F.abs(up) >= 0.85, "roof").when(F.abs(up) <= 0.3, "wall").otherwise("slope")


def smoothstep(w: Column) -> Column:
    c = F.greatest(F.least(w, F.lit(1.0)), F.lit(0.0))
    return c * c * (3 - 2 * c)


def corridor(points: DataFrame, start: tuple[float, float], end: tuple[float, float], half: float, blend: float) -> DataFrame:
    """points with along (0 at start, 1 at end), across, and weight: 1 within half of the line, falling smoothly to 0 at blend beyond,
    0 in front of the start and behind the end."""
    dx, dy = end[0] - start[0], end[1] - start[1]
    length = math.hypot(dx, dy)
    px, py = F.col("x") - start[0], F.col("y") - start[1]
    out = points.withColumn("along", (px * dx + py * dy) / length**2).withColumn("across", (py * dx - px * dy) / length)
    inside = (F.col("along") >= 0) & (F.col("along") <= 1)
    return out.withColumn("weight", F.when(inside, smoothstep((half + blend - F.abs("across")) / blend)).otherwise(0.0))


def repaired(points: DataFrame, z0: float, z1: float) -> DataFrame:
    """corridor() points with z drawn to the line from z0 to z1 by their weight."""
    target = z0 + (z1 - z0) * F.col("along")
    return points.withColumn("z", F.col("z") + F.col("weight") * (target - F.col("z")))


def smoothed(rows: DataFrame, over: WindowSpec, value: str, sigma: float, reach: int) -> DataFrame:
    """rows with smooth: a Gaussian mean over reach rows to either side; beyond the ends the end's value counts on."""
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    at = lambda k: F.coalesce(F.lag(value, -k).over(over) if k < 0 else F.lead(value, k).over(over), first if k < 0 else last)
    parts = [F.lit(x / sum(w)) * (F.col(value) if k == 0 else at(k)) for k, x in zip(range(-reach, reach + 1), w, strict=True)]
    return rows.withColumn("smooth", total(parts))


def spacing(rows: DataFrame, over: WindowSpec, key: str, value: str, most: float) -> DataFrame:
    """(key, n, rising, spaced): whether the value strictly rises with the order, and by at most `most` each step."""
    step = rows.withColumn("__d", F.col(value) - F.lag(value).over(over))
    return step.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.col("__d") > 0), F.lit(True)).alias("rising"), F.coalesce(F.bool_and(F.col("__d") <= most), F.lit(True)).alias("spaced"))


def eigenvalues(c: dict[str, Column]) -> list[Column]:
    """The three eigenvalues, falling, of the symmetric matrix of xx, xy, xz, yy, yz, zz: in closed form, so that nothing leaves the JVM."""
    q = (c["xx"] + c["yy"] + c["zz"]) / 3
    off = c["xy"] * c["xy"] + c["xz"] * c["xz"] + c["yz"] * c["yz"]
    d = [c["xx"] - q, c["yy"] - q, c["zz"] - q]
    p = F.sqrt((dot(d, d) + 2 * off) / 6)
    det = d[0] * (d[1] * d[2] - c["yz"] * c["yz"]) - c["xy"] * (c["xy"] * d[2] - c["yz"] * c["xz"]) + c["xz"] * (c["xy"] * c["yz"] - d[1] * c["xz"])
    phi = F.acos(F.greatest(F.least(F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))) / 3
    big, small = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return [big, 3 * q - big - small, small]
