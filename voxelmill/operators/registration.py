"""Registration of two surveys: a sweep over headings and handedness on structural cells, then point-to-plane refinement.

The sweep counts, for every heading, how the structural cells of both surveys fall on each other under any shift; a heading is a task
of its own over a raster as large as the area. The refinement is one aggregate a round: the normal equations of a small motion, six by
six, summed over all pairs of nearest rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import removed, stored
from . import audits, joins
from .attributes import cross, dot
from .cells import AXES

#: Most cells of a raster that one heading's task holds.
RASTER = 1 << 24


def structural(points: DataFrame, size: float, tall: float = 1.0, key: list[str] | None = None) -> DataFrame:
    """(key, ix, iy): cells whose points (x, y, z) reach over more than `tall`."""
    cell = points.groupBy(*(key or []), F.floor(F.col("x") / size).alias("ix"), F.floor(F.col("y") / size).alias("iy")).agg(F.min("z").alias("__a"), F.max("z").alias("__b"))
    return cell.filter(F.col("__b") - F.col("__a") > tall).drop("__a", "__b")


def _correlated(table: pa.Table, target: np.ndarray, low: tuple[int, int]) -> pa.Table:
    """Best shift of one heading's cells onto the target raster, by the convolution theorem; counts are whole, so exact."""
    x, y = (table.column(c).to_numpy() for c in ("ix", "iy"))
    a = (int(x.min()), int(y.min()))
    shape = (int(x.max()) - a[0] + 1, int(y.max()) - a[1] + 1)
    whole = (shape[0] + target.shape[0] - 1, shape[1] + target.shape[1] - 1)
    if whole[0] * whole[1] > RASTER:
        raise ValueError("the area has too many cells for one raster; take larger cells")
    own = np.zeros(shape, np.float32)
    own[x - a[0], y - a[1]] = 1
    met = np.rint(np.fft.irfft2(np.fft.rfft2(target, whole) * np.fft.rfft2(own[::-1, ::-1], whole), whole))
    at = np.unravel_index(int(met.argmax()), whole)
    dx, dy = (int(at[i]) - shape[i] + 1 + low[i] - a[i] for i in (0, 1))
    return pa.table({"sign": table.column("sign")[:1], "angle": table.column("angle")[:1], "hits": [int(met[at])], "n": [len(x)], "dx": [dx], "dy": [dy]})


def sweep(source: DataFrame, target: DataFrame, headings: list[tuple[int, float]], size: float = 2.0, tall: float = 1.0) -> DataFrame:
    """(sign, angle, hits, n, dx, dy, score) of each heading: the shift by whole cells under which most structural cells of the source
    (x, y, z), mirrored by sign on y and turned by angle degrees, fall on those of the target; the first of equally good ones.

    score: hits / sqrt(n * cells of the target). Headings without a structural cell give no row. What a task holds is the area's raster,
    at most RASTER cells, not points.
    """
    spark = source.sparkSession
    there = [(r.ix, r.iy) for r in structural(target, size, tall).limit(RASTER + 1).collect()]
    if not there:
        return spark.createDataFrame([], "sign long, angle double, hits long, n long, dx long, dy long, score double")
    low = tuple(min(c[i] for c in there) for i in (0, 1))
    shape = tuple(max(c[i] for c in there) - low[i] + 1 for i in (0, 1))
    if shape[0] * shape[1] > RASTER:
        raise ValueError("the area has too many cells for one raster; take larger cells")
    raster = np.zeros(shape, np.float32)
    raster[tuple(np.array(there).T - np.array(low)[:, None])] = 1
    turned = F.explode(F.array(*[F.struct(F.lit(int(s)).cast("long").alias("sign"), F.lit(float(a)).alias("angle"), F.lit(math.cos(math.radians(a))).alias("c"), F.lit(math.sin(math.radians(a))).alias("s")) for s, a in headings])).alias("h")
    each = source.select(*AXES, turned)
    y = F.col("y") * F.col("h.sign")
    each = each.select("h.sign", "h.angle", (F.col("h.c") * F.col("x") - F.col("h.s") * y).alias("x"), (F.col("h.s") * F.col("x") + F.col("h.c") * y).alias("y"), "z")
    cells = structural(each, size, tall, ["sign", "angle"])
    out = cells.groupBy("sign", "angle").applyInArrow(lambda t: _correlated(t, raster, low), "sign long, angle double, hits long, n long, dx long, dy long")
    return out.withColumn("score", F.col("hits") / F.sqrt(F.col("n") * F.lit(float(len(there)))))


def moved(points: DataFrame, matrix: np.ndarray, names: tuple[str, ...] = ("",)) -> DataFrame:
    """points with x, y, z (and vectors named by a prefix, which are turned only) under a 4 x 4 matrix."""
    for n in names:
        v = [F.col(f"{n}{a}") for a in AXES]
        points = points.withColumns({f"{n}{a}": dot([F.lit(float(m)) for m in matrix[i, :3]], v) + (0.0 if n else float(matrix[i, 3])) for i, a in enumerate(AXES)})
    return points


def thinned(points: DataFrame, size: float) -> DataFrame:
    """(id, x, y, z, nx, ny, nz): one mean row for each cell of points with normals; normals of unit length, cells without one left out."""
    cell = points.groupBy(*[F.floor(F.col(a) / size).alias(f"i{a}") for a in AXES]).agg(*[F.avg(a).alias(a) for a in AXES], *[F.avg(f"n{a}").alias(f"n{a}") for a in AXES])
    size_ = F.sqrt(dot([F.col(f"n{a}") for a in AXES], [F.col(f"n{a}") for a in AXES]))
    out = cell.withColumn("__l", size_).filter("__l > 1e-12").withColumns({f"n{a}": F.col(f"n{a}") / F.col("__l") for a in AXES})
    return out.select(F.struct("ix", "iy", "iz").alias("id"), *AXES, *[f"n{a}" for a in AXES])


def _motion(v: np.ndarray) -> np.ndarray:
    """Turns about x, y, z in this order and a shift, as a matrix."""
    (a, b, c), out = v[:3], np.eye(4)
    x = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    y = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
    z = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
    out[:3, :3], out[:3, 3] = z @ y @ x, v[3:]
    return out


def refined(source: DataFrame, target: DataFrame, start: np.ndarray, distance: float, huber: float = 0.2, rounds: int = 100, rest: float = 1e-6) -> tuple[np.ndarray, float, float]:
    """(matrix, share of rows with a partner, their root mean square distance): point-to-plane refinement of the start, rows (id, x, y, z)
    against their nearest of (id, x, y, z, nx, ny, nz) within the distance.

    A round is a join, and one aggregate of 28 sums that the driver solves; residuals above huber weigh less. It ends where share and
    distance change by less than `rest`, or where fewer than six pairs are left.
    """
    matrix, before = np.array(start, float), None
    own = target.select(F.col("id").alias("oid"), *AXES, *[F.col(f"n{a}").alias(f"q{a}") for a in AXES])
    count = source.count()
    for _ in range(rounds + 1):
        now = moved(source.select("id", *AXES), matrix)
        near = joins.nearest_within(now, own, distance)
        p, n = [F.col(a) for a in AXES], [F.col(f"q{a}") for a in AXES]
        off = dot([F.col(a) - F.col(f"o{a}") for a in AXES], n)
        w = F.when(F.abs(off) <= huber, F.lit(1.0)).otherwise(huber / F.abs(off))
        j = [*cross(p, n), *n]
        rows = near.select(off.alias("r"), w.alias("w"), "dist", *[c.alias(f"j{i}") for i, c in enumerate(j)])
        pairs = [(i, k) for i in range(6) for k in range(i, 6)]
        s = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dist") * F.col("dist")).alias("d2"), *[F.sum(F.col("w") * F.col(f"j{i}") * F.col(f"j{k}")).alias(f"a{i}{k}") for i, k in pairs], *[F.sum(F.col("w") * F.col(f"j{i}") * F.col("r")).alias(f"b{i}") for i in range(6)]).first()
        state = (s.n / count if count else 0.0, math.sqrt(s.d2 / s.n) if s.n else math.inf)
        if s.n < 6 or before and all(abs(x - y) < rest for x, y in zip(state, before, strict=True)):
            break
        a = np.zeros((6, 6))
        for i, k in pairs:
            a[i, k] = a[k, i] = s[f"a{i}{k}"]
        matrix, before = _motion(np.linalg.lstsq(a, -np.array([s[f"b{i}"] for i in range(6)]), rcond=None)[0]) @ matrix, state
    return matrix, *state


def nearest_distance(points: DataFrame, others: DataFrame, first: float = 0.5) -> DataFrame:
    """(id, dist): distance of each point (id, x, y, z) to its nearest of the others (x, y, z), however far; nothing if there are none.

    Points look around as far as `first`; those that find nothing look twice as far among the cells' middles, which are few where the
    cells are wide, and then among the rows as far as the nearest cell can reach.
    """
    if others.isEmpty():
        return points.sparkSession.createDataFrame([], f"id {points.schema['id'].dataType.simpleString()}, dist double")
    others = stored(others.select(F.monotonically_increasing_id().alias("oid"), *AXES), "nearest-others")
    left, radius, done = points.select("id", *AXES), first, None
    while True:
        near = joins.nearest_within(left, others, radius)
        found = stored(near.select("id", "dist"), "nearest-found")
        done = found if done is None else done.unionByName(found)
        left = stored(left.join(found.select("id"), "id", "left_anti"), "nearest-left")
        if left.isEmpty():
            return done
        # Widen until one representative of a cell comes in reach of some point; empty rounds over all rows are skipped.
        while True:
            radius *= 2
            middles = others.groupBy(*[F.floor(F.col(a) / radius).alias(f"i{a}") for a in AXES]).agg(F.min("oid").alias("oid")).select("oid", *[((F.col(f"i{a}") + 0.5) * radius).alias(a) for a in AXES])
            if not joins.within(left, middles, 2 * radius).isEmpty():
                break


def register(source: DataFrame, target: DataFrame, size: float = 2.0, thin: float = 0.4, distances: tuple[float, ...] = (3.0, 1.0, 0.4), coarse: float = 5.0, fine: float = 0.25, every: int = 1, held: int = 1, rounds: int = 100) -> dict:
    """The motion that takes the source (id, x, y, z, nx, ny, nz) to the target, and whether it may be used.

    Headings every `coarse` degrees and both kinds of handedness, then every `fine` ones around the best; the height from flat rows
    nearest in the plane; refinement at falling distances between thinned surveys. every: rows whose id is a multiple of it take
    part in the search, held: in the judgement; rounds: most at each distance. The judgement asks for a median distance below 0.15 and a share of 0.7 or more below 0.3.

    matrix, score, angle, sign, quantiles (0.1, 0.5, 0.9, 0.99 of the held rows' distances), within_share (below 0.3), accepted.
    """
    a, b = (stored(df.filter(F.col("id") % every == 0), "survey") for df in (source, target))
    first = sweep(a, b, [(s, float(x)) for s in (1, -1) for x in np.arange(0, 360, coarse)], size).orderBy(F.desc("score"), F.desc("sign"), "angle").first()
    if first is None:
        raise ValueError("a survey has no structural cells")
    around = sweep(a, b, [(first.sign, float(x)) for x in np.arange(first.angle - coarse, first.angle + coarse + fine / 25, fine)], size).orderBy(F.desc("score"), "angle").first()
    best = around if around.score > first.score else first
    turn, matrix = math.radians(best.angle), np.eye(4)
    matrix[:2, :2] = [[math.cos(turn), -math.sin(turn) * best.sign], [math.sin(turn), math.cos(turn) * best.sign]]
    matrix[:2, 3] = best.dx * size, best.dy * size
    flat = lambda df: df.filter(F.abs(F.col("nz")) > 0.8)
    near = joins.nearest_within(moved(flat(a).select("id", *AXES), matrix), flat(b).select(F.col("id").alias("oid"), *AXES), 1.0, 1, "xy").filter("dist < 1")
    middle = audits.quantiles(near.select((F.col("oz") - F.col("z")).alias("dz")), "dz", [0.5]).first()
    matrix[2, 3] = middle.v if middle else 0.0
    thin_a, thin_b = (stored(thinned(df, thin), "survey-thin") for df in (a, b))
    for d in distances:
        matrix, *_ = refined(thin_a, thin_b, matrix, d, rounds=rounds)
    judged = stored(nearest_distance(moved(source.filter(F.col("id") % held == 0).select("id", *AXES), matrix), target.select(*AXES)), "survey-judged")
    q = {r.q: r.v for r in audits.quantiles(judged, "dist", [0.1, 0.5, 0.9, 0.99]).collect()}
    share = judged.agg(F.avg((F.col("dist") < 0.3).cast("double"))).first()[0] or 0.0
    for df in (a, b, thin_a, thin_b):
        removed(df)
    return {"matrix": matrix.tolist(), "score": best.score, "angle": best.angle, "sign": best.sign, "quantiles": [q[k] for k in sorted(q)], "within_share": share, "accepted": bool(q) and q[0.5] < 0.15 and share >= 0.7}
