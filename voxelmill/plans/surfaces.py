"""Queries of masks, outlines, height fields, strips and headings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import claims, contours, edges, masks, merging, patches, regions, registration, terrain
from ..sources.folders import shared
from . import adapters as A
from .columns import _r
from .registry import query

# Cells with gaps: those that hold some rows, without every seventh or so.
_C = "c0 AS (SELECT CAST(floor(x * 0.5::DOUBLE) AS BIGINT) AS ix, CAST(floor(y * 0.25::DOUBLE) AS BIGINT) AS iy, count(*) AS n FROM lp GROUP BY 1, 2), c AS (SELECT ix, iy FROM c0 WHERE n > 3 AND (ix * 5 + iy * 3) % 7 <> 0)"
_GRID = "b AS (SELECT min(ix) AS lx, max(ix) AS ux, min(iy) AS ly, max(iy) AS uy FROM {0}), g AS (SELECT ix, iy FROM (SELECT unnest(range(lx - 1, ux + 2)) AS ix FROM b), (SELECT unnest(range(ly - 1, uy + 2)) AS iy FROM b)), e AS (SELECT ix, iy FROM g ANTI JOIN {0} USING (ix, iy))"
#: Empty cells that no way of empty neighbours leads out of, with their hole's first cell and size.
_HOLES = "w(ix, iy, root) AS (SELECT ix, iy, iy * 100000 + ix FROM e UNION SELECT e.ix, e.iy, w.root FROM w JOIN e ON abs(e.ix - w.ix) + abs(e.iy - w.iy) = 1), p AS (SELECT ix, iy, min(root) AS hole FROM w GROUP BY ix, iy), h AS (SELECT ix, iy, hole, count(*) OVER (PARTITION BY hole) AS area FROM p WHERE hole <> (SELECT (ly - 1) * 100000 + lx - 1 FROM b))"
_DISC = "o AS (SELECT dx, dy FROM (SELECT unnest(range(-3, 4)) AS dx), (SELECT unnest(range(-3, 4)) AS dy))"


def _closing(name: str, of: str) -> str:
    """Common table expressions for a closing by the disc of squared radius 4, whose 13 cells are n4."""
    return f"{name}d AS (SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM {of}, n4), {name} AS (SELECT a.ix, a.iy FROM {name}d a, n4 JOIN {name}d b ON b.ix = a.ix + dx AND b.iy = a.iy + dy GROUP BY a.ix, a.iy HAVING count(*) = 13 UNION SELECT ix, iy FROM {of})"


def _cells(spark, d):
    ix, iy = F.floor(F.col("x") * 0.5), F.floor(F.col("y") * 0.25)
    return A.line_points(spark, d).groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 3) & ((F.col("ix") * 5 + F.col("iy") * 3) % 7 != 0)).select("ix", "iy")


@query(f"WITH {A.LP}, {_C}, {_GRID.format('c')} SELECT c.ix, c.iy, min((c.ix - e.ix) * (c.ix - e.ix) + (c.iy - e.iy) * (c.iy - e.iy)) AS d2 FROM c, e GROUP BY c.ix, c.iy")
def cell_distances(spark, d):
    return masks.distances(_cells(spark, d))


@query(f"WITH {A.LP}, {_C}, {_DISC}, n4 AS (SELECT * FROM o WHERE dx * dx + dy * dy <= 4), {_closing('k', 'c')} SELECT ix, iy FROM k")
def disc_closing(spark, d):
    return masks.closed_disc(_cells(spark, d), 4)


@query(f"WITH RECURSIVE {A.LP}, {_C}, {_GRID.format('c')}, {_HOLES} SELECT ix, iy, hole // 100000 AS hole_y, hole % 100000 AS hole_x, area FROM h")
def mask_holes(spark, d):
    got = masks.holes(_cells(spark, d)).select(F.explode(F.sequence("low", "high")).alias("ix"), "iy", "hole", "area")
    return got.select("ix", "iy", F.col("hole.iy").alias("hole_y"), F.col("hole.low").alias("hole_x"), "area")


_SEG = "s AS (SELECT n_nationkey % 9 AS ax, n_nationkey AS ay, n_nationkey % 9 + 4 AS cx, n_nationkey + n_regionkey AS cy FROM nation), sk AS (SELECT *, greatest(abs(cx - ax), abs(cy - ay)) AS n FROM s), sc AS (SELECT DISTINCT CAST(round_even(ax + (cx - ax) * k / n::DOUBLE, 0) AS BIGINT) AS ix, CAST(round_even(ay + (cy - ay) * k / n::DOUBLE, 0) AS BIGINT) AS iy FROM sk, (SELECT unnest(range(0, 9)) AS k) WHERE k <= n)"
_GUARD = "r AS (SELECT CAST(floor(x * 0.5::DOUBLE) AS BIGINT) AS ix, CAST(floor(y * 0.25::DOUBLE) AS BIGINT) AS iy FROM lp WHERE z > 9.5 AND x > 30 GROUP BY ALL HAVING count(*) >= 3), gd AS (SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM r, o WHERE dx * dx + dy * dy <= 1)"


@query(f"""WITH RECURSIVE {A.LP}, {_C}, {_DISC}, n4 AS (SELECT * FROM o WHERE dx * dx + dy * dy <= 4), {_SEG}, {_GUARD}, seed AS (SELECT ix, iy FROM c UNION SELECT ix, iy FROM sc), {_closing('k', 'seed')}, {_closing('l', 'c')}, {_GRID.format('k')}, {_HOLES},
near AS (SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM seed, o WHERE dx * dx + dy * dy <= 6.25), a AS (SELECT ix, iy FROM k UNION SELECT ix, iy FROM h WHERE area <= 12),
f AS (SELECT ix, iy, (ix, iy) IN (SELECT (ix, iy) FROM c) AS observed, (ix, iy) IN (SELECT (ix, iy) FROM h WHERE area <= 12) AS enclosed, (ix, iy) IN (SELECT (ix, iy) FROM k) AND (ix, iy) NOT IN (SELECT (ix, iy) FROM l) AS bridged FROM a)
SELECT ix, iy, observed, enclosed, bridged AND NOT observed AS bridged FROM f WHERE (observed OR (ix, iy) NOT IN (SELECT (ix, iy) FROM gd)) AND (enclosed OR (ix, iy) IN (SELECT (ix, iy) FROM near))""")
def repaired_mask(spark, d):
    shared(spark)
    n, k, r = A.table(spark, d, "nation"), F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    links = n.select((k % 9).alias("ax"), k.alias("ay"), (k % 9 + 4).alias("bx"), (k + r).alias("by"))
    recess = A.line_points(spark, d).filter("z > 9.5 and x > 30").select(F.floor(F.col("x") * 0.5).alias("ix"), F.floor(F.col("y") * 0.25).alias("iy"))
    return masks.repaired(_cells(spark, d), masks.segment_cells(links), masks.protected_cells(recess), 1.5, 12)


_SIDE = "sd AS (SELECT c.ix + sx AS ax, c.iy + sy AS ay, dx, dy, t FROM c, (VALUES (0, -1, 0, 0, 1, 0, 0), (1, 0, 1, 0, 0, 1, 1), (0, 1, 1, 1, -1, 0, 2), (-1, 0, 0, 1, 0, -1, 3)) v(ox, oy, sx, sy, dx, dy, t) ANTI JOIN (SELECT ix AS jx, iy AS jy FROM c) j ON j.jx = c.ix + ox AND j.jy = c.iy + oy)"
#: Straight stretches: a side that follows one of its own direction begins none.
_STRETCH = "rn AS (SELECT *, CASE WHEN dx <> 0 THEN ay ELSE ax END AS line, CASE WHEN dx <> 0 THEN ax * dx ELSE ay * dy END AS along FROM sd), rr AS (SELECT *, along - row_number() OVER (PARTITION BY t, line ORDER BY along) AS run FROM rn), sg AS (SELECT t, dx, dy, line, min(along) AS lo, max(along) + 1 AS hi FROM rr GROUP BY t, dx, dy, line, run), z AS (SELECT t, dx, dy, CASE WHEN dx <> 0 THEN lo * dx ELSE line END AS ax, CASE WHEN dx <> 0 THEN line ELSE lo * dy END AS ay, CASE WHEN dx <> 0 THEN hi * dx ELSE line END AS cx, CASE WHEN dx <> 0 THEN line ELSE hi * dy END AS cy FROM sg), zi AS (SELECT *, (ax + 1000) * 100000 + (ay + 1000) * 10 + t AS id FROM z)"
_NEXT = "y AS (SELECT a.id, b.id AS nx, a.cx, a.cy, a.dx * b.dy - a.dy * b.dx AS turn, count(*) OVER (PARTITION BY a.id) AS ways FROM zi a JOIN zi b ON b.ax = a.cx AND b.ay = a.cy), f1 AS (SELECT * FROM y WHERE ways = 1 OR turn > 0), r1(id, pt) AS (SELECT id, id FROM zi UNION SELECT r1.id, f1.nx FROM r1 JOIN f1 ON f1.id = r1.pt), c1 AS (SELECT id, min(pt) AS loop FROM r1 GROUP BY id), tw AS (SELECT cx, cy FROM f1 JOIN c1 USING (id) WHERE ways = 2 GROUP BY cx, cy HAVING count(DISTINCT loop) = 1), f2 AS (SELECT id, nx FROM y WHERE ways = 1 OR CASE WHEN (cx, cy) IN (SELECT (cx, cy) FROM tw) THEN turn < 0 ELSE turn > 0 END), r2(id, pt) AS (SELECT id, id FROM zi UNION SELECT r2.id, f2.nx FROM r2 JOIN f2 ON f2.id = r2.pt), c2 AS (SELECT id, min(pt) AS loop FROM r2 GROUP BY id), wk(loop, place, id) AS (SELECT loop, 0, id FROM c2 WHERE id = loop UNION ALL SELECT loop, place + 1, nx FROM wk JOIN f2 USING (id) WHERE nx <> loop)"


@query(f"WITH RECURSIVE {A.LP}, {_C}, {_SIDE}, {_STRETCH}, {_NEXT} SELECT h.ax AS lx, h.ay AS ly, CAST(h.t AS INTEGER) AS turn, CAST(place AS BIGINT) AS place, v.ax AS x, v.ay AS y FROM wk JOIN zi h ON h.id = wk.loop JOIN zi v ON v.id = wk.id")
def outline_loops(spark, d):
    return contours.loops(_cells(spark, d))


@query(f"WITH RECURSIVE {A.LP}, {_C}, {_SIDE}, {_STRETCH}, {_NEXT}, q AS (SELECT loop, v.ax AS x, v.ay AS y, place FROM wk JOIN zi v USING (id)), n AS (SELECT loop, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM q WINDOW w AS (PARTITION BY loop ORDER BY place)) SELECT h.ax AS lx, h.ay AS ly, CAST(h.t AS INTEGER) AS turn, count(*) AS n, CAST(sum(x * ny - y * nx) AS BIGINT) AS area2 FROM n JOIN zi h ON h.id = n.loop GROUP BY 1, 2, 3")
def outline_areas(spark, d):
    return contours.areas(contours.loops(_cells(spark, d)))


def _floor(spark, d):
    """Embeddings as measured ground: some ten metres wide, gently sloping."""
    p = A.vec_points(spark, d)
    return p.select("id", (F.col("x") * 12).alias("x"), (F.col("y") * 12).alias("y"), (F.col("x") * 0.6 + F.col("z") * 0.05).alias("z"))


_FLOOR = "fl AS (SELECT id, x * 12 AS x, y * 12 AS y FROM ep), fc AS (SELECT DISTINCT CAST(floor(x / 0.5::DOUBLE) AS BIGINT) AS ix, CAST(floor(y / 0.5::DOUBLE) AS BIGINT) AS iy FROM fl), k AS (SELECT x, min(iy) AS a, max(iy) + 1 AS b FROM (SELECT ix AS x, iy FROM fc UNION ALL SELECT ix + 1, iy FROM fc) GROUP BY x), m AS (SELECT unnest(range(min(ix), max(ix) + 1)) AS ix FROM fc), hl AS (SELECT m.ix, min(p.a + (q.a - p.a) * (m.ix + 0.5::DOUBLE - p.x) / (q.x - p.x)) AS low, max(p.b + (q.b - p.b) * (m.ix + 0.5::DOUBLE - p.x) / (q.x - p.x)) AS high FROM m JOIN k p ON p.x <= m.ix JOIN k q ON q.x > m.ix GROUP BY m.ix)"


@query(f"WITH {A.EP}, {_FLOOR}, lh AS (SELECT ix, CAST(ceil(round(low - 0.5::DOUBLE, 9)) AS BIGINT) AS lo, CAST(floor(round(high - 0.5::DOUBLE, 9)) AS BIGINT) AS hi FROM hl) SELECT ix, unnest(range(lo, hi + 1)) AS iy FROM lh")
def terrain_cells(spark, d):
    return terrain.lattice(_floor(spark, d), 0.5)


@query()
def terrain_field(spark, d):
    """Conjugate gradients have no SQL; held against a dense solve in the tests."""
    out = terrain.terrain(_floor(spark, d))
    return out.select("ix", "iy", F.round("z", 6).alias("z"), "anchored", F.size("support").alias("points"), "strength")


def _members(spark, d):
    p = A.vec_parts(spark, d)
    return p.select((F.col("id") % 12).alias("member"), "id", (F.floor(F.col("id") / 12) * 0.05).alias("x"), (F.col("e3") * 0.1 + (F.col("id") % 12) * 0.002 * F.floor(F.col("id") / 12)).alias("y"), (F.col("e4") * 0.02).alias("z"))


@query()
def robust_lines(spark, d):
    """Reweighted least squares until it rests; held against Newton steps in the tests."""
    shared(spark)
    got = patches.robust_lines(_members(spark, d), "member", "x", ["y", "z"])
    return got.withColumns(_r("a_y b_y a_z b_z", 8))


@query()
def member_strips(spark, d):
    shared(spark)
    p = _members(spark, d)
    axes = p.select("member").distinct().select("member", *[F.lit(v).alias(n) for n, v in zip(("sx", "sy", "sz", "ex", "ey", "ez", "nx", "ny", "nz"), (0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0), strict=True)])
    out = patches.fit_patches(axes, p.select("member", "x", "y", "z"), p)
    return out.withColumns(_r(" ".join(c for c in out.columns if c not in ("member", "rows")), 6))


_HEADINGS = [(1, 0.0), (1, 33.0), (-1, 0.0), (-1, 120.0)]
_TALL = "GROUP BY ALL HAVING max(z) - min(z) > 0.2::DOUBLE"
_TURNED = " UNION ALL ".join(f"SELECT {s}::BIGINT AS sign, {a!r}::DOUBLE AS angle, {math.cos(math.radians(a))!r}::DOUBLE * x - {math.sin(math.radians(a))!r}::DOUBLE * (y * {s}) AS x, {math.sin(math.radians(a))!r}::DOUBLE * x + {math.cos(math.radians(a))!r}::DOUBLE * (y * {s}) AS y, z FROM ep" for s, a in _HEADINGS)


@query(f"WITH {A.EP}, tr AS ({_TURNED}), a AS (SELECT sign, angle, CAST(floor(x / 0.05::DOUBLE) AS BIGINT) AS ix, CAST(floor(y / 0.05::DOUBLE) AS BIGINT) AS iy FROM tr {_TALL}), b AS (SELECT CAST(floor((x + 0.1::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS ix, CAST(floor((y - 0.05::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS iy FROM ep {_TALL}), h AS (SELECT sign, angle, b.ix - a.ix AS dx, b.iy - a.iy AS dy, count(*) AS hits FROM a, b GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY sign, angle ORDER BY hits DESC, dx, dy) AS k FROM h) SELECT sign, angle, hits, n, dx, dy, round(hits / sqrt(n * (SELECT count(*) FROM b)::DOUBLE), 9) AS score FROM k JOIN (SELECT sign, angle, count(*) AS n FROM a GROUP BY ALL) USING (sign, angle) WHERE k = 1")
def heading_sweep(spark, d):
    p = A.vec_points(spark, d)
    other = p.select((F.col("x") + 0.1).alias("x"), (F.col("y") - 0.05).alias("y"), "z")
    return registration.sweep(p, other, _HEADINGS, 0.05, 0.2).withColumn("score", F.round("score", 9))


_ROAD = """rb AS (SELECT min(ix) AS lx, max(ix) AS ux, min(iy) AS ly, max(iy) AS uy FROM c0), gr AS (SELECT ix, iy FROM (SELECT unnest(range(lx, ux + 1)) AS ix FROM rb), (SELECT unnest(range(ly, uy + 1)) AS iy FROM rb)),
rt AS (SELECT ix, iy, coalesce(n, 0) * 0.02::DOUBLE AS height, coalesce(n, 0) > 2 AND (ix * 5 + iy * 3) % 29 <> 0 AS paved FROM gr LEFT JOIN c0 USING (ix, iy)),
ed AS (SELECT a.ix, a.iy, sqrt(min((a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy))) AS edge FROM rt a, rt b WHERE a.paved AND NOT b.paved GROUP BY a.ix, a.iy),
dp AS (SELECT ix, iy, height FROM rt JOIN ed USING (ix, iy) WHERE edge >= 1.2::DOUBLE), pr AS (SELECT a.ix AS ax, a.iy AS ay, b.ix AS cx, b.iy AS cy FROM dp a JOIN dp b ON (b.ix = a.ix + 1 AND b.iy = a.iy) OR (b.ix = a.ix AND b.iy = a.iy + 1) WHERE abs(b.height - a.height) > 0.3::DOUBLE),
st AS (SELECT ax AS ix, ay AS iy FROM pr UNION SELECT cx, cy FROM pr), aw AS (SELECT a.ix, a.iy, sqrt(min((a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy))) AS away FROM rt a, st b GROUP BY a.ix, a.iy),
t0 AS (SELECT t, exp(-0.5::DOUBLE * (t / 1.5::DOUBLE) * (t / 1.5::DOUBLE)) AS g FROM (SELECT unnest(range(-6, 7)) AS t)), tp AS (SELECT t, g / (SELECT sum(g) FROM t0) AS w FROM t0),
gx AS (SELECT a.ix, a.iy, sum(w * CASE WHEN b.paved THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS m, sum(w * CASE WHEN b.paved THEN b.height ELSE 0.0::DOUBLE END) AS v FROM rt a, tp, rb JOIN rt b ON b.iy = a.iy AND b.ix = greatest(least(a.ix + t, ux), lx) GROUP BY a.ix, a.iy),
gy AS (SELECT a.ix, a.iy, sum(w * b.m) AS m, sum(w * b.v) AS v FROM rt a, tp, rb JOIN gx b ON b.ix = a.ix AND b.iy = greatest(least(a.iy + t, uy), ly) GROUP BY a.ix, a.iy),
sh AS (SELECT rt.ix, rt.iy, height, paved, greatest(least((8 - coalesce(away, 8)) / 6.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) * greatest(least(coalesce(edge, 0) / 1.2::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) AS share, v / greatest(m, 1e-6) AS mean FROM rt LEFT JOIN ed USING (ix, iy) LEFT JOIN aw USING (ix, iy) JOIN gy USING (ix, iy))"""


@query(f"WITH {A.LP}, {_C}, {_ROAD} SELECT ix, iy, round(height, 7) AS height, round(CASE WHEN paved AND share > 0 THEN height + (mean - height) * share ELSE height END, 7) AS repaired FROM sh")
def road_heights(spark, d):
    shared(spark)
    ix, iy = F.floor(F.col("x") * 0.5), F.floor(F.col("y") * 0.25)
    n = A.line_points(spark, d).groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    box = n.agg(F.min("ix").alias("lx"), F.max("ix").alias("ux"), F.min("iy").alias("ly"), F.max("iy").alias("uy"))
    grid = box.select("ly", "uy", F.explode(F.sequence("lx", "ux")).alias("ix")).select("ix", F.explode(F.sequence("ly", "uy")).alias("iy"))
    n = grid.join(n, ["ix", "iy"], "left").fillna(0, ["n"])
    raster = n.select("ix", "iy", (F.col("n") * 0.02).alias("height"), ((F.col("n") > 2) & ((F.col("ix") * 5 + F.col("iy") * 3) % 29 != 0)).alias("paved"))
    return masks.repaired_heights(raster, 0.3, 1.2, 1.5, 8.0, 6.0).withColumns(_r("height repaired", 7))


# References are segments from every third point; predictions parts of them, shifted a little, some of them twice.
_SEGS = """rf AS (SELECT id, id % 2 + 1 AS kind, x AS ax, y AS ay, z AS az, x + e3 AS bx, y + e4 AS b_y, z + e5 AS bz FROM ex WHERE id % 3 = 0),
pd AS (SELECT p.id, r.id % 2 + 1 AS kind, r.x + r.e3 * s + p.e6 * w AS ax, r.y + r.e4 * s + p.e7 * w AS ay, r.z + r.e5 * s + p.e8 * w AS az, r.x + r.e3 * e + p.e7 * w AS bx, r.y + r.e4 * e + p.e8 * w AS b_y, r.z + r.e5 * e + p.e6 * w AS bz FROM (SELECT *, id % 3 * 0.25::DOUBLE - 0.1::DOUBLE AS s, id % 3 * 0.25::DOUBLE + 0.5::DOUBLE AS e, CASE WHEN id % 3 = 2 THEN 0.0::DOUBLE ELSE 0.08::DOUBLE END AS w FROM ex) p JOIN ex r ON r.id = p.id - p.id % 3)"""
_EDGE = """pm AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay) + (bz - az) * (bz - az)) AS len FROM pd), rm AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay) + (bz - az) * (bz - az)) AS len FROM rf),
pu AS (SELECT *, (bx - ax) / len AS dx, (b_y - ay) / len AS dy, (bz - az) / len AS dz FROM pm), ru AS (SELECT *, (bx - ax) / len AS dx, (b_y - ay) / len AS dy, (bz - az) / len AS dz FROM rm),
j1 AS (SELECT p.kind, p.id, r.id AS oid, p.len, r.len AS olen, p.dx * r.dx + p.dy * r.dy + p.dz * r.dz AS c, (p.ax - r.ax) * r.dx + (p.ay - r.ay) * r.dy + (p.az - r.az) * r.dz AS o, (p.ay - r.ay) * r.dz - (p.az - r.az) * r.dy AS px, (p.az - r.az) * r.dx - (p.ax - r.ax) * r.dz AS py, (p.ax - r.ax) * r.dy - (p.ay - r.ay) * r.dx AS pz, p.dy * r.dz - p.dz * r.dy AS sx, p.dz * r.dx - p.dx * r.dz AS sy, p.dx * r.dy - p.dy * r.dx AS sz FROM pu p JOIN ru r USING (kind)),
j2 AS (SELECT *, sx * sx + sy * sy + sz * sz AS ss, px * sx + py * sy + pz * sz AS ps, px * px + py * py + pz * pz AS pp, greatest(0, least(-o / c, (olen - o) / c)) AS l0, least(len, greatest(-o / c, (olen - o) / c)) AS h0 FROM j1 WHERE abs(c) >= cos(radians(15)) - 1e-14),
j3 AS (SELECT *, CASE WHEN ss > 0 THEN pp - ps * ps / ss ELSE pp END AS rest FROM j2 WHERE h0 > l0), j4 AS (SELECT *, CASE WHEN ss > 0 THEN sqrt(greatest(0.0025::DOUBLE - rest, 0) / ss) END AS r FROM j3 WHERE rest <= 0.0025::DOUBLE),
j5 AS (SELECT kind, id, oid, o, c, olen, CASE WHEN ss > 0 THEN greatest(l0, -ps / ss - r) ELSE l0 END AS low, CASE WHEN ss > 0 THEN least(h0, -ps / ss + r) ELSE h0 END AS high FROM j4),
mt AS (SELECT kind, id, oid, low, high, greatest(0, least(o + c * low, o + c * high)) AS olow, least(olen, greatest(o + c * low, o + c * high)) AS ohigh FROM j5 WHERE high > low)"""


def _segments(spark, d):
    p = A.vec_parts(spark, d)
    n = F.col("id") % 3
    ends = dict(zip(("ax", "ay", "az", "bx", "by", "bz"), [*[F.col(a) for a in "xyz"], *[F.col(a) + F.col(e) for a, e in zip("xyz", ("e3", "e4", "e5"), strict=True)]], strict=True))
    reference = p.filter(n == 0).select("id", (F.col("id") % 2 + 1).alias("kind"), *[c.alias(k) for k, c in ends.items()])
    base = p.select(F.col("id").alias("r"), *[F.col(c).alias(f"r_{c}") for c in ("x", "y", "z", "e3", "e4", "e5")])
    own = p.withColumns({"r": F.col("id") - n, "s": n * 0.25 - 0.1, "e": n * 0.25 + 0.5, "w": F.when(n == 2, 0.0).otherwise(0.08)}).join(base, "r")
    at = lambda t, shift: [F.col(f"r_{a}") + F.col(f"r_{e}") * F.col(t) + F.col(f) * F.col("w") for a, e, f in zip("xyz", ("e3", "e4", "e5"), shift, strict=True)]
    predicted = own.select("id", (F.col("r") % 2 + 1).alias("kind"), *[c.alias(k) for k, c in zip(ends, [*at("s", ("e6", "e7", "e8")), *at("e", ("e7", "e8", "e6"))], strict=True)])
    return predicted, reference


@query(f"WITH {A.EX}, {_SEGS}, {_EDGE} SELECT kind, id, oid, round(low, 7) AS low, round(high, 7) AS high, round(olow, 7) AS olow, round(ohigh, 7) AS ohigh FROM mt WHERE high - low > 1e-6")
def edge_matches(spark, d):
    predicted, reference = _segments(spark, d)
    got = edges.matches(edges.measured(predicted), edges.measured(reference), 0.05, 15.0, 0.25)
    return got.filter("high - low > 1e-6").withColumns(_r("low high olow ohigh", 7))


_UNION = lambda name, key, low, high: f"{name}0 AS (SELECT *, max({high}) OVER (PARTITION BY {key} ORDER BY {low}, {high} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM mt), {name} AS (SELECT {key}, sum(greatest(0, {high} - greatest({low}, coalesce(upto, {low})))) AS covered FROM {name}0 GROUP BY {key})"


@query(f"WITH {A.EX}, {_SEGS}, {_EDGE}, {_UNION('u', 'kind, id', 'low', 'high')}, {_UNION('v', 'kind, oid', 'olow', 'ohigh')} SELECT pr.kind, round(raw, 5) AS raw, round(own, 5) AS own, round(reference, 5) AS reference, round(matched, 5) AS matched, round(found, 5) AS found, round(matched / own, 6) AS precision, round(found / reference, 6) AS recall, hits FROM (SELECT kind, sum(len) AS raw, sum(len) AS own FROM pm GROUP BY kind) pr JOIN (SELECT kind, sum(len) AS reference FROM rm GROUP BY kind) USING (kind) JOIN (SELECT kind, sum(covered) AS matched FROM u GROUP BY kind) USING (kind) JOIN (SELECT kind, sum(covered) AS found FROM v GROUP BY kind) USING (kind) JOIN (SELECT kind, count(*) AS hits FROM mt GROUP BY kind) USING (kind)")
def edge_lengths(spark, d):
    predicted, reference = _segments(spark, d)
    out = edges.quality(predicted, reference, 0.05, 15.0, 0.25)
    hits = F.aggregate("fragments", F.lit(0).cast("long"), lambda s, f: s + f["n"])
    return out.select("kind", *[F.round(c, 5).alias(c) for c in ("raw", "own", "reference", "matched", "found")], F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), hits.alias("hits"))


@query()
def drawn_planes(spark, d):
    """Draws have no SQL; tests hold planted planes, and that neither blocks nor partitions matter."""
    planes, _ = regions.region_planes(_floor(spark, d), 10.0, 0.02, 0.05, 24, 2, 40)
    return planes.withColumns(_r("nx ny nz offset", 6))


@query()
def merged_region_planes(spark, d):
    """Planes of regions made one where their common rows stay flat; held against planted planes and numpy in the tests."""
    points = _floor(spark, d)
    planes, members = regions.region_planes(points, 4.0, 0.02, 0.2, 12, 2, 24)
    key = merging.region_key()
    own = members.withColumn("plane", key).join(points, "id").select("plane", "id", "x", "y", "z")
    models, _, of = merging.merged_planes(own, planes.withColumn("plane", key), merging.region_links(planes), 0.2, 10.0)
    pieces = of.groupBy("cluster").agg(F.count(F.lit(1)).alias("pieces"))
    return models.join(pieces, "cluster").withColumns(_r("nx ny nz offset", 6))


@query()
def ordered_claims(spark, d):
    """An ordered fold has no SQL; held against one in the tests."""
    shared(spark)
    p = A.vec_parts(spark, d)
    at = p.select("id", F.explode(F.array(*[F.floor(F.col(a) / 0.05) * 3 + n for n, a in enumerate("xyz")])).alias("plane"), (F.col("e3") > 0).alias("vote"))
    return claims.claims(at, at.select("plane", (F.col("plane") % 3 == 2).alias("gated")))


@query()
def edge_clusters(spark, d):
    """Points in turn join the first cluster all of whose members are near; held against the loop in the tests."""
    return claims.linkage_within(A.vec_points(spark, d).withColumn("order", F.col("x")), "order", 0.1)
