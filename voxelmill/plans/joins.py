"""Queries of joins: by row, by cell, by distance, by interval, by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, joins, ranges
from . import adapters as A
from .columns import _half_up, _rs
from .registry import query

_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_DXY = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(f"WITH {A.EX} SELECT a.id, b.label, round(b.x, 9) AS x FROM ex a JOIN ex b ON b.id = a.id * 37 % 500")
def row_gather(spark, d):
    p = A.vec_parts(spark, d)
    asked = p.select("id", (F.col("id") * 37 % 500).alias("__at"))
    return asked.join(p.select(F.col("id").alias("__at"), "label", F.round("x", 9).alias("x")), "__at").select("id", "label", "x")


_LAT = "l AS (SELECT CAST(floor(x / 0.05::DOUBLE) AS BIGINT) AS i, CAST(floor(y / 0.05::DOUBLE) AS BIGINT) AS j, max(z) AS value FROM ep WHERE id % 3 = 0 GROUP BY ALL)"
_ASK = "q AS (SELECT id, CASE WHEN id % 2 = 0 THEN x ELSE floor(x / 0.05::DOUBLE) * 0.05::DOUBLE END AS x, y FROM ep), t AS (SELECT *, x / 0.05::DOUBLE AS gx, y / 0.05::DOUBLE AS gy FROM q), c AS (SELECT *, CAST(floor(gx) AS BIGINT) AS i, CAST(floor(gy) AS BIGINT) AS j FROM t)"


@query(f"WITH {A.EP}, {_LAT}, {_ASK} SELECT c.id, round(coalesce(l0.value, l1.value, l2.value, l3.value), 9) AS value FROM c LEFT JOIN l l0 ON l0.i = c.i AND l0.j = c.j LEFT JOIN l l1 ON gx = c.i AND l1.i = c.i - 1 AND l1.j = c.j LEFT JOIN l l2 ON gy = c.j AND l2.i = c.i AND l2.j = c.j - 1 LEFT JOIN l l3 ON gx = c.i AND gy = c.j AND l3.i = c.i - 1 AND l3.j = c.j - 1")
def lattice_lookup(spark, d):
    p = A.vec_points(spark, d)
    lattice = p.filter("id % 3 = 0").groupBy(F.floor(F.col("x") / 0.05).alias("i"), F.floor(F.col("y") / 0.05).alias("j")).agg(F.max("z").alias("value"))
    asked = p.withColumn("x", F.when(F.col("id") % 2 == 0, F.col("x")).otherwise(F.floor(F.col("x") / 0.05) * 0.05))
    return joins.lattice_lookup(asked, lattice, 0.05).withColumn("value", F.round("value", 9))


@query("WITH lp AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem), c AS (SELECT DISTINCT CAST(floor(x * 0.5::DOUBLE) AS BIGINT) AS ix, CAST(floor(y * 0.5::DOUBLE) AS BIGINT) AS iy, CAST(floor(z * 0.5::DOUBLE) AS BIGINT) AS iz FROM lp), b AS (SELECT n_nationkey AS box, n_nationkey % 20 AS lx, n_nationkey % 20 + 2 AS ux, n_nationkey % 6 AS ly, n_nationkey % 6 + 1 AS uy, 0 AS lz, 1 AS uz FROM nation), e AS (SELECT box, unnest(range(lx, ux + 1)) AS ix, ly, uy, lz, uz FROM b), f AS (SELECT box, ix, unnest(range(ly, uy + 1)) AS iy, lz, uz FROM e), g AS (SELECT box, ix, iy, unnest(range(lz, uz + 1)) AS iz FROM f) SELECT box, count(c.ix) = count(*) AS covered FROM g LEFT JOIN c USING (ix, iy, iz) GROUP BY box")
def covered_boxes(spark, d):
    k = F.col("n_nationkey").cast("long")
    boxes = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("box"), (k % 20).alias("lx"), (k % 20 + 2).alias("ux"), (k % 6).alias("ly"), (k % 6 + 1).alias("uy"), F.lit(0).cast("long").alias("lz"), F.lit(1).cast("long").alias("uz"))
    return cells.covered_boxes(boxes, cells.counts(A.line_points(spark, d), 2.0))


@query("SELECT DISTINCT l_partkey * 2 AS id FROM lineitem WHERE l_partkey * 2 NOT IN (SELECT p_partkey FROM part)")
def unknown_ids(spark, d):
    asked = A.table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("id")).distinct()
    return ranges.unknown_ids(asked, A.table(spark, d, "part").select(F.col("p_partkey").alias("id")))


@query("SELECT l.l_partkey AS old, count(*) AS n, CAST(sum(s.s_nationkey) AS BIGINT) AS of FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE s.s_nationkey % 2 = 0 GROUP BY 1")
def composed_mapping(spark, d):
    first = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("old"), F.col("l_suppkey").alias("new"))
    second = A.table(spark, d, "supplier").filter("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("old"), F.col("s_nationkey").alias("new"))
    return ranges.composed(first, second).groupBy("old").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("of"))


@query(f"WITH {A.EP}, n AS (SELECT a.id, b.id AS oid, {_D} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS rank FROM ep a JOIN ep b ON a.id <> b.id WHERE {_D} <= 0.12::DOUBLE) SELECT id, oid, round(dist, 9) AS dist, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 8")
def knn_radius(spark, d):
    return joins.capped_neighbours(A.vec_points(spark, d), 0.12, 8).withColumn("dist", F.round("dist", 9))


@query(f"WITH {A.EP} SELECT id, oid, round(dist, 9) AS dist FROM (SELECT a.id, b.id AS oid, {_D} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS k FROM ep a JOIN ep b ON a.id % 2 = 0 AND b.id % 2 = 1 WHERE {_D} <= 0.2::DOUBLE) WHERE k = 1")
def nearest_join(spark, d):
    p = A.vec_points(spark, d)
    return joins.nearest_within(p.filter("id % 2 = 0"), p.filter("id % 2 = 1").withColumnRenamed("id", "oid"), 0.2).select("id", "oid", F.round("dist", 9).alias("dist"))


@query(f"WITH {A.EP} SELECT id, oid, abs(z - oz) <= 0.05::DOUBLE AS ground FROM (SELECT a.id, b.id AS oid, a.z, b.z AS oz, row_number() OVER (PARTITION BY a.id ORDER BY {_DXY}, b.id) AS k FROM ep a JOIN ep b ON a.id % 5 <> 0 AND b.id % 5 = 0 WHERE {_DXY} <= 0.1::DOUBLE) WHERE k = 1")
def ground_ownership(spark, d):
    p = A.vec_points(spark, d)
    return joins.owned_by_ground(p.filter("id % 5 <> 0"), p.filter("id % 5 = 0").withColumnRenamed("id", "oid"), 0.1, 0.05)


@query(f"WITH {A.LP}, c AS (SELECT CAST(floor(x * 0.5::DOUBLE) AS BIGINT) AS ix, CAST(floor(y * 0.5::DOUBLE) AS BIGINT) AS iy, CAST(min(z) AS BIGINT) AS level FROM lp GROUP BY ALL) SELECT a.ix AS ax, a.iy AS ay, b.ix AS bx, b.iy AS by FROM c a JOIN c b ON (b.ix - a.ix, b.iy - a.iy) IN ((0, 1), (0, 2), (1, -1), (1, 0), (1, 1), (2, 0)) WHERE abs(a.level - b.level) <= 1")
def cell_links(spark, d):
    c = A.line_points(spark, d).groupBy(F.floor(F.col("x") * 0.5).alias("ix"), F.floor(F.col("y") * 0.5).alias("iy")).agg(F.rint(F.min("z")).cast("long").alias("level"))
    return joins.cell_links(c, 2.1, "level", 1)


_GB = "eb AS (SELECT id, " + ", ".join(f"{a} - 0.01::DOUBLE AS l{a}, {a} + 0.01::DOUBLE AS u{a}" for a in "xyz") + " FROM ep), g AS (SELECT a.id AS a, b.id AS b, " + ", ".join(f"greatest(a.l{a} - b.u{a}, b.l{a} - a.u{a}, 0.0::DOUBLE) AS g{a}" for a in "xyz") + " FROM eb a JOIN eb b ON a.id < b.id)"


@query(f"WITH {A.EP}, {_GB} SELECT a, b, round(sqrt(gx * gx + gy * gy + gz * gz), 9) AS gap FROM g WHERE sqrt(gx * gx + gy * gy + gz * gz) <= 0.03::DOUBLE")
def box_gaps(spark, d):
    p = A.vec_points(spark, d)
    boxes = p.select(F.col("id").alias("box"), *[(F.col(a) - 0.01).alias(f"l{a}") for a in "xyz"], *[(F.col(a) + 0.01).alias(f"u{a}") for a in "xyz"])
    return joins.box_gaps(boxes, 0.03).withColumn("gap", F.round("gap", 9))


@query(f"WITH {A.EX}, p AS (SELECT id, e3 / l AS nx, e4 / l AS ny, e5 / l AS nz FROM (SELECT *, sqrt(e3 * e3 + e4 * e4 + e5 * e5) AS l FROM ex)), q AS (SELECT a.id AS a, b.id AS b, degrees(acos(least(abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz), 1.0::DOUBLE))) AS degrees FROM p a JOIN p b ON a.id < b.id) SELECT a, b, round(degrees, 6) AS degrees FROM q WHERE degrees >= 25")
def plane_pairs(spark, d):
    from ..operators import attributes

    p = attributes.unit_normals(A.vec_parts(spark, d), ("e3", "e4", "e5")).withColumnRenamed("id", "plane")
    return joins.plane_pairs(p, 25.0).withColumn("degrees", _half_up("degrees", 6))


_IV = "iv AS (SELECT event_id AS id, event_type AS kind, us AS low, us + CAST(floor(value) AS BIGINT) * 60000000 AS high FROM ev)"


@query(f"WITH {A.EV}, {_IV} SELECT a.kind, a.id AS a, b.id AS b, greatest(a.low, b.low) AS low, least(a.high, b.high) AS high FROM iv a JOIN iv b ON a.kind = b.kind AND a.id % 2 = 0 AND b.id % 2 = 1 AND greatest(a.low, b.low) < least(a.high, b.high)")
def interval_match(spark, d):
    e = A.stream(spark, d).select("event_id", F.col("event_type").alias("kind"), F.col("us").alias("low"), (F.col("us") + F.floor("value") * 60_000_000).alias("high"))
    left, right = (e.filter(f"event_id % 2 = {k}").withColumnRenamed("event_id", n) for k, n in ((0, "a"), (1, "b")))
    return joins.interval_overlaps(left, right, ["kind"], 3_600_000_000.0, crowds=True)


def _dist(e: str) -> str:
    dots = lambda u, v: " + ".join(f"({u(a)}) * ({v(a)})" for a in "xyz")
    ab, ap = (lambda a: f"b_{a} - a_{a}"), (lambda a: f"{e}_{a} - a_{a}")
    t = f"greatest(least(coalesce(({dots(ap, ab)}) / nullif({dots(ab, ab)}, 0), 0.0::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE)"
    return "sqrt(" + " + ".join(f"pow({e}_{a} - a_{a} - {t} * (b_{a} - a_{a}), 2)" for a in "xyz") + ")"


_SG = "sg AS (SELECT id, " + ", ".join(f"{a} AS a_{a}, {a} + 0.2::DOUBLE * e{i} AS b_{a}" for a, i in zip("xyz", (3, 4, 5), strict=True)) + " FROM ex), pc AS (SELECT id AS piece, " + ", ".join(f"a_{a} AS p_{a}, a_{a} + 0.3::DOUBLE * (b_{a} - a_{a}) AS q_{a}" for a in "xyz") + " FROM sg WHERE id % 2 = 0), sm AS (SELECT id AS seg, a_x, a_y, a_z, b_x, b_y, b_z FROM sg WHERE id % 2 = 1)"


@query(f"WITH {A.EX}, {_SG}, m AS (SELECT piece, min(seg) AS seg FROM pc, sm WHERE {_dist('p')} <= 0.06::DOUBLE AND {_dist('q')} <= 0.06::DOUBLE GROUP BY piece) SELECT pc.piece, m.seg FROM pc LEFT JOIN m USING (piece)")
def capsule_cover(spark, d):
    p = A.vec_parts(spark, d)
    s = p.select("id", *[F.col(a).alias(f"a{a}") for a in "xyz"], *[(F.col(a) + 0.2 * F.col(f"e{i}")).alias(f"b{a}") for a, i in zip("xyz", (3, 4, 5), strict=True)])
    pieces = s.filter("id % 2 = 0").select(F.col("id").alias("piece"), *[F.col(f"a{a}").alias(f"p{a}") for a in "xyz"], *[(F.col(f"a{a}") + 0.3 * (F.col(f"b{a}") - F.col(f"a{a}"))).alias(f"q{a}") for a in "xyz"])
    return joins.capsule_cover(pieces, s.filter("id % 2 = 1").withColumnRenamed("id", "seg"), 0.06, 0.4)


_CUBES = ", ".join(f"(SELECT unnest([-1, 0, 1]) AS d{a})" for a in "xyz")


@query(f"WITH {A.EP}, t AS (SELECT *, " + ", ".join(f"CAST(floor({a} / 0.1::DOUBLE) AS BIGINT) AS h{a}" for a in "xyz") + " FROM ep), h AS (SELECT *, " + ", ".join(f"h{a} + d{a} AS c{a}" for a in "xyz") + f" FROM t, {_CUBES}) SELECT cx, cy, cz, count(*) AS points, count(*) FILTER (WHERE dx = 0 AND dy = 0 AND dz = 0) AS owned FROM h WHERE " + " AND ".join(f"{a} >= c{a} * 0.1::DOUBLE - 0.02::DOUBLE AND {a} < (c{a} + 1) * 0.1::DOUBLE + 0.02::DOUBLE" for a in "xyz") + " GROUP BY ALL")
def cubic_halo(spark, d):
    return joins.cubic_halo(A.vec_points(spark, d), 0.1, 0.02).groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("points"), F.count_if("own").alias("owned"))


@query(f"WITH {A.EV} SELECT a.event_id, min(b.us) AS answer, min(b.us) IS NOT NULL AS timely FROM ev a LEFT JOIN ev b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND b.us >= a.us AND b.us <= a.us + 43200000000 WHERE a.event_type = 'click' GROUP BY a.event_id")
def request_replies(spark, d):
    e = A.stream(spark, d)
    asked = e.filter("event_type = 'click'").select("event_id", "user_id", "us")
    return joins.replies(asked, e.filter("event_type = 'purchase'").select("user_id", "us"), "user_id", "us", 43_200_000_000).select("event_id", "answer", "timely")


@query(f"WITH {A.EP}, v AS (SELECT DISTINCT id % 23 AS owner, round(x, 1) + 0.0::DOUBLE AS x, round(y, 1) + 0.0::DOUBLE AS y, round(z, 1) + 0.0::DOUBLE AS z FROM ep), l AS (SELECT owner AS a, lead(owner) OVER (PARTITION BY x, y, z ORDER BY owner) AS b FROM v) SELECT DISTINCT a, b FROM l WHERE b IS NOT NULL")
def welded_owners(spark, d):
    return joins.welded(A.vec_points(spark, d).select((F.col("id") % 23).alias("owner"), *[F.round(a, 1).alias(a) for a in "xyz"]))


_TR = "k AS (SELECT i, j, 0.01::DOUBLE * i AS z00, 0.01::DOUBLE * (i + 1) - 0.02::DOUBLE * (j % 2) AS z10, 0.01::DOUBLE * (i + 1) + 0.005::DOUBLE * j AS z11, 0.01::DOUBLE * i + 0.003::DOUBLE * j AS z01 FROM (SELECT unnest(range(-4, 5)) AS i), (SELECT unnest(range(-4, 5)) AS j))"


@query(f"WITH {A.EP}, {_TR}, q AS (SELECT id, x / 0.05::DOUBLE AS gx, y / 0.05::DOUBLE AS gy, CAST(floor(x / 0.05::DOUBLE) AS BIGINT) AS i, CAST(floor(y / 0.05::DOUBLE) AS BIGINT) AS j FROM ep), u AS (SELECT *, gx - i AS u, gy - j AS v FROM q) SELECT id, round(CASE WHEN u >= v THEN z00 + u * (z10 - z00) + v * (z11 - z10) ELSE z00 + u * (z11 - z01) + v * (z01 - z00) END, 9) AS ground FROM u LEFT JOIN k USING (i, j)")
def terrain_heights(spark, d):
    i = spark.range(-4, 5).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(-4).cast("long"), F.lit(4).cast("long"))).alias("j"))
    c, r, j = F.col("i"), F.col("i") + 1, F.col("j")
    corners = i.select("i", "j", (0.01 * c).alias("z00"), (0.01 * r - 0.02 * (j % 2)).alias("z10"), (0.01 * r + 0.005 * j).alias("z11"), (0.01 * c + 0.003 * j).alias("z01"))
    return joins.terrain(A.vec_points(spark, d), corners, 0.05).withColumn("ground", F.round("ground", 9))
