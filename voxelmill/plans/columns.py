"""Queries of columns and predicates of points: views, normals, colours, moves, boxes, poses, profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import attributes as at
from . import adapters as A
from .registry import query


def _r(names: str, digits: int = 9) -> dict:
    return {n: F.round(n, digits) for n in names.split()}


def _half_up(c: str, digits: int) -> Column:
    """round() of figures that aren't negative by the same steps as in SQL; F.round() makes a decimal of each, which took most of the time of
    a table of pairs."""
    return F.floor(F.col(c) * 10.0**digits + 0.5) / 10.0**digits


def _rs(pairs: str, digits: int = 9) -> str:
    return ", ".join(f"round({x}, {digits}) AS {n}" for n, x in (p.split("=", 1) for p in pairs.split("; ")))


@query(f"WITH {A.EP} SELECT id, x::FLOAT AS x, y::FLOAT AS y, z::FLOAT AS z FROM ep")
def xyz_float(spark, d):
    return at.xyz_float(A.vec_points(spark, d))


_N = "n AS (SELECT id, " + ", ".join(f"CASE WHEN id % 10 = 0 THEN 0.0::DOUBLE ELSE e{i} END AS e{i}" for i in (3, 4, 5)) + " FROM ex), l AS (SELECT *, sqrt(e3 * e3 + e4 * e4 + e5 * e5) AS l FROM n)"


@query(f"WITH {A.EX}, {_N} SELECT id, " + ", ".join(f"CASE WHEN l > 1e-8::DOUBLE THEN round(e{i} / l, 9) END AS n{a}" for a, i in zip("xyz", (3, 4, 5), strict=True)) + ", l > 1e-8::DOUBLE AS valid FROM l")
def unit_normals(spark, d):
    p = A.vec_parts(spark, d)
    p = p.withColumns({f"e{i}": F.when(F.col("id") % 10 == 0, 0.0).otherwise(F.col(f"e{i}")) for i in (3, 4, 5)})
    return at.unit_normals(p, ("e3", "e4", "e5")).select("id", "nx", "ny", "nz", "valid").withColumns(_r("nx ny nz"))


_C = "c AS (SELECT id, CASE WHEN id % 4 = 0 THEN id % 256 END AS r, CASE WHEN id % 4 = 0 THEN id * 3 % 256 END AS g, CASE WHEN id % 4 = 0 THEN id * 7 % 256 END AS b, CASE WHEN id % 4 = 1 THEN id * 65793 % 16777216 END AS p, CASE WHEN id % 4 = 2 THEN id % 256 END AS i FROM ex)"


@query(f"WITH {A.EX}, {_C} SELECT id, " + ", ".join(f"round(coalesce({c} / 255.0::DOUBLE, ((p >> {s}) & 255) / 255.0::DOUBLE, i / 255.0::DOUBLE, 0.65::DOUBLE), 9) AS {n}" for n, c, s in (("red", "r", 16), ("green", "g", 8), ("blue", "b", 0))) + " FROM c")
def colours(spark, d):
    k = F.col("id")
    p = A.vec_points(spark, d).select("id", *[F.when(k % 4 == 0, k * m % 256).alias(c) for c, m in zip("rgb", (1, 3, 7), strict=True)], F.when(k % 4 == 1, k * 65793 % 16777216).alias("p"), F.when(k % 4 == 2, k % 256).alias("i"))
    return at.colours(p, ("r", "g", "b"), "p", "i").select("id", "red", "green", "blue").withColumns(_r("red green blue"))


@query(f"WITH {A.EX}, s AS (SELECT *, CASE WHEN (CASE WHEN abs(e3) >= abs(e4) AND abs(e3) >= abs(e5) THEN e3 WHEN abs(e4) >= abs(e5) THEN e4 ELSE e5 END) < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM ex) SELECT id, e3 * s AS e3, e4 * s AS e4, e5 * s AS e5 FROM s")
def oriented_normals(spark, d):
    return at.oriented(A.vec_parts(spark, d), ("e3", "e4", "e5")).select("id", "e3", "e4", "e5")


_ROT = [[0.6, -0.8, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, 1.0]]
_OFF = [0.05, -0.02, 0.01]
_MOVED = "m AS (SELECT id, " + ", ".join(" + ".join(f"{v!r}::DOUBLE * {a}" for v, a in zip(row, "xyz", strict=True)) + f" + {t!r}::DOUBLE AS {n}" for n, row, t in zip("xyz", _ROT, _OFF, strict=True)) + " FROM ep)"


@query(f"WITH {A.EP}, {_MOVED} SELECT id, {_rs('x=x; y=y; z=z')} FROM m WHERE x > -0.1::DOUBLE AND x < 0.15::DOUBLE AND y > -0.1::DOUBLE AND y < 0.15::DOUBLE AND z > -0.2::DOUBLE AND z < 0.2::DOUBLE")
def rigid_crop(spark, d):
    p = at.moved(A.vec_points(spark, d), _ROT, _OFF)
    return at.cropped(p, [-0.1, -0.1, -0.2], [0.15, 0.15, 0.2]).withColumns(_r("x y z"))


#: One turned box for each nation.
_OB = "ob AS (SELECT n_nationkey AS box, n_nationkey * 0.02::DOUBLE - 0.25::DOUBLE AS cx, 0.0::DOUBLE AS cy, 0.0::DOUBLE AS cz, cos(n_nationkey * 0.3::DOUBLE) AS c, sin(n_nationkey * 0.3::DOUBLE) AS s FROM nation)"
_OD = "greatest(abs(c * (x - cx) + s * (y - cy)) - 0.05::DOUBLE, 0.0::DOUBLE) AS dx, greatest(abs(-s * (x - cx) + c * (y - cy)) - 0.02::DOUBLE, 0.0::DOUBLE) AS dy, greatest(abs(z - cz) - 0.1::DOUBLE, 0.0::DOUBLE) AS dz"


@query(f"WITH {A.EP}, {_OB}, j AS (SELECT id, box, {_OD} FROM ep, ob) SELECT id, count(*) AS boxes, CAST(min(box) AS BIGINT) AS first FROM j WHERE sqrt(dx * dx + dy * dy + dz * dz) <= 0.01::DOUBLE GROUP BY id")
def oriented_boxes(spark, d):
    k = F.col("n_nationkey")
    turn = k * 0.3
    box = A.table(spark, d, "nation").select(k.cast("long").alias("box"), (k * 0.02 - 0.25).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("cz"), F.cos(turn).alias("c"), F.sin(turn).alias("s"))
    # Box and point meet in square cells that are wider than a box with its margin, so a box goes to 3 x 3 of them.
    size = 0.12
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    sent = box.withColumn("dx", step).withColumn("dy", step).withColumns({"kx": F.floor(F.col("cx") / size) + F.col("dx"), "ky": F.floor(F.col("cy") / size) + F.col("dy")}).drop("dx", "dy")
    p = A.vec_points(spark, d).withColumns({"kx": F.floor(F.col("x") / size), "ky": F.floor(F.col("y") / size)})
    c, s, o, z = F.col("c"), F.col("s"), F.lit(0.0), F.lit(1.0)
    inside = at.in_oriented_box([F.col("cx"), F.col("cy"), F.col("cz")], [[c, s, o], [-s, c, o], [o, o, z]], [F.lit(0.1), F.lit(0.04), F.lit(0.2)], 0.01)
    return p.join(sent, ["kx", "ky"]).filter(inside).groupBy("id").agg(F.count(F.lit(1)).alias("boxes"), F.min("box").alias("first"))


@query(f"WITH {A.EP} SELECT id FROM ep WHERE abs(0.6::DOUBLE * x + 0.8::DOUBLE * y + 0.0::DOUBLE * z + 0.01::DOUBLE) <= 0.03::DOUBLE")
def plane_residual(spark, d):
    return A.vec_points(spark, d).filter(at.on_plane([0.6, 0.8, 0.0], 0.01, 0.03)).select("id")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 = 0")
def stride_sample(spark, d):
    return at.every(A.vec_points(spark, d), 7).select("id")


@query("WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), k AS (SELECT DISTINCT i * (n - 1) // 63 AS id FROM n, (SELECT unnest(range(64)) AS i)) SELECT id FROM k")
def evenly_spaced(spark, d):
    return at.evenly(A.vec_points(spark, d), 64).select("id")


@query(f"WITH {A.EV}, v AS (SELECT event_id, value / 100 AS lin, event_id % 7 / 10.0::DOUBLE - 0.3::DOUBLE AS ang FROM ev) SELECT event_id, round((lin - ang * 0.4::DOUBLE / 2) / 0.1::DOUBLE, 9) AS leftward, round((lin + ang * 0.4::DOUBLE / 2) / 0.1::DOUBLE, 9) AS rightward FROM v")
def wheel_velocities(spark, d):
    left, right = at.wheel_velocities(F.col("value") / 100, F.col("event_id") % 7 / 10 - 0.3, 0.1, 0.4)
    return A.stream(spark, d).select("event_id", F.round(left, 9).alias("leftward"), F.round(right, 9).alias("rightward"))


_Q = "q AS (SELECT id, x, y, z, e6, e7, e8, e3 / l AS qx, e4 / l AS qy, e5 / l AS qz, label / l AS qw FROM (SELECT *, sqrt(e3 * e3 + e4 * e4 + e5 * e5 + label * label) AS l FROM ex) WHERE l > 0)"
_YAW = "atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))"
_TWO = repr(2 * math.pi)


def _poses(spark, d):
    p = A.vec_parts(spark, d)
    q = [F.col(c) for c in ("e3", "e4", "e5", "label")]
    p = p.withColumn("l", F.sqrt(at.dot(q, q))).filter("l > 0")
    return p.withColumns({n: F.col(c) / F.col("l") for n, c in zip(("qx", "qy", "qz", "qw"), ("e3", "e4", "e5", "label"), strict=True)})


@query(f"WITH {A.EX}, {_Q}, w AS (SELECT *, {_YAW} AS yaw FROM q), t AS (SELECT *, 3.0::DOUBLE - yaw + {math.pi!r}::DOUBLE AS a FROM w) SELECT id, round(yaw, 7) AS yaw, round(a - floor(a / {_TWO}::DOUBLE) * {_TWO}::DOUBLE - {math.pi!r}::DOUBLE, 7) AS turn, round(sqrt((x - 0.1::DOUBLE) * (x - 0.1::DOUBLE) + (y + 0.1::DOUBLE) * (y + 0.1::DOUBLE)), 9) AS far FROM t")
def yaw_angles(spark, d):
    p = _poses(spark, d).withColumn("yaw", at.yaw(*[F.col(c) for c in ("qx", "qy", "qz", "qw")]))
    away = [F.col("x") - 0.1, F.col("y") + 0.1]
    return p.select("id", F.round("yaw", 7).alias("yaw"), F.round(at.wrapped(3.0 - F.col("yaw")), 7).alias("turn"), F.round(F.sqrt(at.dot(away, away)), 9).alias("far"))


_P = "p AS (SELECT *, e6 * 20 AS r0, CASE WHEN e6 * 20 >= 0.5::DOUBLE AND e6 * 20 <= 4.0::DOUBLE THEN e6 * 20 END AS r FROM q), v AS (SELECT *, r * cos(e8) * cos(e7) AS a, r * cos(e8) * sin(e7) AS b, r * sin(e8) AS c FROM p), t AS (SELECT *, 2 * (qy * c - qz * b) AS tx, 2 * (qz * a - qx * c) AS ty, 2 * (qx * b - qy * a) AS tz FROM v)"


@query(f"WITH {A.EX}, {_Q}, {_P} SELECT id, r IS NOT NULL AS hit, {_rs('x=x + (a + qw * tx + (qy * tz - qz * ty)); y=y + (b + qw * ty + (qz * tx - qx * tz)); z=z + (c + qw * tz + (qx * ty - qy * tx))', 7)} FROM t")
def polar_points(spark, d):
    p = _poses(spark, d).withColumn("r", at.ranged(F.col("e6") * 20, 0.5, 4.0))
    hit = F.col("r") < math.inf
    q = [F.col(c) for c in ("qx", "qy", "qz", "qw")]
    v = at.rotated(at.polar(F.col("r"), F.col("e7"), F.col("e8")), *q)
    return p.select("id", hit.alias("hit"), *[F.when(hit, F.round(F.col(a) + c, 7)).alias(a) for a, c in zip("xyz", v, strict=True)])


@query(f"WITH {A.EV} SELECT event_id, greatest(least(value / 50 - 1, 0.4::DOUBLE), -0.4::DOUBLE) AS command FROM ev")
def clamped_commands(spark, d):
    return A.stream(spark, d).select("event_id", at.clamped(F.col("value") / 50 - 1, 0.4).alias("command"))


@query(f"WITH {A.EX}, u AS (SELECT id, z, e5 / sqrt(e3 * e3 + e4 * e4 + e5 * e5) AS up FROM ex) SELECT id, CASE WHEN abs(up) >= 0.85::DOUBLE AND z < 0 THEN 'ground' WHEN abs(up) >= 0.85::DOUBLE THEN 'roof' WHEN abs(up) <= 0.3::DOUBLE THEN 'wall' ELSE 'slope' END AS colour FROM u")
def surface_colours(spark, d):
    p = at.unit_normals(A.vec_parts(spark, d), ("e3", "e4", "e5"))
    return p.select("id", at.palette(F.col("z"), F.col("nz")).alias("colour"))


_CORRIDOR = "c AS (SELECT *, ((x + 0.2::DOUBLE) * 0.4::DOUBLE + (y + 0.1::DOUBLE) * 0.2::DOUBLE) / pow(sqrt(0.4::DOUBLE * 0.4::DOUBLE + 0.2::DOUBLE * 0.2::DOUBLE), 2) AS along, ((y + 0.1::DOUBLE) * 0.4::DOUBLE - (x + 0.2::DOUBLE) * 0.2::DOUBLE) / sqrt(0.4::DOUBLE * 0.4::DOUBLE + 0.2::DOUBLE * 0.2::DOUBLE) AS across FROM ep), w AS (SELECT *, greatest(least((0.02::DOUBLE + 0.05::DOUBLE - abs(across)) / 0.05::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) AS t FROM c), v AS (SELECT *, CASE WHEN along >= 0 AND along <= 1 THEN t * t * (3 - 2 * t) ELSE 0.0::DOUBLE END AS weight FROM w)"


@query(f"WITH {A.EP}, {_CORRIDOR} SELECT id, {_rs('along=along; across=across; weight=weight; z=z + weight * (-0.1::DOUBLE + 0.3::DOUBLE * along - z)', 8)} FROM v")
def corridor_repair(spark, d):
    p = at.corridor(A.vec_points(spark, d), (-0.2, -0.1), (0.2, 0.1), 0.02, 0.05)
    return at.repaired(p, -0.1, 0.2).select("id", "along", "across", "weight", "z").withColumns(_r("along across weight z", 8))


_G = [math.exp(-0.5 * k * k) for k in range(-2, 3)]
_GS = " + ".join(f"{w / sum(_G)!r}::DOUBLE * {v}" for w, v in zip(_G, ("coalesce(lag(value, 2) OVER w, first_value(value) OVER f)", "coalesce(lag(value, 1) OVER w, first_value(value) OVER f)", "value", "coalesce(lead(value, 1) OVER w, last_value(value) OVER f)", "coalesce(lead(value, 2) OVER w, last_value(value) OVER f)"), strict=True))


@query(f"WITH {A.EV} SELECT event_id, round({_GS}, 7) AS smooth FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id), f AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def smooth_profile(spark, d):
    return at.smoothed(A.stream(spark, d), A.by_user(), "value", 1.0, 2).select("event_id", F.round("smooth", 7).alias("smooth"))


@query(f"WITH {A.EV}, g AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS d FROM ev) SELECT user_id, count(*) AS n, coalesce(bool_and(d > 0), true) AS rising, coalesce(bool_and(d <= 86400000000), true) AS spaced FROM g GROUP BY user_id")
def spacing_checks(spark, d):
    return at.spacing(A.stream(spark, d), A.by_user(), "user_id", "us", 86_400_000_000)


@query(f"WITH {A.EP}, k AS (SELECT round(x, 1) + 0.0::DOUBLE AS x, round(y, 1) + 0.0::DOUBLE AS y, round(z, 1) + 0.0::DOUBLE AS z FROM ep) SELECT x, y, z, count(*) AS n FROM k GROUP BY ALL")
def exact_keys(spark, d):
    p = A.vec_points(spark, d).select(*[(F.round(a, 1) + 0.0).alias(a) for a in "xyz"])  # 0 and -0 are one key
    return p.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n"))


_EIG = """m AS (SELECT id % 7 AS label, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM ep GROUP BY 1),
e AS (SELECT *, (xx + yy + zz) / 3 AS q, xx - (xx + yy + zz) / 3 AS a, yy - (xx + yy + zz) / 3 AS b, zz - (xx + yy + zz) / 3 AS c FROM m),
p AS (SELECT *, sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p, a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz) AS det FROM e),
f AS (SELECT *, acos(greatest(least(det / (2 * p * p * p), 1.0::DOUBLE), -1.0::DOUBLE)) / 3 AS phi FROM p),
v AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM f)"""


@query(f"WITH {A.EP}, {_EIG} SELECT label, round(l1, 9) AS l1, round(3 * q - l1 - l3, 9) AS l2, round(l3, 9) AS l3, round(l3 / (3 * q - l1 - l3), 6) AS flat, round((3 * q - l1 - l3) / l1, 6) AS thin FROM v")
def component_shapes(spark, d):
    from ..operators import statistics

    p = A.vec_points(spark, d)
    m = statistics.component_moments(p, p.withColumn("label", F.col("id") % 7))
    big, mid, small = at.eigenvalues({k: F.col(f"c{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")})
    m = m.select("label", big.alias("l1"), mid.alias("l2"), small.alias("l3"))
    share = lambda a, b: F.round(F.when(F.col(b) <= 1e-24, 1.0).otherwise(F.col(a) / F.col(b)), 6)
    return m.select("label", *[F.round(c, 9).alias(c) for c in ("l1", "l2", "l3")], share("l3", "l2").alias("flat"), share("l2", "l1").alias("thin"))
