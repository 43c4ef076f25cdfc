"""Queries of shape: images, retuned outliers, islands, features, planes, claims, smoothing, curves, reachability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attributes, audits, choices, claims, graphs, joins, meshes, neighbours, shapes, statistics, windows
from . import adapters as A
from .catalog_sql import D2, KNN
from .columns import _half_up, _r, _rs
from .meshes import _ED
from .registry import query
from .windows import _PL


@query(f"WITH {A.LP} SELECT CAST(floor(x / 2.0::DOUBLE) AS BIGINT) AS px, CAST(floor(y / 2.0::DOUBLE) AS BIGINT) AS py, count(*) AS n FROM lp GROUP BY ALL")
def density_image(spark, d):
    return A.line_points(spark, d).groupBy(F.floor(F.col("x") / 2.0).alias("px"), F.floor(F.col("y") / 2.0).alias("py")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {KNN}, m AS (SELECT id, avg(dist) AS m FROM n WHERE rank <= 12 GROUP BY id), s AS (SELECT avg(m) AS mean, stddev_samp(m) AS std FROM m) SELECT id, m <= mean + 4 * std AS weak, m > mean + 1 * std AS candidate FROM m, s")
def sor_retune(spark, d):
    """Two ratios from one stored search."""
    stored = neighbours.mean_distances(A.vec_points(spark, d), 12)
    weak = neighbours.statistical_outliers(stored, 4.0).select("id", F.col("keep").alias("weak"))
    return weak.join(neighbours.statistical_outliers(stored, 1.0).select("id", (~F.col("keep")).alias("candidate")), "id")


_COMP = lambda r, n: f"e{n} AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM ep a JOIN ep b ON a.id <> b.id WHERE {D2} <= {r * r!r}::DOUBLE), r{n}(id, root) AS (SELECT id, id FROM ep UNION SELECT e.b, r.root FROM r{n} r JOIN e{n} e ON e.a = r.id), c{n} AS (SELECT id, min(root) AS label FROM r{n} GROUP BY id)"


@query(f"WITH RECURSIVE {A.EP}, {_COMP(0.04, 1)}, {_COMP(0.06, 2)}, {_COMP(0.08, 3)} SELECT id, 0.04::DOUBLE AS radius, label FROM c1 UNION ALL SELECT id, 0.06::DOUBLE, label FROM c2 UNION ALL SELECT id, 0.08::DOUBLE, label FROM c3")
def components_nested(spark, d):
    return neighbours.nested_components(A.vec_points(spark, d), (0.04, 0.06, 0.08))


_ISL = """o AS (SELECT ep.*, c1.label, c2.label AS parent, ep.id % 50 = 0 AS held FROM ep JOIN c1 USING (id) JOIN c2 ON c2.id = ep.id),
m AS (SELECT label, any_value(parent) AS parent, count(*) AS n, bool_or(held) AS held, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM o GROUP BY label),
p AS (SELECT parent, bool_or(held) AS above, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) AS wide FROM o GROUP BY parent),
b AS (SELECT o.* FROM o JOIN m USING (label) WHERE m.held), f AS (SELECT DISTINCT a.label FROM o a JOIN m USING (label), b WHERE NOT m.held AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < 0.05::DOUBLE),
q1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM m), q2 AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS r FROM q1),
q3 AS (SELECT *, CASE WHEN r = 0 THEN 0 ELSE acos(greatest(least(((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * r * r * r), 1.0::DOUBLE), -1.0::DOUBLE)) / 3 END AS a FROM q2),
q4 AS (SELECT label, q, q + 2 * r * cos(a) AS big, q + 2 * r * cos(a + 2 * pi() / 3) AS small FROM q3), q5 AS (SELECT label, big, 3 * q - big - small AS mid, small FROM q4),
sh AS (SELECT label, CASE WHEN mid <= 1e-24 THEN 1.0::DOUBLE ELSE small / mid END AS flat, CASE WHEN big <= 1e-24 THEN 1.0::DOUBLE ELSE mid / big END AS thin FROM q5)"""


@query(f"WITH RECURSIVE {A.EP}, {_COMP(0.04, 1)}, {_COMP(0.07, 2)}, {_ISL} SELECT m.label, m.n, CASE WHEN m.held THEN 0 WHEN p.above OR p.wide > 0.2::DOUBLE OR f.label IS NOT NULL OR (m.n >= 12 AND sh.flat <= 0.04::DOUBLE AND sh.thin > 0.04::DOUBLE) OR (m.n >= 6 AND sh.thin <= 0.04::DOUBLE) THEN 2 ELSE 1 END AS class FROM m JOIN sh USING (label) JOIN p USING (parent) LEFT JOIN f ON f.label = m.label")
def island_classes(spark, d):
    p = A.vec_points(spark, d)
    return shapes.island_classes(p, p.filter("id % 50 = 0"), (0.04, 0.07), 0.2, 0.05)


@query()
def edge_features(spark, d):
    out = shapes.edge_flags(shapes.edge_features(A.vec_points(spark, d), 24, 0.15, 8, 0.2), 100.0, 35.0)
    return out.withColumns({"variation": F.round("variation", 6), "gap": F.round("gap", 4), "crease": F.round("crease", 4)})


_CF = f"""n AS (SELECT a.id, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z FROM ep a JOIN ep b ON {D2} <= 0.12::DOUBLE * 0.12::DOUBLE),
m AS (SELECT id, count(*) - 1 AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM n GROUP BY id HAVING count(*) > 6),
e AS (SELECT *, (xx + yy + zz) / 3 AS q, xx - (xx + yy + zz) / 3 AS a, yy - (xx + yy + zz) / 3 AS b, zz - (xx + yy + zz) / 3 AS c FROM m),
p AS (SELECT *, sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p, a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz) AS det FROM e),
f AS (SELECT *, acos(greatest(least(det / (2 * p * p * p), 1.0::DOUBLE), -1.0::DOUBLE)) / 3 AS phi FROM p),
v AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM f), w AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM v)"""


@query(f"WITH {A.EP}, {_CF} SELECT id, n, {_rs('shift=sqrt(mx * mx + my * my + mz * mz) / 0.12::DOUBLE; linearity=(l1 - l2) / l1; planarity=(l2 - l3) / l1; scattering=l3 / l1; variation=l3 / (l1 + l2 + l3)', 5)} FROM w")
def contour_features(spark, d):
    return shapes.contour_features(A.vec_points(spark, d), 0.12).withColumns(_r("shift linearity planarity scattering variation", 5))


@query()
def plane_fits(spark, d):
    p = A.vec_points(spark, d).withColumn("label", F.col("id") % 7)
    return shapes.planes(p, "label").withColumns(_r("nx ny nz offset", 6))


@query()
def geometric_votes(spark, d):
    """The whole chain: a weak filter, candidates beyond one deviation, and what the shape around them rejects."""
    p = A.vec_points(spark, d)
    stored = neighbours.mean_distances(p, 12)
    weak = neighbours.statistical_outliers(stored, 4.0)
    candidates = neighbours.statistical_outliers(stored, 1.0).filter("not keep").select("id")
    votes = shapes.geometric_outliers(p, weak, ((12, 0.2), (24, 0.3), (32, 0.4)), candidates=candidates)
    out = weak.join(votes, "id", "left").join(candidates.withColumn("candidate", F.lit(True)), "id", "left")
    rejected = F.coalesce(F.col("candidate") & F.col("rejected"), F.lit(False))
    return out.select("id", F.col("keep").alias("sor_keep"), F.coalesce("supported", F.lit(0)).alias("supported"), F.coalesce("consistent", F.lit(0)).alias("consistent"), (F.col("keep") & ~rejected).alias("keep"))


_PB = "pb AS (SELECT id AS plane, x, y, z, e3 / l AS nx, e4 / l AS ny, e5 / l AS nz FROM (SELECT *, sqrt(e3 * e3 + e4 * e4 + e5 * e5) AS l FROM ex)), po AS (SELECT *, -(nx * x + ny * y + nz * z) AS off FROM pb)"


def _planes(spark, d):
    p = attributes.unit_normals(A.vec_parts(spark, d), ("e3", "e4", "e5")).withColumnRenamed("id", "plane")
    return p.withColumn("offset", -(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z")))


@query(f"WITH {A.EX}, {_PB}, g AS (SELECT a.plane AS a, b.plane AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS gap, degrees(acos(least(abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz), 1.0::DOUBLE))) AS angle FROM po a JOIN po b ON a.plane < b.plane) SELECT a, b, round((gap / 0.1::DOUBLE * (gap / 0.1::DOUBLE) + angle / 10.0::DOUBLE * (angle / 10.0::DOUBLE)) / 2, 5) AS cost FROM g WHERE gap <= 0.3::DOUBLE AND angle <= 40")
def link_costs(spark, d):
    pairs = joins.plane_pairs(_planes(spark, d), 0.0, 40.0, 0.3).withColumnRenamed("degrees", "angle")
    costs = pairs.select("a", "b", shapes.link_costs(pairs, {"gap": 0.1, "angle": 10.0}).alias("cost"))
    return costs.withColumn("cost", _half_up("cost", 5))


@query(f"WITH {A.EX}, {_PB} SELECT id, min(plane) AS plane FROM ex p, po WHERE abs(p.x * nx + p.y * ny + p.z * nz + off) <= 0.01::DOUBLE GROUP BY id")
def first_claims(spark, d):
    return shapes.first_claims(A.vec_points(spark, d), _planes(spark, d), 0.01)


@query(f"WITH {A.EP}, c AS (SELECT *, count(*) OVER (PARTITION BY floor(x / 0.1::DOUBLE), floor(y / 0.1::DOUBLE), floor(z / 0.1::DOUBLE)) AS n FROM ep) SELECT id, CASE WHEN x > 0.1::DOUBLE THEN 2 WHEN z < -0.05::DOUBLE THEN 1 WHEN id % 11 = 0 THEN 5 WHEN abs(0.6::DOUBLE * x + 0.8::DOUBLE * y + 0.0::DOUBLE * z + 0.0::DOUBLE) <= 0.02::DOUBLE THEN 4 WHEN n >= 3 THEN 3 ELSE 0 END AS label FROM c")
def partition_labels(spark, d):
    p = A.vec_points(spark, d)
    cell = [F.floor(F.col(a) / 0.1).alias(f"i{a}") for a in "xyz"]
    at = p.select("id", *cell)
    crowded = at.join(at.groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3"), ["ix", "iy", "iz"])
    claims = [(2, p.filter("x > 0.1")), (1, p.filter("z < -0.05")), (5, p.filter("id % 11 = 0")), (4, p.filter(attributes.on_plane([0.6, 0.8, 0.0], 0.0, 0.02))), (3, crowded)]
    return shapes.priority_labels(p, claims).select("id", "label")


@query("SELECT CASE WHEN event_type = 'purchase' THEN 'noise' WHEN value > 60 THEN 'planar' WHEN value > 30 THEN 'obstacle' WHEN user_id % 2 = 0 THEN 'ground' ELSE 'residual' END AS reason, count(*) AS faces FROM events GROUP BY 1")
def face_reasons(spark, d):
    """One reason a face: later rules override earlier ones, noise last, so they stand in falling order here."""
    reason = F.when(F.col("event_type") == "purchase", "noise").when(F.col("value") > 60, "planar").when(F.col("value") > 30, "obstacle").when(F.col("user_id") % 2 == 0, "ground").otherwise("residual")
    return A.table(spark, d, "events").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("faces"))


@query(f"WITH {A.EX} SELECT label, round(sum(greatest(least(1 - pow(abs(e6) / 0.3::DOUBLE, 2) - pow(abs(e7) / 0.2::DOUBLE, 2), 1.0::DOUBLE), 0.0::DOUBLE)), 6) AS gain FROM ex GROUP BY label")
def patch_gain(spark, d):
    gain = F.greatest(F.least(1 - F.pow(F.abs("e6") / 0.3, 2) - F.pow(F.abs("e7") / 0.2, 2), F.lit(1.0)), F.lit(0.0))
    return A.vec_parts(spark, d).groupBy("label").agg(F.round(F.sum(gain), 6).alias("gain"))


_NB = "nb AS (SELECT DISTINCT u AS id, v AS oid FROM ed WHERE owner = 1 UNION SELECT DISTINCT v, u FROM ed WHERE owner = 1)"
_STEP = lambda src, rate: f"(SELECT p.id, " + ", ".join(f"coalesce(p.{a} + {rate!r}::DOUBLE * (m.{a} - p.{a}), p.{a}) AS {a}" for a in "xyz") + f" FROM {src} p LEFT JOIN (SELECT nb.id, avg(q.x) AS x, avg(q.y) AS y, avg(q.z) AS z FROM nb JOIN {src} q ON q.id = nb.oid WHERE nb.id % 10 <> 0 GROUP BY nb.id) m ON m.id = p.id)"  # noqa: E731, F541


@query(f"WITH {A.EP}, {A.FC}, {_ED}, {_NB}, s0 AS (SELECT * FROM ep WHERE id < 97), s1 AS MATERIALIZED {_STEP('s0', 0.5)}, s2 AS MATERIALIZED {_STEP('s1', -0.53)}, s3 AS MATERIALIZED {_STEP('s2', 0.5)}, s4 AS {_STEP('s3', -0.53)} SELECT id, {_rs('x=x; y=y; z=z', 7)} FROM s4")
def smooth_surface(spark, d):
    p = A.vec_points(spark, d).filter("id < 97")
    e = meshes.edges(A.faces(spark, d)).filter("owner = 1").select("u", "v").distinct()
    return shapes.smoothed(p, e, p.filter("id % 10 = 0"), 2).withColumns(_r("x y z", 7))


@query(f"WITH {A.EP}, l AS (SELECT id // 6 AS loop, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM ep WINDOW w AS (PARTITION BY id // 6 ORDER BY id)) SELECT loop, count(*) AS n, round(sum((x * ny - nx * y) / 2), 9) AS area FROM l GROUP BY loop")
def loop_areas(spark, d):
    p = A.vec_points(spark, d).withColumn("loop", F.floor(F.col("id") / 6))
    return shapes.loop_areas(p, "loop", "id").withColumn("area", F.round("area", 9))


_CS = f"""q AS (SELECT line, k, {', '.join(f'{a} + least((k * step - s) / d, 1.0::DOUBLE) * (b_{a} - {a}) AS {a}' for a in 'xyz')}, CASE WHEN k = 0 OR k = n THEN step / 2 ELSE step END AS weight FROM j WHERE r = 1),
f AS (SELECT q.line, q.k, any_value(q.weight) AS weight, coalesce(min(sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z))) FILTER (WHERE sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)) <= 0.15::DOUBLE), 0.15::DOUBLE) AS dist FROM q, (SELECT * FROM ep WHERE id % 2 = 1) p GROUP BY q.line, q.k),
g AS (SELECT *, sum((dist <= 0.08::DOUBLE)::INT) OVER (PARTITION BY line ORDER BY k ROWS UNBOUNDED PRECEDING) AS run, sum(weight) OVER (PARTITION BY line) AS total FROM f),
h AS (SELECT line, run, sum(CASE WHEN dist <= 0.08::DOUBLE THEN 0.0::DOUBLE ELSE weight END) AS w FROM g GROUP BY ALL),
jw AS (SELECT line, dist, sum(weight) OVER (PARTITION BY line ORDER BY dist RANGE UNBOUNDED PRECEDING) AS upto, sum(weight) OVER (PARTITION BY line) AS whole FROM f)"""


@query(f"WITH {A.EP}, {_PL}, {_CS} SELECT f.line, count(*) AS samples, round(sum(CASE WHEN dist <= 0.08::DOUBLE THEN weight ELSE 0.0::DOUBLE END) / sum(weight), 6) AS supported, round((SELECT min(jw.dist) FROM jw WHERE jw.line = f.line AND jw.upto >= 0.95::DOUBLE * jw.whole), 6) AS p95, round((SELECT max(w) FROM h WHERE h.line = f.line), 6) AS longest FROM f GROUP BY f.line")
def curve_support(spark, d):
    p = A.vec_points(spark, d)
    samples = windows.resampled(p.withColumns({"line": F.floor(F.col("id") / 5), "o": F.col("id") % 5}), "line", "o", 0.05)
    out = shapes.curve_support(samples, p.filter("id % 2 = 1").withColumnRenamed("id", "oid"), "line", 0.15, 0.08)
    return out.select("line", "samples", F.round("supported", 6).alias("supported"), F.round("p95", 6).alias("p95"), F.round("longest", 6).alias("longest"))


@query(f"WITH RECURSIVE {A.FC}, e AS (SELECT a AS src, b AS dst FROM fc UNION SELECT b, c FROM fc), r(node) AS (SELECT 0::BIGINT UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def reached_nodes(spark, d):
    f = A.faces(spark, d)
    e = f.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(f.select("b", "c")).distinct()
    return graphs.reached(spark.range(1).withColumnRenamed("id", "node"), e).select("node")


_IVQ = "iv AS (SELECT event_id AS id, event_type AS kind, us AS low, us + CAST(floor(value) AS BIGINT) * 60000000 AS high FROM ev), mt AS (SELECT a.kind, a.id AS a, greatest(a.low, b.low) AS low, least(a.high, b.high) AS high FROM iv a JOIN iv b ON a.kind = b.kind AND a.id % 2 = 0 AND b.id % 2 = 1 AND greatest(a.low, b.low) < least(a.high, b.high)), g AS (SELECT *, CASE WHEN low > max(high) OVER (PARTITION BY kind, a ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM mt), u AS (SELECT *, sum(f) OVER (PARTITION BY kind, a ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS run FROM g), x AS (SELECT kind, a, max(high) - min(low) AS len FROM u GROUP BY kind, a, run)"


@query(f"WITH {A.EV}, {_IVQ} SELECT t.kind, t.total, coalesce(m.matched, 0)::BIGINT AS matched, round(m.matched / nullif(t.total, 0), 9) AS precision FROM (SELECT kind, CAST(sum(high - low) AS BIGINT) AS total FROM iv WHERE id % 2 = 0 GROUP BY kind) t LEFT JOIN (SELECT kind, CAST(sum(len) AS BIGINT) AS matched FROM x GROUP BY kind) m USING (kind)")
def edge_quality(spark, d):
    """Length of the predicted intervals of a kind that some reference covers, each part once."""
    e = A.stream(spark, d).select("event_id", F.col("event_type").alias("kind"), F.col("us").alias("low"), (F.col("us") + F.floor("value") * 60_000_000).alias("high"))
    left, right = (e.filter(f"event_id % 2 = {k}").withColumnRenamed("event_id", n) for k, n in ((0, "a"), (1, "b")))
    matched = joins.covered(left, right, ["kind"], 3_600_000_000.0).groupBy("kind").agg(F.sum(F.col("high") - F.col("low")).alias("matched"))
    total = left.groupBy("kind").agg(F.sum(F.col("high") - F.col("low")).alias("total"))
    return total.join(matched, "kind", "left").select("kind", "total", F.coalesce("matched", F.lit(0)).alias("matched"), F.round(statistics.ratio(F.col("matched"), F.col("total")), 9).alias("precision"))


@query(f"WITH {A.LP}, c AS (SELECT DISTINCT CAST(floor(x * 0.5::DOUBLE) AS BIGINT) AS ix, CAST(floor(y * 0.5::DOUBLE) AS BIGINT) AS iy, CAST(floor(z * 0.5::DOUBLE) AS BIGINT) AS iz FROM lp), f AS (SELECT ix, iy, iz, axis, side, CASE WHEN axis = 0 THEN side ELSE 0 END AS dx, CASE WHEN axis = 1 THEN side ELSE 0 END AS dy, CASE WHEN axis = 2 THEN side ELSE 0 END AS dz FROM c, (SELECT unnest([0, 1, 2])::INTEGER AS axis), (SELECT unnest([-1, 1])::INTEGER AS side)) SELECT axis, side, count(*) AS quads, round(sum(x0), 4) AS x0, round(sum(z1), 4) AS z1 FROM (SELECT f.*, (f.ix + CASE WHEN axis = 0 AND side > 0 THEN 1 ELSE 0 END) * 2.0::DOUBLE AS x0, (f.iz + CASE WHEN axis <> 2 THEN 1 WHEN side > 0 THEN 1 ELSE 0 END) * 2.0::DOUBLE AS z1 FROM f ANTI JOIN c ON c.ix = f.ix + dx AND c.iy = f.iy + dy AND c.iz = f.iz + dz) GROUP BY axis, side")
def voxel_quads(spark, d):
    from ..operators import cells

    q = shapes.voxel_quads(cells.counts(A.line_points(spark, d), 2.0), 2.0)
    return q.groupBy("axis", "side").agg(F.count(F.lit(1)).alias("quads"), F.round(F.sum("x0"), 4).alias("x0"), F.round(F.sum("z1"), 4).alias("z1"))


_DIFF = "r AS (SELECT kind, a, min(low) AS cl, max(high) AS ch FROM u GROUP BY kind, a, run), l AS (SELECT kind, id AS a, low, high FROM iv WHERE id % 2 = 0), h AS (SELECT l.*, cl, ch, coalesce(lag(ch) OVER w, low) AS prev, lead(cl) OVER w IS NULL AS last FROM l LEFT JOIN r USING (kind, a) WINDOW w AS (PARTITION BY l.kind, l.a ORDER BY cl)), p AS (SELECT kind, a, prev AS low, coalesce(cl, high) AS high FROM h UNION ALL SELECT kind, a, coalesce(ch, high), high FROM h WHERE last)"


@query(f"WITH {A.EV}, {_IVQ}, {_DIFF} SELECT kind, a, low, high FROM p WHERE low < high")
def interval_difference(spark, d):
    e = A.stream(spark, d).select("event_id", F.col("event_type").alias("kind"), F.col("us").alias("low"), (F.col("us") + F.floor("value") * 60_000_000).alias("high"))
    left, right = (e.filter(f"event_id % 2 = {k}").withColumnRenamed("event_id", n) for k, n in ((0, "a"), (1, "b")))
    return choices.interval_difference(left, right, ["kind"], 3_600_000_000.0)


@query("WITH q AS (SELECT vec_id AS id, vec_id % 5 <> 0 AS sor_keep, vec_id % 3 = 0 AS rejected FROM embeddings) SELECT CASE WHEN sor_keep AND NOT rejected THEN 'kept' WHEN sor_keep THEN 'geometry' ELSE 'distance' END AS class, count(*) AS n FROM q GROUP BY 1")
def class_view(spark, d):
    p = A.vec_points(spark, d).select("id", (F.col("id") % 5 != 0).alias("sor_keep"), (F.col("id") % 3 == 0).alias("rejected"))
    return audits.class_view(p.withColumn("keep", F.col("sor_keep") & ~F.col("rejected"))).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query()
def unsuppressed(spark, d):
    """Points in order of falling x; one stays unless a kept one lies within reach."""
    return claims.unsuppressed_within(A.vec_points(spark, d).withColumn("order", -F.col("x")), "order", 0.1)


@query()
def region_planes(spark, d):
    return choices.planes_by_region(A.vec_points(spark, d), 0.2, 0.02, 2, 12).withColumns(_r("nx ny nz offset", 6))


@query()
def ground_rows(spark, d):
    p = A.vec_points(spark, d)
    return choices.ground_cells(p, windows.relative_heights(p, 0.1), -0.05, 0.15, 0.03, 0.06)


@query()
def crown_owners(spark, d):
    p = A.vec_points(spark, d)
    return choices.crowns(p, windows.relative_heights(p, 0.1), 0.05, 0.05, 0.15).withColumn("dist", F.round("dist", 9))


@query()
def simplified_loops(spark, d):
    p = A.vec_points(spark, d).withColumn("loop", F.floor(F.col("id") / 12))
    return choices.simplified(p, "loop", "id", 0.05).select("loop", "id")


@query()
def plane_groups(spark, d):
    """Groups of cells' points, joined in order of the angle between their planes."""
    p = A.vec_points(spark, d).withColumn("label", F.col("id") % 40)
    m = statistics.component_moments(p.drop("label"), p.select("id", "label")).withColumnsRenamed({"label": "plane", **{f"mean_{a}": f"m{a}" for a in "xyz"}})
    pairs = joins.plane_pairs(shapes.planes(p, "label").withColumnRenamed("label", "plane"), 0.0).filter("degrees <= 20")
    return choices.joined_planes(m, pairs.withColumnRenamed("degrees", "cost"), 0.11)
