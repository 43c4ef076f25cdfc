"""Queries of published filters and of maps judged as wholes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, cells, neighbours
from ..sources import folders, maps
from . import adapters as A
from .catalog_sql import KNN
from .registry import query

_SOR = f"{KNN}, m AS (SELECT id, avg(dist) AS m FROM n WHERE rank <= 12 GROUP BY id), s AS (SELECT avg(m) AS mean, stddev_samp(m) AS std FROM m), k AS (SELECT id, m, m <= mean + 2 * std AS keep FROM m, s)"


def _published(spark, d) -> str:
    p = A.vec_points(spark, d)
    path = folders.path(spark, "filter")
    maps.publish_filter(p, neighbours.statistical_outliers(neighbours.mean_distances(p, 12), 2.0), path, {"neighbors": 12, "ratio": 2.0}, 2.0)
    return path


@query(f"WITH {_SOR} SELECT id, x, y, z, keep, round(m, 9) AS mean_dist FROM k JOIN ep USING (id)")
def published_filter(spark, d):
    """What is read back: every record with its decision."""
    path = _published(spark, d)
    return spark.read.parquet(f"{path}/records").join(spark.read.parquet(f"{path}/decisions"), "id").withColumn("mean_dist", F.round("mean_dist", 9))


@query(f"WITH {_SOR}, c AS (SELECT CAST(floor(x * 10.0::DOUBLE) AS BIGINT) AS ix, CAST(floor(y * 10.0::DOUBLE) AS BIGINT) AS iy, CAST(floor(z * 10.0::DOUBLE) AS BIGINT) AS iz, count(*) AS n FROM ep JOIN k USING (id) WHERE keep GROUP BY 1, 2, 3), t AS (SELECT unnest([0, 2, 5, 10]) AS t) SELECT CASE WHEN t = 0 THEN 'filter' ELSE 'cells_' || t END AS name, CAST(sum(n) AS BIGINT) AS kept, CAST((SELECT count(*) FROM k WHERE keep) - sum(n) AS BIGINT) AS removed, count(*) AS cells, min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean, CAST(median(n) AS DOUBLE) AS middle FROM t JOIN c ON n > t GROUP BY t")
def published_cells(spark, d):
    """The populations that a published threshold report names."""
    out = folders.path(spark, "cells")
    report = maps.publish_thresholds(spark, _published(spark, d), out, 0.1, (2, 5, 10))
    rows = [(m["name"], m["kept"], m["removed"], m["cells"], m["least"], m["most"], m["mean"], m["middle"]) for m in report["modes"] if m["cells"]]
    return spark.createDataFrame(rows, "name string, kept long, removed long, cells long, least long, most long, mean double, middle double").withColumn("mean", F.round("mean", 9))


# A map with faults: rows that are missing, doubled, altered and in a wrong tile, a face in a wrong tile, one with a strange corner, figures
# that differ, bounds that are missing or too tight.
_TILE = lambda a: f"CAST(floor({a}::FLOAT::DOUBLE / 0.2::DOUBLE) AS BIGINT)"
_MAP = f"""tl AS (SELECT id, x, y, z + CASE WHEN id % 53 = 7 THEN 1 ELSE 0 END AS z, {_TILE('x')} + CASE WHEN id % 71 = 9 THEN 1 ELSE 0 END AS tx, {_TILE('y')} AS ty FROM ep, (SELECT unnest([0, 1]) AS again) WHERE id % 97 <> 5 AND (again = 0 OR id % 89 = 3)),
co AS (SELECT fc.face, fc.a, fc.b, fc.c, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS b_y, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM fc JOIN ep p ON p.id = a JOIN ep q ON q.id = b JOIN ep r ON r.id = c),
ow AS (SELECT CAST(floor((ax + bx + cx) / 3 / 0.2::DOUBLE) AS BIGINT) AS tx, CAST(floor((ay + b_y + cy) / 3 / 0.2::DOUBLE) AS BIGINT) AS ty, face, a, b, c FROM co),
fa AS (SELECT tx + CASE WHEN face % 301 = 2 THEN 1 ELSE 0 END AS tx, ty, face, a, CASE WHEN face % 401 = 4 THEN b + 1000000 ELSE b END AS b, c FROM ow),
us AS (SELECT DISTINCT tx, ty, id FROM (SELECT tx, ty, a AS id FROM fa UNION ALL SELECT tx, ty, b FROM fa UNION ALL SELECT tx, ty, c FROM fa)),
vx AS (SELECT tx, ty, us.id, x, y, z FROM us LEFT JOIN ep ON ep.id = us.id),
nr AS (SELECT tx, ty, count(*) AS records FROM tl GROUP BY tx, ty), nf AS (SELECT tx, ty, count(*) AS triangles FROM fa GROUP BY tx, ty),
re AS (SELECT tx, ty, records + CASE WHEN tx = 0 THEN 1 ELSE 0 END AS records, coalesce(triangles, 0) AS triangles FROM nr LEFT JOIN nf USING (tx, ty)),
bo AS (SELECT tx, ty, min(x) AS lx, max(x) AS ux, min(y) AS ly, max(y) AS uy, min(z) AS lz, max(z) - 0.0001::DOUBLE AS uz FROM vx GROUP BY tx, ty HAVING ty <> 0),
sd AS (SELECT id, count(*) AS n, min(z) AS lo, max(z) AS hi FROM tl GROUP BY id),
rp AS (SELECT coalesce(nr.tx, nf.tx, re.tx) AS tx, nr.records AS r0, nf.triangles AS t0, re.records AS r1, re.triangles AS t1 FROM nr FULL JOIN nf ON nf.tx = nr.tx AND nf.ty = nr.ty FULL JOIN re ON re.tx = coalesce(nr.tx, nf.tx) AND re.ty = coalesce(nr.ty, nf.ty))"""


@query(f"""WITH {A.EP}, {A.FC}, {_MAP}, u AS (SELECT (SELECT count(*) FROM tl) AS records, (SELECT count(*) FROM fa) AS triangles, (SELECT count(*) FROM us) AS mesh_vertices, (SELECT count(*) FROM nr) AS occupied_tiles,
(SELECT count(*) FROM ep ANTI JOIN sd USING (id)) AS missing, (SELECT count(*) FROM sd WHERE n > 1) AS doubled, (SELECT count(*) FROM ep JOIN sd USING (id) WHERE n = 1 AND lo <> z) AS altered, 0::BIGINT AS strange,
(SELECT count(*) FROM tl WHERE tx <> {_TILE('x')} OR ty <> {_TILE('y')}) AS misplaced,
(SELECT count(*) FROM fa WHERE b > 900000) AS strange_corners, (SELECT count(*) FROM fa JOIN ow USING (face) WHERE fa.b < 900000 AND fa.tx <> ow.tx) AS foreign,
(SELECT count(*) FROM rp WHERE r1 IS NULL OR coalesce(r0, 0) <> r1 OR coalesce(t0, 0) <> t1) AS wrong_reports, (SELECT count(*) FROM nf ANTI JOIN bo USING (tx, ty)) AS wrong_bounds,
(SELECT count(*) FROM vx JOIN bo USING (tx, ty) WHERE vx.z > uz) AS outside, 1::BIGINT AS wrong_totals) SELECT *, false AS passed FROM u""")
def map_audit(spark, d):
    p, size = A.vec_points(spark, d), 0.2
    k = F.col("id")
    again = F.explode(F.when(k % 89 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    tiles = cells.tiles(p, size).filter(k % 97 != 5).withColumn("__again", again).drop("__again")
    tiles = tiles.withColumn("tx", F.col("tx") + (k % 71 == 9).cast("long")).withColumn("z", F.col("z") + (k % 53 == 7).cast("int"))
    faces = audits.centred(A.faces(spark, d), p, size)
    f = F.col("face")
    faces = faces.withColumn("tx", F.col("tx") + (f % 301 == 2).cast("long")).withColumn("b", F.when(f % 401 == 4, F.col("b") + 1_000_000).otherwise(F.col("b")))
    per = faces.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("triangles"))
    reports = tiles.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("records")).join(per, ["tx", "ty"], "left").fillna(0, ["triangles"]).withColumn("records", F.col("records") + (F.col("tx") == 0).cast("long"))
    bounds = audits.surface_corners(faces, p).groupBy("tx", "ty").agg(*[g(a).alias(f"{n}{a}") for a in "xyz" for g, n in ((F.min, "l"), (F.max, "u"))]).filter("ty <> 0").withColumn("uz", F.col("uz") - 0.0001)
    summary = audits.map_totals(tiles, faces).withColumn("triangles", F.col("triangles") + 1)
    return audits.map_audit(p, tiles, faces, reports, bounds, summary, size)
