"""Queries of triangle meshes: shapes, edges, topology, chunks, gates, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import meshes
from . import adapters as A
from .columns import _r, _rs
from .registry import query

_CN = "cn AS (SELECT f.*, " + ", ".join(f"{c}.{a} AS {c}_{a}" for c in "abc" for a in "xyz") + " FROM fc f " + " ".join(f"JOIN ep {c} ON {c}.id = f.{c}" for c in "abc") + ")"
_U = {a: f"(b_{a} - a_{a})" for a in "xyz"}
_V = {a: f"(c_{a} - a_{a})" for a in "xyz"}
_NX = {"x": f"({_U['y']} * {_V['z']} - {_U['z']} * {_V['y']})", "y": f"({_U['z']} * {_V['x']} - {_U['x']} * {_V['z']})", "z": f"({_U['x']} * {_V['y']} - {_U['y']} * {_V['x']})"}
_SH = "sh AS (SELECT *, l / 2 AS area, " + ", ".join(f"k{a} / l AS n{a}, (a_{a} + b_{a} + c_{a}) / 3 AS m{a}" for a in "xyz") + ", (a_x * (b_y * c_z - b_z * c_y) + a_y * (b_z * c_x - b_x * c_z) + a_z * (b_x * c_y - b_y * c_x)) / 6 AS volume FROM (SELECT *, sqrt(kx * kx + ky * ky + kz * kz) AS l FROM (SELECT *, " + ", ".join(f"{_NX[a]} AS k{a}" for a in "xyz") + " FROM cn)))"
_MESH = f"WITH {A.EP}, {A.FC}, {_CN}, {_SH}"
_ED = "ed AS (SELECT owner, face, least(a, b) AS u, greatest(a, b) AS v FROM fc UNION ALL SELECT owner, face, least(b, c), greatest(b, c) FROM fc UNION ALL SELECT owner, face, least(c, a), greatest(c, a) FROM fc), mu AS (SELECT owner, u, v, count(*) AS n FROM ed GROUP BY ALL)"


def _cornered(spark, d):
    return meshes.corners(A.faces(spark, d), A.vec_points(spark, d))


@query(f"{_MESH} SELECT face, {_rs('area=area; nx=nx; ny=ny; nz=nz; mx=mx; my=my; mz=mz')} FROM sh")
def face_shapes(spark, d):
    return meshes.shapes(_cornered(spark, d)).select("face", "area", "nx", "ny", "nz", "mx", "my", "mz").withColumns(_r("area nx ny nz mx my mz"))


@query(f"{_MESH} SELECT owner, count(*) AS faces, round(sum(area), 7) AS area, round(sum(volume), 7) AS volume FROM sh GROUP BY owner")
def signed_volumes(spark, d):
    return meshes.solids(_cornered(spark, d)).withColumns(_r("area volume", 7))


@query(f"WITH {A.FC}, {_ED} SELECT owner, u, v FROM mu WHERE n = 1")
def boundary_edges(spark, d):
    return meshes.multiplicities(A.faces(spark, d)).filter("n = 1").drop("n")


@query(f"WITH {A.FC}, {_ED} SELECT owner, u, v, n FROM mu WHERE n > 2")
def tangled_edges(spark, d):
    return meshes.multiplicities(A.faces(spark, d)).filter("n > 2")


@query(f"WITH {A.FC}, {_ED}, x AS (SELECT owner, count(*) AS edges, count(*) FILTER (WHERE n = 1) AS boundary, count(*) FILTER (WHERE n > 2) AS tangled FROM mu GROUP BY owner), v AS (SELECT owner, count(DISTINCT v) AS vertices FROM (SELECT owner, unnest([a, b, c]) AS v FROM fc) GROUP BY owner), f AS (SELECT owner, count(*) AS faces FROM fc GROUP BY owner) SELECT owner, vertices, edges, faces, vertices - edges + faces AS euler, boundary, tangled FROM f JOIN x USING (owner) JOIN v USING (owner)")
def mesh_topology(spark, d):
    return meshes.topology(A.faces(spark, d))


@query(f"WITH {A.EP}, {A.FC}, {_ED} SELECT owner, round(max(abs(q.z - p.z)), 9) AS step, round(max(abs(q.z - p.z) / nullif(sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)), 0)), 6) AS slope FROM ed JOIN ep p ON p.id = u JOIN ep q ON q.id = v GROUP BY owner")
def edge_metrics(spark, d):
    return meshes.edge_metrics(A.faces(spark, d), A.vec_points(spark, d)).select("owner", F.round("step", 9).alias("step"), F.round("slope", 6).alias("slope"))


@query(f"WITH {A.EP}, s AS (SELECT CAST(round_even(x * 20, 0) AS BIGINT) AS kx, CAST(round_even(y * 20, 0) AS BIGINT) AS ky, count(*) AS n, max(z) - min(z) AS gap FROM ep GROUP BY ALL) SELECT kx, ky, n, round(gap, 9) AS gap FROM s WHERE n > 1")
def seam_metrics(spark, d):
    return meshes.seams(A.vec_points(spark, d), 20.0).withColumn("gap", F.round("gap", 9))


@query(f"WITH {A.EP}, c AS (SELECT id % 7 AS label, CAST(floor(x / 0.05::DOUBLE) AS BIGINT) AS ix, CAST(floor(y / 0.05::DOUBLE) AS BIGINT) AS iy, min(x) AS lx, max(x) AS ux, min(y) AS ly, max(y) AS uy FROM ep GROUP BY ALL), s AS (SELECT label, count(*) AS cells, min(lx) AS lx, max(ux) AS ux, min(ly) AS ly, max(uy) AS uy FROM c GROUP BY label) SELECT label, cells, round(cells * (0.05::DOUBLE * 0.05::DOUBLE), 9) AS area, round(cells * (0.05::DOUBLE * 0.05::DOUBLE) / ((ux - lx) * (uy - ly)), 7) AS coverage FROM s")
def footprint_coverage(spark, d):
    p = A.vec_points(spark, d).withColumn("label", F.col("id") % 7)
    return meshes.footprints(p, "label", 0.05).select("label", "cells", F.round("area", 9).alias("area"), F.round("coverage", 7).alias("coverage"))


_CH = "g AS (SELECT *, CAST(floor(mx / 0.2::DOUBLE) AS BIGINT) AS gx, CAST(floor(my / 0.2::DOUBLE) AS BIGINT) AS gy FROM sh), k AS (SELECT *, (row_number() OVER (PARTITION BY owner, gx, gy ORDER BY face) - 1) // 64 AS chunk FROM g)"


@query(f"{_MESH}, {_CH} SELECT owner, gx, gy, chunk, count(*) AS n, " + ", ".join(f"min(least(a_{a}, b_{a}, c_{a})) AS l{a}, max(greatest(a_{a}, b_{a}, c_{a})) AS u{a}" for a in "xyz") + " FROM k GROUP BY ALL")
def chunk_bounds(spark, d):
    return meshes.chunks(_cornered(spark, d), 0.2, 64)


@query(f"WITH {A.FC} SELECT v, count(DISTINCT owner) AS owners FROM (SELECT owner, unnest([a, b, c]) AS v FROM fc) GROUP BY v HAVING count(DISTINCT owner) > 1")
def shared_points(spark, d):
    return meshes.shared_vertices(A.faces(spark, d))


@query(f"WITH {A.FC}, f2 AS (SELECT face, (a + b) % 40 AS owner, a, b, c FROM fc), s AS (SELECT v FROM (SELECT owner, unnest([a, b, c]) AS v FROM f2) GROUP BY v HAVING count(DISTINCT owner) > 6) SELECT face FROM f2 WHERE a IN (SELECT v FROM s) OR b IN (SELECT v FROM s) OR c IN (SELECT v FROM s)")
def crowded_faces(spark, d):
    f = A.faces(spark, d).withColumn("owner", (F.col("a") + F.col("b")) % 40)
    v = f.select("face", F.explode(F.array("a", "b", "c")).alias("v"))
    return v.join(meshes.shared_vertices(f).filter("owners > 6"), "v", "left_semi").select("face").distinct()


@query(f"WITH {A.FC}, s AS (SELECT v FROM (SELECT owner, unnest([a, b, c]) AS v FROM fc) GROUP BY v HAVING count(DISTINCT owner) > 1) SELECT face, owner, a, b, c FROM fc WHERE a IN (SELECT v FROM s) OR b IN (SELECT v FROM s) OR c IN (SELECT v FROM s)")
def frozen_faces(spark, d):
    return meshes.frozen_faces(A.faces(spark, d)).select("face", "owner", "a", "b", "c")


@query(f"{_MESH} SELECT CAST(floor(mx / 0.1::DOUBLE) AS BIGINT) AS tx, CAST(floor(my / 0.1::DOUBLE) AS BIGINT) AS ty, count(*) AS faces, round(sum(area), 7) AS area FROM sh GROUP BY ALL")
def face_tiles(spark, d):
    return meshes.owned_faces(_cornered(spark, d), 0.1).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("faces"), F.round(F.sum("area"), 7).alias("area"))


_UN = "un AS (SELECT id, e3 / l AS nx, e4 / l AS ny, e5 / l AS nz FROM (SELECT *, sqrt(e3 * e3 + e4 * e4 + e5 * e5) AS l FROM ex))"
_DOT = lambda p, q: f"({' + '.join(f'{p}.n{a} * {q}.n{a}' for a in 'xyz')})"
_LEN = lambda p, q: "sqrt(" + " + ".join(f"({p}_{a} - {q}_{a}) * ({p}_{a} - {q}_{a})" for a in "xyz") + ")"


@query(f"{_MESH}, {A.EX}, {_UN}, g AS (SELECT s.face, s.owner, s.area, greatest({_LEN('a', 'b')}, {_LEN('b', 'c')}, {_LEN('c', 'a')}) AS side, least(abs({_DOT('s', 'p')}), abs({_DOT('s', 'q')}), abs({_DOT('s', 'r')})) AS facing, least({_DOT('p', 'q')}, {_DOT('q', 'r')}, {_DOT('r', 'p')}) AS pair FROM sh s JOIN un p ON p.id = s.a JOIN un q ON q.id = s.b JOIN un r ON r.id = s.c) SELECT face, owner, CASE WHEN area * 2 < 0.005::DOUBLE THEN 'area' WHEN side > 0.5::DOUBLE THEN 'edge' WHEN facing < 0.1::DOUBLE THEN 'facing' WHEN pair < -0.5::DOUBLE THEN 'pair' ELSE 'kept' END AS reason FROM g")
def support_gates(spark, d):
    from ..operators import attributes

    n = attributes.unit_normals(A.vec_parts(spark, d), ("e3", "e4", "e5")).select("id", "nx", "ny", "nz")
    return meshes.supported(_cornered(spark, d), n, 0.5, 0.1, -0.5, 0.005)


@query(f"WITH RECURSIVE {A.FC}, l AS (SELECT a AS s, b AS t FROM fc UNION SELECT b, a FROM fc UNION SELECT b, c FROM fc UNION SELECT c, b FROM fc), r(v, root) AS (SELECT DISTINCT s, s FROM l UNION SELECT l.t, r.root FROM r JOIN l ON l.s = r.v), k AS (SELECT v, min(root) AS root FROM r GROUP BY v), m AS (SELECT root, min(face) AS component FROM fc JOIN k ON v = a GROUP BY root) SELECT face, component FROM fc JOIN k ON v = a JOIN m USING (root)")
def mesh_components(spark, d):
    return meshes.face_components(A.faces(spark, d))


@query(f"WITH {A.FC}, {_ED}, x AS (SELECT owner, count(*) FILTER (WHERE n = 1) AS open, count(*) FILTER (WHERE n > 2) AS tangled FROM mu GROUP BY owner), f AS (SELECT owner, count(*) AS faces FROM fc GROUP BY owner) SELECT owner, faces, open, tangled, open = 0 AND tangled = 0 AS closed FROM f JOIN x USING (owner)")
def solid_audit(spark, d):
    from ..operators import audits

    return audits.solid_audit(A.faces(spark, d))


@query(f"WITH {A.EP}, b AS (SELECT id % 7 AS label, " + ", ".join(f"min({a}) AS l{a}, max({a}) AS u{a}" for a in "xyz") + " FROM ep WHERE id % 3 <> 0 AND id % 7 <> 6 GROUP BY 1) SELECT id % 7 AS label, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(" + " AND ".join(f"{a} >= l{a} AND {a} <= u{a}" for a in "xyz") + ", false)) AS outside FROM ep LEFT JOIN b ON b.label = id % 7 GROUP BY 1")
def bounds_audit(spark, d):
    from ..operators import audits

    p = A.vec_points(spark, d).withColumn("label", F.col("id") % 7)
    said = p.filter("id % 3 <> 0 AND label <> 6").groupBy("label").agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for f, n in ((F.min, "l"), (F.max, "u"))])
    return audits.bounds_audit(p, said, ["label"])


@query("WITH k AS (SELECT i, j, 0.01::DOUBLE * i AS z00, 0.01::DOUBLE * (i + 1) - 0.02::DOUBLE * (j % 2) AS z10, 0.01::DOUBLE * (i + 1) + 0.005::DOUBLE * j AS z11, 0.01::DOUBLE * i + 0.003::DOUBLE * j AS z01 FROM (SELECT unnest(range(-4, 5)) AS i), (SELECT unnest(range(-4, 5)) AS j)), b AS (SELECT n_nationkey AS box, n_nationkey % 7 - 4 AS lx, n_nationkey % 7 - 3 AS ux, n_nationkey % 5 - 2 AS ly, n_nationkey % 5 - 1 AS uy, 0.01::DOUBLE * (n_nationkey % 7 - 4) AS low, 0.01::DOUBLE * (n_nationkey % 7 - 2) AS high FROM nation), e AS (SELECT box, unnest(range(lx, ux + 1)) AS i, ly, uy, low, high FROM b), f AS (SELECT box, i, unnest(range(ly, uy + 1)) AS j, low, high FROM e) SELECT box, bool_and(coalesce(least(z00, z10, z11, z01) >= low - 0.015::DOUBLE AND greatest(z00, z10, z11, z01) <= high + 0.015::DOUBLE, false)) AS covered FROM f LEFT JOIN k USING (i, j) GROUP BY box")
def terrain_covers(spark, d):
    from ..operators import audits

    i = spark.range(-4, 5).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(-4).cast("long"), F.lit(4).cast("long"))).alias("j"))
    c, r, j = F.col("i"), F.col("i") + 1, F.col("j")
    corners = i.select("i", "j", (0.01 * c).alias("z00"), (0.01 * r - 0.02 * (j % 2)).alias("z10"), (0.01 * r + 0.005 * j).alias("z11"), (0.01 * c + 0.003 * j).alias("z01"))
    k = F.col("n_nationkey").cast("long")
    boxes = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("box"), (k % 7 - 4).alias("lx"), (k % 7 - 3).alias("ux"), (k % 5 - 2).alias("ly"), (k % 5 - 1).alias("uy"), (0.01 * (k % 7 - 4)).alias("low"), (0.01 * (k % 7 - 2)).alias("high"))
    return audits.covered_terrain(boxes, corners.select("i", "j"), corners, 0.015)
