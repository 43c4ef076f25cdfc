"""Merged planes against numpy: what must become one, what must stay apart, and the quantile's bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import merging, regions
from voxelmill.sources import folders

MEMBERS, PLANES = "plane long, id long, x double, y double, z double", "plane long, nx double, ny double, nz double, offset double"


def fitted(p):
    n = np.linalg.svd(p - p.mean(0), full_matrices=False)[2][2]
    return n, -float(np.median(p @ n))


def pieces(seed=3):
    """A floor of 25 tiles, a wall of 4, a slab 0.3 above the floor's corner, a slope that meets the floor; tiles share a rim of rows."""
    r = np.random.default_rng(seed)
    floor = np.c_[r.uniform(0, 10, (2500, 2)), r.normal(0, 0.01, 2500)]
    wall = np.c_[r.uniform(0, 8, 500), np.full(500, 10.0) + r.normal(0, 0.01, 500), r.uniform(0, 3, 500)]
    slab = np.c_[r.uniform(0, 2, (200, 2)), r.normal(0.3, 0.01, 200)]
    slope = np.c_[xy := r.uniform((10, 0), (12, 2), (200, 2)), (xy[:, 0] - 10) * 0.2 + r.normal(0, 0.01, 200)]
    p, parts, of = np.concatenate([floor, wall, slab, slope]), {}, {}
    for i in range(5):
        for j in range(5):
            parts[i * 5 + j] = [k for k in range(2500) if 2 * i - 0.1 <= p[k, 0] < 2 * i + 2 and 2 * j <= p[k, 1] < 2 * j + 2]
            of[i * 5 + j] = "floor"
    for i in range(4):
        parts[100 + i], of[100 + i] = [k for k in range(2500, 3000) if 2 * i <= p[k, 0] < 2 * i + 2], "wall"
    parts[200], of[200], parts[300], of[300] = list(range(3000, 3200)), "slab", list(range(3200, 3400)), "slope"
    return p, parts, of


def tables(spark, p, parts):
    members = spark.createDataFrame([(k, i, *map(float, p[i])) for k, own in parts.items() for i in own], MEMBERS)
    planes = spark.createDataFrame([(k, *map(float, n), o) for k, own in parts.items() for n, o in [fitted(p[own])]], PLANES)
    return members, planes


def test_pieces_become_whole(spark):
    folders.shared(spark)
    p, parts, of = pieces()
    members, planes = tables(spark, p, parts)
    near = lambda a, b: np.linalg.norm(p[parts[a]].mean(0) - p[parts[b]].mean(0)) < 4
    pairs = [(a, b) for a in parts for b in parts if a < b and near(a, b)]
    links = spark.createDataFrame(pairs + pairs[:5] + [(b, a) for a, b in pairs[:5]] + [(3, 3), (3, 999)], "a long, b long")
    models, rows, names = merging.merged_planes(members.unionByName(members.limit(7)), planes, links)
    named = {q.plane: q.cluster for q in names.collect()}
    assert set(named) == set(parts)
    assert {frozenset(k for k in parts if named[k] == c) for c in set(named.values())} == {frozenset(k for k in parts if of[k] == w) for w in set(of.values())}
    held = {}
    for q in rows.collect():
        held.setdefault(q.cluster, []).append(q.id)
    for q in models.collect():
        own = sorted(i for i in held[q.cluster])
        whole = sorted({i for k in parts if named[k] == q.cluster for i in parts[k]})
        assert len(set(own)) == len(own) == q.n and set(own) <= set(whole) and len(own) > 0.95 * len(whole)
        n, _ = fitted(p[whole])
        assert abs(n @ [q.nx, q.ny, q.nz]) > 1 - 1e-4 and np.abs(p[own] @ [q.nx, q.ny, q.nz] + q.offset).max() <= 0.04
    shuffled = merging.merged_planes(members.repartition(5, "id"), planes.repartition(3), links)
    assert {q.plane: q.cluster for q in shuffled[2].collect()} == named


def test_nothing_linked_and_nothing_at_all(spark):
    folders.shared(spark)
    p, parts, _ = pieces()
    members, planes = tables(spark, p, {k: parts[k] for k in (0, 1, 200)})
    none = spark.createDataFrame([], "a long, b long")
    models, _, names = merging.merged_planes(members, planes, none)
    assert {(q.plane, q.cluster) for q in names.collect()} == {(0, 0), (1, 1), (200, 200)} and models.count() == 3
    assert [t.count() for t in merging.merged_planes(members.limit(0), planes, none)] == [0, 0, 0]


@pytest.mark.parametrize("m", (1, 2, 20, 21, 41, 100))
def test_quantile_bound(spark, m):
    """The bound by counts agrees with the interpolated quantile, also where it falls between two rows."""
    r = np.random.default_rng(m)
    sets = [np.sort(r.uniform(0, 1, m)) for _ in range(20)]
    tolerance = float(np.median([np.quantile(s, 0.95) for s in sets]))
    rows = spark.createDataFrame([(k, float(v)) for k, s in enumerate(sets) for v in s], "cluster long, off double")
    got = {q.cluster: q.good for q in merging._verdicts(rows, tolerance, 0.95).collect()}
    clear = {k: bool(np.quantile(s, 0.95) <= tolerance) for k, s in enumerate(sets) if abs(np.quantile(s, 0.95) - tolerance) > 1e-12}
    assert {k: got[k] for k in clear} == clear


def test_region_links(spark):
    planes = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (1, -1, 0), (2, 0, 0), (9, 9, 0)], "tx long, ty long, plane int")
    key = {(q.tx, q.ty, q.plane): q.k for q in planes.withColumn("k", merging.region_key()).collect()}
    got = {(q.a, q.b) for q in merging.region_links(planes).collect()}
    want = {tuple(sorted((key[s], key[t]))) for s, t in (((0, 0, 0), (0, 0, 1)), ((0, 0, 0), (1, -1, 0)), ((0, 0, 1), (1, -1, 0)), ((1, -1, 0), (2, 0, 0)))}
    assert got == want


def test_planes_of_regions(spark):
    """A floor cut into regions is one plane again, whatever the regions' own fits."""
    folders.shared(spark)
    r = np.random.default_rng(8)
    p = np.c_[xy := r.uniform(0, 6, (3000, 2)), 0.05 * xy[:, 0] + r.normal(0, 0.005, 3000)]
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    planes, members = regions.region_planes(points, 2.0, support=60, most=1, draws=40)
    own = members.withColumn("plane", merging.region_key()).join(points, "id")
    models, rows, _ = merging.merged_planes(own, planes.withColumn("plane", merging.region_key()), merging.region_links(planes))
    assert models.count() == 1 and rows.select(F.countDistinct("id")).first()[0] > 2900
