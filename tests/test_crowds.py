"""What rows get from crowded neighbourhoods, without rows of pairs, against plain versions."""

import itertools
import math

import numpy as np
import pytest

from voxelmill.operators import crowds, edges, meshes, motion, neighbours, shapes

SEGMENT = "id long, kind long, ax double, ay double, az double, bx double, by double, bz double"


def crowd(spark, seed=1, n=400):
    """Points of which some share a place and some have a neighbour exactly at 0.25."""
    r = np.random.default_rng(seed)
    at = np.round(r.normal(0, 0.2, (n, 3)) * 16) / 16
    at[: n // 2] = r.normal(0, 0.2, (n // 2, 3))
    at[-1] = 9.0
    return at, spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, x double, y double, z double")


def near(at, radius):
    d2 = ((at[:, None] - at[None]) ** 2) @ np.ones(3)
    on = d2 <= radius * radius
    np.fill_diagonal(on, False)
    return d2, on


def segments(spark, rows):
    return spark.createDataFrame([(i, 1, *map(float, np.ravel(s))) for i, s in enumerate(rows)], SEGMENT)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_crowded_edges_meet_as_arrays(spark):
    """200 near-parallel lines in one cell, in blocks of any size: no row for a candidate, the same stretches."""
    r = np.random.default_rng(3)
    a = r.uniform(0, 0.3, (200, 3))
    rows = np.stack([a, a + [0.4, 0, 0] + r.normal(0, 0.03, (200, 3))], 1)
    p, q = edges.measured(segments(spark, rows)), edges.measured(segments(spark, rows[:60]))
    whole = edges.matches(p, q, 0.05, 10.0, 1.0)
    assert "FlatMapCoGroupsInArrow" in plan(whole)
    got = {(m.id, m.oid): (m.low, m.high, m.olow, m.ohigh) for m in whole.collect()}
    assert got == {(m.id, m.oid): (m.low, m.high, m.olow, m.ohigh) for m in edges.matches(p, q, 0.05, 10.0, 1.0, block=13).collect()}
    t = np.linspace(0, 1, 2001)
    for i, j in itertools.product(range(0, 200, 9), range(0, 60, 7)):
        (b, c), (d, e) = rows[i], rows[j]
        u, v = (c - b) / np.linalg.norm(c - b), (e - d) / np.linalg.norm(e - d)
        at = b + t[:, None] * (c - b) - d
        along = at @ v
        on = (along >= 0) & (along <= np.linalg.norm(e - d)) & (np.linalg.norm(at - along[:, None] * v, axis=1) <= 0.05) & (abs(u @ v) >= math.cos(math.radians(10)))
        length = got[i, j][1] - got[i, j][0] if (i, j) in got else 0.0
        assert abs(on.mean() * np.linalg.norm(c - b) - length) < 1e-3


@pytest.mark.parametrize("block", [7, 2048])
def test_lengths_of_a_crowd(spark, block):
    """Unions of blocks are those of all matches."""
    r = np.random.default_rng(4)
    a = r.uniform(0, 0.3, (90, 3))
    rows = np.stack([a, a + [0.4, 0, 0] + r.normal(0, 0.02, (90, 3))], 1)
    p, q = edges.measured(segments(spark, rows)), edges.measured(segments(spark, rows[:40]))
    met = edges.matches(p, q, 0.05, 10.0, 0.25)
    parts = edges._lengths(p, q, 0.05, 10.0, 0.25, block)
    for key, low, high in (("id", "low", "high"), ("oid", "olow", "ohigh")):
        want = {w[key]: w.covered for w in edges._covered(met.selectExpr("kind", key, f"{low} as low", f"{high} as high"), ["kind", key]).collect()}
        got = {g[key]: g.covered for g in edges._covered(parts.filter(f"{key} is not null"), ["kind", key]).collect()}
        assert want.keys() == got.keys() and all(math.isclose(want[k], got[k], abs_tol=1e-12) for k in want)
    assert {(w.oid, w["count"]) for w in met.groupBy("oid").count().collect()} == {(g.oid, g.n) for g in parts.filter("oid is not null").groupBy("oid").agg({"n": "sum"}).toDF("oid", "n").collect()}


def test_own_intervals_meet_by_direction(spark):
    """Crossing lines in one place don't meet; coinciding ones do, either way round, the shortest too."""
    r = np.random.default_rng(5)
    rows = [np.array([m - d, m + d]) for m, d in ((r.normal(0, 0.01, 3), r.normal(0, 0.3, 3)) for _ in range(60))]
    for i in range(10):
        s, e = rows[i]
        rows += [np.array([s + 0.8 * (e - s), s + 0.3 * (e - s)]), np.array([s + 0.9 * (e - s), s + (0.9 + 1e-7) * (e - s)])]
    p = edges.measured(segments(spark, rows))
    mine, other, ways = edges._directed(p, 1e-9)
    assert edges._pairs(mine, other, 1e-9, 1.0, ways).filter("o_id < id").count() < 60 + 20 * 80
    got = {(q.id): q.high - q.low for q in edges.own_intervals(p).collect()}
    assert set(got) == set(range(60)) and all(math.isclose(got[i], np.linalg.norm(rows[i][1] - rows[i][0]), abs_tol=1e-12) for i in got)


@pytest.mark.parametrize("block", [11, 2048])
def test_third_farthest(spark, block):
    at, points = crowd(spark)
    out = crowds.third_farthest(points, 0.25, 6, block)
    assert "Join" not in plan(out).split("FlatMapCoGroupsInArrow")[0]
    d2, on = near(at, 0.25)
    want = {i: np.sort(d2[i][on[i]])[-3] for i in range(len(at)) if on[i].sum() >= 6}
    got = {q.id: q.third for q in out.collect()}
    assert want.keys() == got.keys() and all(math.isclose(want[i], got[i], abs_tol=1e-12) for i in want)


@pytest.mark.parametrize("block", [11, 2048])
def test_widest_gaps(spark, block):
    at, points = crowd(spark, 2)
    _, on = near(at, 0.25)
    want = {}
    for i in np.flatnonzero(on.any(1)):
        a = np.sort(np.degrees(np.arctan2(*(at[on[i]] - at[i]).T[[1, 0]])))
        want[i] = max(np.diff(np.append(a, a[0] + 360)))
    got = {q.id: q.gap for q in crowds.widest_gaps(points, 0.25, block).collect()}
    assert want.keys() == got.keys() and all(math.isclose(want[i], got[i], abs_tol=1e-9) for i in want)


@pytest.mark.parametrize("block", [11, 2048])
def test_moments_within(spark, block):
    """As those of the pairs, far from the origin too; and the features make no pairs."""
    at, points = crowd(spark, 3)
    points = points.selectExpr("id", "x + 1000 AS x", "y - 500 AS y", "z").dropDuplicates(["x", "y", "z"])
    want = {q.id: q for q in shapes.moments(shapes.offsets(points, 0.25), own=True).collect()}
    got = {q.id: q for q in crowds.moments_within(points, 0.25, block).collect()}
    assert want.keys() == got.keys() and all(g.n == want[i].n and np.allclose(g[2:], want[i][2:], atol=1e-12) for i, g in got.items())
    assert "FlatMapCoGroupsInArrow" in plan(shapes.contour_features(points, 0.25))


def test_nearest_is_spread_by_places(spark, monkeypatch):
    """Tasks follow the places, not the bytes that are shuffled; results are those of numpy."""
    _, points = crowd(spark, 6)
    monkeypatch.setattr(neighbours, "SEARCHED", 20)
    out = neighbours.nearest(points, 5, few_points=0)
    assert "REPARTITION_BY_NUM" in plan(out)
    rows = lambda df: sorted((q.id, q.rank, q.nid, round(q.dist, 12)) for q in df.collect())
    assert rows(out) == rows(neighbours.nearest(points, 5))


@pytest.mark.parametrize("block", [11, 2048])
def test_links_of_a_crowd(spark, block):
    """As many links as points and neighbouring cells, and the components of all pairs; none across a gap just wider than the radius."""
    at, _ = crowd(spark, 7, 240)
    at = np.concatenate([at, [[5, 5, 5], [5.25, 5, 5], [5.5000001, 5, 5]], np.random.default_rng(8).normal(3, 0.01, (300, 3))])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, x double, y double, z double")
    _, on = near(at, 0.25)
    label = np.arange(len(at))
    while (label != (now := np.where(on | np.eye(len(at), dtype=bool), label[None], len(at)).min(1))).any():
        label = now
    links = crowds.links(points, 0.25, block).collect()
    assert all(label[q.src] == label[q.dst] for q in links) and len(links) < on.sum() / 20
    got = np.arange(len(at))
    for _ in range(len(at)):
        was = got.copy()
        for q in links:
            got[q.src] = got[q.dst] = min(got[q.src], got[q.dst])
        if (was == got).all():
            break
    assert (got == label).all()


def test_nearer_is_open(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.5, 0.0, 0.0), (3, 2.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert sorted(q.id for q in crowds.nearer(points, points.filter("id = 1"), 0.5).collect()) == [1]
    assert sorted(q.id for q in crowds.nearer(points, points.filter("id = 1"), 0.5000001).collect()) == [1, 2]


def test_faces_of_one_vertex(spark):
    """A vertex of many faces is one node: no task gets its faces to sort. A face of one vertex only is in, one without corners is its own."""
    rows = [(f, 0, 2 * f + 1, 2 * f + 2) for f in range(10, 300)] + [(5, 1001, 1002, 1003), (7, 1003, 1004, 1005), (400, 1005, 1005, 1005), (401, 2000, 2000, 2000), (402, None, None, None)]
    out = meshes.face_components(spark.createDataFrame(rows, "face long, a long, b long, c long"))
    assert "Window" not in plan(out)
    want = {f: 10 for f in range(10, 300)} | {5: 5, 7: 5, 400: 5, 401: 401, 402: 402}
    assert {q.face: q.component for q in out.collect()} == want


def test_residency_of_many_rows(spark):
    """Partitions follow the rows, and a fold over numbers is as one over a dictionary."""
    r = np.random.default_rng(9)
    walk = [(u, i, float(x), float(y)) for u in range(3) for i, (x, y) in enumerate(np.cumsum(r.normal(0, 1.5, (300, 2)), 0))]
    places = [(k, float(x), float(y)) for k, (x, y) in enumerate(r.normal(0, 12, (40, 2)))]
    rows = spark.createDataFrame(walk, "u long, us long, x double, y double")
    out = motion.residency(rows, spark.createDataFrame(places, "payload long, px double, py double"), "u", ["us"], 9.0)
    assert "REPARTITION_BY_NUM" in plan(out)
    want = []
    for u in range(3):
        last, held = None, {}
        for _, n, x, y in (w for w in walk if w[0] == u):
            if last and math.hypot(x - last[0], y - last[1]) < 1.5:
                continue
            last = x, y
            for k, px, py in places:
                away = math.hypot(px - x, py - y)
                if k in held and away > 12.0:
                    want.append((u, k, held.pop(k), n))
                elif k not in held and away <= 9.0:
                    held[k] = n
        want += [(u, k, n, None) for k, n in held.items()]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
