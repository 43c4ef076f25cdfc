"""Planes of regions, ordered claims, clusters, edge lengths and clocks against plain versions."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import claims, edges, regions
from voxelmill.sources import folders
from voxelmill.streaming import timers


def points_of(spark, p):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")


def test_medians(spark):
    r = np.random.default_rng(1)
    rows = [("a", float(x)) for x in r.normal(0, 1, 501)] + [("b", float(x)) for x in r.integers(0, 4, 400)] + [("c", 2.5)] * 7 + [("d", 1.0), ("d", 4.0)] + [("e", float(x)) for x in [*r.uniform(0, 1e-6, 300), 1e9]]
    got = {q.k: q["median"] for q in regions.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v")).collect()}
    assert got == {k: float(np.median([v for j, v in rows if j == k])) for k in "abcde"}
    assert regions.medians(spark.createDataFrame([], "k string, v double"), ["k"], F.col("v")).count() == 0


def scene(seed=4):
    r = np.random.default_rng(seed)
    floor = np.c_[r.uniform(0, 4, (900, 2)), r.normal(0.5, 0.004, 900)]
    wall = np.c_[r.uniform(5, 9, 700), np.full(700, 2.0) + r.normal(0, 0.004, 700), r.uniform(0, 3, 700)]
    slope = np.c_[xy := r.uniform(12, 16, (800, 2)), 0.5 * xy[:, 0] - 3 + r.normal(0, 0.004, 800)]
    second = np.c_[r.uniform(0, 4, (500, 2)), r.normal(2.0, 0.004, 500)]
    return np.concatenate([floor, wall, slope, second, r.uniform(0, 16, (150, 3))])


def test_region_planes(spark, monkeypatch):
    folders.shared(spark)
    p = scene()
    points = points_of(spark, p)
    planes, members = regions.region_planes(points, 10.0, draws=120)
    got = sorted((q.tx, q.ty, round(abs(q.nx), 1), round(abs(q.ny), 1), round(abs(q.nz), 1), q.n) for q in planes.collect())
    assert [(g[:5]) for g in got] == [(0, 0, 0.0, 0.0, 1.0), (0, 0, 0.0, 0.0, 1.0), (0, 0, 0.0, 1.0, 0.0), (1, 1, 0.4, 0.0, 0.9)]
    own = {}
    for q in members.collect():
        assert q.id not in own
        own[q.id] = (q.tx, q.ty, q.plane)
    for q in planes.collect():
        rows = p[[i for i, o in own.items() if o == (q.tx, q.ty, q.plane)]]
        off = rows @ [q.nx, q.ny, q.nz] + q.offset
        assert len(rows) == q.n >= 128 and np.abs(off).max() <= 0.04 and abs(np.median(off)) < 0.002
    # The same on any partitioning, and however a crowded region is cut into blocks.
    again, _ = regions.region_planes(points.orderBy(F.desc("x")).repartition(7), 10.0, draws=120)
    assert sorted(map(str, again.drop("nx", "ny", "nz", "offset").collect())) == sorted(map(str, planes.drop("nx", "ny", "nz", "offset").collect()))
    monkeypatch.setattr(regions, "BLOCK", 64)
    cut, _ = regions.region_planes(points, 10.0, draws=120)
    assert sorted(map(str, cut.select("tx", "ty", "plane", "n").collect())) == sorted(map(str, planes.select("tx", "ty", "plane", "n").collect()))


def test_region_planes_of_little(spark):
    folders.shared(spark)
    for rows in (np.zeros((0, 3)), np.zeros((300, 3)), np.c_[np.arange(300) / 10, np.zeros((300, 2))], scene()[:100]):
        planes, members = regions.region_planes(points_of(spark, rows), 100.0, draws=20)
        assert planes.count() == members.count() == 0


def test_primitives(spark):
    """A plane's rows that lie apart are pieces of their own; a thin ring of rows covers too little of its rectangle."""
    folders.shared(spark)
    r = np.random.default_rng(2)
    left, right = (np.c_[r.uniform(a, a + 2, 1500), r.uniform(0, 2, 1500), r.normal(1, 0.003, 1500)] for a in (0, 4))
    t = r.uniform(0, 2 * np.pi, 900)
    ring = np.c_[3 + 2.5 * np.cos(t), 6 + 2.5 * np.sin(t), np.full(900, 1.0)]
    few = np.c_[r.uniform(8, 8.4, 60), r.uniform(0, 0.4, 60), np.full(60, 1.0)]
    p = np.concatenate([left, right, ring, few])
    parts, rows = regions.primitives(points_of(spark, p), 10.0, draws=60)
    got = parts.collect()
    assert len(got) == 2 and all(q.nz > 0.999 and q.coherence > 0.8 and q.n > 1300 and 3.0 < q.area < 4.5 for q in got)
    of = {}
    for q in rows.collect():
        of.setdefault(q.part, set()).add(q.id)
    assert sorted(len(v) for v in of.values()) == sorted(q.n for q in got)
    assert {frozenset(i // 1500 for i in v) for v in of.values()} == {frozenset({0}), frozenset({1})}


# Ordered claims and clusters


@pytest.mark.parametrize("seed", range(3))
def test_claims_equal_the_fold(spark, seed):
    folders.shared(spark)
    r = np.random.default_rng(seed)
    planes = [(k, bool(r.random() < 0.6)) for k in range(14)]
    wants = sorted({(int(r.integers(0, 14)), int(i)) for i in r.integers(0, 60, 220)} | {(k, 100 + k // 2) for k in range(14)})
    wants = [(k, i, [True, False, None][int(r.integers(0, 3))]) for k, i in wants]
    left, want = {i for _, i, _ in wants}, set()
    for k, gated in planes:
        rows = [(i, v) for j, i, v in wants if j == k and i in left]
        if rows and (not gated or 2 * sum(bool(v) for _, v in rows) >= len(rows)):
            want |= {(k, i) for i, _ in rows}
            left -= {i for i, _ in rows}
    got = claims.claims(spark.createDataFrame(wants, "plane int, id long, vote boolean"), spark.createDataFrame(planes, "plane int, gated boolean"))
    assert {tuple(q) for q in got.collect()} == want and any(g for _, g in planes)
    assert claims.claims(spark.createDataFrame([], "plane int, id long, vote boolean"), spark.createDataFrame(planes, "plane int, gated boolean")).count() == 0


def test_planes_far_apart_are_settled_together(spark, monkeypatch):
    folders.shared(spark)
    rounds, keep = [], claims.stored
    monkeypatch.setattr(claims, "stored", lambda df, name: (rounds.append(name), keep(df, name))[1])
    wants = spark.range(4000).selectExpr("cast(id % 1000 as int) AS plane", "id", "true AS vote")
    got = claims.claims(wants, spark.range(1000).selectExpr("cast(id as int) AS plane", "false AS gated"))
    assert got.count() == 4000 and rounds.count("claims-taken") == 1


def test_elevated(spark):
    p, g = points_of(spark, [(0, 0, 2), (0, 0, 1), (50, 0, 9), (3, 0, 5)]), spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 3.0, 0.5, 4.5)], "oid long, x double, y double, z double")
    assert {q.id: q.vote for q in claims.elevated(p, g).collect()} == {0: True, 1: False, 2: False, 3: False}


@pytest.mark.parametrize("seed", range(3))
def test_complete_linkage(spark, seed):
    r = np.random.default_rng(seed)
    order = [int(x) for x in r.integers(0, 8, 40)]
    pairs = {tuple(map(int, r.choice(35, 2, replace=False))) for _ in range(160)}
    near = pairs | {(b, a) for a, b in pairs}
    clusters: list[list[int]] = []
    for i in sorted(range(40), key=lambda i: (order[i], i)):
        for c in clusters:
            if all((i, j) in near for j in c):
                c.append(i)
                break
        else:
            clusters.append([i])
    items, table = spark.createDataFrame([(i, float(o)) for i, o in enumerate(order)], "item long, order double"), spark.createDataFrame([*pairs, (3, 3)], "a long, b long")
    assert {q.item: q.cluster for q in claims.complete_linkage(items, table).collect()} == {i: c[0] for c in clusters for i in c}
    with pytest.raises(ValueError, match="pairs"):
        claims.complete_linkage(items, table, most=10)


# Edge lengths


def plain_match(p, q, distance, degrees):
    """Of one prediction and one reference by dense sampling: the stretch that counts, or None."""
    d, e = p[1] - p[0], q[1] - q[0]
    n, m = np.linalg.norm(d), np.linalg.norm(e)
    d, e = d / n, e / m
    if abs(d @ e) < math.cos(math.radians(degrees)):
        return None
    t = np.linspace(0, n, 20001)
    at = p[0] + t[:, None] * d
    foot = (at - q[0]) @ e
    ok = (foot >= 0) & (foot <= m) & (np.linalg.norm(at - q[0] - foot[:, None] * e, axis=1) <= distance)
    if ok.sum() < 2:
        return None
    low, high = t[ok][0], t[ok][-1]
    ends = sorted(((p[0] + x * d - q[0]) @ e) for x in (low, high))
    return low, high, ends[0], ends[1]


def length_of(parts):
    total, reach = 0.0, -math.inf
    for a, b in sorted(parts):
        total += max(0.0, b - max(a, reach))
        reach = max(reach, b)
    return total


@pytest.mark.parametrize("seed", range(2))
def test_edge_quality(spark, seed):
    r = np.random.default_rng(seed)
    reference, predicted = [], []
    for k in range(12):
        a = r.uniform(-4, 4, 3)
        b = a + r.normal(0, 1.5, 3)
        reference.append((k % 2 + 1, np.array([a, b])))
        for _ in range(3):
            s, e = sorted(r.uniform(-0.2, 1.2, 2))
            ends = np.array([a + s * (b - a), a + e * (b - a)]) + r.normal(0, 0.05, (2, 3))
            predicted.append((int(r.integers(1, 3)) if r.random() < 0.2 else k % 2 + 1, ends if r.random() < 0.5 else ends[::-1]))
    predicted += [predicted[0], (predicted[1][0], predicted[1][1][::-1]), (predicted[2][0], np.array([predicted[2][1].mean(0), predicted[2][1][1]]))]  # lines that coincide
    frame = lambda rows: spark.createDataFrame([(i, k, *map(float, s.ravel())) for i, (k, s) in enumerate(rows)], "id long, kind long, ax double, ay double, az double, bx double, by double, bz double")
    got = {q.kind: q for q in edges.quality(frame(predicted), frame(reference), 0.1, 5.0).collect()}
    duplicates = {len(predicted) - 3, len(predicted) - 2, len(predicted) - 1}
    for kind in (1, 2):
        size = lambda s: float(np.linalg.norm(s[1] - s[0]))
        mine, theirs = [(i, s) for i, (k, s) in enumerate(predicted) if k == kind], [(i, s) for i, (k, s) in enumerate(reference) if k == kind]
        met = {(i, j): m for i, s in mine for j, t in theirs if (m := plain_match(s, t, 0.1, 5.0))}
        q = got[kind]
        assert math.isclose(q.raw, sum(size(s) for _, s in mine), abs_tol=1e-9) and math.isclose(q.reference, sum(size(s) for _, s in theirs), abs_tol=1e-9)
        own = sum(size(s) for i, s in mine if i not in duplicates)
        assert math.isclose(q.own, own, abs_tol=1e-6) and math.isclose(q.duplicate, q.raw - q.own, abs_tol=1e-9)
        matched = sum(length_of([m[:2] for (i, _), m in met.items() if i == k]) for k, _ in mine if k not in duplicates)
        found = sum(length_of([m[2:] for (_, j), m in met.items() if j == k]) for k, _ in theirs)
        assert math.isclose(q.matched, matched, abs_tol=0.01) and math.isclose(q.found, found, abs_tol=0.01)
        assert math.isclose(q.precision, q.matched / q.own) and math.isclose(q.recall, q.found / q.reference) and math.isclose(q["false"], q.own - q.matched)
        n = {j: sum((i, j) in met for i, _ in mine) for j, _ in theirs}
        assert [(f.id, f.n) for f in q.fragments] == [(j, c) for j, c in sorted(n.items()) if c]
        assert q.matched > 1


def test_edge_quality_of_bounds(spark):
    frame = lambda rows: spark.createDataFrame([(i, 1, *map(float, s)) for i, s in enumerate(rows)], "id long, kind long, ax double, ay double, az double, bx double, by double, bz double")
    one = frame([(0, 0, 0, 1, 0, 0)])
    for other, matched in (((0, 0.1, 0, 1, 0.1, 0), 1.0), ((0, 0.1001, 0, 1, 0.1001, 0), 0.0), ((2, 0, 0, 3, 0, 0), 0.0), ((0.5, 0, 0, 0.5, 1, 0), 0.0), ((1.5, 0, 0, 0.25, 0, 0), 0.75)):
        assert math.isclose(edges.quality(frame([other]), one).first().matched, matched, abs_tol=1e-9), other
    none = edges.quality(frame([]), one).first()
    assert none.precision is None and none.recall == 0.0 and none.fragments is None
    assert edges.quality(frame([]), frame([])).count() == 0
    with pytest.raises(Exception, match="no length"):
        edges.quality(frame([(0, 0, 0, 0, 0, 0)]), one).collect()


# Clocks


def test_a_stop_follows_by_itself(spark, tmp_path):
    """No row comes after the commands: the stop is the clock's."""
    folder = tmp_path / "in"
    rows = [("a", 1.0, "enable", 1.0), ("a", 2.0, "command", 0.9), ("a", 2.5, "command", float("nan")), ("b", 1.0, "command", 0.3), ("c", 1.0, "enable", 1.0), ("c", 2.0, "command", -0.2), ("c", 3.0, "enable", 0.0)]
    schema = "k string, time double, kind string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{folder}")
    events = spark.readStream.schema(schema).parquet(f"file://{folder}")
    q = timers.stops(events, "k", 0.5, 0.4).writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("stops").filter("cause = 'silence'").isEmpty():
            time.sleep(0.2)
        time.sleep(1.5)
        got = [tuple(x) for x in spark.table("stops").orderBy("k", "time").collect()]
    finally:
        q.stop()
    assert got == [("a", 2.0, 0.4, "command"), ("a", 2.5, 0.0, "silence"), ("c", 2.0, -0.2, "command"), ("c", 3.0, 0.0, "motor")]


def test_payloads_around_a_moving_key(spark, tmp_path):
    boxes = [(f"p{i}", 10.0 * i, -1.0, 10.0 * i + 4, 1.0) for i in range(9)]
    r = np.random.default_rng(3)
    x = np.cumsum(r.normal(0, 3, 80))
    batches = [[("u", float(t), float(x[t]), 0.0) for t in range(a, a + 20)] for a in range(0, 80, 20)]
    schema = "k string, time double, x double, y double"
    for i, rows in enumerate(batches):
        r.shuffle(rows)
        spark.createDataFrame([(str(k), float(t), float(a), float(b)) for k, t, a, b in rows], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    moves = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    q = timers.resident(moves, boxes, "k", 12.0).writeStream.format("memory").queryName("resident").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(q.time, q.payload, q.loaded) for q in spark.table("resident").collect()]
    want, held, at, step = [], set(), None, 2.0
    for t, a in enumerate(x):
        if at is not None and abs(a - at) < step:
            continue
        at = a
        now = {n for n, lx, ly, ux, uy in boxes if lx <= a + 12 + (2 * step if n in held else 0) and ux >= a - 12 - (2 * step if n in held else 0)}
        want += [(float(t), n, False) for n in held - now] + [(float(t), n, True) for n in now - held]
        held = now
    assert sorted(got) == sorted(want) and {w[2] for w in want} == {True, False}
    with pytest.raises(ValueError):
        timers.resident(moves, boxes * 20_000, "k", 12.0)
