"""Crowded places and large groups: what is compared stays bounded, and results are those of plain loops."""

import math
import subprocess
import sys
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelmill.operators import choices, claims, joins, neighbours, shapes, statistics


def _cloud(n, seed=5):
    return np.random.default_rng(seed).normal(0, 0.12, (n, 3))


def _points(spark, at, name="id"):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], f"{name} long, x double, y double, z double")


@pytest.mark.parametrize(("k", "axes"), [(1, "xy"), (4, "xyz")])
def test_nearest_within_looks_near_first(spark, monkeypatch, k, axes):
    at = np.vstack([_cloud(600), [[0.9, 0.9, 0.9]]])
    radii, plain = [], joins.within
    monkeypatch.setattr(joins, "within", lambda p, o, r, a="xyz": radii.append(r) or plain(p, o, r, a))
    got = {(q.id, q.rank): q.oid for q in joins.nearest_within(_points(spark, at), _points(spark, at, "oid"), 0.3, k, axes, itself=False).collect()}
    d = np.sqrt(sum((at[:, None, i] - at[None, :, i]) ** 2 for i in range(len(axes))))
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1): int(o) for i in range(len(at)) for r, o in enumerate(np.argsort(d[i], kind="stable")[:k]) if d[i, o] <= 0.3}
    assert got == want
    assert radii[0] < 0.3


def test_edge_features_looks_near_first(spark, monkeypatch):
    radii, plain = [], joins.within
    monkeypatch.setattr(joins, "within", lambda p, o, r, a="xyz": radii.append(r) or plain(p, o, r, a))
    at = _cloud(600, 6)
    got = {(q.id, q.oid) for q in shapes.offsets(_points(spark, at), 0.3, 8).collect()}
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(o)) for i in range(len(at)) for o in np.argsort(d[i], kind="stable")[:8] if d[i, o] <= 0.3}
    assert radii[0] < 0.3


def test_votes_in_a_fresh_process():
    """A worker that has imported nothing else."""
    code = """
import pyarrow as pa
from voxelmill.operators import shapes
one = [[0.1 * i for i in range(1, 17)]]
batch = pa.RecordBatch.from_arrays([pa.array([1]), *[pa.array(one if n in ("dist", "dx") else [[0.0] * 16]) for n in ("dist", "dx", "dy", "dz")]], names=["id", "dist", "dx", "dy", "dz"])
print(next(shapes._votes([batch], ((16, 2.0),), 6, 16)).to_pydict())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=False)
    assert "{'id': [1], 'supported': [1], 'consistent': [1]}" in done.stdout, done.stderr


def test_weighted_quantile_of_ties(spark):
    """95 % lies exactly at the next to last of 20 steps; which way the sums of doubles are rounded doesn't matter."""
    rows = []
    for line in range(40):
        step, order = 1 / (20 + math.sqrt(line + 2)), np.random.default_rng(line).permutation(21)
        order = [k for k in order if 0 < k < 20][:1] + [k for k in order if k in (0, 20)] + [k for k in order if 0 < k < 20][1:]
        rows += [(line, float(v), step / 2 if k in (0, 20) else step) for v, k in enumerate(order)]
    got = {q.line: q.q for q in statistics.weighted_quantile(spark.createDataFrame(rows, "line long, v double, w double").repartition(5, "v"), "line", "v", "w", 0.95).collect()}
    for line in got:
        own = [(v, Fraction(w)) for n, v, w in rows if n == line]
        assert got[line] == min(v for v, _ in own if sum(w for u, w in own if u <= v) >= Fraction(95, 100) * sum(w for _, w in own) * (1 - Fraction(1, 10**12)))


def test_capsule_cover_in_turns(spark, monkeypatch):
    """Long segments and short ones; a covered piece meets no later segment."""
    r = np.random.default_rng(3)
    a, b = _cloud(1500, 7), _cloud(1500, 8)
    b = np.where(np.arange(1500)[:, None] % 3 == 0, b, a + 0.2 * b)
    p = _cloud(80, 9)
    q = p + r.normal(0, 0.01, p.shape)
    left, plain = [], joins.stored
    monkeypatch.setattr(joins, "stored", lambda df, name: [out := plain(df, name), left.append(out.count()) if name == "pieces" else None][0])
    table = lambda key, u, v, names: spark.createDataFrame([(i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(u, v, strict=True))], f"{key} long, " + ", ".join(f"{e}{c} double" for e in names for c in "xyz"))
    longest = float(np.sqrt(((a - b) ** 2).sum(1)).max())
    got = {x.piece: x.seg for x in joins.capsule_cover(table("piece", p, q, "pq"), table("seg", a, b, "ab"), 0.06, longest * 1.01).collect()}
    assert left == sorted(left, reverse=True) and left[1] < left[0] == 80

    def away(e):
        ab, ap = b - a, e - a
        t = np.clip((ab * ap).sum(1) / (ab * ab).sum(1), 0, 1)
        return np.sqrt(((ap - t[:, None] * ab) ** 2).sum(1))

    for i in range(80):
        on = np.flatnonzero((away(p[i]) <= 0.06) & (away(q[i]) <= 0.06))
        assert got[i] == (int(on[0]) if len(on) else None)
    with pytest.raises(Exception, match="longer than said"):
        joins.capsule_cover(table("piece", p, q, "pq"), table("seg", a, b, "ab"), 0.06, 0.01).collect()


def test_first_claims_of_many_planes(spark):
    planes = spark.range(20_001).selectExpr("id AS plane", "1.0D AS nx", "0.0D AS ny", "0.0D AS nz", "-0.001D * id AS offset")
    points = spark.createDataFrame([(0, 0.0105, 0.0, 0.0), (1, 20.0, 1.0, 1.0), (2, 25.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert {q.id: q.plane for q in shapes.first_claims(points, planes, 0.0021).collect()} == {0: 9, 1: 19_998}


def test_plane_pairs_by_blocks(spark, monkeypatch):
    same = spark.range(20_001).selectExpr("id AS plane", "1.0D AS nx", "0.0D AS ny", "0.0D AS nz")
    assert joins.plane_pairs(same, 25.0).isEmpty()
    n = _cloud(130, 4)
    n /= np.sqrt((n * n).sum(1))[:, None]
    planes = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(n)], "plane long, nx double, ny double, nz double")
    got = sorted((q.a, q.b) for q in joins.all_pairs(planes, "plane", 20).select(*joins._ends("plane")).collect())
    assert got == [(i, j) for i in range(130) for j in range(i + 1, 130)]
    degrees = np.degrees(np.arccos(np.minimum(np.abs(n @ n.T), 1.0)))
    got = {(q.a, q.b): q.degrees for q in joins.plane_pairs(planes, 25.0).collect()}
    assert set(got) == {(i, j) for i in range(130) for j in range(i + 1, 130) if degrees[i, j] >= 25}
    assert all(abs(got[k] - degrees[k]) < 1e-9 for k in got)


def test_plane_pairs_within_reach(spark):
    n, at = _cloud(120, 14), _cloud(120, 15)
    n /= np.sqrt((n * n).sum(1))[:, None]
    planes = spark.createDataFrame([(i, *map(float, [*v, *p])) for i, (v, p) in enumerate(zip(n, at, strict=True))], "plane long, nx double, ny double, nz double, x double, y double, z double")
    got = {(q.a, q.b) for q in joins.plane_pairs(planes, 0.0, 40.0, 0.2).collect()}
    degrees = np.degrees(np.arccos(np.minimum(np.abs(n @ n.T), 1.0)))
    gap = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if degrees[i, j] <= 40 and gap[i, j] <= 0.2}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_pairs_copies_no_row(spark):
    """What is shuffled follows the rows: each block once for either side, not once for every other block."""
    rows = spark.range(300).repartition(3)
    pairs = joins.all_pairs(rows, "id", 20)
    assert "explode" not in _plan(pairs)
    assert sorted(tuple(q) for q in pairs.select(*joins._ends("id")).collect()) == [(i, j) for i in range(300) for j in range(i + 1, 300)]
    assert max(_shares(pairs)) <= 2 * 60 * 60


def test_link_costs_copy_no_row(spark):
    from voxelmill.plans.shapes import link_costs

    df = link_costs(spark, "/root/testdata/sf0.01")
    assert "explode" not in _plan(df)
    assert df.count() == 17_386


def test_plane_pairs_of_no_numbers(spark):
    """A normal that is no number stands at no angle, as in SQL; a place that is none is within no reach. A limit itself belongs to it."""
    nan, r = float("nan"), math.sqrt(0.5)
    rows = [(0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, nan, 0.0, 0.0, 0.1, 0.0, 0.0), (2, None, 0.0, 1.0, 0.0, 0.1, 0.0), (3, 0.0, 1.0, 0.0, nan, 0.0, 0.0), (4, 0.0, 1.0, 0.0, None, 0.0, 0.0), (5, 0.0, 1.0, 0.0, 0.25, 0.0, 0.0), (None, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0), (6, r, r, 0.0, 1e9, 0.0, 0.0), (7, 0.0, 1.0, 0.0, 1e9, 0.25, 0.0)]
    at = spark.createDataFrame(rows, "plane long, nx double, ny double, nz double, x double, y double, z double")
    got = sorted((q.a, q.b, round(q.degrees, 6), q.gap) for q in joins.plane_pairs(at, 0.0, 180.0, 0.25).collect())
    assert [q[:3] for q in got] == [(0, 1, 0.0), (0, 2, 0.0), (0, 5, 90.0), (1, 2, 0.0), (1, 5, 0.0), (6, 7, 45.0)]
    assert [q[3] for q in got if q[0] in (0, 6)] == [0.1, 0.1, 0.25, 0.25]
    assert {(q.a, q.b) for q in joins.plane_pairs(at, 90.0).collect()} == {(0, 3), (0, 4), (0, 5), (0, 7)}


def _intervals(spark, n, seed):
    r = np.random.default_rng(seed)
    low, long = r.integers(0, 2000, 2 * n), r.integers(0, 60, 2 * n) * (r.random(2 * n) < 0.9)
    rows = [(f"k{i % 2}", i, int(a), int(a + b)) for i, (a, b) in enumerate(zip(low, long, strict=True))]
    at = spark.createDataFrame(rows, "kind string, id long, low long, high long")
    return rows, at.filter("id >= 400").withColumnRenamed("id", "a"), at.filter("id < 400 AND (low < 800 OR low > 1100)").withColumnRenamed("id", "b")


def _plainly(rows):
    """Which unit steps of each left interval some right one covers."""
    right = {(k, t) for k, i, a, b in rows if i < 400 and not 800 <= a <= 1100 for t in range(a, b)}
    return {(k, i): ({t for t in range(a, b) if (k, t) in right}, set(range(a, b))) for k, i, a, b in rows if i >= 400}


def _steps(got):
    out = {}
    for q in got:
        out.setdefault((q.kind, q.a), []).extend(range(q.low, q.high))
    assert all(len(v) == len(set(v)) for v in out.values())
    return {k: set(v) for k, v in out.items()}


def test_covered_meets_unions(spark, monkeypatch):
    rows, left, right = _intervals(spark, 500, 1)
    met, plain = [], joins.interval_overlaps
    monkeypatch.setattr(joins, "interval_overlaps", lambda *a: [out := plain(*a), met.append(out.count())][0])
    got = _steps(joins.covered(left, right, ["kind"], 50.0).collect())
    assert got == {k: own for k, (own, _) in _plainly(rows).items() if own}
    assert met[0] <= 2 * left.count()


def test_interval_difference_meets_unions(spark, monkeypatch):
    rows, left, right = _intervals(spark, 500, 2)
    met, plain = [], joins.interval_overlaps
    monkeypatch.setattr(joins, "interval_overlaps", lambda *a: [out := plain(*a), met.append(out.count())][0])
    got = _steps(choices.interval_difference(left, right, ["kind"], 50.0).collect())
    assert got == {k: whole - own for k, (own, whole) in _plainly(rows).items() if whole - own}
    assert met[0] <= 2 * left.count()


def _shares(df):
    """Rows by the task that makes them."""
    return [q["count"] for q in df.groupBy(F.spark_partition_id()).count().collect()]


def test_interval_match_spreads_its_pairs(spark):
    """Not over as many tasks as the table of events has splits, here one."""
    from voxelmill.plans.joins import interval_match

    n = _shares(interval_match(spark, "/root/testdata/sf0.01"))
    assert sum(n) == 11_655
    assert max(n) < sum(n) / 2


@pytest.mark.parametrize("dealt", [15, 10_000])
def test_interval_overlaps_of_a_crowd(spark, monkeypatch, dealt):
    """One moment holds most intervals; others touch, are empty, turned round or null, or last for many slots."""
    monkeypatch.setattr(joins, "DEALT", dealt)
    r = np.random.default_rng(3)
    rows = [("k", int(a), int(a + b)) for a, b in zip(r.integers(500, 510, 200), r.integers(-3, 12, 200), strict=True)]
    rows += [(f"k{i % 2}"[: 1 + i % 3 // 2], int(a), int(a + b)) for i, (a, b) in enumerate(zip(r.integers(-300, 1500, 120), r.integers(0, 400, 120), strict=True))]
    rows += [("k", 400, 500), ("k", 500, 500), ("k", 500, 600), (None, 1, 900), ("k", None, 900), ("k", 1, None)] * 2
    rows = [(i, *q) for i, q in enumerate(rows)]
    at = spark.createDataFrame(rows, "id long, kind string, low long, high long")
    left, right = (at.filter(f"id % 2 = {k}").withColumnRenamed("id", n) for k, n in ((0, "a"), (1, "b")))
    whole = [q for q in rows if None not in q]
    want = sorted((k, a, b, max(l, m), min(h, g)) for a, k, l, h in whole for b, o, m, g in whole if a % 2 == 0 and b % 2 == 1 and k == o and max(l, m) < min(h, g))
    for crowds in (True, False):
        assert sorted(tuple(q) for q in joins.interval_overlaps(left, right, ["kind"], 50.0, crowds).collect()) == want
    n = _shares(joins.interval_overlaps(left, right, ["kind"], 1000.0, True))
    assert sum(n) == len(want)
    assert dealt > 15 or max(n) < sum(n) / 2


@pytest.mark.parametrize("size", [40, 1000])
def test_linkage_within_by_turns(spark, size):
    """As complete_linkage of all pairs has it, whose one group may be too large."""
    at = np.round(_cloud(300, 21), 2)  # ties in order
    points = _points(spark, at).withColumn("order", F.col("x"))
    pairs = neighbours.radius_pairs(points, 0.1)
    want = {q.item: q.cluster for q in claims.complete_linkage(points.select(F.col("id").alias("item"), "order"), pairs).collect()}
    got = {q.item: q.cluster for q in claims.linkage_within(points, "order", 0.1, size).collect()}
    assert got == want


def test_linkage_within_of_a_crowd(spark):
    """Clusters of many members each, of which most are dropped, and points that are nowhere; no join of all near ones."""
    at = np.vstack([_cloud(5000, 23), np.round(_cloud(1000, 24), 2), [[np.nan, 0, 0], [np.inf, 0, 0], [np.inf, 0, 0]]])
    got = claims.linkage_within(_points(spark, at).withColumn("order", F.col("id") % 7), "order", 0.2)
    assert "Join" not in _plan(got)
    got = {q.item: q.cluster for q in got.collect()}
    groups, names, want = [], [], {}
    for i in sorted(range(len(at)), key=lambda i: (i % 7, i)):
        with np.errstate(invalid="ignore"):
            mine = next((g for g, m in enumerate(groups) if (claims._squares(at[m], at[i]) <= 0.2 * 0.2).all()), len(groups))
        if mine == len(groups):
            groups.append([])
            names.append(i)
        groups[mine].append(i)
        want[i] = names[mine]
    assert got == want
    most = max(groups, key=len)
    assert len(most) > 2 * claims.MEMBERS
    left = claims._outer(at[most], 0.2)
    assert len(left) < len(most) / 2
    eye = at[most].mean(0) + _cloud(300, 25)
    assert all(claims._squares(left, p).max() == claims._squares(at[most], p).max() for p in eye)


@pytest.mark.parametrize("size", [40, 1000])
def test_unsuppressed_within_by_turns(spark, size):
    at = np.round(_cloud(300, 22), 2)
    points = _points(spark, at).withColumn("order", -F.col("x"))
    want = {q.item: q.kept for q in choices.unsuppressed(points.select(F.col("id").alias("item"), "order"), neighbours.radius_pairs(points, 0.1)).collect()}
    got = {q.item: q.kept for q in claims.unsuppressed_within(points, "order", 0.1, size).collect()}
    assert got == want
