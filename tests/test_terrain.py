"""Height fields and strips against dense, plain versions."""

import itertools
import math

import numpy as np
import pytest

from voxelmill.operators import patches, terrain
from voxelmill.operators.terrain import Ground
from voxelmill.sources.folders import shared


def points_of(spark, p):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")


def plain_lattice(xy, cell):
    corners = {(x + a, y + b) for x, y in np.floor(xy / cell).astype(int).tolist() for a in (0, 1) for b in (0, 1)}
    order = sorted(corners)
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    hull = [a for a, b in itertools.permutations(order, 2) if all(turn(a, b, c) > 0 or (turn(a, b, c) == 0 and (c[0] - a[0]) * (c[0] - b[0]) + (c[1] - a[1]) * (c[1] - b[1]) <= 0) for c in order)]
    edges = [(a, b) for a, b in itertools.permutations(set(hull), 2) if all(turn(a, b, c) >= 0 for c in order)]
    lo, hi = np.min(order, 0), np.max(order, 0)
    return {(x, y) for x, y in itertools.product(range(lo[0], hi[0]), range(lo[1], hi[1])) if all(turn(a, b, (x + 0.5, y + 0.5)) >= 0 for a, b in edges)}


def plain_fit(p, query, g):
    """One node after another; None where no plane holds."""
    d = np.hypot(*(p[:, :2] - query).T)
    order = sorted((i for i in range(len(p)) if d[i] <= g.radius), key=lambda i: (d[i], i))[: g.most]
    s = p[order]

    def plane(q):
        if len(q) < 3 or np.linalg.matrix_rank(q[:, :2] - q[:, :2].mean(0), tol=1e-6) < 2:
            return None
        m = q.mean(0)
        grad = np.linalg.lstsq(q[:, :2] - m[:2], q[:, 2] - m[2], rcond=None)[0]
        off = np.abs(q[:, 2] - m[2] - (q[:, :2] - m[:2]) @ grad).max()
        return m[2] + (query - m[:2]) @ grad if off <= g.error and np.hypot(*grad) <= g.slope else None

    if len(s) < g.least or d[order[0]] > g.nearest or plane(s) is None:
        return None, []
    angle = np.sort(np.arctan2(*(s[:, :2] - query).T[::-1]))
    if max([*np.diff(angle), 2 * np.pi + angle[0] - angle[-1]]) > np.pi + 1e-8 and d[order[0]] > 1e-8:
        return None, []
    for axis in (0, 1):
        left = s[:, axis] < query[axis]
        a, b = plane(s[left]), plane(s[~left])
        if a is not None and b is not None and abs(a - b) > g.step:
            return None, []
    for a, b in itertools.combinations(s, 2):
        if math.hypot(*(a - b)[:2]) < 0.02 and abs(a[2] - b[2]) > 2 * g.step:
            return None, []
    return plane(s), order


def plain_terrain(p, g):
    cells = sorted(plain_lattice(p[:, :2], g.cell))
    keys = sorted({(x + a, y + b) for x, y in cells for a in (0, 1) for b in (0, 1)})
    at = {k: i for i, k in enumerate(keys)}
    xy = np.array(keys) * g.cell
    fits = [plain_fit(p, q, g) for q in xy]
    held = np.array([h is not None for h, _ in fits])
    heights = np.array([0.0 if h is None else h for h, _ in fits])
    basis = np.c_[xy - xy.mean(0), np.ones(len(xy))]
    plane = basis @ np.linalg.lstsq(basis[held], heights[held], rcond=None)[0]
    lap = np.zeros((len(keys),) * 2)
    sides = {tuple(sorted((at[x + a, y + b], at[x + c, y + d]))) for x, y in cells for a, b, c, d in ((0, 0, 1, 0), (1, 0, 1, 1), (0, 1, 1, 1), (0, 0, 0, 1))}
    for i, j in sides:
        lap[i, i] += 1
        lap[j, j] += 1
        lap[i, j] -= 1
        lap[j, i] -= 1
    strength = 1.0
    while True:
        z = plane + np.linalg.solve(strength * lap + np.diag(held.astype(float)), np.where(held, heights - plane, 0))
        slope = 0.0
        for x, y in cells:
            a, b, c, d = z[at[x, y]], z[at[x + 1, y]], z[at[x + 1, y + 1]], z[at[x, y + 1]]
            slope = max(slope, math.hypot(b - a, c - b), math.hypot(c - d, d - a))
        if slope / g.cell <= g.slope:
            return {k: (z[i], bool(held[i]), fits[i][1]) for k, i in at.items()}, strength
        strength *= 4


def ground(seed, n, wide, bump=0.0):
    r = np.random.default_rng(seed)
    xy = r.uniform(-wide, wide, (n, 2))
    xy = xy[(np.hypot(*xy.T) > 0.8) & (xy[:, 0] + xy[:, 1] < wide)]  # a gap in the middle, a corner cut off
    return np.c_[xy, 0.1 * xy[:, 0] - 0.05 * xy[:, 1] + 0.02 * np.sin(3 * xy[:, 0]) + bump * (xy[:, 0] > 1)]


@pytest.mark.parametrize(("seed", "n", "wide", "bump"), [(1, 900, 3.0, 0.0), (2, 500, 2.5, 0.6)])
def test_terrain_equals_a_dense_solve(spark, seed, n, wide, bump):
    p, g = ground(seed, n, wide, bump), Ground()
    want, strength = plain_terrain(p, g)
    got = terrain.terrain(points_of(spark, p), g).collect()
    assert {(q.ix, q.iy) for q in got} == set(want) and {q.strength for q in got} == {strength}
    for q in got:
        z, held, support = want[q.ix, q.iy]
        assert q.anchored == held and list(q.support) == support and math.isclose(q.z, z, abs_tol=1e-7)
    assert strength > 1 if bump else strength == 1
    assert any(not q.anchored for q in got)


def test_terrain_of_little(spark):
    flat = [(x / 4, y / 4, 0.0) for x in range(8) for y in range(8)]
    got = terrain.terrain(points_of(spark, flat + flat))
    assert all(abs(q.z) < 1e-9 for q in got.collect())
    assert terrain.terrain(points_of(spark, flat[:4])).count() == 0
    assert terrain.terrain(points_of(spark, [(x / 9, x / 9, 0.0) for x in range(40)])).count() == 0
    assert terrain.terrain(points_of(spark, [(x * 9.0, y * 9.0, 0.0) for x in range(3) for y in range(3)])).count() == 0  # no anchors
    with pytest.raises(Exception, match="finite"):
        terrain.terrain(points_of(spark, [*flat, (0, 0, math.nan)]))
    with pytest.raises(ValueError):
        Ground(nearest=2.0)


@pytest.mark.parametrize("seed", range(3))
def test_lattice(spark, seed):
    p = np.random.default_rng(seed).normal(0, 1.5, (12, 3))
    assert {(q.ix, q.iy) for q in terrain.lattice(points_of(spark, p), 0.5).collect()} == plain_lattice(p[:, :2], 0.5)
    assert terrain.lattice(points_of(spark, p).limit(0), 0.5).count() == 0


def plain_line(t, o, scale):
    """Newton steps on the soft-L1 loss, halved until they help."""
    loss = lambda q: (np.sqrt(1 + ((o - q[0] - q[1] * t) / scale) ** 2) - 1).sum()
    q = np.linalg.lstsq(np.c_[np.ones_like(t), t], o, rcond=None)[0]
    for _ in range(200):
        r = (q[0] + q[1] * t - o) / scale
        j = np.c_[np.ones_like(t), t] / scale
        grad = j.T @ (r / np.sqrt(1 + r * r))
        step = np.linalg.solve(j.T @ (j * ((1 + r * r) ** -1.5)[:, None]) + 1e-12 * np.eye(2), -grad)
        while loss(q + step) > loss(q) and np.abs(step).max() > 1e-14:
            step /= 2
        q = q + step
    return q


def test_robust_lines(spark):
    shared(spark)
    r, rows, want = np.random.default_rng(2), [], {}
    for k in range(6):
        t = r.uniform(0, 3, 30)
        o = np.stack([0.1 * k + 0.02 * t, -0.05 * t]) + r.normal(0, 0.01, (2, 30))
        o[0, :5] += 0.8
        rows += [(k, *map(float, x)) for x in zip(t, *o, strict=True)]
        want[k] = np.concatenate([plain_line(t, o[0], 0.03), plain_line(t, o[1], 0.03)])
    rows += [(9, 1.0, 0.5, 0.0), (9, 1.0, 0.5, 0.0)]
    got = {q.k: q for q in patches.robust_lines(spark.createDataFrame(rows, "k long, t double, u double, v double"), "k", "t", ["u", "v"]).collect()}
    assert set(got) == {*want, 9} and (got[9].a_u, got[9].b_u) == (0.5, 0.0)
    for k, w in want.items():
        assert np.allclose([got[k].a_u, got[k].b_u, got[k].a_v, got[k].b_v], w, atol=1e-8)


def test_patches(spark):
    shared(spark)
    r = np.random.default_rng(5)
    members, centres, points = [], [], []
    for k, (tilt, n, long) in enumerate(((0.05, 40, 2.0), (0.0, 40, 2.0), (0.6, 40, 2.0), (0.0, 8, 2.0), (0.0, 40, 0.3))):
        members.append((k, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0))
        t = np.linspace(0.1, long - 0.1, 9)
        centres += [(k, float(x), float(0.02 + tilt * x + r.normal(0, 0.002)), float(r.normal(0, 0.002))) for x in t]
        xs = r.uniform(0.1, long - 0.1, n)
        points += [(k, i, float(x), float(0.02 + tilt * x + y), float(r.normal(0, 0.001))) for i, (x, y) in enumerate(zip(xs, r.uniform(-0.04, 0.04, n), strict=True))]
    members.append((7, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0))
    centres += [(7, 0.1, 0.0, 0.0)] * 5
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n in ('member', 'id') else 'double'}" for n in names.split()))
    got = {q.member: q for q in patches.fit_patches(frame(members, "member sx sy sz ex ey ez nx ny nz"), frame(centres, "member x y z"), frame(points, "member id x y z")).collect()}
    assert set(got) == {0, 1}  # too steep, too few points, too short, too few centres
    assert abs(got[0].degrees - math.degrees(math.atan(0.05))) < 0.3 and got[1].degrees < 0.3
    for q in got.values():
        assert 0.03 < q.half_width < 0.04 and q.plane_rms < 0.002 and q.centre_rms < 0.006 and q.nz > 0.99
        assert abs(q.ax - 0.05) < 0.02 and abs(q.bx - 1.95) < 0.02 and q.rows == 40
        assert abs(np.dot((q.nx, q.ny, q.nz), (q.bx - q.ax, q.by - q.ay, q.bz - q.az))) < 1e-9
