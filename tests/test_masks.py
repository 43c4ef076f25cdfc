"""Distances, discs, holes, repairs and outlines of masks against plain versions."""

import itertools

import numpy as np
import pytest

from voxelmill.operators import contours, masks
from voxelmill.sources.folders import shared


def cells_of(spark, mask, low=(-3, 5), **more):
    rows = [(int(x) + low[0], int(y) + low[1], *more.values()) for x, y in np.argwhere(mask)]
    return spark.createDataFrame(rows, ", ".join(["ix long", "iy long", *(f"{k} string" for k in more)]))


def mask_of(rows, shape, low=(-3, 5)):
    out = np.zeros(shape, bool)
    for q in rows:
        out[q.ix - low[0], q.iy - low[1]] = True
    return out


def plain_d2(mask, box=True):
    """Squared distance to the nearest empty cell; without a box the mask is surrounded by empty cells."""
    m = mask if box else np.pad(mask, 1)
    empty = np.argwhere(~m)
    out = np.zeros(m.shape)
    for x, y in np.argwhere(m):
        out[x, y] = ((empty - (x, y)) ** 2).sum(1).min() if len(empty) else np.inf
    return out if box else out[1:-1, 1:-1]


MASKS = [np.random.default_rng(k).random((17, 23)) < share for k, share in enumerate((0.3, 0.6, 0.8, 0.97))] + [np.ones((9, 30), bool), np.eye(6, dtype=bool)]


@pytest.mark.parametrize("k", range(len(MASKS)))
def test_distances(spark, k):
    m = MASKS[k]
    got = {(q.ix + 3, q.iy - 5): q.d2 for q in masks.distances(cells_of(spark, m)).collect()}
    want = plain_d2(m, box=False)
    assert got == {(x, y): want[x, y] for x, y in np.argwhere(m)}
    box = (-3, m.shape[0] - 4, 5, m.shape[1] + 4)
    got = {(q.ix + 3, q.iy - 5): q.d2 for q in masks.distances(cells_of(spark, m), box=box).collect()}
    want = plain_d2(m)
    assert got == {(x, y): None if np.isinf(want[x, y]) else want[x, y] for x, y in np.argwhere(m)}


def test_distances_of_keys_and_repeats(spark):
    a, b = MASKS[1], MASKS[2]
    both = cells_of(spark, a, name="a").unionByName(cells_of(spark, b, name="b"))
    got = {(q.name, q.ix + 3, q.iy - 5): q.d2 for q in masks.distances(both.unionByName(both), ["name"]).collect()}
    want = {("a", *p): plain_d2(a, False)[tuple(p)] for p in np.argwhere(a)} | {("b", *p): plain_d2(b, False)[tuple(p)] for p in np.argwhere(b)}
    assert got == want
    assert masks.distances(both.limit(0)).count() == 0


def plain_dilated(m, r2):
    out = np.zeros_like(m)
    for x, y in itertools.product(*map(range, m.shape)):
        out[x, y] = any((x - a) ** 2 + (y - b) ** 2 <= r2 for a, b in np.argwhere(m))
    return out


def plain_holes(m):
    """Label of each enclosed empty cell, by flooding; 0 elsewhere."""
    m = np.pad(m, 1)
    label, n = np.zeros(m.shape, int), 0
    for start in map(tuple, np.argwhere(~m)):
        if label[start]:
            continue
        n += 1
        todo = [start]
        label[start] = n
        while todo:
            x, y = todo.pop()
            for a, b in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and not m[a, b] and not label[a, b]:
                    label[a, b] = n
                    todo.append((a, b))
    label[label == label[0, 0]] = 0
    return label[1:-1, 1:-1]


@pytest.mark.parametrize("r2", [1, 4, 6.5])
def test_discs(spark, r2):
    m = np.pad(MASKS[0] & (np.random.default_rng(9).random(MASKS[0].shape) < 0.4), 6)
    wide = plain_dilated(m, r2)
    assert (mask_of(masks.dilated_disc(cells_of(spark, m), r2).collect(), m.shape) == wide).all()
    assert (mask_of(masks.closed_disc(cells_of(spark, m), r2).collect(), m.shape) == (wide & (plain_d2(wide) > r2) | m)).all()


@pytest.mark.parametrize("k", range(3))
def test_holes(spark, k):
    m = MASKS[k + 1] if k < 2 else np.pad(np.ones((5, 70), bool), 1)
    if k == 2:
        m[3, 2:68] = False
        m[2, 30] = False
    want = {}
    label = plain_holes(m)
    for n in set(label.ravel()) - {0}:
        own = np.argwhere(label == n)
        want |= {(int(x), int(y)): len(own) for x, y in own}
    got = {(x + 3, q.iy - 5): q.area for q in masks.holes(cells_of(spark, m)).collect() for x in range(q.low, q.high + 1)}
    assert got == want and got


def test_repaired(spark):
    shared(spark)
    r = np.random.default_rng(3)
    seen = np.pad(r.random((24, 24)) < 0.5, 8)
    seen[14:20, 14:20] = False
    segments = [(2, 2, 9, 5), (30, 30, 30, 30), (36, 4, 33, 9)]
    bridge = np.zeros_like(seen)
    for ax, ay, bx, by in segments:
        n = max(abs(bx - ax), abs(by - ay)) + 1
        bridge[tuple(np.rint(np.linspace((ax, ay), (bx, by), n)).astype(int).T)] = True
    guard = np.zeros_like(seen)
    guard[15:17, 15:17] = True
    reach, most = 1.5, 40
    seed = seen | bridge
    closing = lambda m: (lambda w: w & (plain_d2(w) > 4) | m)(plain_dilated(m, 4))
    closed, local = closing(seed), closing(seen)
    label = plain_holes(closed)
    inside = np.isin(label, [n for n in set(label.ravel()) - {0} if (label == n).sum() <= most])
    kept = (closed | inside) & ~(guard & ~seen) & (inside | plain_dilated(seed, (reach + 1) ** 2))
    links = spark.createDataFrame([tuple(v + o for v, o in zip(s, (-3, 5) * 2, strict=True)) for s in segments], "ax long, ay long, bx long, by long")
    got = masks.repaired(cells_of(spark, seen), masks.segment_cells(links), cells_of(spark, guard), reach, most).collect()
    assert len(got) == kept.sum() and (mask_of(got, seen.shape) == kept).all()
    for name, want in (("observed", seen), ("enclosed", inside & kept), ("bridged", closed & ~local & kept & ~seen)):
        assert (mask_of([q for q in got if q[name]], seen.shape) == want).all()
    rows = spark.createDataFrame([(0, 0)] * 3 + [(5, 5)] * 2, "ix long, iy long")
    assert {tuple(q) for q in masks.protected_cells(rows).collect()} == {(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)}


def plain_heights(h, paved, sigma):
    edge = np.sqrt(plain_d2(paved))
    deep, steep = edge >= 3, np.zeros(h.shape, bool)
    for axis in (0, 1):
        a, b = (h[:-1], h[1:]) if axis == 0 else (h[:, :-1], h[:, 1:])
        da, db = (deep[:-1], deep[1:]) if axis == 0 else (deep[:, :-1], deep[:, 1:])
        e = (np.abs(b - a) > 0.08) & da & db
        for s in ((slice(None, -1), slice(1, None))):
            steep[(s, slice(None)) if axis == 0 else (slice(None), s)] |= e
    if not steep.any():
        return h
    k = np.exp(-0.5 * (np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1) / sigma) ** 2)
    k /= k.sum()
    smooth = lambda v: np.apply_along_axis(lambda x: np.convolve(np.pad(x, len(k) // 2, mode="edge"), k, "valid"), 1, np.apply_along_axis(lambda x: np.convolve(np.pad(x, len(k) // 2, mode="edge"), k, "valid"), 0, v))
    mean = smooth(np.where(paved, h, 0)) / np.maximum(smooth(paved.astype(float)), 1e-6)
    blend = np.clip((45 - np.sqrt(plain_d2(~steep))) / 30, 0, 1) * np.clip(edge / 3, 0, 1)
    return np.where(paved & (blend > 0), h + (mean - h) * blend, h)


def test_repaired_heights(spark):
    shared(spark)
    r = np.random.default_rng(1)
    h = np.add.outer(np.arange(60) * 0.01, np.arange(50) * 0.02) + r.normal(0, 0.005, (60, 50))
    h[20:, 25:] += 0.5
    paved = np.ones(h.shape, bool)
    paved[:, :6] = paved[50:55, 40:45] = False
    rows = [(x, y, float(h[x, y]), bool(paved[x, y]) or None) for x, y in itertools.product(range(60), range(50))]
    frame = lambda rows: spark.createDataFrame(rows, "ix int, iy int, height double, paved boolean")
    got = np.zeros(h.shape)
    for q in masks.repaired_heights(frame(rows), sigma=4.0).collect():
        got[q.ix, q.iy] = q.repaired
    want = plain_heights(h, paved, 4.0)
    assert np.allclose(got, want, atol=1e-9) and (np.abs(want - h) > 0.1).any() and (got[~paved] == h[~paved]).all()
    gentle = frame([(x, y, 0.01 * x, True) for x, y in itertools.product(range(9), range(9))])
    assert all(q.repaired == q.height for q in masks.repaired_heights(gentle).collect())
    assert masks.repaired_heights(frame([])).count() == 0
    with pytest.raises(Exception, match="gaps"):
        masks.repaired_heights(frame(rows[:-1])).collect()


# Outlines


def plain_loops(mask):
    """One walk after another along the sides; a ring is cut where it meets itself."""
    m, ways = np.pad(mask, 1), {}
    for x, y in np.argwhere(m):
        for (ox, oy), a, b in (((0, -1), (0, 0), (1, 0)), ((1, 0), (1, 0), (1, 1)), ((0, 1), (1, 1), (0, 1)), ((-1, 0), (0, 1), (0, 0))):
            if not m[x + ox, y + oy]:
                ways.setdefault((x + a[0], y + a[1]), []).append((x + b[0], y + b[1]))
    rings = []
    while ways:
        start = next(iter(ways))
        at, before, ring = start, None, []
        while True:
            ring.append(at)
            options = ways[at]
            to = options[0] if before is None else max(options, key=lambda p: (at[0] - before[0]) * (p[1] - at[1]) - (at[1] - before[1]) * (p[0] - at[0]))
            options.remove(to)
            if not options:
                del ways[at]
            before, at = at, to
            if at == start:
                break
        todo = [ring]
        while todo:
            ring, seen = todo.pop(), {}
            for i, p in enumerate(ring):
                if p in seen:
                    todo += [ring[seen[p] : i], ring[: seen[p]] + ring[i:]]
                    break
                seen[p] = i
            else:
                corner = [p for a, p, b in zip(ring[-1:] + ring, ring, ring[1:] + ring[:1], strict=False) if (p[0] - a[0]) * (b[1] - p[1]) != (p[1] - a[1]) * (b[0] - p[0])]
                k = corner.index(min(corner))
                rings.append(tuple((int(x) - 1, int(y) - 1) for x, y in corner[k:] + corner[:k]))
    return sorted(rings)


@pytest.mark.parametrize("k", range(7))
def test_outlines(spark, k):
    r = np.random.default_rng(k)
    m = r.random((12, 14)) < (0.3, 0.5, 0.7, 0.9, 0.6, 0.5, 1.1)[k]
    if k == 4:  # a ring that closes only at a corner
        m = np.ones((5, 5), bool)
        m[1:4, 1:4] = False
        m[0, 0] = False
        m = np.kron(m, np.ones((1, 1), bool))
    got = {}
    out = contours.loops(cells_of(spark, m, low=(0, 0))).collect()
    for q in sorted(out, key=lambda q: q.place):
        got.setdefault((q.lx, q.ly, q.turn), []).append((q.x, q.y))
    assert all(v[0] == k[:2] for k, v in got.items())
    assert sorted(map(tuple, got.values())) == plain_loops(m)
    area = contours.areas(contours.loops(cells_of(spark, m, low=(0, 0)))).collect()
    assert sum(q.area2 for q in area) == 2 * m.sum()


def test_outlines_of_keys(spark):
    a, b = np.ones((2, 3), bool), MASKS[1]
    both = cells_of(spark, a, low=(0, 0), name="a").unionByName(cells_of(spark, b, low=(0, 0), name="b"))
    out = contours.loops(both, ["name"]).collect()
    assert [(q.x, q.y) for q in sorted((q for q in out if q.name == "a"), key=lambda q: q.place)] == [(0, 0), (2, 0), (2, 3), (0, 3)]
    assert sum(q.name == "b" for q in out) == sum(map(len, plain_loops(b)))
    assert contours.loops(both.limit(0)).count() == 0
