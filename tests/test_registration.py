"""Planted motions between surveys."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import registration as reg
from voxelmill.sources.folders import shared

SCHEMA = "id long, x double, y double, z double, nx double, ny double, nz double"


def town(seed):
    """Ground and the walls of some houses, with normals."""
    r, rows = np.random.default_rng(seed), []
    xy = r.uniform(0, 60, (2500, 2))
    rows.append(np.c_[xy, 0.2 * np.sin(xy[:, 0] / 9), np.zeros((2500, 2)), np.ones(2500)])
    for x, y, w, h in ((5, 8, 14, 6), (30, 5, 8, 20), (40, 40, 16, 5), (8, 45, 10, 10), (52, 20, 4, 9)):
        for a, b, n in (((x, y), (x + w, y), (0, -1)), ((x + w, y), (x + w, y + h), (1, 0)), ((x + w, y + h), (x, y + h), (0, 1)), ((x, y + h), (x, y), (-1, 0))):
            t = r.uniform(0, 1, 260)
            p = np.array(a) + t[:, None] * (np.array(b) - np.array(a))
            rows.append(np.c_[p, r.uniform(0, 4, 260), np.tile([*n, 0.0], (260, 1))])
    return np.concatenate(rows)


def frame(spark, p):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], SCHEMA)


def planted(turn, sign, shift):
    m = np.eye(4)
    a = math.radians(turn)
    m[:3, :3] = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]]) @ np.diag([1, sign, 1])
    m[:3, 3] = shift
    return m


@pytest.mark.parametrize(("turn", "sign"), [(37.4, 1), (211.0, -1)])
def test_register_finds_a_planted_motion(spark, turn, sign):
    shared(spark)
    target = town(1)
    m = planted(turn, sign, (12.3, -7.1, 1.7))  # takes the source to the target
    back = np.linalg.inv(m)
    source = np.c_[target[:, :3] @ back[:3, :3].T + back[:3, 3], target[:, 3:] @ back[:3, :3].T] + np.random.default_rng(2).normal(0, 0.01, target.shape)
    got = reg.register(frame(spark, source), frame(spark, target), coarse=10.0, fine=1.0)
    assert got["sign"] == sign and got["accepted"] and got["within_share"] > 0.99
    assert np.allclose(got["matrix"], m, atol=0.03) and got["quantiles"] == sorted(got["quantiles"]) and got["quantiles"][1] < 0.05


def test_register_says_no(spark):
    shared(spark)
    a, b = town(1)[::4], town(1)[::4]
    b[625:, :2] = np.random.default_rng(5).uniform(0, 60, (len(b) - 625, 2))  # the houses are scattered
    b[:, 2] *= 3
    got = reg.register(frame(spark, a), frame(spark, b), coarse=45.0, fine=15.0, distances=(1.0,), rounds=4)
    assert not got["accepted"] and got["within_share"] < 0.7
    with pytest.raises(ValueError):
        reg.register(frame(spark, a[:100]), frame(spark, a[:100] * [1, 1, 0, 1, 1, 1]), coarse=90.0)


def test_sweep_counts_every_shift(spark):
    r = np.random.default_rng(3)
    cells = {(int(x), int(y)) for x, y in r.integers(0, 12, (40, 2))}
    tall = lambda cs: spark.createDataFrame([(2.0 * x + 0.5, 2.0 * y + 0.5, z) for x, y in cs for z in (0.0, 2.0)], "x double, y double, z double")
    other = {(x + 5, y - 3) for x, y in cells if (x + y) % 3} | {(30, 30)}
    got = reg.sweep(tall(cells), tall(other), [(1, 0.0)]).first()
    hits = {}
    for x, y in cells:
        for a, b in other:
            hits[a - x, b - y] = hits.get((a - x, b - y), 0) + 1
    assert got.hits == max(hits.values()) and hits[got.dx, got.dy] == got.hits and (got.dx, got.dy) == (5, -3)
    assert math.isclose(got.score, got.hits / math.sqrt(len(cells) * len(other)))
    assert reg.sweep(tall(cells), tall(set()), [(1, 0.0)]).count() == 0 and reg.sweep(tall(set()), tall(cells), [(1, 0.0)]).count() == 0


def test_nearest_distance(spark):
    shared(spark)
    r = np.random.default_rng(4)
    a, b = r.normal(0, 3, (60, 3)), r.normal(0, 3, (80, 3))
    a[0], a[1] = (500, 0, 0), (-3000, 80, 9)
    got = {q.id: q.dist for q in reg.nearest_distance(frame(spark, np.c_[a, a]), frame(spark, np.c_[b, b]).drop("id")).collect()}
    assert got == pytest.approx({i: float(np.sqrt(((b - p) ** 2).sum(1)).min()) for i, p in enumerate(a)})
    assert reg.nearest_distance(frame(spark, np.c_[a, a]), frame(spark, np.c_[b, b]).filter(F.lit(False))).count() == 0
