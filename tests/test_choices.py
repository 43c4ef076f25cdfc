"""Ordered choices, region jobs, caches, frames and the command line against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.__main__ import main
from voxelmill.operators import audits, choices, frames
from voxelmill.sources import cache


def points_of(spark, p):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")


@pytest.mark.parametrize("n, links", [(40, 30), (60, 200), (5, 0)])
def test_unsuppressed(spark, n, links):
    r = np.random.default_rng(n)
    order = r.integers(0, 10, n)  # ties go to the lower item
    pairs = {tuple(sorted(map(int, r.choice(n, 2, replace=False)))) for _ in range(links)}
    items = spark.createDataFrame([(i, float(o)) for i, o in enumerate(order)], "item long, order double")
    got = {q.item: q.kept for q in choices.unsuppressed(items, spark.createDataFrame([*pairs, (0, 0)], "a long, b long")).collect()}
    kept = set()
    for i in sorted(range(n), key=lambda i: (order[i], i)):
        if not any(tuple(sorted((i, j))) in pairs for j in kept):
            kept.add(i)
    assert got == {i: i in kept for i in range(n)}


def test_region_planes(spark):
    r = np.random.default_rng(4)
    flat = np.concatenate([np.c_[r.uniform(0, 1, (150, 2)), np.full(150, 0.5)], np.c_[r.uniform(2, 3, 140), np.full(140, 0.25), r.uniform(0, 1, 140)], r.uniform(0, 1, (20, 3))])
    got = {(q.tx, q.ty): q for q in choices.planes_by_region(points_of(spark, flat), 2.0, 0.01).collect()}
    assert set(got) == {(0, 0), (1, 0)}
    assert np.allclose([abs(got[0, 0].nz), abs(got[0, 0].offset)], [1, 0.5], atol=1e-6) and got[0, 0].n >= 150
    assert np.allclose([abs(got[1, 0].ny), abs(got[1, 0].offset)], [1, 0.25], atol=1e-6) and got[1, 0].n == 140
    again = {(q.tx, q.ty): q for q in choices.planes_by_region(points_of(spark, flat).repartition(5), 2.0, 0.01).collect()}
    assert again == got


def test_regions_have_halos(spark):
    p = points_of(spark, [(x, 0.5, 0.0) for x in np.arange(0.05, 4, 0.1)])
    import pandas as pd

    def job(own, halo):
        return pd.DataFrame({"n": [len(own)], "near": [len(halo)], "first": [own["id"].iloc[0]]})

    got = {q.tx: (q.n, q.near, q.first) for q in choices.by_region(p, 1.0, 0.2, job, "n long, near long, first long").collect()}
    assert got == {0: (10, 2, 0), 1: (10, 4, 10), 2: (10, 4, 20), 3: (10, 2, 30)}


def test_ground_cells(spark):
    p = [(x / 10, y / 10, 0.0) for x in range(10) for y in range(10)] + [(5.0, 5.0, 0.0)] + [(0.55, 0.55, 2.0)]
    points = points_of(spark, p)
    got = {q.id for q in choices.ground_cells(points, points.select("id", F.col("z").alias("height")), -0.15, 0.25, 0.15, 0.5).collect()}
    cells = {}
    for i, (x, y, z) in enumerate(p[:-1]):
        cells.setdefault((np.floor(x / 0.15), np.floor(y / 0.15)), []).append((z, i))
    want = {sorted(c)[len(c) // 2][1] for c in cells.values()} - {100}
    assert got == want


def test_simplified(spark):
    square = [(0, 0), (1, 0.001), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1)]
    rows = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(square)], "loop long, k long, x double, y double")
    assert [q.k for q in choices.simplified(rows, "loop", "k", 0.01).orderBy("k").collect()] == [0, 2, 4, 6]
    assert choices.simplified(rows, "loop", "k", 0.0001).count() == 5


def test_crowns(spark):
    r = np.random.default_rng(6)
    p = np.concatenate([r.normal(size=(200, 3)) * 0.4 + [0, 0, 6], r.normal(size=(200, 3)) * 0.4 + [12, 0, 8], [[40.0, 40, 1]]])
    points = points_of(spark, p)
    got = {q.id: q.seed for q in choices.crowns(points, points.select("id", F.col("z").alias("height")), 1.0, 4.0, 7.0).collect()}
    assert len({got[i] for i in range(200)}) >= 1 and not {got[i] for i in range(200)} & {got[i] for i in range(200, 400)} and 400 not in got


def test_joined_planes(spark):
    """Three patches of one plane and two of another: cheap pairs first, a pair across never."""
    from voxelmill.operators import statistics

    r = np.random.default_rng(8)
    rows = []
    for plane, (cx, up) in enumerate([(0, False), (1, False), (2, False), (5, True), (5.2, True), (2.2, True)]):
        for _ in range(50):
            u, v = r.uniform(0, 1, 2)
            rows.append((len(rows), *((float(cx), float(u), float(v)) if up else (float(cx + u), float(v), 0.0)), plane))
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, plane long")
    m = statistics.component_moments(points.drop("plane"), points.select("id", F.col("plane").alias("label")))
    planes = m.withColumnsRenamed({"label": "plane", **{f"mean_{a}": f"m{a}" for a in "xyz"}})
    pairs = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (3, 4, 0.5), (2, 5, 0.1)], "a long, b long, cost double")
    got = {q.plane: q.joined for q in choices.joined_planes(planes, pairs, 0.05).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    assert {q.plane: q.joined for q in choices.joined_planes(planes, pairs, 0.12, 60).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: None}
    assert sorted(q.plane for q in choices.joined_planes(planes, pairs.limit(0), 0.05).collect()) == list(range(6))


def test_factors_of_some_rows(spark):
    from voxelmill.operators import neighbours

    p = points_of(spark, np.random.default_rng(1).normal(size=(80, 3)))
    whole = {(q.id, q.k): round(q.lof, 9) for q in neighbours.outlier_factors(p, (3, 6)).collect()}
    some = {(q.id, q.k): round(q.lof, 9) for q in neighbours.outlier_factors(p, (3, 6), p.filter("id % 9 = 0")).collect()}
    assert some == {k: v for k, v in whole.items() if k[0] % 9 == 0} and len(some) == 18


def test_class_view(spark):
    good = spark.createDataFrame([(True, False, True), (True, True, False), (False, False, False)], "sor_keep boolean, rejected boolean, keep boolean")
    assert sorted(q["class"] for q in audits.class_view(good).collect()) == ["distance", "geometry", "kept"]
    with pytest.raises(Exception, match="its parts say"):
        audits.class_view(good.withColumn("keep", F.lit(True))).collect()


def test_cache(spark):
    made = []

    def make(df, k):
        made.append(k)
        return df.withColumn("y", F.col("x") * k)

    df = spark.createDataFrame([(i,) for i in range(9)], "x long")
    for table, k, version, there in ((df, 2, "1", False), (df.repartition(3).orderBy(F.desc("x")), 2, "1", True), (df, 3, "1", False), (df, 2, "2", False), (df.filter("x < 8"), 2, "1", False)):
        out, found = cache.cached(table, "test", {"k": k}, version, make)
        assert found == there and sorted(q.y for q in out.collect()) == [k * i for i in range(out.count())]
    assert made == [2, 3, 2, 2]


def test_frames(spark):
    depth = np.array([[0, 1500], [2500, 65535]], ">u2")
    padded = b"".join(row.tobytes() + b"##" for row in depth)
    rows = [(padded, "16UC1", 2, 2, 6, True), (bytes(range(6)), "bgr8", 2, 1, 6, False), (np.array([1.0, np.nan], "<f4").tobytes(), "32FC1", 2, 1, 8, False)]
    table = spark.createDataFrame(rows, "data binary, encoding string, width int, height int, stride int, big boolean")
    got = [q.pixels for q in frames.images(table).collect()]
    assert sorted(got, key=len) == sorted([[float("inf"), 1.5, 2.5, 65.535], [2.0, 1.0, 0.0, 5.0, 4.0, 3.0], [1.0, float("inf")]], key=len)
    for bad in ((b"1", "mono8", 2, 1, 2, False), (b"12", "what", 2, 1, 2, False), (b"12", "mono8", 2, 1, 1, False)):
        with pytest.raises(ValueError):
            frames.decoded(*bad)
    scan = spark.createDataFrame([([0.1, 1.0, None, float("nan"), 9.0],)], "r array<double>")
    assert scan.select(frames.ranges("r", 0.5, 5.0).alias("r")).first().r == [float("inf"), 1.0, float("inf"), float("inf"), float("inf")]


def test_command_line(spark, tmp_path, capsys):
    assert main([]) == 0 and "voxel_counts" in capsys.readouterr().out.split()
    spark.range(20).selectExpr("id AS event_id", "id % 3 AS user_id", "'click' AS event_type", "90.0 + id AS value").write.parquet(f"file://{tmp_path}/events.parquet")
    assert main(["union_all", "--tables", f"file://{tmp_path}", "--out", f"file://{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 40
    with pytest.raises(SystemExit):
        main(["union_all"])
