"""Rules against plain versions: neighbours in cells, replies, votes by shape, choices in turn, point folders, published wholes."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import audits, cells, choices, joins, neighbours, shapes, statistics
from voxelmill.sources import folders, maps, pointfiles


def points_of(spark, p):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")


def clouds():
    r = np.random.default_rng(1)
    return [r.normal(0, 1, (90, 3)), np.concatenate([np.zeros((40, 3)), r.normal(0, 1, (30, 3)), [[900.0, 0, 0]]]), np.array([[float(x), float(y), 0] for x in range(8) for y in range(8)]), np.zeros((5, 3))]


@pytest.mark.parametrize("k", range(4))
def test_nearest_in_cells_and_compared(spark, k):
    p = clouds()[k]
    points = points_of(spark, p)
    want = set()
    for i, a in enumerate(p):
        d = [(float(np.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)), j) for j, b in enumerate(p) if j != i]
        want |= {(i, j, n + 1, x) for n, (x, j) in enumerate(sorted(d)[:6])}
    assert {tuple(q) for q in neighbours.nearest(points, 6).collect()} == want
    assert {tuple(q) for q in neighbours.nearest(points, 6, few_points=0).collect()} == want


def test_points_go_only_where_somebody_looks(spark):
    """At no level but those in use does a point meet anybody."""
    p = points_of(spark, np.random.default_rng(2).uniform(0, 1, (3000, 3)))
    low, deepest = {a: 0.0 for a in "xyz"}, 6
    levels = neighbours._fitting(p, 5, low, 1.0, deepest).agg(F.min("level"), F.max("level")).first()
    assert 2 <= levels[0] and levels[1] <= 4
    assert neighbours.nearest(points_of(spark, []), 3, few_points=0).count() == 0 == neighbours.nearest(points_of(spark, []), 3).count()


def test_equal_requests_stay_apart(spark):
    asked = [("a", 10), ("a", 10), ("a", 10), ("a", 95), ("b", 1), (None, 3), ("c", None), ("a", -7)]
    given = [("a", 10), ("a", 12), ("a", 104), ("b", 50), (None, 4), ("a", -3)]
    frame = lambda rows: spark.createDataFrame(rows, "k string, t long")
    got = joins.replies(frame(asked), frame(given), "k", "t", 9).collect()
    want = [(k, t, min((u for j, u in given if j == k and k is not None and t is not None and t <= u <= t + 9), default=None)) for k, t in asked]
    assert sorted(map(str, got)) == sorted(map(str, (spark.createDataFrame([(*w, w[2] is not None) for w in want], "k string, t long, answer long, timely boolean").collect())))
    assert joins.replies(frame(asked), frame(given), "k", "t", 0).filter("timely").count() == 3


def test_iterative_outliers_stop_with_few_points(spark):
    folders.shared(spark)
    p = np.concatenate([np.random.default_rng(0).normal(0, 0.1, (5, 3)), [[50.0, 0, 0]]])
    got = statistics.iterative_outliers(points_of(spark, p), 5, 0.5, 4, neighbours.outlier_factors).collect()
    assert len(got) == 6 and {q["pass"] for q in got} <= {None, 1}
    with pytest.raises(ValueError):
        statistics.iterative_outliers(points_of(spark, p[:5]), 5, 1.5, 4, neighbours.outlier_factors)


def plain_vote(places, least):
    """One neighbourhood: whether its places make a line or a plane through two cuts, and whether the origin lies on it."""
    kept, kind = np.unique(places, axis=0), None
    for turn in range(3):
        if len(kept) < least:
            return False, False
        middle = kept.mean(0)
        values, axes = np.linalg.eigh(np.cov((kept - middle).T, bias=True))
        a, b, c = np.maximum(values, 0)
        now = "line" if c >= 0.03**2 and b <= 0.03 * c else "plane" if b >= 0.03**2 and b >= 0.05 * c and a <= 0.1 * b else None
        if now is None or turn and now != kind:
            return False, False
        kind = now
        off = axes[:, :2] if kind == "line" else axes[:, :1]
        away = np.linalg.norm((kept - middle) @ off, axis=1)
        if turn < 2:
            kept = kept[np.argsort(away, kind="stable")[: math.floor(len(kept) * 0.8)]]
    m = np.median(away)
    limit = min(max(m + 3 * 1.4826 * np.median(np.abs(away - m)), 0.03), 0.12)
    return True, bool(np.linalg.norm(middle @ off) <= limit)


def test_votes_by_shape(spark):
    r = np.random.default_rng(7)
    flat = np.c_[r.uniform(0, 3, (160, 2)), r.normal(0, 0.004, 160)]
    line = np.c_[r.uniform(5, 9, 80), np.full((80, 2), 1.0) + r.normal(0, 0.003, (80, 2))]
    blob, dots, twins = r.normal(0, 0.3, (60, 3)) + [0, 9, 0], np.repeat(r.normal(0, 0.01, (4, 3)) + [9, 9, 9], 6, 0), np.repeat(flat[:5], 3, 0)
    p = np.concatenate([flat, line, blob, dots, twins, [[1.5, 1.5, 0.3], [7.0, 1.2, 1.0]]])
    points, scales = points_of(spark, p), ((12, 0.4), (32, 0.6), (64, 1.0))
    keep = points.select("id", (F.col("id") % 41 != 3).alias("keep"))
    some = points.filter("id % 2 = 0 or id >= 300").select("id")
    got = {q.id: (q.supported, q.consistent, q.rejected) for q in shapes.geometric_outliers(points, keep, scales, candidates=some).collect()}
    left = [i for i in range(len(p)) if i % 41 != 3]
    want = {}
    for i in left:
        if i % 2 == 0 or i >= 300:
            near = sorted((float(np.sqrt(((p[j] - p[i]) ** 2).sum())), j) for j in left if j != i)
            votes = [plain_vote(np.array([p[j] - p[i] for d, j in near[:k] if d <= radius]).reshape(-1, 3), 6) for k, radius in scales]
            s, c = sum(v[0] for v in votes), sum(v[1] for v in votes)
            want[i] = (s, c, s >= 2 and c == 0)
    assert got == want
    assert sum(v[2] for v in want.values()) >= 1 and {v[0] for v in want.values()} >= {0, 1, 2, 3}


@pytest.mark.parametrize("most", [0, 3, 10**6])
def test_choices_in_turn(spark, most):
    folders.shared(spark)
    r = np.random.default_rng(most % 7)
    order = [int(x) for x in r.integers(0, 9, 60)]
    pairs = [(i, i + 1) for i in range(20)] + [tuple(map(int, r.choice(np.arange(25, 60), 2, replace=False))) for _ in range(25)]
    got = choices.unsuppressed(spark.createDataFrame([(i, float(o)) for i, o in enumerate(order)], "item long, order double"), spark.createDataFrame([*pairs, (1, 0)], "a long, b long"), most)
    kept = set()
    for i in sorted(range(60), key=lambda i: (order[i], i)):
        if not any((i, j) in pairs or (j, i) in pairs for j in kept):
            kept.add(i)
    assert {q.item: q.kept for q in got.collect()} == {i: i in kept for i in range(60)}


def test_first_and_middle_rows_of_cells(spark):
    p = np.random.default_rng(3).uniform(0, 2, (200, 3))
    points = points_of(spark, p).withColumn("more", F.col("id") * 2)
    for middle in (False, True):
        got = {q.id: q for q in cells.pick_in_cell(points, 0.5, ["z", "id"], middle).collect()}
        of = {}
        for i, a in enumerate(p):
            of.setdefault(tuple(np.floor(a * 2).astype(int)), []).append((a[2], i))
        assert set(got) == {sorted(c)[len(c) // 2 if middle else 0][1] for c in of.values()}
        assert all(q.more == 2 * i and (q.x, q.y) == (p[i][0], p[i][1]) for i, q in got.items())


# Point folders


def pcd(path, rows, text, fields="x y z ring", types="F F F U", sizes="4 4 8 2"):
    head = f"# .PCD\nVERSION 0.7\nFIELDS {fields}\nSIZE {sizes}\nTYPE {types}\nWIDTH {len(rows)}\nHEIGHT 1\nPOINTS {len(rows)}\nDATA {'ascii' if text else 'binary'}\n"
    body = "".join(" ".join(map(repr, r)) + "\n" for r in rows).encode() if text else np.array(rows, "<f4,<f4,<f8,<u2").tobytes()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(head.encode() + body)


def test_folders_and_patterns(spark, tmp_path):
    pointfiles.register(spark)
    made = {}
    for name, n, text in (("a/one.pcd", 50, True), ("a/two.pcd", 70, False), ("b/three.PCD", 0, False), ("b/four.pcd", 33, True)):
        made[name] = [(i / 4, -i / 8, i / 3, i) for i in range(n)]
        pcd(tmp_path / name, made[name], text)
    (tmp_path / "a/notes.txt").write_text("none")
    for split in (100, 10_000):
        got = pointfiles.open_points(spark, str(tmp_path), split=split).collect()
        assert sorted((q.file[len(str(tmp_path)) + 1 :], q.row, *q[:4]) for q in got) == sorted((f, i, *r) for f, rows in made.items() for i, r in enumerate(rows))
    plain = spark.read.format("pcd").option("split", 90).load(str(tmp_path)).collect()
    assert sorted(map(str, plain)) == sorted(map(str, got))
    some = pointfiles.open_points(spark, f"{tmp_path}/*/[ot]*.pcd", ["z", "x"], 64)
    assert some.columns == ["z", "x", "row", "file"] and some.count() == 120
    one = pointfiles.open_points(spark, str(tmp_path / "a/one.pcd"))
    assert "file" not in one.columns and one.count() == 50
    with pytest.raises(Exception, match="no such field"):
        pointfiles.open_points(spark, str(tmp_path), ["w"]).count()
    with pytest.raises(Exception, match="no .ply file"):
        pointfiles.open_points(spark, f"{tmp_path}/none*.ply").count()
    (tmp_path / "a/one.pcd").write_bytes((tmp_path / "a/one.pcd").read_bytes() + b"1 2 3 4\n")
    with pytest.raises(ValueError, match="the header says 50 rows, there are 51"):
        pointfiles.open_points(spark, str(tmp_path), split=100)
    pcd(tmp_path / "a/one.pcd", [(0.0, 0.0, 0.0, 1)], True, fields="x y z line")
    with pytest.raises(Exception, match="other fields"):
        pointfiles.open_points(spark, str(tmp_path)).count()


def test_the_driver_reads_headers_only(spark, tmp_path, monkeypatch):
    """Planning opens a file once, for its header."""
    rows = [(1.0, 2.0, 3.0, 4)] * 400
    pcd(tmp_path / "a.pcd", rows, True)
    read = []
    monkeypatch.setattr(pointfiles, "_lines_of", lambda *a: read.append(a))
    source = pointfiles.PcdSource({"path": str(tmp_path), "split": "100"})
    pieces = source.reader(None).partitions()
    assert len(pieces) > 10 and not read and [p.last_one for p in pieces] == [False] * (len(pieces) - 1) + [True]


def test_views_of_a_cloud(spark):
    rows = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 0.0, 0.0, 2.0, 51.0), (1, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 255.0)], "row long, x float, y float, z float, normal_x float, normal_y float, normal_z float, intensity float")
    a, b = pointfiles.cloud(rows).orderBy("row").collect()
    assert (a.nz, a.valid, round(a.red, 9)) == (1.0, True, 0.2) and (b.nz, b.valid, b.blue) == (None, False, 1.0)
    bare = pointfiles.cloud(rows.select("x", "y", "z")).first()
    assert bare.nx is None and bare.green == 0.65
    painted = pointfiles.cloud(rows.select("x", "y", "z", F.lit(255).alias("red"), F.lit(0).alias("green"), F.lit(51).alias("blue"))).first()
    assert (painted.red, painted.green, painted.blue) == (1.0, 0.0, 0.2)
    with pytest.raises(Exception, match="not finite"):
        pointfiles.cloud(rows.withColumn("x", F.lit(1e300))).collect()
    with pytest.raises(ValueError):
        pointfiles.cloud(rows.drop("z"))


# Published wholes


def test_published_filter_and_thresholds(spark, tmp_path):
    folders.shared(spark)
    r = np.random.default_rng(6)
    p = np.concatenate([r.normal(0, 0.3, (150, 3)), [[30.0, 0, 0]]])
    points = points_of(spark, p).withColumn("ring", F.col("id") % 4)
    judged = neighbours.statistical_outliers(neighbours.mean_distances(points, 8), 2.0)
    path, out = str(tmp_path / "filter"), str(tmp_path / "cells")
    report = maps.publish_filter(points, judged, path, {"neighbors": 8, "ratio": 2.0}, 2.0)
    d = np.sort([q.mean_dist for q in judged.collect()])
    assert report["records"] == 151 and report["removed"] >= 1 and report["retained"] + report["removed"] == 151
    assert np.allclose(report["quantiles"], np.quantile(d, maps.LEVELS)) and report["histogram"] == np.histogram(d, 64)[0].tolist()
    assert math.isclose(report["threshold"], d.mean() + 2 * d.std(ddof=1)) and maps.read_report(spark, path) == json.loads(json.dumps(report))
    assert spark.read.parquet(f"{path}/records").count() == 151 and spark.read.parquet(f"{path}/decisions").filter("keep").count() == report["retained"]
    got = maps.publish_thresholds(spark, path, out, 0.25, (1, 2))
    kept = {q.id for q in judged.filter("keep").collect()}
    of = {}
    for i in kept:
        of.setdefault(tuple(np.floor(p[i] * 4).astype(int)), []).append(i)
    for mode, t in zip(got["modes"], (0, 1, 2), strict=True):
        n = [len(c) for c in of.values() if len(c) > t]
        assert (mode["kept"], mode["cells"], mode["removed"]) == (sum(n), len(n), len(kept) - sum(n)) and mode["middle"] == (np.median(n) if n else None)
    flags = {q.id: (q.n, q.keep_1, q.keep_2) for q in spark.read.parquet(f"{out}/decisions").collect()}
    assert flags == {i: (n, n > 1, n > 2) for c in of.values() for i in c for n in (len(c),)} | {i: (0, False, False) for i in range(151) if i not in kept}
    assert spark.read.option("header", True).csv(f"{out}/frequencies/cells_1").count() == len({len(c) for c in of.values() if len(c) > 1})
    with pytest.raises(ValueError, match="holds something"):
        maps.publish_filter(points, judged, path, {}, 2.0)
    with pytest.raises(ValueError, match="same ids"):
        maps.publish_filter(points, judged.filter("id > 3"), str(tmp_path / "other"), {}, 2.0)


def test_a_map_is_judged_as_a_whole(spark, tmp_path):
    r = np.random.default_rng(8)
    points = points_of(spark, r.uniform(-4, 4, (60, 3))).withColumn("ring", F.col("id") % 3)
    faces = spark.createDataFrame([(k, *map(int, r.choice(60, 3, replace=False))) for k in range(40)], "face long, a long, b long, c long")
    path = str(tmp_path / "map")
    summary = maps.write_map(points, faces, 2.0, path)
    good = maps.verify_map(spark, path, 2.0).first()
    assert good.passed and (good.records, good.triangles) == (60, 40) and summary == {c: good[c] for c in audits.TOTALS}
    with pytest.raises(ValueError, match="holds something"):
        maps.write_map(points, faces, 2.0, path)
    load = lambda n: spark.read.parquet(f"{path}/{n}")
    parts = {n: load(n) for n in ("source", "tiles", "faces", "reports", "bounds")}
    parts["tiles"] = parts["tiles"].withColumns({t: F.col(t).cast("long") for t in ("tx", "ty")})
    said = spark.createDataFrame([tuple(summary[c] for c in audits.TOTALS)], ", ".join(f"{c} long" for c in audits.TOTALS))
    first = parts["bounds"].orderBy("tx", "ty").first()
    here = (F.col("tx") == first.tx) & (F.col("ty") == first.ty)
    faults = {
        "missing": {"tiles": parts["tiles"].filter("id <> 5")}, "doubled": {"tiles": parts["tiles"].unionByName(parts["tiles"].filter("id = 7"))}, "altered": {"tiles": parts["tiles"].withColumn("ring", F.when(F.col("id") == 9, 8).otherwise(F.col("ring")))},
        "strange": {"tiles": parts["tiles"].withColumn("id", F.when(F.col("id") == 9, 999).otherwise(F.col("id")))}, "misplaced": {"tiles": parts["tiles"].withColumn("tx", F.when(F.col("id") == 9, 50).otherwise(F.col("tx")))},
        "strange_corners": {"faces": parts["faces"].withColumn("b", F.when(F.col("face") == 3, 5000).otherwise(F.col("b")))}, "foreign": {"faces": parts["faces"].withColumn("ty", F.when(F.col("face") == 3, 40).otherwise(F.col("ty")))},
        "wrong_reports": {"reports": parts["reports"].withColumn("triangles", F.col("triangles") + here.cast("int"))}, "wrong_bounds": {"bounds": parts["bounds"].filter(~here)}, "outside": {"bounds": parts["bounds"].withColumn("uz", F.when(here, F.col("uz") - 0.001).otherwise(F.col("uz")))},
        "wrong_totals": {"summary": said.withColumn("mesh_vertices", F.col("mesh_vertices") + 1)},
    }
    for rule, changed in faults.items():
        args = parts | {"summary": said} | changed
        got = audits.map_audit(*(args[n] for n in ("source", "tiles", "faces", "reports", "bounds", "summary")), 2.0).first()
        assert got[rule] >= 1 and not got.passed, rule
    with pytest.raises(ValueError, match="needs rows"):
        maps.write_map(points.limit(0), faces, 2.0, str(tmp_path / "none"))
