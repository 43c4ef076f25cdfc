"""Point files, streaming forms and the passes of outlier factors, each against a plain version."""

import datetime
import json
import struct

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from voxelmill import functions
from voxelmill.functions import formats
from voxelmill.operators import cells, motion, neighbours, shapes, statistics
from voxelmill.sources import folders, pointfiles, records, sinks
from voxelmill.streaming import control

DIR = "/root/testdata/sf0.001"


def _pcd(path, rows, text, more=""):
    head = f"# .PCD\nVERSION 0.7\nFIELDS x y z ring\nSIZE 4 4 8 2\nTYPE F F F U\n{more}WIDTH {len(rows)}\nHEIGHT 1\nPOINTS {len(rows)}\nDATA {'ascii' if text else 'binary'}\n"
    body = "".join(f"{x!r} {y!r} {z!r} {k}\n" for x, y, z, k in rows).encode() if text else np.array(rows, "<f4,<f4,<f8,<u2").tobytes()
    path.write_bytes(head.encode() + body)
    return str(path)


@pytest.mark.parametrize("text", [True, False])
@pytest.mark.parametrize("n", [0, 1, 500])
def test_pcd(spark, tmp_path, text, n):
    pointfiles.register(spark)
    rows = [(i / 4, -i / 8, i / 3, i % 60000) for i in range(n)]
    df = spark.read.format("pcd").option("split", 700).load(_pcd(tmp_path / "a.pcd", rows, text))
    got = df.collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(rows)
    assert [tuple(r)[:4] for r in sorted(got, key=lambda r: r.row)] == rows and sorted(r.row for r in got) == list(range(n))


def test_pcd_refused(spark, tmp_path):
    for more in ("SIZE 4 4 8 2\n", "COUNT 1 1 1\n"):
        with pytest.raises(ValueError), open(_pcd(tmp_path / "b.pcd", [(0.0, 0.0, 0.0, 1)], False, more), "rb") as f:
            pointfiles.pcd_header(f)


def test_ply(spark, tmp_path):
    pointfiles.register(spark)
    rows = np.array([(i, i / 2, i % 256) for i in range(300)], ">f4,>f8,u1")
    (tmp_path / "c.ply").write_bytes(b"ply\nformat binary_big_endian 1.0\nelement vertex 300\nproperty float x\nproperty double y\nproperty uchar red\nend_header\n" + rows.tobytes())
    got = spark.read.format("ply").option("split", 1000).load(str(tmp_path / "c.ply")).orderBy("row").collect()
    assert [tuple(r)[:3] for r in got] == [tuple(r) for r in rows.tolist()]


def _streamed(spark, tmp_path, batches, schema, of):
    """All output rows of a stream whose files come one a batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/*")
    q = of(source).writeStream.outputMode("append").format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table("out").collect()]


def test_watchdog(spark, tmp_path):
    rows = [("a", 0.0, "command", 3.0), ("a", 0.1, "sample", 0.0), ("a", 0.2, "enable", 1.0), ("a", 0.3, "sample", 0.0), ("a", 0.4, "command", 3.0), ("a", 0.9, "sample", 0.0), ("a", 0.91, "sample", 0.0)]
    got = _streamed(spark, tmp_path, [rows], "k string, time double, kind string, value double", lambda s: control.watchdog(s, "k", 0.5, 1.0, None))
    assert sorted(got) == [("a", 0.1, 0.0), ("a", 0.3, 0.0), ("a", 0.9, 1.0), ("a", 0.91, 0.0)]


def test_throttled_and_newer(spark, tmp_path):
    rows = [("a", t / 8) for t in range(16)]
    got = _streamed(spark, tmp_path, [rows], "k string, time double", lambda s: control.throttled(s, "k", 4.0, None))
    assert sorted(t for _, t in got) == [t / 8 for t in range(0, 16, 2)]
    (tmp_path / "n").mkdir()
    got = _streamed(spark, tmp_path / "n", [[*rows, ("a", 0.0), ("b", 0.0)]], "k string, time double", lambda s: control.newer(s, "k", None))
    assert sorted(got) == sorted([*rows, ("b", 0.0)])


def test_onsets(spark, tmp_path):
    seconds = [0, 1, 3, 10, 11, 400]
    rows = [("a", float(t)) for t in seconds]
    got = _streamed(spark, tmp_path, [rows, [("z", 9000.0)]], "k string, s double", lambda s: control.onsets(s.withColumn("ts", F.timestamp_seconds("s")), "k", "ts", "5 seconds", "1 second").select("k", F.unix_seconds("onset"), "contacts"))
    assert {g for g in got if g[0] == "a"} == {("a", 0, 3), ("a", 10, 2), ("a", 400, 1)}


def test_iterative_outliers(spark):
    folders.shared(spark)
    r = np.random.default_rng(1)
    rows = [(i, *map(float, p)) for i, p in enumerate(np.concatenate([r.normal(0, 1, (60, 3)), r.normal(0, 1, (3, 3)) * 30]))]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = {q.id: q["pass"] for q in statistics.iterative_outliers(points, 5, 1.5, 2, neighbours.outlier_factors).collect()}
    first = {q.id for q in neighbours.outlier_factors(points, (5,)).collect() if q.lof > 1.5}
    left = points.filter(~F.col("id").isin(sorted(first)))
    second = {q.id for q in neighbours.outlier_factors(left, (5,)).collect() if q.lof > 1.5}
    assert {i for i, p in got.items() if p == 1} == first and {i for i, p in got.items() if p == 2} == second
    assert len(got) == len(rows) and first


def test_rows_are_counted(spark, tmp_path):
    pointfiles.register(spark)
    rows = [(1.0, 2.0, 3.0, 4)] * 50
    for change in (lambda b: b.rsplit(b"\n", 2)[0] + b"\n", lambda b: b + b"1 2 3 4\n"):
        path = tmp_path / "d.pcd"
        _pcd(path, rows, True)
        path.write_bytes(change(path.read_bytes()))
        with pytest.raises(Exception, match="the header says 50 rows"):
            spark.read.format("pcd").option("split", 100).load(str(path)).count()
    path = tmp_path / "e.pcd"
    _pcd(path, rows, False)
    path.write_bytes(path.read_bytes() + b"\0" * 4096)
    assert spark.read.format("pcd").load(str(path)).count() == 50
    path.write_bytes(path.read_bytes() + b"x")
    with pytest.raises(Exception, match="other than zeros"):
        spark.read.format("pcd").load(str(path)).count()


def test_text_rows_keep_their_place(spark, tmp_path):
    """Blank lines count for nothing, wherever a range is cut."""
    pointfiles.register(spark)
    rows = [(i / 4, -i / 8, i / 3, i) for i in range(60)]
    path = tmp_path / "f.pcd"
    _pcd(path, rows, True)
    head, _, body = path.read_bytes().partition(b"DATA ascii\n")
    lines = body.split(b"\n")
    path.write_bytes(head + b"DATA ascii\n" + b"\n".join(x + b"\n  " * (i % 4) for i, x in enumerate(lines)))
    for split in (1, 7, 40, 10_000):
        got = spark.read.format("pcd").option("split", split).load(str(path)).orderBy("row").collect()
        assert [tuple(r)[:4] for r in got] == rows and [r.row for r in got] == list(range(60)), split


def test_npy(spark, tmp_path):
    records.register(spark)
    a = np.array([(i, i / 3, -i) for i in range(1000)], [("x", "<f8"), ("y", "<f4"), ("n", "<i8")])
    np.save(tmp_path / "a.npy", a)
    got = spark.read.format("npy").option("split", 3000).load(str(tmp_path / "a.npy")).orderBy("row").collect()
    assert [tuple(r) for r in got] == [(*t, i) for i, t in enumerate(a.tolist())]
    np.save(tmp_path / "b.npy", np.arange(12.0).reshape(4, 3))
    assert [tuple(r) for r in spark.read.format("npy").load(str(tmp_path / "b.npy")).orderBy("row").collect()] == [(3.0 * i, 3.0 * i + 1, 3.0 * i + 2, i) for i in range(4)]
    np.save(tmp_path / "c.npy", np.zeros((2, 2, 2)))
    for name, data in (("c", None), ("d", b"nothing"), ("e", (tmp_path / "a.npy").read_bytes()[:-1])):
        if data is not None:
            (tmp_path / f"{name}.npy").write_bytes(data)
        with pytest.raises(Exception):  # noqa: B017
            spark.read.format("npy").load(str(tmp_path / f"{name}.npy")).count()


def test_schemas(spark, tmp_path):
    fields = tuple((n, "f4") for n in records.XYZINORMAL)
    assert records.require_xyzinormal(pointfiles.Header(fields, 1, False, 0)).rows == 1
    for bad in (pointfiles.Header(fields, 1, True, 0), pointfiles.Header(fields[:-1], 1, False, 0), pointfiles.Header((("x", "f8"), *fields[1:]), 1, False, 0)):
        with pytest.raises(ValueError):
            records.require_xyzinormal(bad)
    df = spark.createDataFrame([(1, 2.0)], "id long, x double")
    assert records.require_columns(df, "id long, x double") is df
    with pytest.raises(ValueError):
        records.require_columns(df, "x double, id long")


def test_xml(spark, tmp_path):
    (tmp_path / "w.xml").write_text("<sdf><world><model name='a'><pose>1 2 3 0 0 0</pose><link><collision name='c'><geometry><box><size>4 5 6</size></box></geometry></collision></link></model></world></sdf>")
    assert [tuple(r) for r in records.read_boxes(spark, str(tmp_path / "w.xml")).collect()] == [("a", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)]
    (tmp_path / "v.xml").write_text("<sdf><model name='b'><pose>1 2 3</pose><link><collision name='c'><geometry><sphere>1</sphere></geometry></collision></link></model></sdf>")
    with pytest.raises(Exception, match="not a box"):
        records.read_boxes(spark, str(tmp_path / "v.xml")).collect()
    (tmp_path / "r.xml").write_text("<robot><joint name='j' type='revolute'><parent link='p'/><child link='q'/><limit lower='-1' upper='2'/></joint></robot>")
    assert [tuple(r) for r in records.read_joints(spark, str(tmp_path / "r.xml")).collect()] == [("j", "revolute", "p", "q", -1.0, 2.0)]


def test_bags(spark, tmp_path):
    def field_(name, value):
        return struct.pack("<I", len(name) + 1 + len(value)) + name + b"=" + value

    fields = field_(b"op", b"\x03") + field_(b"index_pos", struct.pack("<Q", 50)) + field_(b"conn_count", struct.pack("<I", 2)) + field_(b"chunk_count", struct.pack("<I", 1))
    good = b"#ROSBAG V2.0\n" + struct.pack("<I", len(fields)) + fields + b" " * 4096
    for name, data in (("a", good), ("b", b"#ROSBAG V1.2\n"), ("c", good[:30]), ("d", good[:40])):
        (tmp_path / f"{name}.bag").write_bytes(data)
    got = {r.path[-5]: (r.index_pos, r.conn_count, r.chunk_count, r.problem is None) for r in records.audit_bags(spark, str(tmp_path)).collect()}
    assert got == {"a": (50, 2, 1, True), "b": (None, None, None, False), "c": (None, None, None, False), "d": (None, None, None, False)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(float(i % 7), float(i % 3), float(i)) for i in range(200)], "x double, y double, z double")
    tiled = cells.tiles(rows, 2.0)
    back = sinks.write_tiles(tiled, 2.0, f"file://{tmp_path}/tiles", ["x", "y", "z"])
    assert sorted(map(tuple, back.select("x", "y", "z", "tx", "ty").collect())) == sorted(map(tuple, tiled.collect()))
    with pytest.raises(Exception):  # noqa: B017  (something is there)
        sinks.write_tiles(tiled, 2.0, f"file://{tmp_path}/tiles", ["x"])
    with pytest.raises(Exception, match="outside of its tile"):
        sinks.write_tiles(tiled.withColumn("tx", F.col("tx") + 1), 2.0, f"file://{tmp_path}/wrong", ["x"]).collect()
    assert json.loads(sinks.write_report(rows.agg(F.count("*").alias("n"), F.max("z").alias("top")), f"file://{tmp_path}/report")) == {"n": 200, "top": 199.0}
    with pytest.raises(ValueError):
        sinks.strict(rows.agg((F.max("z") * float("nan")).alias("bad")))
    sinks.write_frequencies(spark.createDataFrame([(2, 3, 1), (1, 5, 4)], "n long, before long, after long"), f"file://{tmp_path}/freq")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/freq").collect()] == [("1", "5", "4"), ("2", "3", "1")]
    for side, data in (("a", b"same"), ("b", b"same")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "f.bin").write_bytes(data)
    (tmp_path / "b" / "g.bin").write_bytes(b"more")
    assert [r.name for r in sinks.archive_matches(spark, f"{tmp_path}/a", f"{tmp_path}/b").collect()] == ["g.bin"]


def test_registry(spark):
    points = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(9)], "id long, x double, y double, z double")
    assert "nearest" in functions.names() and functions.support(spark, "nearest", points).supported
    assert functions.create(spark, "voxel_counts")(points, 2.0).count() == 5
    assert functions.support(spark, "nothing").problems == ["no such operator"]
    assert functions.support(spark, "nearest", points.drop("x")).problems == ["no column x"]
    with pytest.raises(ValueError, match="no column z"):
        functions.create(spark, "nearest")(points.drop("z"), 3)
    functions.operator("test_only")(lambda df: df)
    with pytest.raises(ValueError, match="name of its own"):
        functions.operator("test_only")(lambda df: df)


def _near(p, k):
    return {i: sorted((float(np.linalg.norm(p[i] - p[j])), j) for j in range(len(p)) if j != i)[:k] for i in range(len(p))}


@pytest.mark.parametrize("name", ["cloud", "outlier", "copies", "line", "few"])
def test_nearest(spark, name):
    r = np.random.default_rng(7)
    p = {"cloud": r.normal(size=(300, 3)), "outlier": np.concatenate([r.normal(size=(200, 3)) * 1e-3, [[1e6, 0, 0], [0, -1e5, 3]]]), "copies": np.concatenate([np.zeros((60, 3)), r.integers(0, 2, (60, 3)).astype(float)]),
         "line": np.stack([np.arange(150.0) ** 2, np.zeros(150), np.zeros(150)], axis=1), "few": r.normal(size=(4, 3))}[name]
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    got = {}
    for q in neighbours.nearest(points, 6).collect():
        got.setdefault(q.id, []).append((q["rank"], q.dist, q.nid))
    want = _near(p, 6)
    for i, near in want.items():
        assert [k for k, *_ in sorted(got[i])] == list(range(1, len(near) + 1))
        assert np.allclose([d for _, d, _ in sorted(got[i])], [d for d, _ in near], rtol=1e-9, atol=1e-9)
        if name in ("copies", "cloud"):
            assert [n for *_, n in sorted(got[i])] == [j for _, j in near]


def test_neighbours_refused(spark):
    few = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(5)], "id long, x double, y double, z double")
    with pytest.raises(ValueError, match="more than 5 points"):
        neighbours.mean_distances(few, 5)
    with pytest.raises(ValueError, match="more than 5 points"):
        neighbours.outlier_factors(few, (2, 5))
    for bad in (None, float("nan"), float("inf")):
        odd = few.unionByName(spark.createDataFrame([(9, bad, 0.0, 0.0)], few.schema))
        with pytest.raises(Exception, match="missing or not finite"):
            neighbours.nearest(odd, 2).collect()


def test_coincident_cloud(spark):
    """All in one place: every factor is one and every point is kept."""
    points = spark.createDataFrame([(i, -2.0, -2.0, -2.0) for i in range(37)], "id long, x double, y double, z double")
    assert {round(q.lof, 9) for q in neighbours.outlier_factors(points, (5, 9)).collect()} == {1.0}
    assert all(q.keep for q in neighbours.statistical_outliers(neighbours.mean_distances(points, 5), 3.0).collect())


def test_edge_features(spark):
    """A flat square: a boundary at its rim, none inside, no crease; two squares at a right angle: a crease where they meet."""
    flat = [(i * 20 + j, i * 0.1, j * 0.1, 0.0) for i in range(20) for j in range(20)]
    up = [(1000 + i * 20 + j, i * 0.1, 0.0, (j + 1) * 0.1) for i in range(20) for j in range(20)]
    points = spark.createDataFrame(flat + up, "id long, x double, y double, z double")
    got = {q.id: q for q in shapes.edge_flags(shapes.edge_features(points, 64, 0.25, 8, 0.03)).collect()}
    assert got[10 * 20 + 10].flags == 0 and got[10 * 20 + 10].variation < 1e-9
    assert got[10 * 20 + 19].flags & 1 and not got[10 * 20 + 19].flags & 2
    assert got[10 * 20 + 1].flags & 2


def test_island_classes(spark):
    r = np.random.default_rng(3)
    ground = [(x, y, 0.0) for x in np.arange(13) * 0.15 for y in np.arange(13) * 0.15]
    blob = (r.normal(size=(8, 3)) * 0.05 + [5, 5, 5]).tolist()
    patch = [(10 + i * 0.15, j * 0.15, 3.0) for i in range(4) for j in range(4)]
    line = [(20 + i * 0.1, 0.0, 4.0) for i in range(8)]
    near = [(1.0, 1.0, 0.3)]
    p = [*ground, *blob, *patch, *line, *near]
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    got = {q.label: q["class"] for q in shapes.island_classes(points, points.filter("id = 0"), (0.2, 0.25), 1.0, 0.4).collect()}
    n = len(ground)
    assert got[0] == 0 and got[n] == 1 and got[n + 8] == 2 and got[n + 24] == 2 and got[n + 32] == 2


def test_geometric_outliers(spark):
    """A plane with a point off it: scales agree on a plane that it doesn't lie on."""
    flat = [(i * 15 + j, i * 0.1, j * 0.1, 0.0) for i in range(15) for j in range(15)]
    points = spark.createDataFrame([*flat, (900, 0.75, 0.75, 0.3)], "id long, x double, y double, z double")
    keep = points.select("id", F.lit(True).alias("keep"))
    got = {q.id: q for q in shapes.geometric_outliers(points, keep, ((12, 0.4), (32, 0.6), (64, 1.0))).collect()}
    assert got[900].rejected and not got[7 * 15 + 7].rejected and got[7 * 15 + 7].consistent >= 2


def test_planes(spark):
    r = np.random.default_rng(2)
    xy = r.normal(size=(200, 2))
    points = spark.createDataFrame([(i, float(x), float(y), float(0.5 * x - 0.25 * y + 2), 1) for i, (x, y) in enumerate(xy)], "id long, x double, y double, z double, plane long")
    q = shapes.planes(points, "plane").first()
    n = np.array([-0.5, 0.25, 1.0]) / np.linalg.norm([-0.5, 0.25, 1.0])
    assert np.allclose([q.nx, q.ny, q.nz, q.offset], [*n, -2 * n[2]])


def test_residency(spark):
    """Enters within the radius, stays a little beyond it, looks again only after having moved far enough."""
    xs = [0.0, 4.0, 4.5, 9.0, 13.5, 15.0, 9.0]
    rows = spark.createDataFrame([("a", i, x, 0.0) for i, x in enumerate(xs)], "user_id string, us long, x double, y double")
    payloads = spark.createDataFrame([(1, 0.0, 0.0)], "payload long, px double, py double")
    got = [tuple(r) for r in motion.residency(rows, payloads, "user_id", ["us"], 10.0).collect()]
    want, last, since = [], None, None
    for i, x in enumerate(xs):
        if last is not None and abs(x - last) < 10 / 6:
            continue
        last = x
        if since is None and x <= 10:
            since = i
        elif since is not None and x > 10 + 20 / 6:
            want.append(("a", 1, since, i))
            since = None
    want += [("a", 1, since, None)] if since is not None else []
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 2


def test_settled_and_advances(spark, tmp_path):
    rows = [("a", t / 10, 0.0 if 3 <= t <= 8 else 1.0, 0.0) for t in range(12)]
    (tmp_path / "s").mkdir()
    got = _streamed(spark, tmp_path / "s", [rows], "k string, time double, linear double, angular double", lambda s: control.settled(s, "k", 0.015, 0.04, 0.25, None))
    assert sorted(round(t, 1) for _, t, *_ in got) == [0.6, 0.7, 0.8]
    (tmp_path / "a").mkdir()
    got = _streamed(spark, tmp_path / "a", [[("a", 1.0), ("a", 1.0), ("a", 2.0)]], "k string, time double", lambda s: control.advances(s, "k", 3, None))
    assert sorted(got) == [("a", 1.0), ("a", 2.0)]


def test_latest_wins(spark):
    points = spark.createDataFrame([(float(i % 5), 0.0, 0.0) for i in range(50)], "x double, y double, z double")
    mailbox = control.Latest(lambda size: cells.counts(points, size))
    ask = lambda *rows: [Row(revision=a, size=b, threshold=c) for a, b, c in rows]
    assert mailbox.answer(ask((1, 1.0, 5), (3, 1.0, 20), (2, 9.0, 0))).count() == 0
    assert mailbox.answer(ask((4, 1.0, 5))).count() == 5 and mailbox.made == 1
    assert mailbox.answer(ask((4, 2.0, 0))) is None and mailbox.made == 1
    assert mailbox.answer(ask((5, 2.0, 15))).count() == 2 and mailbox.made == 2


def test_stream_replies(spark, tmp_path):
    seconds = [("a", 0), ("b", 5), ("z", 900)]
    asked = spark.createDataFrame([(k, datetime.datetime.fromtimestamp(1000 + t, datetime.UTC)) for k, t in seconds], "k string, ts timestamp")
    told = spark.createDataFrame([(k, datetime.datetime.fromtimestamp(1000 + t, datetime.UTC)) for k, t in [("a", 3), ("b", 60), ("z", 901)]], "k string, ts timestamp")
    for name, df in (("q", asked), ("r", told)):
        df.coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
    q, r = (spark.readStream.schema("k string, ts timestamp").parquet(f"file://{tmp_path}/{n}") for n in ("q", "r"))
    out = control.replies(q, r, "k", "ts", "1 second", "10 seconds").writeStream.format("memory").queryName("replies").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = {x.k: x.answer is not None for x in spark.table("replies").collect()}
    assert got["a"] and got["z"] and not got.get("b", False)


def test_ingress_and_published(spark):
    rows = [("a", 0.0, '{"linear": 1, "angular": 2}'), ("a", 1.0, '{"linear": "x"}'), ("a", 2.0, "nothing"), ("a", 3.0, '{"linear": 1e999, "angular": 0}')]
    assert [tuple(r) for r in control.ingress(spark.createDataFrame(rows, "key string, time double, body string")).collect()] == [("a", 0.0, 1.0, 2.0)]
    points = spark.createDataFrame([(1.0, 1.0, 1.0), (None, 0.0, 0.0), (float("inf"), 0.0, 0.0), (0.0, float("nan"), 0.0)], "x double, y double, z double")
    assert control.published(points).count() == 1


def test_trace(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "n long, k string").write.parquet(f"file://{tmp_path}/in")
    for phase in ("one", "two"):
        source = spark.readStream.schema("n long, k string").parquet(f"file://{tmp_path}/in")
        control.traced(source, f"file://{tmp_path}/out", f"file://{tmp_path}/ck-{phase}", phase).awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [(1, "a", "one"), (1, "a", "two")]


def test_catalogue(spark, tmp_path):
    rows = [(1.0, 2.0, 3.0, 4)] * 5
    for name in ("a", "b", "c"):
        _pcd(tmp_path / f"{name}.pcd", rows, False)
    (tmp_path / "b.pcd").write_bytes((tmp_path / "b.pcd").read_bytes()[:-1])
    (tmp_path / "d.pcd").write_bytes(b"nothing")
    said = spark.createDataFrame([(str(tmp_path / f"{n}.pcd"), k) for n, k in (("a", 5), ("b", 5), ("c", 6), ("d", 5), ("e", 5))], "path string, rows long")
    got = {q.path[-5]: (q.found, q.problem) for q in records.audit_points(spark, said).collect()}
    assert got["a"] == (5, None) and got["b"] == (5, "the payload is cut") and got["c"] == (5, "the catalogue says otherwise") and got["d"][0] is got["e"][0] is None


def test_formats():
    way = [formats.Conversion("a", "b", 5), formats.Conversion("a", "c", 1), formats.Conversion("c", "b", 2), formats.Conversion("b", "d", 1), formats.Conversion("x", "d", 1)]
    assert formats.plan({"a"}, {"d"}, way) == [way[1], way[2], way[3]]
    assert formats.plan({"a", "d"}, {"d"}, way) == [] and formats.plan({"a", "x"}, {"d"}, way) == [way[4]]
    with pytest.raises(ValueError, match="no way"):
        formats.plan({"d"}, {"a"}, way)
