"""Triangle meshes as tables: faces (face, owner, a, b, c) over vertices (id, x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored
from . import graphs
from .attributes import cross, dot
from .cells import AXES


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """faces with ax ... cz, the places of their corners; a face with an unknown vertex drops out."""
    out = faces
    for c in "abc":
        out = out.join(vertices.select(F.col("id").alias(c), *[F.col(a).alias(f"{c}{a}") for a in AXES]), c)
    return out


def _sides():
    a, b, c = ([F.col(f"{k}{x}") for x in AXES] for k in "abc")
    return a, [y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, c, strict=True)]


def shapes(cornered: DataFrame) -> DataFrame:
    """Faces with area, unit normal nx, ny, nz (null for an area of 0), centroid mx, my, mz, and volume: that of the tetrahedron with the
    origin, whose sum over a closed surface is its volume."""
    a, u, v = _sides()
    n = cross(u, v)
    length = F.sqrt(dot(n, n))
    b, c = [F.col(f"b{x}") for x in AXES], [F.col(f"c{x}") for x in AXES]
    out = cornered.withColumns({"area": length / 2, **{f"n{x}": F.try_divide(k, length) for x, k in zip(AXES, n, strict=True)}, "volume": dot(a, cross(b, c)) / 6})
    return out.withColumns({f"m{x}": (F.col(f"a{x}") + F.col(f"b{x}") + F.col(f"c{x}")) / 3 for x in AXES})


def solids(cornered: DataFrame) -> DataFrame:
    """(owner, faces, area, volume)."""
    return shapes(cornered).groupBy("owner").agg(F.count(F.lit(1)).alias("faces"), F.sum("area").alias("area"), F.sum("volume").alias("volume"))


def edges(faces: DataFrame) -> DataFrame:
    """(owner, face, u, v) with u < v: the three edges of every face."""
    pairs = [("a", "b"), ("b", "c"), ("c", "a")]
    each = F.explode(F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in pairs]))
    return faces.select("owner", "face", each.alias("e")).select("owner", "face", "e.u", "e.v")


def multiplicities(faces: DataFrame) -> DataFrame:
    """(owner, u, v, n): how many faces of an owner share an edge; 1 is a boundary, above 2 is not manifold."""
    return edges(faces).groupBy("owner", "u", "v").agg(F.count(F.lit(1)).alias("n"))


def topology(faces: DataFrame) -> DataFrame:
    """(owner, vertices, edges, faces, euler, boundary, tangled) of each owner."""
    e = multiplicities(faces).groupBy("owner").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("n") == 1).alias("boundary"), F.count_if(F.col("n") > 2).alias("tangled"))
    v = faces.select("owner", F.explode(F.array("a", "b", "c")).alias("v")).distinct().groupBy("owner").agg(F.count(F.lit(1)).alias("vertices"))
    f = faces.groupBy("owner").agg(F.count(F.lit(1)).alias("faces"))
    return f.join(e, "owner").join(v, "owner").withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def edge_metrics(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(owner, step, slope): the greatest difference in height over an edge, and the greatest against its length in the plane; edges
    that stand upright have no slope."""
    ends = edges(faces)
    for c in "uv":
        ends = ends.join(vertices.select(F.col("id").alias(c), *[F.col(a).alias(f"{c}{a}") for a in AXES]), c)
    d = {a: F.col(f"v{a}") - F.col(f"u{a}") for a in AXES}
    step = F.abs(d["z"])
    return ends.groupBy("owner").agg(F.max(step).alias("step"), F.max(F.try_divide(step, F.sqrt(d["x"] * d["x"] + d["y"] * d["y"]))).alias("slope"))


def seams(vertices: DataFrame, scale: float) -> DataFrame:
    """(kx, ky, n, gap): places in the plane, rounded to 1 / scale, with several vertices, and their greatest difference in height."""
    key = [F.rint(F.col(a) * scale).cast("long").alias(f"k{a}") for a in "xy"]
    return vertices.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), (F.max("z") - F.min("z")).alias("gap")).filter("n > 1")


def footprints(points: DataFrame, label: str, size: float) -> DataFrame:
    """(label, cells, area, coverage): occupied cells in the plane, their area, and its share of the bounding box; null for a flat box."""
    cell = [F.floor(F.col(a) / size).alias(f"i{a}") for a in "xy"]
    c = points.groupBy(label, *cell).agg(*[f(a).alias(f"{n}{a}") for a in "xy" for f, n in ((F.min, "l"), (F.max, "u"))])
    c = c.groupBy(label).agg(F.count(F.lit(1)).alias("cells"), *[f(f"{n}{a}").alias(f"{n}{a}") for a in "xy" for f, n in ((F.min, "l"), (F.max, "u"))])
    area = F.col("cells") * (size * size)
    return c.select(label, "cells", area.alias("area"), F.try_divide(area, (F.col("ux") - F.col("lx")) * (F.col("uy") - F.col("ly"))).alias("coverage"))


def chunks(cornered: DataFrame, size: float, most: int) -> DataFrame:
    """(owner, gx, gy, chunk, n, bounds): runs of at most `most` faces of an owner in a square cell of their middle, in order of face,
    with their bounding box."""
    mid = shapes(cornered).withColumns({f"g{a}": F.floor(F.col(f"m{a}") / size) for a in "xy"})
    w = Window.partitionBy("owner", "gx", "gy").orderBy("face")
    at = mid.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / most))
    bounds = [f(*[F.col(f"{c}{a}") for c in "abc"]) for a in AXES for f in (F.least, F.greatest)]
    names = [f"{n}{a}" for a in AXES for n in ("l", "u")]
    return at.groupBy("owner", "gx", "gy", "chunk").agg(F.count(F.lit(1)).alias("n"), *[(F.min if n[0] == "l" else F.max)(b).alias(n) for n, b in zip(names, bounds, strict=True)])


def shared_vertices(faces: DataFrame) -> DataFrame:
    """(v, owners): vertices that faces of several owners use."""
    v = faces.select("owner", F.explode(F.array("a", "b", "c")).alias("v")).distinct()
    return v.groupBy("v").agg(F.count(F.lit(1)).alias("owners")).filter("owners > 1")


def frozen_faces(faces: DataFrame) -> DataFrame:
    """Faces that touch a shared vertex, which must not be moved."""
    shared = shared_vertices(faces).select("v")
    touched = faces.select("face", F.explode(F.array("a", "b", "c")).alias("v")).join(shared, "v", "left_semi").select("face").distinct()
    return faces.join(touched, "face", "left_semi")


def owned_faces(cornered: DataFrame, size: float) -> DataFrame:
    """Faces with tx, ty: the half-open tile of their middle, so that each has one owner."""
    return shapes(cornered).withColumns({f"t{a}": F.floor(F.col(f"m{a}") / size) for a in "xy"})


def supported(cornered: DataFrame, normals: DataFrame, longest: float, facing: float, pair: float, least: float) -> DataFrame:
    """(face, reason) by support gates: 'area' (below least), 'edge' (a side above longest), 'facing' (the face's normal against a corner's
    below facing), 'pair' (two corners' normals against each other below pair), or 'kept'; the first that holds."""
    n = cornered
    for c in "abc":
        n = n.join(normals.select(F.col("id").alias(c), *[F.col(f"n{a}").alias(f"{c}n{a}") for a in AXES]), c)
    own = shapes(n)
    of = lambda c: [F.col(f"{c}n{a}") for a in AXES]
    side = lambda p, q: F.sqrt(dot(d := [F.col(f"{p}{a}") - F.col(f"{q}{a}") for a in AXES], d))
    faces_ = F.least(*[F.abs(dot([F.col(f"n{a}") for a in AXES], of(c))) for c in "abc"])
    pairs = F.least(dot(of("a"), of("b")), dot(of("b"), of("c")), dot(of("c"), of("a")))
    reason = F.when(F.col("area") * 2 < least, "area").when(F.greatest(side("a", "b"), side("b", "c"), side("c", "a")) > longest, "edge")
    reason = reason.when(F.coalesce(faces_ < facing, F.lit(True)), "facing").when(F.coalesce(pairs < pair, F.lit(True)), "pair").otherwise("kept")
    return own.select("face", "owner", reason.alias("reason"))


def face_components(faces: DataFrame) -> DataFrame:
    """(face, component): the least face that ways over shared vertices (a, b, c) reach, itself included. The graph is that of the vertices, so
    a vertex of many faces is one node, and faces are only aggregated and joined."""
    sides = F.explode(F.array(*[F.struct(F.col(p).alias("src"), F.col(q).alias("dst")) for p, q in (("a", "b"), ("b", "c"))])).alias("s")
    of = stored(graphs.labelled(faces.select("a").distinct(), "a", faces.select(sides).select("s.*").distinct()), "vertices")
    least = faces.join(of, "a").groupBy("component").agg(F.min("face").alias("__least"))
    names = stored(of.join(least, "component").select("a", F.col("__least").alias("component")), "names")
    return faces.select("face", "a").join(names, "a", "left").select("face", F.coalesce("component", "face").alias("component"))
