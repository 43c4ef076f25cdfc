"""Shape around points and of groups: moments, normals, edge features, contour features, islands, planes, curves, smoothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored
from . import crowds, joins, neighbours, statistics
from .attributes import dot, eigenvalues, oriented
from .cells import AXES, with_cells

_PAIRS = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]


def offsets(points: DataFrame, radius: float, k: int | None = None) -> DataFrame:
    """(id, oid, dist, dx, dy, dz): other rows within the closed radius, the k nearest of them if k is given."""
    own, others = points.select("id", *AXES), points.select(F.col("id").alias("oid"), *AXES)
    near = joins.within(own, others, radius).filter("id <> oid") if k is None else joins.nearest_within(own, others, radius, k, itself=False)
    return near.select("id", "oid", "dist", *[(F.col(f"o{a}") - F.col(a)).alias(f"d{a}") for a in AXES])


def moments(near: DataFrame, own: bool = False) -> DataFrame:
    """(id, n, mx, my, mz, cxx ... czz): number, mean and population covariance of the offsets of each id; own: the point itself, at no
    offset, is one of them."""
    m = near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"d{a}").alias(f"s{a}") for a in AXES], *[F.sum(F.col(f"d{a}") * F.col(f"d{b}")).alias(f"q{a}{b}") for a, b in _PAIRS])
    n = F.col("n") + (1 if own else 0)
    return m.select("id", "n", *[(F.col(f"s{a}") / n).alias(f"m{a}") for a in AXES], *[(F.col(f"q{a}{b}") / n - F.col(f"s{a}") / n * (F.col(f"s{b}") / n)).alias(f"c{a}{b}") for a, b in _PAIRS])


def _spectra(batches):
    """Adds the eigenvalues, falling, and the unit eigenvectors of the least and the greatest to rows of cxx ... czz."""
    for batch in batches:
        c = {p: batch.column(f"c{p[0]}{p[1]}").to_numpy(zero_copy_only=False) for p in _PAIRS}
        m = np.stack([[c[min(a, b), max(a, b)] for b in AXES] for a in AXES]).transpose(2, 0, 1) if batch.num_rows else np.zeros((0, 3, 3))
        ok = np.isfinite(m).all(axis=(1, 2))
        values, vectors = np.linalg.eigh(np.where(ok[:, None, None], m, 0.0))
        more = [*(values[:, 2 - i] for i in range(3)), *(vectors[:, i, 0] for i in range(3)), *(vectors[:, i, 2] for i in range(3))]
        names = ["l1", "l2", "l3", "nx", "ny", "nz", "ux", "uy", "uz"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.where(ok, v, np.nan)) for v in more]], names=[*batch.schema.names, *names])


def spectra(rows: DataFrame) -> DataFrame:
    """rows (..., cxx ... czz) with l1 >= l2 >= l3 and the axes of the least (nx, ny, nz) and the greatest (ux, uy, uz); one Arrow pass
    over rows that are few numbers each."""
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(_spectra, ", ".join([*columns, *[f"{n} double" for n in ("l1", "l2", "l3", "nx", "ny", "nz", "ux", "uy", "uz")]]))


def planes(points: DataFrame, label: str) -> DataFrame:
    """(label, n, nx, ny, nz, offset): the plane of each label's points: the axis of least spread, its largest component not negative,
    and the negative median of the points along it."""
    fit = oriented(spectra(statistics.component_moments(points.select("id", *AXES), points.select("id", F.col(label).alias("label")))), ("nx", "ny", "nz"))
    fit = fit.select(F.col("label").alias("__l"), "nx", "ny", "nz").withColumns({f"n{a}": F.col(f"n{a}") + 0.0 for a in AXES})
    at = points.join(fit, F.col(label) == F.col("__l"))
    along = dot([F.col(a) for a in AXES], [F.col(f"n{a}") for a in AXES])
    return at.groupBy(label, "nx", "ny", "nz").agg(F.count(F.lit(1)).alias("n"), (-F.median(along)).alias("offset"))


def edge_features(points: DataFrame, k: int = 64, radius: float = 0.3, least: int = 8, variation: float = 0.08) -> DataFrame:
    """(id, n, valid, variation, gap, crease) of points (id, x, y, z).

    variation: least eigenvalue's share of the spread of the neighbours and the point. A normal is valid with `least` neighbours
    or more and a variation up to the limit. gap: the widest angle in degrees without a neighbour around a point with a valid
    normal. crease: the third largest angle in degrees between the neighbours' valid normals and the axis that most of them share,
    among max(6, least) of them or more.
    """
    near = offsets(points, radius, k).checkpoint()
    m = spectra(moments(near, own=True)).withColumn("variation", F.try_divide(F.col("l3"), F.col("l1") + F.col("l2") + F.col("l3")))
    m = m.withColumn("valid", F.coalesce((F.col("n") >= least) & (F.col("variation") <= variation), F.lit(False))).checkpoint()
    good = m.filter("valid").select("id", "nx", "ny", "nz", "ux", "uy", "uz")
    flat = near.join(good, "id")
    v = [F.col("ny") * F.col("uz") - F.col("nz") * F.col("uy"), F.col("nz") * F.col("ux") - F.col("nx") * F.col("uz"), F.col("nx") * F.col("uy") - F.col("ny") * F.col("ux")]
    d = [F.col(f"d{a}") for a in AXES]
    flat = flat.withColumns({"p": dot(d, [F.col("ux"), F.col("uy"), F.col("uz")]), "q": dot(d, v)}).filter("p <> 0 OR q <> 0")
    gap = statistics.cyclic_gap(flat.select("id", F.degrees(F.atan2("q", "p")).alias("angle")), "angle")
    of = near.select("id", "oid").join(good.select(F.col("id").alias("oid"), "nx", "ny", "nz"), "oid")
    axis = spectra(of.groupBy("id").agg(*[F.sum(F.col(f"n{a}") * F.col(f"n{b}")).alias(f"c{a}{b}") for a, b in _PAIRS])).select("id", "ux", "uy", "uz")
    away = F.degrees(F.acos(F.least(F.abs(dot([F.col(f"n{a}") for a in AXES], [F.col(f"u{a}") for a in AXES])), F.lit(1.0))))
    crease = statistics.third_largest(of.join(axis, "id").withColumn("away", away), "away", max(6, least))
    out = points.select("id").join(m.select("id", "n", "valid", "variation"), "id", "left").join(gap, "id", "left").join(crease.withColumnRenamed("third", "crease"), "id", "left")
    return out.select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("valid", F.lit(False)).alias("valid"), "variation", "gap", "crease")


def edge_flags(features: DataFrame, gap: float = 135.0, crease: float = 35.0) -> DataFrame:
    """features with flags: 1 for a boundary (a gap that wide or wider), 2 for a crease (an angle that wide or wider), 3 for both."""
    bit = lambda c, least, b: F.when(F.col(c) >= least, b).otherwise(0)
    return features.withColumn("flags", bit("gap", gap, 1).bitwiseOR(bit("crease", crease, 2)))


def contour_features(points: DataFrame, radius: float, least: int = 6) -> DataFrame:
    """(id, n, shift, linearity, planarity, scattering, variation) from all distinct places within the radius, the own one among them;
    points with fewer than `least` others give nothing."""
    places = points.groupBy(*AXES).agg(F.min("id").alias("id")).select("id", *AXES)
    m = crowds.moments_within(places, radius).filter(F.col("n") >= least)
    big, mid, small = eigenvalues({p: F.col(f"c{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz")})
    m = m.withColumns({"l1": big, "l2": mid, "l3": small})
    part = lambda c: F.try_divide(c, F.col("l1"))
    shift = F.sqrt(dot(d := [F.col(f"m{a}") for a in AXES], d)) / radius
    return m.select("id", "n", shift.alias("shift"), part(F.col("l1") - F.col("l2")).alias("linearity"), part(F.col("l2") - F.col("l3")).alias("planarity"), part(F.col("l3")).alias("scattering"), F.try_divide(F.col("l3"), F.col("l1") + F.col("l2") + F.col("l3")).alias("variation"))


def island_classes(points: DataFrame, anchors: DataFrame, radii: tuple[float, ...], most: float, gap: float, flat: float = 0.04, thin: float = 0.04) -> DataFrame:
    """(label, n, class) of the islands at the first radius: 0 supported (an anchor lies in it), 1 removable, 2 to review.

    To review is an island of a supported parent at the last radius, one whose parent's bounding box has a diagonal above `most`,
    one with a supported point nearer than gap, and one that is planar (12 points or more) or linear (6 or more).
    """
    both = neighbours.nested_components(points, (radii[0], radii[-1])).checkpoint()
    fine, coarse = (both.filter(F.col("radius") == r).select("id", "label") for r in (radii[0], radii[-1]))
    own = points.join(fine, "id").join(coarse.withColumnRenamed("label", "parent"), "id").checkpoint()
    held = own.join(anchors.select("id"), "id", "left_semi")
    stats = statistics.component_moments(points, fine).drop("cov")
    big, mid, small = eigenvalues({p: F.col(f"c{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz")})
    ratio = lambda a, b: F.when(b <= 1e-24, 1.0).otherwise(a / b)
    stats = stats.select("label", "n", ratio(small, mid).alias("flat"), ratio(mid, big).alias("thin"))
    box = own.groupBy("parent").agg(*[(F.max(a) - F.min(a)).alias(f"w{a}") for a in AXES])
    box = box.select("parent", F.sqrt(dot(w := [F.col(f"w{a}") for a in AXES], w)).alias("wide"))
    body = own.join(held.select("label").distinct(), "label", "left_semi")
    rest = own.join(held.select("label").distinct(), "label", "left_anti")
    close = crowds.nearer(rest.select("id", *AXES), body, gap)
    close = rest.join(close, "id", "left_semi").select("label").distinct().withColumn("close", F.lit(True))
    of = own.select("label", "parent").distinct()
    of = of.join(held.select("label").distinct().withColumn("held", F.lit(True)), "label", "left").join(held.select("parent").distinct().withColumn("above", F.lit(True)), "parent", "left")
    out = of.join(stats, "label").join(box, "parent").join(close, "label", "left")
    shape = ((F.col("n") >= 12) & (F.col("flat") <= flat) & (F.col("thin") > thin)) | ((F.col("n") >= 6) & (F.col("thin") <= thin))
    review = F.coalesce("above", F.lit(False)) | (F.col("wide") > most) | F.coalesce("close", F.lit(False)) | shape
    return out.select("label", "n", F.when(F.col("held"), 0).when(review, 2).otherwise(1).alias("class"))


def link_costs(pairs: DataFrame, sigma: dict[str, float]) -> Column:
    """Half the sum of the squares of the pair's figures, each against its sigma."""
    return dot(c := [F.col(k) / s for k, s in sigma.items()], c) / 2


#: Planes that are sent to all tasks at once.
PLANES = 20_000


def first_claims(points: DataFrame, planes_: DataFrame, tolerance: float) -> DataFrame:
    """(id, plane): the lowest of the planes (plane, nx, ny, nz, offset) that a point lies on. Planes take their turns by number, few
    first; a point that one has claimed meets no later ones."""
    p = planes_.select("plane", "nx", "ny", "nz", "offset")
    on = F.abs(dot([F.col(a) for a in AXES], [F.col(f"n{a}") for a in AXES]) + F.col("offset")) <= tolerance
    left, done = stored(points.select("id", *AXES), "unclaimed"), None
    for turn in joins.in_turn(p, "plane", most=PLANES):
        found = stored(left.join(F.broadcast(p.filter(turn)), on).groupBy("id").agg(F.min("plane").alias("plane")), "claimed")  # some PLANES rows
        done = found if done is None else done.unionByName(found)
        left = stored(left.join(found, "id", "left_anti"), "unclaimed")
        if left.isEmpty():
            break
    return done


def priority_labels(rows: DataFrame, claims: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows with label: that of the first of the claims (label, table of ids) that holds the row's id, 0 if none does. Every row
    has one label, so the labels part the rows."""
    out, label = rows, []
    for n, (value, ids) in enumerate(claims):
        out = out.join(ids.select("id").distinct().withColumn(f"__c{n}", F.lit(value)), "id", "left")
        label.append(F.col(f"__c{n}"))
    return out.withColumn("label", F.coalesce(*label, F.lit(0))).drop(*[f"__c{n}" for n in range(len(claims))])


def smoothed(vertices: DataFrame, edges: DataFrame, pinned: DataFrame, passes: int, shrink: float = 0.5, grow: float = -0.53) -> DataFrame:
    """(id, x, y, z) after passes of a step towards the mean of a vertex's neighbours and one away from it; pinned ids stay where they
    are. Each step is a join and a partial aggregate; each pass a checkpoint."""
    both = edges.select(F.col("u").alias("id"), F.col("v").alias("oid")).unionByName(edges.select(F.col("v").alias("id"), F.col("u").alias("oid"))).distinct()
    free = both.join(pinned.select("id"), "id", "left_anti").checkpoint()
    now = vertices.select("id", *AXES)
    for _ in range(passes):
        for rate in (shrink, grow):
            mean = free.join(now.select(F.col("id").alias("oid"), *AXES), "oid").groupBy("id").agg(*[F.avg(a).alias(f"m{a}") for a in AXES])
            now = now.join(mean, "id", "left").select("id", *[F.coalesce(F.col(a) + rate * (F.col(f"m{a}") - F.col(a)), F.col(a)).alias(a) for a in AXES])
        now = now.checkpoint()
    return now


def loop_areas(loops: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n, area): signed area of the closed loop of the vertices (key, order, x, y); left turns count positive."""
    w = Window.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(a).over(w), F.first(a).over(whole)) for a in "xy")
    return loops.withColumn("__a", (F.col("x") * ny - nx * F.col("y")) / 2).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("__a").alias("area"))


def curve_support(samples: DataFrame, sources: DataFrame, key: str, reach: float, near: float) -> DataFrame:
    """(key, samples, supported, p95, longest): of resampled curves (key, k, x, y, z, weight): the weight's share with a source (oid, x, y,
    z) at most near away, the distance (reach where none is closer) that 95 % of the weight stay within, and the most weight in a
    row without support."""
    from . import windows

    at = samples.withColumn("id", F.struct(key, "k"))
    best = joins.nearest_within(at.select("id", *AXES), sources, reach).select(F.col("id").alias("__id"), "dist")
    at = at.join(best, F.col("id") == F.col("__id"), "left").withColumn("dist", F.coalesce("dist", F.lit(reach)))
    gap = windows.longest_gap(at, key, ["k"], F.col("dist") <= near, "weight", False)
    p95 = statistics.weighted_quantile(at, key, "dist", "weight", 0.95).withColumnRenamed("q", "p95")
    share = at.groupBy(key).agg(F.count(F.lit(1)).alias("samples"), (F.sum(F.when(F.col("dist") <= near, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("supported"))
    return share.join(p95, key).join(gap, key)


def geometric_outliers(points: DataFrame, keep: DataFrame, scales=((12, 0.4), (32, 1.2), (64, 3.0)), least: int = 6, contradictions: int = 2, candidates: DataFrame | None = None) -> DataFrame:
    """(id, supported, consistent, rejected) of the points that keep (id, keep) leaves, or of the candidates (id) among them: at each scale
    (k nearest survivors within a radius) the neighbours' different places make a line or a plane, and do so still, of the same kind,
    after each of two cuts of the fifth that fits worst; only then the scale is confident.

    A line has a second spread of at most 0.03 of the first, a plane one of 0.05 or more, and a third of at most 0.1 of the second; spreads
    that count are 0.03 long at least, and `least` places must be left. A point is consistent with a scale if it lies as near to
    the shape as the places do (three median deviations, 0.03 to 0.12). Rejected: confident scales enough, none consistent.
    """
    left = points.join(keep.filter("keep").select("id"), "id", "left_semi").select("id", *AXES).checkpoint()
    asked = left if candidates is None else left.join(candidates.select("id").distinct(), "id", "left_semi")
    k, radius = max(s[0] for s in scales), max(s[1] for s in scales)
    near = joins.nearest_within(asked, left.select(F.col("id").alias("oid"), *AXES), radius, k, itself=False)
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "dist", *[(F.col(f"o{a}") - F.col(a)).alias(f"d{a}") for a in AXES]))).alias("l"))  # k at most
    flat = lists.select("id", *[F.col(f"l.{n}").alias(n) for n in ("dist", "dx", "dy", "dz")])
    votes = flat.mapInArrow(lambda b: _votes(b, scales, least, k), "id long, supported int, consistent int")
    out = asked.select("id").join(votes, "id", "left").na.fill(0, ["supported", "consistent"])
    return out.withColumn("rejected", (F.col("supported") >= contradictions) & (F.col("consistent") == 0))


def _votes(batches, scales, least: int, most: int):
    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            n = np.asarray(pc.list_value_length(part.column("dist")))
            there = np.arange(most)[None] < n[:, None]
            filled = []
            for name, empty in (("dist", np.inf), ("dx", 0.0), ("dy", 0.0), ("dz", 0.0)):
                column = np.full(there.shape, empty)
                column[there] = pc.list_flatten(part.column(name)).to_numpy(zero_copy_only=False)
                filled.append(column)
            dist, places = filled[0], np.stack(filled[1:], -1)
            found = [_shape(places[:, :k], dist[:, :k] <= r, least) for k, r in scales]
            yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(sum(f[i].astype(np.int32) for f in found), pa.int32()) for i in (0, 1)]], names=["id", "supported", "consistent"])


def _shape(places: np.ndarray, used: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of places (rows, k, 3): whether those used make a confident line or plane, and whether the origin lies on it too."""
    order = np.lexsort(np.where(used[..., None], places, np.inf).transpose(2, 0, 1)[::-1], axis=1)
    places, used = np.take_along_axis(places, order[..., None], 1), np.take_along_axis(used, order, 1)
    used[:, 1:] &= ~(used[:, :-1] & (places[:, 1:] == places[:, :-1]).all(-1))  # one of each place
    sure, kind = used.sum(1) >= least, None
    for turn in range(3):
        n = used.sum(1)
        weight = used / np.maximum(n, 1)[:, None]
        middle = np.einsum("rk,rkc->rc", weight, places)
        off = places - middle[:, None]
        spread, axes = np.linalg.eigh(np.einsum("rk,rki,rkj->rij", weight, off, off))
        small, second, first = np.maximum(spread, 0.0).T
        wide = np.float64(0.03) ** 2
        line = (first >= wide) & (second <= 0.03 * first)
        plane = (first >= wide) & (second >= wide) & (second >= 0.05 * first) & (small <= 0.1 * second) & ~line
        now = np.where(line, 1, np.where(plane, 2, 0))
        sure &= (n >= least) & (now > 0) & (now == kind if turn else True)
        kind = now
        flat, side = np.einsum("rkc,rc->rk", off, axes[:, :, 0]), np.einsum("rkc,rc->rk", off, axes[:, :, 1])
        away = np.where(line[:, None], np.hypot(flat, side), np.abs(flat))
        if turn < 2:
            rank = np.argsort(np.argsort(np.where(used, away, np.inf), axis=1, kind="stable"), axis=1, kind="stable")
            used &= rank < np.floor(n * 0.8)[:, None]

    def median(values):
        low = np.sort(np.where(used, values, np.inf), axis=1)
        row, n = np.arange(len(low)), np.maximum(used.sum(1), 1)
        return (low[row, (n - 1) // 2] + low[row, n // 2]) / 2

    with np.errstate(invalid="ignore"):
        typical = median(away)
        limit = np.clip(typical + 3.0 * 1.4826 * median(np.abs(away - typical[:, None])), 0.03, 0.12)
        own = np.hypot(np.einsum("rc,rc->r", middle, axes[:, :, 0]), np.where(line, np.einsum("rc,rc->r", middle, axes[:, :, 1]), 0.0))
    return sure, sure & (own <= limit)


def voxel_quads(cells: DataFrame, size: float) -> DataFrame:
    """(ix, iy, iz, axis, side, x0, y0, z0, x1, y1, z1): the exposed faces of occupied cells as squares between two corners."""
    from .cells import exposed_faces

    out = exposed_faces(cells)
    for i, a in enumerate(AXES):
        on = F.col("axis") == i
        shift = F.when(on & (F.col("side") > 0), 1).otherwise(0)
        out = out.withColumns({f"{a}0": (F.col(f"i{a}") + shift) * size, f"{a}1": (F.col(f"i{a}") + F.when(on, shift).otherwise(1)) * size})
    return out


def cell_weights(points: DataFrame, size: float) -> DataFrame:
    own = with_cells(points, size)
    return own.join(own.groupBy("ix", "iy", "iz").agg((1 / F.count(F.lit(1))).alias("weight")), ["ix", "iy", "iz"])
