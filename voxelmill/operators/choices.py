"""Choices in an order: what stays when better rows suppress worse ones, fitted groups merged one by one, region jobs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import shared, stored
from . import cells, graphs, joins, sequences, windows
from .cells import AXES


#: Conflicts of a connected group that one task goes through in order.
CONFLICTS = 1_000_000


def _in_turn(pdf: pd.DataFrame) -> pd.DataFrame:
    """Items that a kept one suppresses, of the conflicts (a, oa, b, ob) of a group, a before b."""
    gone: set = set()
    for a, b in pdf.sort_values(["oa", "a"])[["a", "b"]].itertuples(index=False):
        if a not in gone:  # all that precede it have had their turn
            gone.add(b)
    return pd.DataFrame({"item": sorted(gone)})


def unsuppressed(items: DataFrame, conflicts: DataFrame, most: int = CONFLICTS) -> DataFrame:
    """(item, kept) of items (item, order): each item in turn, least order first, is kept unless a kept one conflicts with it (conflicts:
    a, b). Not transitive: what a dropped item would have suppressed stays.

    The same as going through them one by one. Items that conflict in a connected group of up to `most` conflicts are gone
    through by one task; larger groups go in rounds, in which an item is decided once all its conflicting predecessors are: each
    round decides at least the first undecided item of every group, and is a few joins of what is left.
    """
    shared(items.sparkSession)
    order = items.select("item", "order")
    pairs = conflicts.select("a", "b").filter("a <> b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a <> b")).distinct()
    pairs = pairs.join(order.withColumnsRenamed({"item": "a", "order": "oa"}), "a").join(order.withColumnsRenamed({"item": "b", "order": "ob"}), "b")
    pairs = stored(pairs.filter("oa < ob OR (oa = ob AND a < b)"), "conflicts")
    of = graphs.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "a")
    grouped = stored(pairs.join(of, "a"), "conflict-groups")
    large = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("component")
    kind = items.schema["item"].dataType.simpleString()
    small = grouped.join(large, "component", "left_anti")
    gone = stored(small.groupBy("component").applyInPandas(_in_turn, f"item {kind}"), "suppressed")
    before = stored(grouped.join(large, "component", "left_semi").select("a", "b"), "conflicts-left")
    if not before.isEmpty():
        gone = gone.unionByName(_in_rounds(before))
    return order.join(gone.withColumn("__gone", F.lit(True)), "item", "left").select("item", F.col("__gone").isNull().alias("kept"))


def _in_rounds(before: DataFrame) -> DataFrame:
    """Items that a kept one suppresses, of the pairs (a, b), a before b, in rounds."""
    left, done = stored(before.select(F.explode(F.array("a", "b")).alias("item")).distinct(), "undecided"), None
    while True:
        # Kept: undecided without an undecided predecessor; dropped: those that a kept one precedes.
        kept = stored(left.join(before.select(F.col("b").alias("item")).distinct(), "item", "left_anti"), "kept")
        gone = stored(left.join(before.join(kept.select(F.col("item").alias("a")), "a").select(F.col("b").alias("item")).distinct(), "item", "left_semi"), "suppressed")
        done = gone if done is None else done.unionByName(gone)
        left = stored(left.join(kept.unionByName(gone), "item", "left_anti"), "undecided")
        if left.isEmpty():
            return done
        before = stored(before.join(left.select(F.col("item").alias("a")), "a", "left_semi").join(left.select(F.col("item").alias("b")), "b", "left_semi"), "conflicts-left")


def by_region(points: DataFrame, size: float, margin: float, job: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """job(own rows, rows of the halo) of every tile, in order of id, with tx and ty in front of what it returns (schema). A tile with its
    halo is one task's rows; size bounds them."""
    at = cells.halo(points, size, margin)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        own = pdf["own"]
        if not own.any():
            return pd.DataFrame(columns=["tx", "ty", *names])
        out = job(pdf[own].drop(columns=["own", "tx", "ty"]), pdf[~own].drop(columns=["own", "tx", "ty"]))
        out.insert(0, "tx", key[0])
        out.insert(1, "ty", key[1])
        return out

    names = [c.split()[0] for c in schema.split(",")]
    return at.groupBy("tx", "ty").applyInPandas(run, f"tx long, ty long, {schema}")


def ransac(points: np.ndarray, tolerance: float, rounds: int = 350, seed: int = 7) -> tuple[np.ndarray, np.ndarray] | None:
    """(normal and offset, which points lie on it) of the plane with the most points, refitted twice; None for fewer than three points
    or none but collinear ones. Repeatable: the draws hang on the seed alone."""
    if len(points) < 3:
        return None
    draws, best, top = np.random.default_rng(seed), None, 2
    for _ in range(rounds):
        a, b, c = points[draws.choice(len(points), 3, replace=False)]
        n = np.cross(b - a, c - a)
        if (length := np.linalg.norm(n)) <= 1e-12:
            continue
        on = np.abs((points - a) @ (n / length)) <= tolerance
        if on.sum() > top:
            top, best = on.sum(), on
    for _ in range(2 if best is not None else 0):
        middle = points[best].mean(axis=0)
        n = np.linalg.eigh(np.cov((points[best] - middle).T, bias=True))[1][:, 0]
        n = n * (1 if n[np.argmax(np.abs(n))] >= 0 else -1)
        offset = -np.median(points[best] @ n)
        best = np.abs(points @ n + offset) <= tolerance
    return None if best is None or best.sum() < 3 else (np.append(n, offset), best)


def planes_by_region(points: DataFrame, size: float, tolerance: float, most: int = 12, support: int = 128) -> DataFrame:
    """(tx, ty, plane, nx, ny, nz, offset, n) of points (id, x, y, z): up to `most` planes a tile, each of the points that those before it
    left, of `support` points or more."""

    def job(own: pd.DataFrame, _: pd.DataFrame) -> pd.DataFrame:
        left, out = own[list(AXES)].to_numpy(), []
        while len(out) < most and (found := ransac(left, tolerance)) is not None and found[1].sum() >= support:
            out.append((len(out), *found[0], int(found[1].sum())))
            left = left[~found[1]]
        return pd.DataFrame(out, columns=["plane", "nx", "ny", "nz", "offset", "n"])

    return by_region(points, size, 0.0, job, "plane long, nx double, ny double, nz double, offset double, n long")


def ground_cells(points: DataFrame, heights: DataFrame, low: float, high: float, size: float, coarse: float) -> DataFrame:
    """(id) of the ground's representatives: rows whose height (id, height) lies in the band, the upper median row of each cell, of those
    the ones in the largest group of connected coarse cells (the lower one of equally large ones)."""
    band = points.join(heights, "id").filter(F.col("height").between(low, high)).drop("height")
    flat = band.withColumns({f"i{a}": F.floor(F.col(a) / size) for a in "xy"})
    w = Window.partitionBy("ix", "iy")
    place, n = F.row_number().over(w.orderBy("z", "id")), F.count(F.lit(1)).over(w)
    mids = flat.withColumn("__k", place).withColumn("__n", n).filter(F.col("__k") == F.floor(F.col("__n") / 2) + 1).select("id", *AXES)
    shared(points.sparkSession)
    at = mids.withColumns({f"i{a}": F.floor(F.col(a) / coarse) for a in "xy"}).checkpoint()
    cells_ = at.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n")).withColumn("node", F.struct("ix", "iy")).withColumn("level", F.lit(0))
    links = joins.cell_links(cells_, 1.5, "level", 0).select(F.struct(F.col("ax").alias("ix"), F.col("ay").alias("iy")).alias("src"), F.struct(F.col("bx").alias("ix"), F.col("by").alias("iy")).alias("dst"))
    of = graphs.labelled(cells_.select("node", "n"), "node", links)
    top = of.groupBy("component").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    chosen = of.join(F.broadcast(top.select("component")), "component").select("node.ix", "node.iy")  # one component
    return at.join(chosen, ["ix", "iy"], "left_semi").select("id")


def crowns(points: DataFrame, heights: DataFrame, size: float, least: float, reach: float) -> DataFrame:
    """(id, seed, dist): the crown, if any within reach, that a point belongs to. Seeds are the local peaks above least of the smoothed
    greatest height of each cell, numbered by place."""
    at = points.join(heights, "id").withColumns({f"i{a}": F.floor(F.col(a) / size) for a in "xy"})
    top = at.groupBy("ix", "iy").agg(F.max("height").alias("v"))
    smooth = windows.focal(top, "v", 3).select("ix", "iy", F.col("smooth").alias("v"))
    found = windows.peaks(smooth, "v", 3, least)
    middle = {a: (F.col(f"i{a}") + 0.5) * size for a in "xy"}
    seeds = found.select((F.col("ix") * 1_000_003 + F.col("iy")).alias("seed"), middle["x"].alias("x"), middle["y"].alias("y"))
    from .ranges import nearest_seed

    return nearest_seed(points, seeds, reach)


def simplified(loops: DataFrame, key: str, order: str, tolerance: float) -> DataFrame:
    """The vertices (key, order, x, y) of closed loops that stay when no dropped one lies farther than tolerance from the line between its
    kept neighbours: the two ends are the first vertex and the one farthest from it."""

    def keep(p: np.ndarray, lo: int, hi: int, out: set) -> None:
        stack = [(lo, hi)]
        while stack:
            lo, hi = stack.pop()
            if hi - lo < 2:
                continue
            a, ab = p[lo], p[hi] - p[lo]
            length, off = np.hypot(*ab), p[lo + 1 : hi] - p[lo]
            away = np.abs(ab[0] * off[:, 1] - ab[1] * off[:, 0]) / length if length else np.hypot(*(p[lo + 1 : hi] - a).T)
            k = int(away.argmax())
            if away[k] > tolerance:
                out.add(lo + 1 + k)
                stack += [(lo, lo + 1 + k), (lo + 1 + k, hi)]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        p = pdf[["x", "y"]].to_numpy()
        far = int(np.hypot(*(p - p[0]).T).argmax())
        out = {0, far}
        ring = np.concatenate([p, p[:1]])
        keep(ring, 0, far, out)
        keep(ring, far, len(p), out)
        return pdf.iloc[sorted(i for i in out if i < len(p))]

    rows = loops.select(key, order, "x", "y")
    return rows.groupBy(key).applyInPandas(one, rows.schema)


def interval_difference(left: DataFrame, right: DataFrame, key: list[str], size: float) -> DataFrame:
    """(key, a, low, high): the parts of the left intervals (key, a, low, high) that no right one (key, b, low, high) covers."""
    covered = joins.covered(left, right, key, size).select(F.struct(*key, "a").alias("__k"), "low", "high")
    w = Window.partitionBy("__k").orderBy("low")
    holes = left.withColumn("__k", F.struct(*key, "a")).join(covered.withColumnsRenamed({"low": "cl", "high": "ch"}), "__k", "left")
    holes = holes.withColumn("__before", F.coalesce(F.lag("ch").over(w.orderBy("cl")), F.col("low"))).withColumn("__last", F.lead("cl").over(w.orderBy("cl")).isNull())
    parts = F.array(F.struct(F.col("__before").alias("low"), F.coalesce("cl", "high").alias("high")), F.struct(F.when(F.col("__last"), F.coalesce("ch", "high")).alias("low"), F.col("high").alias("high")))
    out = holes.select(*key, "a", F.explode(parts).alias("p")).select(*key, "a", "p.low", "p.high")
    return out.filter("low < high")


def _pooled(a: tuple, b: tuple) -> tuple:
    """Number, mean and population covariance of two groups together."""
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), (a[0] * a[2] + b[0] * b[2]) / n + np.outer(d, d) * (a[0] * b[0] / n**2)


def joined_planes(planes: DataFrame, pairs: DataFrame, thickness: float, least: int = 0) -> DataFrame:
    """(plane, joined) of planes (plane, n, mx, my, mz, cxx ... czz: moments of their points) and candidate pairs (a, b, cost): pairs are
    taken in order of cost, and join two groups whose points together still make a plane: a root of the least eigenvalue of their
    pooled covariance up to thickness. Groups of fewer than `least` points come out as null; joined is a group's lowest plane.

    Groups form inside connected components of the pairs only, and each component is one task's few rows.
    """
    moments = ["n", "mx", "my", "mz", *(f"c{p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz"))]
    links = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    of = graphs.labelled(planes.select("plane", *moments), "plane", links).checkpoint()
    asked = pairs.select("a", "b", "cost").join(of.select(F.col("plane").alias("a"), F.col("component").alias("part")), "a")
    kind = planes.schema["plane"].dataType.simpleString()

    def run(key: tuple, own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        state, root = {}, {}
        for r in own.itertuples(index=False):
            state[r.plane] = r.n, np.array([r.mx, r.my, r.mz]), np.array([[r.cxx, r.cxy, r.cxz], [r.cxy, r.cyy, r.cyz], [r.cxz, r.cyz, r.czz]])
            root[r.plane] = r.plane

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for r in wanted.sort_values(["cost", "a", "b"]).itertuples(index=False):
            a, b = sorted((find(r.a), find(r.b)))
            if a != b:
                both = _pooled(state[a], state[b])
                if np.sqrt(max(np.linalg.eigvalsh(both[2])[0], 0.0)) <= thickness:
                    root[b], state[a] = a, both
        tops = [find(p) for p in own["plane"]]
        made = pd.DataFrame({"plane": own["plane"], "joined": pd.array([t if state[t][0] >= least else None for t in tops], "Int64")})
        return made

    return of.groupBy("component").cogroup(asked.groupBy("part")).applyInPandas(run, f"plane {kind}, joined {kind}")
