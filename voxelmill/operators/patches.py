"""Strips fitted to many members at once.

Every member's centres along its axis are fitted by a robust line in its own frame. All fits go in lockstep: a round is one aggregate of
weighted moments by member and a join of what it gives, until no fit moves any more; those that rest drop out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.folders import stored
from . import shapes
from .attributes import cross, dot
from .cells import AXES


def robust_lines(rows: DataFrame, key: str, t: str, values: list[str], scale: float = 0.03, tolerance: float = 1e-12, most: int = 500) -> DataFrame:
    """(key, a_v, b_v for each value v): the line a + b t of least soft-L1 loss, 2 (sqrt(1 + (r / scale)²) - 1) summed over all rows.

    Reweighted least squares: each round weighs a row by 1 / sqrt(1 + (r / scale)²). A key whose rows have one t only has b 0. The loss is
    convex, so there is one answer. Rows are aggregated by partial sums; a key may have any number.
    """
    rows = stored(rows.select(key, F.col(t).cast("double").alias("__t"), *[F.col(v).cast("double").alias(v) for v in values]), "line-rows")
    names = [f"{p}_{v}" for v in values for p in "ab"]
    now = rows.select(key).distinct().select(key, *[F.lit(0.0).alias(n) for n in names])
    done, first = None, True
    for _ in range(most):
        at = rows.join(now, key)
        sums = []
        for v in values:
            off = (F.col(v) - F.col(f"a_{v}") - F.col(f"b_{v}") * F.col("__t")) / scale
            w = F.lit(1.0) if first else 1 / F.sqrt(1 + off * off)
            sums += [F.sum(x).alias(f"{n}_{v}") for n, x in (("w", w), ("t", w * F.col("__t")), ("tt", w * F.col("__t") * F.col("__t")), ("o", w * F.col(v)), ("to", w * F.col("__t") * F.col(v)))]
        got = at.groupBy(key, *names).agg(*sums)
        moved = F.lit(0.0)
        for v in values:
            w, t1, tt, o, to = (F.col(f"{n}_{v}") for n in ("w", "t", "tt", "o", "to"))
            det = w * tt - t1 * t1
            slope = F.when(det > 1e-12 * w * tt, (w * to - t1 * o) / det).otherwise(F.lit(0.0))
            got = got.withColumn(f"__b_{v}", slope).withColumn(f"__a_{v}", (o - F.col(f"__b_{v}") * t1) / w)
            moved = F.greatest(moved, *[F.abs(F.col(f"__{p}_{v}") - F.col(f"{p}_{v}")) for p in "ab"])
        seen = Observation()
        step = got.select(key, *[F.col(f"__{n}").alias(n) for n in names], ((moved <= tolerance) & F.lit(not first)).alias("__rest"))
        step = stored(step.observe(seen, F.count_if(~F.col("__rest")).alias("left"), F.count_if("__rest").alias("rest")), "line-round")
        ready = step.filter("__rest").drop("__rest")
        if seen.get["rest"]:
            done = ready if done is None else done.unionByName(ready)
        if not seen.get["left"]:
            if not seen.get["rest"]:
                return step.drop("__rest")
            return done
        now, first = step.filter("not __rest").drop("__rest"), False
    raise ValueError("the fits did not converge")


def _vector(name: str) -> list[Column]:
    return [F.col(f"{name}{a}") for a in AXES]


def _unit(v: list[Column]) -> list[Column]:
    size = F.sqrt(dot(v, v))
    return [c / size for c in v]


def _minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def _put(df: DataFrame, name: str, v: list[Column]) -> DataFrame:
    return df.withColumns({f"{name}{a}": c for a, c in zip(AXES, v, strict=True)})


def fit_patches(members: DataFrame, centres: DataFrame, points: DataFrame, scale: float = 0.03, angle: float = 15.0, shortest: float = 0.5, least: int = 12) -> DataFrame:
    """(member, ax ... bz, nx, ny, nz, half_width, centre_rms, plane_rms, degrees, rows) of the members (member, sx ... ez: ends of a search
    axis, nx, ny, nz: normal) whose section centres (member, x, y, z) and points (member, id, x, y, z) make a strip.

    Three different centres at least; the line through them turns by `angle` degrees at most and is `shortest` long at least between its
    outermost centres and 0.05 beyond; `least` points beside it. Its plane is that of these points, turned to hold the line and to
    face the given normal's side; its width spans their 0.05 to 0.95 quantiles.
    """
    m = _put(members, "d", _unit(_minus(_vector("e"), _vector("s"))))
    m = m.withColumn("length", F.sqrt(dot(_minus(_vector("e"), _vector("s")), _minus(_vector("e"), _vector("s")))))
    m = _put(m, "r", _unit(cross(_vector("n"), _vector("d"))))
    along = dot(_vector("n"), _vector("d"))
    m = _put(m, "f", _unit([n - along * d for n, d in zip(_vector("n"), _vector("d"), strict=True)]))
    at = centres.select("member", *AXES).distinct().join(m, "member")
    off = _minus([F.col(a) for a in AXES], _vector("s"))
    at = stored(at.select("member", *AXES, dot(off, _vector("d")).alias("t"), dot(off, _vector("r")).alias("u"), dot(off, _vector("f")).alias("v")), "patch-centres")
    enough = at.groupBy("member").agg(F.count(F.lit(1)).alias("__n"), F.min("t").alias("low"), F.max("t").alias("high")).filter("__n >= 3").drop("__n")
    lines = robust_lines(at.join(enough.select("member"), "member"), "member", "t", ["u", "v"], scale)
    m = m.join(enough, "member").join(lines, "member")
    turned = [d + r * F.col("b_u") + f * F.col("b_v") for d, r, f in zip(_vector("d"), _vector("r"), _vector("f"), strict=True)]
    m = _put(_put(m, "g", turned), "h", _unit(turned))
    m = m.withColumn("degrees", F.degrees(F.acos(F.greatest(F.least(dot(_vector("h"), _vector("d")), F.lit(1.0)), F.lit(-1.0)))))
    m = m.withColumn("low", F.greatest(F.lit(0.0), F.col("low") - 0.05)).withColumn("high", F.least("length", F.col("high") + 0.05))
    m = m.filter((F.col("degrees") <= angle) & (F.col("high") - F.col("low") >= shortest))
    m = _put(m, "o", [s + r * F.col("a_u") + f * F.col("a_v") for s, r, f in zip(_vector("s"), _vector("r"), _vector("f"), strict=True)])
    m = _put(_put(m, "a", [o + F.col("low") * g for o, g in zip(_vector("o"), _vector("g"), strict=True)]), "b", [o + F.col("high") * g for o, g in zip(_vector("o"), _vector("g"), strict=True)])
    m = m.withColumn("span", F.sqrt(dot(_minus(_vector("b"), _vector("a")), _minus(_vector("b"), _vector("a")))))
    m = stored(m.select("member", "degrees", "span", *[f"{n}{a}" for n in "ahobn" for a in AXES]), "patch-lines")
    place = [F.col(f"p{a}") for a in AXES]
    own = points.select("member", "id", *[F.col(a).alias(f"p{a}") for a in AXES]).dropDuplicates(["member", "id"]).join(m, "member")
    ahead = dot(_minus(place, _vector("a")), _vector("h"))
    own = stored(own.filter((ahead >= 0) & (ahead <= F.col("span"))), "patch-points")
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    spread = own.groupBy("member").agg(F.count(F.lit(1)).alias("rows"), *[F.covar_pop(f"p{a}", f"p{b}").alias(f"c{a}{b}") for a, b in pairs]).filter(F.col("rows") >= least)
    axes = shapes.spectra(spread).select("member", "rows", *[F.col(f"n{a}").alias(f"q{a}") for a in AXES])
    m = m.join(axes, "member")
    lean = dot(_vector("q"), _vector("h"))
    m = _put(m, "q", _unit([q - lean * h for q, h in zip(_vector("q"), _vector("h"), strict=True)]))
    m = _put(m, "q", [F.when(dot(_vector("q"), _vector("n")) < 0, -q).otherwise(q) for q in _vector("q")])
    m = stored(_put(m, "w", _unit(cross(_vector("q"), _vector("h")))), "patch-planes")
    each = own.select("member", *place).join(m, "member")
    aside, lifted = dot(_minus(place, _vector("o")), _vector("w")), dot(_minus(place, _vector("a")), _vector("q"))
    wide = each.groupBy("member").agg(F.percentile(aside, [0.05, 0.95]).alias("__q"), F.sqrt(F.avg(lifted * lifted)).alias("plane_rms"))
    beside = cross(_minus([F.col(a) for a in AXES], _vector("o")), _vector("h"))
    near = at.select("member", *AXES).join(m, "member").groupBy("member").agg(F.sqrt(F.avg(dot(beside, beside))).alias("centre_rms"))
    out = m.join(wide, "member").join(near, "member")
    return out.select("member", *[f"{n}{a}" for n in "ab" for a in AXES], *[F.col(f"q{a}").alias(f"n{a}") for a in AXES], ((F.col("__q")[1] - F.col("__q")[0]) / 2).alias("half_width"), "centre_rms", "plane_rms", "degrees", "rows")
