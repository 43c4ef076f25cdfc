"""Predicted edge lines against reference lines, by length.

Segments (id, kind, ax ... bz) meet through the cells that their boxes touch. What a prediction shares with a reference is an interval of
either, clipped in closed form: where its foot lies within the reference, and where it is no farther than the tolerance. Lengths are those of
unions of intervals.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored
from . import crowds
from .attributes import cross, dot
from .cells import AXES

_ENDS = [f"{e}{a}" for e in "ab" for a in AXES]


def measured(segments: DataFrame) -> DataFrame:
    """segments with length and unit direction dx, dy, dz; one of no length, or with an end that isn't finite, is an error."""
    d = [F.col(f"b{a}") - F.col(f"a{a}") for a in AXES]
    length = F.sqrt(dot(d, d))
    good = (length > 0) & (length < math.inf)
    out = segments.withColumn("length", F.when(F.coalesce(good, F.lit(False)), length).otherwise(F.raise_error(F.lit("a segment has no length or isn't finite"))))
    return out.withColumns({f"d{a}": c / F.col("length") for a, c in zip(AXES, d, strict=True)})


def _pairs(left: DataFrame, right: DataFrame, reach: float, size: float, more: list[str]) -> DataFrame:
    """left joined with right (columns prefixed by o_) of the same kind and the same value of the columns `more`, whose boxes are at most reach
    apart: they meet in the cells that both touch, once in the one where their common box begins."""
    def celled(df: DataFrame, grow: float) -> DataFrame:
        for a in AXES:
            df = df.withColumns({f"__l{a}": F.least(f"a{a}", f"b{a}") - grow, f"__u{a}": F.greatest(f"a{a}", f"b{a}") + grow})
        for a in AXES:
            df = df.withColumn(f"__i{a}", F.explode(F.sequence(F.floor(F.col(f"__l{a}") / size), F.floor(F.col(f"__u{a}") / size))))
        return df

    cell = [*[f"__i{a}" for a in AXES], *more]
    mine = celled(left, reach)
    other = celled(right, 0.0)
    other = other.withColumnsRenamed({c: f"o_{c}" for c in other.columns if c not in cell and c != "kind"})
    both = mine.join(other, ["kind", *cell])
    for a in AXES:
        low = F.greatest(F.col(f"__l{a}"), F.col(f"o___l{a}"))
        both = both.filter((low <= F.least(f"__u{a}", f"o___u{a}")) & (F.floor(low / size) == F.col(f"__i{a}")))
    return both.drop(*cell, *[c for c in both.columns if c.startswith("__") or c.startswith("o___")])


def _v(name: str) -> list[Column]:
    return [F.col(f"{name}{a}") for a in AXES]


def _celled(segments: DataFrame, grow: float, size: float) -> DataFrame:
    """segments, once for each cell that their boxes, grown by that much, touch."""
    for a in AXES:
        low, high = F.least(f"a{a}", f"b{a}") - grow, F.greatest(f"a{a}", f"b{a}") + grow
        segments = segments.withColumn(f"__i{a}", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    return segments


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _stretches(left: pa.Table, right: pa.Table, distance: float, degrees: float, size: float):
    """(i, j, low, high, olow, ohigh) of the rows i of left and j of right that match, in parts, a few rows of left at a time. A pair belongs
    to the cell where its common box begins."""
    least = math.cos(math.radians(degrees)) - 1e-14
    names = [*_ENDS, "dx", "dy", "dz", "length"]
    p, r = crowds.numbers(left, names).T, crowds.numbers(right, names).T
    cell = [left.column(f"__i{a}")[0].as_py() for a in AXES] if left.num_rows else []
    for part in crowds.slices(p.shape[1], r.shape[1]):
        # Directions first: one product of matrices leaves few pairs. It may differ by rounding, so the bound is held again below.
        i, j = np.nonzero(np.abs(p[6:9, part].T @ r[6:9]) >= least - 1e-9)
        i += part.start
        for k, at in enumerate(cell):
            low = np.maximum(np.minimum(p[k, i], p[3 + k, i]) - distance, np.minimum(r[k, j], r[3 + k, j]))
            high = np.minimum(np.maximum(p[k, i], p[3 + k, i]) + distance, np.maximum(r[k, j], r[3 + k, j]))
            here = (low <= high) & (np.floor(low / size) == at)
            i, j = i[here], j[here]
        a, d, oa, od = p[0:3, i], p[6:9, i], r[0:3, j], r[6:9, j]
        c = _dots(d, od)
        away = a - oa
        off = _dots(away, od)
        far = distance + 64 * 2.220446049250313e-16 * np.maximum(np.maximum(np.abs(p[:6, i]).max(0), np.abs(r[:6, j]).max(0)), 1.0)
        with np.errstate(all="ignore"):
            # Where the foot lies within the reference.
            first, last = -off / c, (r[9, j] - off) / c
            low, high = np.maximum(0.0, np.minimum(first, last)), np.minimum(p[9, i], np.maximum(first, last))
            # The vector from the line at t is p + t s; its square is s.s t² + 2 p.s t + p.p, at most far².
            u, s = cross(away, od), cross(d, od)
            ss, ps, pp = _dots(s, s), _dots(u, s), _dots(u, u)
            bent = ss > 0
            room = far * far - (pp - np.where(bent, ps * (ps / ss), 0.0))
            half = np.sqrt(np.maximum(room, 0.0) / ss)
            ok = (c != 0) & (np.abs(c) >= least) & (high > low) & (room >= 0)
            low, high = np.where(bent, np.maximum(low, -ps / ss - half), low), np.where(bent, np.minimum(high, -ps / ss + half), high)
            ok &= high > low
        i, j, low, high, off, c = (v[ok] for v in (i, j, low, high, off, c))
        one, two = off + c * low, off + c * high
        yield i, j, low, high, np.maximum(0.0, np.minimum(one, two)), np.minimum(r[9, j], np.maximum(one, two))


def _along(predicted: DataFrame, reference: DataFrame, distance: float, size: float, fold, schema: str, block: int) -> DataFrame:
    columns = ["id", "kind", *_ENDS, "dx", "dy", "dz", "length"]
    cell = [f"__i{a}" for a in AXES]
    return crowds.meet(_celled(predicted.select(*columns), distance, size), _celled(reference.select(*columns), 0.0, size), ["kind", *cell], fold, schema, block)


def _types(predicted: DataFrame, reference: DataFrame) -> tuple[str, str, str]:
    return tuple(df.schema[c].dataType.simpleString() for df, c in ((predicted, "kind"), (predicted, "id"), (reference, "id")))


def _taken(column: pa.ChunkedArray, rows: np.ndarray) -> pa.Array:
    return column.combine_chunks().take(pa.array(rows))


def matches(predicted: DataFrame, reference: DataFrame, distance: float = 0.1, degrees: float = 5.0, size: float | None = None, block: int = crowds.BLOCK) -> DataFrame:
    """(kind, id, oid, low, high, olow, ohigh): the stretches of predictions (measured) that lie along references of their kind, and the
    stretches of the references that they cover, both as lengths from the first end.

    A point of a prediction counts if its foot on the reference's line lies between the reference's ends and is no farther than the distance,
    and if the two directions, either way round, differ by at most the angle. The distance is a square root of a square function of the
    place, so both bounds are intervals in closed form. Candidates are arrays in a task; only what matches becomes a row.
    """
    size = size or max(1.0, 4 * distance)
    figures = ["low", "high", "olow", "ohigh"]

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_stretches(left, right, distance, degrees, size)) or [[np.zeros(0, int)] * 2 + [np.zeros(0)] * 4]
        i, j, *v = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table([_taken(left.column("kind"), i), _taken(left.column("id"), i), _taken(right.column("id"), j), *[pa.array(c) for c in v]], names=["kind", "id", "oid", *figures])

    kind, key, other = _types(predicted, reference)
    return _along(predicted, reference, distance, size, fold, f"kind {kind}, id {key}, oid {other}, " + ", ".join(f"{c} double" for c in figures), block)


def _union(key: np.ndarray, low: np.ndarray, high: np.ndarray):
    """The unions of the intervals of each key, a row number, as _merged() makes them."""
    if not len(key):
        return key, low, high
    order = np.lexsort((high, low, key))
    key, low, high = key[order], low[order], high[order]
    by = np.argsort(high, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    upto = np.maximum.accumulate(key.astype(np.int64) * len(by) + rank)[:-1]  # the key and the place of its greatest end so far
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] > high[by[upto % len(by)]])])
    start = np.flatnonzero(new)
    return key[start], low[start], np.maximum.reduceat(high, start)


def _lengths(predicted: DataFrame, reference: DataFrame, distance: float, degrees: float, size: float, block: int = crowds.BLOCK) -> DataFrame:
    """(kind, id, oid, low, high, n), a stored table: the unions of a block's matches() along the predictions (id, no oid) and along the references
    (oid, no id), and n, how many predictions of the block match a reference, once for each."""

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, theirs, n = [], [], np.zeros(right.num_rows, np.int64)
        for i, j, low, high, olow, ohigh in _stretches(left, right, distance, degrees, size):
            mine.append(_union(i, low, high))
            theirs.append(_union(j, olow, ohigh))
            n += np.bincount(j, minlength=right.num_rows)
        none = [(np.zeros(0, int), np.zeros(0), np.zeros(0))]
        i, low, high = (np.concatenate(c) for c in zip(*(mine or none), strict=True))  # a row of left is in one part
        j, olow, ohigh = _union(*(np.concatenate(c) for c in zip(*(theirs or none), strict=True)))
        first = np.concatenate([[True], j[1:] != j[:-1]]) if len(j) else np.zeros(0, bool)
        count = np.where(first, n[j], 0)
        nulls = lambda c, rows: pa.nulls(rows, c.type)
        kinds = left.column("kind").combine_chunks() if left.num_rows else right.column("kind").combine_chunks()
        columns = [
            kinds.take(pa.array(np.zeros(len(i) + len(j), int))),
            pa.chunked_array([_taken(left.column("id"), i), nulls(left.column("id"), len(j))], left.column("id").type),
            pa.chunked_array([nulls(right.column("id"), len(i)), _taken(right.column("id"), j)], right.column("id").type),
            pa.array(np.concatenate([low, olow])), pa.array(np.concatenate([high, ohigh])), pa.array(np.concatenate([np.zeros(len(i), np.int64), count])),
        ]
        return pa.table(columns, names=["kind", "id", "oid", "low", "high", "n"])

    kind, key, other = _types(predicted, reference)
    return stored(_along(predicted, reference, distance, size, fold, f"kind {kind}, id {key}, oid {other}, low double, high double, n long", block), "stretches")


def _merged(rows: DataFrame, key: list[str]) -> DataFrame:
    """The unions of the intervals (key, low, high) of each key."""
    w = Window.partitionBy(*key).orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    at = rows.withColumn("__new", F.when(reach.isNull() | (F.col("low") > reach), 1).otherwise(0))
    at = at.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy(*key, "__run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("__run")


def _covered(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, covered): length of the union of each key's intervals."""
    return _merged(rows, key).groupBy(*key).agg(F.sum(F.col("high") - F.col("low")).alias("covered"))


#: Width of the cells of unit directions in which lines meet.
_WAY = 1e-3


def _directed(segments: DataFrame, slack: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """(segments, segments, columns): those on the left, in the columns, meet all on the right on whose lines both of their ends may lie within
    slack, scaled by the greatest coordinate. The ends tell the direction to 2 slack / length; one too short for that meets every direction."""
    most = F.greatest(F.lit(1.0), F.max(F.greatest(*[F.abs(c) for c in _ENDS])))
    loose = 4 * slack * (segments.agg(most).first()[0] or 1.0)
    play = loose / F.col("length") + 1e-12
    short = play > _WAY / 2
    ways = ["__short", *[f"__w{a}" for a in AXES]]
    mine = segments.withColumn("__short", short).withColumn("__sign", F.explode(F.when(short, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(-1.0)))))
    for a in AXES:
        low, high = (F.floor((F.col("__sign") * F.col(f"d{a}") + s * play) / _WAY) for s in (-1, 1))
        mine = mine.withColumn(f"__w{a}", F.explode(F.when(short, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(low, high))))
    twice = F.array(F.lit(False), F.lit(True)) if not segments.filter(short).isEmpty() else F.array(F.lit(False))
    other = segments.withColumn("__short", F.explode(twice))
    other = other.withColumns({f"__w{a}": F.when(F.col("__short"), F.lit(0).cast("long")).otherwise(F.floor(F.col(f"d{a}") / _WAY)) for a in AXES})
    return mine.drop("__sign"), other, ways


def own_intervals(predicted: DataFrame, size: float | None = None, slack: float = 1e-9) -> DataFrame:
    """(kind, id, low, high): the stretches of each prediction (measured) that no earlier one (by id) of its kind lies on; only lines that
    coincide but for rounding, scaled by the coordinates, cover each other. So only lines of one direction, either way round, meet."""
    mine, other, ways = _directed(predicted, slack)
    both = _pairs(mine, other, slack, size or 1.0, ways).filter("o_id < id")
    scale = F.greatest(*[F.abs(F.col(c)) for c in (*_ENDS, *(f"o_{e}" for e in _ENDS))], F.lit(1.0)) * slack
    gap = lambda e: cross([p - q for p, q in zip(_v(e), _v("o_a"), strict=True)], _v("o_d"))
    on = [F.sqrt(dot(g, g)) <= scale for g in (gap("a"), gap("b"))]
    both = both.filter(on[0] & on[1])
    along = [dot([p - q for p, q in zip(_v(e), _v("a"), strict=True)], _v("d")) for e in ("o_a", "o_b")]
    low, high = F.greatest(F.lit(0.0), F.least(*along)), F.least(F.col("length"), F.greatest(*along))
    taken = _merged(both.select("kind", "id", low.alias("low"), high.alias("high")).filter("high > low"), ["kind", "id"])
    # What lies between the taken stretches, and before and behind them.
    w = Window.partitionBy("kind", "id").orderBy("low")
    at = predicted.select("kind", "id", "length").join(taken, ["kind", "id"], "left")
    before = F.coalesce(F.lag("high").over(w), F.lit(0.0))
    parts = F.array(F.struct(before.alias("low"), F.coalesce("low", "length").alias("high")), F.when(F.lead("low").over(w).isNull() & F.col("low").isNotNull(), F.struct(F.col("high").alias("low"), F.col("length").alias("high"))))
    return at.withColumn("__p", parts).select("kind", "id", F.explode("__p").alias("p")).filter("p is not null and p.low < p.high").select("kind", "id", "p.low", "p.high")


def quality(predicted: DataFrame, reference: DataFrame, distance: float = 0.1, degrees: float = 5.0, size: float | None = None) -> DataFrame:
    """One row a kind of either table (id, kind, ax ... bz): raw and own length of the predictions, length of the references, matched lengths
    of both, duplicate and false lengths, precision and recall (null for an empty whole), and fragments, how many predictions match a
    reference, as the sorted list (id, n) of the references that any does.

    A prediction's matched length is that of its own stretches; intervals are united before they are measured, so nothing counts twice.
    """
    p, r = measured(predicted.select("id", "kind", *_ENDS)), measured(reference.select("id", "kind", *_ENDS))
    met = _lengths(p, r, distance, degrees, size or max(1.0, 4 * distance))
    own = own_intervals(p, size)
    found = _merged(met.filter("id IS NOT NULL").select("kind", "id", "low", "high"), ["kind", "id"]).withColumnsRenamed({"low": "mlow", "high": "mhigh"})
    hit = own.join(found, ["kind", "id"]).withColumn("__l", F.least("high", "mhigh") - F.greatest("low", "mlow")).filter("__l > 0")
    theirs = met.filter("oid IS NOT NULL")
    fragments = theirs.groupBy("kind", "oid").agg(F.sum("n").alias("n"))
    total = lambda df, c, name: df.groupBy("kind").agg(F.sum(c).alias(name))
    parts = [
        total(p, "length", "raw"), total(own, F.col("high") - F.col("low"), "own"), total(r, "length", "reference"), total(hit, "__l", "matched"),
        total(_covered(theirs.select("kind", "oid", "low", "high"), ["kind", "oid"]), "covered", "found"),
    ]
    out = p.select("kind").unionByName(r.select("kind")).distinct()
    for part in parts:
        out = out.join(part, "kind", "left")
    out = out.fillna(0.0).join(fragments.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(F.col("oid").alias("id"), "n"))).alias("fragments")), "kind", "left")
    return out.withColumns({"duplicate": F.greatest(F.lit(0.0), F.col("raw") - F.col("own")), "false": F.greatest(F.lit(0.0), F.col("own") - F.col("matched")), "precision": F.try_divide("matched", "own"), "recall": F.try_divide("found", "reference")})
