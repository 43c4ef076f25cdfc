"""Audits and reports of tables: archives against their source, tiles against reports, filter and threshold reports, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import shared


def row_digest(columns: list[str]) -> Column:
    """A 64-bit digest of the values, null told from everything else; -0 equals 0."""
    parts = []
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def archive_audit(source: DataFrame, archive: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: rows of either side, and how many keys of the source are missing, doubled or altered in the archive, and how many of the
    archive are strange. Both sides are reduced to a count and a digest a key before they meet."""
    side = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"n{n}"), F.sum(row_digest(columns).cast("decimal(38,0)")).alias(f"d{n}")).withColumnRenamed(key, f"k{n}")
    both = side(source, 0).join(side(archive, 1), F.col("k0").eqNullSafe(F.col("k1")), "full")
    n0, n1 = F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))
    return both.agg(
        F.coalesce(F.sum(n0), F.lit(0)).alias("source"), F.coalesce(F.sum(n1), F.lit(0)).alias("archive"), F.count_if((n0 > 0) & (n1 == 0)).alias("missing"), F.count_if((n0 > 0) & (n1 > n0)).alias("doubled"),
        F.count_if((n0 > 0) & (n0 == n1) & (F.col("d0") != F.col("d1"))).alias("altered"), F.count_if((n0 == 0) & (n1 > 0)).alias("strange"),
    )


def misplaced(points: DataFrame, size: float) -> DataFrame:
    """Rows whose tile (tx, ty) isn't that of their place."""
    wrong = reduce(Column.__or__, [F.floor(F.col(a).cast("float").cast("double") / size) != F.col(f"t{a}") for a in "xy"])
    return points.filter(wrong)


def resume_audit(found: DataFrame, said: DataFrame, key: list[str], figure: str) -> DataFrame:
    """(key, found, said) where the figure found differs from what a report said, or one of the two is missing."""
    on = reduce(Column.__and__, [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key])
    both = found.alias("f").join(said.alias("s"), on, "full")
    names = [F.coalesce(F.col(f"f.{k}"), F.col(f"s.{k}")).alias(k) for k in key]
    return both.filter(~F.col(f"f.{figure}").eqNullSafe(F.col(f"s.{figure}"))).select(*names, F.col(f"f.{figure}").alias("found"), F.col(f"s.{figure}").alias("said"))


def label_audit(rows: DataFrame, labels: DataFrame, domain: list[int]) -> DataFrame:
    """One row: rows without a label, with several, with one outside of the domain, and labels of unknown rows."""
    l_ = labels.groupBy(F.col("id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"), F.count_if(~F.col("label").isin(domain)).alias("__bad"))
    both = rows.select("id").join(l_, F.col("id") == F.col("__id"), "full")
    return both.agg(F.count_if(F.col("__n").isNull()).alias("unlabelled"), F.count_if(F.col("id").isNotNull() & (F.col("__n") > 1)).alias("several"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("outside"), F.count_if(F.col("id").isNull()).alias("unknown"))


def quantiles(rows: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """(q, v): quantiles of a whole column, linear between neighbours, nulls left out; nothing for an empty one.

    Equal values are counted first. A range partition and partial sums place the two ranks of each quantile, so no task and
    no buffer holds the column.
    """
    shared(rows.sparkSession)
    each = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    spread = each.repartitionByRange("v").withColumn("part", F.spark_partition_id()).checkpoint()
    parts = spread.groupBy("part").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    total = parts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return rows.sparkSession.createDataFrame([], "q double, v double")
    w = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = spread.join(F.broadcast(parts.select("part", "before")), "part").withColumn("last", F.col("before") + F.sum("n").over(w) - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    at = [(q, int((total - 1) * q), (total - 1) * q - int((total - 1) * q)) for q in qs]
    hit = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k + up).cast("long").alias("rank"), F.lit(w_ if up else 1.0 - w_).alias("w")) for i, (_, k, w_) in enumerate(at) for up in (0, 1)]))
    want = ranked.withColumn("h", hit).filter((F.col("h.rank") >= F.col("first")) & ((F.col("h.rank") <= F.col("last"))) & (F.col("h.w") > 0))
    got = want.groupBy("h.i").agg(F.sum(F.col("v") * F.col("h.w")).alias("v"))
    return got.select(F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("i") + 1).alias("q"), "v")


def filter_report(decisions: DataFrame, keep: str, value: str) -> DataFrame:
    """One row: records, retained, removed, their shares, and mean and sample deviation of the value; nulls for no record."""
    c = decisions.agg(F.count(F.lit(1)).alias("records"), F.count_if(keep).alias("retained"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
    removed = F.col("records") - F.col("retained")
    return c.select("records", "retained", removed.alias("removed"), F.try_divide(F.col("retained"), F.col("records")).alias("retained_share"), F.try_divide(removed, F.col("records")).alias("removed_share"), "mean", "deviation")


def threshold_rows(decisions: DataFrame, thresholds: list[int], first: str) -> DataFrame:
    """(threshold, kept, kept_after): of decisions with keep_t columns and a first filter's decision, rows that each threshold keeps, and
    those that both keep."""
    flags = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"keep_{t}").alias("k")) for t in thresholds])).alias("f")
    each = decisions.select(F.col(first).alias("__first"), flags)
    return each.groupBy("f.threshold").agg(F.count_if("f.k").alias("kept"), F.count_if(F.col("f.k") & F.col("__first")).alias("kept_after"))


def crossed_counts(points: DataFrame, keep: str, cells: list[str]) -> DataFrame:
    """points with n: how many rows that the filter keeps share the cell, 0 for a row that it drops."""
    n = points.filter(keep).groupBy(*cells).agg(F.count(F.lit(1)).alias("__n"))
    return points.join(n, cells, "left").withColumn("n", F.when(F.col(keep), F.col("__n")).otherwise(F.lit(0))).drop("__n")


def frequencies(points: DataFrame, keep: str, cells: list[str]) -> DataFrame:
    """(n, before, after): how many cells hold n rows, all and those that the filter keeps."""
    c = points.groupBy(*cells).agg(F.count(F.lit(1)).alias("all"), F.count_if(keep).alias("kept"))
    each = c.select(F.explode(F.array(F.struct(F.col("all").alias("n"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.col("kept").alias("n"), F.lit(0).alias("b"), F.lit(1).alias("a")))).alias("e")).select("e.*")
    return each.filter("n > 0").groupBy("n").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))


def rolled_up(reports: DataFrame, key: str, counters: list[str], named: str) -> DataFrame:
    """One row: regions, the counters' sums, how many regions have any of `named`, and the sorted keys of those that have none."""
    none = F.array_join(F.array_sort(F.collect_set(F.when(F.col(named) == 0, F.col(key)))), ",")  # one short name a region without any
    return reports.agg(F.count(F.lit(1)).alias("regions"), *[F.sum(c).alias(c) for c in counters], F.count_if(F.col(named) > 0).alias("filled"), none.alias("empty"))


def assigned(rows: DataFrame, column: str, prefixes: list[tuple[str, str]], other: str) -> Column:
    """Name of the first prefix that the column starts with."""
    out = None
    for name, prefix in prefixes:
        c = F.col(column).startswith(prefix)
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(other)


def latest(requests: DataFrame, key: str, revision: str, columns: list[str]) -> DataFrame:
    """(key, columns) of the request of the greatest revision; older ones are stale."""
    return requests.groupBy(key).agg(F.max_by(F.struct(*columns), revision).alias("m")).select(key, "m.*")


def solid_audit(faces: DataFrame) -> DataFrame:
    """(owner, faces, open, tangled, closed): a surface is closed if every edge has two faces."""
    from . import meshes

    e = meshes.multiplicities(faces).groupBy("owner").agg(F.count_if(F.col("n") == 1).alias("open"), F.count_if(F.col("n") > 2).alias("tangled"))
    f = faces.groupBy("owner").agg(F.count(F.lit(1)).alias("faces"))
    return f.join(e, "owner").withColumn("closed", (F.col("open") == 0) & (F.col("tangled") == 0))


def bounds_audit(rows: DataFrame, said: DataFrame, key: list[str], axes: str = "xyz") -> DataFrame:
    """(key, n, outside): rows of each key, and those that its reported bounds (key, l., u.) don't hold; all, where none are reported."""
    both = rows.join(said, key, "left")
    inside = reduce(Column.__and__, [(F.col(a) >= F.col(f"l{a}")) & (F.col(a) <= F.col(f"u{a}")) for a in axes])
    return both.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside"))


def class_view(decisions: DataFrame) -> DataFrame:
    """decisions (sor_keep, rejected, keep) with class: kept, geometry or distance; keep must be sor_keep without the rejected, else
    reading the row raises an error."""
    right = F.col("keep") == (F.col("sor_keep") & ~F.col("rejected"))
    name = F.when(F.col("keep"), "kept").when(F.col("sor_keep"), "geometry").otherwise("distance")
    return decisions.withColumn("class", F.when(right, name).otherwise(F.raise_error(F.lit("a decision isn't what its parts say"))))


def covered_terrain(boxes: DataFrame, cells: DataFrame, corners: DataFrame, error: float) -> DataFrame:
    """(box, covered): whether every cell (i, j) of a box (box, lx, ux, ly, uy: cell ranges, low, high) is on the lattice, with all its
    corners within error of the box's range of heights."""
    out = boxes
    for a, c in (("x", "i"), ("y", "j")):
        out = out.withColumn(c, F.explode(F.sequence(f"l{a}", f"u{a}")))
    z = [F.col(c) for c in ("z00", "z10", "z11", "z01")]
    fits = (F.least(*z) >= F.col("low") - error) & (F.greatest(*z) <= F.col("high") + error)
    at = out.join(cells.select("i", "j").distinct().join(corners, ["i", "j"]), ["i", "j"], "left")
    return at.groupBy("box").agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("covered"))


#: What a map's summary says.
TOTALS = ("records", "triangles", "mesh_vertices", "occupied_tiles")
_PLACES = [f"{c}{a}" for c in "abc" for a in "xyz"]


def _with_corners(faces: DataFrame, source: DataFrame) -> DataFrame:
    """faces with the places of their corners, ax ... cz; null where the source has no such row."""
    for c in "abc":
        faces = faces.join(source.select(F.col("id").alias(c), *[F.col(a).cast("double").alias(f"{c}{a}") for a in "xyz"]), c, "left")
    return faces


def centred(faces: DataFrame, source: DataFrame, size: float) -> DataFrame:
    """(tx, ty, face, a, b, c): faces with the tile of their centre."""
    at = _with_corners(faces.select("face", "a", "b", "c"), source)
    tile = lambda a: F.floor((F.col(f"a{a}") + F.col(f"b{a}") + F.col(f"c{a}")) / 3 / size)
    return at.select(tile("x").alias("tx"), tile("y").alias("ty"), "face", "a", "b", "c")


def surface_corners(faces: DataFrame, source: DataFrame) -> DataFrame:
    """(tx, ty, id, x, y, z): the rows that a tile's faces use, each once a tile; places are null for strange ids."""
    used = faces.select("tx", "ty", F.explode(F.array("a", "b", "c")).alias("id")).distinct()
    return used.join(source.select("id", "x", "y", "z"), "id", "left").select("tx", "ty", "id", "x", "y", "z")


def map_totals(tiles: DataFrame, faces: DataFrame) -> DataFrame:
    """One row of TOTALS: rows and tiles of the archive, faces, and the rows that faces use, counted by tile."""
    used = faces.select("tx", "ty", F.explode(F.array("a", "b", "c")).alias("id")).distinct().agg(F.count(F.lit(1)).alias("mesh_vertices"))
    kept = tiles.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("occupied_tiles"))
    return kept.join(faces.agg(F.count(F.lit(1)).alias("triangles"))).join(used).select(*TOTALS)  # one row each


def map_audit(source: DataFrame, tiles: DataFrame, faces: DataFrame, reports: DataFrame, bounds: DataFrame, summary: DataFrame, size: float) -> DataFrame:
    """One row: what a map holds, how often each rule is broken, and passed: none is.

    source (id, x, y, z, ...) and tiles (tx, ty and the same): rows that are missing, doubled, altered or strange in the archive, or
    misplaced; faces (tx, ty, face, a, b, c): strange_corners, corners that are no row, and foreign, faces whose centre lies in another tile;
    reports (tx, ty, records, triangles): wrong_reports, tiles whose figures differ or that have no report, or one for nothing;
    bounds (tx, ty, lx ... uz): wrong_bounds, surfaces without bounds or bounds without a surface, and outside, corners beyond them;
    summary (TOTALS, one row): wrong_totals, figures that differ. Every part is an aggregate; only counts meet.
    """
    own = [c for c in source.columns if c != "id"]
    kept = archive_audit(source, tiles, "id", own).select("missing", "doubled", "altered", "strange")
    stray = misplaced(tiles, size).agg(F.count(F.lit(1)).alias("misplaced"))
    at = _with_corners(faces, source)
    lost = sum((F.col(f"{c}x").isNull().cast("int") for c in "bc"), F.col("ax").isNull().cast("int"))
    centre = {a: F.floor((F.col(f"a{a}") + F.col(f"b{a}") + F.col(f"c{a}")) / 3 / size) for a in "xy"}
    shape = at.agg(F.coalesce(F.sum(lost), F.lit(0)).alias("strange_corners"), F.count_if((lost == 0) & ((centre["x"] != F.col("tx")) | (centre["y"] != F.col("ty")))).alias("foreign"))
    there = tiles.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("__records"))
    made = faces.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("__triangles"))
    found = there.join(made, ["tx", "ty"], "full").withColumn("__found", F.lit(True))
    said = found.join(reports.select("tx", "ty", "records", "triangles").withColumn("__said", F.lit(True)), ["tx", "ty"], "full")
    same = F.col("__found") & F.col("__said") & (F.coalesce("__records", F.lit(0)) == F.col("records")) & (F.coalesce("__triangles", F.lit(0)) == F.col("triangles"))
    figures = said.agg(F.count_if(~F.coalesce(same, F.lit(False))).alias("wrong_reports"))
    names = [f"{n}{a}" for a in "xyz" for n in "lu"]
    held = made.join(bounds.select("tx", "ty", *names).withColumn("__b", F.lit(True)), ["tx", "ty"], "full").agg(F.count_if(F.col("__triangles").isNull() | F.col("__b").isNull()).alias("wrong_bounds"))
    inside = reduce(Column.__and__, [F.col(a).between(F.col(f"l{a}"), F.col(f"u{a}")) for a in "xyz"])
    beyond = surface_corners(faces, source).join(bounds.select("tx", "ty", *names), ["tx", "ty"]).agg(F.count_if(~inside).alias("outside"))
    totals = map_totals(tiles, faces)
    sums = totals.join(summary.select(*[F.col(c).alias(f"__{c}") for c in TOTALS])).select(*TOTALS, sum(((~F.col(c).eqNullSafe(F.col(f"__{c}"))).cast("int") for c in TOTALS[1:]), (~F.col(TOTALS[0]).eqNullSafe(F.col(f"__{TOTALS[0]}"))).cast("int")).alias("wrong_totals"))
    out = sums
    for part in (kept, stray, shape, figures, held, beyond):  # one row each
        out = out.join(part)
    rules = ["missing", "doubled", "altered", "strange", "misplaced", "strange_corners", "foreign", "wrong_reports", "wrong_bounds", "outside", "wrong_totals"]
    return out.select(*TOTALS, *[F.col(r).cast("long").alias(r) for r in rules], reduce(Column.__and__, [F.col(r) == 0 for r in rules]).alias("passed"))
