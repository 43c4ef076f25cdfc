"""Ordered rows and sets: best rows, runs on bins, batches, circular runs, ranks, focal filters, rectangles, lists, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .sequences import runs


def best(rows: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """(key, columns): the first row of each key in the order, by a partial aggregate: order columns rise, negate one to make it fall."""
    names = [f"__o{i}" for i in range(len(order))]
    top = F.min(F.struct(*[o.alias(n) for n, o in zip(names, order, strict=True)], *[F.col(c).alias(f"__c{c}") for c in columns])).alias("m")
    return rows.groupBy(key).agg(top).select(key, *[F.col(f"m.__c{c}").alias(c) for c in columns])


def bin_runs(rows: DataFrame, key: str, bin_: str, gap: int, least: float) -> DataFrame:
    """(key, first, last, bins): runs of occupied bins that are cut where a step is above gap, of those in which at least a share
    `least` of the bins from first to last is occupied."""
    one = rows.select(key, bin_).distinct()
    w = Window.partitionBy(key).orderBy(bin_)
    got = runs(one, w, F.col(bin_) - F.lag(bin_).over(w) > gap).groupBy(key, "run").agg(F.min(bin_).alias("first"), F.max(bin_).alias("last"), F.count(F.lit(1)).alias("bins"))
    return got.filter(F.col("bins") / (F.col("last") - F.col("first") + 1) >= least).drop("run")


def central_run(rows: DataFrame, key: str, bin_: str, gap: int, middle: int) -> DataFrame:
    """(key, first, last, bins): of a key's runs the one closest to the middle bin, then the largest, then the first."""
    got = bin_runs(rows, key, bin_, gap, 0.0)
    away = F.greatest(F.col("first") - middle, middle - F.col("last"), F.lit(0))
    return best(got, key, [away, -F.col("bins"), F.col("first")], ["first", "last", "bins"])


def batches(rows: DataFrame, over: WindowSpec, size: Column, limit: float) -> DataFrame:
    """rows with before (the sizes in front of a row) and batch: a new one each time that sum passes a further multiple of limit."""
    whole = F.coalesce(F.sum(size).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("double"))
    return rows.withColumn("before", whole).withColumn("batch", F.floor(F.col("before") / limit))


def longest_gap(rows: DataFrame, key: str, order: list[str], good: Column, weight: str, closed: bool) -> DataFrame:
    """(key, longest): the most weight in a row of rows that aren't good, 0 if there is none. On a closed curve the last and the first
    rows follow each other; one without any good row is one run."""
    w = Window.partitionBy(key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = rows.withColumn("__g", good).withColumn("__n", F.sum(F.col("__g").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("__all", F.sum(F.col("__g").cast("int")).over(whole))
    # The run of bad rows behind the last good one goes on in front of the first.
    run = F.when(F.lit(closed) & (F.col("__n") == F.col("__all")), F.lit(0)).otherwise(F.col("__n"))
    bad = at.withColumn("__run", run).groupBy(key, "__run").agg(F.sum(F.when(F.col("__g"), 0.0).otherwise(F.col(weight))).alias("__w"))
    return bad.groupBy(key).agg(F.max("__w").alias("longest"))


def focal(cells: DataFrame, value: str, reach: int, sigma: float = 1.0) -> DataFrame:
    """(ix, iy, low, middle, high, smooth) of the occupied cells: least, median, greatest and Gaussian mean of the value over the occupied
    cells at most reach steps away on either axis. A static list of offsets and one join."""
    steps = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
    moves = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(math.exp(-0.5 * (a * a + b * b) / sigma**2)).alias("g")) for a, b in steps])
    sent = cells.select((F.col("ix")).alias("sx"), F.col("iy").alias("sy"), F.col(value).alias("__v"), F.explode(moves).alias("m"))
    sent = sent.select((F.col("sx") + F.col("m.dx")).alias("ix"), (F.col("sy") + F.col("m.dy")).alias("iy"), "__v", F.col("m.g").alias("__g"))
    near = cells.select("ix", "iy").join(sent, ["ix", "iy"]).groupBy("ix", "iy")
    return near.agg(F.min("__v").alias("low"), F.median("__v").alias("middle"), F.max("__v").alias("high"), (F.sum(F.col("__v") * F.col("__g")) / F.sum("__g")).alias("smooth"))


def peaks(cells: DataFrame, value: str, reach: int, least: float) -> DataFrame:
    """(ix, iy, value): cells whose value is above least and the greatest within reach."""
    top = focal(cells, value, reach).select("ix", "iy", "high")
    return cells.join(top, ["ix", "iy"]).filter((F.col(value) == F.col("high")) & (F.col(value) > least)).select("ix", "iy", value)


def rectangles(cells: DataFrame) -> DataFrame:
    """(x0, x1, y0, y1): the occupied cells (ix, iy) as rectangles: runs along x, equal runs of rows that follow each other as one."""
    w = Window.partitionBy("iy").orderBy("ix")
    one = cells.select("ix", "iy").distinct()
    rows = runs(one, w, F.col("ix") - F.lag("ix").over(w) > 1).groupBy("iy", "run").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"))
    v = Window.partitionBy("x0", "x1").orderBy("iy")
    return runs(rows.drop("run"), v, F.col("iy") - F.lag("iy").over(v) > 1).groupBy("x0", "x1", "run").agg(F.min("iy").alias("y0"), F.max("iy").alias("y1")).drop("run")


def relative_heights(points: DataFrame, size: float, share: float = 0.1) -> DataFrame:
    """(id, height): z above the ground of the point's cell: the cells' quantile of z, least over 5 x 5 cells, median over 3 x 3 of those.
    Cells without a point lend nothing to their neighbours."""
    at = points.withColumns({f"i{a}": F.floor(F.col(a) / size) for a in "xy"})
    low = at.groupBy("ix", "iy").agg(F.percentile("z", share).alias("q"))
    least = focal(low, "q", 2).select("ix", "iy", F.col("low").alias("q"))
    ground = focal(least, "q", 1).select("ix", "iy", F.col("middle").alias("ground"))
    return at.join(ground, ["ix", "iy"]).select("id", (F.col("z") - F.col("ground")).alias("height"))


def resampled(vertices: DataFrame, key: str, order: str, step: float) -> DataFrame:
    """(key, k, x, y, z, weight): points along each open polyline (key, order, x, y, z), evenly spaced by step or a little less, both ends
    among them; weight is the length that a point stands for: half a step at the ends. A line of no length gives nothing."""
    w = Window.partitionBy(key).orderBy(order)
    d = [F.lead(a).over(w) - F.col(a) for a in "xyz"]
    at = vertices.withColumn("__d", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).withColumns({f"__{a}": F.lead(a).over(w) for a in "xyz"})
    at = at.withColumn("__s", F.coalesce(F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    at = at.withColumn("__all", F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).filter("__d > 0")
    n = F.ceil(F.col("__all") / step)
    at = at.withColumn("__n", n).withColumn("__step", F.col("__all") / F.col("__n"))
    # A sample belongs to the piece that begins at it or before it; the last one to the piece that ends the line.
    ends = F.col("__s") + F.col("__d") >= F.col("__all") * (1 - 1e-12)
    last = F.when(ends, F.col("__n")).otherwise(F.ceil((F.col("__s") + F.col("__d")) / F.col("__step")) - 1)
    first = F.ceil(F.col("__s") / F.col("__step"))
    out = at.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    t = F.least((F.col("k") * F.col("__step") - F.col("__s")) / F.col("__d"), F.lit(1.0))
    weight = F.when((F.col("k") == 0) | (F.col("k") == F.col("__n")), F.col("__step") / 2).otherwise(F.col("__step"))
    return out.select(key, "k", *[(F.col(a) + t * (F.col(f"__{a}") - F.col(a))).alias(a) for a in "xyz"], weight.alias("weight"))


def evidence(reports: DataFrame, key: str) -> DataFrame:
    """(key, kept, changed, lost, open) of the reports (key, kept, changed, lost, unknown: arrays): kept is what all keep and none
    names otherwise, changed and lost what any names (lost wins), open what any can't tell and none names as changed or lost."""
    any_ = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    n = F.count(F.lit(1))
    got = reports.groupBy(key).agg(n.alias("__n"), F.flatten(F.collect_list(F.array_distinct("kept"))).alias("__k"), any_("changed").alias("__c"), any_("lost").alias("lost"), any_("unknown").alias("__u"))
    bad = F.array_union("__c", F.array_union("lost", "__u"))
    kept = F.filter(F.array_distinct("__k"), lambda x: F.size(F.filter("__k", lambda y: y == x)) == F.col("__n"))
    return got.select(key, F.array_sort(F.array_except(kept, bad)).alias("kept"), F.array_sort(F.array_except("__c", "lost")).alias("changed"), F.array_sort("lost").alias("lost"), F.array_sort(F.array_except("__u", F.array_union("__c", "lost"))).alias("open"))
