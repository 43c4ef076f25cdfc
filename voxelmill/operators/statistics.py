"""Figures of columns and groups: histograms, weighted quantiles, moments of components, guarded ratios, retuned outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import shared
from .cells import AXES


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, n) of equal widths from the least to the greatest value, the last bin closed, empty bins with 0.

    Where all values are equal the range is half a unit to each side. Without a value there are no bins.
    """
    v = F.col(value).cast("double")
    box = rows.filter(v.isNotNull()).agg(F.min(v).alias("lo"), F.max(v).alias("hi")).filter("lo IS NOT NULL")
    flat = F.col("lo") == F.col("hi")
    box = box.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    n = rows.filter(v.isNotNull()).select(v.alias("v")).join(F.broadcast(box)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row
    step = (F.col("hi") - F.col("lo")) / bins
    whole = box.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    whole = whole.select("bin", (F.col("lo") + F.col("bin") * step).alias("low"), F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * step).alias("high"))
    return whole.join(n, "bin", "left").fillna(0, ["n"])


def weighted_quantile(rows: DataFrame, key: str, value: str, weight: str, q: float) -> DataFrame:
    """(key, q): the first value at which the weight of values up to it reaches q of all weight of the key.

    Equal values are one row first; a range partition by key and value and partial sums place the running weight, so a key of many
    values is many tasks' work. What misses q by no more than sums of doubles do (a part in 10^12) reaches it, so the order in which
    weights are added doesn't decide.
    """
    shared(rows.sparkSession)
    each = rows.groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    spread = each.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()).checkpoint()
    parts = spread.groupBy("k", "part").agg(F.sum("w").alias("w"))  # a key has one row a partition
    of = Window.partitionBy("k")
    before = F.coalesce(F.sum("w").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = parts.select(F.col("k").alias("__k"), F.col("part").alias("__p"), before.alias("before"), F.sum("w").over(of).alias("all"))
    running = F.sum("w").over(Window.partitionBy("part", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    at = spread.withColumn("below", running).join(parts, F.col("k").eqNullSafe(F.col("__k")) & (F.col("part") == F.col("__p")))
    hit = at.filter(F.col("before") + F.col("below") >= F.col("all") * q * (1 - 1e-12))
    return hit.groupBy(F.col("k").alias(key)).agg(F.min("v").alias("q"))


def component_moments(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n, bounds, means and the six population covariances) of the points (id, x, y, z) of each label."""
    of = points.select("id", *AXES).join(labels.select("id", "label"), "id")
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    bounds = [f(a).alias(f"{name}_{a}") for a in AXES for f, name in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))]
    return of.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *bounds, *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def capacity(rows: DataFrame, found: Column, real: Column) -> DataFrame:
    """One row: hits, precision and recall of found against real."""
    c = rows.agg(F.count_if(found & real).alias("hits"), F.count_if(found).alias("found"), F.count_if(real).alias("real"))
    return c.select("hits", ratio(F.col("hits"), F.col("found")).alias("precision"), ratio(F.col("hits"), F.col("real")).alias("recall"))


def third_largest(neighbours: DataFrame, value: str, least: int) -> DataFrame:
    """(id, third): third largest value among the neighbour rows of an id that has at least `least` of them."""
    w = Window.partitionBy("id").orderBy(F.desc(value))
    ranked = neighbours.withColumn("__r", F.row_number().over(w))
    return ranked.groupBy("id").agg(F.max(F.when(F.col("__r") == 3, F.col(value))).alias("third"), F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).drop("__n")


def cyclic_gap(rows: DataFrame, angle: str) -> DataFrame:
    """(id, gap): widest angle in degrees between neighbouring directions of an id, the step over 360 included."""
    w = Window.partitionBy("id").orderBy(angle)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead(angle).over(w), F.first(angle).over(whole) + 360.0)
    return rows.withColumn("__g", following - F.col(angle)).groupBy("id").agg(F.max("__g").alias("gap"))


def iterative_outliers(points: DataFrame, k: int, limit: float, passes: int, factors) -> DataFrame:
    """(id, pass): points that a pass of local outlier factors removed (factor above the limit), null for those that stay.

    Every pass searches among the points that the ones before it left; it ends early when a pass removes none, or leaves k points or
    fewer. As few to begin with are an error. factors is outlier_factors. The rows left are written to the checkpoint folder between passes.
    """
    left, gone = points, None
    for number in range(1, passes + 1):
        if number > 1 and left.limit(k + 1).count() <= k:
            break
        bad = factors(left, (k,)).filter(F.col("lof") > limit).select("id", F.lit(number).alias("pass")).checkpoint()
        if bad.isEmpty():
            break
        gone = bad if gone is None else gone.unionByName(bad)
        left = left.join(bad, "id", "left_anti").checkpoint()
    if gone is None:
        return points.select("id", F.lit(None).cast("int").alias("pass"))
    return points.select("id").join(gone, "id", "left")
