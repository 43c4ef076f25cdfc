"""State rows of a moving thing: fresh stamps, rest, debouncing, residency, paths, depth-limited queues."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .sequences import runs


def fresh(rows: DataFrame, key: str, order: list[str], stamp: str) -> DataFrame:
    """rows with fresh: whether the stamp is above all stamps of the key before it; and missed: how many rows in a row up to this one
    are not."""
    over = Window.partitionBy(key).orderBy(*order)
    top = F.max(stamp).over(over.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("fresh", F.coalesce(F.col(stamp) > top, F.lit(True)))
    out = out.withColumn("__r", F.sum(F.col("fresh").cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("missed", F.row_number().over(Window.partitionBy(key, "__r").orderBy(*order)) - 1).drop("__r")


def settled(rows: DataFrame, over: WindowSpec, still: Column, key: str, time: str, least: float) -> DataFrame:
    """(key, since, until): stretches of rows in which the condition holds throughout, for `least` or longer."""
    flagged = rows.withColumn("__s", F.coalesce(still, F.lit(False)))
    marked = runs(flagged, over, F.col("__s") != F.lag("__s").over(over))
    out = marked.filter("__s").groupBy(key, "run").agg(F.min(time).alias("since"), F.max(time).alias("until"))
    return out.filter(F.col("until") - F.col("since") >= least).drop("run")


def immobile(rows: DataFrame, key: str, order: list[str], time: str, axes: list[str], span: float, most: float) -> DataFrame:
    """(key, moved, immobile): the farthest from its first place that a key has come within span of its first row."""
    w = Window.partitionBy(key).orderBy(*order)
    t0 = F.first(time).over(w)
    d = [F.col(a) - F.first(a).over(w) for a in axes]
    away = F.sqrt(reduce(Column.__add__, [c * c for c in d]))
    out = rows.select(key, away.alias("__a"), (F.col(time) - t0 <= span).alias("__in")).filter("__in").groupBy(key).agg(F.max("__a").alias("moved"))
    return out.withColumn("immobile", F.col("moved") <= most)


def paths(rows: DataFrame, over: WindowSpec, key: str, axes: list[str]) -> DataFrame:
    """(key, rows, length, straight): length of the way through a key's places, and from its first to its last one."""
    step = [F.col(a) - F.lag(a).over(over) for a in axes]
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = [F.last(a).over(whole) - F.first(a).over(whole) for a in axes]
    norm = lambda d: F.sqrt(reduce(Column.__add__, [c * c for c in d]))
    out = rows.select(key, norm(step).alias("__d"), norm(end).alias("__e"))
    return out.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("__d"), F.lit(0.0)).alias("length"), F.max("__e").alias("straight"))


def queued(rows: DataFrame, key: str, order: list[str], depth: int) -> DataFrame:
    """The last `depth` rows of each key: what a queue of that depth holds that drops its oldest."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= depth).drop("__n")


def accepted(rows: DataFrame, values: list[str]) -> DataFrame:
    """rows with taken: whether all values are finite numbers."""
    ok = reduce(Column.__and__, [F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) & (F.abs(F.col(v).cast("double")) < float("inf")) for v in values])
    return rows.withColumn("taken", ok)


def residency(rows: DataFrame, payloads: DataFrame, key: str, order: list[str], radius: float) -> DataFrame:
    """(key, payload, since, until): which payloads (payload, px, py) are loaded as a key moves (x, y), by numbers of its rows.

    A key looks again once it has moved the threshold, the lesser of 5 and radius / 6, from where it last looked. A payload enters
    within radius and stays until it is radius plus twice the threshold away; until is null while it is loaded. The payloads are
    the few that a world has: their number is checked, since every key folds over them in order.
    """
    if payloads.count() > 10_000:
        raise ValueError("too many payloads to hold at each key")
    table = payloads.select("payload", "px", "py").toPandas().sort_values("payload")
    names, px, py = table["payload"].tolist(), table["px"].to_numpy(float), table["py"].to_numpy(float)
    step = min(5.0, radius / 6)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        last, since, out = None, np.full(len(names), -1), []
        pdf = pdf.sort_values(order)
        for n, (x, y) in enumerate(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)):
            if last is not None and ((x - last[0]) ** 2 + (y - last[1]) ** 2) ** 0.5 < step:
                continue
            last = (x, y)
            away, held = ((px - x) ** 2 + (py - y) ** 2) ** 0.5, since >= 0
            gone, new = held & (away > radius + 2 * step), ~held & (away <= radius)
            out += [(names[k], int(since[k]), n) for k in np.flatnonzero(gone)]
            since[gone], since[new] = -1, n
        out += [(names[k], int(since[k]), None) for k in np.flatnonzero(since >= 0)]
        made = pd.DataFrame(out, columns=["payload", "since", "until"])
        made.insert(0, key, pdf[key].iloc[0])
        return made.astype({"since": "int64", "until": "Int64"})

    kind = rows.schema[key].dataType.simpleString()
    payload = payloads.schema["payload"].dataType.simpleString()
    # The work of a row doesn't show in the bytes that are shuffled, so the number of partitions follows the rows.
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, min(8192, rows.count() // 20_000))
    return rows.select(key, *order, "x", "y").repartition(parts, key).groupBy(key).applyInPandas(fold, f"{key} {kind}, payload {payload}, since long, until long")
