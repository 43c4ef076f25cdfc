"""Ordered rows of a key: gaps and islands, sessions, sample-and-hold, episodes, interpolation, latest command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def runs(rows: DataFrame, over: WindowSpec, starts: Column, name: str = "run") -> DataFrame:
    """rows with the number of the run that they are in: a run starts where `starts` holds; the first row starts one."""
    flag = F.when(F.row_number().over(over) == 1, 1).when(starts, 1).otherwise(0)
    return rows.withColumn("__f", flag).withColumn(name, F.sum("__f").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def sessions(rows: DataFrame, over: WindowSpec, time: str, gap: int) -> DataFrame:
    """rows with session: a new one after more than gap without a row."""
    return runs(rows, over, F.col(time) - F.lag(time).over(over) > gap, "session")


def sample_hold(rows: DataFrame, over: WindowSpec, value: str, every: int) -> DataFrame:
    """rows with held: the value of the first row of each `every` rows."""
    n = F.floor((F.row_number().over(over) - 1) / every)
    held = F.when((F.row_number().over(over) - 1) % every == 0, F.col(value))
    return rows.withColumn("slot", n).withColumn("held", F.last(held, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0)))


def episodes(rows: DataFrame, over: WindowSpec, done: Column) -> DataFrame:
    """rows with episode: how many rows before them were done."""
    flag = F.when(done, 1).otherwise(0)
    return rows.withColumn("episode", F.coalesce(F.sum(flag).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def latest(rows: DataFrame, over: WindowSpec, is_command: Column, value: str, time: str, expires: int) -> DataFrame:
    """rows with command: value of the last command up to them, 0 if none or older than expires."""
    whole = over.rowsBetween(Window.unboundedPreceding, 0)
    v = F.last(F.when(is_command, F.col(value)), ignorenulls=True).over(whole)
    t = F.last(F.when(is_command, F.col(time)), ignorenulls=True).over(whole)
    return rows.withColumn("command", F.when(F.coalesce(F.col(time) - t > expires, F.lit(True)), 0.0).otherwise(v))


def interpolated(rows: DataFrame, over: WindowSpec, known: Column, time: str, value: str) -> DataFrame:
    """rows with lerp: value at rows that are known, in between on the line, beyond the ends the end's value."""
    before, after = over.rowsBetween(Window.unboundedPreceding, 0), over.rowsBetween(0, Window.unboundedFollowing)
    t, v = F.when(known, F.col(time)), F.when(known, F.col(value))
    t0, v0 = (F.last(c, ignorenulls=True).over(before) for c in (t, v))
    t1, v1 = (F.first(c, ignorenulls=True).over(after) for c in (t, v))
    line = F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (F.col(time) - t0) / (t1 - t0))
    return rows.withColumn("lerp", F.coalesce(line, v0, v1))


def merged(intervals: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """(key, low, high): unions of the closed intervals that touch."""
    w = Window.partitionBy(key).orderBy(low, high)
    top = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs(intervals.withColumn("__t", top), w, F.col(low) > F.col("__t")).groupBy(key, "run").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("run")
