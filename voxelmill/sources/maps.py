"""Maps and filter results as wholes: published together, read back and judged in one row."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, cells, statistics
from . import sinks

LEVELS = [0.0, 0.01, 0.5, 0.9, 0.95, 0.99, 1.0]


def _fresh(spark: SparkSession, path: str) -> None:
    """Refuses a folder that holds something."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(at) and (not store.getFileStatus(at).isDirectory() or len(store.listStatus(at))):
        raise ValueError(f"{path} holds something already")


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/report").first()[0])


def _counted(rows: DataFrame, column: str) -> dict:
    """n, and whether the column's values are n different ones."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(column).alias("ids")).first().asDict()


def publish_filter(records: DataFrame, decisions: DataFrame, path: str, config: dict, ratio: float) -> dict:
    """Writes the records (id, ...), the decisions (id, keep, mean_dist) and a report to the folders records, decisions and report below
    the path, and returns the report; the report comes last, so a folder without one isn't complete.

    Every record must have one decision and every decision a record. The report has counts and shares, mean, deviation and threshold of
    the distances, their quantiles at LEVELS and a histogram of 64 bins. A folder that holds something is refused.
    """
    spark = records.sparkSession
    _fresh(spark, path)
    records.write.parquet(f"{path}/records")
    decisions.select("id", "keep", "mean_dist").write.parquet(f"{path}/decisions")
    own, judged = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/decisions")
    n, m = _counted(own, "id"), _counted(judged, "id")
    if n["n"] != n["ids"] or m["n"] != m["ids"] or n["n"] != m["n"] or not own.join(judged, "id", "left_anti").isEmpty():
        raise ValueError("records and decisions must have the same ids, each once")
    report = audits.filter_report(judged, "keep", "mean_dist").first().asDict()
    report |= {"config": config, "threshold": None if report["mean"] is None else report["mean"] + ratio * (report["deviation"] or 0.0)}
    if report["records"]:
        q = {r.q: r.v for r in audits.quantiles(judged, "mean_dist", LEVELS).collect()}
        bins = {r.bin: r.n for r in statistics.histogram(judged, "mean_dist", 64).collect()}
        report |= {"levels": LEVELS, "quantiles": [q[x] for x in LEVELS], "histogram": [bins.get(k, 0) for k in range(64)]}
    text = json.dumps(report, sort_keys=True, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(f"{path}/report")
    return report


def publish_thresholds(spark: SparkSession, source: str, path: str, size: float, thresholds: tuple[int, ...] = (5, 10, 20, 40)) -> dict:
    """From a published filter at `source`: the rows that it keeps are counted in cells of the size, and each threshold keeps those in cells
    of more. Writes records, decisions (id, sor_keep, n, keep_t ...), a frequency file for each population below frequencies, and a
    report with one entry a population: rows kept, rows that the cells removed, and the cells' count, least, most, mean and median.
    """
    _fresh(spark, path)
    before = read_report(spark, source)
    records, judged = spark.read.parquet(f"{source}/records"), spark.read.parquet(f"{source}/decisions")
    both = cells.with_cells(records.join(judged.select("id", F.col("keep").alias("sor_keep")), "id"), size)
    counted = audits.crossed_counts(both, "sor_keep", cells.CELL).withColumns({f"keep_{t}": F.col("sor_keep") & (F.col("n") > t) for t in thresholds})
    records.write.parquet(f"{path}/records")
    counted.select("id", "sor_keep", "n", *cells.CELL, *[f"keep_{t}" for t in thresholds]).write.parquet(f"{path}/decisions")
    done = spark.read.parquet(f"{path}/decisions")
    if done.count() != before["records"]:
        raise ValueError("the filter's decisions aren't those of its records")
    kept, modes = done.filter("sor_keep").count(), []
    for name, flag in (("filter", "sor_keep"), *((f"cells_{t}", f"keep_{t}") for t in thresholds)):
        own = done.filter(flag).groupBy(*cells.CELL).agg(F.count(F.lit(1)).alias("n"))
        n = F.col("n")
        s = own.agg(F.coalesce(F.sum(n), F.lit(0)).alias("kept"), F.count(n).alias("cells"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.median(n.cast("double")).alias("middle")).first().asDict()
        own.groupBy("n").agg(F.count(F.lit(1)).alias("cells")).coalesce(1).sortWithinPartitions("n").write.mode("error").option("header", True).csv(f"{path}/frequencies/{name}")
        modes.append({"name": name, "removed": kept - s["kept"], **s})
    report = {"records": before["records"], "filter_removed": before["records"] - kept, "size": size, "source_config": before["config"], "modes": modes}
    spark.createDataFrame([(json.dumps(report, sort_keys=True, allow_nan=False),)], "value string").coalesce(1).write.mode("error").text(f"{path}/report")
    return report


def write_map(records: DataFrame, faces: DataFrame, size: float, path: str) -> dict:
    """Writes a map: the source rows (id, x, y, z, ...), their tiles, faces (face, a, b, c: ids of rows) in the tile of their centre, a report
    for each tile and each surface's bounds, and a summary, which is returned; the summary comes last. A folder that holds something
    is refused, and so is a map without rows."""
    spark = records.sparkSession
    _fresh(spark, path)
    if records.isEmpty():
        raise ValueError("a map needs rows")
    records.write.parquet(f"{path}/source")
    source = spark.read.parquet(f"{path}/source")
    sinks.write_tiles(cells.tiles(source, size), size, f"{path}/tiles", ["id"])
    owned = audits.centred(faces, source, size)
    owned.write.parquet(f"{path}/faces")
    owned = spark.read.parquet(f"{path}/faces")
    tiles = spark.read.parquet(f"{path}/tiles").withColumns({t: F.col(t).cast("long") for t in ("tx", "ty")})
    per = owned.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("triangles"))
    reports = tiles.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("records")).join(per, ["tx", "ty"], "full").fillna(0, ["records", "triangles"])
    reports.write.parquet(f"{path}/reports")
    corners = audits.surface_corners(owned, source)
    corners.groupBy("tx", "ty").agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for f, n in ((F.min, "l"), (F.max, "u"))]).write.parquet(f"{path}/bounds")
    summary = audits.map_totals(tiles, owned)
    text = sinks.write_report(summary, f"{path}/summary")
    return json.loads(text)


def verify_map(spark: SparkSession, path: str, size: float) -> DataFrame:
    """audits.map_audit() of a map that write_map() or another writer left at the path."""
    source = spark.read.parquet(f"{path}/source")
    tiles = spark.read.parquet(f"{path}/tiles").withColumns({t: F.col(t).cast("long") for t in ("tx", "ty")})
    summary = json.loads(spark.read.text(f"{path}/summary").first()[0])
    said = spark.createDataFrame([tuple(int(summary[c]) for c in audits.TOTALS)], ", ".join(f"{c} long" for c in audits.TOTALS))
    return audits.map_audit(source, tiles, *(spark.read.parquet(f"{path}/{n}") for n in ("faces", "reports", "bounds")), said, size)
