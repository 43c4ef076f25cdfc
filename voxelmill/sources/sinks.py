"""Written products: tiles as folders, strict JSON reports, frequency files, byte-exact archives with their digests."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits


def write_tiles(rows: DataFrame, size: float, path: str, order: list[str]) -> DataFrame:
    """Writes rows with tx and ty as one folder a tile, sorted inside, and returns them read back. A tile of many rows goes to several
    tasks and files, by salt; no file is written where some are. Reading checks that every row lies in its tile."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(8)))
    out = salted.repartition("tx", "ty", "__salt").drop("__salt").sortWithinPartitions("tx", "ty", *order)
    out.write.mode("error").partitionBy("tx", "ty").parquet(path)
    return read_tiles(rows.sparkSession, path, size)


def read_tiles(spark: SparkSession, path: str, size: float) -> DataFrame:
    """The tiles, with tx and ty of type long; a row outside of its tile raises an error when it is read."""
    back = spark.read.parquet(path).withColumns({t: F.col(t).cast("long") for t in ("tx", "ty")})
    wrong = [F.floor(F.col(a).cast("float").cast("double") / size) != F.col(f"t{a}") for a in "xy"]
    checked = F.when(wrong[0] | wrong[1], F.raise_error(F.lit("a row lies outside of its tile"))).otherwise(F.col("tx"))
    return back.withColumn("tx", checked.cast("long"))


def strict(report: DataFrame) -> str:
    """The one row of a report as JSON; a number that isn't finite is refused."""
    rows = report.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report is one row")
    values = rows[0].asDict(recursive=True)
    if bad := [k for k, v in values.items() if isinstance(v, float) and not math.isfinite(v)]:
        raise ValueError(f"not finite: {bad}")
    return json.dumps(values, sort_keys=True, default=str, allow_nan=False)


def write_report(report: DataFrame, path: str) -> str:
    """Writes the report through Spark's committer, so that it is there whole or not at all, and returns its text."""
    text = strict(report)
    report.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(path)
    return text


def write_frequencies(rows: DataFrame, path: str) -> None:
    """(n, before, after) as one sorted CSV file with a header; as short as there are different counts. More cells after a filter than
    before are refused."""
    if rows.agg((F.sum("after") > F.sum("before")).alias("bad")).first()["bad"]:
        raise ValueError("a filter can't make cells")
    rows.coalesce(1).sortWithinPartitions("n").write.mode("error").option("header", True).csv(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files below path; two files of one name are refused when the rows are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    twice = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two files are named "), F.col("name")))).otherwise(F.col("bytes"))
    return files.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes"), F.first("sha256").alias("sha256")).select("name", twice.alias("bytes"), "sha256")


def archive_matches(spark: SparkSession, source: str, archive: str) -> DataFrame:
    """(name, found, said) of the files whose bytes differ between two folders, or that only one has."""
    return audits.resume_audit(inventory(spark, archive), inventory(spark, source), ["name"], "sha256")
