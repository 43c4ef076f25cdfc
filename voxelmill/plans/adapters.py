"""The driver's tables seen as points and streams, for Spark and, in the same order of rows, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z) of lineitem. Rows need no id here: cells, histograms and quantiles are of values."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, x, y, z): points with a digest of all columns as their row key, ties being equal rows."""
    t = table(spark, sf_dir, "lineitem")
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]))
    return t.select(key.alias("key"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


def vec_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z): the first three components of embeddings in double precision."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, ts, us, event_type, value): events with their time in microseconds."""
    t = table(spark, sf_dir, "events")
    return t.select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value", "props")


def by_user() -> Window:
    return Window.partitionBy("user_id").orderBy("us", "event_id")


#: The same as common table expressions.
LP = "lp AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem)"
LR = "lp AS (SELECT md5(concat_ws('|', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR)) AS key, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem)"
EP = "ep AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
EV = "ev AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us, event_type, value, props FROM events)"


def vec_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, x, y, z, e3 ... e8): points with further components, as normals, quaternions or second ends."""
    e = F.col("embedding")
    names = ["x", "y", "z", *(f"e{i}" for i in range(3, 9))]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), *[e[i].cast("double").alias(n) for i, n in enumerate(names)])


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(face, owner, a, b, c): triangles over the points 0 to 96, their corners made of event ids; three different ones each."""
    k = F.col("event_id")
    t = table(spark, sf_dir, "events").select(k.alias("face"), (k % 5).alias("owner"), (k * 7 % 97).alias("a"), (k * 11 % 89).alias("b"), (k * 13 % 83).alias("c"))
    return t.filter("a <> b AND b <> c AND a <> c")


EX = "ex AS (SELECT vec_id AS id, label::BIGINT AS label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {n}" for i, n in enumerate(["x", "y", "z", *(f"e{i}" for i in range(3, 9))])) + " FROM embeddings)"
FC = "fc AS (SELECT * FROM (SELECT event_id AS face, event_id % 5 AS owner, event_id * 7 % 97 AS a, event_id * 11 % 89 AS b, event_id * 13 % 83 AS c FROM events) WHERE a <> b AND b <> c AND a <> c)"
