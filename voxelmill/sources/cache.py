"""Results kept by what they are made of: the content of their table, the parameters and the version of the operator."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audits import row_digest
from . import folders


def content_key(table: DataFrame, parameters: dict, version: str) -> str:
    """A digest of the table's rows in whatever order, its schema, the parameters and the version; one pass and one row."""
    digest = row_digest(table.columns)
    got = table.agg(F.count(F.lit(1)).alias("n"), F.sum(digest.cast("decimal(38,0)")).alias("s"), F.bit_xor(digest).alias("x")).first()
    said = [table.schema.simpleString(), got.n, str(got.s), got.x, parameters, version]
    return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()


def cached(table: DataFrame, name: str, parameters: dict, version: str, make: Callable[..., DataFrame], root: str | None = None) -> tuple[DataFrame, bool]:
    """make(table, **parameters), from the folder where an earlier run has put it, or made and put there; and whether it was there.

    A result counts once Spark has committed it (its _SUCCESS file); one that a run left half-written is made again.
    """
    spark = table.sparkSession
    folders.shared(spark)
    root = (root or spark.sparkContext.getCheckpointDir()).rstrip("/")
    path = f"{root}/cache/{name}/{content_key(table, parameters, version)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    if not there:
        make(table, **parameters).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), there
