"""Where intermediate results go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> None:
    """Lets checkpoint() write to the folder in spark.checkpoint.dir. Where that is unset a session on one machine gets a folder of its
    own; a cluster, whose executors couldn't see it, gets an error."""
    if spark.sparkContext.getCheckpointDir():
        return
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="voxelmill-"))


def path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    shared(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, and its lineage is cut."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def removed(df: DataFrame) -> None:
    """Deletes the files of a stored() table that nothing reads any more."""
    spark = df.sparkSession
    for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(at)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
