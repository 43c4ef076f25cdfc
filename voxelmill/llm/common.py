"""Pieces that several operators share: shared tables, blocks of hot keys, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: a space and the control characters from tab to carriage return.
SPACES = " \t\n\x0b\f\r"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a session on one machine gets a folder of its own; a cluster,
    whose executors couldn't see it, gets an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="voxelmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Most rows and bytes of an Arrow batch. Whole texts go to Python; with Spark's 10,000 rows a batch of them may take a third of an
#: executor, in the JVM and in the worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bounded(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches to BATCH; lower ones stay."""
    for key, most in BATCH.items():
        with contextlib.suppress(Exception):  # a version of Spark may lack one
            now = spark.conf.get(key)
            if not now.isdigit() or not 0 < int(now) <= most:
                spark.conf.set(key, str(most))


#: What pipeline stages have stored and not yet removed, by the names of the folders; those of a stage that is running.
_LEFT: list[str] = []
_RUNNING: list[list[str]] = []
#: Most rows of a few numbers (some 100 bytes each in memory) that are broadcast; a larger table joins by a shuffle.
SMALL = 250_000


def rested(spark: SparkSession) -> None:
    """Has executors collect their garbage, after which they give back what their heaps don't need: a heap that one stage has
    stretched stays so for the next one, whose Python workers need the memory. One short task for each core, twice."""
    n = 2 * spark.sparkContext.defaultParallelism
    if spark.sparkContext.master.split("[")[0] != "local":
        spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def stage(f):
    """Marks a pipeline stage. Once it begins, the result of the one before it is written, so what earlier stages have stored
    goes, but for tables that its documents are read from."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded(spark)
        rested(spark)
        files = docs.inputFiles()
        for path in [p for p in _LEFT if not any(p.rpartition("/")[2] in x for x in files)]:
            deleted(spark, path)
            _LEFT.remove(path)
        _RUNNING.append([])
        try:
            return f(spark, docs, sf_dir)
        finally:
            _LEFT.extend(_RUNNING.pop())

    return run


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    bounded(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if _RUNNING:
        _RUNNING[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str, column: str = "__row") -> DataFrame:
    """docs, stored, with a number of its own for each row: ids may be null or repeat, and numbers must not change between reads."""
    return stored(docs.withColumn(column, F.monotonically_increasing_id()), name)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def removed(*tables: DataFrame) -> None:
    """Deletes the files of stored() tables that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            deleted(df.sparkSession, path)


def sweep(spark: SparkSession, hours: float) -> int:
    """Deletes stored tables below the shared folder that nothing has written to for so long, and returns how many. Results are lazy, so
    tables stay until then; a number of hours no job takes is a safe one."""
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    store, gone = root.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for status in store.listStatus(root):
        if re.fullmatch(r".+-[0-9a-f]{32}", status.getPath().getName()) and status.getModificationTime() <= (time.time() - hours * 3600) * 1000:
            gone += store.delete(status.getPath(), True)
    return gone


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The stored table df, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= most else df


def trimmed() -> None:
    """Gives memory that Python has freed back to the system: workers outlive their tasks, and the next stage needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


#: What this worker keeps between its tasks.
_KEPT: list[dict] = []


def alone(kept: dict | None = None) -> None:
    """Empties what other kinds of tasks have left in this worker, which is used again for all of them; `kept` is the caller's own."""
    others = [x for x in _KEPT if x is not kept and x]
    for x in others:
        x.clear()
    if others:
        trimmed()
    if kept is not None and not any(x is kept for x in _KEPT):
        _KEPT.append(kept)


def lower_ascii(text):
    """A-Z in lower case and nothing else; Spark's own lower() is quicker and equal for plain ASCII."""
    c = F.coalesce(text, F.lit(""))
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, small))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of one key as one table, from batches that are sorted by it; only one key is held at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        table = pa.Table.from_batches([batch])
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if held and keys[start] != last:
                yield pa.concat_tables(held)
                held = []
            last = keys[start]
            held.append(table.slice(start, i - start))
            start = i
    if held:
        yield pa.concat_tables(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 14) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of many whole groups, `least` rows or more but for the last one, from batches that are sorted by the integer keys, with
    the group's number of each row; the last group waits for what follows."""
    held: list[pa.Table] = []

    def numbers(t: pa.Table) -> np.ndarray:
        columns = np.stack([t.column(k).to_numpy().astype(np.int64) for k in keys])
        return np.concatenate([[0], np.cumsum((columns[:, 1:] != columns[:, :-1]).any(axis=0))])

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < least:
            continue
        whole = pa.concat_tables(held).combine_chunks()
        g = numbers(whole)
        cut = int(np.searchsorted(g, g[-1]))
        held = [whole.slice(cut)]
        if cut:
            yield whole.slice(0, cut).combine_chunks(), g[:cut]
    if sum(t.num_rows for t in held):
        whole = pa.concat_tables(held).combine_chunks()
        yield whole, numbers(whole)


def block_units(rows: DataFrame, key: str, row: str, weight, limit: int) -> DataFrame:
    """Cuts each key that has two rows or more into blocks of about `limit` weight, and deals rows to units of two
    blocks (bi <= bj) so that any two rows of a key meet in a unit and no unit grows with its key.

    Rows keep their columns and get nb (blocks of the key), b (own block), bi and bj. A key of one block is one unit.
    Sizes come from a partial aggregate; hot keys are split by the skew handling of the join.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.sum(weight).alias("__w"))
    sizes = sizes.filter("__n > 1").select(key, F.ceil(F.col("__w") / F.lit(limit)).cast("int").alias("nb"))
    out = rows.join(sizes, key).withColumn("b", F.pmod(F.xxhash64(F.col(row), F.lit(7)), F.col("nb")).cast("int"))
    out = out.withColumn("__x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return out.withColumn("bi", F.least("b", "__x")).withColumn("bj", F.greatest("b", "__x")).drop("__x")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (src, dst): the smallest node reachable, itself included.

    Alternates large-star and small-star steps, each a partial aggregate and a join, until the edges stay as they
    are. Nothing is collected but one count and one checksum a round; each round's edges are a stored table.
    """
    now = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v")
    now = stored(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = stored(small.filter("u <> v").distinct(), "edges")
        got = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        removed(now)
        now = after
        if got == mark:
            break
        mark = got
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
