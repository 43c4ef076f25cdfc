"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents all want target / source size copies: the whole part is sure, the fraction is rounded by pivotal
sampling. Two fractional units meet, mass moves at random from one to the other until one is integral, and the other
meets the next. Within blocks of bounded size the units are a document, largest first, and the pool of all smaller ones,
and the mass is words: the block's words stay, and its last and smallest document is what is left over. These documents
of one source, near each other in size, meet in pairs in blocks of blocks, a reduction tree that ends with one document a
source, rounded alone.
Only ids, sources and sizes move; texts are read once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, numbered, read, small, stage, stored

#: Weights by the source's rank, repeating; total of the targets against all sizes; most copies of a document.
WEIGHTS, BUDGET, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK, FAN_IN = 4096, 256


def size_of(text):
    """Number of words [^\\x20\\x09-\\x0D]+; null: 0."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: list[float], weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> list[float]:
    """Targets of the sources in order; what exceeds most times a source's size is dealt to the others by weight."""
    total, n = budget * sum(sizes), len(sizes)
    w = [weights[i % len(weights)] for i in range(n)]
    full = [s == 0 for s in sizes]
    out = [0.0] * n
    while not all(full):
        left = total - sum(out[i] for i in range(n) if full[i])
        share = sum(w[i] for i in range(n) if not full[i])
        over = False
        for i in range(n):
            if not full[i]:
                out[i] = left * w[i] / share
        for i in range(n):
            if not full[i] and out[i] > most * sizes[i]:
                out[i], full[i], over = most * sizes[i], True, True
        if not over:
            break
    return out


def _pooled(batches, last: bool):
    """Rounds the fractions p of each unit's rows, which are equal; at most one row of a unit stays fractional unless last.

    Each row in turn, largest first, meets the pool of the smaller ones: words move from one to the other until the row or the
    whole pool is integral. The pool's rows share what moves by their size, so one fraction holds for all of them; each row
    is rounded up as often as its fraction says. Rows without a word move nothing and are rounded alone.
    """
    for t in groups(batches, "unit"):
        p, size, uid = t.column("p").to_numpy().copy(), t.column("size").to_numpy().astype(float), t.column("uid").to_numpy()
        draws = np.random.default_rng(abs(int(t.column("unit")[0].as_py()))).random(len(p) + 1)
        order = np.lexsort((uid, -size))
        smaller = size[order].sum() - np.cumsum(size[order])
        of, q, left = p[0], p[0], -1
        for n, i in enumerate(order if 0 < of < 1 else ()):
            s, pool = size[i], smaller[n]
            if s == 0:
                p[i] = 1.0 if draws[n] < of else 0.0
            elif q <= 0 or q >= 1:
                p[i] = q
            elif pool == 0:
                p[i], left = q, i
            else:
                up, down = min((1 - q) * s, q * pool), min(q * s, (1 - q) * pool)
                moved = up if draws[n] * (up + down) < down else -down
                p[i], q = q + moved / s, q - moved / pool
                p[i], q = (round(v) if abs(v - round(v)) < 1e-9 else v for v in (p[i], q))
                left = i if 0 < p[i] < 1 else left
        if last and left >= 0:
            p[left] = 1.0 if draws[-1] < p[left] else 0.0
        yield from t.set_column(t.schema.get_field_index("p"), "p", pa.array(p)).to_batches()


def _pivotal(batches, last: bool):
    """Rounds the fractions p of each unit's rows; at most one row of a unit stays fractional unless last."""
    for t in groups(batches, "unit"):
        p, size, uid = t.column("p").to_numpy().copy(), t.column("size").to_numpy(), t.column("uid").to_numpy()
        draws = np.random.default_rng(abs(int(t.column("unit")[0].as_py()))).random(len(p) + 1)
        order = np.lexsort((uid, -size))
        held = -1
        for n, i in enumerate(order):
            if p[i] <= 0 or p[i] >= 1:
                continue
            if held < 0:
                held = i
                continue
            a, b = p[held], p[i]
            if a + b < 1 - 1e-12:
                if draws[n] * (a + b) < b:
                    p[held], p[i], held = 0.0, a + b, i
                else:
                    p[held], p[i] = a + b, 0.0
            elif a + b > 1 + 1e-12:
                if draws[n] * (2 - a - b) < 1 - b:
                    p[held], p[i], held = 1.0, a + b - 1, i
                else:
                    p[held], p[i] = a + b - 1, 1.0
            else:
                p[held], p[i] = (1.0, 0.0) if draws[n] < a else (0.0, 1.0)
                held = -1
        if last and held >= 0:
            p[held] = 1.0 if draws[-1] < p[held] else 0.0
        yield from t.set_column(t.schema.get_field_index("p"), "p", pa.array(p)).to_batches()


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = 11) -> DataFrame:
    """doc_id, source, dup, size, source_size, target, copies, taken of every row of docs.

    Null or blank text has size 0 and gets no copies of its fraction's mass (any number of its copies is no word). A null
    source is a source of its own, last in order. Rows with one doc_id are documents of their own, told apart by dup;
    rows equal in doc_id, source and size are interchangeable. Sources of no words have target 0. Empty in, empty out.
    """
    spark = docs.sparkSession
    keys = ["doc_id", "source", "size"]
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    sized = stored(sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("same")), "op4-sizes")
    rows = sized.withColumn("dup", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same")))).drop("same")
    sums = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("same")).alias("source_size"), F.sum("same").alias("docs"))
    at = sorted(sums.collect(), key=lambda r: (r.source is None, r.source or ""))  # one row a source
    goal = targets([float(r.source_size) for r in at], weights, budget, most)
    plan = [(r.source, r.source_size, g, int(np.floor(g / r.source_size)) if r.source_size else 0, g / r.source_size % 1 if r.source_size else 0.0, max(1, -(-r.docs // BLOCK))) for r, g in zip(at, goal, strict=True)]
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, whole long, frac double, blocks long")
    # One row a source, from the aggregate above; its size is checked before it is broadcast.
    small = F.broadcast(plan) if len(at) <= 100_000 else plan
    on = F.col("s.source").eqNullSafe(F.col("r.source"))
    rows = rows.alias("r").join(small.alias("s"), on).select("r.doc_id", "r.source", "r.dup", "r.size", "source_size", "target", "whole", "frac", "blocks")
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "dup", "size", F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(seed)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("blocks"))).withColumn("p", F.col("frac"))
    kept = [c for c in rows.columns if c != "p"]
    done, now, level = [], rows, 0
    blocks = max([1, *(max(1, -(-r.docs // BLOCK)) for r in at)])
    while True:
        final = blocks == 1
        units = now.withColumn("unit", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "block", F.lit(seed + level)))
        units = units.repartition("unit").sortWithinPartitions("unit")
        rounded = _pivotal if level else _pooled
        got = units.mapInArrow(lambda b, final=final, rounded=rounded: rounded(b, final), units.schema)
        got = stored(got.drop("unit"), "op4-level")
        done.append(got.filter("p <= 0 or p >= 1"))
        if final:
            break
        blocks, level = -(-blocks // FAN_IN), level + 1
        now = got.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / FAN_IN))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.withColumn("copies", F.col("whole") + F.round("p").cast("long"))
    return out.select("doc_id", "source", "dup", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op4_mix(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@stage
def mixed_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it; rows with one doc_id, or a null one, each for itself."""
    rows = numbered(docs, "op4-rows")
    plan = mix(rows.select(F.col("__row").alias("doc_id"), "source", "text")).filter("copies > 0")
    plan = stored(plan.select(F.col("doc_id").alias("__row"), F.col("copies").cast("int").alias("__copies")), "op4-copies")
    out = rows.join(small(plan), "__row")
    return out.withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


SQL: dict[str, str] = {}
