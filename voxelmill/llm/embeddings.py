"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Equal vectors are one row with its number of copies. Rotations learned for balanced binary codes (several, from random
starts) turn vectors into codes; substrings of the codes key hash tables. Members of a bucket are dealt to units of bounded
size, and a unit retrieves its pairs whose whole codes are near in Hamming distance, each pair in the first table only where
the two meet, which their codes tell. Vectors are sent to the units in which they have such a pair, and the pairs are
reranked there in double precision; a unit returns links by vector and a spanning forest, never a row for each pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_units, components, read, stored, whole_groups

COSINE = 0.9
#: Vectors that the rotations are learned on, those of the smallest digest; every row is indexed.
SAMPLE, ITERATIONS = 8_000, 30
#: A pair at the threshold shares no bucket with this probability (bits of a code taken as independent).
MISS = 0.002
#: Most members of a block of a bucket; pairs that are compared at a time.
BLOCK, PAIRS = 256, 1 << 16
_UNIT = ["key", "bi", "bj"]


def can_link(column: str = "embedding"):
    """Whether a vector can link with any: no null, nothing that is not finite, not zero."""
    return F.expr(f"size({column}) > 0 and forall({column}, x -> x is not null and abs(x) < double('infinity')) and exists({column}, x -> x <> 0)")


def usual_size(vectors: DataFrame) -> int:
    """The most frequent number of components of the vectors that can link, the smaller of equally frequent ones; 1 without any."""
    top = vectors.filter(can_link()).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top["d"] if top else 1


def unit_rows(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Unit vectors of a column of lists that can link, all of d components; scaled first, so that squares stay finite."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    x = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in chunks)]).reshape(-1, d)
    x = x / np.abs(x).max(axis=1, initial=0, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(sample: np.ndarray, codes: int, seed: int = 3) -> list[np.ndarray]:
    """Rotations (after projection on the principal axes) whose signs lose least, from `codes` random starts."""
    values, axes = np.linalg.eigh(sample.T @ sample / max(1, len(sample)))
    axes = axes[:, np.argsort(-values)]
    v, out = sample @ axes, []
    for k in range(codes):
        r = np.linalg.qr(np.random.default_rng(seed + k).normal(size=(v.shape[1],) * 2))[0]
        for _ in range(ITERATIONS if len(v) else 0):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return out


def plan(n: int, d: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int, int]:
    """Bits of a substring, tables and codes for n vectors of d components."""
    bits = min(d, 62, max(10, math.ceil(math.log2(max(2, n) / 8))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    tables = math.ceil(math.log(miss) / math.log1p(-same))
    return bits, tables, math.ceil(tables / max(1, d // bits))


def _encode(batches, rotations: np.ndarray, bits: int, tables: int):
    d = rotations.shape[1]
    per = d // bits
    weights = 1 << np.arange(bits, dtype=np.int64)
    for batch in batches:
        x = unit_rows(batch.column("embedding"), d)
        if not len(x):
            continue
        signs = [(x @ r > 0) for r in rotations]
        keys = [signs[t // per][:, t % per * bits : t % per * bits + bits] @ weights for t in range(tables)]
        code = np.packbits(np.concatenate(signs, axis=1), axis=1)
        keys = np.stack(keys, axis=1) * 1024 + np.arange(tables)  # fewer than 1024 tables at any size
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["rid", "code", "keys"])


def _retrieved(table: pa.Table, group: np.ndarray, most: int, d: int, bits: int, tables: int):
    """(i, j): rows of one unit whose codes differ in `most` bits or less, in the first table where both share a bucket."""
    b, t = table.column("b").to_numpy(), table.column("key").to_numpy() % 1024
    apart = table.column("bi").to_numpy() != table.column("bj").to_numpy()
    raw = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)
    code = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), np.uint8)
    code[:, : raw.shape[1]] = raw
    words, per = code.view(np.uint64), d // bits
    at = (np.arange(tables) // per * d + np.arange(tables) % per * bits)[:, None] + np.arange(bits)
    rows, step = np.arange(len(group)), 1
    while len(rows := rows[rows + step < len(group)]) and len(rows := rows[group[rows] == group[rows + step]]):
        for k in range(0, len(rows), PAIRS):
            i = rows[k : k + PAIRS]
            j = i + step
            near = (np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int32) <= most) & ~(apart[i] & (b[i] == b[j]))
            i, j = i[near], j[near]
            for q in range(0, len(i), 4096):
                differ = np.unpackbits(raw[i[q : q + 4096]] ^ raw[j[q : q + 4096]], axis=1)
                meet = np.stack([~differ[:, a].any(axis=1) for a in at], axis=1)
                first = meet.argmax(axis=1) == t[i[q : q + 4096]]
                yield i[q : q + 4096][first], j[q : q + 4096][first]
        step += 1


def _near(batches, *plan):
    """Rows that have a retrieved pair in their unit."""
    for table, group in whole_groups(batches, _UNIT):
        mine = np.zeros(table.num_rows, bool)
        for i, j in _retrieved(table, group, *plan):
            mine[i] = mine[j] = True
        if mine.any():
            yield from table.select([*_UNIT, "rid", "b"]).filter(pa.array(mine)).to_batches()


def _rerank(batches, cosine: float, most: int, d: int, *plan):
    """(rid, links, to): copies that a vector links with in a unit, and a spanning forest of the links as to."""
    for table, group in whole_groups(batches, _UNIT):
        x, copies, rid = unit_rows(table.column("embedding"), d), table.column("copies").to_numpy(), table.column("rid").to_numpy()
        links, root = np.zeros(len(rid), np.int64), np.arange(len(rid))
        pairs = []
        for i, j in _retrieved(table, group, most, d, *plan):
            good = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[good], j[good]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            pairs.append((i, j))
        if not links.any():
            continue
        i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
        while True:  # least row of each component
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            root = root[root]
            if (root == before).all():
                break
        has, tree = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
        out = [np.concatenate([rid[has], rid[tree]]), np.concatenate([links[has], np.zeros(len(tree), np.int64)])]
        yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array([None] * len(has) + rid[root[tree]].tolist(), pa.int64())], names=["rid", "links", "to"])


def near_vectors(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors.

    Vectors that are null, empty, zero, not finite, hold a null or have not the usual number of components (the most
    frequent one of the table) link with nothing. Equal vectors link. Rows with one vec_id are vectors of their own; a row with
    null vec_id links with nothing. Other columns are ignored; an empty table gives an empty result. The codes are a filter of
    stated recall; links found are exact.
    """
    own = vectors.select("vec_id", "embedding").filter("vec_id is not null")
    d = usual_size(own)
    good = own.filter(F.size("embedding") == d).filter(can_link())
    same = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    same = stored(same.withColumn("rid", F.monotonically_increasing_id()), "op2-vectors")
    pick = same.orderBy(F.xxhash64("embedding"), "least").limit(SAMPLE).select("embedding").toArrow()
    bits, tables, codes = plan(same.count(), d, cosine, miss)
    rotations = np.stack(learn(unit_rows(pick.column("embedding"), d), codes))
    all_bits, share = codes * d, math.acos(cosine) / math.pi
    how = int(all_bits * (share + 5 * math.sqrt(share * (1 - share) / all_bits))), d, bits, tables
    coded = same.select("rid", "embedding").mapInArrow(lambda b: _encode(b, rotations, bits, tables), "rid long, code binary, keys array<long>")
    coded = stored(coded, "op2-codes")
    dealt = block_units(coded.select("rid", "code", F.explode("keys").alias("key")), "key", "rid", F.lit(1), BLOCK)
    dealt = dealt.select(*_UNIT, "rid", "b", "code").repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    near = stored(dealt.mapInArrow(lambda b: _near(b, *how), "key long, bi int, bj int, rid long, b int"), "op2-near")
    sent = near.join(coded.select("rid", "code"), "rid").join(same.select("rid", "embedding", "copies"), "rid")
    sent = sent.select(*_UNIT, "rid", "b", "code", "embedding", "copies").repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    found = stored(sent.mapInArrow(lambda b: _rerank(b, cosine, *how), "rid long, links long, to long"), "op2-links")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = components(found.filter("to is not null").select(F.col("rid").alias("src"), F.col("to").alias("dst")))
    each = same.join(links, "rid", "left").join(classes, F.col("rid") == F.col("node"), "left").withColumn("class", F.coalesce("component", "rid"))
    least = each.groupBy("class").agg(F.min("least").alias("component_id"))
    each = each.join(least, "class").select(F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    out = vectors.select("vec_id", "embedding").join(stored(each, "op2-classes"), (F.col("embedding") == F.col("e")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


SQL: dict[str, str] = {}
