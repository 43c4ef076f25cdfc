"""Prefix trie of conversations, built level by level.

Turns are told apart by a digest of role and text; texts are not moved. Equal conversations are one class with a weight.
At each depth the live classes are grouped by (parent node, next turn): the smallest conversation names the new node.
A class that is alone in its node leaves the loop, as all its further nodes are known; the loop ends where no two
classes share a node. Then the levels are joined in reverse, children aggregated by parent, for leaves and savings.

Nothing holds a conversation or a group in one row: turns stay one row each and are numbered in pieces of a conversation,
hot groups shrink by partial aggregation and meet by joins that are broadcast below a checked size or split by Spark.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SMALL, read, small, stored

#: Turns of a piece of a conversation that one task numbers or sums.
PIECE = 1024
#: Conversations whose ids are joined to one string before it is hashed.
IDS = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def _running(rows: DataFrame, key: str, piece: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with `name`: the sum of value up to the row in its key, in the given order, which must also order the pieces. Windows
    hold a piece; sums of whole pieces come before them."""
    rows = rows.withColumn("__piece", piece).withColumn("__value", value)
    sums = rows.groupBy(key, "__piece").agg(F.sum("__value").alias("__sum"))
    before = sums.withColumn("__before", F.sum("__sum").over(W.partitionBy(key).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)))
    before = small(stored(before.filter("__before is not null").select(key, "__piece", "__before"), "op12-pieces"))
    own = F.sum("__value").over(W.partitionBy(key, "__piece").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = rows.withColumn(name, own).join(before, [key, "__piece"], "left")
    return out.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).drop("__piece", "__value", "__before")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest of role and text, size (code points of the text), stored. Turns are in order, null first; rows
    of one turn follow each other by their digest. Rows without conv_id belong to no conversation."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.length(text).cast("long").alias("size"), F.unhex(F.sha2(F.concat_ws("\x00", F.octet_length(role).cast("string"), role, text), 256)).alias("digest"))
    piece = F.coalesce(F.floor(F.col("turn") / PIECE), F.lit(-(1 << 62)))
    return stored(_running(rows, "conv_id", piece, [F.col("turn").asc_nulls_first(), F.col("digest")], F.lit(1).cast("long"), "pos").drop("turn"), "op12-turns")


def rebuilt(turns: DataFrame, width: int = 100, shares: int = 6) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: (conv_id, n) of all, and their turns like `turns`. Conversation c gets the first h turns of
    conversation c - c % width, h = crc32(decimal c) % shares, then its own behind its first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shares
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % width)
    lead = own.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(lead, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n")), "op12-conversations")
    heads = turns.filter(F.col("pos") < shares).withColumnRenamed("conv_id", "base").join(convs.filter("taken > 0"), "base").filter("pos <= taken")
    short = small(stored(convs.filter("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("shift")), "op12-shifts"))
    tails = turns.filter(F.col("pos") > h).join(short, "conv_id", "left").withColumn("pos", F.col("pos") - F.coalesce("shift", F.lit(0)))
    columns = ["conv_id", "pos", "digest", "size"]
    return convs.select("conv_id", "n"), stored(heads.select(columns).unionByName(tails.select(columns)), "op12-rebuilt")


def _pieces(batches, most: int):
    """Ids of a class in stretches of IDS, joined, from sorted rows."""
    held, cls = [], None
    row = lambda: {"cls": cls, "first": held[0], "ids": ",".join(map(str, held))}
    for batch in batches:
        out = []
        for c, conv in zip(batch.column("cls").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if held and (c != cls or len(held) == most):
                out.append(row())
                held = []
            cls = c
            held.append(conv)
        yield pa.RecordBatch.from_pylist(out, pa.schema([("cls", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))
    if held:
        yield pa.RecordBatch.from_pylist([row()], pa.schema([("cls", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))


def _hashes(batches):
    """One digest a class, from its sorted stretches; only the state of the hash is held."""
    cls, state = None, None
    schema = pa.schema([("cls", pa.int64()), ("ends", pa.string())])
    for batch in batches:
        out = []
        for c, ids in zip(batch.column("cls").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if c == cls:
                state.update(b",")
            else:
                if state:
                    out.append({"cls": cls, "ends": state.hexdigest()})
                cls, state = c, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if state:
        yield pa.RecordBatch.from_pylist([{"cls": cls, "ends": state.hexdigest()}], schema)


def _classes(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, n, k, ends) of each distinct conversation, cls the smallest conv_id of its k copies; and the turns of these alone.

    Conversations are equal where number, two sums of 64-bit hashes over (pos, digest) and the sum of sizes are: 10^9 of them
    collide by chance with a probability below 10^-20."""
    hashes = [F.sum(F.xxhash64(F.lit(seed), "pos", "digest").cast("decimal(38,0)")).alias(f"f{seed}") for seed in (1, 2)]
    prints = turns.groupBy("conv_id").agg(*hashes, F.sum("size").alias("f3"))
    marked = stored(convs.join(prints, "conv_id", "left").select("conv_id", "n", F.sha2(F.concat_ws(",", "n", "f1", "f2", "f3"), 256).alias("mark")), "op12-marks")
    groups = stored(marked.groupBy("mark").agg(F.min("conv_id").alias("cls"), F.first("n").alias("n"), F.count(F.lit(1)).alias("k")), "op12-classes")
    members = marked.select("mark", "conv_id").join(small(stored(groups.filter("k > 1").select("mark", "cls"), "op12-copied")), "mark")
    most, parts = IDS, int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = stored(members.select("cls", "conv_id"), "op12-members").repartitionByRange(parts, "cls", "conv_id").sortWithinPartitions("cls", "conv_id")
    pieces = stored(members.mapInArrow(lambda b: _pieces(b, most), "cls long, first long, ids string"), "op12-ids")
    ends = pieces.repartition(parts, "cls").sortWithinPartitions("cls", "first").mapInArrow(_hashes, "cls long, ends string")
    out = stored(groups.join(ends, "cls", "left").select("cls", "n", "k", F.coalesce("ends", F.sha2(F.col("cls").cast("string"), 256)).alias("ends")), "op12-ends")
    kept = turns.withColumnRenamed("conv_id", "cls").join(out.select("cls", "n", "k"), "cls")
    return out, stored(kept.select("cls", "n", "k", "pos", "digest", "size"), "op12-class-turns")


def _levels(classes: DataFrame, turns: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (conv_id, parent, n_convs, m classes, size of the last turn) of the depths from the root on, as long as two classes share
    a node above; and (cls, conv_id, depth) of the classes that end in the root or in nodes that they share."""
    held, least = classes.agg(F.count(F.lit(1)), F.min("cls")).first()
    root = classes.agg(F.min("cls").alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.sum("k").alias("n_convs"), F.count(F.lit(1)).alias("m"), F.lit(0).cast("long").alias("size"))
    levels, ended, depth = [root.filter("m > 0")], [], 0
    live = classes.select("cls", F.lit(least).cast("long").alias("node"), "n")
    while held:
        ended.append(live.filter(F.col("n") == depth).select("cls", F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth")))
        depth += 1
        go = live.filter(F.col("n") >= depth).select("cls", "node")
        moved = turns.filter(F.col("pos") == depth).join(F.broadcast(go) if held <= SMALL else go, "cls")
        sizes = moved.groupBy("node", "digest").agg(F.min("cls").alias("conv_id"), F.sum("k").alias("n_convs"), F.count(F.lit(1)).alias("m"), F.first("size").alias("size"))
        groups = stored(sizes, "op12-groups")
        several = F.when(F.col("m") > 1, F.col("m"))
        made, shared, held = groups.agg(F.count(F.lit(1)), F.count(several), F.coalesce(F.sum(several), F.lit(0))).first()
        if made:
            levels.append(groups.select("conv_id", F.col("node").alias("parent"), "n_convs", "m", "size"))
        if held:
            into = groups.filter("m > 1").select("node", "digest", F.col("conv_id").alias("to"))
            live = stored(moved.join(F.broadcast(into) if shared <= SMALL else into, ["node", "digest"]).select("cls", F.col("to").alias("node"), "n"), "op12-live")
            if depth & (depth - 1) == 0:  # what is read shrinks with what lives
                keep = live.select("cls")
                turns = stored(turns.filter(F.col("pos") > depth).join(F.broadcast(keep) if held <= SMALL else keep, "cls", "left_semi"), "op12-live-turns")
    return levels, functools.reduce(DataFrame.unionByName, ended) if ended else classes.select("cls", F.col("cls").alias("conv_id"), F.col("n").alias("depth"))


def _rolled(levels: list[DataFrame], savings: DataFrame) -> list[DataFrame]:
    """The shared nodes of each level, deepest first: conv_id, parent, n_convs, depth, n_children, n_leaves, saved. savings: (conv_id,
    depth, saved) of nodes whose one class has copies, with all that lies below them."""
    out, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        shared = (F.col("m") > 1) | F.lit(depth == 0)
        nodes, saving = levels[depth], F.col("size") * (F.col("n_convs") - 1)
        ends = nodes.filter(~shared).join(savings.filter(F.col("depth") == depth).select("conv_id", "saved"), "conv_id", "left")
        ends = ends.select("parent", F.lit(1).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
        nodes = nodes.filter(shared).select("conv_id", "parent", "n_convs", saving.alias("own"))
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
            nodes = nodes.join(sums, "conv_id", "left")
        else:
            nodes = nodes.select("*", *(F.lit(None).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved")))
        nodes = stored(nodes.select("conv_id", "parent", "n_convs", F.lit(depth).cast("long").alias("depth"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.col("own") + F.coalesce("saved", F.lit(0))).alias("saved")), "op12-rolled")
        out.append(nodes)
        below = nodes.select("parent", "n_leaves", "saved").unionByName(ends)
    return out


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs: (conv_id, n) of every conversation, once; turns: (conv_id, pos from 1, digest, size). No conversations give no node, not even
    a root. A chain of nodes that one class alone goes through is written at once, row by row of its turns.
    """
    classes, turns = _classes(convs, turns)
    levels, ended = _levels(classes, turns)
    # Nodes of one class with all below them: (k - 1) times the sizes from there to the end.
    copied = turns.filter("k > 1")
    sums = copied.groupBy("cls").agg(F.sum("size").alias("all"))
    upto = _running(copied, "cls", F.floor(F.col("pos") / PIECE), [F.col("pos")], F.col("size"), "upto").join(sums, "cls")
    savings = stored(upto.select(F.col("cls").alias("conv_id"), F.col("pos").alias("depth"), ((F.col("k") - 1) * (F.col("all") - F.col("upto") + F.col("size"))).alias("saved")), "op12-savings")
    starts = [x.filter("m = 1").select(F.col("conv_id").alias("cls"), F.lit(d).cast("long").alias("start"), "parent") for d, x in enumerate(levels) if d]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    ends = classes.select("cls", "ends")
    at = stored(ended.join(ends, "cls").select("conv_id", "depth", "ends"), "op12-ended")
    shared = functools.reduce(DataFrame.unionByName, _rolled(levels, savings)).join(at, ["conv_id", "depth"], "left")
    shared = shared.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
    if not starts:
        return shared.select(columns)
    begun = stored(functools.reduce(DataFrame.unionByName, starts).join(ends, "cls"), "op12-starts")
    chains = turns.join(begun, "cls").filter("pos >= start").join(savings.select(F.col("conv_id").alias("cls"), F.col("depth").alias("pos"), "saved"), ["cls", "pos"], "left")
    alone = chains.select(
        F.col("cls").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("start"), F.col("parent")).otherwise(F.col("cls")).alias("parent_conv_id"), F.col("k").alias("n_convs"),
        (F.col("pos") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.when(F.col("pos") == F.col("n"), F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    return shared.select(columns).unionByName(alone.select(columns))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(turns_of(read(spark, sf_dir, "conversations"))))


#: crc32 of the decimal conv_id s, byte by byte and bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length(s) + 1), lambda i: ord(substr(s, i, 1))::UBIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT)"
SQL = {
    "op12_prefix_trie": f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c0 AS (SELECT conv_id, count(*) AS own, conv_id::VARCHAR AS s FROM t GROUP BY conv_id), c1 AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base, CAST({_CRC} % 6 AS BIGINT) AS h FROM c0),
c AS (SELECT c1.*, least(h, coalesce(b.own, 0)) AS taken FROM c1 LEFT JOIN c0 b ON b.conv_id = base),
r AS (SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = base AND pos <= taken UNION ALL SELECT c.conv_id, pos - h + taken, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
k AS (SELECT conv_id, pos AS depth, length(text) AS size, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path FROM r),
m AS (SELECT conv_id, depth, size, md5(path) AS node FROM k UNION ALL SELECT conv_id, 0, 0, 'root' FROM c), l AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM m),
n AS (SELECT node, any_value(depth) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM l GROUP BY node),
ch AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up), below AS (SELECT DISTINCT a.node, b.node AS sub FROM m a JOIN m b ON b.conv_id = a.conv_id AND b.depth >= a.depth),
s AS (SELECT below.node, sum((x.n_convs - 1) * x.size) AS saved, count(*) FILTER (WHERE ch.node IS NULL) AS leaves FROM below JOIN n x ON x.node = sub LEFT JOIN ch ON ch.node = sub GROUP BY below.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM n JOIN s USING (node) LEFT JOIN ch USING (node) LEFT JOIN n u ON u.node = n.up"""
}
