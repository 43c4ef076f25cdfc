"""MinHash near-duplicates: circulant signatures, banding, exact verification.

Two permutations of the 32-bit universe make all signature coordinates: the first spreads a document's shingles, the
second is shifted round by one place for each coordinate, and a coordinate is the least image. Bands of coordinates are
bucket keys. Documents of equal shingle sets are one class and go on as one. The members of a bucket are dealt to units
of bounded size in which any two of them meet; texts are sent once for each distinct unit, and the unit links pairs by
their full shingle sets. It returns a forest of verified links, never all pairs. Components of the links are classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, block_units, components, groups, numbered, read, removed, small, stage, stored, trimmed

WORDS, BANDS, ROWS, PERCENT = 5, 32, 8, 85
#: A pair of Jaccard similarity 0.85 shares no band with probability (1 - 0.85 ** 8) ** 32, below 4 in 100,000.
#: Most shingles and members in a block of a bucket; rows of a batch that are signed at a time.
BLOCK_SHINGLES, BLOCK_DOCS, STEP = 256_000, 256, 512
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WORDS)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit keys of the 5-word shingles; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    # bytes.split() cuts at space and \\t \\n \\v \\f \\r, which are the contract's separators.
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(one) - WORDS + 1
    with np.errstate(over="ignore"):
        h = one[:n] * _ODD[0]
        for k in range(1, WORDS):
            h ^= h >> np.uint64(29)
            h = h * _ODD[0] + one[k : k + n] * _ODD[k]
    return np.unique(h)


def _permuted(v: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    s = v >> np.uint32(16)
    np.bitwise_xor(v, s, out=v)
    np.multiply(v, np.uint32(a), out=v)
    np.right_shift(v, np.uint32(15), out=s)
    np.bitwise_xor(v, s, out=v)
    np.multiply(v, np.uint32(b), out=v)
    np.right_shift(v, np.uint32(16), out=s)
    np.bitwise_xor(v, s, out=v)
    return v


def signature(keys: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate i is the least of the second permutation, shifted round by i, over the images of the first."""
    with np.errstate(over="ignore"):
        first = _permuted((keys ^ (keys >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
        shift = np.arange(k, dtype=np.uint32)[:, None]
        least = np.full(k, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(first), 1024):
            np.minimum(least, _permuted(first[None, i : i + 1024] - shift, 0x7FEB352D, 0x846CA68B).min(axis=1), out=least)
    return least


def _sign(batches):
    alone()
    for whole in batches:
        for at in range(0, whole.num_rows, STEP):
            batch = whole.slice(at, STEP)
            n, sets, bands = [], [], []
            for text in batch.column("text"):
                keys = shingles(text.as_py())
                n.append(len(keys))
                sets.append(xxhash.xxh3_128_digest(keys.tobytes()) if len(keys) else None)
                bands.append(np.frombuffer(b"".join(xxhash.xxh3_64_digest(r.tobytes(), seed=i) for i, r in enumerate(signature(keys).reshape(BANDS, ROWS))), ">i8").astype(np.int64) if len(keys) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "set", "bands"])
    trimmed()


def _linked(table: pa.Table):
    """A forest of the links in one unit: pairs of Jaccard similarity of PERCENT or more, on full sets."""
    ids, b = table.column("doc_id").to_pylist(), table.column("b").to_pylist()
    apart = table.column("bi")[0].as_py() != table.column("bj")[0].as_py()
    keys = [shingles(t.as_py()) for t in table.column("text")]
    size = np.array([len(k) for k in keys], np.int64)
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if len(ids) <= 4:
        pairs = [(i, j, len(np.intersect1d(keys[i], keys[j], assume_unique=True))) for i in range(len(ids)) for j in range(i) if 100 * min(size[i], size[j]) >= PERCENT * max(size[i], size[j])]
    else:
        # All intersections at once: the incidence of shingles that two members or more hold, times its transpose.
        owner, flat = np.repeat(np.arange(len(ids)), size), np.concatenate(keys)
        _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[at] > 1
        _, at = np.unique(at[keep], return_inverse=True)
        owner, both = owner[keep], np.zeros((len(ids), len(ids)), np.float32)
        for low in range(0, int(at.max(initial=-1)) + 1, 8192):
            mine = (at >= low) & (at < low + 8192)
            m = np.zeros((len(ids), 8192), np.float32)
            m[owner[mine], at[mine] - low] = 1
            both += m @ m.T
        union = size[:, None] + size[None, :] - both
        pairs = [(i, j, both[i, j]) for i, j in zip(*np.nonzero(np.tril(100 * both >= PERCENT * union, -1)), strict=True)]
    for i, j, common in pairs:
        if (not apart or b[i] != b[j]) and 100 * int(common) >= PERCENT * int(size[i] + size[j] - common):
            x, y = find(i), find(j)
            if x != y:
                root[x] = y
                yield ids[i], ids[j]


def _verify(batches):
    alone()
    for table in groups(batches, "unit"):
        links = list(_linked(table))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["src", "dst"])
    trimmed()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    Documents link at 100 * intersection >= 85 * union of their shingle sets; equal sets always do. Null and blank texts have
    no shingles and link with nothing: such a row is its own class. Sets that share a doc_id are one document when classes
    are formed; each row gives a row. A null doc_id has no class but its own row, kept. Other columns are ignored. An empty
    table gives an empty result. Copies meet in their set, by partial aggregation, and never as links.
    """
    signed = docs.select("doc_id", "text").mapInArrow(_sign, "doc_id long, n long, set binary, bands array<long>")
    signed = stored(signed, "op9-signed")
    good = signed.filter("set is not null and doc_id is not null")
    reps = stored(good.groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "op9-sets")
    rows = reps.select("set", "n", F.explode("bands").alias("key")).withColumn("weight", F.greatest(F.col("n"), F.lit(BLOCK_SHINGLES // BLOCK_DOCS)))
    rows = rows.withColumn("member", F.xxhash64("set")).select("member", "key", "weight")
    dealt = block_units(rows, "key", "member", F.col("weight"), BLOCK_SHINGLES)
    one = dealt.filter("nb = 1").groupBy("key").agg(F.array_sort(F.collect_list("member")).alias("members")).dropDuplicates(["members"])
    one = one.select(F.xxhash64("members").alias("unit"), F.explode("members").alias("member"), F.lit(0).alias("b"), F.lit(0).alias("bi"), F.lit(0).alias("bj"))
    hot = dealt.filter("nb > 1").select(F.xxhash64("key", "bi", "bj").alias("unit"), "member", "b", "bi", "bj")
    of = reps.select(F.xxhash64("set").alias("member"), "rep", F.col("n").alias("size"))
    members = stored(one.unionByName(hot).join(of, "member"), "op9-units")
    # A doc_id of several rows brings all its texts; what is not the set's own finds its own set in the same unit or another.
    texts = docs.select("doc_id", "text").join(small(members), F.col("doc_id") == F.col("rep"))
    units = texts.select("unit", "doc_id", "text", "b", "bi", "bj").repartition("unit").sortWithinPartitions("unit")
    links = stored(units.mapInArrow(_verify, "src long, dst long"), "op9-links")
    # Sets that one doc_id holds: an edge from each to the least of them.
    own = good.select("doc_id", "set").join(reps.select("set", "rep"), "set").groupBy("doc_id", "rep").agg(F.count(F.lit(1)).alias("__n"))
    several = own.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most")
    same = own.join(several, "doc_id").filter("rep <> least").select(F.col("rep").alias("src"), F.col("least").alias("dst"))
    found = components(links.unionByName(same))
    classes = reps.join(found, F.col("rep") == F.col("node"), "left").select("set", F.coalesce("component", "rep").alias("class"))
    classes = stored(classes, "op9-classes")
    removed(reps, members, links)
    out = signed.select("doc_id", "n", "set").join(classes, "set", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("class")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


@stage
def distinct_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class, the one of the smallest doc_id (a null one last).

    Classes are formed of rows, not of ids: rows with one doc_id, or with a null one, go only where their texts are near
    to others. Blank texts link with nothing and stay.
    """
    rows = numbered(docs, "op9-rows")
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"))
    found = stored(found.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("class"), "kept"), "op9-rows-classes")
    several = found.filter("not kept").select("class").distinct()
    members = found.join(several, "class", "left_semi").join(rows.select("__row", "doc_id"), "__row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    members = stored(members.select("class", order.alias("m")), "op9-members")
    best = members.groupBy("class").agg(F.min("m").alias("m")).select(F.col("m.__row").alias("__best"))
    gone = members.select(F.col("m.__row").alias("__row")).join(best, F.col("__row") == F.col("__best"), "left_anti")
    return rows.join(small(stored(gone, "op9-gone")), "__row", "left_anti").select(*docs.columns)


SQL = {
    "op9_near_dedup": """
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(a, i, i + 4), ' ') AS t FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 4, 1) + 1)) AS i FROM w WHERE len(a) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS c FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
}
