"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window (ten consecutive item words, or a whole shorter item) is a set of positioned shingles of three words. The words of
the whole corpus are counted, and shingles are ordered by rarity: that of their rarest word, which bounds how often they can
occur. Containment needs all shingles of a window, so its necessary prefix is one token, the rarest; a window with a word
that no document holds is nowhere and has none. Positions of the texts join the prefix tokens alone, the token's offset and
the document's length bound where the window can lie, and the words there, compared with the whole window, verify it. The
benchmark is the query set: its prefixes are taken in blocks of a checked size, each broadcast, so that no text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, numbered, read, small, stage, stored

#: Separators of the contract: all of ASCII but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
#: Broadcast at most so many bytes of windows at once.
BLOCK_BYTES = 16 << 20


def words(text):
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def _shingle(array, at, k: int):
    """Key of the k words from the zero-based position on."""
    return F.xxhash64(F.lit(k), *[F.get(array, at + i) for i in range(k)])


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows (w array, items array of item_id strings). Items without words have none."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("a")).filter("size(a) > 0")
    at = F.sequence(F.lit(0), F.greatest(F.size("a") - window, F.lit(0)))
    b = b.select("item", "a", F.explode(at).alias("at")).select("item", F.slice("a", F.col("at") + 1, window).alias("w"))
    return b.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))


def prefixes(docs: DataFrame, wins: DataFrame, shingle: int) -> DataFrame:
    """(w, items, k, off, gkey): every window that can occur, with its rarest shingle (of k words) at the offset off."""
    wins = wins.withColumn("k", F.least(F.size("w"), F.lit(shingle)))
    known = small(stored(wins.select(F.explode("w").alias("word")).distinct(), "op1-words"))
    # Other words go no further than the task that reads them.
    counts = docs.select(F.explode(words(F.col("text"))).alias("word")).join(known, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    at = wins.select("w", "items", "k", F.posexplode("w").alias("at", "word")).join(counts, "word", "left")
    times = F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("times", F.lit(0)).alias("n")))), lambda x: x["n"])
    own = at.groupBy("w", "items", "k").agg(times.alias("times")).filter(~F.array_contains("times", F.lit(0).cast("long")))
    # A total order of all tokens: the bound on their count, then their key.
    tokens = lambda k: F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.struct(F.array_min(F.slice("times", i + 1, k)).alias("n"), _shingle(F.col("w"), i, k).alias("gkey"), i.alias("off")))
    keys = [F.when(F.col("k") == k, tokens(k)) for k in range(1, shingle + 1)]
    return own.withColumn("p", F.array_min(F.coalesce(*keys))).select("w", "items", "k", "p.off", "p.gkey")


def _found(docs: DataFrame, prefix: DataFrame, sizes: list[int], blocks: int) -> DataFrame:
    """(doc_id, row, n_words, span, items): one row for each occurrence of a window, and one without a span a document."""
    base = docs.select("doc_id", words(F.col("text")).alias("a"), F.monotonically_increasing_id().alias("row"))
    at = base.select("doc_id", "row", "a", F.posexplode_outer("a").alias("p", "first")).withColumn("p", F.coalesce("p", F.lit(0)))
    keys = [F.when(F.col("p") + k <= F.size("a"), _shingle(F.col("a"), F.col("p"), k)) for k in sizes]
    keyed = at.withColumn("key", keys[0] if len(keys) == 1 else F.explode(F.array(*keys)) if keys else F.lit(None).cast("long"))
    out = None
    start = F.col("p") - F.col("off")
    for b in range(blocks):
        mine = prefix.filter(F.pmod("gkey", F.lit(blocks)) == b).select("gkey", "off", "w", "items")
        fits = (start >= 0) & (start + F.size("w") <= F.size("a"))
        same = (F.col("key") == F.col("gkey")) & fits & (F.slice("a", F.when(fits, start + 1).otherwise(1), F.size("w")) == F.col("w"))
        hit = keyed.join(F.broadcast(mine), same, "left").filter("off is not null or p = 0")
        span = F.when(F.col("off").isNotNull(), F.struct(start.alias("s"), (start + F.size("w")).alias("e")))
        hit = hit.select("doc_id", "row", F.size("a").cast("long").alias("n_words"), span.alias("span"), "items")
        out = hit if out is None else out.unionByName(hit)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, row, n_words, n_hit, n_items, items (sorted item_id strings) and contaminated of every row of docs.

    Null text and null item text have no words; an item without words matches nothing; rows with one doc_id are
    documents of their own (one output row for each input row); other columns are ignored, whatever their names.
    An empty benchmark leaves every document clean. A null item_id counts as no item but its windows still hit.
    """
    prefix = stored(prefixes(docs, windows(benchmark, window), shingle), "op1-prefix")
    sizes = sorted(r.k for r in prefix.select("k").distinct().collect())  # at most `shingle` values
    bytes_ = prefix.agg(F.sum(F.octet_length(F.concat_ws(" ", "w")) + F.octet_length(F.concat_ws(" ", "items")) + 200)).first()[0] or 0
    found = _found(docs, prefix, sizes, max(1, -(-int(bytes_) // block_bytes)))
    found = found.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda s, x: F.struct(F.greatest(s["end"], x["e"]).cast("long").alias("end"), (s["hit"] + F.greatest(x["e"] - F.greatest(x["s"], s["end"]), F.lit(0))).cast("long").alias("hit")),
        lambda s: s["hit"],
    )
    out = found.select("doc_id", "row", "n_words", covered.alias("n_hit"), "items")
    return out.select("doc_id", "row", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@stage
def clean_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without an occurrence of a benchmark window; rows with one doc_id, or a null one, each for itself."""
    rows = numbered(docs, "op1-rows")
    found = decontaminate(rows.select(F.col("__row").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("__row"))
    return rows.join(small(stored(found, "op1-gone")), "__row", "left_anti").select(*docs.columns)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = {
    "op1_decontaminate": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS a FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS a FROM benchmark),
w AS MATERIALIZED (SELECT DISTINCT item, array_to_string(list_slice(a, i, i + 9), ' ') AS t, least(len(a), 10) AS n
      FROM (SELECT item, a, unnest(range(1, greatest(len(a) - 9, 1) + 1)) AS i FROM b WHERE len(a) > 0)),
lens AS (SELECT DISTINCT n FROM w),
p AS (SELECT doc_id, a, n, unnest(range(1, len(a) - n + 2)) AS i FROM d, lens WHERE len(a) >= n),
occ AS MATERIALIZED (SELECT p.doc_id, p.i, p.n, w.item FROM p JOIN w ON w.n = p.n AND w.t = array_to_string(list_slice(p.a, p.i, p.i + p.n - 1), ' ')),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.a) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""
}
