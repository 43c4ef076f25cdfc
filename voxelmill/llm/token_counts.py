"""Token counts through a cache that is keyed by content and tokenizer digests.

Content digests of all documents join the stored counts of the tokenizer's version; one text of each missing digest is
encoded, the new counts are appended to the cache, and the documents join them. Only digests move where the cache has all;
texts move once, one for each missing digest, and hot digests shrink by partial aggregation before that.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, read, shared_root, stored

LIMIT = 4096
#: Most word counts that one worker remembers; beyond it words are encoded afresh.
REMEMBERED = 400_000
_BLANK = " ▁"
_CHUNK = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")


class Counter:
    """Pieces of a text under a sentencepiece model.

    If no piece of the model holds a blank behind another character, no merge crosses the place before a blank, so a text
    has the pieces of its words; their counts are remembered. Models that have such pieces encode texts whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        plain = len(self.model.encode("½ ①")) == len(self.model.encode("½")) + len(self.model.encode("①"))
        self.by_word = plain and not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("a  b", out_type=str) != self.model.encode("a b", out_type=str)
        self.seen: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        seen, cut, fresh = self.seen, [], {}
        for text in texts:
            if "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
                first, *rest = _CHUNK.findall(text) or [""]
                # The blank that opens a later word stands for the one which the model puts before a text.
                words = [first, *(w[1:] or "▁" for w in rest)] if text else []
            else:
                words = text.split(" ")
            cut.append(words)
            fresh |= dict.fromkeys(w for w in words if w not in seen)
        extra = {}
        if fresh:
            names = list(fresh)
            counts = dict(zip(names, (1 if w == "▁" else len(x) for w, x in zip(names, self.model.encode(names, num_threads=1), strict=True)), strict=True))
            if len(seen) + len(counts) <= REMEMBERED:
                seen |= counts
            else:
                extra = counts
        if extra:
            return [sum(seen[w] if w in seen else extra[w] for w in words) for words in cut]
        return [sum(map(seen.__getitem__, words)) for words in cut]


def _counts(batches, path: str):
    count = Counter(path)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        n: list[int] = []
        for i in range(0, len(texts), 64):
            n += count(texts[i : i + 64])
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])


def version_of(path: str) -> str:
    """Digest of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs; cache: path of the table of counts, made if missing.

    Content is normalised to the text itself with null as the empty text, so that counts are those of the raw text. Empty
    text has no tokens. Repeated texts are encoded once, and none that the cache holds. Rows with one doc_id each give a row;
    other columns are ignored; an empty table gives an empty result. A cache that lacks nothing stays as it is. Runs may
    share a cache: two that append the same digest at once append the same count.
    """
    spark, version = docs.sparkSession, version_of(tokenizer)
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    keyed = stored(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest")), "op7-digests")
    have = cached(spark, cache, version)
    asked = keyed.select("digest").distinct()
    known = None if have is None else stored(have.join(asked, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "op7-known")
    missing = asked if known is None else stored(asked.join(known, "digest", "left_anti"), "op7-missing")
    n = None if known is None else missing.count()
    if n != 0:
        # One text of each digest that lacks a count. Few are picked where they lie; many meet by digest, copies before that.
        rows = docs.select(text.alias("text"), digest.alias("digest"))
        few = n is not None and n <= SMALL
        fresh = (rows.join(F.broadcast(missing), "digest", "left_semi") if few else rows).groupBy("digest").agg(F.first("text").alias("text"))
        fresh = fresh if few or n is None else fresh.join(missing, "digest", "left_semi")
        new = stored(fresh.mapInArrow(lambda b: _counts(b, tokenizer), "digest binary, n_tokens long"), "op7-new")
        if not new.isEmpty():
            new.withColumn("version", F.lit(version)).write.mode("append").parquet(cache)
        known = new if known is None else known.unionByName(new)
    out = keyed.join(known, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def cached(spark, cache: str, version: str) -> DataFrame | None:
    """(digest, n_tokens) of the version in the cache as it is now; None if there is no cache."""
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("digest binary, n_tokens long, version string").parquet(cache).filter(F.col("version") == version).select("digest", "n_tokens")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # A place of its own below the shared folder: later runs, on these or on other tables, find what earlier ones counted.
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), f"{shared_root(spark)}/token-counts")


SQL: dict[str, str] = {}
