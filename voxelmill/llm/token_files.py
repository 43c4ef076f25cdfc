"""Token ids in Arrow IPC files of fixed-size-list batches.

The ids of all documents, each closed by an end id, form one stream in order of doc_id. Documents are dealt to shards by
ranges of doc_id; a shard cuts its stream into sequences of equal length and writes them as record batches of two
fixed-size lists, the ids (16-bit where the vocabulary allows) and a mask that is false on the padding of the last sequence. Every sequence starts at a known
byte, so a mapped file gives any of them without a copy. A second file holds doc_id, offset and length of each document.
"""

from __future__ import annotations

import contextlib
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, read, shared_path, stage

LENGTH, BATCH = 2048, 64
#: A shard is made of about so many bytes of the documents' files, or less; bytes of text that are encoded at a time.
SHARD_BYTES, SLICE = 32 << 20, 2 << 20
_INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
#: Most words whose ids a worker remembers.
REMEMBERED = 500_000
#: Marks the first word of a text; a text that holds it is encoded whole.
START = "\x02"
#: Where a blank isn't followed by a word, words can't be told by blanks alone.
_ODD = re.compile(r" \s| $|<\||\x02")


def _visible() -> dict[int, str]:
    """Byte-level models write each byte as a printable character: its own, or the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian numbers. Byte-level pre-tokenisation always cuts before a blank that a word
    follows, so the ids of a text are those of its words with their blank. A word of Latin letters, with a comma or full
    stop or without, is one or two pre-tokens for the library's model; it encodes others as texts. Ids of words are
    remembered. Texts where blanks don't tell words are encoded whole."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.seen: dict[str, bytes] = {}
        self.visible = _visible()
        self.plain = "ByteLevel" in str(self.library.pre_tokenizer)
        self.marks = {c: [t.id for t in self.library.model.tokenize(c)] for c in ",."}

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.dtype.char, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """Ids of the word behind a blank, or of the first one of a text."""
        if word[:1] == START:
            return self._whole(word[1:])
        mark = word[-1:] if word[-1:] in self.marks else ""
        body = word[: -len(mark)] if mark else word
        if body.isalpha() and (body.isascii() or max(body) < "\u0250"):
            token = (" " + body).encode().decode("latin-1").translate(self.visible)
            return self._packed([t.id for t in self.library.model.tokenize(token)] + (self.marks[mark] if mark else []))
        return self._whole(" " + word)

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        parts = [self._text(t) for t in texts]
        return np.frombuffer(b"".join(parts), self.dtype), np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize

    def _text(self, text: str) -> bytes:
        if not self.plain or _ODD.search(text):
            return self._whole(text)
        words, seen = text.split(" "), self.seen
        words[0] = START + words[0]  # no blank stands in front of it
        try:
            return b"".join(map(seen.__getitem__, words))
        except KeyError:
            new = {w: self._word(w) for w in dict.fromkeys(words) if w not in seen}
            if len(seen) + len(new) <= REMEMBERED:
                seen |= new
                return b"".join(map(seen.__getitem__, words))
            return b"".join([seen[w] if w in seen else new[w] for w in words])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker: what it remembers serves all its tasks, until the worker does something else."""
    alone(_ENCODERS)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _schema(length: int, dtype: np.dtype) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


def _slices(texts: pa.Array):
    """(first, end) of stretches of rows that hold about SLICE bytes."""
    ends, low = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, "right")))
        yield low, high
        low = high


def _write(batches, tokenizer: str, out: str, length: int, end: int):
    """Writes one shard and yields a row about it. A task that runs again writes the same bytes to its own attempt's
    files; the row that Spark keeps names the attempt that counts."""
    task = TaskContext.get()
    name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
    store, root = fs.FileSystem.from_uri(out)
    store.create_dir(root, recursive=True)
    encode = encoder(tokenizer)
    dtype, held, index = encode.dtype, [], []  # ids not written yet, and places of documents
    size = total = docs = 0
    schema = _schema(length, dtype)

    def flush(writer, last: bool) -> None:
        nonlocal held, size
        ids = np.concatenate([*held, np.zeros(0, dtype)])
        whole = len(ids) if last else len(ids) // (BATCH * length) * BATCH * length  # all batches but the last are full
        part, rest = ids[:whole], ids[whole:]
        pad = -len(part) % length
        mask = np.ones(len(part) + pad, bool)
        if pad:
            mask[-pad:] = False
            part = np.concatenate([part, np.zeros(pad, dtype)])
        for i in range(0, len(part), BATCH * length):
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x[i : i + BATCH * length]), length) for x in (part, mask)]
            writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
        held, size = [rest], len(rest)

    def noted(writer) -> None:
        nonlocal index, docs
        for part in index:
            writer.write_batch(part)
            docs += part.num_rows
        index = []

    def opened(kind: str, layout: pa.Schema):
        sink = files.enter_context(store.open_output_stream(f"{root}/{name}.{kind}"))
        return files.enter_context(pa.ipc.new_file(sink, layout))

    with contextlib.ExitStack() as files:
        writer, places = opened("arrow", schema), opened("index", _INDEX)
        for batch in batches:
            for low, high in _slices(batch.column("text")):
                ids, n = encode.many([t or "" for t in batch.column("text").slice(low, high - low).to_pylist()])
                ends = np.cumsum(n + 1)
                stream = np.full(len(ids) + len(n), end, dtype)
                stream[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                index.append(pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(total + ends - n - 1), pa.array(n + 1)], schema=_INDEX))
                held.append(stream)
                size, total = size + len(stream), total + len(stream)
                if size >= BATCH * length:
                    flush(writer, False)
                noted(places)
        flush(writer, True)
        noted(places)
    yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "name": [name], "docs": [docs], "tokens": [total]})


def _shards(docs: DataFrame) -> int:
    """Shards of SHARD_BYTES by the size that the optimizer knows of the files; 1 where it knows none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return -(-size // SHARD_BYTES) if size < 1 << 60 else 1


def write_token_files(docs: DataFrame, tokenizer: str, out: str, length: int = LENGTH, end: int = 0, shards: int | None = None) -> DataFrame:
    """Writes the files and returns their manifest: shard, name, start (ids before it), docs, tokens; one row a shard.

    Null text is empty: only the end id. Rows with one doc_id follow each other in order of a digest of their text; equal
    rows are interchangeable. A null doc_id comes first. An empty table gives an empty manifest or empty shards. Other
    columns are ignored. The ranges are of equal numbers of rows, so a hot source or a long document is only its own weight.
    """
    spark = docs.sparkSession
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), _shards(docs))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = rows.mapInArrow(lambda b: _write(b, tokenizer, out, length, end), "shard long, name string, docs long, tokens long")
    # One short row a shard: running totals of the shards before.
    made, start, manifest = sorted(made.collect()), 0, []
    for shard, name, count, tokens in made:
        manifest.append((shard, name, start, count, tokens))
        start += tokens
    return spark.createDataFrame(manifest, "shard long, name string, start long, docs long, tokens long")


class Shard:
    """Random access to one shard; sequences are views of the file's bytes where the store can map it."""

    def __init__(self, out: str, name: str, length: int):
        store, root = fs.FileSystem.from_uri(out)
        local = isinstance(store, fs.LocalFileSystem)
        opened = [pa.memory_map(f"{root}/{name}.{x}") if local else store.open_input_file(f"{root}/{name}.{x}") for x in ("arrow", "index")]
        self.data, self.length, self.at = pa.ipc.open_file(opened[0]), length, -1
        self.index = pa.ipc.open_file(opened[1]).read_all()

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence i."""
        if self.at != i // BATCH:
            self.at = i // BATCH
            batch = self.data.get_batch(self.at)
            self.ids, self.mask = batch.column(0).flatten().to_numpy(), batch.column(1).flatten()
        k = i % BATCH * self.length
        return self.ids[k : k + self.length], self.mask.slice(k, self.length)

    def tokens(self, offset: int, n: int) -> np.ndarray:
        """n ids from the offset on."""
        parts = []
        while n:
            ids, _ = self.sequence(offset // self.length)
            got = ids[offset % self.length :][:n]
            if not len(got):
                raise ValueError("the file ends before the offset")
            parts.append(got)
            offset, n = offset + len(got), n - len(got)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def _read(batches, out: str, length: int):
    for batch in batches:
        for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
            shard = Shard(out, name, length)
            for part in shard.index.to_batches():
                crc = [zlib.crc32(np.ascontiguousarray(shard.tokens(o, n), dtype="<u4")) for o, n in zip(part.column("offset").to_pylist(), part.column("n_tokens").to_pylist(), strict=True)]
                first = pa.array(part.column("offset").to_numpy() + start)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), first, part.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, out: str, length: int = LENGTH) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; shards are read in parallel."""
    spread = manifest.repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(lambda b: _read(b, out, length), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = shared_path(spark, "op6-tokens")
    return read_token_files(write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), out), out)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    return token_files(spark, read(spark, sf_dir, "documents"))


@stage
def pipeline_files(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents as token files, and what the files hold of each."""
    return token_files(spark, docs)


SQL: dict[str, str] = {}
