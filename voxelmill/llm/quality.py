"""Quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

Units are the characters of a text with white space made one space and every repeat of the word before it made one mark,
so that junk symbols, capitals, tables and stuttering all surprise the model. One model for each language is counted over
all trusted documents: highest-order counts come from the texts, lower orders count distinct continuations, three discounts
an order come from counts of counts, and probabilities are interpolated order by order in SQL. The model is cut into
shards of bounded size by the last two units of the context, so that a position needs one shard only (n-grams of one and two
units, as few as the alphabet allows, are in all of them); stretches of texts of bounded size join the shards' counts one
after another inside one task and gather log-probability. A row for each position in a shuffle would be many times the text. A document's perplexity is held
against a quantile of the trusted documents' perplexities in its language. Those are held out: trusted texts fall into two
folds by their content, so that copies share one, and each fold is scored by a model of the other.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, groups, read, shared_path, small, stage, stored, trimmed

ORDER = 5
#: Texts of a few units say little: so many units at the language's mean are added to each.
PRIOR_UNITS = 40
#: A document is rejected above MARGIN times the QUANTILE of trusted perplexities of its language.
QUANTILE, MARGIN = 0.995, 1.05
#: Most rows of a shard, each a n-gram or a context.
SHARD_ROWS = 1_000_000
#: Rows taken from a batch at a time, and characters of text that pass the shards together.
STEP, HELD = 256, 1_500_000
#: Keys that are put into a table at a time; different n-grams that a task counts before it hands them on.
FILL, GRAMS = 1 << 18, 500_000
#: Slots of a table that make one row of a file.
CHUNK = 1 << 17
START, MARK = "\x02", "\x01"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def units(text: str | None) -> str:
    words = (text or "").split()
    if len(words) > 1 and any(map(operator.eq, words, words[1:])):
        words[1:] = [MARK if a == b else b for a, b in zip(words, words[1:], strict=False)]
    return " ".join(words)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 start marks, and the number of units of each."""
    joined = "".join(START * (ORDER - 1) + t for t in texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def _hashes(codes: np.ndarray, seed: np.ndarray) -> list[np.ndarray]:
    """Key of the n-gram of each order that ends at each position; positions that lack units in front hold rubbish."""
    out, c = [], codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        h, power = np.zeros(len(c), np.uint64), np.uint64(1)
        for m in range(ORDER):
            power = power * _BASE
            h = h + np.concatenate([np.zeros(min(m, len(c)), np.uint64), c[: len(c) - m]]) * power
            k = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + seed + np.uint64(m)
            out.append(k ^ (k >> np.uint64(29)))
    return out


def _key(c: np.ndarray, at: np.ndarray, seed: np.ndarray, m: int) -> np.ndarray:
    """As _hashes() has it for n-grams of m units that end at the positions given, and for them only; c: code points + 1."""
    with np.errstate(over="ignore"):
        h, power = np.zeros(len(at), np.uint64), np.uint64(1)
        for j in range(m):
            power = power * _BASE
            h += c[at - j] * power
        k = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + seed + np.uint64(m - 1)
        return k ^ (k >> np.uint64(29))


def _seed(lang: str | None) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest((lang or "").encode()))


def _pieces(batch: pa.RecordBatch, most: int = 200_000):
    """(first row, languages, units) of stretches of rows that hold about so many units."""
    at, size, langs, texts = 0, 0, [], []
    rows = (r for k in range(0, batch.num_rows, STEP) for r in zip(*(batch.column(c).slice(k, STEP).to_pylist() for c in ("lang", "text")), strict=True))
    for i, (lang, text) in enumerate(rows):
        u = units(text)
        langs.append(lang)
        texts.append(u)
        size += len(u)
        if size >= most:
            yield at, langs, texts
            at, size, langs, texts = i + 1, 0, [], []
    if langs:
        yield at, langs, texts


@dataclass
class Grams:
    """N-grams of the highest order with their counts: keys (with the language in them), number of the language, code points."""

    key: np.ndarray
    lang: np.ndarray
    codes: np.ndarray
    n: np.ndarray


def _merged(parts: list[Grams]) -> Grams:
    key, lang, codes, n = (np.concatenate([getattr(p, c) for p in parts]) for c in ("key", "lang", "codes", "n"))
    key, first, at = np.unique(key, return_index=True, return_inverse=True)
    return Grams(key, lang[first], codes[first], np.bincount(at, n, len(key)).astype(np.int64))


def _positions(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every unit among texts that each have ORDER - 1 start marks in front, and the text that it is of."""
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
    return np.arange(len(owner)) + (owner + 1) * (ORDER - 1), owner


def _count(batches):
    """(lang, g, n): n-grams of the highest order in one task's texts."""
    alone()
    names: dict[str, int] = {}
    parts: list[Grams] = []
    for batch in batches:
        for _, langs, texts in _pieces(batch):
            codes, n = _codes(texts)
            if not n.sum():
                continue
            where, owner = _positions(n)
            number = np.array([names.setdefault(x or "", len(names)) for x in langs])
            seed = np.array([_seed(x) for x in langs], np.uint64)
            key = _key(codes.astype(np.uint64) + np.uint64(1), where, seed[owner], ORDER)
            key, first, times = np.unique(key, return_index=True, return_counts=True)
            grams = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[where[first] - ORDER + 1]
            parts.append(Grams(key, number[owner[first]], grams, times))
        if sum(len(p.key) for p in parts) > GRAMS:
            parts = [_merged(parts)]
            if len(parts[0].key) > GRAMS // 2:
                yield _counted(parts.pop(), list(names))
    if parts:
        yield _counted(_merged(parts), list(names))
    trimmed()


def _counted(grams: Grams, names: list[str]) -> pa.RecordBatch:
    c = grams.codes
    size = (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)).sum(axis=1)
    flat = np.ascontiguousarray(c).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    text = pa.StringArray.from_buffers(len(c), pa.py_buffer(offsets), pa.py_buffer(flat))
    langs = pa.DictionaryArray.from_arrays(pa.array(grams.lang, pa.int32()), pa.array(names, pa.string())).dictionary_decode()
    return pa.RecordBatch.from_arrays([langs, text, pa.array(grams.n)], names=["lang", "g", "n"])


def counted(trusted: DataFrame) -> DataFrame:
    """Stored counts (lang, g, n) of the highest order; of trusted the columns lang and text are read; null lang is ''."""
    grams = trusted.select("lang", "text").mapInArrow(_count, "lang string, g string, n long")
    return stored(grams.groupBy("lang", "g").agg(F.sum("n").alias("n")), "op3-counts")


def train(top: DataFrame) -> DataFrame:
    """Rows of the model of counted() n-grams: lang, g (n-gram or context), kind (p: log-probability of the n-gram, w: log of
    the context's weight on the lower order), value."""
    counts = {ORDER: top}
    for m in range(ORDER - 1, 0, -1):
        # Continuation counts; an n-gram that opens a text has start marks only before it and keeps its own count.
        opens = F.expr("left(g, 2)") == START * 2
        higher = counts[m + 1].select("lang", F.expr(f"right(g, {m})").alias("g"), F.when(opens, F.col("n")).otherwise(F.lit(1)).alias("n"))
        counts[m] = stored(higher.groupBy("lang", "g").agg(F.sum("n").alias("n")), "op3-counts")
    model, lower = None, None
    for m in range(1, ORDER + 1):
        c = counts[m]
        of = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"t{k}") for k in (1, 2, 3, 4)]
        t = c.groupBy("lang").agg(*of)
        y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
        d = [F.coalesce(F.when(F.col(f"t{k}") > 0, k - (k + 1) * y * F.col(f"t{k + 1}") / F.col(f"t{k}")), F.lit(0.5)) for k in (1, 2, 3)]
        t = t.select("lang", *[F.least(F.greatest(x, F.lit(0.1)), F.lit(k - 0.05)).alias(f"d{k}") for k, x in enumerate(d, 1)])
        c = c.join(F.broadcast(t), "lang")  # one row a language
        c = c.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        c = c.withColumn("h", F.expr(f"left(g, {m - 1})"))
        context = stored(c.groupBy("lang", "h").agg(F.sum("n").alias("all"), F.sum("d").alias("off")), "op3-contexts")
        c = c.join(context, ["lang", "h"])
        if lower is None:
            size = c.groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("v"))
            c = c.join(F.broadcast(size), "lang").withColumn("p0", 1 / F.col("v"))
            unknown = context.join(F.broadcast(size), "lang").select("lang", F.lit("").alias("g"), F.lit("p").alias("kind"), F.log(F.col("off") / F.col("all") / F.col("v")).alias("value"))
            model = unknown
        else:
            c = c.withColumn("s", F.expr(f"right(g, {m - 1})")).join(lower, ["lang", "s"])
        p = (F.col("n") - F.col("d")) / F.col("all") + F.col("off") / F.col("all") * F.col("p0")
        c = stored(c.select("lang", "g", p.alias("p")), "op3-order")
        lower = c.select("lang", F.col("g").alias("s"), F.col("p").alias("p0"))
        model = model.unionByName(c.select("lang", "g", F.lit("p").alias("kind"), F.log("p").alias("value")))
        if m > 1:
            model = model.unionByName(context.select("lang", F.col("h").alias("g"), F.lit("w").alias("kind"), F.log(F.col("off") / F.col("all")).alias("value")))
    return stored(model, "op3-model")


class Table:
    """Values by 64-bit key: open addressing, a slot holding the key's upper half and the value, so that a look is one access. The
    slot is of the lower half, so two keys in one place are told apart by 32 bits more."""

    def __init__(self, keys: np.ndarray | tuple = (), values: np.ndarray | tuple = ()):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.zeros(1 << bits, np.uint64)
        for k in range(0, len(keys), FILL):
            self._put(keys[k : k + FILL], values[k : k + FILL])

    @classmethod
    def of(cls, slots: np.ndarray) -> Table:
        """A table from its own slots."""
        out = cls()
        out.slots, out.mask = slots, np.uint64(len(slots) - 1)
        return out

    @staticmethod
    def _tag(keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(32) | np.uint64(1)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        held = self._tag(keys) << np.uint64(32) | values.astype(np.float32).view(np.uint32)
        pos, left = keys & self.mask, np.arange(len(keys))
        while len(left):
            at = pos[left]
            free = self.slots[at] == 0
            self.slots[at[free]] = held[left[free]]
            left = left[self.slots[at] != held[left]]
            pos[left] = (pos[left] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are there."""
        pos, tag = keys & self.mask, self._tag(keys)
        got = self.slots[pos]
        there = got >> np.uint64(32) == tag
        left = np.flatnonzero(~there & (got != 0))
        while len(left):
            pos[left] = (pos[left] + np.uint64(1)) & self.mask
            more = self.slots[pos[left]]
            hit = more >> np.uint64(32) == tag[left]
            got[left[hit]], there[left[hit]] = more[hit], True
            left = left[~hit & (more != 0)]
        return got.astype(np.uint32).view(np.float32), there


def _keys(langs: list[str], grams: list[str]) -> np.ndarray:
    out = np.zeros(len(grams), np.uint64)
    seeds = {x: _seed(x) for x in set(langs)}
    by: dict[int, list[int]] = {}
    for i, g in enumerate(grams):
        by.setdefault(len(g), []).append(i)
    for m, rows in by.items():
        if m:
            codes = np.frombuffer("".join(grams[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
            seed = np.repeat(np.array([seeds[langs[i]] for i in rows], np.uint64), m)
            out[rows] = _hashes(codes, seed)[m - 1][m - 1 :: m]
    return out


def _shard_of(last: np.ndarray, before: np.ndarray, shards: int) -> np.ndarray:
    """Shard of the contexts that end with these two units."""
    both = (before.astype(np.uint64) * np.uint64(1_000_003) + last.astype(np.uint64)) & np.uint64((1 << 31) - 1)
    return (both * np.uint64(2654435761) >> np.uint64(16) & np.uint64(0xFFFF)) % np.uint64(shards)


class Stretch:
    """Consecutive rows of a held batch, the first of them at `at`: code points + 1, and the places, texts and languages of the units, a
    shard's together."""

    def __init__(self, batch: int, at: int, langs: list[str], codes: np.ndarray, n: np.ndarray, shards: int):
        self.batch, self.at, self.n, self.langs = batch, at, n, langs
        where, owner = _positions(n)
        self.c = codes.astype(np.uint64) + np.uint64(1)
        self.cuts = np.array([0, len(where)])
        if shards > 1:
            own = _shard_of(codes[where - 1], codes[where - 2], shards).astype(np.int16)
            order = np.argsort(own, kind="stable")
            where, owner = where[order], owner[order]
            self.cuts = np.searchsorted(own[order], np.arange(shards + 1))
        self.where, self.owner = where.astype(np.int32), owner
        self.seeds = np.array([_seed(x) for x in langs], np.uint64)

    def part(self, model: Shards, number: int) -> np.ndarray:
        """Log-probability that one shard gives to the units of each text that are its own."""
        grams, weights = _tables(model.path, number)
        where, owner = (x[self.cuts[number] : self.cuts[number + 1]] for x in (self.where, self.owner))
        seed = self.seeds[owner]
        score, left = np.zeros(len(where)), np.arange(len(where))
        for m in range(ORDER, 0, -1):
            value, there = grams.get(_key(self.c, where[left], seed[left], m))
            score[left[there]] += value[there]
            left = left[~there]
            if not len(left):
                break
            if m > 1:
                value, there = weights.get(_key(self.c, where[left] - 1, seed[left], m - 1))
                score[left[there]] += value[there]
            else:
                score[left] += np.array([model.unknown.get(x or "", 0.0) for x in self.langs])[owner[left]]
        return np.bincount(owner, score, len(self.n))


def _score(batches, model: Shards):
    alone()
    try:
        yield from _scored(batches, model)
    finally:  # workers go on to other stages
        _TABLES.clear()
        trimmed()


def _scored(batches, model: Shards):
    held, stretches, size = [], [], 0
    for batch in batches:
        held.append((batch, np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)))
        for at, langs, texts in _pieces(batch):
            stretches.append(Stretch(len(held) - 1, at, langs, *_codes(texts), model.number))
            size += len(stretches[-1].c)
            if size >= HELD:
                _pass(held, stretches, model)
                yield from _yielded(held[:-1])
                held, stretches, size = held[-1:], [], 0
        if model.number == 1:  # nothing is read again for it
            _pass(held, stretches, model)
            yield from _yielded(held)
            held, stretches, size = [], [], 0
    _pass(held, stretches, model)
    yield from _yielded(held)


def _yielded(held: list):
    for batch, lp, n in held:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp), pa.array(n)], names=[*batch.schema.names, "__lp", "__units"])


def _pass(held: list, stretches: list[Stretch], model: Shards) -> None:
    """Adds what all shards give to the texts held, a shard at a time; the one that is in memory first."""
    there = [number for path, number in _TABLES if path == model.path]
    for number in sorted(range(model.number if stretches else 0), key=lambda k: k not in there):
        for x in stretches:
            _, lp, n = held[x.batch]
            lp[x.at : x.at + len(x.n)] += x.part(model, number)
            n[x.at : x.at + len(x.n)] = x.n


def _keyed(batches):
    """Keys in place of n-grams: made where the rows are, so that the driver sees numbers only."""
    for batch in batches:
        key = _keys(batch.column("lang").to_pylist(), batch.column("g").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array(key.view(np.int64)), batch.column("value").cast(pa.float32()), batch.column("shard")], names=["w", "key", "value", "shard"])


def _built(batches):
    """(shard, w, part, slots): the tables of each shard in parts of CHUNK slots, from rows that are sorted by shard."""
    alone()
    for table in groups(batches, "shard"):
        w = np.concatenate([c.to_numpy(zero_copy_only=False) for c in table.column("w").chunks])
        key, value = table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy()
        for kind in (False, True):
            slots = Table(key[w == kind], value[w == kind]).slots
            for part, k in enumerate(range(0, len(slots), CHUNK)):
                row = [table.column("shard").combine_chunks().slice(0, 1), pa.array([kind]), pa.array([part], pa.int32()), pa.array([slots[k : k + CHUNK].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["shard", "w", "part", "slots"])
    trimmed()


@dataclass(frozen=True)
class Shards:
    """The model's files in the shared folder, one subfolder a shard; the driver holds none of it."""

    path: str
    number: int
    unknown: dict


def shards_of(model: DataFrame, shard_rows: int = SHARD_ROWS) -> Shards:
    """The model in shards of a checked number of rows, each as two tables ready for use."""
    spark = model.sparkSession
    shards = max(1, -(-model.count() // shard_rows))
    unknown = {r.lang: r.value for r in model.filter("g = '' and kind = 'p'").collect()}  # one row a language
    # Contexts go by their last two units, n-grams by the two before their last; what has a shorter context goes to all.
    context = F.when(F.col("kind") == "w", F.col("g")).otherwise(F.expr("left(g, length(g) - 1)"))
    last, before = F.ascii(F.expr("right(context, 1)")).cast("long"), F.ascii(F.expr("substring(context, length(context) - 1, 1)")).cast("long")
    home = F.shiftright((before * 1_000_003 + last) % (1 << 31) * 2654435761, 16) % (1 << 16) % shards
    everywhere = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    shard = F.explode(F.when(F.length("context") < 2, everywhere).otherwise(F.array(home)))
    model = model.withColumn("context", context)
    own = model.filter(F.col("g") != "").select("lang", "g", (F.col("kind") == "w").alias("w"), "value", shard.alias("shard"))
    keyed = own.mapInArrow(_keyed, "w boolean, key long, value float, shard long")
    path = shared_path(spark, "op3-shards")
    tables = keyed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_built, "shard long, w boolean, part int, slots binary")
    tables.write.partitionBy("shard").parquet(path)
    return Shards(path, shards, unknown)


_TABLES: dict[tuple[str, int], tuple[Table, Table]] = {}


def _tables(path: str, number: int) -> tuple[Table, Table]:
    """A shard's n-grams and contexts, read from the shared folder; a worker keeps the last one only."""
    if (path, number) not in _TABLES:
        _TABLES.clear()
        store, root = fs.FileSystem.from_uri(path)
        got: dict[bool, list] = {False: [], True: []}
        if store.get_file_info(f"{root}/shard={number}").type != fs.FileType.NotFound:  # a shard, or the model, may be empty
            for batch in dataset.dataset(f"{root}/shard={number}", filesystem=store, format="parquet").to_batches(batch_size=4, use_threads=False):
                for w, part, slots in zip(*(batch.column(c).to_pylist() for c in ("w", "part", "slots")), strict=True):
                    got[w].append((part, np.frombuffer(slots, np.uint64)))
        made = [Table.of(np.concatenate([x for _, x in sorted(got[w], key=lambda x: x[0])])) if got[w] else Table() for w in (False, True)]
        _TABLES[path, number] = made[0], made[1]
    return _TABLES[path, number]


def score(docs: DataFrame, shards: Shards) -> DataFrame:
    """docs with __lp (log-probability of the text) and __units."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__lp", T.DoubleType()), T.StructField("__units", T.LongType())])
    return docs.mapInArrow(lambda b: _score(b, shards), schema)


#: Columns that judge() adds.
RESULTS = ("perplexity", "threshold", "accepted")


def _named_apart(docs: DataFrame) -> dict[str, str]:
    """New names for the columns of docs that are named like a result or like what is computed on the way."""
    return {c: f"__in_{i}" for i, c in enumerate(docs.columns) if c.startswith("__") or c.lower() in RESULTS}


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """docs with perplexity, threshold and accepted; these stand in for columns of docs with their names."""
    names = _named_apart(docs)
    out = _judged(docs.withColumnsRenamed(names), labels, quantile, margin)
    return out.drop(*[n for c, n in names.items() if c.lower() in RESULTS]).withColumnsRenamed({n: c for c, n in names.items()})


def _judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """judge() of docs whose columns clash with none of its own.

    Trusted documents are those labelled quality 1 and not toxic; all of them train the model and, held out, set the
    thresholds. Documents of a language whose trusted texts fill less than two folds have no threshold and are accepted, as
    are texts without a word (perplexity null). A null lang and an empty one are one language, of no name. doc_ids may repeat: each row is judged by its own text, labels are taken once.
    Columns of docs are kept; with no labels all documents are accepted.
    """
    ids = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("__id")).distinct()
    ids = stored(ids, "op3-trusted")
    ids = small(ids)
    trusted = docs.select("doc_id", "lang", "text").join(ids, F.col("doc_id") == F.col("__id"), "left_semi")
    # A fold is a language of its own to the counts and to the held-out models; both folds together make the whole model.
    trusted = trusted.select(F.coalesce("lang", F.lit("")).alias("__lang"), F.pmod(F.xxhash64("text"), F.lit(2)).alias("__fold"), "text")
    name = lambda fold: F.concat("__lang", F.lit("#"), fold.cast("string"))
    top = counted(trusted.withColumn("lang", name(F.col("__fold"))))
    model = shards_of(train(stored(top.groupBy(F.expr("left(lang, length(lang) - 2)").alias("lang"), "g").agg(F.sum("n").alias("n")), "op3-counts")))
    halves = shards_of(train(top))
    own = score(trusted.withColumn("lang", name(1 - F.col("__fold"))), halves).filter("__units > 0")
    own = own.filter(F.col("lang").isin(list(halves.unknown))).select("__lang", "__lp", "__units")  # two names a language
    own = stored(own, "op3-scores")
    mean = own.groupBy("__lang").agg((-F.sum("__lp") / F.sum("__units")).alias("__mean"))
    smooth = (-F.col("__lp") + F.lit(PRIOR_UNITS) * F.col("__mean")) / (F.col("__units") + PRIOR_UNITS)
    # An exact quantile of thousandths of a nat: a bounded number of bins a language, however many documents.
    bins = own.join(F.broadcast(mean), "__lang").groupBy("__lang", F.ceil(smooth * 1000).alias("bin")).count()
    w = Window.partitionBy("__lang")
    bins = bins.withColumn("below", F.sum("count").over(w.orderBy("bin"))).withColumn("all", F.sum("count").over(w))
    limit = bins.filter(F.col("below") >= F.col("all") * quantile).groupBy("__lang").agg((F.exp(F.min("bin") / 1000) * margin).alias("threshold"))
    limit = stored(mean.join(limit, "__lang"), "op3-limits")  # one row a language
    got = score(docs, model).withColumn("__l", F.coalesce("lang", F.lit("")))
    got = got.join(F.broadcast(limit), F.col("__l") == F.col("__lang"), "left")
    got = got.withColumn("perplexity", F.when((F.col("__units") > 0) & F.col("__mean").isNotNull(), F.exp(smooth)))
    return got.withColumn("accepted", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).select(*docs.columns, "perplexity", "threshold", "accepted")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judge(docs, read(spark, sf_dir, "labels")).select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "accepted")


@stage
def accepted_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier doesn't reject."""
    names = _named_apart(docs)
    out = _judged(docs.withColumnsRenamed(names), read(spark, sf_dir, "labels")).filter("accepted").drop(*RESULTS)
    return out.withColumnsRenamed({n: c for c, n in names.items()}).select(*docs.columns)


SQL: dict[str, str] = {}
