"""Runs of repeated words: stretches of a text that repeat a period three times or more.

Main and Lorentz's divide and conquer on interned word ids. A text is halved again and again; a run that lies in a segment
and crosses its midpoint has at least half of its words on one side. There the Z-function from the midpoint gives, for each
period, how far the words go on repeating; the repetition is then extended to the other side. The halves are taken in step
for all texts of a slice, and the left side is the right side of the reversed words. One that could be extended beyond
its segment belongs to a midpoint further up. Of the repetitions of one interval the smallest period stays.

A run of length L with at least half of it on one side has, by its bounds, four words or more there that follow each other
and recur one period on, so only places where the midpoint's four words recur can start anything; all others have a
Z-value below four, and need no work in Python.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

#: Least words of a run, and least number of its periods. The four words above hold for these and larger ones.
LEAST, TIMES = 24, 3
GRAM = 4
#: Bytes of text whose words are held at a time; a longer text is held alone.
BYTES = 1 << 20


def _grams(ids: np.ndarray) -> np.ndarray:
    """A number for the GRAM words from each place on; equal words have equal numbers. Places near the end have 0."""
    out = np.zeros(len(ids), np.uint64)
    if len(ids) >= GRAM:
        own, n = ids.astype(np.uint64), len(ids) - GRAM + 1
        for k in range(GRAM):
            out[:n] = out[:n] * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
    return out


def _equal(ids: np.ndarray, a: int, b: int, end: int) -> int:
    """How many words from a on equal those from b on (a < b), up to `end`."""
    total, step = 0, 32
    while b < end:
        right = ids[b : min(b + step, end)]
        differ = ids[a : a + len(right)] != right
        at = int(differ.argmax())
        if differ[at]:
            return total + at
        total, a, b, step = total + len(right), a + len(right), b + len(right), 2 * step
    return total


def _z(ids: np.ndarray, mid: int, end: int, places: list[int]) -> list[tuple[int, int]]:
    """(period, Z-value) at mid + period, for the given periods in ascending order; they hold all whose value is GRAM or more."""
    values: dict[int, int] = {}
    left = right = 0  # the box that reaches furthest, from mid on
    for q in places:
        known = values[q - left] if q + GRAM <= right else -1
        if not 0 <= known < right - q:
            known = max(0, right - q)
            known += _equal(ids, mid + known, mid + q + known, end)
            left, right = q, q + known
        values[q] = known
    return list(values.items())


def _crossing(ids, back, places, low: int, mid: int, end: int, first: int, last: int, least: int, times: int):
    """(start, end, period) of the runs within [low, end) that cross mid with half or more of their words behind it. back: the
    words reversed; the text is [first, last)."""
    n, bases = len(ids), []
    for q, z in _z(ids, mid, end, places):
        if 2 * (q + z) < max(least, times * q) or any(q % p == 0 and p + x == q + z for p, x in bases):
            continue  # too short behind mid, or a multiple of a period that ends there too
        bases.append((q, z))
        before = _equal(back, n - mid - q, n - mid, n - low)
        start, stop = mid - before, mid + q + z
        beyond = stop == end < last and ids[end] == ids[end - q] or start == low > first and ids[low - 1] == ids[low - 1 + q]
        if stop - start >= max(least, times * q) and not beyond:
            yield start, stop, q


def find_runs(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) by the number of the text, sorted, starts counted in the text; text k has the word ids
    bounds[k] to bounds[k + 1]. least >= 24 and times >= 3."""
    if least < LEAST or times < TIMES:
        raise ValueError(f"runs need {LEAST} words and {TIMES} periods at least")
    back = ids[::-1].copy()
    n, sides = len(ids), ((ids, back, _grams(ids)), (back, ids, _grams(back)))
    text, low, end = np.arange(len(bounds) - 1), bounds[:-1], bounds[1:]
    found: dict[tuple[int, int, int], int] = {}
    while True:
        long = end - low >= least
        text, low, end = text[long], low[long], end[long]
        if not len(text):
            break
        mid = (low + end) // 2
        for side, (own, other, grams) in enumerate(sides):
            a, m, b = (low, mid, end) if side == 0 else (n - end, n - mid, n - low)
            count = 2 * (b - m) // times  # longer periods have too little behind mid
            first = np.cumsum(count) - count
            which = np.repeat(np.arange(len(m)), count)
            place = np.arange(len(which)) - first[which] + m[which] + 1
            hit = np.flatnonzero(grams[place] == grams[m][which])
            at, cut = np.unique(which[hit], return_index=True)
            for k, part in zip(at.tolist(), np.split(place[hit], cut[1:]), strict=False):
                t = int(text[k])
                f, e = int(bounds[t]), int(bounds[t + 1])
                f, e = (f, e) if side == 0 else (n - e, n - f)
                for start, stop, q in _crossing(own, other, (part - m[k]).tolist(), int(a[k]), int(m[k]), int(b[k]), f, e, least, times):
                    key = (t, start - f, stop - f) if side == 0 else (t, e - stop, e - start)
                    found[key] = min(found.get(key, q), q)
        text, low, end = np.repeat(text, 2), np.stack([low, mid], 1).ravel(), np.stack([mid, end], 1).ravel()
    out: dict[int, list[tuple[int, int, int]]] = {}
    for (t, start, stop), q in found.items():
        out.setdefault(t, []).append((start, stop - start, q))
    return {t: sorted(runs, key=lambda r: (r[0], r[2])) for t, runs in out.items()}


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _of_texts(texts: list[bytes], least: int, times: int) -> tuple[list[int], list[list], list[bytes]]:
    """Words, runs, and kept words joined by a space, of each text."""
    words = [t.split() for t in texts]  # of bytes: at the six blanks of ASCII and nowhere else
    sizes = [len(w) for w in words]
    flat = pa.array(itertools.chain.from_iterable(words), pa.binary(), size=sum(sizes))
    ids = flat.dictionary_encode().indices.to_numpy()
    runs = find_runs(ids, np.cumsum([0, *sizes]), least, times)
    kept = []
    for t, own in enumerate(words):
        if t in runs:
            drop = np.zeros(len(own) + 1, np.int64)
            for start, length, period in runs[t]:
                drop[start + period] += 1
                drop[start + length] -= 1
            own = [own[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
        kept.append(b" ".join(own))
    return sizes, [runs.get(t, []) for t in range(len(texts))], kept


def _runs(batches, least: int, times: int):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        size, low = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + BYTES, "right")))
            n, runs, kept = _of_texts(texts.slice(low, high - low).to_pylist(), least, times)
            listed = pa.array([[{"start": a, "length": b, "period": c} for a, b, c in x] for x in runs], _RUNS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(n, pa.int64()), listed, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
            low = high


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, sorted by start and period) and collapsed (the text without what any run
    holds after its first period, blanks as one space) of every row of docs.

    Words are what stands between blanks (a space, tab to carriage return). Null and blank texts have no words, no runs and an
    empty collapsed text; rows with one doc_id, or none, each give a row; other columns are ignored; an empty table gives an
    empty result. Nothing is shuffled; a task holds BYTES of text or one text, and its time is n log n in the longest text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lambda b: _runs(b, least, times), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_period(docs: DataFrame) -> DataFrame:
    """The contract's texts: with h the crc32 of the decimal doc_id and g = floor(h / 10), where h % 10 = 0 each word i >= a is
    replaced by word a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)). Without words or doc_id a text stays."""
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    a, p = F.col("__g") % F.col("__n"), 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("__words"), F.floor(h / 10).alias("__g"))
    chosen = chosen.withColumn("__n", F.size("__words").cast("long")).withColumn("__a", F.when(F.col("__n") > 0, a)).withColumn("__p", p)
    place = lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1), lambda i: F.get("__words", place(i).cast("int")))
    return chosen.select("doc_id", F.when(F.col("__n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_period(read(spark, sf_dir, "documents")))

    def order(x, y):
        """Greatest exact length / period first, then smallest start, then period."""
        more = y["length"] * x["period"] - x["length"] * y["period"]
        return F.signum(F.when(more != 0, more).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"])).cast("int")

    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.get(F.array_sort("runs", order), 0)
    out = found.withColumn("best", best)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


SQL: dict[str, str] = {}
