"""Secret scans through a trigram inverted index.

Each rule's regex is parsed into a Boolean query over trigrams that any match must hold. The index is a stored table of
postings (trigram, key of the text) over all distinct texts, of the trigrams that some query names. Queries are evaluated on
the postings: those of one text are brought together, all trigrams of an alternative intersect, alternatives unite, and the
rules left are the text's candidates. Their regexes run over the texts that hold the candidates; rules without mandatory
trigrams scan every text. Equal texts have one set of postings; a key that two texts share only adds candidates.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as C
import re._parser as P
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, small, stored

#: Bytes of text that are cut into trigrams at a time.
BYTES = 1 << 21
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Least length of the group that is measured (0: the match).
    least: int = 0
    group: int = 0
    any_case: bool = False

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.any_case else 0)


#: Fixed values of the contract, in its order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: Further kinds, each a published token format.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
)


def _runs(parsed, most: int = 64):
    """The sequence as runs: sets of the strings that a stretch of it can be, with None between stretches."""
    runs: list[set[str] | None] = []
    now = {""}

    def put(options: set[str] | None) -> None:
        nonlocal now
        if options is None or len(now) * len(options) > most:
            runs.append(now)
            now = {""} if options is None else options
            if options is not None:
                return
        else:
            now = {a + b for a in now for b in options}

    for op, arg in parsed:
        if op is C.LITERAL:
            put({chr(arg).lower()})
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 6:
            put({chr(a).lower() for _, a in arg})
        elif op is C.SUBPATTERN:
            inner = _runs(arg[3], most)
            if len(inner) == 1:
                put(inner[0])
            else:
                put(None)
                runs += inner
        elif op is C.BRANCH:
            parts = [_runs(x, most) for x in arg[1]]
            put(set().union(*(p[0] for p in parts)) if all(len(p) == 1 for p in parts) else None)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and tuple(arg[:2]) == (0, 1):
            inner = _runs(arg[2], most)
            put(inner[0] | {""} if len(inner) == 1 else None)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            inner = _runs(arg[2], most)
            if len(inner) == 1:
                put(inner[0])
            put(None)
        elif op is C.AT or op is C.ASSERT_NOT:
            continue
        else:
            put(None)
    return [*runs, now]


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """All of the outer list, any of the inner ones, each with all its trigrams; empty: no mandatory trigram."""
    query = []
    for run in _runs(P.parse(pattern)):
        sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if all(sets):
            query.append(sorted(set(sets), key=sorted))
    return query


class Rules:
    """Rules with their queries, and the trigrams that the queries name."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern)) for r in rules]
        self.trigrams = sorted({t for *_, q in self.rules for any_ in q for all_ in any_ for t in all_})
        self.free = [n for n, (*_, q) in enumerate(self.rules) if not q]
        coded = [int.from_bytes(t.encode(), "big") for t in self.trigrams]  # of ASCII: three bytes
        self.number = np.zeros(1 << 24, np.int16)
        self.number[coded] = np.arange(1, len(coded) + 1)

    def holds(self, found, n: int):
        """Condition on `found`, the array of a text's trigrams: the query of rule n."""
        every = None
        for any_ in self.rules[n][2]:
            some = None
            for all_ in any_:
                one = F.size(F.array_intersect(found, F.array(*[F.lit(t) for t in sorted(all_)]))) == len(all_)
                some = one if some is None else some | one
            every = some if every is None else every & some
        return every

    def postings(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of a trigram, number of the text): each trigram of the queries once for a text that holds it."""
        raw = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
        flat = np.frombuffer(b"\n\n".join(raw), np.uint8)
        if len(flat) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = flat[:-2].astype(np.int32) << 16
        code |= flat[1:-1].astype(np.int32) << 8
        code |= flat[2:]
        number = self.number[code]
        at = np.flatnonzero(number)
        start = np.cumsum([0, *(len(r) + 2 for r in raw)])
        both = np.unique((np.searchsorted(start, at, "right") - 1) * 4096 + number[at] - 1)
        return both % 4096, both // 4096

    def scan(self, text: str, rules) -> list[tuple[int, int, int]]:
        """(start, number of the rule, end) of the rules' matches, sorted."""
        found = []
        for n in rules:
            rule, regex, _ = self.rules[n]
            found += [(m.start(), n, m.end()) for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return sorted(found)


def _index(batches, rules: tuple[Rule, ...]):
    made = Rules(rules)
    for batch in batches:
        texts, keys = batch.column("text"), batch.column("key").to_numpy()
        size, low = np.cumsum(np.asarray(texts.value_lengths() if hasattr(texts, "value_lengths") else pc.binary_length(texts))), 0
        while low < len(keys):
            high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + BYTES, "right")))
            number, at = made.postings(texts.slice(low, high - low).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(made.trigrams, object)[number], pa.string()), pa.array(keys[low:high][at])], names=["trigram", "key"])
            low = high


def index(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The stored inverted index of the columns text (not null) and key: postings (trigram, key), in order of trigrams."""
    rows = texts.select("text", "key").mapInArrow(lambda b: _index(b, rules), "trigram string, key long")
    return stored(rows.distinct().sortWithinPartitions("trigram", "key"), "op8-postings")


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): the numbers of the rules whose query the postings of a key fulfil, where there is one."""
    made = Rules(rules)
    found = postings.groupBy("key").agg(F.collect_set("trigram").alias("found"))  # no more than the queries name
    asked = [F.when(made.holds(F.col("found"), n), F.lit(n)) for n, (*_, q) in enumerate(made.rules) if q]
    if not asked:
        return found.select("key", F.array().cast("array<int>").alias("rules")).limit(0)
    return found.select("key", F.array_compact(F.array(*asked)).alias("rules")).filter(F.size("rules") > 0)


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"


def _scan(batches, rules: tuple[Rule, ...]):
    made = Rules(rules)
    named = lambda spans: ",".join(f"{rules[n].kind}:{a}:{b}" for a, n, b in spans)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [made.scan(t, made.free + (r or [])) for t, r in zip(part.column("text").to_pylist(), part.column("rules").to_pylist(), strict=True)]
            counts = [pa.array([sum(n == k for _, n, _ in x) for x in found], pa.int64()) for k in range(len(BASE))]
            base = pa.array([named(s for s in x if s[1] < len(BASE)) for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, base, pa.array([named(x) for x in found], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])


def scan_secrets(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """doc_id, counts, base_spans and spans (kind:start:end, code points) of every row of docs.

    Null text is empty and holds nothing; rows with one doc_id each give a row; other columns are ignored; spans of different
    kinds may overlap and all stay; an empty table gives an empty result. Every regex moves on with each step, so times are
    linear in the text. The size of the table of candidates is checked before it is broadcast; a larger one joins by key.
    """
    rules = (*BASE, *more)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    asked = stored(candidates(index(own, rules), rules), "op8-candidates")
    return own.join(small(asked), "key", "left").select("doc_id", "text", "rules").mapInArrow(lambda b: _scan(b, rules), _SCHEMA)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


SQL: dict[str, str] = {}
