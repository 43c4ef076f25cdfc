"""Personal data by candidate gradient boosting.

The contract's four base kinds are found by linear scans and always stay. Generous generators propose spans that may overlap:
looser forms of the four kinds, and kinds that have no base rule. Boosted trees over features of the span's format and of its
context score them, a threshold for each kind, calibrated on candidates outside the fit, selects, and of overlapping spans
the likelier one stays. The trees are fitted and calibrated on candidates of the documents themselves, a stated number of them,
as far as the base rules tell what they are, and on generated examples of every kind: written in ways that the base rules miss, and
numbers and names that only look alike. So every kind has both sides at any size of the table; what no rule decides (a phone
number without a country code) is nobody's example, the generated ones speak for it.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, stored

#: Fixed values of the contract, in its order.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), leftmost and non-overlapping in each kind, in time linear in the text.

    An address is found from its @: the local part is the run before it. Four parts of a run of dotted numbers are an
    IP from the run's first part on; a run with fewer can't match at any later digit.
    """
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not re.search("[0-9]", text):
        return out
    for m in _DOTTED.finditer(text):
        parts, place = m[0].split("."), m.start()
        for i in range(0, len(parts), 4):
            four = parts[i : i + 4]
            end = place + sum(map(len, four)) + len(four) - 1
            if len(four) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((1, place, end))
            place = end + 1
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return sorted(out)


#: Generators: more than is wanted. The first four are looser forms of the base kinds, in their order.
GENERATORS = {
    "email_like": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[\[(]\x20?at\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}){0,4}"),
    "ip_like": re.compile(r"(?<![0-9.])[0-9]{1,4}(?:[.,][0-9]{1,4}){3}(?![0-9.])"),
    "card_like": re.compile(r"(?<![0-9A-Za-z])[0-9]{3,19}(?![0-9A-Za-z])"),  # groups, see _cards
    "phone_like": re.compile(r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b", re.ASCII),
    "mac": re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])"),
}
NAMES = tuple(GENERATORS)
#: Most texts have no digit at all, and so nothing of these kinds.
_ANY, _OF_DIGITS = re.compile("[0-9]"), frozenset(("ip_like", "card_like", "phone_like", "ssn", "iban"))
_CUES = ("phone", "tel", "call", "ssn", "social", "iban", "account", "mac", "mail", "contact", "card", "order", "version", "part", "invoice", "id ")
#: Candidates of the documents that the trees are fitted and calibrated on (half each), those of the smallest digest, and as many
#: generated examples for either; a kind adds spans where those outside the fit reach this precision.
CANDIDATES, GENERATED, PRECISION = 8_000, 2_800, 0.95


def _cards(text: str):
    """(start, end) of 13 to 19 digits: whole groups of three or more that one blank, stop or hyphen parts. Groups of a longer row are
    proposed in every way, so spans overlap; few begin at one place."""
    groups = [m.span() for m in GENERATORS["card_like"].finditer(text)]
    for i, (start, _) in enumerate(groups):
        total = 0
        for k in range(i, len(groups)):
            a, b = groups[k]
            if k > i and (a != groups[k - 1][1] + 1 or text[a - 1] not in " .-"):
                break
            total += b - a
            if total > 19:
                break
            if total >= 13:
                yield start, b


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(generator, start, end): everything that the generators propose."""
    out, digits = [], _ANY.search(text)
    for n, (name, regex) in enumerate(GENERATORS.items()):
        if not digits and name in _OF_DIGITS:
            continue
        if name == "email_like" and "@" not in text and not ("at]" in text or "at)" in text or "at ]" in text or "at )" in text):
            continue
        if name == "mac" and text.count(":") < 5:
            continue
        out += [(n, a, b) for a, b in (_cards(text) if name == "card_like" else (m.span() for m in regex.finditer(text)))]
    return out


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


#: Only a phone that the base rule finds begins so.
_PREFIX = re.compile(r"\+[0-9]{1,3}[\x20.-]?")


def features(n: int, text: str, start: int, end: int) -> list[float]:
    """Format and context of a span. The country code of a phone, which only base phones are sure to have, is left out."""
    span, before, after = _PREFIX.sub("", text[start:end]), text[max(0, start - 24) : start].lower(), text[end : end + 12].lower()
    digits, name = _digits(span), NAMES[n]
    high = name == "ip_like" and any(int(x) > 255 for x in re.findall("[0-9]+", span))
    checked = name == "iban" and _iban_ok(span) or name == "card_like" and 13 <= len(digits) <= 19 and luhn(digits)
    format_ = [n, len(span), len(digits) / len(span), len(set(digits)), span.count("-"), span.count(" "), span.count("."), span.count(","), span.count("("), "dot" in span.lower(), checked, high, int(digits[:3] or 0), len(max(re.findall(r"(.)\1*", span), default="", key=len))]
    context = [before[-1:].isalnum(), after[:1].isalnum(), before[-1:].isspace(), after[:1].isspace(), after[:1] == "." and after[1:2].isdigit(), before[-1:] == "." and before[-2:-1].isdigit(), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after)]
    return [*map(float, format_), *map(float, context), *(float(c in before) for c in _CUES)]


class Boosted:
    """Logistic boosting of trees of depth two over histograms of at most 32 quantile bins a feature."""

    def __init__(self, rounds: int = 60, rate: float = 0.3):
        self.rounds, self.rate, self.trees, self.bias = rounds, rate, [], 0.0

    @staticmethod
    def _split(x, g, h, rows):
        best, gs, hs = (1e-6, None), g[rows], h[rows]
        base = gs.sum() ** 2 / (hs.sum() + 1)
        for f in range(x.shape[1]):
            v = x[rows, f]
            gl, hl = (np.bincount(v, w, 32).cumsum()[:-1] for w in (gs, hs))
            n = np.bincount(v, minlength=32).cumsum()[:-1]
            gain = gl**2 / (hl + 1) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + 1) - base
            gain[(n == 0) | (n == len(v))] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
        return best[1]

    def _grow(self, x, g, h, rows, depth, out):
        cut = self._split(x, g, h, rows) if depth and len(rows) > 20 else None
        if cut is None:
            value = float(-g[rows].sum() / (h[rows].sum() + 1) * self.rate)
            out[rows] += value
            return value
        f, k = cut
        low = x[rows, f] <= k
        return (f, float(self.cuts[f][k]), self._grow(x, g, h, rows[low], depth - 1, out), self._grow(x, g, h, rows[~low], depth - 1, out))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        # At most 31 cuts a feature; the last ones repeat the greatest value, so that they cut nothing.
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower")) for c in x.T]
        self.cuts = [np.concatenate([c, np.full(32 - len(c), np.inf)]) for c in self.cuts]
        binned = np.stack([np.searchsorted(c, v) for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        self.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        score, rows = np.full(len(y), self.bias), np.arange(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            self.trees.append(self._grow(binned, p - y, p * (1 - p), rows, 2, score))
        return self

    def _add(self, tree, x, rows, out) -> None:
        if not isinstance(tree, tuple):
            out[rows] += tree
            return
        f, cut, low, high = tree
        left = x[rows, f] <= cut
        self._add(low, x, rows[left], out)
        self._add(high, x, rows[~left], out)

    def probabilities(self, rows: list[list[float]] | np.ndarray) -> np.ndarray:
        x = np.asarray(rows, float)
        score = np.full(len(x), self.bias)
        for tree in self.trees if len(x) else ():
            self._add(tree, x, np.arange(len(x)), score)
        return 1 / (1 + np.exp(-score))


def _card(d, r: random.Random, right: bool) -> str:
    """16 digits in one of the usual ways to write them; right: Luhn's sum holds."""
    body = r.choice("3456") + d(14)
    good = next(c for c in "0123456789" if luhn(body + c))
    number = body + (good if right else r.choice([c for c in "0123456789" if c != good]))
    return r.choice(("", " ", "-", ".")).join(number[i : i + 4] for i in range(0, 16, 4))


def _example(name: str, yes: bool, r: random.Random, d, word) -> tuple[str, str]:
    """(cue, span) of one generated example of the kind."""
    if name == "email_like":
        at, dot = r.choice((("@", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "."), (" (at) ", ".")))
        user = word() + r.choice(("", ".", "_", "-")) + word() + r.choice(("", d(2)))
        return r.choice(("mail ", "contact ", "")), f"{user}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr'))}" if yes else r.choice((f"{word()}{at}{word()}", f"{d(2)}@{d(2)}", f"{word()}@{d(1)}"))
    if name == "ip_like":
        part = lambda: str(r.randint(0, 255))
        if yes:
            return r.choice(("", "id ", "mail ")), ".".join(part() for _ in range(4))
        wrong = [part() for _ in range(4)]
        wrong[r.randint(0, 3)] = str(r.randint(256, 9999))
        return r.choice(("version ", "part ", "")), r.choice((".".join(wrong), ",".join(part() for _ in range(4))))
    if name == "card_like":
        return r.choice(("card ", "account ", "") if yes else ("order ", "invoice ", "id ", "")), _card(d, r, yes)
    if name == "phone_like":
        a, b, c = d(3), d(3), d(4)
        if yes:
            plain = r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}"))
            return (r.choice(("call ", "tel ", "phone ", "contact ", "")), plain) if r.random() < 0.7 else (r.choice(("call ", "tel ", "phone ")), r.choice((f"{a} {b} {c}", f"{a}.{b}.{c}", a + b + c)))
        return r.choice(("order ", "part ", "invoice ", "version ", "id ")) if r.random() < 0.7 else "", r.choice((f"{a} {b} {c}", f"{a}.{b}.{c}", a + b + c))
    if name == "ssn":
        span = f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}" if yes else f"{r.choice(('000', '666', str(r.randint(900, 999)), d(3)))}-{d(2)}-{d(4)}"
        return r.choice(("ssn ", "social security ", "SSN: ", "")) if yes else r.choice(("part ", "order ", "version ", "invoice ", "id ")), span
    if name == "iban":
        body, number = r.choice(("DE", "FR", "ES", "GB")), d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in number + body + "00")) % 97
        span = f"{body}{check if yes else (check + r.randint(1, 60)) % 98:02d}{number}"
        return r.choice(("iban ", "account ", "")) if yes else r.choice(("part ", "order ", "account ", "")), span
    span = ":".join(f"{r.randint(0, 255):02x}" for _ in range(6)) if yes else ":".join(d(2) for _ in range(6))
    return r.choice(("mac ", "MAC: ", "")) if yes else r.choice(("version ", "id ", "")), span


def examples(n: int, seed: int) -> list[tuple[int, str, int, int, int]]:
    """generator, text, start, end, label: generated data of every kind in fitting contexts, and numbers, names and codes that look
    alike; the same cues stand before some of both."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("the", "an", "er", "is", "to", "on", "re", "ing", "la", "que")) for _ in range(r.randint(1, 3)))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    out = []
    while len(out) < n:
        name, yes = r.choice(NAMES), r.random() < 0.5
        cue, span = _example(name, yes, r, d, word)
        text = " ".join(word() for _ in range(4)) + " " + cue + span + r.choice((" ", ". ", ", ")) + word()
        out += [(n_, text, a, b, int(yes)) for n_, a, b in proposals(text) if NAMES[n_] == name]
    return out[:n]


def _covered(base: list[tuple[int, int, int]], n: int, start: int, end: int) -> int:
    return int(any(k == n and a < end and b > start for k, a, b in base))


def _label(base: list[tuple[int, int, int]], n: int, text: str, start: int, end: int) -> int | None:
    """1 for a span of its own base kind; 0 for part of another one, and for what fails the kind's own check; None where no rule tells."""
    if _covered(base, n, start, end):
        return 1
    if any(a < end and b > start for _, a, b in base) or NAMES[n] == "ip_like":
        return 0
    return 0 if NAMES[n] == "card_like" and not luhn(_digits(text[start:end])) else None


def _candidates(batches):
    """(digest, features, label) of the candidates that the base rules label."""
    names = ["digest", "features", "label"]
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            found = [c for c in proposals(text) if c[0] < len(KINDS)]
            if found:
                base, key = base_spans(text), xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
                rows += [((key + a * 0x9E3779B97F4A7C15) % (1 << 63), features(n, text, a, b), label) for n, a, b in found if (label := _label(base, n, text, a, b)) is not None]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.float64()), pa.int64()), strict=True)], names=names)


@dataclass(frozen=True)
class Model:
    trees: Boosted
    #: The least probability that is taken, by generator.
    thresholds: tuple[float, ...]


def calibrated(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest threshold at which what is taken has that precision, halfway to the next lower example; none reaches it: above 1."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)  # equal probabilities are taken together
    good = np.flatnonzero((hits >= precision) & last)
    return float(np.append(p[order], 0.0)[good[-1] : good[-1] + 2].mean()) if len(good) else 2.0


def fitted(docs: DataFrame, most: int = CANDIDATES, seed: int = 5) -> Model:
    """The model of the documents; without any candidate it is that of the generated examples."""
    rows = docs.select("text").mapInArrow(_candidates, "digest long, features array<double>, label long")
    rows = stored(rows.orderBy("digest", "label", F.xxhash64("features")).limit(most), "op5-candidates").collect()  # `most` at most
    # A digest is that of a text and a place, so copies of a candidate are on one side.
    own = {half: [(r.features, r.label) for r in rows if r.digest // 7 % 2 == half] for half in (0, 1)}
    for half in (0, 1):
        own[half] += _generated(seed + half)
    x, y = zip(*own[0], strict=True)
    trees = Boosted().fit(np.array(x), np.array(y, float))
    x, y = (np.array(c, float) for c in zip(*own[1], strict=True))
    p = trees.probabilities(x)
    return Model(trees, tuple(calibrated(p[x[:, 0] == n], y[x[:, 0] == n]) for n in range(len(NAMES))))


@functools.cache
def _generated(seed: int) -> list[tuple[list[float], int]]:
    return [(features(n, t, a, b), y) for n, t, a, b, y in examples(GENERATED, seed)]


def added(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[str, int, int]]:
    """Spans that the trees take: likeliest first, none over another or over a base span; sorted by generator and place."""
    starts, ends = [], []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(ends, a + 1)  # the first interval that ends behind a
        return i == len(starts) or starts[i] >= b

    found = [c for c in proposals(text) if free(*c[1:])]
    if not found:
        return []
    p = model.trees.probabilities([features(n, text, a, b) for n, a, b in found])
    more = []
    for _, a, b, n in sorted((-q, a, b, n) for q, (n, a, b) in zip(p.tolist(), found, strict=True) if q >= model.thresholds[n]):
        if free(a, b):
            i = bisect.bisect_left(starts, a)
            starts.insert(i, a)
            ends.insert(i, b)
            more.append((n, a, b))
    return [(NAMES[n], a, b) for n, a, b in sorted(more)]


def spans_of(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    return base, added(text, base, model)


def _find(batches, model: Model):
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            base, more = spans_of(text.as_py() or "", model)
            named = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
            rows.append((doc, *(sum(k == i for k, *_ in base) for i in range(4)), named, ",".join(filter(None, [named, *(f"{k}:{a}:{b}" for k, a, b in more)]))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_spans and spans (kind:start:end in code points) of every row of docs.

    Null text is empty and holds nothing; rows with one doc_id each give a row; other columns are ignored; an empty table gives
    an empty result. Base spans of different kinds may overlap; added ones overlap nothing. Without a model one is fitted
    on the documents, the same for the same texts in whatever order. Times are linear in a text, but for sorting its spans.
    """
    model = model or fitted(docs)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"
    return docs.select("doc_id", "text").mapInArrow(lambda b: _find(b, model), schema)


def redacted(text: str, model: Model) -> str:
    """The text with every span replaced by its kind."""
    base, more = spans_of(text, model)
    for kind, a, b in sorted([*((KINDS[k], a, b) for k, a, b in base), *more], key=lambda s: -s[1]):
        text = f"{text[:a]}[{kind}]{text[b:]}"
    return text


def op5_pii(spark, sf_dir: str) -> DataFrame:
    out = find_pii(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


SQL: dict[str, str] = {}
