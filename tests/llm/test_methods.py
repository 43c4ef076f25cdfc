"""Results that come through the dealt method: taking it away changes rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from voxelmill.llm import common, decontaminate, embeddings, html_text, pii, quality

WORDS = "the of and to in that is was for it with as his on be at by had not are".split()


def words(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


# Personal data


def few_rows(seed):
    """A small table: some base spans of each kind, and spans in ways that no base rule finds, beside numbers that look alike."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    wild = {
        "email_like": lambda: f"{r.choice(WORDS)}.{r.choice(WORDS)} [at] {r.choice(WORDS)} [dot] com", "phone_like": lambda: r.choice((f"call {d(3)}-555-{d(4)}", f"({d(3)}) 555-{d(4)}")),
        "card_like": lambda: f"{pii._card(d, r, True).replace('.', ' ')} {pii._card(d, r, True)}",
    }
    alike = (lambda: f"order {d(3)} {d(3)} {d(4)}", lambda: f"{r.choice(WORDS)}@{r.choice(WORDS)}", lambda: f"version {r.randint(1, 9)}.{r.randint(300, 999)}.1.2", lambda: f"order {pii._card(d, r, False)}", lambda: f"part {d(10)}")
    rows = [(i, f"{words(r, 6)} {r.choice(('a.b@c.de', '1.2.3.4', '4111 1111 1111 1111', '+1 (310) 555-4510'))} {words(r, 4)}") for i in range(12)]
    planted = [(100 + i, f"{words(r, 6)} {make()} {words(r, 5)}", kind) for i, (kind, make) in enumerate(list(wild.items()) * 25)]
    decoys = [(1000 + i, f"{words(r, 6)} {make()} {words(r, 5)}") for i, make in enumerate(alike * 20)]
    return rows, planted, decoys


def test_trees_find_what_no_base_rule_does(spark):
    rows, planted, decoys = few_rows(3)
    docs = spark.createDataFrame([*rows, *(p[:2] for p in planted), *decoys], "doc_id long, text string")
    got = {q.doc_id: [s.split(":")[0] for s in q.spans.split(",") if s] for q in pii.find_pii(docs).collect()}
    for kind in ("email_like", "phone_like", "card_like"):
        own = [i for i, _, k in planted if k == kind]
        assert sum(kind in got[i] for i in own) >= 0.9 * len(own), kind
    assert sum(bool(got[i]) for i, _ in decoys) <= 0.05 * len(decoys)
    none = pii.Model(pii.Boosted(), (2.0,) * len(pii.NAMES))
    bare = {q.doc_id: q.spans for q in pii.find_pii(docs, none).collect()}
    assert sum(not bare[i] for i, *_ in planted) >= 0.9 * len(planted)


@pytest.mark.parametrize("n", [0, 5, 12])
def test_no_kind_is_off_for_the_size_of_a_table(spark, n):
    rows, *_ = few_rows(4)
    model = pii.fitted(spark.createDataFrame(rows[:n], "doc_id long, text string"))
    assert max(model.thresholds) < 1
    for text, kind in (("call 555-123-4567 now", "phone_like"), ("john [at] example [dot] com", "email_like"), ("by card 4111.1111.1111.1111 it", "card_like")):
        assert [k for k, *_ in pii.spans_of(text, model)[1]] == [kind]


def test_what_rules_tell():
    base = pii.base_spans("1.2.3.4 and +1 (310) 555-4510")
    names = {n: i for i, n in enumerate(pii.NAMES)}
    text = "1.2.3.4 and +1 (310) 555-4510"
    assert pii._label(base, names["ip_like"], text, 0, 7) == 1 and pii._label(base, names["phone_like"], text, 0, 5) == 0
    assert pii._label([], names["phone_like"], "555-123-4567", 0, 12) is None and pii._label([], names["card_like"], "4111 1111 1111 1112", 0, 19) == 0


# Style trees


def site(seed, pages):
    """(html, slots) of the pages of one host without any article element: each slot has so many different texts and shapes."""
    r, out = random.Random(seed), []
    slots = [(f"x{chr(97 + i)}", r.choice((1, 1, 2, 40, 400)), r.choice((1, 1, 3)), r.choice((1.0, 1.0, 0.7, 0.3))) for i in range(7)]
    for n in range(pages):
        own = []
        for name, texts, shapes, often in slots:
            if r.random() < often:
                text, shape = f"{name} text {r.randrange(texts)}", r.randrange(shapes)
                own.append((name, text, shape))
        html = "<html><body>" + "".join(f"<div class='{k}'>{t}{('', '<span></span>', '<span></span><em></em>')[s]}</div>" for k, t, s in own) + f"<div class='body'>page {n} of {seed}</div></body></html>"
        out.append((html, [*own, ("body", f"page {n} of {seed}", 0)]))
    return out


def entropy(values):
    n = Counter(values)
    return math.log2(sum(n.values())) - sum(c * math.log2(c) for c in n.values()) / sum(n.values())


def plain_texts(pages):
    """The pages' texts less the slots of low entropy, both of text and of the elements within, over pages that read differently."""
    distinct = {}
    for _, own in pages:
        distinct.setdefault(tuple(t for _, t, _ in own), []).append(own)
    whole = entropy(range(len(distinct)))
    low = set()
    for name in {n for _, own in pages for n, *_ in own}:
        # Of copies that place the same texts differently the slot of the least digests counts; here copies are alike or shape alone differs.
        seen = [[(t, s) for n, t, s in own[0] if n == name] for own in distinct.values()]
        seen = [x[0] for x in seen if x]
        if len(seen) >= 4 and len(seen) >= 0.5 * len(distinct) and whole >= 1 and entropy(t for t, _ in seen) <= 0.2 * whole and entropy(s for _, s in seen) <= 0.2 * whole:
            low.add(name)
    return [" ".join(t for n, t, _ in own if n not in low) for _, own in pages], low


def test_style_tree_equals_a_plain_one(spark, monkeypatch):
    rows, want, removed = [], [], 0
    for seed in range(12):
        pages = site(seed, 30)
        texts, low = plain_texts(pages)
        removed += len(low)
        rows += [(len(rows) + i, f"http://h{seed}.example.org/{i}", html) for i, (html, _) in enumerate(pages)]
        want += texts
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [q.text for q in html_text.extract_text(table).orderBy("page_id").collect()]
    assert got == want and removed >= 12
    monkeypatch.setattr(html_text, "low_nodes", lambda pages: pages.selectExpr("host", "1L AS path").limit(0))
    bare = [q.text for q in html_text.extract_text(table).orderBy("page_id").collect()]
    assert sum(a != b for a, b in zip(bare, want, strict=True)) > 200


@pytest.mark.parametrize("name", ["search", "form", "social", "banner", "related", "share", "comment", "menu", "login", "modal"])
def test_an_id_in_an_article_is_a_place_to_jump_to(name):
    for part in (f"<section id='{name}'><h2>On {name}</h2><p>kept</p></section>", f"<p id='{name}'>On {name} kept</p>", f"<div class='section' id='{name}'>On {name} kept</div>"):
        assert html_text.main_text(f"<article><p>first</p>{part}</article>") == f"first On {name} kept"
    assert html_text.main_text(f"<article><p>first</p><div id='{name}'>gone</div><section class='{name}'>gone</section></article>") == "first"
    assert html_text.main_text(f"<body><section id='{name}'>gone</section><p>kept</p></body>") == "kept"


# Embeddings


def test_links_near_the_bound_are_found(spark):
    """Pairs and clusters planted at a cosine of 0.9 to 0.93 among thousands of vectors, against brute force."""
    r = np.random.default_rng(6)
    u = r.normal(size=(4000, 64))
    near = lambda v, c: c * v / np.linalg.norm(v) + math.sqrt(1 - c * c) * (lambda w: w / np.linalg.norm(w))((w := r.normal(size=64)) - (w @ v) / (v @ v) * v)
    pairs = [near(u[i], r.uniform(0.9, 0.93)) for i in range(1500)]
    heart = r.normal(size=64)
    cluster = [near(heart, r.uniform(0.94, 0.97)) for _ in range(60)]
    x = np.concatenate([u, pairs, cluster]).astype(np.float32).astype(float)
    x = x[r.permutation(len(x))]
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (n @ n.T >= 0.9).sum(axis=1) - 1
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {q.vec_id: q.n_links for q in embeddings.near_vectors(table).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert links.sum() > 3000 and (found <= links).all() and found.sum() >= 0.99 * links.sum()


# Benchmark words


def test_only_the_benchmarks_words_are_counted(spark):
    """The counts that order shingles are those of the whole corpus, of the words that a window holds."""
    r = random.Random(2)
    docs = spark.createDataFrame([(i, words(r, 30)) for i in range(20)] + [(99, "unheard of words all over")], "doc_id long, text string")
    wins = decontaminate.windows(spark.createDataFrame([(1, "the of and"), (2, "never seen")], "item_id long, text string"))
    got = decontaminate.prefixes(docs, wins, 3).collect()
    assert [tuple(q.w) for q in got] == [("the", "of", "and")] and got[0].off == 0


def test_quality_of_tables_with_clashing_names(spark):
    """Columns named like the results, or like what is computed on the way, stay or are stood in for."""
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(40)), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    want = {q.doc_id: (q.perplexity, q.accepted) for q in quality.judge(docs, labels).collect()}
    odd = docs.selectExpr("*", "1 AS __lp", "'x' AS __units", "2 AS __lang", "'l' AS __l", "3 AS __mean", "'mine' AS Perplexity", "7 AS accepted")
    got = quality.judge(odd, labels)
    assert got.columns == ["doc_id", "text", "lang", "__lp", "__units", "__lang", "__l", "__mean", "perplexity", "threshold", "accepted"]
    assert {q.doc_id: (q.perplexity, q.accepted) for q in got.collect()} == want and {q["__units"] for q in got.collect()} == {"x"}
    path = common.shared_path(spark, "tables")
    labels.write.parquet(f"{path}/labels.parquet")
    kept = quality.accepted_documents(spark, odd, path)
    assert kept.columns == odd.columns and {(q.Perplexity, q.accepted) for q in kept.collect()} == {("mine", 7)}
    assert {q.doc_id for q in kept.collect()} == {i for i, (_, ok) in want.items() if ok}
