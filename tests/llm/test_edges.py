"""Methods that results must come through, and the cases a docstring defines: repeated and null ids, empty tables, ties."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelmill.llm import common, decontaminate, embeddings, mixing, near_dedup, quality, token_files

tokenizers_at = pytest.importorskip("public_tokenizers")
WORDS = "the of and to in that is was for it with as his on be at by had not are".split()


def text(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_prefix_is_the_rarest_shingle(spark):
    """Every window that can occur has one token, and no other shingle of it is bound to be rarer; one with an unknown word has none."""
    r = random.Random(1)
    texts = [text(r, 80) for _ in range(60)]
    counts = Counter(w for t in texts for w in t.split())
    items = [(1, " ".join(texts[0].split()[5:40])), (2, " ".join(texts[1].split()[:4])), (3, "unknown1 the1"), (4, texts[2].split()[0])]
    wins = decontaminate.windows(spark.createDataFrame(items, "item_id long, text string"))
    got = decontaminate.prefixes(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), wins, 3).collect()
    assert sorted(tuple(q.w) for q in got) == sorted({tuple(q.w) for q in wins.collect()} - {("unknown1", "the1")})
    for q in got:
        k = min(3, len(q.w))
        bounds = [min(counts[w] for w in q.w[i : i + k]) for i in range(len(q.w) - k + 1)]
        assert bounds[q.off] == min(bounds)


def test_only_prefixes_are_joined(spark, monkeypatch):
    """Without its prefix a window isn't found: there is no other way to it."""
    r = random.Random(2)
    rows = docs(spark, [(i, text(r, 50), "en", "s") for i in range(20)])
    bench = spark.createDataFrame([(1, rows.first().text)], "item_id long, text string")
    assert decontaminate.decontaminate(rows, bench).filter("contaminated").count() == 1
    monkeypatch.setattr(decontaminate, "prefixes", lambda *a, f=decontaminate.prefixes: f(*a).limit(0))
    assert decontaminate.decontaminate(rows, bench).filter("contaminated").count() == 0


def test_decontaminate_in_blocks(spark):
    r = random.Random(3)
    texts = [text(r, 60) for _ in range(30)]
    rows = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(5, texts[6], "en", "s"), (None, texts[7], "en", "s"), (None, None, "en", "s")])
    bench = spark.createDataFrame([(i, " ".join(t.split()[3:30])) for i, t in enumerate(texts[::2])] + [(None, texts[1]), (0, texts[3])], "item_id long, text string")
    one, many = (sorted(map(str, decontaminate.decontaminate(rows, bench, block_bytes=b).drop("row").collect())) for b in (1 << 24, 2000))
    assert one == many and len(one) == 33
    null_item = {q.doc_id: q for q in decontaminate.decontaminate(rows, bench).collect()}[1]
    assert null_item.contaminated and null_item.n_items == 0


def test_sets_of_one_id(spark):
    """Sets that share a doc_id are one document when classes are formed; blank and null-id rows stay alone."""
    r = random.Random(4)
    a, b, c = (text(r, 60) for _ in range(3))
    rows = [(7, a), (7, b), (2, a), (9, b), (4, c), (4, " "), (None, c), (None, None), (1, None), (7, a)]
    got = sorted(((q.doc_id, q.n_shingles > 0, q.component_id, q.kept) for q in near_dedup.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()), key=str)
    want = [(7, True, 2, False), (7, True, 2, False), (7, True, 2, False), (2, True, 2, True), (9, True, 2, False), (4, True, 4, True), (4, False, 4, True), (None, True, None, True), (None, False, None, True), (1, False, 1, True)]
    assert got == sorted(want, key=str)


def test_pivotal_rounding():
    """Fractions become integral, their sum stays within one, and each is rounded up as often as it says."""
    p = np.array([0.3, 0.7, 0.5, 0.25, 0.25, 0.9, 0.1, 0.45])
    n = 6000
    units = np.repeat(np.arange(n), len(p))
    batch = pa.RecordBatch.from_arrays([pa.array(units * 7919 + 13), pa.array(np.tile(p, n)), pa.array(np.tile(np.arange(8) % 3 + 1, n)), pa.array(np.tile(np.arange(8), n))], names=["unit", "p", "size", "uid"])
    out = np.concatenate([b.column("p").to_numpy() for b in mixing._pivotal(iter([batch]), True)]).reshape(n, 8)
    assert np.isin(out, (0, 1)).all() or np.allclose(out, out.round())
    assert set(out.round().sum(axis=1)) <= {np.floor(p.sum()), np.ceil(p.sum())}
    assert np.abs(out.mean(axis=0)[np.lexsort((np.arange(8), -(np.arange(8) % 3 + 1)))].sum() - p.sum()) < 0.02
    left = np.concatenate([b.column("p").to_numpy() for b in mixing._pivotal(iter([batch]), False)]).reshape(n, 8)
    assert (((left > 1e-9) & (left < 1 - 1e-9)).sum(axis=1) <= 1).all() and np.allclose(left.sum(axis=1), p.sum())


def plain_targets(sizes):
    """Shares of 150 % by weights 5, 2, 1; what exceeds twice a size is shared again among the others."""
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, capped = 1.5 * sum(sizes), {i for i, s in enumerate(sizes) if not s}
    while True:
        rest = total - sum(2 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        share = {i: rest * w[i] / sum(w[j] for j in free) for i in free}
        if not (over := {i for i in free if share[i] > 2 * sizes[i]}):
            return [2.0 * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets(seed):
    r = random.Random(seed)
    sizes = [float(r.choice((0, 1, 10, 1000, r.randint(1, 10**6)))) for _ in range(r.randint(1, 9))]
    assert mixing.targets(sizes) == pytest.approx(plain_targets(sizes) if any(sizes) else [0.0] * len(sizes))


def test_mix_of_many_blocks(spark, monkeypatch):
    """A reduction tree of several levels; repeated ids and equal sizes; a source without a word; reruns agree."""
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    r = random.Random(5)
    rows = [(i % 150, " ".join(["w"] * r.choice((1, 3, 3, 50))), "en", r.choice("aaabc")) for i in range(400)] + [(1000, " ", "en", "z"), (None, None, "en", None)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(spark, rows).orderBy(F.desc("text")).repartition(5)).collect()))
    sizes = {s: sum(len((t or "").split()) for _, t, _, x in rows if x == s) for s in ("a", "b", "c", "z", None)}
    goal = dict(zip(sizes, plain_targets([float(v) for v in sizes.values()]), strict=True))
    for s, want in goal.items():
        own = [q for q in got if q.source == s]
        assert own[0].target == pytest.approx(want) and own[0].source_size == sizes[s]
        assert all(np.floor(want / sizes[s]) <= q.copies <= np.ceil(want / sizes[s]) for q in own if sizes[s])
        assert abs(sum(q.taken for q in own) - want) <= 0.03 * want + max(q["size"] for q in own)  # copies are kept exactly, words nearly


def test_quality_of_nothing(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs(spark, []), labels).count() == 0
    odd = docs(spark, [(1, None, None, "s"), (1, "", "", "s"), (None, "a b", None, None), (2, "x " * 30_000, "en", "s")])
    got = quality.judge(odd.selectExpr("*", "1 AS perplexity_", "'x' AS __g"), labels).collect()
    assert len(got) == 4 and all(q.accepted for q in got)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_hold_what_positions_need(spark, shards):
    """A position finds all its n-grams and contexts in its own shard, whatever the alphabet."""
    r = random.Random(shards)
    texts = ["".join(r.choice("abé日\U0001f600 ") for _ in range(60)) for _ in range(40)]
    table = spark.createDataFrame([("en", quality.units(t)) for t in texts], "lang string, text string")
    model = quality.train(quality.counted(table))
    whole, cut = (sorted((q.text, q["__lp"]) for q in quality.score(table, quality.shards_of(model, rows)).collect()) for rows in (10**9, max(1, model.count() // shards)))
    assert [t for t, _ in whole] == [t for t, _ in cut] and np.allclose([x for _, x in whole], [x for _, x in cut], atol=1e-3)


def test_counts_are_those_of_python(spark, monkeypatch):
    monkeypatch.setattr(quality, "GRAMS", 300)
    r = random.Random(9)
    rows = [(r.choice(("en", "", None)), "".join(r.choice("abé日\U0001f600 ") for _ in range(r.randint(0, 50)))) for _ in range(200)]
    got = {(q.lang, q.g): q.n for q in quality.counted(spark.createDataFrame(rows, "lang string, text string")).collect()}
    want = Counter()
    for lang, t in rows:
        u = quality.START * 4 + quality.units(t)
        want.update((lang or "", u[i - 4 : i + 1]) for i in range(4, len(u)))
    assert got == want


def test_tables():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(1, 1 << 63, 50_000, dtype=np.uint64))
    crowded = r.integers(1, 1 << 31, 200, dtype=np.uint64) << np.uint64(32) | np.uint64(5)  # all want one slot
    keys = np.unique(np.concatenate([keys, crowded]))
    values = r.normal(size=len(keys)).astype(np.float32)
    table = quality.Table(keys, values)
    got, there = table.get(keys)
    assert there.all() and (got == values).all()
    other = np.setdiff1d(r.integers(1, 1 << 63, 50_000, dtype=np.uint64), keys)
    assert not table.get(other)[1].any() and not quality.Table(np.zeros(0, np.uint64), np.zeros(0)).get(keys[:9])[1].any()


def test_files_of_odd_ids(spark, tmp_path):
    """Null ids first, rows of one id by the digest of their texts, whole sequences but the last, a mask for its padding, views of the file."""
    path, out = tokenizers_at.path("byte_bpe_50k.json"), f"file://{tmp_path}/files"
    r = random.Random(6)
    rows = [(None, "a b c", "en", "s"), (5, text(r, 200), "en", "s"), (5, text(r, 100), "en", "s"), (5, None, "en", "s"), (2, "", "en", "s"), (9, "日本 語 " * 500, "en", "s")]
    manifest = token_files.write_token_files(docs(spark, rows), path, out, length=64, shards=2)
    back = token_files.read_token_files(manifest, out, 64).orderBy("start").collect()
    assert [q.doc_id for q in back] == [None, 2, 5, 5, 5, 9]
    assert [q.start for q in back] == [0, *itertools.accumulate(q.n_tokens for q in back)][:-1]
    model = token_files.Encoder(path).library
    assert sorted(q.n_tokens for q in back) == sorted(len(model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    for m in manifest.collect():
        shard = token_files.Shard(out, m.name, 64)
        masks = [shard.sequence(i)[1].to_pylist() for i in range(-(-m.tokens // 64))]
        assert [x for mask in masks for x in mask] == [True] * m.tokens + [False] * (-m.tokens % 64)
        before = pa.total_allocated_bytes()
        held = [shard.sequence(i)[0] for i in range(len(masks))]
        assert pa.total_allocated_bytes() - before < 4096 and sum(len(x) for x in held) == 64 * len(masks)


def test_tables_of_earlier_stages_go(spark, tmp_path):
    import os

    @common.stage
    def first(spark, table, sf_dir):
        return common.stored(table, "gone-first")

    @common.stage
    def second(spark, table, sf_dir):
        return common.stored(table, "gone-second")

    def there(name):
        return [x for x in os.listdir(common.shared_root(spark).removeprefix("file://")) if x.startswith(name)]

    rows = docs(spark, [(1, "a", "en", "s")])
    one = first(spark, rows, "")
    two = second(spark, one, "")  # reads what the first has stored
    assert there("gone-first") and two.count() == 1
    two.write.parquet(f"file://{tmp_path}/two")
    first(spark, spark.read.parquet(f"file://{tmp_path}/two"), "")
    assert not there("gone-second") and len(there("gone-first")) == 1


def test_sweep(spark):
    import os

    kept = common.stored(spark.range(3).toDF("n"), "swept")
    root = common.shared_root(spark).removeprefix("file://")
    assert common.sweep(spark, 1) == 0 and kept.count() == 3
    old = [x for x in os.listdir(root) if x.startswith("swept-")][0]
    os.utime(f"{root}/{old}", (0, 0))
    assert common.sweep(spark, 1) == 1 and not os.path.exists(f"{root}/{old}")


def test_recall(spark):
    """Links found among vectors of the tables, against brute force."""
    folder = "/root/testdata/sf0.1"
    import os

    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    ids, x = zip(*[(q.vec_id, q.embedding) for q in table.collect()], strict=True)
    u = np.array(x, float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = {q.vec_id: q.n_links for q in embeddings.near_vectors(table).collect()}
    found = np.array([got[i] for i in ids])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()


@pytest.mark.parametrize("fraction", (0.05, 0.4, 0.5, 0.93))
def test_rounding_against_the_pool(fraction):
    """Words stay: one row at most is left fractional, rounding moves no more than its words, each row is rounded up as often as it says."""
    size, n = np.array([900, 400, 400, 90, 60, 30, 30, 10, 3, 0]), 6000
    units = np.repeat(np.arange(n), len(size))
    batch = pa.RecordBatch.from_arrays([pa.array(units * 7919 + 13), pa.array(np.full(len(units), fraction)), pa.array(np.tile(size, n)), pa.array(np.tile(np.arange(len(size)), n))], names=["unit", "p", "size", "uid"])
    rounds = lambda last: np.concatenate([b.column("p").to_numpy() for b in mixing._pooled(iter([batch]), last)]).reshape(n, len(size))
    left, out = rounds(False), rounds(True)
    open_ = (left > 0) & (left < 1)
    assert (open_.sum(axis=1) <= 1).all() and np.allclose(left @ size, fraction * size.sum())
    assert np.isin(out, (0, 1)).all() and (np.abs(out - left) * size).sum(axis=1).max() <= (open_ * size).sum(axis=1).max()
    assert np.abs(out.mean(axis=0) - fraction).max() < 0.03


def test_words_of_unequal_documents(spark):
    """Fifty documents of a source, one of them a fifth of all its words: words come within 2 % of the target where the others can
    take up what rounding that one moves, within half of it elsewhere."""
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * (5000 if i % 50 == 7 else r.randint(20, 700))), "en", f"s{i // 50}") for i in range(300)]
    got = mixing.mix(docs(spark, rows)).collect()
    near = 0
    for s in {q.source for q in got}:
        own = [q for q in got if q.source == s]
        total, goal = own[0].source_size, own[0].target
        f, off = goal / total % 1, abs(sum(q.taken for q in own) - goal)
        roomy = min(f, 1 - f) * (total - 5000) >= max(f, 1 - f) * 5000
        assert off <= (0.02 * goal if roomy else 2500)
        near += roomy
    assert near
