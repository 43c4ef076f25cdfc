"""Archives, prefix tries and periodic runs against plain versions, with the cases that their docstrings define."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs

from voxelmill.llm import common, periodic_runs, prefix_trie, warc

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
CRC = lambda n: zlib.crc32(str(n).encode())


def folder(spark, name, rows, schema):
    path = common.shared_path(spark, "tables")
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


# Periodic runs


def plain_runs(w, least=24, times=3):
    """Every period for itself, by stretches of words that equal the one a period on."""
    found, n = {}, len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                found.setdefault((start, i + q - start), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repeated_words(r):
    out, k = [], r.choice([1, 2, 3, 30])
    for _ in range(r.randint(0, 6)):
        block = [r.randint(0, k) for _ in range(r.randint(1, 25))]
        out += block if r.random() < 0.5 else (block * 80)[: r.randint(1, 120)]
    return out


def test_runs_of_many_texts():
    r, seen = random.Random(5), 0
    for _ in range(300):
        texts = [repeated_words(r) for _ in range(r.randint(1, 5))]
        got = periodic_runs.find_runs(np.array([x for t in texts for x in t], np.int32), np.cumsum([0, *map(len, texts)]))
        for k, t in enumerate(texts):
            assert got.get(k, []) == plain_runs(t)
            seen += len(got.get(k, []))
    assert seen > 300


def test_runs_need_their_z_values(monkeypatch):
    ids, bounds = np.tile(np.arange(10), 5), np.array([0, 50])
    assert periodic_runs.find_runs(ids, bounds) == {0: [(0, 50, 10)]}
    monkeypatch.setattr(periodic_runs, "_z", lambda *a: [])
    assert periodic_runs.find_runs(ids, bounds) == {}
    with pytest.raises(ValueError):
        periodic_runs.find_runs(ids, bounds, least=5)


def test_long_texts_of_one_word():
    one, two = np.zeros(100_000, np.int32), np.tile(np.arange(7), 9000)
    assert periodic_runs.find_runs(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)])) == {0: [(0, 100_000, 1)], 1: [(0, 63_000, 7)]}


def plain_op13(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and CRC(doc_id) % 10 == 0 and n:
        g = CRC(doc_id) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
    drop = {i for s, k, q in runs for i in range(s + q, s + k)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, SHA("".join(f"{a},{b},{c}\n" for a, b, c in runs)), SHA(kept)


def test_op13_against_plain_version(spark):
    r = random.Random(8)
    rows = [(i, "".join(f"w{x}" + r.choice([" ", "\n", "\t\x0b", "  "]) for x in repeated_words(r)), "en") for i in range(250)]
    rows += [(None, None, None), (None, "a b " * 30, "x"), (7, rows[3][1], "fr"), (7, rows[3][1], "fr"), (901, "", None), (902, " \n ", ""), (903, "ä ö ü " * 40, ""), (904, "x y " * 1500, ""), (CRC(1), "one", "")]
    path = folder(spark, "documents", [(*x, 5) for x in rows], "doc_id long, text string, runs string, n_words int")  # names that clash
    got = periodic_runs.op13_periodic_runs(spark, path)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(plain_op13(i, t)) for i, t, _ in rows)
    assert sum(q.n_runs > 0 for q in got.collect()) > 50
    empty = folder(spark, "documents", [], "doc_id long, text string")
    assert periodic_runs.op13_periodic_runs(spark, empty).count() == 0


def test_runs_survive_small_slices(spark, monkeypatch):
    r = random.Random(9)
    texts = [" ".join(map(str, repeated_words(r))).encode() for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [t.decode() for t in texts]})
    whole = [x for b in periodic_runs._runs([batch], 24, 3) for x in b.to_pylist()]
    monkeypatch.setattr(periodic_runs, "BYTES", 200)
    assert [x for b in periodic_runs._runs([batch], 24, 3) for x in b.to_pylist()] == whole and len(whole) == 40


# Prefix tries


def plain_op12(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            order = hashlib.sha256(f"{len(role.encode())}\0{role}\0{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), order, (role, text)))
    own = {c: [t for *_, t in sorted(x, key=lambda y: y[:2])] for c, x in own.items()}
    convs = {c: tuple(own.get(c - c % 100, [])[: CRC(c) % 6] + t[CRC(c) % 6 :]) for c, t in own.items()}
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[x] for x in children[node])
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], SHA(",".join(str(c) for c in sorted(m) if convs[c] == node))) for node, m in members.items())


SCHEMA = "conv_id long, turn long, role string, text string"


def trie(spark, rows):
    got = prefix_trie.op12_prefix_trie(spark, folder(spark, "conversations", [(*r, 1) for r in rows], f"{SCHEMA}, n int"))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()))


def test_op12_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    r, rows = random.Random(3), []
    for c in [*range(0, 60), *range(100, 130), *range(205, 240)]:  # of the last ones the first conversation is absent
        rows += [(c, t, "user" if t % 2 == 0 else None, r.choice(["", "äb", "abc", None, "x" * 20])) for t in range(r.choice([1, 2, 3, 7, 8, 12]))]
    rows += [(c, t, "user", f"t{t}") for c in range(300, 340) for t in range(9)]  # copies, nine turns each
    rows += [(350, t, "user", f"t{t % 9}") for t in range(14)] + [(351, t, "user", f"t{t % 9}") for t in range(15)]
    rows += [(None, 1, "user", "nobody"), (5, None, "user", "first"), (5, None, "user", "first too"), (6, 2, "user", "again"), (6, 2, "user", "again")]
    r.shuffle(rows)
    got = trie(spark, rows)
    assert got == plain_op12(rows)
    assert max(x[3] for x in got if x[1] == 9) > 30  # a group of copies ends below


def test_op12_small_tables(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "user", "x")]) == []
    for rows in ([(7, 0, "user", "hi")], [(0, 0, "user", "hi"), (0, 1, None, None)], [(c, 0, "user", "hi") for c in range(20)], [(-5, 0, "a", "b"), (-105, 0, "a", "b"), (-100, 3, "a", "c")]):
        if rows[0][0] >= 0:
            assert trie(spark, rows) == plain_op12(rows)
        else:
            assert trie(spark, rows)[0][3] == 3


def test_op12_joins_without_broadcast(spark, monkeypatch):
    r = random.Random(4)
    rows = [(c, t, "user", r.choice("ab")) for c in range(40) for t in range(r.randint(1, 6))]
    monkeypatch.setattr(prefix_trie, "SMALL", 0)
    monkeypatch.setattr(prefix_trie, "small", lambda df, most=0: df)
    assert trie(spark, rows) == plain_op12(rows)


# Archives


def plain_op11(pages, least=0):
    raw = [(p, (h or "").encode()) for p, _, h in pages]
    best = defaultdict(lambda: None)
    for p, h in raw:
        if p is not None and (best[h] is None or p > best[h]):
            best[h] = p
    out = []
    for p, h in raw:
        revisit = len(h) >= least and best[h] != p
        out.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", best[h] if revisit else None))
    return sorted(map(str, out))


PAGES = [(i, f"https://{'abc'[i % 3]}.example.org/p/{i // 7}?q={i % 2}#x", f"<p>{'ä' * (i % 5)}{i % 11}</p>") for i in range(200)]
ODD = [(None, None, None), (None, "http://x.org", "<p>0</p>"), (300, "", ""), (301, "no scheme", None), (302, "http://a.b/ \r\nEvil: 1 \x85", "x\r\n\r\ny"), (303, "http://u:p@EXAMPLE.org:80", "<b>"), (5, PAGES[5][1], PAGES[5][2]), (5, PAGES[5][1], PAGES[5][2]), (5, PAGES[5][1], "other"), (304, "http://10.0.0.1/a", "big" * 300_000)]


def test_op11_against_plain_version(spark):
    rows = PAGES + ODD + [(1000 + i, "http://hot.example.org/", "<p>hot</p>") for i in range(150)]
    path = folder(spark, "pages", [(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.op11_warc(spark, path)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(str, map(tuple, got.collect()))) == plain_op11(rows)
    assert warc.op11_warc(spark, folder(spark, "pages", [], "page_id long, url string, html string")).count() == 0


def test_archive_is_found_by_its_index_alone(spark):
    out = common.shared_path(spark, "archive")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    captures = warc.write_archive(pages, out, least=9, file_bytes=2000)
    parts = warc.build_index(captures, out, lines=5)
    assert sum(p.first > p.last for p in parts) == 0 and len(parts) > 1
    index, places = warc.Index(out, parts), {(q.key, q.page_id): (q.name, q.offset, q.length) for q in captures.collect()}
    assert len(places) == 200 and all(list(index.find(*k)) == [v] for k, v in places.items())
    assert not list(index.find("org,example,a)/p/0?q=0", 10**9)) and not list(index.find("", 0)) and not list(index.find("zzz", 0))
    some = spark.createDataFrame([(p, u) for p, u, _ in PAGES[::9]] * 3 + [(9999, "http://nowhere.org/")], "page_id long, url string")
    got = warc.read_records(warc.find_captures(some, out, parts), out).collect()
    assert sorted(q.page_id for q in got) == [p for p, *_ in PAGES[::9]]
    for q in got:
        assert q.payload is None if q.record_type == "revisit" else bytes(q.payload).decode() == PAGES[q.page_id][2]
    assert sorted(str((q.page_id, q.payload_bytes, q.payload_digest, q.record_type, q.refers_to)) for q in got) == [x for x in plain_op11(PAGES, 9) if int(x[1:].split(",")[0]) % 9 == 0]
    # Files are plain WARC: each member is a record of its own.
    store, root = fs.FileSystem.from_uri(out)
    name, offset, length = next(iter(places.values()))
    with store.open_input_file(f"{root}/{name}") as f:
        record = zlib.decompress(f.read_at(length, offset), 31)
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: ") and record.endswith(b"\r\n\r\n")
    with pytest.raises(ValueError):
        warc.parsed(record.replace(b"<p>", b"<q>"))


@pytest.mark.parametrize(("url", "key"), [("http://Ab.Example.org/X?y#z", "org,example,ab)/X?y"), ("https://a.b", "b,a)/"), ("http://u:p@a.b:80?q", "b,a:80)?q"), ("http://10.0.0.1/", "10.0.0.1)/"), ("http://[::1]/x", "[::1])/x"), ("/only/path#f", ")/only/path"), (None, ")/"), ("http://a/b c\n", "a)/b%20c%0A")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


@pytest.mark.parametrize("name", ["op11_warc", "op12_prefix_trie"])
def test_queries_equal_their_sql(spark, name):
    import os

    duckdb, folder = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in ("pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    module = warc if name.startswith("op11") else prefix_trie
    c.execute(module.SQL[name])
    names = [x[0] for x in c.description]
    assert sorted(map(str, c.fetchall())) == sorted(str(tuple(q[n] for n in names)) for q in getattr(module, name)(spark, folder).collect())
