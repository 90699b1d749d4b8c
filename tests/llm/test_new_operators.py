"""Fingerprints, prefix trie and periodic runs against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import common, iblt, queries, runs, trie

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, bucket string, cells string, a string, part string, pair string, node string, row string"


def docs(spark, rows):
    """Documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in rows], DOC).repartition(3)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "?!"), (5, "one"), (None, "no id here at all"), (None, None), (6, "twice told. tale"), (6, "twice told. tale"), (7, "a" * 3000)]


# ---- document fingerprints

def plain_digests(text: str | None) -> set[int]:
    cut = re.sub(r"([.!?])[\x20\x09-\x0D]+", "\\1\n", text or "")
    return {int(hashlib.md5(p.encode()).hexdigest()[:15], 16) for p in cut.split("\n") if p}


def sentences(rng, n, vocabulary):
    return " ".join(f"s{rng.randrange(vocabulary)} ends." for _ in range(n))


def test_sketches_give_every_difference(spark):
    """From none to thousands of differing digests: small sketches, larger ones, and sub-tables that fail."""
    rng = random.Random(3)
    rows = []
    for i, n in enumerate([0, 1, 2, 3, 5, 8, 12, 20, 40, 200, 3000] * 4):
        shared = {rng.getrandbits(60) for _ in range(rng.choice([0, 5, 500]))}
        a, b = ({rng.getrandbits(60) for _ in range(rng.randrange(n + 1))} for _ in range(2))
        rows.append((i, sorted(shared | a), sorted(shared | b)))
    rows += [(100, None, [1, 2]), (101, None, None), (102, [0], []), (103, [], [0, (1 << 60) - 1])]
    got = {r.pair: r for r in iblt.differences(spark.createDataFrame(rows, "pair long, a array<long>, b array<long>")).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    for i, a, b in rows:
        a, b = set(a or []), set(b or [])
        assert (sorted(got[i].only_a), sorted(got[i].only_b)) == (sorted(a - b), sorted(b - a)), i
    assert iblt.differences(spark.createDataFrame([], "pair long, a array<long>, b array<long>")).count() == 0


def test_small_differences_need_no_larger_sketch(spark):
    rng = random.Random(4)
    rows = [(i, [rng.getrandbits(60) for _ in range(6)]) for i in range(300)]
    got = spark.createDataFrame(rows, "i long, a array<long>").select(iblt.is_peeled(iblt.peel(iblt.sketch(iblt.signed(F.col("a"))))).alias("ok")).collect()
    assert np.mean([r.ok for r in got]) > 0.93


def plain_fingerprints(rows: list[tuple]) -> dict:
    """By distinct, non-null ids."""
    order = sorted(rows, reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]

        def near(other):
            a, b = plain_digests(t), plain_digests(other)
            return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0

        out[i] = (len(t), sha(edited), near(edited), near(after), len(plain_digests(t)))
    return out


def test_fingerprints_against_plain(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(-500, 10**6), rng.choice([None, "", "é𝄞 ü.\n" * 3, sentences(rng, rng.randrange(1, 60), rng.choice([5, 10**6]))])) for _ in range(120)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(10**7, sentences(rng, 9000, 10**6)), (10**7 + 1, sentences(rng, 9000, 10**6))]
    table = docs(spark, rows)
    got = {r.doc_id: r for r in iblt.fingerprints(table).collect()}
    want = plain_fingerprints(rows)
    assert {i: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.n_paragraphs) for i, r in got.items()} == want
    texts = dict(rows)
    same = defaultdict(set)
    for i, r in got.items():
        same[texts[i] or ""].add(str(r.cells))
    assert all(len(s) == 1 for s in same.values())
    assert len({str(r.cells) for r in got.values()}) == len({frozenset(plain_digests(t)) for t in same})


def test_fingerprint_edges(spark):
    got = iblt.fingerprints(docs(spark, EDGES)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in EDGES)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    twice = [r for r in got if r.doc_id == 6]
    assert max(r.near_next for r in twice) == 1.0 and twice[0].cells == twice[1].cells
    one = iblt.fingerprints(docs(spark, [(9, "only. one here. of all")])).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 22)]
    assert iblt.fingerprints(docs(spark, [])).count() == 0
    assert iblt.fingerprints(docs(spark, [(None, f"{i:04d}four") for i in range(40)])).select("edited_sha256").distinct().count() == 40


def test_changed_paragraphs(spark):
    old = docs(spark, [(1, "same. old one. same end"), (2, "a.\nb.\nc"), (3, "gone"), (4, None)])
    new = docs(spark, [(1, "same. new one. same end"), (2, "c\nb.\na."), (4, "x. y."), (5, "come")])
    got = {r.doc_id: (r.gone, r.come) for r in iblt.changed_paragraphs(old, new).collect()}
    assert got == {1: (["old one."], ["new one."]), 2: ([], []), 4: ([], ["x.", "y."])}


def test_fingerprints_use_no_python(spark):
    plan = iblt.with_next(common.table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- prefix trie

def plain_trie(rows: list[tuple], heads: bool) -> list[tuple]:
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16], r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if heads else 0
        convs[c] = own.get(c - c % 20, [])[:h] + v[h:]
    nodes, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, m in nodes.items():
        s = (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += s
    out = []
    for p, m in nodes.items():
        ids = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(ids)))
    return sorted(out, key=str)


def turns(spark, rows):
    schema = "conv_id long, turn long, role string, text string, path string, node string, words string, first string"
    return spark.createDataFrame([(*r, *["x"] * 4) for r in rows], schema).repartition(3)


def some_turns(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(10_000), 150):
        for t in range(rng.choice([1, 2, 3, 9, 40])):
            rows.append((c, t, rng.choice(["user", "bot"]) if t % 5 == 4 else "user", f"say {rng.randrange(2)}" if t < 6 or rng.random() < 0.8 else f"own {rng.random()}"))
    rows += [(20_000, None, None, "first"), (20_000, 0, "user", None), (20_001, 1, "", ""), (20_001, 1, "user", "tie"), (20_001, 1, "user", "tie"), (None, 0, "user", "lost"),
             (30_007, 0, "u", "no neighbour here"), (5, None, None, None)]
    rows += [(c, 0, "user", "the very same words") for c in range(40_001, 40_020)]
    return rows


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_trie_against_plain(spark, batch):
    rows = some_turns(8)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        convs = trie.conversations(turns(spark, rows))
        for heads in (True, False):
            out = trie.trie(trie.with_heads(convs) if heads else convs)
            assert sorted(map(tuple, out.collect()), key=str) == plain_trie(rows, heads)
    finally:
        spark.conf.set(key, before)


def test_trie_edges(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert trie.trie(trie.conversations(turns(spark, rows))).count() == 0
    deep = [(1, i, "user", f"w {i}") for i in range(3000)] + [(2, i, "user", f"w {i}") for i in range(1500)] + [(3, 0, "user", "long " * 50_000)]
    got = sorted(map(tuple, trie.trie(trie.conversations(turns(spark, deep))).collect()), key=str)
    assert got == plain_trie(deep, False)
    # h turns of an own conversation of fewer turns leave none: it ends at the root
    short = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = trie.trie(trie.with_heads(trie.conversations(turns(spark, [(short, 0, "user", "hello")])))).collect()
    assert [(r.conv_id, r.depth, r.n_leaves, r.ends_sha256) for r in got] == [(short, 0, 1, sha(str(short)))]


def test_members_are_joined_in_numeric_order(spark):
    ids = [-70_000, -3, 0, 5, 4095, 4096, 10_000, 10**12]
    got = trie.trie(trie.conversations(turns(spark, [(i, 0, "user", "hi") for i in ids]))).collect()
    assert {r.ends_sha256 for r in got if r.depth == 1} == {sha(",".join(map(str, ids)))}


# ---- periodic runs

def plain_runs(words: list) -> list[tuple]:
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapse(doc_id, text) -> tuple:
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, n_, q in found for i in range(s + q, s + n_)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (len(found), *top, top[1] * 1000 // top[2] if found else None,
            sha("".join(f"{s},{n_},{q}\n" for s, n_, q in sorted(found, key=lambda r: (r[0], r[2])))), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic_texts(seed: int, n: int) -> list[str]:
    rng, out = random.Random(seed), []
    for _ in range(n):
        k, m = rng.choice([1, 2, 2, 3, 6]), rng.randrange(0, 150)
        words = [f"w{rng.randrange(k)}" for _ in range(m)]
        if rng.random() < 0.6 and m:
            p = rng.randrange(1, max(2, m // 3))
            words = (words[:m // 4] + words[m // 4:m // 4 + p] * 60)[:m]
            if rng.random() < 0.5:
                words += ["x"] + words[:m // 2]
        out.append(rng.choice([" ", "\t", " \n"]).join(words))
    return out


def test_wavelet_and_blocks_against_plain():
    rng = np.random.default_rng(6)
    values = rng.permutation(700)
    w = runs.Wavelet(values)
    lo = rng.integers(0, 700, 300)
    hi = lo + rng.integers(0, 701 - lo)
    x = rng.integers(0, 1100, 300)
    assert w.below(lo, hi, x).tolist() == [(values[a:b] < v).sum() for a, b, v in zip(lo, hi, x)]
    some = hi > lo
    k = rng.integers(0, (hi - lo)[some])
    assert w.at_rank(lo[some], hi[some], k).tolist() == [np.sort(values[a:b])[i] for a, b, i in zip(lo[some], hi[some], k)]
    symbols, _ = runs.numbered([[b"a", b"b"] * 20 + [b"c"], [], [b"a"] * 9, [b"b", b"a"] * 21])
    blocks, n = runs.Blocks(symbols, 42), len(symbols)
    assert blocks.suffixes.tolist() == sorted(range(n), key=lambda i: symbols[i:].tolist())
    a = rng.integers(0, n - 1, 200)
    b = a + 1 + rng.integers(0, n - 1 - a)

    def equal(x, y):
        return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    assert blocks.forward(a, b).tolist() == [equal(symbols[i:], symbols[j:]) for i, j in zip(a, b)]
    assert blocks.backward(a, b).tolist() == [equal(symbols[:i][::-1], symbols[:j][::-1]) for i, j in zip(a, b)]


@pytest.mark.parametrize("batch", [1, 400, 250_000])
def test_runs_against_plain(spark, monkeypatch, batch):
    texts = periodic_texts(batch, 150)
    parts = []
    held, n = [], 0
    for t in map(str.encode, texts):
        if held and n + len(t.split()) > batch:
            parts.append(held)
            held, n = [], 0
        held.append(t.split())
        n += len(t.split())
    for texts_ in [*parts, held]:
        symbols, starts = runs.numbered(texts_)
        got = [(int(s), int(e - s), int(q)) for s, e, q in runs.find_runs(symbols, max(map(len, texts_)))]
        assert sorted(got) == sorted((int(at) + s, n_, q) for at, t in zip(starts, texts_) for s, n_, q in plain_runs(t))


def test_collapse_against_plain(spark):
    rows = [(i, t) for i, t in enumerate(periodic_texts(3, 200))] + EDGES
    rows += [(500, "ab cd " * 30 + "é " * 30 + "x y z " * 9), (501, "solo\x0b\x0c\r\n" * 40), (502, "nbsp\u00a0stays " * 12)]
    got = runs.collapse_runs(docs(spark, rows), planted=True).collect()
    assert sorted(map(str, [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got])) == sorted(
        str((i, *plain_collapse(i, t))) for i, t in rows)
    assert all(sha(r.collapsed) == r.collapsed_sha256 for r in got)
    assert sum(r.n_runs > 0 for r in got) > 80
    assert runs.collapse_runs(docs(spark, [])).count() == 0


def test_very_long_runs():
    for words in ([b"z"] * 100_000, [b"a", b"b", b"c"] * 30_000 + [b"a"] * 20_000, ([b"a"] * 400 + [b"b"]) * 100):
        symbols, _ = runs.numbered([words])
        found = runs.find_runs(symbols, len(words))
        top = found[np.argmax(found[:, 1] - found[:, 0])]
        assert top.tolist() in ([0, 100_000, 1], [0, 90_001, 3], [0, 40_100, 401])


def test_registered_queries_against_plain(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in queries.op13_periodic_runs(spark, SF).collect()}
    few = [(i, t) for i, t in rows if len(t or "") < 6000]
    assert {i: got[i] for i, _ in few} == {i: plain_collapse(i, t) for i, t in few}
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.n_paragraphs) for r in queries.op11_document_fingerprints(spark, SF).collect()}
    assert got == plain_fingerprints(rows)
    rows = [tuple(r) for r in common.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op12_prefix_trie(spark, SF).collect()), key=str) == plain_trie(rows, True)
