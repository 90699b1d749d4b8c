"""The text operators against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import os
import random
import re
import sys
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import reference as plain  # noqa: E402

from shelfcast.llm import ann, bpe, common, decontam, langid, license, linededup, quality, simhash, substring, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, score string, ids string, fp string, row string, line string, occ string, sha string"


def docs(spark, rows, lang="en"):
    """Documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, *["x"] * 7) for i, t in rows], DOC).repartition(3)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "?!"), (5, "one"), (None, "no id here at all"), (None, None), (6, "twice told tale"), (6, "twice told tale"), (7, "a" * 3000)]


# ---- language ID

def test_ppm_code_lengths_are_exact():
    rng = random.Random(1)
    train = [bytes(rng.choice(b"abcde ") for _ in range(n)) for n in (400, 7, 90)]
    g = np.concatenate([langid.grams(np.frombuffer(langid.fold(t.decode()), np.uint8)) for t in train])
    keys, n = np.unique(g, return_counts=True)
    scorer = langid.Scorer(["x"], [keys], [n.astype(float)])
    texts = ["abcde abc", "zzz", "a", "xaby" * 40, "déjà abba", "e" * 700]
    got = scorer.lengths(texts)[:, 0]
    # plain counts of several texts: each starts after its own zero bytes
    joined = {}
    for t in train:
        data = bytes(langid.ORDER) + t
        for i in range(langid.ORDER, len(data)):
            for k in range(langid.ORDER + 1):
                joined.setdefault(data[i - k:i], {}).setdefault(data[i], 0)
                joined[data[i - k:i]][data[i]] += 1
    want = [_bits(joined, t.encode()) for t in texts]
    assert got == pytest.approx(want)
    assert plain.ppm_bits(b"abab", b"ab", 2) > 0


def _bits(counts, text):
    import math
    bits, data = 0.0, bytes(langid.ORDER) + text
    for i in range(langid.ORDER, len(data)):
        out = set()
        for k in range(langid.ORDER, -1, -1):
            here = counts.get(data[i - k:i])
            if here is None:
                continue
            left = {s: n for s, n in here.items() if s not in out}
            total = sum(left.values()) + len(left)
            if data[i] in left:
                bits += math.log2(total / left[data[i]])
                break
            if left:
                bits += math.log2(total / len(left))
            out |= set(here)
        else:
            bits += math.log2(256 - len(out))
    return bits


def test_pieces_of_the_scorer_do_not_matter(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    keys, n = np.unique(langid.grams(np.frombuffer(langid.fold("abcab é abc"), np.uint8)), return_counts=True)
    whole = langid.Scorer(["x"], [keys], [n.astype(float)]).lengths(texts)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert langid.Scorer(["x"], [keys], [n.astype(float)]).lengths(texts) == pytest.approx(whole)


def test_language_of_held_out_rows(spark):
    table = common.table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(table.filter(~langid.held_out("doc_id")))
    told = langid.identify(table, model).join(table.filter(langid.held_out("doc_id")).select("doc_id", "lang"), "doc_id").toPandas()
    assert len(told) > 150 and (told.lang == told.lang_pred).mean() > 0.97
    assert told.score.between(0, 1).all()


def test_every_language_keeps_a_text(spark):
    rng = random.Random(24)
    table = docs(spark, [(i, prose(rng, 500)) for i in range(5)], "aa").unionByName(docs(spark, [(i, prose(rng, 5)) for i in range(5, 40)], "bb"))
    assert [lang for lang, _, _ in langid.train(table, train_bytes=1)] == ["aa", "bb"]


def test_language_edges(spark):
    english = docs(spark, [(i, "the cat and the dog") for i in range(20)])
    french = docs(spark, [(i, "le chat et le chien") for i in range(20, 40)], "fr")
    model = langid.train(english.unionByName(french))
    assert [m[0] for m in model] == ["en", "fr"]
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs(spark, [*EDGES, (8, "the dog"), (9, "le chien")]), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und"), (None, "und"), (8, "en"), (9, "fr")} <= got
    assert langid.identify(docs(spark, EDGES), model).count() == len(EDGES)
    assert langid.train(docs(spark, EDGES, None)) == []
    assert {r.lang_pred for r in langid.identify(docs(spark, EDGES), []).collect()} == {"und"}
    assert langid.identify(docs(spark, []), model).count() == 0
    kept = langid.keep_known(docs(spark, [*EDGES, (8, "the dog")]), model)
    assert kept.columns == docs(spark, []).columns and 8 in {r.doc_id for r in kept.collect()} and 1 not in {r.doc_id for r in kept.collect()}


# ---- byte-level BPE

HOW = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(HOW[0], "rb"))}
    return tiktoken.Encoding("own", pat_str=HOW[1], mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_the_library(library):
    e, rng = bpe.Encoder(bpe.read_ranks(HOW[0]), HOW[1]), random.Random(3)
    letters = "ab c\n\t é'sd1.!ñ中 \x1c\x85  🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(800)]
    texts += ["", " ", "  ", "a ", " a", "a" * 5000, " " * 3000, "ab" * 2000 + "\n \n x", "I'll don't 'S"]
    for text, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert bpe.unpack(ids, e.tokens) == text.encode()


def test_memo_of_pieces_stays_small_and_right(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    e, rng = bpe.Encoder(bpe.read_ranks(HOW[0]), HOW[1]), random.Random(4)
    for _ in range(20):
        texts = [prose(rng, 30) for _ in range(5)]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [library.encode_ordinary(t) for t in texts]
        assert len(e.words.new) <= 50 + 150


def test_bpe_table(spark, library):
    rows = [*EDGES, (8, "naïve café " * 3000)]
    out = bpe.decode(bpe.encode(docs(spark, rows), *HOW, keep=("doc_id", "score")), *HOW).collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded).decode()) for r in out) == sorted((i or -1, t or "") for i, t in rows)
    assert {r.n_tokens for r in out if r.doc_id == 8} == {len(library.encode_ordinary("naïve café " * 3000))}
    assert bpe.encode(docs(spark, []), *HOW).count() == 0


# ---- decontamination

def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(30))] for _ in range(2))
        assert decontam.common_subsequence(a, b) == plain.common(a, b)


def test_contaminations_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, n, 4000).capitalize() + ". " + prose(rng, 5, 4000)) for i, n in enumerate([15, 20, 30, 45, 60, 25, 40])]
    rows = [(i, prose(rng, rng.randrange(20, 400), 4000)) for i in range(40)]
    held = set()
    for k, (i, t) in enumerate(rows[:20]):
        item = items[k % len(items)]
        words = item[1].split()
        if k % 3 == 1:  # every ninth word replaced: still 0.8 in order
            words = [w if j % 9 else "other" for j, w in enumerate(words)]
        if k % 3 == 2:  # every fourth word but not the answer's: a paraphrase
            words = [w if j % 4 or j >= len(words) - 5 else "other" for j, w in enumerate(words)]
        at = rng.randrange(len(t.split()))
        rows[k] = (i, " ".join([*t.split()[:at], *words, *t.split()[at:]]))
        held.add((i, item[0]))
    bench = spark.createDataFrame([(i, t, "x") for i, t in [*items, (90, None), (91, ""), (92, "w1 w2")]], "item_id long, text string, doc_id string")
    found = decontam.contaminations(docs(spark, [*rows, *EDGES]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == held
    for r in found:
        item = [w.strip(".").lower() for w in items[r.item_id][1].split()]
        assert r.common <= plain.common(item, dict(rows)[r.doc_id].replace(".", "").lower().split()) / len(item) + 1e-9
    clean = decontam.without_benchmark(docs(spark, [*rows, *EDGES]), bench)
    assert clean.count() == len(rows) + len(EDGES) - 20 and clean.columns == docs(spark, []).columns
    assert decontam.contaminations(docs(spark, []), bench).count() == 0
    assert decontam.contaminations(docs(spark, rows), bench.limit(0)).count() == 0


def test_short_items_at_the_limits_are_found(spark):
    rng = random.Random(23)
    items, rows, held = [], [(i, prose(rng, 200, 20_000)) for i in range(1000, 1100)], set()
    for i, n in enumerate([8, 10, 12, 15, 17, 19, 30, 45] * 3):
        words = prose(rng, n, 20_000).split()
        items.append((i, " ".join(words), " ".join(words[-3:])))
        most = [n - -(-4 * n // 5), n - -(-3 * n // 5)]
        for k, lost in enumerate(most):  # a copy at 0.8, a paraphrase at 0.6 with the whole answer
            gone = set(rng.sample(range(n - 3), min(lost, n - 3)))
            text = [f"x{rng.randrange(20_000)}" if j in gone else w for j, w in enumerate(words)]
            host = prose(rng, 120, 20_000).split()
            at = rng.randrange(120)
            rows.append((2 * i + k, " ".join([*host[:at], *text, *host[at:]])))
            held.add((2 * i + k, i))
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    found = decontam.contaminations(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == held


def test_weights_of_other_words_are_their_own(spark):
    space = decontam.frequencies(docs(spark, [(i, f"often rare{i}") for i in range(50)]), docs(spark, [(0, "an item")]))
    often, rare = (int(decontam.Terms([w]).bucket[0]) for w in ("often", "rare7"))
    assert space.idf[often] == space.idf[rare] == 0
    assert space.other[often] < 0.01 and space.other[rare] == pytest.approx(np.log(51 / 2))


def test_latent_space_is_that_of_the_svd(spark):
    rng = random.Random(7)
    items = docs(spark, [(i, prose(rng, 30, 60)) for i in range(50)])
    space = decontam.frequencies(docs(spark, [(i, prose(rng, 60, 90)) for i in range(30)]), items)
    decontam.fit(items, space)
    rows = [r.text for r in items.collect()]
    words = decontam.Terms(rows)
    lo, hi = decontam.passages(words.first)
    which, term, weight, norm = space.rows(words.bucket, lo, hi)
    a = np.zeros((len(lo), int((space.idf > 0).sum())))
    a[which, term] = weight / norm[which]
    rank = min(space.basis.shape[1], np.linalg.matrix_rank(a))
    best = np.linalg.svd(a)[1][:rank]
    assert np.linalg.norm(a @ space.basis) >= 0.98 * np.linalg.norm(best)


# ---- substring dedup

def test_equal_windows_have_equal_anchors():
    rng = random.Random(8)
    shared = prose(rng, 90, 20).split()
    texts = [" ".join([*prose(rng, rng.randrange(40), 20).split(), *shared, *prose(rng, rng.randrange(40), 20).split()]) for _ in range(30)]
    words = substring.Words([t.encode() for t in texts])
    at, anchor, own = substring.anchors(words, 50)
    by = {}
    for a, h in zip(anchor.tolist(), own.tolist()):
        assert by.setdefault(h, a) == a
    assert len(set(own.tolist())) < len(own)


@pytest.mark.parametrize("many", [substring.MANY, 2])
def test_substring_against_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(substring, "MANY", many)
    rng = random.Random(9)
    passage = [prose(rng, n, 50) for n in (49, 50, 51, 120)]
    rows = [(i, " ".join([prose(rng, rng.randrange(60)), rng.choice(passage), prose(rng, rng.randrange(60)), rng.choice(passage)])) for i in range(60)]
    rows += [(100 + i, "same " * n) for i, n in enumerate((49, 50, 51, 70, 300))] + [(200, "a b " * 80), (201, "b a " * 80), (202, rows[3][1]), (203, "é ß " * 60), (204, "é ß " * 60)]
    rows += [(300, "x y z " * 40), (300, "x y z " * 40), (301, prose(rng, 80)), (301, rows[5][1])] + [r for r in EDGES]
    got = sorted(substring.remove_repeats(docs(spark, rows)).collect(), key=str)
    assert [tuple(r) for r in got] == sorted(plain.substring(rows, 50), key=lambda r: str(substring_row(r)))
    assert substring.remove_repeats(docs(spark, [])).count() == 0


def substring_row(r):
    from pyspark.sql import Row
    return Row(doc_id=r[0], n_words=r[1], n_removed=r[2], kept=r[3])


# ---- nearest neighbours

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, query_id string, leaf int").repartition(3)


def test_small_leaves_still_give_k_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((200, 6)).astype(np.float32)
    rows[:150] = rows[0] + rows[:150] / 1000  # a tight cluster and outliers
    monkeypatch.setattr(ann, "LEAF_ROWS", 4)
    monkeypatch.setattr(ann, "calibrate", lambda *a, **b: (1, 1.0))
    got = ann.search(vectors(spark, list(enumerate(rows.tolist()))), every=10, k=20).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {q: 20 for q in range(0, 200, 10)}


def test_nearest_equals_brute_force_when_every_leaf_is_visited(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((300, 8)).astype(np.float32)
    rows[100:180] = rows[100]  # ties
    monkeypatch.setattr(ann, "TARGET", 1.0)
    monkeypatch.setattr(ann, "LEAF_ROWS", 30)
    ids = list(range(300))
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0] * 7 + [None]), (1080, [1.0, 2.0]), (None, [1.0] * 8), (1100, [])]
    table = vectors(spark, [*zip(ids, rows.tolist()), (20, rows[20].tolist()), *bad])
    got = ann.search(table, every=20, k=20).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(rows[r.query_id].astype(float) @ rows[r.vec_id].astype(float)), rel=1e-12)
    want = plain.nearest(ids, rows, 20, 20)
    assert set(by) == set(want)
    hit = [len(set(by[q]) & set(want[q])) / 20 for q in want]
    assert np.mean(hit) >= 0.99
    ties = [q for q in want if set(want[q]) <= set(range(100, 180))]
    assert all(by[q] == want[q] for q in ties)


def test_nearest_recall_and_few_rows(spark):
    table = common.table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = table.orderBy("vec_id").toPandas()
    want = plain.nearest(rows.vec_id.tolist(), np.stack(rows.embedding), 20, 20)
    got = ann.search(table).groupBy("query_id").agg({"vec_id": "collect_list"}).collect()
    assert np.mean([len(set(r[1]) & set(want[r[0]])) / 20 for r in got]) >= 0.9
    few = ann.search(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]), every=20, k=20).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in sorted(few, key=lambda r: r.rank)] == [(0, 2, 1.0), (0, 1, 0.0)]
    assert ann.search(vectors(spark, [])).count() == 0
    assert ann.search(vectors(spark, [(0, [1.0])])).count() == 0


# ---- WARC

def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ x\n%", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (9, "u", "<p>é</p>"), (9, "u", "<p>é</p>"),
            (None, "u", "only here"), (None, "u", "<p>é</p>"), (5, "u", "long " * 200_000)]
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, sha string, last long").repartition(2)
    for least, kinds in ((0, {(1, "revisit", 9), (2, "revisit", 9), (3, "revisit", 4), (4, "response", None), (9, "response", None), (None, "response", None), (None, "revisit", 9), (5, "response", None)}),
                         (1, {(1, "revisit", 9), (2, "revisit", 9), (3, "response", None), (4, "response", None), (9, "response", None), (None, "response", None), (None, "revisit", 9), (5, "response", None)})):
        got = warc.round_trip(pages, least).collect()
        assert len(got) == len(rows)
        assert {(r.page_id, r.record_type, r.refers_to) for r in got} == kinds
        said = {(r.page_id, r.payload_bytes, r.payload_digest) for r in got}
        assert said == {(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in rows}
        assert all(bytes(r.payload).decode() in {h or "" for i, _, h in rows if i == r.page_id} for r in got if r.record_type == "response")
    assert warc.round_trip(pages.limit(0)).count() == 0
    folder = str(tmp_path / "archives")
    manifest = warc.write_archives(pages, folder, archive_bytes=1)
    assert manifest.count() == len(rows) and warc.read_archives(manifest, folder).count() == len(rows)


def test_damaged_archives():
    good = warc.record(1, "u", b"payload", None)
    data = b"".join([good, warc.record(2, None, b"x", 1)])
    read = lambda blob: [warc.parse(d, o) for o, d in warc.members(io.BytesIO(blob).read)]
    assert [p for _, _, p in read(data)] == [b"payload", b""]
    assert [o for o, _ in warc.members(io.BytesIO(data).read)] == [0, len(good)]
    plain_record = zlib.decompress(good, 31)
    for bad in (plain_record.replace(b"payload\r", b"paylaod\r"), plain_record[:-3], plain_record.replace(b"WARC/1.1", b"PARC/1.1"), plain_record.replace(b"Length: 7", b"Length: 8")):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(warc.Damaged):
            read(z.compress(bad) + z.flush())
    with pytest.raises(warc.Damaged):
        read(data[:-5])


# ---- licences

def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    rows = [(1, "Some text | a table\nReleased under the MIT License."), (2, "Licensed under CC BY-NC 4.0. And more.\nLicensed under the Apache License, Version 2.0."),
            (3, mit), (4, "The licence of the poem. MIT"), (5, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
            (8, "word " * 50_000 + ".\nReleased under the MIT License.\n"), *[(100 + k, t) for k, (_, t) in enumerate(EDGES)], (6, "twice"), (6, "twice")]
    got = {r.doc_id: r for r in license.scan(docs(spark, rows)).collect()}
    assert got[1].licences == ["MIT"] and got[2].licences == ["Apache-2.0", "CC-BY-NC-4.0"] and got[8].licences == ["MIT"]
    assert got[3].licences == [] and got[3].left_over == ["Permission", "MitNotice"]
    assert got[4].licences == [] and got[5].licences == ["GPL-3.0-or-later"]
    assert license.scan(docs(spark, rows)).count() == len(rows) and license.scan(docs(spark, [])).count() == 0


def test_longer_rules_use_up_their_sentences(spark):
    text = ". ".join(license.SENTENCES[n][0] for n in ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "GplFree", "Proprietary"))
    r = license.scan(docs(spark, [(1, text + ".")])).first()
    assert r.licences == ["BSD-3-Clause", "Proprietary"] and r.left_over == ["GplFree"]


GPL_2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
MPL_2 = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."


def test_standard_notices_at_any_line_width(spark):
    notices = {"GPL-2.0-or-later": [GPL_2, HOPE], "GPL-3.0-or-later": [GPL_2.replace("version 2", "version 3").replace("Foundation;", "Foundation,")],
               "MIT": [MIT_GRANT, MIT_NOTICE, MIT_AS_IS], "MPL-2.0": [MPL_2], "Apache-2.0": [APACHE]}
    rows, want = [], {}
    for name, paragraphs in notices.items():
        for width in [*range(20, 120, 3), 10_000]:
            for mark in ("", "# ", " * "):
                lines = [x for p in paragraphs for x in [*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), ""]]
                want[len(rows)] = [name]
                rows.append((len(rows), "Copyright of a heading\n\n" + "\n".join(mark + x if x else x for x in lines)))
    got = {r.doc_id: r for r in license.scan(docs(spark, rows)).collect()}
    assert {i: r.licences for i, r in got.items()} == want
    assert all(r.left_over == [] or want[i] == ["Apache-2.0"] for i, r in got.items())


# ---- SimHash

def test_simhash_against_brute_force(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randrange(1, 80), 2000)) for i in range(60)]
    for i in range(60, 120):
        words = rows[rng.randrange(60)][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words).upper()))
    rows += [(500, "A b É c"), (501, "a b É c"), *[(600 + i, t) for i, t in EDGES if i is not None]]
    got = simhash.simhash_components(docs(spark, rows)).collect()
    fps = {i: plain.simhash(t) for i, t in rows}
    part = plain.components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == sorted((i, fps[i], part[i]) for i, _ in rows)
    assert len(set(part.values())) < len(part)
    kept = simhash.keep_one(docs(spark, rows + [(None, "q")]))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _ in rows if part[i] == i)
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_split_groups_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT_ROWS", 8)
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(60)})
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    frame = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, rep long")
    got = {r.node: r.component for r in common.connected_components(simhash.near_pairs(frame)).collect()}
    want = plain.components(list(range(len(fps))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert [got.get(i, i) for i in range(len(fps))] == [want[i] for i in range(len(fps))]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 540)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 500 for i in range(500, 540)}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_more_licences_are_known(spark):
    texts = {
        "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
        "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "MIT": "# SPDX-License-Identifier: MIT\n\nimport os",
        "ISC": "ISC License\n\nCopyright (c) 2020, Somebody",
        "Unlicense": "This is free and unencumbered software released into the public domain.",
        "Zlib": "This software is provided 'as-is', without any express or implied warranty.  In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
        "CC0-1.0": "This work is licensed under CC0 1.0.",
        "Artistic-2.0": "Released under the Artistic License 2.0.",
    }
    rows = list(enumerate(texts.values()))
    got = {r.doc_id: r.licences for r in license.scan(docs(spark, rows)).collect()}
    assert {name: got[i] for i, name in enumerate(texts)} == {name: [name] for name in texts}


# ---- line dedup

def test_line_dedup_against_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    lines = [prose(rng, rng.randrange(1, 40), 500) for _ in range(25)]
    rows = []
    for i in range(50):
        own = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(lines).split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = f"w{rng.randrange(500)}"
            own.append(rng.choice([" ".join(words), " ".join(words).upper() + "!!", "---", "", prose(rng, 12, 500)]))
        rows.append((i, "\n".join(own)))
    rows += [(60, None), (61, ""), (62, " \n\n"), (63, rows[4][1]), (64, "z " * 70_000)]
    table = docs(spark, rows)
    words = table.select(F.explode(F.split(linededup.normalised(F.regexp_replace("text", "\n", " ")), " ")).alias("w")).distinct().select("w", F.xxhash64("w").alias("h"))
    hashes = {r.w: r.h % 2**64 for r in words.collect()}
    got = {r.doc_id: r for r in linededup.dedup_lines(table).collect()}
    want = plain.dedup_lines(rows, hashes)
    assert [got[i].text for i, _ in rows] == want
    assert sum(r._gone for r in got.values()) > 15


def test_line_dedup_edges(spark):
    got = linededup.dedup_lines(docs(spark, [*EDGES, (None, "twice told tale")])).collect()
    assert len(got) == len(EDGES) + 1
    assert [r.text for r in got if r.doc_id == 6] == ["twice told tale"] * 2
    assert sorted(r.text for r in got if r.doc_id is None and r.text is not None) == ["", "no id here at all"]
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def test_lines_at_the_limits_are_found(spark, monkeypatch):
    """Lines near both limits, bits and edits, with files split at every size; against all pairs."""
    from pyspark.sql import functions as F

    rng = random.Random(22)
    lines = []
    for n in (1, 4, 5, 6, 10, 15, 30, 60, 200):
        for _ in range(8):
            words = prose(rng, n, 5000).split()
            other = list(words)
            for i in sorted(rng.sample(range(n), min(n, rng.choice([1, 1, 2, n // 5 + 1]))), reverse=True):
                other[i:i + 1] = rng.choice([["new"], [], [words[i], "more"]])
            lines += [" ".join(words), " ".join(other), " ".join(sorted(words))]
    table = docs(spark, list(enumerate(lines)))
    words = sorted({w for x in lines for w in x.split()})
    hashes = {r.w: r.h % 2**64 for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    first = {}
    for i, x in enumerate(lines):
        if x:
            first.setdefault(x, i)
    prints = {x: plain.line_simhash(x, hashes) for x in first}

    def linked(a, b):
        x, y = a.split(" "), b.split(" ")
        return (prints[a] ^ prints[b]).bit_count() <= linededup.BITS and plain.edits(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9)

    part = plain.components(sorted(first), linked)
    want = {first[x]: first[part[x]] for x in first}
    assert sum(a != b for a, b in want.items()) > 10
    for split in (1, 2000):
        monkeypatch.setattr(linededup, "SPLIT_ROWS", split)
        got = linededup.line_groups(linededup.lines_of(linededup.with_row(table))).collect()
        own = {r.occ.doc_id: r.component for r in got}
        assert {(i, j) for i in own for j in own if own[i] == own[j]} == {(i, j) for i in want for j in want if want[i] == want[j]}


def test_line_dedup_with_columns_of_its_own_names(spark):
    table = docs(spark, [(1, "the same line here\nother one"), (2, "The same line here!")]).withColumnsRenamed(
        {"lang": "_lines", "score": "_gone", "ids": "_at", "fp": "_key", "occ": "__key"})
    got = {r.doc_id: r for r in linededup.dedup_lines(table).collect()}
    assert [got[i].text for i in (1, 2)] == ["the same line here\nother one", ""]
    assert [(got[i]["_lines"], got[i]["_gone"], got[i]["_at"], got[i]["_key"]) for i in (1, 2)] == [("en", "x", "x", "x")] * 2
    assert [(got[i]["__lines"], got[i]["__gone"]) for i in (1, 2)] == [(2, 0), (1, 1)]


# ---- quality

def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.7
    acc = np.array([[0.9, 0.8], [0.7, 0.95], [0.85, 0.85], [0.6, 0.9]])
    right = rng.random((len(truth), 4)) < np.where(truth[:, None], acc[:, 1], acc[:, 0])
    votes = np.where(right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, found = quality.fit_labellers(patterns, counts.astype(float))
    assert share == pytest.approx(0.7, abs=0.04) and np.abs(found - acc).max() < 0.05


def test_quality_agrees_with_hand_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.classify(common.table(spark, sf, "documents")).join(common.table(spark, sf, "labels"), "doc_id").toPandas()
    assert (got.good == (got.quality == 1)).mean() > 0.95
    assert got[got.quality == 1].good.mean() > 0.97


def test_quality_against_plain_loops(spark):
    """Label model, posterior, trigram shares and scorer of small documents, step by step."""
    import math

    from pyspark.sql import functions as F

    rng = random.Random(31)
    words = quality.STOP_WORDS
    rows = [(i, rng.choice([" ".join(rng.choice(words + [f"lore{rng.randrange(90)}"] * 40) for _ in range(rng.randrange(1, 90))), "?! " * rng.randrange(20), "AA BB " * rng.randrange(1, 30), None]))
            for i in range(60)]
    table = docs(spark, rows)
    got = {r.doc_id: r for r in quality.classify(table).collect()}
    text = F.coalesce("text", F.lit(""))
    voted = {r[0]: list(r[1:]) for r in table.select("doc_id", *[v.cast("int") for v in quality.votes(text).values()]).collect()}
    share, acc = 0.5, [[0.8, 0.8] for _ in range(9)]

    def good(v):
        odds = math.log(share / (1 - share))
        for x, (bad_right, good_right) in zip(v, acc):
            if x == 1:
                odds += math.log(good_right / (1 - bad_right))
            elif x == 0:
                odds += math.log((1 - good_right) / bad_right)
        return 1 / (1 + math.exp(-odds))

    for _ in range(200):
        p = {i: good(v) for i, v in voted.items()}
        new = [[(sum((p[i] if c else 1 - p[i]) for i, v in voted.items() if v[j] == c) + 8) / (sum((p[i] if c else 1 - p[i]) for i, v in voted.items() if v[j] >= 0) + 10)
                for c in (0, 1)] for j in range(9)]
        last, share = share, (sum(p.values()) + 1) / (len(p) + 2)
        done = abs(share - last) < 1e-10 and max(abs(a - b) for x, y in zip(new, acc) for a, b in zip(x, y)) < 1e-10
        acc = new
        if done:
            break
    label = {i: good(v) for i, v in voted.items()}
    assert {i: r.weak_label for i, r in got.items()} == pytest.approx(label, abs=1e-9)

    def shares(t):
        data, out = b" " + (t or "").encode() + b" ", [0.0] * quality.BUCKETS
        for k in range(len(data) - 2):
            g = data[k] << 16 | data[k + 1] << 8 | data[k + 2]
            out[int(common.mix(np.array([g], np.uint64))[0] % np.uint64(quality.BUCKETS))] += 1
        return [x / max(sum(out), 1) for x in out]

    own = {i: shares(t) for i, t in rows}
    used = sorted({k for x in own.values() for k, v in enumerate(x) if v})
    mean = {k: sum(x[k] for x in own.values()) / len(rows) for k in used}
    scale = {k: math.sqrt(sum((x[k] - mean[k]) ** 2 for x in own.values()) / len(rows)) + 1e-4 for k in used}
    z = {i: {k: (x[k] - mean[k]) / scale[k] for k in used} for i, x in own.items()}
    step = 0.5 / max(1.0, sum(v * v for x in z.values() for v in x.values()) / len(rows) / 4)
    w, vw, b, vb = dict.fromkeys(used, 0.0), dict.fromkeys(used, 0.0), 0.0, 0.0
    for _ in range(300):
        gap = {i: label[i] - 1 / (1 + math.exp(-max(-30, min(30, sum(w[k] * x[k] for k in used) + b)))) for i, x in z.items()}
        vw = {k: 0.9 * vw[k] + sum(gap[i] * z[i][k] for i in z) / len(rows) - 1e-3 * w[k] for k in used}
        vb = 0.9 * vb + sum(gap.values()) / len(rows)
        w, b = {k: w[k] + step * vw[k] for k in used}, b + step * vb
    want = {i: 1 / (1 + math.exp(-(sum(w[k] * x[k] for k in used) + b))) for i, x in z.items()}
    assert {i: r.score for i, r in got.items()} == pytest.approx(want, abs=2e-4)  # the operator fits in single precision


def test_quality_edges(spark):
    got = quality.classify(docs(spark, [*EDGES, (8, "word " * 30_000)])).collect()
    assert len(got) == len(EDGES) + 1 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(docs(spark, [])).count() == 0


def test_lines_code_is_compiled_and_files_are_shuffled_once(spark, monkeypatch):
    """The JVM leaves methods of over 8000 bytes to its interpreter; a line's SimHash was one of 18 thousand.  The rows of the files were shuffled for each side."""
    plans, keep = {}, linededup.stage

    def seen(df, name, free=False):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain("codegen" if name == "distinct-lines" else "simple")
        plans.setdefault(name, []).append(out.getvalue())
        return keep(df, name, free)

    for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        before = spark.conf.get(k)
        spark.conf.set(k, v)
        monkeypatch.setattr(linededup, "stage", seen)
        plans[k] = before
    try:
        text = "\n".join(f"{i} one two three four five six seven {i % 3}" for i in range(9))
        rows = linededup.line_groups(linededup.lines_of(linededup.with_row(docs(spark, [(1, text), (2, text), (3, None)])))).collect()
    finally:
        for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.set(k, plans.pop(k))
    assert len(rows) == 9 and {r.copies for r in rows} == {2}
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", plans["distinct-lines"][0])]
    assert sizes and max(sizes) < 8000
    assert "ReusedExchange" in plans["line-pairs"][1]


def test_rows_of_ids_are_found_without_shuffling_the_others(spark, monkeypatch):
    from pyspark.sql import functions as F

    lines = spark.range(2000).select("id", F.concat(F.lit("line "), F.col("id")).alias("line"))
    ids = spark.createDataFrame([(i,) for i in (0, 7, 63, 64, 1999, 5000)], "id long")
    for words in (1 << 19, 1):  # one word: most bits are set
        monkeypatch.setattr(linededup, "WORDS", words)
        assert sorted(r.id for r in linededup.of_ids(lines, ids).collect()) == [0, 7, 63, 64, 1999]
    assert linededup.of_ids(lines, ids.limit(0)).count() == 0
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as out:
            linededup.of_ids(lines, ids).explain()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert out.getvalue().index("SortMergeJoin") < out.getvalue().index("BroadcastHashJoin")  # the bits are looked up below the shuffle


def test_lines_of_many_copies_keep_their_simhash(spark, monkeypatch):
    """The bits of all copies are added up; a line whose copies have too many words for the counters is hashed alone."""
    lines = linededup.numbered(linededup.lines_of(linededup.with_row(docs(spark, [(i, "one two three four five six seven eight nine\nonce told") for i in range(40)]))))
    want = sorted((r.copies, r.n, r.simhash) for r in linededup.distinct_lines(lines).collect())
    assert [x[:2] for x in want] == [(40, 2), (40, 9)]
    alone = linededup.numbered(linededup.lines_of(linededup.with_row(docs(spark, [(0, "one two three four five six seven eight nine\nonce told")]))))
    assert sorted((r.n, r.simhash) for r in linededup.distinct_lines(alone).collect()) == [x[1:] for x in want]
    hashed = []
    monkeypatch.setattr(linededup, "hashed", lambda rows, f=linededup.hashed: hashed.append(rows) or f(rows))
    for most in (81, 1):
        monkeypatch.setattr(linededup, "MOST_WORDS", most)
        hashed.clear()
        assert sorted((r.copies, r.n, r.simhash) for r in linededup.distinct_lines(lines).collect()) == want
        assert len(hashed) == 2 and hashed[1].count() == (1 if most == 81 else 2)


def test_lines_have_as_many_files_however_many_there_are(spark):
    """Files of common bits were split from 2000 lines on: rows grew 111 times as the lines grew five times.  Every line is under ten pairs of blocks now, and a pair is found in one of them."""
    from itertools import combinations

    from pyspark.sql import functions as F

    assert sum(linededup.BLOCKS) == 2**64 - 1 and all(not a & b for a, b in combinations(linededup.BLOCKS, 2))
    # 6000 lines that agree in the lowest 16 bits, and in no other
    lines = spark.range(6000).select("id", F.lit(9).alias("n"), F.lit(1).cast("long").alias("copies"), F.xxhash64("id").bitwiseAND(~0xFFFF).alias("simhash"))
    busy = linededup.busy_files(lines)
    assert len(busy) == 1 and not busy[0].filter("large").count()
    rows = linededup.files(lines, [], busy)
    assert rows.count() == 60_000
    rng = random.Random(5)
    pairs = []
    for i in range(200):
        x = rng.getrandbits(64)
        pairs.append((i, linededup._signed(x), linededup._signed(x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))))
    both = spark.createDataFrame(pairs, "id long, x long, y long").select("id", "x", "y", F.explode(F.array(*linededup._longs(linededup.PAIRS))).alias("mask"))
    agree = F.col("x").bitwiseXOR(F.col("y")).bitwiseAND(F.col("mask")) == 0
    found = both.filter(agree & linededup.first_shared("x", "y", F.col("mask"))).groupBy("id").count().collect()
    assert len(found) == 200 and {r["count"] for r in found} == {1}


def test_lines_of_busy_files_are_not_listed(spark, monkeypatch):
    """All rows of files of many lines, up to ten a line, were gathered to compare them with the head; now only lines near it are."""
    rng = random.Random(41)
    near = prose(rng, 60, 5000).split()
    lines = [" ".join(near)] * 3 + [" ".join(near[:i] + ["other"] + near[i + 1:]) for i in range(60)] + [prose(rng, 20, 5000) for _ in range(40)]
    table = docs(spark, list(enumerate(lines)))
    made, keep = [], linededup.of_ids

    def seen(*args):
        made.append((out := keep(*args)).count())
        return out

    monkeypatch.setattr(linededup, "of_ids", seen)
    for rows, most in ((2, 1 << 17), (2, 0), (64, 1 << 17)):  # heads sent to every task, or shuffled
        monkeypatch.setattr(linededup, "HEAD_ROWS", rows)
        monkeypatch.setattr(linededup, "HEADS", most)
        made.clear()
        got = linededup.line_groups(linededup.lines_of(linededup.with_row(table))).collect()
        assert max(made) <= len(set(lines)) == len(got)
        part = {r.occ.doc_id: r.component for r in got}
        assert len({part[i] for i in part if i < 63}) < 10 and len({part[i] for i in part if i >= 63}) == 40
    # the head is the line of the most copies
    once = linededup.distinct_lines(linededup.numbered(linededup.lines_of(linededup.with_row(table))))
    monkeypatch.setattr(linededup, "HEAD_ROWS", 2)
    first = once.filter("copies = 3").first()
    head = linededup.heads(once, linededup.busy_files(once)).collect()
    own = [r for r in head if (r.simhash_h ^ first.simhash) & r.mask == 0]
    assert own and {(r.id_h, r.n_h, r.simhash_h) for r in own} == {(first.id, 60, first.simhash)}


def test_normalised_lines(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    marks = list("aZ09 \t-_,.[]&^\u00e9\u00c9\u00df\u0130\u0663\u00bd\u4e2d\u0301\u200b\U0001d400\U0001f600")
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randrange(30)))) for i in range(300)]
    plainly = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    assert docs(spark, rows).filter(linededup.normalised(F.col("text")) != plainly).count() == 0


def test_removed_lines_are_normalised_once(spark, monkeypatch):
    """Lines were normalised twice, once for the groups and once for the lines that go."""
    calls, keep = [], linededup.lines_of
    monkeypatch.setattr(linededup, "lines_of", lambda rows: calls.append(keep(rows)) or calls[-1])
    plans, write = {}, linededup.stage

    def seen(df, name, free=False):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        plans.setdefault(name, []).append(out.getvalue())
        return write(df, name, free)

    monkeypatch.setattr(linededup, "stage", seen)
    got = linededup.removed_lines(docs(spark, [(1, "a line of five words\nother"), (2, "A line, of five words!")])).collect()
    assert [(r.doc_id, r.gone) for r in got] == [(2, [0])]
    assert [name for name, x in plans.items() if any("regexp_replace" in p for p in x)] == ["lines"]


def test_a_worker_frees_a_model_that_refers_to_itself(spark):
    """An encoder's memos refer to the encoder; it stayed in memory under the next operator's model."""
    import weakref

    class Model:
        def __init__(self):
            self.own = self.__init__

    gone = weakref.ref(common.held("first", Model))
    assert gone() is not None
    common.held("second", Model)
    assert gone() is None
    common.let_go()
    assert list(common._held) == [""]


def test_few_rows_at_a_time_and_nothing_kept():
    import pyarrow as pa

    before = pa.total_allocated_bytes()
    batches = (pa.RecordBatch.from_arrays([pa.array(range(n * 7, n * 7 + 7))], ["x"]) for n in range(3))
    got = [b.column(0).to_pylist() for b in common.few(batches, 3)]
    assert [x for g in got for x in g] == list(range(21)) and max(map(len, got)) == 3
    assert pa.total_allocated_bytes() == before
