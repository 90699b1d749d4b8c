"""The corpus pipeline against plain versions of its stages, and the registered queries against their SQL."""

from __future__ import annotations

import os
import random
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import reference as plain  # noqa: E402

import corpus_pipeline  # noqa: E402
from shelfcast.llm import langid, linededup, queries  # noqa: E402
from test_text_operators import prose  # noqa: E402


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    item = prose(rng, 30, 3000)
    rows = [(i, "\n".join(prose(rng, rng.randrange(6, 30), 3000) for _ in range(rng.randrange(1, 5)))) for i in range(40)]
    rows += [(40, rows[3][1]), (41, rows[5][1] + "\nextra"), (42, f"{rows[6][1]} {item} tail"), (43, None), (44, "12 34"), (45, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}

    model = langid.train(docs.filter(~langid.held_out("doc_id")))
    known = {r.doc_id for r in langid.identify(docs, model).collect() if r.lang_pred != "und" and r.bits_per_byte < 8}
    assert known == {i for i, _ in rows if i < 43}
    left = [r for r in rows if r[0] in known]
    words = docs.select(F.explode(F.split(linededup.normalised(F.regexp_replace("text", "\n", " ")), " ")).alias("w")).distinct().select("w", F.xxhash64("w").alias("h"))
    texts = dict(zip([i for i, _ in left], plain.dedup_lines(left, {r.w: r.h % 2**64 for r in words.collect()})))
    fps = {i: plain.simhash(t) for i, t in texts.items()}
    part = plain.components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    want = {i: t for i, t in texts.items() if part[i] == i and plain.common(item.split(), t.split()) < 0.6 * 30}
    assert {i: r.decoded for i, r in got.items()} == want
    assert 42 not in got and 40 in texts and all(len(r.ids) == 4 * r.n_tokens for r in got.values())


def test_stages_keep_the_columns_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    empty = docs.limit(0)
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, empty, sf).columns == docs.columns
        assert step(spark, empty, sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.project(", ".join(columns)).fetchall()))
