"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import bpe, decontam, langid, linededup, simhash
from shelfcast.llm.common import stage, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learned from the rows outside the held-out fold; documents whose language it can't tell go."""
    return langid.keep_known(docs, langid.train(docs.filter(~langid.held_out("doc_id"))))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fuzzy line dedup over all documents; every document stays, with the lines that are left and their length."""
    left = linededup.dedup_lines(docs).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group, the document with the smallest id stays."""
    return simhash.keep_one(docs, shingle=3, bits=3)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ``doc_id, lang, source, n_tokens, ids`` and the decoded ids as text."""
    how = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(docs, *how, keep=("doc_id", "lang", "source")), *how)
    return out.withColumn("decoded", F.decode("decoded", "UTF-8"))


STAGES = [
    ("language", known_language),
    ("lines", without_repeated_lines),
    ("near copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("tokens", tokens),
]

#: PPM code lengths and SimHashes have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
