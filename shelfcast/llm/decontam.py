"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into overlapping passages of ``PASSAGE``
words.  Words are hashed into ``BUCKETS`` terms, which get inverse document
frequencies counted over all documents, whether the benchmark uses them or not.
A randomised SVD of the benchmark passages' TF-IDF rows, whose products are
summed by Spark jobs, gives a latent space of ``LATENT`` dimensions.  A
document passage is a candidate for an item if their latent cosine, lowered by
the share of the passage's weight that lies outside the benchmark's terms,
reaches ``COSINE`` times the cosine that a copy of the item's passage has among
other words of equal weight; passages whose whole benchmark weight can't reach it, or without
the rarer words that any item needs nearby, are passed over, which loses none.  Each candidate is checked on the words around
the passage: the longest common subsequence with the whole item decides, and
for paraphrases the item's answer must be there too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import let_go, stage
from shelfcast.llm.substring import CHUNK, Words

PASSAGE, STRIDE = 32, 16
BUCKETS, LATENT, SPARE, POWERS = 1 << 17, 128, 16, 2
#: Times the root of a passage's share of PASSAGE words; from the recall in the README.
COSINE = 0.2
#: Common share of an item's words for a copy; for a paraphrase, with this share of its answer's words.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: Items of fewer words match nothing; passages of items compared in one pass over the documents.
LEAST_WORDS, ITEM_BLOCK = 5, 8192

#: Rare words of an item that a passage must have around it before it is projected.
SEVERAL = 4

SEPARATES = np.ones(256, bool)
SEPARATES[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
SENTENCE = regex.compile(r"(?<=[.!?:])\s+")


class Terms(Words):
    """Words of lower-cased texts: runs of letters, digits and non-ASCII characters."""

    def __init__(self, texts: list[str]):
        super().__init__([t.lower().encode("utf-8", "surrogatepass") for t in texts], SEPARATES)
        self.hash = self.hashes()
        self.bucket = (self.hash >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) words of the passages of texts that start at the words ``first``; the last one ends with its text."""
    lo, hi = [], []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        starts = list(range(s, max(e - PASSAGE, s) + 1, STRIDE)) if e > s else []
        if starts and starts[-1] + PASSAGE < e:
            starts.append(e - PASSAGE)
        lo += starts
        hi += [min(x + PASSAGE, e) for x in starts]
    return np.array(lo, np.int64), np.array(hi, np.int64)


def spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions lo to hi of every passage, one after another, and each position's passage."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


class Space:
    """Inverse document frequencies and, once fitted, the latent projection of each benchmark term."""

    def __init__(self, idf: np.ndarray, other: np.ndarray):
        self.idf, self.other = idf, other  # idf is 0 where the benchmark has no term; other has those terms' frequencies
        self.row = np.cumsum(idf > 0) - 1
        self.basis = np.zeros((0, 0))

    def rows(self, bucket: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """(passage, term row, weight) of the benchmark's terms in each passage, and each passage's full norm."""
        at, which = spans(lo, hi)
        key, n = np.unique(which * BUCKETS + bucket[at], return_counts=True)
        which, term = key // BUCKETS, key % BUCKETS
        inside = self.idf[term] > 0
        weight = np.sqrt(n) * np.where(inside, self.idf[term], self.other[term])
        norm = np.sqrt(np.bincount(which, weight**2, minlength=len(lo)))
        return which[inside], self.row[term[inside]], weight[inside], norm

    def project(self, which, term, weight, n: int) -> np.ndarray:
        out = np.zeros((n, self.basis.shape[1]), np.float32)
        if len(which):
            first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
            weight = weight[:, None].astype(np.float32)
            for s in range(0, len(first), 256):  # passages at a time, so that their rows stay in the processor's cache
                own = first[s:s + 256]
                a, b = own[0], first[s + 256] if s + 256 < len(first) else len(which)
                out[which[own]] = np.add.reduceat(weight[a:b] * self.basis[term[a:b]], own - a, axis=0)
        return out


def _parts(batches, columns: int):
    """(rows, texts) of about CHUNK characters; the text is the last column, null is empty."""
    for b in batches:
        rows, texts, n = [], [], 0
        for row in zip(*(b.column(i).to_pylist() for i in range(columns))):
            rows.append(row[:-1])
            texts.append(row[-1] or "")
            n += len(texts[-1])
            if n >= CHUNK:
                yield rows, texts
                rows, texts, n = [], [], 0
        if rows:
            yield rows, texts


def frequencies(docs: DataFrame, items: DataFrame) -> Space:
    """Document frequencies of all terms over all documents, as inverse frequencies."""
    spark = docs.sparkSession

    def used(batches):
        seen = np.zeros(BUCKETS, np.int64)
        for _, texts in _parts(batches, 1):
            seen[Terms(texts).bucket] = 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at)], ["term"])

    known = np.zeros(BUCKETS, bool)
    known[[r.term for r in items.select("text").mapInArrow(used, "term long").distinct().collect()]] = True

    def count(batches):
        let_go()
        n, docs_seen = np.zeros(BUCKETS, np.int64), 0
        for _, texts in _parts(batches, 1):
            words = Terms(texts)
            n += np.bincount(np.unique(words.doc * BUCKETS + words.bucket) % BUCKETS, minlength=BUCKETS)
            docs_seen += len(texts)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[n[at], docs_seen])], ["term", "n"])

    counts = {r.term: r.n for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(-1, 0)
    seen = np.zeros(BUCKETS, np.int64)
    seen[list(counts)] = list(counts.values())
    idf = np.maximum(np.log((1 + total) / (1 + seen)), 1e-3)
    return Space(np.where(known, idf, 0.0), np.where(known, 0.0, idf))


def fit(items: DataFrame, space: Space, seed: int = 3) -> None:
    """Randomised SVD of the items' passages: subspace iteration, each product a sum over Spark tasks."""
    spark, terms = items.sparkSession, int((space.idf > 0).sum())
    width = min(LATENT + SPARE, terms)
    probe = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0] if width else np.zeros((0, 0))

    def product(right: np.ndarray) -> np.ndarray:
        """A' A right."""
        shared = spark.sparkContext.broadcast((space, right))

        def run(batches):
            space, right = shared.value
            out = np.zeros_like(right)
            for _, texts in _parts(batches, 1):
                words = Terms(texts)
                lo, hi = passages(words.first)
                which, term, weight, norm = space.rows(words.bucket, lo, hi)
                weight = weight / norm[which]
                left = np.zeros((len(lo), right.shape[1]))
                np.add.at(left, which, weight[:, None] * right[term])
                np.add.at(out, term, weight[:, None] * left[which])
            at = np.flatnonzero(out.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(out[at]), pa.list_(pa.float64()))], ["term", "v"])

        sums = (items.select("text").mapInArrow(run, "term long, v array<double>").select("term", F.posexplode("v"))
                .groupBy("term", "pos").agg(F.sum("col").alias("x")).toArrow())
        out = np.zeros_like(right)
        out[sums.column("term").to_numpy(), sums.column("pos").to_numpy()] = sums.column("x").to_numpy()
        return out

    for _ in range(POWERS if width else 0):
        probe = np.linalg.qr(product(probe))[0]
    if width:
        values, vectors = np.linalg.eigh(probe.T @ product(probe))
        best = np.argsort(-values)[:LATENT]
        best = best[values[best] > 1e-9 * max(values.max(), 1e-300)]
        probe = probe @ vectors[:, best]
    space.basis = probe.astype(np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a word of bits at a time."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def answer_of(text: str, answer: str | None) -> str:
    """The item's answer if it has one, else its last sentence."""
    return answer if answer else SENTENCE.split(text.strip())[-1]


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, row, item_id, common, answer)`` of every document and benchmark item it holds.

    common is the largest share of the item's words in order found around a
    candidate passage, answer that of the answer's words; row is the text's
    hash, which tells apart rows of one doc_id.  ``benchmark`` has item_id, text
    and may have answer; without one the last sentence is the answer.  Null and
    empty texts hold nothing and are held by nothing, items of fewer than
    LEAST_WORDS words match nothing, repeated documents report each row once
    and repeated items once per id; null ids are reported as null.  Further
    columns are ignored, empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("row"), "text")
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = stage(benchmark.select(F.col("item_id").cast("long").alias("item_id"), answer.alias("answer"), F.col("text").cast("string").alias("text")).distinct(), "items")
    space = frequencies(rows, items)
    fit(items, space)

    found = None
    blocks = max(1, -(-items.count() * 2 // ITEM_BLOCK))
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        own = [(r.item_id, r.answer, r.text) for r in own if r.text and len(Terms([r.text]).hash) >= LEAST_WORDS]
        if not own:
            continue
        part = _held_by(rows, spark.sparkContext.broadcast((space, own)))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, row long, item_id long, common double, answer double")
    return found.groupBy("doc_id", "row", "item_id").agg(F.max(F.struct("common", "answer")).alias("best")).select("doc_id", "row", "item_id", "best.*")


class Needed:
    """Words that a held item must have near a passage, to pass over passages that can hold none.

    An item is held only if PARAPHRASE of its words lie around the passage, so at most ``spare`` of them are
    missing.  Of its ``spare`` + SEVERAL rarest words (or all) at least SEVERAL (or what all less ``spare`` are) must be there.
    """

    def __init__(self, items: Terms, idf: np.ndarray):
        words, item, self.n, self.least = [], [], np.diff(items.first), []
        for i, (a, b) in enumerate(zip(items.first[:-1].tolist(), items.first[1:].tolist())):
            spare = (b - a) - math.ceil(PARAPHRASE * (b - a) - 1e-9)
            chosen = items.hash[a:b][np.argsort(-idf[items.bucket[a:b]], kind="stable")[:spare + SEVERAL]]
            self.least.append(len(chosen) - spare)
            chosen = np.unique(chosen)
            words.append(chosen)
            item += [i] * len(chosen)
        by = np.argsort(words := np.concatenate(words), kind="stable")
        self.words, self.item, self.least = words[by], np.array(item)[by], np.array(self.least)

    def near(self, docs: Terms, lo: np.ndarray) -> np.ndarray:
        """Whether the passages that start at ``lo`` have as many needed words of some item around them, in their document."""
        if not len(lo):
            return np.zeros(0, bool)
        start = np.searchsorted(self.words, docs.hash)
        at = np.flatnonzero(self.words[np.minimum(start, len(self.words) - 1)] == docs.hash)
        start, many = start[at], np.searchsorted(self.words, docs.hash[at], "right") - start[at]
        place = np.repeat(at, many)
        item = self.item[np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)]
        by = np.lexsort((place, item))
        place, item = place[by], item[by]
        last = np.arange(len(place)) + self.least[item] - 1
        inside = last < len(place)
        first, last = np.flatnonzero(inside), last[inside]
        n, p, q = self.n[item[first]], place[first], place[last]
        ok = (item[first] == item[last]) & (docs.doc[p] == docs.doc[q]) & (q - p < PASSAGE + 2 * n)
        n, p, q = n[ok], p[ok], q[ok]
        cover = np.zeros(len(docs.hash) + 1, np.int64)
        np.add.at(cover, np.maximum(q - PASSAGE - n + 1, docs.first[docs.doc[p]]), 1)
        np.add.at(cover, np.minimum(p + n + 1, docs.first[docs.doc[p] + 1]), -1)
        return np.cumsum(cover)[lo] > 0


def _held_by(rows: DataFrame, shared) -> DataFrame:
    def run(batches):
        let_go()
        space, own = shared.value
        items = Terms([t for _, _, t in own])
        words = [items.hash[a:b].tolist() for a, b in zip(items.first[:-1], items.first[1:])]
        answers = [Terms([answer_of(t, a)]).hash.tolist() for _, a, t in own]
        lo, hi = passages(items.first)
        item = np.searchsorted(items.first, lo, "right") - 1
        which, term, weight, norm = space.rows(items.bucket, lo, hi)
        latent = space.project(which, term, weight, len(lo))
        size = np.sqrt((latent**2).sum(axis=1))
        # a copy of the item's passage scores 1 whatever share of it the latent space keeps
        aim = (latent * (norm / np.maximum(size, 1e-9) ** 2)[:, None]).T
        least = COSINE * np.sqrt((hi - lo) / PASSAGE)
        reach = np.min(least * size / np.maximum(norm, 1e-9), where=norm > 0, initial=1.0)
        needed = Needed(items, space.idf)
        for ids, texts in _parts(batches, 3):
            docs = Terms(texts)
            out = []
            lo, hi = passages(docs.first)
            some = needed.near(docs, lo)
            lo, hi = lo[some], hi[some]
            which, term, weight, norm = space.rows(docs.bucket, lo, hi)
            inside = np.sqrt(np.bincount(which, weight**2, minlength=len(lo)))
            able = inside >= reach * norm * (1 - 1e-6)
            able &= inside > 0
            new = np.cumsum(able) - 1
            keep = able[which]
            score = space.project(new[which[keep]], term[keep], weight[keep], int(able.sum())) @ aim
            score /= np.maximum(norm[able], 1e-9)[:, None]
            near, passage = np.nonzero(score >= least)
            starts, doc = lo[able][near], docs.doc[lo[able][near]] if len(near) else np.zeros(0, int)
            pairs = np.unique(np.stack([doc, item[passage], starts]), axis=1)
            done: dict[tuple[int, int], float] = {}
            for d, i, s in pairs.T.tolist():
                if done.get((d, i), 0) >= 1:
                    continue
                n = len(words[i])
                around = docs.hash[max(docs.first[d], s - n):min(docs.first[d + 1], s + PASSAGE + n)].tolist()
                there = set(around)
                if sum(w in there for w in words[i]) / n < PARAPHRASE:  # the subsequence can't be longer
                    continue
                common = common_subsequence(words[i], around) / n
                if common < PARAPHRASE:
                    continue
                answer = common_subsequence(answers[i], around) / max(len(answers[i]), 1)
                if common >= COPY or answer >= ANSWER:
                    done[d, i] = max(done.get((d, i), 0), common)
                    out.append((*ids[d], own[i][0], common, answer))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "row", "item_id", "common", "answer"])

    return rows.mapInArrow(run, "doc_id long, row long, item_id long, common double, answer double")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``."""
    bad = contaminations(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    row = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (row == bad["_row"]), "left_anti")
