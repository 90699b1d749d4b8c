"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of length 0 to ``ORDER`` with the
counts of the bytes that followed.  The cost of a byte is its exact PPM code
length (escape method C, with exclusion) under those frozen counts: the
longest known context predicts it, or escapes to the next shorter one with
the symbols already ruled out left out.  As the counts are frozen, a byte's
cost depends on its last ``ORDER`` bytes alone, so equal byte runs are costed
once per worker.  The language with the shortest code wins.

Training reads a documented, bounded sample: of the rows with text and a
language, as many (by a hash of doc_id) as make ``TRAIN_BYTES`` a language in
expectation, and ``MODEL_BYTES`` in all; copies of one text count as often as
they occur.  Counting is a job; the counts (at most one per sampled byte and
language) are broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import few, held, let_go, mix

ORDER = 4
TRAIN_BYTES, MODEL_BYTES = 2_000_000, 16_000_000
UNKNOWN = "und"
#: Slots of a worker's memo of costs, bytes costed at once.
SLOTS, PIECE = 1 << 20, 1 << 16
#: Rows of a batch that are treated at once.
ROWS = 512
LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray) -> np.ndarray:
    """Each byte from the ORDER-th on with the ORDER bytes before it, as one integer."""
    n = len(data) - ORDER
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER + 1):
        out = (out << np.uint64(8)) | data[k:k + n]
    return out


def fold(text: str) -> bytes:
    """Lower-cased UTF-8 after ORDER zero bytes, the context of a text's start."""
    return bytes(ORDER) + text.lower().encode("utf-8", "surrogatepass")


def low(key: np.ndarray, n_bytes: int) -> np.ndarray:
    return key & np.uint64((1 << (8 * n_bytes)) - 1)


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each x in sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


class Tree:
    """One language's counts by context length."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.by = []
        for k in range(ORDER + 1):
            sym, which = np.unique(low(keys, k + 1), return_inverse=True)
            n = np.bincount(which, counts).astype(np.float64)
            ctx, first, kinds = np.unique(sym >> np.uint64(8), return_index=True, return_counts=True)
            # what the next shorter context has counted for the symbols seen here: excluded after an escape
            ruled = np.add.reduceat(self.by[-1][1][find(self.by[-1][0], low(sym, k))[0]], first) if k else np.zeros(1)
            self.by.append((sym, n, ctx, np.add.reduceat(n, first), kinds.astype(np.float64), ruled))

    def cost(self, g: np.ndarray) -> np.ndarray:
        """Bits that each gram's last byte takes after the bytes before it."""
        bits, out_n, out_d = np.zeros(len(g)), np.zeros(len(g)), np.zeros(len(g))
        todo = np.arange(len(g))
        for k in range(ORDER, -1, -1):
            sym, n, ctx, total, kinds, ruled = self.by[k]
            c, seen = find(ctx, low(g[todo] >> np.uint64(8), k))
            s, hit = find(sym, low(g[todo], k + 1))
            left_d = np.where(seen, kinds[c] - out_d[todo], 0)
            left = np.where(seen, total[c] - out_n[todo] + left_d, 0)
            escape = seen & ~hit & (left_d > 0)
            bits[todo[hit]] += np.log2(left[hit] / n[s[hit]])
            bits[todo[escape]] += np.log2(left[escape] / left_d[escape])
            known = todo[seen]
            out_n[known], out_d[known] = ruled[c[seen]], kinds[c[seen]]
            todo = todo[~hit]
        bits[todo] += np.log2(np.maximum(256 - out_d[todo], 1))
        return bits


class Scorer:
    """Code lengths of texts under every language's tree, with a memo of grams."""

    def __init__(self, langs: list[str], keys: list[np.ndarray], counts: list[np.ndarray]):
        self.langs, self.trees = langs, [Tree(k, c) for k, c in zip(keys, counts)]
        self.key = np.full(SLOTS, ~np.uint64(0))
        self.bits = np.zeros((SLOTS, len(langs)))

    def costs(self, g: np.ndarray) -> np.ndarray:
        slot = (mix(g) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        out = self.bits[slot]
        miss = np.flatnonzero(self.key[slot] != g)
        if len(miss):
            new, which = np.unique(g[miss], return_inverse=True)
            bits = np.stack([t.cost(new) for t in self.trees], axis=1)
            out[miss] = bits[which]
            self.key[slot[miss]], self.bits[slot[miss]] = g[miss], out[miss]
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """[text, language] code lengths in bits."""
        parts = [fold(t) for t in texts]
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        total = np.zeros((len(texts), len(self.langs)))
        for s in range(0, len(data) - ORDER, PIECE):
            e = min(s + PIECE, len(data) - ORDER)  # grams s to e; gram i ends at byte i + ORDER
            first, last = np.searchsorted(ends, s + ORDER, "right"), np.searchsorted(ends, e - 1 + ORDER, "right")
            cuts = np.maximum(starts[first:last + 1] - s, 0)
            bits = self.costs(grams(data[s:e + ORDER]))
            # grams that end in a text's leading zeros belong to no text
            pad = np.concatenate([np.arange(c - ORDER, c) for c in starts[first:last + 1] - s] + [np.zeros(0, int)]).astype(np.int64)
            bits[pad[(pad >= 0) & (pad < e - s)]] = 0
            np.add.at(total, np.arange(first, last + 1), np.add.reduceat(bits, np.minimum(cuts, e - s - 1), axis=0))
        return total


def train(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, sorted grams, counts) of a bounded sample of ``docs(doc_id, text, lang)``, with at least one text of every language."""
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
            .filter("doc_id is not null and text is not null and lang is not null"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    size = F.octet_length("text")
    sizes = rows.groupBy("lang").agg(F.sum(size).alias("n"), F.min(F.when(size > 0, draw)).alias("least")).collect()
    if not sizes:
        return []
    share = min(train_bytes, MODEL_BYTES // len(sizes))
    keep = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, share / max(r.n, 1)))])
    first = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, -1.0 if r.least is None else float(r.least))])

    def count(batches):
        let_go()
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                g = np.concatenate([grams(np.frombuffer(fold(t), np.uint8)) for t, x in zip(texts, langs) if x == lang])
                keys, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    drawn = (draw < F.element_at(keep, F.col("lang"))) | (draw == F.element_at(first, F.col("lang")))
    got = (rows.filter(drawn).select("text", "lang")
           .mapInArrow(count, "lang string, gram long, n long")
           .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())
    lang, gram, n = (got.column(c).to_numpy() for c in ("lang", "gram", "n"))
    model = []
    for x in sorted(set(lang)):
        own = lang == x
        order = np.argsort(gram[own])
        model.append((x, gram[own][order].view(np.uint64), n[own][order].astype(np.float64)))
    return model


def _scorer(model) -> Scorer:
    """One scorer per worker and model."""
    return held(model.id, lambda: Scorer(*map(list, zip(*model.value))))


class Shared:
    """A broadcast model that workers know by a name."""

    def __init__(self, spark, value):
        import uuid

        self.id, self._b = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._b.value


def _told(shared, texts: list):
    """(language, score, bits a byte) of each text."""
    lang, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
    known = [i for i, t in enumerate(texts) if shared and t and LETTER.search(t)]
    if known:
        s = _scorer(shared)
        bits = s.lengths([texts[i] for i in known])
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(known)), best]
        score[known] = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(axis=1)
        rate[known] = least / [len(fold(texts[i])) - ORDER for i in known]
        for i, x in zip(known, best):
            lang[i] = s.langs[x]
    return lang, score, rate


def identify(docs: DataFrame, model: list) -> DataFrame:
    """``(doc_id, lang_pred, score, bits_per_byte)`` for every row of ``docs(doc_id, text)``, by whole texts alone.

    score is the winner's posterior under equal priors.  Null, empty and
    letterless texts get ``und``, score 0 and no bits; so does every text if
    nothing was learned.  Ties go to the language that sorts first.  Repeated
    rows, null ids and further columns are no special cases.
    """
    shared = Shared(docs.sparkSession, model) if model else None

    def run(batches):
        for b in few(batches, ROWS):
            lang, score, rate = _told(shared, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rate, from_pandas=True)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double"))


def keep_known(docs: DataFrame, model: list, bits: float = 8.0) -> DataFrame:
    """The rows of ``docs`` whose language is told, in a code shorter than ``bits`` a byte (8: than no model at all)."""
    shared = Shared(docs.sparkSession, model) if model else None
    at = docs.columns.index("text")

    def run(batches):
        for b in few(batches, ROWS):
            lang, _, rate = _told(shared, b.column(at).cast(pa.string()).to_pylist())
            yield b.filter(pa.array([x != UNKNOWN and r < bits for x, r in zip(lang, rate)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str):
    """The fold that training never sees: crc32 of the id as text leaves remainder 2 by 4 (false for a null id)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
