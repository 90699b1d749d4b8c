"""Substring deduplication by recompression.

Words are symbols.  A round names runs of equal symbols and then pairs: each
symbol is a left or a right one by its name, and a left one followed by a
right one becomes one symbol.  Names are 64-bit hashes of what they stand for,
so every task gives equal content the same name and no round shuffles.

What lies outside a stretch of words can only change the symbols at its ends:
a pair is decided by its two symbols.  So each window has interior symbols
that depend on its own words alone, found by walking the certain range through
the rounds.  The longest of them (ties: least name, then leftmost) is the
window's anchor; a window without interior symbols is anchored by the hash of
its words.  Equal windows have equal anchors, hence only windows whose anchor
occurs in several documents can repeat.  For those, the window's own hash
beside its anchor verifies the repeat (128 bits together), and the smallest
document of each content decides what goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import mix, slabs, stage

WINDOW, ROUNDS = 50, 5
#: Rounds that name runs before pairs; every round would cost a certain symbol more.
RUN_ROUNDS = (0, 3)
#: Bytes of text treated at once, runs compared at once, documents of an anchor that is compared in one task.
CHUNK, SLAB_RUNS, MANY = 1 << 20, 20_000, 4096
RUNS = "anchor long, doc_id long, place long, contents binary"
ODD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LANES = np.arange(8)


class Words:
    """The words of several texts: bounds in ``data``, document numbers and hashes."""

    def __init__(self, texts: list[bytes], separates: np.ndarray = SPACE):
        raw = b"\n".join(texts)
        self.data = np.frombuffer(raw + bytes(8), np.uint8)
        inside = ~separates[self.data[:len(raw)]]
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
        self.lo, self.hi = edge[::2], edge[1::2]
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        #: First word of each text, and the number of words at the end.
        self.first = np.searchsorted(self.lo, starts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        size = self.hi - self.lo
        h, at, left, todo = size.astype(np.uint64) * ODD, self.lo.copy(), size.copy(), np.arange(len(size))
        while len(todo):
            lane = self.data[at[todo][:, None] + LANES].view("<u8").ravel()
            unused = (64 - 8 * np.minimum(left[todo], 8)).astype(np.uint64)
            h[todo] = mix(h[todo] * ODD ^ (lane & (~np.uint64(0) >> unused)))
            at[todo] += 8
            left[todo] -= 8
            todo = todo[left[todo] > 0]
        return h

    def kept(self, doc: int, keep: np.ndarray) -> bytes:
        """The kept words of a text, joined by one space."""
        own = np.flatnonzero(keep[self.first[doc]:self.first[doc + 1]]) + self.first[doc]
        data = self.data.tobytes() if not hasattr(self, "raw") else self.raw
        self.raw = data
        return b" ".join([data[a:b] for a, b in zip(self.lo[own].tolist(), self.hi[own].tolist())])


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words (a polynomial of the words' hashes)."""
    out = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    power, step, done, need, part = np.uint64(1), ODD, 0, size, h  # part[i]: of 2^k words from i on; binary parts of size
    span = 1
    while need:
        if need & 1:
            out += part[done:done + len(out)] * power
            power, done = np.uint64(int(power) * int(step) & 0xFFFFFFFFFFFFFFFF), done + span
        need >>= 1
        if need:
            part = part[:-span] + part[span:] * step
            step, span = np.uint64(int(step) * int(step) & 0xFFFFFFFFFFFFFFFF), 2 * span
    return mix(out)


def anchors(words: Words, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, anchor, hash) of every window of ``size`` words."""
    h = words.hashes()
    at = np.flatnonzero(words.doc[:max(len(h) - size + 1, 0)] == words.doc[size - 1:]) if len(h) >= size else np.zeros(0, int)
    hashes = window_hashes(h, size)[at]
    if not len(at):
        return at, hashes, hashes
    a, z = at.copy(), at + size  # the certain symbols of each window are a to z
    sym, new, start = h, np.zeros(len(h), bool), np.arange(len(h))
    new[words.first[:-1][words.first[:-1] < len(h)]] = True
    for r in range(rounds):
        seed = np.uint64((r + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        if r in RUN_ROUNDS:
            head = np.r_[True, sym[1:] != sym[:-1]] | new
            at_head = np.flatnonzero(head)
            n = np.diff(np.r_[at_head, len(sym)])
            which = np.cumsum(head) - 1
            some = a < z
            a, z = np.where(some, which[np.where(some, a, 0)] + 1, 0), np.where(some, which[np.where(some, z - 1, 0)], 0)
            a = np.minimum(a, z)
            long = n > 1
            sym, new, start = sym[at_head], new[at_head], start[at_head]
            sym[long] = mix(sym[long] ^ mix(n[long].astype(np.uint64) + seed))
        right = (mix(sym ^ seed) >> np.uint64(63)).astype(bool)
        tied = np.r_[~right[:-1] & right[1:] & ~new[1:], False]  # this symbol and the next
        head = np.r_[True, ~tied[:-1]]
        which = np.r_[np.cumsum(head) - 1, head.sum()]
        some = a < z
        first, last = np.where(some, a, 0), np.where(some, z - 1, 0)
        a2 = which[first + right[first]]
        z2 = which[last] + right[last]
        a, z = np.where(some, np.minimum(a2, z2), 0), np.where(some, z2, 0)
        both = np.flatnonzero(tied)
        sym = sym.copy()
        sym[both] = mix(sym[both] * ODD + mix(sym[both + 1] + seed))
        at_head = np.flatnonzero(head)
        sym, new, start = sym[at_head], new[at_head], start[at_head]
    span = np.diff(np.r_[start, len(h)])
    value = (np.minimum(span, (1 << 20) - 1).astype(np.uint64) << np.uint64(44)) | (~sym >> np.uint64(20))
    width = z - a
    some = np.flatnonzero(width > 0)
    out = hashes ^ ODD
    if len(some):
        height = int(width.max()).bit_length()
        best = [np.arange(len(sym))]  # best[k][i]: the anchor among 2^k symbols from i on
        for k in range(1, height):
            low = best[-1]
            other = np.r_[low[1 << (k - 1):], np.full(1 << (k - 1), low[-1])][:len(low)]
            best.append(np.where(value[other] > value[low], other, low))
        table = np.stack(best)
        k = np.frexp(width[some].astype(np.float64))[1] - 1
        x, y = table[k, a[some]], table[k, z[some] - (1 << k)]
        out[some] = sym[np.where(value[y] > value[x], y, x)]
    return at, out, hashes


def _chunks(rows):
    """Lists of (row, text) of about CHUNK bytes."""
    held, n = [], 0
    for row, text in rows:
        held.append((row, text))
        n += len(text)
        if n >= CHUNK:
            yield held
            held, n = [], 0
    if held:
        yield held


def _texts(batch: pa.RecordBatch, *columns: str):
    """Rows of other columns, each with the text's UTF-8."""
    others = zip(*(batch.column(c).to_pylist() for c in columns))
    return zip(others, (t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()))


def _crc():
    return F.crc32(F.col("text").cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF))


def find_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(doc_id, places)``: the windows of a document that a document with a smaller id has too, in runs ``(place, n)``.

    All runs of an anchor that at most MANY documents hold are compared in one
    task.  A place is ``31 bits of crc32(text) << 32 | first word``, so that rows which share an
    id but not their text stay apart.
    """
    rows = docs.filter("doc_id is not null and octet_length(text) >= %d" % (2 * size - 1))

    def name(batches):
        for b in batches:
            for part in _chunks(_texts(b, "doc_id")):
                words = Words([t for _, t in part])
                at, anchor, _ = anchors(words, size)
                ids = np.array([r[0] for r, _ in part], np.int64)[words.doc[at]]
                order = np.lexsort((anchor, ids))
                anchor, ids = anchor[order], ids[order]
                other = np.r_[True, (anchor[1:] != anchor[:-1]) | (ids[1:] != ids[:-1])] if len(ids) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[other].view(np.int64)), pa.array(ids[other])], ["anchor", "doc_id"])

    named = stage(rows.select("doc_id", "text").mapInArrow(name, "anchor long, doc_id long"), "anchors")
    shared = (named.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
              .filter("lo < hi").select("anchor", (F.col("n") > MANY).alias("many")))

    def runs(many: bool) -> DataFrame:
        """``(anchor, doc_id, place, contents)``: windows in a row that have one shared anchor, and their hashes."""
        own = named.join(shared.filter(F.col("many") == many).select("anchor"), "anchor")
        per_doc = own.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
        return rows.select("doc_id", "text", _crc().alias("crc")).join(per_doc, "doc_id").mapInArrow(hash_runs, RUNS)

    def hash_runs(batches):
        for b in batches:
            for part in _chunks(_texts(b, "doc_id", "crc", "anchors")):
                words = Words([t for _, t in part])
                at, anchor, own = anchors(words, size)
                keep = np.isin(anchor, np.concatenate([np.array(r[2], np.int64) for r, _ in part]).view(np.uint64))
                at, anchor, own, doc = at[keep], anchor[keep], own[keep], words.doc[at[keep]]
                first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])][:len(at)])
                place = (np.array([r[1] for r, _ in part], np.int64) << 32)[doc] | (at - words.first[doc])
                ends = 8 * np.r_[first, len(at)].astype(np.int32)
                contents = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(own.tobytes())])
                ids = np.array([r[0] for r, _ in part], np.int64)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(ids[first]), pa.array(place[first]), contents], ["anchor", "doc_id", "place", "contents"])

    def compare(batches):
        """Runs of windows that a smaller document has, from all runs of each anchor."""
        for t in slabs(batches, ["anchor"], SLAB_RUNS):
            contents = t.column("contents").to_pylist()
            n = np.array([len(c) // 8 for c in contents])
            which = np.repeat(np.arange(len(n)), n)
            own = np.frombuffer(b"".join(contents), np.int64)
            anchor, ids, place = (t.column(c).to_numpy()[which] for c in ("anchor", "doc_id", "place"))
            place = place + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((ids, own, anchor))
            new = np.r_[True, (own[order][1:] != own[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])][:len(order)]
            least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            gone = np.zeros(len(order), bool)
            gone[order] = least < ids[order]
            at = np.flatnonzero(gone)
            first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (which[at][1:] != which[at][:-1])][:len(at)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at[first]], place[at[first]], np.diff(np.r_[first, len(at)]).astype(np.int64))], ["doc_id", "place", "n"])

    few = runs(False).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "doc_id long, place long, n long")
    if not shared.filter("many").isEmpty():
        # an anchor of very many documents: a row per window, combined before the shuffle, the join's large keys split
        packed = stage(runs(True), "runs")
        def unpack(batches):
            for b in batches:
                contents = b.column("contents").to_pylist()
                n = np.array([len(c) // 8 for c in contents], np.int64)
                which = np.repeat(np.arange(len(n)), n)
                anchor, ids, place = (b.column(c).to_numpy()[which] for c in ("anchor", "doc_id", "place"))
                place = place + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, np.frombuffer(b"".join(contents), np.int64), ids, place)], ["anchor", "content", "doc_id", "place"])

        windows = packed.mapInArrow(unpack, "anchor long, content long, doc_id long, place long")
        first = windows.groupBy("anchor", "content").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").drop("hi")
        repeated = windows.join(first, ["anchor", "content"]).filter("lo < doc_id").select("doc_id", "place", F.lit(1).cast("long").alias("n"))
        few = few.unionByName(repeated)
    return few.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("places"))


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row of ``docs(doc_id, text)``; kept holds the words that stay.

    A word goes if a window of ``size`` words that covers it also starts in a
    document with a smaller id.  Null, empty and blank texts have no words,
    shorter texts no window.  Repeated rows (equal ids) take nothing from each
    other; a row with a null id loses nothing and takes nothing.  Further
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = rows.withColumn("crc", _crc()).join(find_repeats(rows, size), "doc_id", "left")

    def cut(batches):
        for b in batches:
            for part in _chunks(_texts(b, "doc_id", "crc", "places")):
                words = Words([t for _, t in part])
                gone = np.zeros(len(words.lo) + 1, np.int64)
                for i, ((_, crc, places), _) in enumerate(part):
                    if places:
                        p, n = np.array([(x["place"], x["n"]) for x in places], np.int64).T
                        own = p >> 32 == crc
                        p = (p[own] & 0xFFFFFFFF) + words.first[i]
                        np.add.at(gone, p, 1)
                        np.add.at(gone, p + n[own] - 1 + size, -1)
                keep = np.cumsum(gone)[:-1] == 0
                total = np.r_[0, np.cumsum(keep)]
                n, kept = np.diff(words.first), total[words.first[1:]] - total[words.first[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r, _ in part], pa.int64()), pa.array(n), pa.array(n - kept),
                     pa.array([words.kept(i, keep).decode("utf-8", "surrogatepass") for i in range(len(part))], pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"])

    return marked.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
