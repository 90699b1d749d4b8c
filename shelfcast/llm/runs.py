"""Periodic runs of words by internal pattern matching.

Documents of a batch are joined into one sequence of word numbers, each closed
by a symbol of its own.  Prefix doubling sorts the suffixes and, on the way,
names every block of 2**k words (``Blocks``); a wavelet matrix over the suffix
array answers range successor queries: the next place from a position on at
which the words of a block occur, and how many follow up to another
(``Wavelet``).

A run of period q and length L >= max(12, 2q) has L - q >= max(6, q), so it
holds, before its last q words, a whole dyadic block of b words with
2b - 1 <= max(6, q), and that block occurs again q words on.  So blocks of two
words look 1 to 6 words ahead, blocks of b = 4, 8, ... words 2b - 1 to 4b - 2.
These neighbouring windows are cut into pieces of b places.  The occurrences in
a piece are an arithmetic progression, given by its first two members and their
number; the members' distances are the candidate periods.  A progression of
three or more lies in a stretch whose period is its step; where the block itself
lies in the same stretch, the distances are multiples of that period and are
left out.  A candidate is extended both ways over equal blocks, longest first;
of runs over the same words the smallest period counts.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest run in words, and words of the periods that blocks of two words look for.
SHORTEST, NEAR = 12, 6
#: Words of documents that are indexed together (a longer document is indexed alone).
BATCH_WORDS = 250_000


class Blocks:
    """Names of the blocks of 1, 2, 4, ... symbols at every position, and the suffix array.

    ``rank[k][i]`` is the suffix array's first index of the suffixes that start with the block of 2**k symbols at i;
    ``size[k][i]`` how many they are.  Blocks that run beyond the end have names of their own.
    """

    def __init__(self, symbols: np.ndarray, longest: int):
        """``symbols`` are small numbers; no block of more than ``longest`` symbols occurs twice."""
        n = self.n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        rank, size = self._named(order, symbols[order], np.arange(n))
        self.rank, self.size, k = [rank], [size], 0
        while (1 << k) <= longest:
            # suffixes that are told apart already keep their place
            at = np.flatnonzero(size > 1)
            if not len(at):
                break
            after = np.zeros(len(at), np.int64)
            inside = at + (1 << k) < n
            after[inside] = rank[at[inside] + (1 << k)] + 1
            key = rank[at].astype(np.int64) * (n + 1) + after
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            group = key // (n + 1)
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = group + np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            order[place] = at
            new_rank, new_size = self._named(at, key, place)
            rank, size = rank.copy(), size.copy()
            rank[at], size[at] = new_rank[at], new_size[at]
            self.rank.append(rank)
            self.size.append(size)
            k += 1
        self.suffixes = order

    def _named(self, at: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[first, len(at)])
        rank, size = np.zeros(self.n, np.int32), np.ones(self.n, np.int32)
        rank[at] = np.repeat(place[first], count)
        size[at] = np.repeat(count, count)
        return rank, size

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and from b on are equal (a < b)."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            while True:  # the longest blocks may fit more than once
                x, y = a + out, b + out
                inside = y + (1 << k) <= self.n
                same = inside & (self.rank[k][x] == self.rank[k][np.where(inside, y, 0)])
                out[same] += 1 << k
                if k < len(self.rank) - 1 or not same.any():
                    break
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before a and before b are equal (a < b)."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            while True:
                x, y = a - out - (1 << k), b - out - (1 << k)
                inside = x >= 0
                same = inside & (self.rank[k][np.where(inside, x, 0)] == self.rank[k][np.where(inside, y, 0)])
                out[same] += 1 << k
                if k < len(self.rank) - 1 or not same.any():
                    break
        return out


class Wavelet:
    """Wavelet matrix of the numbers 0 to n - 1 in any order."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.before, values = [], [], values.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1
            self.before.append(np.concatenate(([0], np.cumsum(1 - bit))).astype(np.int32))
            self.zeros.append(int(self.before[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values at lo <= index < hi are less than x."""
        out, lo, hi = np.zeros(len(lo), np.int64), lo.astype(np.int64), hi.astype(np.int64)
        top = x >= (1 << self.bits)
        out[top] = (hi - lo)[top]
        for b, zeros, before in zip(range(self.bits - 1, -1, -1), self.zeros, self.before):
            l0, h0 = before[lo], before[hi]
            one = ((x >> b) & 1).astype(bool)
            out += np.where(one & ~top, h0 - l0, 0)
            lo, hi = np.where(one, lo - l0 + zeros, l0), np.where(one, hi - h0 + zeros, h0)
        return out

    def at_rank(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values at lo <= index < hi."""
        out, lo, hi, k = np.zeros(len(lo), np.int64), lo.astype(np.int64), hi.astype(np.int64), k.copy()
        for b, zeros, before in zip(range(self.bits - 1, -1, -1), self.zeros, self.before):
            l0, h0 = before[lo], before[hi]
            one = k >= h0 - l0
            k -= np.where(one, h0 - l0, 0)
            out += np.where(one, 1 << b, 0)
            lo, hi = np.where(one, lo - l0 + zeros, l0), np.where(one, hi - h0 + zeros, h0)
        return out


def progressions(blocks: Blocks, wavelet: Wavelet, level: int):
    """Yield ``(place, first, step, count)`` of the progressions in which blocks of 2**level symbols occur again."""
    b = 1 << level
    far = (1, NEAR) if b == 2 else (2 * b - 1, 4 * b - 2)
    at = np.arange(0, blocks.n, b)
    size = blocks.size[level][at]
    at = at[size > 1]
    lo = blocks.rank[level][at].astype(np.int64)
    hi = lo + blocks.size[level][at]
    for start in range(far[0], far[1] + 1, b):
        end = min(start + b, far[1] + 1)
        below = wavelet.below(lo, hi, at + start)
        some = below < hi - lo
        p, l, h, below = at[some], lo[some], hi[some], below[some]
        first = wavelet.at_rank(l, h, below)
        some = first < p + end
        p, l, h, below, first = p[some], l[some], h[some], below[some], first[some]
        count = wavelet.below(l, h, p + end) - below
        step = np.zeros(len(p), np.int64)
        several = count > 1
        step[several] = wavelet.at_rank(l[several], h[several], below[several] + 1) - first[several]
        yield p, first, step, count


def find_runs(symbols: np.ndarray, longest: int) -> np.ndarray:
    """All runs ``(start, end, period)`` of a sequence, ordered; ``longest`` bounds the stretches without a closing symbol."""
    blocks = Blocks(symbols, longest)
    if len(blocks.rank) < 2:
        return np.zeros((0, 3), np.int64)
    wavelet = Wavelet(blocks.suffixes)
    found = []
    for level in range(1, len(blocks.rank)):
        for place, first, step, count in progressions(blocks, wavelet, level):
            if not len(place):
                continue
            many = np.flatnonzero(count > 2)
            if len(many):  # members that lie in the block's own stretch of period step are multiples of that period
                p, d = place[many], step[many]
                own = p + d + blocks.forward(p, p + d) >= first[many] + (1 << level)
                keep = np.ones(len(place), bool)
                keep[many[own]] = False
                place, first, step, count = place[keep], first[keep], step[keep], count[keep]
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            a = np.repeat(place, count)
            q = np.repeat(first, count) + nth * np.repeat(step, count) - a
            start = a - blocks.backward(a, a + q)
            end = a + q + blocks.forward(a, a + q)
            good = end - start >= np.maximum(SHORTEST, 2 * q)
            if good.any():
                found.append(np.unique(np.column_stack((start[good], end[good], q[good])), axis=0))
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)  # by start, end, period
    return rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]]


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the repeated tail that every tenth document gets, told by its id's CRC-32 (the query's test cases)."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[:n - a]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of word numbers, each text closed by a number of its own, and the texts' starts."""
    known: dict[bytes, int] = {}
    flat = [known.setdefault(w, len(known)) for t in texts for w in t]
    n = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(n + 1) - (n + 1)
    out = np.empty(len(flat) + len(texts), np.int64)
    ends = starts + n
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = flat
    out[ends] = len(known) + np.arange(len(texts))
    return out, starts


def described(words: list[bytes], runs: np.ndarray) -> tuple:
    """``(n_runs, start, length, period, exponent_milli, runs, kept)`` of one text; ``runs`` as found, by start."""
    if not len(runs):
        return 0, None, None, None, None, b"", words
    start, length, period = runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    top = np.lexsort((period, start, -length))[0]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist())).encode()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
    return (len(start), int(start[top]), int(length[top]), int(period[top]), int(1000 * length[top] // period[top]), listed, kept)


SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed string, collapsed_sha256 string")


def collapse_runs(docs: DataFrame, planted: bool = False, texts: bool = True) -> DataFrame:
    """For each row of ``docs(doc_id, text)``, its periodic runs of words and the text with each run cut to one period.

    Words lie between ASCII white space.  Columns: ``n_words, n_runs``; ``start, length, period, exponent_milli`` of
    the longest run (ties: smallest start, then period; null without a run); ``runs_sha256`` of all runs as lines
    ``start,length,period``; ``collapsed`` (null unless ``texts``) and its SHA-256: the words that no run holds after
    its first period, joined by one space.  ``planted`` gives every tenth document a repeated tail first
    (``repeated_tail``; not for a null id).  Null, empty and blank texts have no words; repeated rows and null ids stay
    as they are; an empty table gives an empty result; other columns are ignored.  Map-only: a task holds the
    documents of a batch, and a text is never split: about 25 arrays of its number of words.
    """
    def flush(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
        sequence, starts = numbered(words)
        longest = max(len(w) for w in words)
        runs = find_runs(sequence, longest) if longest >= SHORTEST else np.zeros((0, 3), np.int64)
        cut = np.searchsorted(runs[:, 0], np.r_[starts, len(sequence)])
        out = []
        for i, (w, s) in enumerate(zip(words, starts)):
            own = runs[cut[i]:cut[i + 1]] - np.array([s, s, 0])
            n, start, length, period, milli, listed, kept = described(w, own)
            text = b" ".join(kept)
            out.append((ids[i], len(w), n, start, length, period, milli, hashlib.sha256(listed).hexdigest(),
                        text.decode() if texts else None, hashlib.sha256(text).hexdigest()))
        kinds = [pa.int64()] * 7 + [pa.string()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                          ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed", "collapsed_sha256"])

    def run(batches):
        ids, words, n = [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                w = (text or b"").split()
                if words and n + len(w) > BATCH_WORDS:
                    yield flush(ids, words)
                    ids, words, n = [], [], 0
                ids.append(i)
                words.append(repeated_tail(i, w) if planted else w)
                n += len(w) + 1
        if words:
            yield flush(ids, words)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
