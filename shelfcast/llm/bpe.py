"""Byte-level BPE: a segment tree over byte positions finds the next merge.

A piece of text starts as single-byte tokens.  Leaf ``i`` of its tree holds
``rank * width + i`` for the pair that starts at byte ``i`` (infinite if the
pair is no token), so the root is the leftmost pair of the least rank.  A
merge rewrites three leaves - the merged pair's own, its dead right
neighbour's and its left neighbour's - and the nodes above them.  Short
pieces of equal width are merged side by side, one numpy step per merge;
longer ones use the same tree one by one, so a piece of n bytes takes
O(n log n).  A worker remembers a bounded number of pieces and of words.
"""

from __future__ import annotations

import base64
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import few, held

#: Entries of a memo's newer half; bytes of the widest piece merged side by side; pieces merged at once.
MEMO, WIDE, BLOCK = 60_000, 64, 8_000
#: Rows of a batch that are treated at once.
ROWS = 256
NONE = np.int64(1) << 60
#: A space between two characters that aren't white space: whatever the pattern cuts, it cuts here.
INNER = r"(?<=\P{White_Space}) (?=\P{White_Space})"


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a file of ``base64 rank`` lines."""
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1")
    return sorted(ranks, key=ranks.get)


class Encoder:
    """Ranks and the splitting pattern; ``encode`` gives ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, rank = tokens, {t: i for i, t in enumerate(tokens)}
        # regex counts U+001C to U+001F as white space, the pattern's own engine doesn't
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.apart = regex.compile(INNER).split
        self.uneven = regex.compile(r" \p{White_Space}|\p{White_Space} |^ | $").search
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {(rank[t[:k]] << 20) | rank[t[k:]]: r for t, r in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank}
        self.first = np.full((256, 256), NONE)
        for x in range(256):
            for y in range(256):
                self.first[x, y] = rank.get(bytes([x, y]), NONE)
        self.bits = max(8, (4 * len(self.pairs)).bit_length())  # the pairs again, in a table with open addresses
        self.keys, self.ranks = np.full(1 << self.bits, -1), np.full(1 << self.bits, NONE)
        keys, ranks = np.fromiter(self.pairs, np.int64, len(self.pairs)), np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        at = self.slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]], self.ranks[at[free]] = keys[free], ranks[free]
            placed = self.keys[at] == keys
            self.ranks[at[placed]] = ranks[placed]
            keys, ranks, at = keys[~placed], ranks[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)
        self.memo, self.words = Memo(self.learn), Memo(self.join)

    def slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NONE if it is no token."""
        k = (a << 20) | b
        at = self.slot(k)
        there, out = self.keys[at], self.ranks[at]
        out[there != k] = NONE
        more = np.flatnonzero((there != k) & (there != -1))
        at = at[more]
        while len(more):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == k[more]
            out[more[hit]] = self.ranks[at[hit]]
            going = ~hit & (there != -1)
            more, at = more[going], at[going]
        return out

    def one(self, piece: bytes) -> bytes:
        """A long piece."""
        n, width = len(piece), 1 << max(1, (len(piece) - 1).bit_length())
        ids, pairs, none = self.byte[np.frombuffer(piece, np.uint8)].tolist(), self.pairs, 1 << 80
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (r := pairs.get((ids[i] << 20) | ids[i + 1])) is not None:
                tree[width + i] = r * width + i
        for x in range(width - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def put(i: int, value: int) -> None:
            x = width + i
            tree[x] = value
            while x > 1:
                x >>= 1
                least = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == least:
                    return
                tree[x] = least

        def value(i: int, j: int) -> int:
            r = pairs.get((ids[i] << 20) | ids[j])
            return none if r is None else r * width + i

        while (least := tree[1]) < none:
            r, i = divmod(least, width)
            j = after[i]
            k, h = after[j], before[i]
            ids[i], ids[j], after[i] = r, -1, k
            put(j, none)
            put(i, value(i, k) if k < n else none)
            if k < n:
                before[k] = i
            if h >= 0:
                put(h, value(h, i))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most ``width`` bytes, a power of two, side by side."""
        n, p = np.array([len(x) for x in pieces]), len(pieces)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(p, width)
        ids = self.byte[raw]
        at = np.arange(width)
        after, before = np.tile(at + 1, (p, 1)).ravel(), np.tile(at - 1, (p, 1)).ravel()
        tree = np.full((p, 2 * width), NONE)
        rank = self.first[raw[:, :-1], raw[:, 1:]]
        tree[:, width:-1] = np.where((rank < NONE) & (at[:-1] < n[:, None] - 1), rank * width + at[:-1], NONE)
        half = width
        while half > 1:
            half >>= 1
            tree[:, half:2 * half] = np.minimum(tree[:, 2 * half:4 * half:2], tree[:, 2 * half + 1:4 * half:2])
        flat, ids = tree.ravel(), np.where(at < n[:, None], ids, -1).ravel()

        def put(rows, i, value) -> None:
            x = width + i
            base = rows * (2 * width)
            flat[base + x] = value
            while x[0] > 1:  # all leaves lie at the same depth
                x = x >> 1
                flat[base + x] = np.minimum(flat[base + 2 * x], flat[base + 2 * x + 1])

        rows = np.flatnonzero(flat[1::2 * width] < NONE)
        while len(rows):
            least, base, end = flat[rows * 2 * width + 1], rows * width, n[rows]
            r, i = least // width, least % width
            j = after[base + i]
            k, h = after[base + j], before[base + i]
            ids[base + i], ids[base + j], after[base + i] = r, -1, k
            inner = k < end
            right = self.pair(r, ids[base + np.where(inner, k, 0)])
            put(rows, j, NONE)
            put(rows, i, np.where(inner & (right < NONE), right * width + i, NONE))
            before[base[inner] + k[inner]] = i[inner]
            has = h >= 0
            if has.any():
                left = self.pair(ids[base[has] + h[has]], r[has])
                put(rows[has], h[has], np.where(left < NONE, left * width + h[has], NONE))
            rows = rows[flat[rows * 2 * width + 1] < NONE]
        ids = ids.reshape(p, width)
        live = ids >= 0
        data, ends = ids[live].astype("<u4").tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [data[s:e] for s, e in zip([0, *ends[:-1]], ends)]

    def learn(self, fresh: list[str]) -> list[bytes]:
        """Ids of pieces."""
        raw = [s.encode("utf-8", "surrogatepass") for s in fresh]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(raw)
        for i in np.flatnonzero(size > WIDE).tolist():
            out[i] = self.one(raw[i])
        low, width = 0, 2
        while width <= WIDE:
            own = np.flatnonzero((size > low) & (size <= width)).tolist()
            for k in range(0, len(own), BLOCK):
                part = own[k:k + BLOCK]
                for i, ids in zip(part, self.many([raw[i] for i in part], width)):
                    out[i] = ids
            low, width = width, 2 * width
        return out

    def cut(self, word: str) -> list[str]:
        """A word's pieces; the pattern itself is spared for letters that end in at most one mark."""
        if word.isascii():
            if (word[1:] if word[0] == " " else word).isalpha():
                return [word]
            if word[-1] in ".,;:!?" and (word[1:-1] if word[0] == " " else word[:-1]).isalpha():
                return [word[:-1], word[-1]]
        return self.split(word)

    def join(self, fresh: list[str]) -> list[bytes]:
        """Ids of words, which may be several pieces."""
        pieces = list(map(self.cut, fresh))
        get = self.memo.hold(set().union(*pieces))
        return [get(x[0]) if len(x) == 1 else b"".join(map(get, x)) for x in pieces]

    def apart_at_spaces(self, text: str | None) -> list[str]:
        if not text:
            return []
        parts = self.apart(text) if self.uneven(text) else text.split(" ")
        return [parts[0], *[" " + x for x in parts[1:]]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        words = [self.apart_at_spaces(t) for t in texts]
        get = self.words.hold(set().union(*words))
        return [b"".join(map(get, x)) for x in words]


class Memo:
    """What ``make`` has returned, for the keys of late: a newer and an older half of bounded size."""

    def __init__(self, make):
        self.make, self.new, self.old = make, {}, {}

    def hold(self, keys: set):
        """The lookup, which from now on has ``keys``."""
        if len(self.new) > MEMO:
            self.new, self.old = {}, self.new
        fresh = keys - self.new.keys()
        kept = fresh & self.old.keys()
        self.new.update((k, self.old[k]) for k in kept)
        fresh = list(fresh - kept)
        self.new.update(zip(fresh, self.make(fresh)))
        return self.new.__getitem__


class Shared:
    """The ranks (a file's worth), broadcast; a worker builds one encoder."""

    def __init__(self, spark, path: str, pattern: str):
        self.id, self._b = uuid.uuid4().hex, spark.sparkContext.broadcast((read_ranks(path), pattern))

    @property
    def tokens(self) -> list[bytes]:
        return self._b.value[0]

    def encoder(self) -> Encoder:
        return held(self.id, lambda: Encoder(*self._b.value))


def unpack(ids: bytes, tokens: list[bytes]) -> bytes:
    """The bytes that packed ids stand for."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _chunks(texts: list, size: int = 1 << 20):
    """Runs of texts of about ``size`` characters."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``n_tokens`` and ``ids binary`` of every row: whole texts, no special tokens; ids packed little-endian.

    Null and empty texts have no tokens.  Repeated rows, null ids and further
    columns are no special cases; an empty table gives an empty result.
    """
    shared = Shared(docs.sparkSession, path, pattern)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))

    def run(batches):
        e = shared.encoder()
        for b in few(batches, ROWS):
            ids = [x for c in _chunks(b.column(len(keep)).to_pylist()) for x in e.encode(c)]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [*keep, "n_tokens", "ids"])

    kept = [x for x in rows.schema.fields if x.name != "_text"]
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (with a column ``ids`` as ``encode`` returns it) and ``decoded binary``, the bytes of its ids."""
    shared = Shared(encoded.sparkSession, path, pattern)
    at = encoded.columns.index("ids")

    def run(batches):
        for b in few(batches, ROWS):
            yield b.append_column("decoded", pa.array([unpack(x, shared.tokens) for x in b.column(at).to_pylist()], pa.binary()))

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
