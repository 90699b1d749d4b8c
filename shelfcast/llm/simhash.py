"""SimHash near-duplicates: 64-bit fingerprints linked through a Gray-order hierarchical index.

Fingerprints are deduplicated first, so exact copies are one row however many
there are.  Two fingerprints within three bits agree on one of four 16-bit
blocks; a block value's fingerprints form a top node of the index.  A node
that holds too many splits again by four disjoint nibble columns and then by
four bit columns of the word (the same pigeonhole argument), so no group is
unbounded.  Inside a node the fingerprints are sorted by Gray rank, runs of
neighbours are factored into upper nodes that keep the bits all members share
(mask and pattern), and pairs of nodes are walked from the top: the bits that
both nodes fix give a lower bound on every difference below, and a pair
beyond the maximum is dropped with all its members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import connected_components, join_forest, let_go, slabs, stage

FAN_OUT = 4
#: A group of more fingerprints is split by further columns.
SPLIT_ROWS = 4096
#: Rows of an index that is built at once, and pairs of nodes that are widened at once.
SLAB_ROWS, SLAB_PAIRS = 200_000, 400_000
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``k`` lower-cased words; of all words if fewer; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    del words
    starts = np.concatenate(([0], ends[:-k])).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], 42) for s, e in zip(starts, (ends[k - 1:] - 1).tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``."""
    n = len(hashes)
    if not n:
        return 0
    lanes, cuts = np.uint64(0x0101010101010101), np.arange(0, n, 255)
    counts = np.empty((8, 8), np.int64)  # [bit of the byte, byte]
    for j in range(8):  # eight one-byte counters in a word hold 255 additions
        sums = np.add.reduceat((hashes >> np.uint64(j)) & lanes, cuts)
        counts[j] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = 2 * counts > n
    return sum(1 << (8 * byte + j) for j in range(8) for byte in range(8) if bits[j, byte])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` for every row; fp holds the unsigned bits, 0 for null, empty or blank text."""
    def run(batches):
        let_go()
        for b in batches:
            fps = [majority(shingle_hashes(t, shingle)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the Gray-code order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class Level:
    """Nodes of one height: the bits that all members share, and each node's children."""

    def __init__(self, group, mask, pattern, lo=None, hi=None):
        self.group, self.mask, self.pattern, self.lo, self.hi = group, mask, pattern, lo, hi

    def above(self) -> "Level":
        """Runs of FAN_OUT neighbours of the same group."""
        n = len(self.group)
        first = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]])
        rank = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
        lo = np.flatnonzero(rank % FAN_OUT == 0)
        ones = np.bitwise_and.reduceat(self.pattern & self.mask, lo)
        any_one = np.bitwise_or.reduceat(self.pattern, lo)
        mask = np.bitwise_and.reduceat(self.mask, lo) & (ones | ~any_one)
        return Level(self.group[lo], mask, ones & mask, lo, np.r_[lo[1:], n])


def links(group: np.ndarray, fp: np.ndarray, bits: int):
    """Yield index arrays (a, b), a < b, of all pairs of a group that differ in 1 to ``bits`` bits.

    ``group`` and then the Gray rank of ``fp`` must be ascending.
    """
    levels = [Level(group, np.full(len(fp), ONES), fp)]
    while len(levels[-1].group) > len(np.unique(group)):
        levels.append(levels[-1].above())
    top = np.arange(len(levels[-1].group))
    todo = [(len(levels) - 1, top, top)]
    while todo:
        at, a, b = todo.pop()
        if at == 0:
            apart = a != b
            yield a[apart], b[apart]
            continue
        if len(a) > SLAB_PAIRS // FAN_OUT**2:
            half = len(a) // 2
            todo += [(at, a[half:], b[half:]), (at, a[:half], b[:half])]
            continue
        up, low = levels[at], levels[at - 1]
        wide_b = up.hi[b] - up.lo[b]
        n = (up.hi[a] - up.lo[a]) * wide_b
        pair = np.repeat(np.arange(len(a)), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        x, y = up.lo[a][pair] + k // wide_b[pair], up.lo[b][pair] + k % wide_b[pair]
        near = (x <= y) & (np.bitwise_count((low.pattern[x] ^ low.pattern[y]) & low.mask[x] & low.mask[y]) <= bits)
        todo.append((at - 1, x[near], y[near]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _columns(kind: int) -> list[int]:
    """Four disjoint masks that cover the word: 16-bit blocks, nibble columns or bit columns."""
    base, step = ((0xFFFF, 16), (0x000F000F000F000F, 4), (0x1111111111111111, 1))[kind]
    return [_signed(base << (step * i)) for i in range(4)]


def _split(rows: DataFrame, kind: int) -> DataFrame:
    masks = F.explode(F.array(*[F.lit(m).cast("long") for m in _columns(kind)]))
    return (rows.select("fp", "rep", F.col("mask"), masks.alias("_m")).withColumn("mask", F.col("mask").bitwiseOR(F.col("_m")))
            .select("fp", "rep", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")))


def near_pairs(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Edges ``(a, b)`` between the ``rep`` of fingerprints ``(fp, rep)`` at most ``bits`` (0 to 3) apart.

    Of each group's pairs, the edges of a spanning forest are kept: the same
    components with fewer rows than fingerprints.
    """
    if not 0 <= bits <= 3:
        raise ValueError("four blocks find pairs of at most three differing bits")
    rows, done = _split(fps.withColumn("mask", F.lit(0).cast("long")), 0), []
    for kind in (1, 2):
        large = stage(rows.groupBy("mask", "key").count().filter(F.col("count") > SPLIT_ROWS).select("mask", "key", F.lit(True).alias("large")), "large")
        if large.isEmpty():
            break
        marked = rows.join(large, ["mask", "key"], "left")
        done.append(marked.filter("large is null").select("fp", "rep", "mask", "key"))
        rows = _split(marked.filter("large"), kind)
    for r in done:
        rows = rows.unionByName(r)

    def run(batches):
        for t in slabs(batches, ["mask", "key"], SLAB_ROWS):
            fp, mask, key = (t.column(c).to_numpy().view(np.uint64) for c in ("fp", "mask", "key"))
            group = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            order = np.lexsort((gray_rank(fp), group))
            group, fp, rep = group[order], fp[order], t.column("rep").to_numpy()[order]
            several = np.bincount(group)[group] > 1
            group, fp, rep = group[several], fp[several], rep[several]
            if not len(fp):
                continue
            labels = np.arange(len(fp))
            for a, b in links(group, fp, bits):
                join_forest(labels, a, b)
            own = labels != np.arange(len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[labels[own]])], ["a", "b"])

    return (rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
            .select("fp", "rep", "mask", "key").mapInArrow(run, "a long, b long"))


def simhash_components(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id that links of at most ``bits`` bits
    reach.  Null, empty and blank texts have fingerprint 0 and link like any
    other; texts with fewer words than a shingle hash as one sequence.
    Repeated rows stay repeated.  A null doc_id keeps its row and never is a
    component's id unless no other id has its fingerprint; then the
    component of that fingerprint is null.  Other columns are ignored; an
    empty table gives an empty result.
    """
    own = stage(fingerprints(docs, shingle), "fingerprints")
    fps = stage(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    known = fps.filter("rep is not null")
    parts = connected_components(near_pairs(known, bits))
    whose = (fps.join(parts, fps.rep == parts.node, "left")
             .select("fp", F.coalesce("component", "rep").alias("component_id")))
    return own.join(whose, "fp").select("doc_id", "fp", "component_id")


def hex16(c) -> Column:
    """16 lower-case hex digits of a long's bits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; copies of a kept row's doc_id stay too."""
    kept = (simhash_components(docs, shingle, bits).filter("doc_id <=> component_id or doc_id is null")
            .select(F.col("doc_id").alias("_kept_id")).distinct())
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept_id"]), "left_semi")
