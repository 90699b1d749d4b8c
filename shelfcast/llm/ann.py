"""Nearest neighbours by inner product: a hierarchical k-means tree walked best bin first.

Vectors get one more component that makes their lengths equal, so the largest
inner product becomes the smallest distance.  The tree is fitted on a bounded
sample (``FIT_VALUES`` components, ``FIT_ROWS`` rows) and every row is filed in
its nearest leaf.  A query keeps the branches it passed in a priority queue
by the distance to their centres and visits leaves in that order; how many is
widened until a bounded set of queries, compared with brute force over all
rows, reaches ``TARGET`` recall.  A query goes on past that number until its
leaves hold enough rows for an answer.  Leaves and their visitors are dealt out in
blocks of bounded size, so a leaf that holds a third of all rows is many tasks.
Scores are sums in component order in double precision, so equal vectors have
equal scores and ties are exact.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import stage

FIT_ROWS, FIT_VALUES = 20_000, 2_000_000
BRANCH, LEAF_ROWS, LEAST_FIT = 16, 256, 8
CALIBRATION, TARGET = 200, 0.97
BLOCK_ROWS, BLOCK_QUERIES = 2048, 2048
#: Scores held at once.
PANEL = 1 << 21


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, v array<double>)``: one row per id, of the table's most frequent dimension (ties: the larger).

    Null ids and vectors that are null, empty, zero, or hold a null or
    non-finite component take no part.  Of several vectors of one id the
    largest in array order stays.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.max("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    size = sizes.first()
    return stage(rows.filter(F.size("v") == (size.d if size else 0)), "vectors")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Tree:
    """Centres of a hierarchical k-means; leaves are numbered from 0."""

    def __init__(self, rows: np.ndarray, longest: float, least: int, seed: int = 7):
        self.id, self.longest = uuid.uuid4().hex, longest
        self.centres: list[np.ndarray] = []  # by inner node
        self.children: list[list[int]] = []  # inner node, or ~leaf
        self.leaves = 0
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(self.lift(rows), least)
        del self.rng

    def lift(self, rows: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - np.einsum("ij,ij->i", rows, rows), 0)
        return np.hstack([rows, np.sqrt(rest)[:, None]])

    def aim(self, queries: np.ndarray) -> np.ndarray:
        length = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        return np.hstack([queries * (self.longest / length)[:, None], np.zeros((len(queries), 1))])

    def _grow(self, rows: np.ndarray, least: int) -> int:
        if len(rows) > least and len(different := np.unique(rows, axis=0)) > 1:
            centres = different[self.rng.choice(len(different), min(BRANCH, len(different)), replace=False)]
            for _ in range(8):
                near = nearest(rows, centres)
                n = np.bincount(near, minlength=len(centres))
                sums = np.zeros_like(centres)
                np.add.at(sums, near, rows)
                centres = sums[n > 0] / n[n > 0, None]
            near = nearest(rows, centres)
            used = np.unique(near)
            if len(used) > 1:
                node = len(self.centres)
                self.centres.append(centres[used])
                self.children.append([])
                kids = [self._grow(rows[near == c], least) for c in used]
                self.children[node] = kids
                return node
        self.leaves += 1
        return ~(self.leaves - 1)

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre at every level."""
        out, rows = np.zeros(len(rows), np.int64), self.lift(rows) if len(rows) else rows
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = ~node
            elif len(own):
                near = nearest(rows[own], self.centres[node])
                todo += [(kid, own[near == i]) for i, kid in enumerate(self.children[node])]
        return out

    def walk(self, query: np.ndarray, visits: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``visits`` leaves of an aimed query, best bin first, and more until those hold ``least`` rows; ``held`` by leaf."""
        out: list[int] = []
        queue, rows = [(0.0, self.root)], 0
        while queue and (len(out) < visits or rows < least):
            _, node = heapq.heappop(queue)
            while node >= 0:
                gap = self.centres[node] - query
                far = np.einsum("ij,ij->i", gap, gap)
                best = int(far.argmin())
                for i, kid in enumerate(self.children[node]):
                    if i != best:
                        heapq.heappush(queue, (float(far[i]), kid))
                node = self.children[node][best]
            out.append(~node)
            rows += int(held[~node]) if held is not None else 0
        return out


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    near = np.empty(len(rows), np.int64)
    size = np.einsum("ij,ij->i", centres, centres)
    for s in range(0, len(rows), 8192):
        near[s:s + 8192] = (size - 2 * rows[s:s + 8192] @ centres.T).argmin(axis=1)
    return near


def top(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
    """Each query's ``k`` best of ``rows`` (not its own id), ties to the smaller id."""
    parts = []
    order = np.argsort(ids, kind="stable")
    ids, by_dim = ids[order], np.ascontiguousarray(rows[order].T)
    step = max(1, PANEL // max(len(ids), 1))
    for s in range(0, len(queries) if len(ids) else 0, step):
        q = queries[s:s + step]
        score = np.zeros((len(q), len(ids)))
        for d in range(len(by_dim)):  # in component order: the sum of a pair never depends on its block
            score += q[:, d, None] * by_dim[d]
        for i, own in enumerate(query_ids[s:s + step]):
            x = score[i]
            mine = np.flatnonzero(ids != own)
            if len(mine) > k:
                least = np.partition(x[mine], len(mine) - k)[len(mine) - k]
                mine = mine[x[mine] >= least]
            best = mine[np.argsort(-x[mine], kind="stable")[:k]]  # ids ascend: ties to the smaller
            parts.append((np.full(len(best), own), ids[best], x[best]))
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query's candidates, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Exact answers of a bounded block of queries against all rows."""
    block = rows.sparkSession.sparkContext.broadcast((query_ids, queries))

    def run(batches):
        for b in batches:
            yield top(b.column(0).to_numpy(), matrix(b.column(1)), *block.value, k)

    return best_of(rows.select("vec_id", "v").mapInArrow(run, FOUND), k)


def fit(rows: DataFrame, n: int) -> Tree:
    """A tree for ``n`` usable rows, from a bounded sample of them by a hash of the id."""
    d = len(rows.first().v)
    bound = min(FIT_ROWS, FIT_VALUES // d)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, bound / n) * (1 << 30)))
    longest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    sample = rows.filter(part).orderBy("vec_id").limit(2 * bound).toArrow().column("v").combine_chunks()
    sample = matrix(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample)
    if not len(sample):
        sample = matrix(rows.limit(1).toArrow().column("v").combine_chunks())
    return Tree(sample, longest, max(LEAST_FIT, round(LEAF_ROWS * len(sample) / n)))


def calibrate(tree: Tree, rows: DataFrame, queries: DataFrame, k: int, target: float | None = None) -> tuple[int, float]:
    """Leaf visits, widened until ``target`` of the true neighbours of a bounded set of queries are found; the recall reached."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).toArrow()
    ids, qs = some.column("vec_id").to_numpy(), matrix(pa.concat_arrays(some.column("v").chunks))
    true = brute_force(rows, ids, qs, k).select("query_id", "vec_id").join(rows, "vec_id").select("query_id", "v").toArrow()
    if not true.num_rows:
        return 1, 1.0
    leaf = tree.leaf(matrix(pa.concat_arrays(true.column("v").chunks)))
    place = {q: {x: i for i, x in enumerate(tree.walk(a, tree.leaves))} for q, a in zip(ids.tolist(), tree.aim(qs))}
    target = TARGET if target is None else target
    need = np.sort([place[q][x] + 1 for q, x in zip(true.column("query_id").to_pylist(), leaf.tolist())])
    visits = int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)])
    return visits, float((need <= visits).mean())


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row whose id is divisible by ``every``.

    Candidates are all usable rows but those of the query's id; fewer than
    ``k`` are all returned.  Ties go to the smaller id.  See ``usable`` for
    the rows that take part; other columns are ignored, and a table
    without usable rows gives an empty result.
    """
    spark, rows = vectors.sparkSession, usable(vectors, id_col, vec_col)
    n = rows.count()
    queries = rows.filter(F.col("vec_id") % every == 0)
    if not n or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = fit(rows, n)
    visits, _ = calibrate(tree, rows, queries, k)
    shared = spark.sparkContext.broadcast(tree)

    def file(batches):
        for b in batches:
            yield b.append_column("leaf", pa.array(shared.value.leaf(matrix(b.column(1)))))

    def visit(batches):
        for b in batches:
            walks = [shared.value.walk(q, visits, held.value, k + 1) for q in shared.value.aim(matrix(b.column(1)))]
            at = np.repeat(np.arange(len(walks)), [len(w) for w in walks])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.concatenate(walks).astype(np.int64))], ["query_id", "leaf"])

    filed = stage(rows.mapInArrow(file, "vec_id long, v array<double>, leaf long"), "filed")
    counts = np.zeros(tree.leaves, np.int64)
    for r in filed.groupBy("leaf").count().collect():
        counts[r.leaf] = r["count"]
    held = spark.sparkContext.broadcast(counts)  # k rows beside the query's own
    visited = stage(queries.repartition(max(8, spark.sparkContext.defaultParallelism), "vec_id").select("vec_id", "v")
                    .mapInArrow(visit, "query_id long, leaf long"), "visits")
    blocks = (filed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("row_blocks"))
              .join(visited.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks")), "leaf"))

    def deal(x: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row to its own block, once for each block of the other side."""
        x = x.join(blocks, "leaf").withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int"))
        return x.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))

    cell = ["leaf", "row_block", "query_block"]
    right = deal(filed, "vec_id", "row_block", "query_block").select(*cell, "vec_id", "v")
    aims = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    left = deal(visited, "query_id", "query_block", "row_block").join(aims, "query_id").select(*cell, "query_id", "q")

    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.Table.from_batches([top(*[np.zeros(0, np.int64), np.zeros((0, 0))] * 2, k)])
        one = lambda t, c: pa.concat_arrays(t.column(c).chunks)
        return pa.Table.from_batches([top(one(r, "vec_id").to_numpy(), matrix(one(r, "v")), one(q, "query_id").to_numpy(), matrix(one(q, "q")), k)])

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(compare, FOUND)
    return best_of(found, k)
