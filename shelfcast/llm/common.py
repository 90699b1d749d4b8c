"""Helpers shared by the text operators: staged tables, connected components, batches."""

from __future__ import annotations

import gc
from typing import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import shared_dir

#: ASCII white space; everything between is a word (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether Spark removes a statement's shuffle files when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``free`` removes the shuffle files of the write at once, not when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    if free:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


_held: dict[str, object] = {}


def held(key: str, build: Callable[[], object]) -> object:
    """What ``build`` gives, kept by a worker under ``key`` until another key is asked for: one model at a time.

    Workers outlive a stage; so the model of one operator doesn't stay in memory under the next.
    """
    if key not in _held:
        _held.clear()
        gc.collect()  # a model may refer to itself
        pa.default_memory_pool().release_unused()
        _held[key] = build()
    return _held[key]


def let_go() -> None:
    """Drop the model that this worker holds of an earlier operator."""
    held("", lambda: None)


def few(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that their Python objects stay few; what Arrow's pool keeps of past batches goes back to the system."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)
        pa.default_memory_pool().release_unused()
    b = None
    pa.default_memory_pool().release_unused()


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of ``edges(a, b)`` (long) as ``(node, component)``, component = smallest node.

    Large-star and small-star rounds alternate until the edge set no longer
    changes: every node then points at its component's smallest node.  The
    minimum of a neighbourhood is an aggregate (combined before the shuffle)
    joined back on the node, so a hub's edges never meet in one task.  Each
    round is a staged table.  Null ends and self loops are ignored; nodes
    without an edge do not appear; no edges give an empty result.
    """
    def smallest(links: DataFrame) -> DataFrame:
        return links.groupBy("a").agg(F.min("b").alias("m"))

    def signature(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
              .filter("a is not null and b is not null and a <> b").distinct(), "edges")
    seen = signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.join(smallest(both), "a").filter(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct())
        low = smallest(large)
        small = (large.join(low, "a").filter(F.col("b") != F.col("m"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b")))).distinct()
        e = stage(small, "edges")
        last, seen = seen, signature(e)
        if last == seen:
            break
    nodes = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def join_forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of ``a[i]`` and ``b[i]`` in ``labels`` (each entry points at its set's smallest index)."""
    while len(a):
        ra, rb = labels[a], labels[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def slabs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``: at least ``rows`` rows, or what is left."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        t = pa.Table.from_batches(held)
        other = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            other |= v[1:] != v[:-1]
        cut = np.flatnonzero(other)
        if len(cut):
            yield t.slice(0, int(cut[-1]) + 1)
            held = t.slice(int(cut[-1]) + 1).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
