"""Exact quantiles of any number of values, without sorting them or gathering them in one task.

A quantile lies between two order statistics.  A mergeable sketch (KLL) of the
values gives a narrow band around each; one more aggregate counts what lies
below the band, on its edges and inside it, which shows whether the wanted
place is an edge or inside.  Bands that still hold too many values are narrowed
again by a sketch of their own values, so each pass leaves a small share of the
last one; at most ``GATHERED`` values inside a band are gathered at the end.
Values on an edge are only counted, so a value that a third of all rows have
costs nothing.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch, and the share of the values on each side of the sketched place that a band takes in.
SKETCH_K, MARGIN = 4096, 0.004
#: Values that a final band may hold.
GATHERED = 10_000
#: Narrowing passes before giving up (each leaves about two margins of the values, so a handful is enough for any table).
PASSES = 30


class _Band:
    """The open interval (lo, hi) that holds the order statistic ``rank``, ``below`` values at or under lo, ``inside`` values in it."""

    def __init__(self, rank: int, inside: int):
        self.rank, self.below, self.inside, self.margin = rank, 0, inside, MARGIN
        self.lo: float | None = None  # None: no edge yet
        self.hi: float | None = None
        self.value: float | None = None

    def has(self, v: Column) -> Column:
        above = F.lit(True) if self.lo is None else v > self.lo
        return above if self.hi is None else above & (v < self.hi)

    def holds(self, x: float) -> bool:
        return (self.lo is None or self.lo < x) and (self.hi is None or x < self.hi)

    def narrow(self, a: float, b: float, under: int, at_a: int, between: int, at_b: int) -> None:
        """Edges a <= b inside the interval, ``under`` values of the interval below a, and so on."""
        r = self.rank - self.below
        if r < under:
            self.hi, self.inside = a, under
            self.margin *= 2  # the sketch was further off than the margin
        elif r < under + at_a:
            self.value = a
        elif r < under + at_a + between:
            self.lo, self.hi, self.below, self.inside = a, b, self.below + under + at_a, between
        elif r < under + at_a + between + at_b:
            self.value = b
        else:
            self.lo, self.below = b, self.below + under + at_a + between + at_b
            self.inside -= under + at_a + between + at_b
            self.margin *= 2


def _order_statistics(values: DataFrame, ranks: Sequence[int], n: int, gathered: int) -> dict[int, float]:
    v = F.col("v")
    bands = [_Band(r, n) for r in sorted(set(ranks))]
    for _ in range(PASSES):
        wide = [b for b in bands if b.value is None and b.inside > gathered]
        if not wide:
            break
        places = [((b.rank - b.below) / b.inside, b.margin) for b in wide]
        sketches = values.agg(*[F.kll_sketch_agg_double(F.when(b.has(v), v), F.lit(SKETCH_K)).alias(f"s{i}") for i, b in enumerate(wide)])
        edges = sketches.select(*[F.kll_sketch_get_quantile_double(f"s{i}", F.lit(min(1.0, max(0.0, p + side * m)))).alias(f"{name}{i}")
                                  for i, (p, m) in enumerate(places) for name, side in (("a", -1), ("b", 1))]).first()
        counts = []
        for i, band in enumerate(wide):
            a, b, own = edges[f"a{i}"], edges[f"b{i}"], band.has(v)
            counts += [F.count_if(own & c).alias(f"{k}{i}") for k, c in
                       (("under", v < a), ("at_a", v == a), ("between", (v > a) & (v < b)), ("at_b", (v == b) & F.lit(a != b)))]
        got = values.agg(*counts).first()
        for i, band in enumerate(wide):
            band.narrow(edges[f"a{i}"], edges[f"b{i}"], *[got[f"{k}{i}"] for k in ("under", "at_a", "between", "at_b")])
    else:
        raise RuntimeError("quantile bands that don't narrow")
    last = [b for b in bands if b.value is None]
    if last:
        kept = values.filter(reduce(Column.__or__, [b.has(v) for b in last]))
        histogram = sorted((r.v, r.n) for r in kept.groupBy("v").agg(F.count("*").alias("n")).collect())
        for b in last:
            at = b.below
            for value, count in histogram:
                if b.holds(value):
                    at += count
                    if b.rank < at:
                        b.value = value
                        break
    return {b.rank: b.value for b in bands}


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], gathered: int = GATHERED) -> list[float | None]:
    """The quantiles of a numeric column by linear interpolation; None without values.  Null and NaN don't count.

    ``df`` is read two times a pass: pass it staged (or read from a table) if it is costly to compute.  At
    most ``gathered`` values for each order statistic, and four counts a pass, reach the driver.
    """
    v = F.col(column).cast("double")
    values = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n = values.count()
    if not n:
        return [None] * len(probs)
    places = [p * (n - 1) for p in probs]
    ranks = [r for x in places for r in (math.floor(x), math.ceil(x))]
    found = _order_statistics(values, ranks, n, gathered)

    def between(x: float) -> float:
        lo, hi = found[math.floor(x)], found[math.ceil(x)]
        return lo if lo == hi else lo + (hi - lo) * (x - math.floor(x))

    return [between(x) for x in places]
