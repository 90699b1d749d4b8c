"""Exact rounding helpers vs Python Decimal (ROUND_HALF_UP), many groups in one job."""
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from shelfcast.functions.rounding import avg_half_up, half_up, ratio_half_up


def _expected_avg(vals, scale, src_scale):
    d = sum(Decimal(v).scaleb(-src_scale) for v in vals) / Decimal(len(vals))
    return float(d.quantize(Decimal(1).scaleb(-scale), rounding=ROUND_HALF_UP))


def test_avg_half_up_matches_decimal(spark):
    rng = np.random.default_rng(11)
    rows, groups = [], {}
    for g in range(400):
        n = int(rng.integers(1, 40))
        vals = [int(x) for x in rng.integers(0, 5000, n)]
        if g % 7 == 0:                         # force exact .xx5 ties
            vals = [1, 2] if g % 2 else [5, 10]
        groups[g] = vals
        rows += [(g, v) for v in vals]
    df = spark.createDataFrame(rows, "g int, cents long").withColumn(
        "price", (F.col("cents") / 100).cast("decimal(10,2)"))
    out = {r.g: (r.a0, r.a2) for r in df.groupBy("g").agg(
        avg_half_up("cents", 2, 0).alias("a0"), avg_half_up("price", 2, 2).alias("a2")).collect()}
    for g, vals in groups.items():
        assert out[g][0] == _expected_avg(vals, 2, 0), g
        assert out[g][1] == _expected_avg(vals, 2, 2), g


def test_ratio_and_half_up(spark):
    r = spark.range(1).select(ratio_half_up(F.lit(29), F.lit(200), 2, 0).alias("a"),   # 0.145 -> 0.15
                              ratio_half_up(F.lit(1), F.lit(0), 2, 0).alias("z"),
                              half_up(F.lit(2.675), 2).alias("h"),
                              half_up(F.lit(-1.25), 1).alias("n")).first()
    assert r.a == 0.15 and r.z is None
    assert r.h in (2.67, 2.68)          # binary 2.675 is 2.67499...; deterministic in every engine
    assert r.n == -1.2                  # floor-based: half-up towards +infinity
