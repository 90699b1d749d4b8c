"""Exact quantiles against numpy: ties, hot values, few and many values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import clean, quality, quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("gathered", [1, 50, 10_000])
def test_against_numpy(spark, gathered):
    rng = random.Random(gathered)
    cases = [
        [], [3.0], [3.0, 1.0], [5.0] * 400, list(range(700)), [rng.choice([1.0, 2.5, 7.0]) for _ in range(999)],
        [7.0] * 500 + [7 + i / 1000 for i in range(1, 501)], [rng.gauss(0, 1) for _ in range(801)] + [float("inf")],
    ]
    for values in cases:
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(3)
        got = quantiles.exact_quantiles(df, "x", PROBS, gathered)
        if not values:
            assert got == [None] * len(PROBS)
        else:
            s = sorted(values)
            want = []
            for p in PROBS:
                at = p * (len(s) - 1)
                lo, hi = s[int(np.floor(at))], s[int(np.ceil(at))]
                want.append(lo if lo == hi else lo + (hi - lo) * (at - np.floor(at)))
            assert got == want or np.allclose(got, want, equal_nan=True)


def test_a_million_distinct_values_in_bounded_steps(spark, monkeypatch):
    """No more than GATHERED values are ever gathered, and a third of the rows on one value is no burden."""
    df = spark.range(1_000_000).select((F.xxhash64("id") % 1_000_000_007).cast("double").alias("x"))
    df = df.unionByName(spark.range(500_000).select(F.lit(12345.0).alias("x")))
    values = np.sort(np.array([r.x for r in df.collect()]))
    sizes, collect = [], type(df).collect

    def counted(self):
        rows = collect(self)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(type(df), "collect", counted)
    got = quantiles.exact_quantiles(df, "x", [0.5, 0.9])
    assert sizes and max(sizes) <= 4 * quantiles.GATHERED
    for p, x in zip([0.5, 0.9], got):
        at = p * (len(values) - 1)
        lo, hi = values[int(np.floor(at))], values[int(np.ceil(at))]
        assert x == lo + (hi - lo) * (at - np.floor(at))


def test_median_is_taken_before_rounding(spark):
    rows = [("a", "x", 1, "1.004"), ("b", "x", 1, "1.006"), ("c", "x", 1, "-3"), ("d", "x", 1, None), ("e", "x", 1, "n/a")]
    df = spark.createDataFrame(rows, "store_id string, item_id string, wm_yr_wk int, sell_price string").withColumn("ingest_ord", F.monotonically_increasing_id())
    got = {r.store_id: r.sell_price for r in clean.clean_prices(df).collect()}
    # the median of 1.004 and 1.006 is 1.005, of 1.00 and 1.01 it would be too, but of cents rounded first 1.01 or 1.00
    assert got["a"] == 1.0 and got["b"] == 1.01 and got["c"] == got["d"] == got["e"] == 1.01
    none = clean.clean_prices(df.filter("store_id in ('c', 'd')")).collect()
    assert [r.sell_price for r in none] == [None, None]


def test_plans_have_no_global_percentile(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "sales_units int")
    plan = quality.check_sales_outliers(df)._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()
