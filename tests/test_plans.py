"""Plan-shape guards: the physical plans the scale design relies on."""
import pytest

from conftest import SF_SMALL

import sys, os
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from plan_report import summarize  # noqa: E402


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["int_daily_sales", "features", "inventory_recommendations",
                                  "scenario_impact", "clean_and_melt_sales", "quality_checks"])
def test_no_cartesian_products(spark, name):
    import __spark_entry__ as E
    s = summarize(_plan(E.queries()[name](spark, SF_SMALL)))
    assert s["cartesian"] == 0
    assert s["python"] == 0


def test_features_single_series_shuffle(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["features"](spark, SF_SMALL))
    s = summarize(plan)
    assert s["windows"] == 2 and s["cartesian"] == 0
    # the series windows share one shuffle and one sort; the others are the day totals' own
    assert plan.split("Window", 2)[-1].split("Exchange", 1)[1].startswith(" hashpartitioning(item_id")


def test_scan_pruning_and_fixed_broadcasts(spark):
    from shelfcast.sources import adapter
    plan = _plan(adapter.series_days(spark, SF_SMALL))
    assert "ReadSchema: struct<l_orderkey" not in plan or "l_comment" not in plan
    assert "BroadcastExchange" in plan
    li = [line for line in plan.splitlines() if "lineitem.parquet" in line]
    assert li and all("l_discount" not in line for line in li)


def test_day_totals_are_joined_as_the_planner_sizes_them(spark):
    import __spark_entry__ as E
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(E.queries()["features"](spark, SF_SMALL))
        assert "SortMergeJoin" in plan and "CartesianProduct" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_writers_split_large_periods(spark):
    import glob
    import tempfile
    from shelfcast.sources import io
    root = tempfile.mkdtemp(prefix="shelfcast-files-")
    df = spark.range(40000).selectExpr("concat('s', id % 7) AS store_id", "concat('i', id % 50) AS item_id",
                                       "CASE WHEN id < 39000 THEN '2023-01-05' ELSE '2023-02-01' END AS date_str", "id AS sales_units")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        io.write_fact_layout(df, f"{root}/months", "date_str")
        io.write_bucketed(df.repartition(12), "t_one_file", f"{root}/buckets", ["item_id", "store_id"], 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sql("DROP TABLE IF EXISTS t_one_file")
    assert len(glob.glob(f"{root}/months/month=2023-01/*.parquet")) > 1    # the large month is several tasks
    assert len(glob.glob(f"{root}/buckets/*.parquet")) == 4                # one file a bucket


def test_keep_first_hot_key_is_partial_aggregate(spark):
    from pyspark.sql import functions as F
    from shelfcast.operators import clean
    # one key holds most rows: keep-first must combine map-side (partial aggregate), not window
    df = spark.range(20000).select(F.when(F.col("id") < 15000, F.lit(0)).otherwise(F.col("id")).alias("k"),
                                   F.col("id").alias("ingest_ord"), (F.col("id") * 3).alias("v"))
    out = clean.keep_first(df, ["k"])
    plan = _plan(out)
    assert "Window" not in plan
    assert plan.count("Aggregate") >= 2      # partial + final
    first = out.filter("k = 0").first()
    assert first.ingest_ord == 0 and first.v == 0
    assert out.count() == 5001


def test_bucketed_facts_reuse_partitioning(spark):
    import tempfile
    from shelfcast.operators import features as fe
    from shelfcast.plans.warehouse import Warehouse
    from shelfcast.sources import io
    root = tempfile.mkdtemp(prefix="shelfcast-bkt-")
    w = Warehouse(spark, SF_SMALL)
    keys = ["item_id", "store_id"]
    fs = io.write_bucketed(w.fact_sales, "t_fs_bkt", f"{root}/fs", keys, 8, keys + ["date_str"])
    fp = io.write_bucketed(w.fact_prices, "t_fp_bkt", f"{root}/fp", keys, 8)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = fe.load_base(fs, w.dim_calendar, fp)
        feat = fe.add_price_change(fe.add_rolling_std(fe.add_rolling_mean(fe.add_lags(base))))
        plan = _plan(feat)
        assert "SortMergeJoin" in plan                      # the price join is a shuffle join ...
        assert "Exchange hashpartitioning" not in plan      # ... that, like the windows, reads the buckets
        assert feat.count() == w.fact_sales.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
