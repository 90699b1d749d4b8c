"""Driver-table adapter invariants (the retail model derived from order lines)."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from shelfcast.plans.warehouse import Warehouse
from shelfcast.sources import adapter


def test_series_and_facts(spark):
    w = Warehouse(spark, SF_SMALL)
    fs = w.fact_sales
    # one row per series and day, units are the line quantities
    assert fs.count() == fs.select("item_id", "store_id", "date_str").distinct().count()
    total = adapter.read_table(spark, SF_SMALL, "lineitem").agg(F.sum("l_quantity")).first()[0]
    assert fs.agg(F.sum("sales_units")).first()[0] == int(total)
    # items belong to exactly one department, stores to one state
    assert fs.groupBy("item_id").agg(F.countDistinct("dept_id").alias("n")).filter("n > 1").count() == 0
    assert fs.groupBy("store_id").agg(F.countDistinct("state_id").alias("n")).filter("n > 1").count() == 0
    assert {r.cat_id for r in fs.select("cat_id").distinct().collect()} <= {"FOODS", "HOBBIES", "HOUSEHOLD"}


def test_price_list_has_gaps_and_cents(spark):
    w = Warehouse(spark, SF_SMALL)
    daily = w.daily
    # some series-days fall in weeks without an invoiced price -> default 5.00
    assert daily.filter(F.col("sell_price") == 5).count() > 0
    prices = w.fact_prices
    cents = F.col("sell_price") * 100
    assert prices.filter(F.abs(cents - F.round(cents)) > 1e-6).count() == 0       # whole cents
    assert prices.count() == prices.select("store_id", "item_id", "wm_yr_wk").distinct().count()


def test_raw_feeds_are_dirty(spark):
    w = Warehouse(spark, SF_SMALL)
    q = w.raw_prices
    assert q.filter(F.col("sell_price").isNull()).count() > 0          # open lines: no price yet
    assert q.filter(F.col("sell_price") < 0).count() > 0               # returned lines: refunds
    assert q.count() > q.select("store_id", "item_id", "wm_yr_wk").distinct().count()   # duplicates
    cal = w.raw_calendar
    assert cal.count() > cal.select("date").distinct().count()
    cleaned = w.clean_prices
    assert cleaned.filter(F.col("sell_price") <= 0).count() == 0


def test_week_code_and_weekday_numbering(spark):
    row = spark.range(1).select(
        F.lit("2021-01-03").cast("date").alias("d")).select(
        __import__("shelfcast.functions.calendar", fromlist=["x"]).wm_yr_wk("d").alias("wk"),
        F.dayofweek("d").alias("wday")).first()
    # 2021-01-03 is a Sunday in ISO week 53 of ISO year 2020 -> '1' || '20' || '53'
    assert row.wk == 12053 and row.wday == 1
