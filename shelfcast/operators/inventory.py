"""Inventory planning (I1-I13): recent demand statistics, policy and risk per series.

One pass: the last 90 days per series (window rank within the series, at
most one row per day, so a group is bounded by the calendar), then joins on
the series key with the lead-time forecast, the on-hand snapshot and the
product costs.  No per-series driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions import inventory as inv
from shelfcast.functions.rounding import half_up

SERIES = ["item_id", "store_id"]
RECENT_DAYS = 90
DEFAULT_UNIT_COST = 5.00


def pop_std_from_sums(n: Column, s: Column, ss: Column) -> Column:
    """Population std from count, sum and sum of squares of integers (exact until sqrt)."""
    return F.sqrt((n * ss - s * s).cast("double") / (n * n).cast("double"))


def samp_std_from_sums(n: Column, s: Column, ss: Column) -> Column:
    """Sample std from integer sums; null for fewer than 2 values."""
    return F.when(n > 1, F.sqrt((n * ss - s * s).cast("double") / (n * (n - 1)).cast("double")))


def recent_stats(sales: DataFrame, last_n: int = RECENT_DAYS, units: str = "sales_units") -> DataFrame:
    """Mean, max and population std of each series' last ``last_n`` daily rows."""
    w = Window.partitionBy(*SERIES).orderBy(F.col("date_str").desc())
    u = F.col(units).cast("long")
    recent = sales.select(*SERIES, "date_str", units).withColumn("_rn", F.row_number().over(w)) \
                  .filter(F.col("_rn") <= last_n)
    agg = recent.groupBy(*SERIES).agg(F.count(u).alias("_n"), F.sum(u).alias("_s"),
                                      F.sum(u * u).alias("_ss"), F.max(u).alias("max_demand"))
    n, s, ss = F.col("_n"), F.col("_s"), F.col("_ss")
    return agg.select(*SERIES, (s / n).alias("avg_demand"), pop_std_from_sums(n, s, ss).alias("std_demand"),
                      F.col("max_demand").cast("double").alias("max_demand"))


def lead_time_forecast(forecasts: DataFrame, horizon: int = 7) -> DataFrame:
    """Sum of the forward forecast (actual is null) of the given horizon per series.

    Forecasts are stored in cents, so the sum is taken exactly in cents: the
    order quantity applies ``ceil`` to it and must not depend on summation order.
    """
    return (forecasts.filter(F.col("actual_demand").isNull() & (F.col("horizon_days") == horizon))
            .groupBy(*SERIES)
            .agg((F.sum(F.round(F.col("forecast_demand") * F.lit(100.0)).cast("long")) / F.lit(100.0))
                 .alias("forecast_lead_time_demand")))


def recommendations(sales: DataFrame, forecasts: DataFrame, on_hand: DataFrame,
                    products: DataFrame, lead_time: int = inv.DEFAULT_LEAD_TIME_DAYS,
                    z: float = inv.DEFAULT_SERVICE_LEVEL_Z, stats: DataFrame | None = None,
                    evaluation_date: Column | None = None) -> DataFrame:
    """fact_inventory_recommendations for every series in ``sales``.

    ``on_hand`` is the snapshot (item_id, store_id, current_inventory);
    series missing from it count as 0 on hand.
    """
    stats = stats if stats is not None else recent_stats(sales)
    eval_date = evaluation_date if evaluation_date is not None else sales.agg(F.max("date_str")).scalar()
    fc = lead_time_forecast(forecasts, lead_time)
    cost = products.select("item_id", F.col("unit_cost").cast("double").alias("_cost"))
    df = (stats.join(fc, SERIES, "left").join(on_hand, SERIES, "left").join(cost, "item_id", "left"))
    avg, std, mx = F.col("avg_demand"), F.col("std_demand"), F.col("max_demand")
    onh = F.coalesce(F.col("current_inventory"), F.lit(0))
    fc_lt = F.coalesce(F.col("forecast_lead_time_demand"), avg * F.lit(lead_time))
    ss = inv.safety_stock(mx, avg, std, lead_time, z)
    df = df.select(*SERIES, onh.alias("current_inventory"), avg.alias("_avg"), std.alias("_std"),
                   fc_lt.alias("_fc"), ss.alias("safety_stock"),
                   F.coalesce(F.col("_cost"), F.lit(DEFAULT_UNIT_COST)).alias("unit_cost"))
    rop = inv.reorder_point("_avg", lead_time, "safety_stock")
    qty = inv.order_quantity("_fc", "safety_stock", "current_inventory")
    df = df.withColumn("reorder_point", rop).withColumn("recommended_order_qty", qty) \
           .withColumn("average_daily_demand", half_up("_avg", 2))
    level, status, days = inv.risk_class("current_inventory", "reorder_point", "safety_stock",
                                         "average_daily_demand", lead_time)
    return df.select(
        eval_date.alias("evaluation_date"), *SERIES, "current_inventory", "average_daily_demand",
        half_up("_std", 2).alias("demand_std_dev"), F.lit(lead_time).alias("lead_time_days"),
        "safety_stock", "reorder_point", half_up("_fc", 2).alias("forecast_demand_lt"),
        "recommended_order_qty", inv.days_of_supply("current_inventory", "_avg").alias("days_of_supply"),
        "unit_cost", inv.order_cost("recommended_order_qty", "unit_cost").alias("estimated_order_cost"),
        status.alias("inventory_status"), level.alias("risk_level"),
        inv.stockout_risk("current_inventory", "safety_stock", "average_daily_demand", lead_time)
        .alias("stockout_risk_pct"),
        inv.overstock_risk("current_inventory", "average_daily_demand", lead_time).alias("overstock_risk_pct"),
        F.date_format(F.date_add(F.to_date(eval_date), days), "yyyy-MM-dd").alias("suggested_replenishment_date"))
