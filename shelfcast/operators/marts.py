"""SQL models (T1-T11): staging views, intermediate tables and marts.

Money is DECIMAL end to end (exact sums; averages rounded half-up in the
integer domain) and is only turned into doubles by the caller's output step.
The calendar join uses a broadcast hint: one row per day, bounded by the
calendar span, never by the volume of sales.  The store dimension is joined
after the per-store aggregate (one row per store on both sides).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.rounding import avg_half_up

# Default price for weeks without a listed price, category revenue columns
DEFAULT_PRICE = "5.00"
CATEGORY_COLUMNS = [("FOODS", "foods_revenue"), ("HOBBIES", "hobbies_revenue"),
                    ("HOUSEHOLD", "household_revenue")]


def stg_sales(fact_sales: DataFrame) -> DataFrame:
    """T1."""
    u = F.col("sales_units")
    return fact_sales.select("id", "item_id", "dept_id", "cat_id", "store_id", "state_id",
                             "date_str", u.cast("int").alias("sales_units"),
                             F.when(u > 0, 1).otherwise(0).alias("is_active_sale"))


def stg_calendar(dim_calendar: DataFrame) -> DataFrame:
    """T2 (is_weekend: wday in (1, 2), as the source model defines it)."""
    c = F.col

    def _none(x):
        return F.coalesce(c(x), F.lit("None")).alias(x)

    def _zero(x):
        return F.coalesce(c(x), F.lit(0)).cast("int").alias(x)

    return dim_calendar.select(
        "date_str", c("wm_yr_wk").cast("int").alias("wm_yr_wk"), "weekday",
        c("wday").cast("int").alias("wday"), c("month").cast("int").alias("month"),
        c("year").cast("int").alias("year"), "d_id",
        _none("event_name_1"), _none("event_type_1"), _none("event_name_2"), _none("event_type_2"),
        _zero("snap_CA"), _zero("snap_TX"), _zero("snap_WI"), _zero("is_holiday"),
        F.when(c("wday").isin(1, 2), 1).otherwise(0).alias("is_weekend"))


def stg_prices(fact_prices: DataFrame) -> DataFrame:
    """T3."""
    return fact_prices.select("store_id", "item_id", F.col("wm_yr_wk").cast("int").alias("wm_yr_wk"),
                              F.col("sell_price").cast("decimal(10,2)").alias("sell_price"))


def snap_for_state(state_col: str = "state_id"):
    s = F.col(state_col)
    return (F.when(s == "CA", F.col("snap_CA")).when(s == "TX", F.col("snap_TX"))
            .when(s == "WI", F.col("snap_WI")).otherwise(F.lit(0)))


def int_daily_sales(stg_sales_df: DataFrame, stg_calendar_df: DataFrame, stg_prices_df: DataFrame,
                    default_price: str = DEFAULT_PRICE) -> DataFrame:
    """T4: sales INNER calendar (broadcast) LEFT prices on (store, item, week).

    The price join is a shuffle (sort-merge) join on the composite key; the
    price list grows with stores x items x weeks, so it is never broadcast
    blindly - the planner does it only under the size threshold.
    """
    cal = stg_calendar_df.select("date_str", "wm_yr_wk", "weekday", "wday", "month", "year",
                                 "event_name_1", "event_type_1", "is_holiday", "is_weekend",
                                 "snap_CA", "snap_TX", "snap_WI")
    joined = (stg_sales_df.join(F.broadcast(cal), "date_str", "inner")
              .join(stg_prices_df, ["store_id", "item_id", "wm_yr_wk"], "left"))
    price = F.coalesce(F.col("sell_price"), F.lit(default_price).cast("decimal(10,2)"))
    return joined.select(
        "id", "item_id", "dept_id", "cat_id", "store_id", "state_id", "date_str",
        "wm_yr_wk", "weekday", "wday", "month", "year", "event_name_1", "event_type_1",
        "is_holiday", "is_weekend", snap_for_state().alias("is_snap_day"), "sales_units",
        price.alias("sell_price"),
        F.round(F.col("sales_units") * price, 2).alias("daily_revenue"))


def int_weekly_sales(daily: DataFrame) -> DataFrame:
    """T5 (grouped by week and year: a week crossing New Year yields two rows)."""
    return (daily.groupBy("store_id", "item_id", "dept_id", "cat_id", "wm_yr_wk", "year")
            .agg(F.sum("sales_units").alias("weekly_sales_units"),
                 F.sum("daily_revenue").alias("weekly_revenue"),
                 avg_half_up("sell_price", 2, 2).alias("avg_weekly_price"),
                 F.max("is_holiday").alias("had_holiday"),
                 F.max("is_snap_day").alias("had_snap_day")))


def int_monthly_sales(daily: DataFrame) -> DataFrame:
    """T6."""
    return (daily.groupBy("store_id", "cat_id", "dept_id", "year", "month")
            .agg(F.sum("sales_units").alias("monthly_sales_units"),
                 F.sum("daily_revenue").alias("monthly_revenue"),
                 F.count_distinct("item_id").alias("active_products_count"),
                 avg_half_up("daily_revenue", 2, 2).alias("avg_daily_revenue")))


def mart_product_performance(daily: DataFrame) -> DataFrame:
    """T7."""
    return (daily.groupBy("item_id", "cat_id", "dept_id")
            .agg(F.count_distinct("store_id").alias("stores_count"),
                 F.sum("sales_units").alias("total_units_sold"),
                 F.sum("daily_revenue").alias("total_revenue"),
                 avg_half_up("sales_units", 2, 0).alias("avg_daily_units"),
                 avg_half_up("sell_price", 2, 2).alias("avg_selling_price"),
                 F.max("sales_units").alias("max_single_day_units"),
                 F.min("sales_units").alias("min_single_day_units")))


def mart_store_performance(daily: DataFrame, dim_stores_df: DataFrame) -> DataFrame:
    """Aggregate per store first, then join the one-row-per-store dimension."""
    per_store = (daily.groupBy("store_id")
                 .agg(F.count_distinct("item_id").alias("total_skus_stocked"),
                      F.sum("sales_units").alias("total_units_sold"),
                      F.sum("daily_revenue").alias("total_gross_revenue"),
                      avg_half_up("daily_revenue", 2, 2).alias("avg_store_daily_revenue"),
                      *[F.sum(F.when(F.col("cat_id") == cat, F.col("daily_revenue"))
                              .otherwise(F.lit(0).cast("decimal(10,2)"))).alias(name)
                        for cat, name in CATEGORY_COLUMNS]))
    stores = dim_stores_df.select("store_id", "state_id", "store_name", "region")
    return (per_store.join(stores, "store_id", "left")          # both sides one row per store
            .select("store_id", "state_id", "store_name", "region", "total_skus_stocked",
                    "total_units_sold", "total_gross_revenue", "avg_store_daily_revenue",
                    *[name for _, name in CATEGORY_COLUMNS]))


def mart_inventory_health(recs: DataFrame, unit_value: float = 5.0) -> DataFrame:
    """Per store risk counts, units and value of the recommendations."""
    rl, st = F.col("risk_level"), F.col("inventory_status")
    return (recs.groupBy("store_id")
            .agg(F.count_distinct("item_id").alias("total_monitored_skus"),
                 F.sum("current_inventory").alias("total_inventory_units"),
                 (F.sum("current_inventory") * F.lit(unit_value)).alias("estimated_inventory_value"),
                 F.count_if(rl == "High Risk").alias("high_risk_sku_count"),
                 F.count_if(rl == "Medium Risk").alias("medium_risk_sku_count"),
                 F.count_if(rl == "Low Risk").alias("low_risk_sku_count"),
                 F.count_if(st == "Critical Stockout Risk").alias("stockout_alert_count"),
                 F.count_if(st == "Excess Overstock").alias("overstock_alert_count"),
                 F.sum("recommended_order_qty").alias("total_recommended_replenishment_units"),
                 F.sum(F.col("estimated_order_cost").cast("decimal(14,2)"))
                 .alias("total_replenishment_cost")))


def mart_forecast_accuracy(forecasts: DataFrame) -> DataFrame:
    """Per (model, horizon) over holdout rows: count, MAE, RMSE, MAPE (actual 0 skipped).

    Errors are taken on forecasts already rounded to cents, so they are
    aggregated exactly in cents; only sqrt and the final ratio are doubles.
    """
    from shelfcast.operators.evaluate import error_stats
    holdout = forecasts.filter(F.col("actual_demand").isNotNull())
    return (holdout.groupBy("model_used", "horizon_days")
            .agg(*error_stats(mape_mode="nullif")))
