"""StructTypes of the raw files and warehouse tables (data model section 1.4)."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, L = T.StringType(), T.IntegerType(), T.DoubleType(), T.LongType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# raw inputs
CALENDAR_RAW = _st(("date", S), ("wm_yr_wk", I), ("weekday", S), ("wday", I), ("month", I), ("year", I),
                   ("d", S), ("event_name_1", S), ("event_type_1", S), ("event_name_2", S),
                   ("event_type_2", S), ("snap_CA", I), ("snap_TX", I), ("snap_WI", I), ("is_holiday", I))
# price read as text: unparsable values survive to the cleaner, which coerces them
PRICES_RAW = _st(("store_id", S), ("item_id", S), ("wm_yr_wk", S), ("sell_price", S))
SALES_ID = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]

# warehouse tables
DIM_STORES = _st(("store_id", S), ("state_id", S), ("store_name", S), ("region", S))
DIM_CATEGORIES = _st(("cat_id", S), ("category_name", S))
DIM_DEPARTMENTS = _st(("dept_id", S), ("cat_id", S), ("department_name", S))
DIM_PRODUCTS = _st(("item_id", S), ("dept_id", S), ("cat_id", S), ("product_name", S), ("unit_cost", D))
DIM_CALENDAR = _st(("date_str", S), ("wm_yr_wk", I), ("weekday", S), ("wday", I), ("month", I), ("year", I),
                   ("d_id", S), ("event_name_1", S), ("event_type_1", S), ("event_name_2", S),
                   ("event_type_2", S), ("snap_CA", I), ("snap_TX", I), ("snap_WI", I), ("is_holiday", I))
FACT_SALES = _st(("id", S), ("item_id", S), ("dept_id", S), ("cat_id", S), ("store_id", S), ("state_id", S),
                 ("date_str", S), ("sales_units", I))
FACT_PRICES = _st(("store_id", S), ("item_id", S), ("wm_yr_wk", I), ("sell_price", D))
FACT_FORECAST_RESULTS = _st(("forecast_date", S), ("item_id", S), ("store_id", S), ("model_used", S),
                            ("actual_demand", D), ("forecast_demand", D), ("confidence_lower", D),
                            ("confidence_upper", D), ("forecast_error", D), ("horizon_days", I))
FACT_INVENTORY_RECOMMENDATIONS = _st(
    ("evaluation_date", S), ("item_id", S), ("store_id", S), ("current_inventory", I),
    ("average_daily_demand", D), ("demand_std_dev", D), ("lead_time_days", I), ("safety_stock", I),
    ("reorder_point", I), ("forecast_demand_lt", D), ("recommended_order_qty", I), ("days_of_supply", D),
    ("unit_cost", D), ("estimated_order_cost", T.DecimalType(14, 2)), ("inventory_status", S),
    ("risk_level", S), ("stockout_risk_pct", D), ("overstock_risk_pct", D),
    ("suggested_replenishment_date", S))
SYS_VALIDATION_LOGS = _st(("run_timestamp", T.TimestampType()), ("dataset_name", S), ("check_name", S),
                          ("status", S), ("records_evaluated", L), ("failed_records", L), ("details", S))

WAREHOUSE_TABLES = {
    "dim_stores": DIM_STORES, "dim_categories": DIM_CATEGORIES, "dim_departments": DIM_DEPARTMENTS,
    "dim_products": DIM_PRODUCTS, "dim_calendar": DIM_CALENDAR, "fact_sales": FACT_SALES,
    "fact_prices": FACT_PRICES, "fact_forecast_results": FACT_FORECAST_RESULTS,
    "fact_inventory_recommendations": FACT_INVENTORY_RECOMMENDATIONS,
    "sys_validation_logs": SYS_VALIDATION_LOGS,
}
