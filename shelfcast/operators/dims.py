"""Dimension and fact building (D1-D8), including the deterministic calendar generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions import calendar as cal
from shelfcast.functions.rounding import ratio_half_up, unscaled

# ---------------------------------------------------------------------------
# Known store directory (store_id, state_id, store_name, region)
STORE_DIRECTORY = [
    ("CA_1", "CA", "Sacramento Supercenter", "Pacific"),
    ("CA_2", "CA", "San Francisco Metro", "Pacific"),
    ("TX_1", "TX", "Dallas Supercenter", "South Central"),
    ("TX_2", "TX", "Austin Central", "South Central"),
    ("WI_1", "WI", "Milwaukee North", "Midwest"),
    ("WI_2", "WI", "Madison West", "Midwest"),
]
DEFAULT_REGION = "General"
DEFAULT_AVG_PRICE = 5.0
UNIT_COST_RATIO = 0.60
CALENDAR_COLUMNS = ["date_str", "wm_yr_wk", "weekday", "wday", "month", "year", "d",
                    "event_name_1", "event_type_1", "event_name_2", "event_type_2",
                    "snap_CA", "snap_TX", "snap_WI", "is_holiday"]
FACT_SALES_COLUMNS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id",
                      "date_str", "sales_units"]
FACT_PRICES_COLUMNS = ["store_id", "item_id", "wm_yr_wk", "sell_price"]
# ---------------------------------------------------------------------------


def store_directory(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STORE_DIRECTORY, "store_id string, d_state string, "
                                                  "store_name string, region string")


def dim_stores(sales: DataFrame) -> DataFrame:
    """Distinct (store_id, state_id) + directory lookup; unknown -> 'Store <id>', 'General'."""
    directory = store_directory(sales.sparkSession).drop("d_state")
    return (sales.select("store_id", "state_id").distinct()
            .join(F.broadcast(directory), "store_id", "left")        # 6-row fixed lookup
            .select("store_id", "state_id",
                    F.coalesce("store_name", F.concat(F.lit("Store "), "store_id")).alias("store_name"),
                    F.coalesce("region", F.lit(DEFAULT_REGION)).alias("region")))


def title_label(col: str) -> Column:
    """'FOODS-NEW_1' -> 'Foods-New 1': underscores to spaces; a letter after another is small, after anything else large.

    Runs of letters and what lies between them are taken apart, the former
    get their case, and are joined again.
    """
    text = F.regexp_replace(F.col(col), "_", " ")
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def dim_categories(sales: DataFrame) -> DataFrame:
    """D2."""
    return sales.select("cat_id").distinct().withColumn("category_name", title_label("cat_id"))


def dim_departments(sales: DataFrame) -> DataFrame:
    """D3."""
    return (sales.select("dept_id", "cat_id").distinct()
            .withColumn("department_name", title_label("dept_id")))


def dim_products(sales: DataFrame, prices: DataFrame) -> DataFrame:
    """Product name from the item code; unit cost = round(avg price x 0.60, 2), avg default 5.0.

    Average price per item is an aggregate of the price list joined back on
    item_id (one row per item on both sides).
    """
    avg_cost = (prices.groupBy("item_id")
                .agg(ratio_half_up(F.sum(unscaled("sell_price", 2)) * F.lit(6),
                                   F.count("sell_price") * F.lit(10), 2, 2).alias("unit_cost")))
    parts = F.split(F.col("item_id"), "_")
    name = F.concat(F.element_at(parts, 1), F.lit(" Product #"), F.element_at(parts, -1))
    return (sales.select("item_id", "dept_id", "cat_id").distinct()
            .join(avg_cost, "item_id", "left")
            .select("item_id", "dept_id", "cat_id", name.alias("product_name"),
                    F.coalesce("unit_cost", F.lit(round(DEFAULT_AVG_PRICE * UNIT_COST_RATIO, 2)))
                    .alias("unit_cost")))


def dim_calendar(cleaned_calendar: DataFrame) -> DataFrame:
    """Project the calendar columns present, ``d`` renamed ``d_id``."""
    cols = [c for c in CALENDAR_COLUMNS if c in cleaned_calendar.columns]
    return cleaned_calendar.select(*cols).withColumnRenamed("d", "d_id")


def fact_sales_table(cleaned_sales: DataFrame) -> DataFrame:
    """fact_sales projection."""
    return cleaned_sales.select(*FACT_SALES_COLUMNS)


def fact_prices_table(cleaned_prices: DataFrame) -> DataFrame:
    """fact_prices projection."""
    return cleaned_prices.select(*FACT_PRICES_COLUMNS)


def calendar_rows(date_col: Column, index_col: Column) -> list[Column]:
    """Calendar attributes of a date; ``index_col`` is the 0-based day offset (-> d_<i+1>)."""
    d = date_col
    return [
        F.date_format(d, "yyyy-MM-dd").alias("date"),
        cal.wm_yr_wk(d).alias("wm_yr_wk"),
        cal.weekday_name(d).alias("weekday"),
        cal.wday(d).alias("wday"),
        F.month(d).alias("month"),
        F.year(d).alias("year"),
        F.concat(F.lit("d_"), (index_col + 1).cast("string")).alias("d"),
        cal.holiday_name(d).alias("event_name_1"),
        cal.holiday_type(d).alias("event_type_1"),
        F.lit(None).cast("string").alias("event_name_2"),
        F.lit(None).cast("string").alias("event_type_2"),
        cal.snap_flag(d, "CA").alias("snap_CA"),
        cal.snap_flag(d, "TX").alias("snap_TX"),
        cal.snap_flag(d, "WI").alias("snap_WI"),
        F.when(cal.holiday_name(d).isNotNull(), 1).otherwise(0).alias("is_holiday"),
    ]


def calendar_between(bounds: DataFrame, start_col: str = "start_date",
                     end_col: str = "end_date") -> DataFrame:
    """One calendar row per day from a one-row frame of (start, end) dates.

    The day count is bounded by the calendar span (thousands of rows), not
    by the data volume.
    """
    days = bounds.select(F.posexplode(F.sequence(F.col(start_col), F.col(end_col)))
                         .alias("_i", "_date"))
    return days.select(*calendar_rows(F.col("_date"), F.col("_i")))


def generate_calendar(spark: SparkSession, start_date: str = "2021-01-01",
                      num_days: int = 1000) -> DataFrame:
    """D7 with literal arguments: ``num_days`` days from ``start_date``."""
    bounds = spark.range(1).select(
        F.to_date(F.lit(start_date)).alias("start_date"),
        F.date_add(F.to_date(F.lit(start_date)), num_days - 1).alias("end_date"))
    return calendar_between(bounds)


def future_dates(last_dates: DataFrame, days: int, last_col: str = "last_date",
                 horizon_col: str | None = None) -> DataFrame:
    """For each row, the dates last+1 .. last+days as ``forecast_date`` (ISO string).

    ``horizon_col`` (optional) names an int column holding the horizon per row
    instead of the fixed ``days``.
    """
    n = F.col(horizon_col) if horizon_col else F.lit(days)
    seq = F.sequence(F.date_add(F.col(last_col), 1), F.date_add(F.col(last_col), n))
    return (last_dates.withColumn("_d", F.explode(seq))
            .withColumn("forecast_date", F.date_format("_d", "yyyy-MM-dd"))
            .drop("_d"))
