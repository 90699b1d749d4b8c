"""Feature engineering (F1-F15) with window functions.

All per-series windows share one specification - partition by
(item_id, store_id), order by date - so Spark plans a single shuffle and a
single sort for every lag, rolling mean and rolling std (F4-F7).  Lags and
frames are row based, as in the source platform.

Cross-series totals (F8, F9) are aggregates joined back on their keys; the
planner (with AQE's runtime size check) broadcasts the small aggregate
instead of shuffling the feature rows a second time.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions import calendar as cal
from shelfcast.operators.marts import snap_for_state

SERIES = ["item_id", "store_id"]
# Lag and window lengths, minimum observations, default price,
# seasonal periods of the feature set
LAGS = (7, 14, 28, 60)
ROLL_MEANS = (7, 14, 28)
ROLL_STDS = (7, 28)
MIN_PERIODS = 3
DEFAULT_PRICE = 5.00
TWO_PI = 2 * math.pi
YEAR_DAYS = 365.25


def series_window(order_col: str = "date") -> Window:
    return Window.partitionBy(*SERIES).orderBy(order_col)


def load_base(sales: DataFrame, calendar: DataFrame, prices: DataFrame,
              default_price: float = DEFAULT_PRICE) -> DataFrame:
    """F1: sales INNER calendar LEFT prices, SNAP by state, price default 5.00.

    ``calendar`` is the calendar dimension (one row per day, broadcast).
    No global sort: every consumer orders inside its own window.
    """
    c = calendar.select("date_str", "wm_yr_wk", "weekday", "wday", "month", "year",
                        "event_name_1", "event_type_1", "is_holiday", "snap_CA", "snap_TX", "snap_WI")
    p = prices.select("store_id", "item_id", "wm_yr_wk", F.col("sell_price").alias("_price"))
    df = (sales.select("id", "item_id", "dept_id", "cat_id", "store_id", "state_id", "date_str",
                       "sales_units")
          .join(F.broadcast(c), "date_str", "inner")
          .join(p, ["store_id", "item_id", "wm_yr_wk"], "left"))
    return df.select(
        "id", "item_id", "dept_id", "cat_id", "store_id", "state_id", "date_str", "sales_units",
        "wm_yr_wk", "weekday", "wday", "month", "year", "event_name_1", "event_type_1", "is_holiday",
        snap_for_state().alias("snap_indicator"),
        F.coalesce(F.col("_price").cast("double"), F.lit(float(default_price))).alias("sell_price"),
        F.to_date("date_str").alias("date"))


def add_temporal(df: DataFrame) -> DataFrame:
    """day_of_week (Mon=0), day_of_month, quarter, is_weekend (Sat/Sun), day_of_year."""
    d = F.col("date")
    dow = cal.weekday_mon0(d)
    return (df.withColumn("day_of_week", dow)
              .withColumn("day_of_month", F.dayofmonth(d))
              .withColumn("quarter", F.quarter(d))
              .withColumn("is_weekend", F.when(dow.isin(5, 6), 1).otherwise(0))
              .withColumn("day_of_year", F.dayofyear(d)))


def add_cyclical(df: DataFrame) -> DataFrame:
    """sin/cos of 2*pi*month/12."""
    a = F.lit(TWO_PI) * F.col("month") / F.lit(12.0)
    return df.withColumn("sin_month", F.sin(a)).withColumn("cos_month", F.cos(a))


def add_lags(df: DataFrame, lags: Sequence[int] = LAGS, col: str = "sales_units") -> DataFrame:
    """lag k of units within the series."""
    w = series_window()
    return df.select("*", *[F.lag(col, k).over(w).alias(f"sales_lag_{k}") for k in lags])


def _frame(k: int) -> Window:
    return series_window().rowsBetween(-k, -1)


def add_rolling_mean(df: DataFrame, windows: Sequence[int] = ROLL_MEANS,
                     min_periods: int = MIN_PERIODS, col: str = "sales_units") -> DataFrame:
    """mean of the previous k rows (current row excluded), at least ``min_periods``."""
    u = F.col(col)
    return df.select("*", *[F.when(F.count(u).over(_frame(k)) >= min_periods, F.avg(u).over(_frame(k)))
                            .alias(f"sales_roll_mean_{k}") for k in windows])


def add_rolling_std(df: DataFrame, windows: Sequence[int] = ROLL_STDS,
                    min_periods: int = MIN_PERIODS, col: str = "sales_units") -> DataFrame:
    """sample std of the previous k rows, at least ``min_periods``."""
    u = F.col(col)
    return df.select("*", *[F.when(F.count(u).over(_frame(k)) >= min_periods,
                                   F.stddev_samp(u).over(_frame(k)))
                            .alias(f"sales_roll_std_{k}") for k in windows])


def add_price_change(df: DataFrame, lag: int = 7) -> DataFrame:
    """price lag and percent change; zero or missing base -> 0."""
    prev = F.lag("sell_price", lag).over(series_window())
    return (df.withColumn(f"price_lag_{lag}", prev)
              .withColumn("price_change_pct",
                          F.coalesce((F.col("sell_price") - F.col(f"price_lag_{lag}"))
                                     / F.nullif(F.col(f"price_lag_{lag}"), F.lit(0.0)), F.lit(0.0))))


def _cents(col: str) -> Column:
    return F.round(F.col(col) * F.lit(100.0)).cast("long")


def category_day_totals(df: DataFrame) -> DataFrame:
    """(cat_id, date_str) -> mean price (exact, from whole cents) and unit total."""
    return (df.groupBy("cat_id", "date_str")
            .agg((F.sum(_cents("sell_price")) / F.count("sell_price") / F.lit(100.0)).alias("_cat_price"),
                 F.sum("sales_units").alias("cat_sales_momentum_7")))


def store_day_totals(df: DataFrame) -> DataFrame:
    """(store_id, date_str) -> unit total."""
    return df.groupBy("store_id", "date_str").agg(F.sum("sales_units").alias("store_sales_momentum_7"))


def add_relative_price(df: DataFrame, cat_day: DataFrame | None = None) -> DataFrame:
    """F8: price / mean price of the category that day (null -> 1).

    The mean is taken over whole cents (exact sum) so that it does not
    depend on the order in which partial sums are combined.
    """
    cat_day = cat_day if cat_day is not None else category_day_totals(df)
    out = df.join(cat_day.select("cat_id", "date_str", "_cat_price"), ["cat_id", "date_str"], "left")
    return (out.withColumn("price_rel_to_cat",
                           F.coalesce(F.col("sell_price") / F.col("_cat_price"), F.lit(1.0)))
               .drop("_cat_price"))


def add_group_totals(df: DataFrame, cat_day: DataFrame | None = None,
                     store_day: DataFrame | None = None) -> DataFrame:
    """same-day unit totals of the store and of the category."""
    cat_day = cat_day if cat_day is not None else category_day_totals(df)
    store_day = store_day if store_day is not None else store_day_totals(df)
    out = df.join(store_day, ["store_id", "date_str"], "left")
    return out.join(cat_day.select("cat_id", "date_str", "cat_sales_momentum_7"), ["cat_id", "date_str"], "left")


def fill_numeric(df: DataFrame, value: float = 0.0) -> DataFrame:
    """nulls in numeric columns -> 0."""
    numeric = [f.name for f in df.schema.fields
               if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal")]
    return df.fillna(value, subset=numeric)


def build_features(base: DataFrame) -> DataFrame:
    """F2 -> F10 over the F1 base.

    The cross-series day totals (F8, F9) only need base columns, so they are
    aggregated from the base and joined first (the planner sizes them); the
    series windows (F4-F7) then cost a single shuffle and sort on
    (item_id, store_id).
    """
    cat_day = category_day_totals(base)
    df = add_group_totals(add_relative_price(base, cat_day), cat_day, store_day_totals(base))
    df = add_cyclical(add_temporal(df))
    df = add_price_change(add_rolling_std(add_rolling_mean(add_lags(df))))
    return fill_numeric(df)


def split_date(df: DataFrame, test_days: int) -> Column:
    """F12 helper: the test_days-th latest distinct date (scalar subquery)."""
    latest = (df.select("date_str").distinct().orderBy(F.col("date_str").desc()).limit(test_days))
    return latest.agg(F.min("date_str")).scalar()


def time_split(df: DataFrame, test_days: int) -> tuple[DataFrame, DataFrame]:
    """train <= split < test, split = distinct_dates[-test_days]."""
    s = split_date(df, test_days)
    return df.filter(F.col("date_str") <= s), df.filter(F.col("date_str") > s)


def fourier_columns(date_col: str = "date", weekly: int = 3, yearly: int = 5) -> list[Column]:
    """weekly (period 7, on Mon=0 weekday) and yearly (period 365.25, on day of year) terms."""
    d = F.col(date_col)
    dow, doy = cal.weekday_mon0(d), F.dayofyear(d)
    cols = []
    for k in range(1, weekly + 1):
        a = F.lit(TWO_PI * k) * dow / F.lit(7.0)
        cols += [F.sin(a).alias(f"sin_week_{k}"), F.cos(a).alias(f"cos_week_{k}")]
    for k in range(1, yearly + 1):
        a = F.lit(TWO_PI * k) * doy / F.lit(YEAR_DAYS)
        cols += [F.sin(a).alias(f"sin_year_{k}"), F.cos(a).alias(f"cos_year_{k}")]
    return cols


FOURIER_NAMES = ([f"{f}_week_{k}" for k in range(1, 4) for f in ("sin", "cos")]
                 + [f"{f}_year_{k}" for k in range(1, 6) for f in ("sin", "cos")])
TREND_NAMES = ["trend_linear", "trend_quad", "changepoint_0", "changepoint_1", "changepoint_2"]
REGRESSOR_NAMES = ["is_holiday", "snap_indicator", "sell_price"]
ADDITIVE_FEATURES = TREND_NAMES + REGRESSOR_NAMES + FOURIER_NAMES


def trend_columns(t_col: Column, n_col: Column) -> list[Column]:
    """t/365.25, (t/365.25)^2 and three interior changepoint hinges.

    ``t_col`` is days since the series origin, ``n_col`` the number of
    training rows; changepoint i sits at floor(i*(n-1)/4) (i = 1..3).
    """
    ty = t_col / F.lit(YEAR_DAYS)
    cols = [ty.alias("trend_linear"), (ty * ty).alias("trend_quad")]
    for i in range(1, 4):
        cp = F.floor(F.lit(float(i)) * (n_col - 1) / F.lit(4.0))
        cols.append((F.greatest(F.lit(0.0), t_col - cp) / F.lit(YEAR_DAYS)).alias(f"changepoint_{i - 1}"))
    return cols


def regressor_columns(df: DataFrame) -> list[Column]:
    """F14 regressors: holiday, SNAP (or is_snap_day) and price (default 5.0) if present."""
    def have(c):
        return c in df.columns
    snap = (F.col("snap_indicator") if have("snap_indicator")
            else F.col("is_snap_day") if have("is_snap_day") else F.lit(0))
    return [(F.col("is_holiday") if have("is_holiday") else F.lit(0)).cast("double").alias("is_holiday"),
            snap.cast("double").alias("snap_indicator"),
            (F.col("sell_price") if have("sell_price") else F.lit(DEFAULT_PRICE)).cast("double")
            .alias("sell_price")]


def add_additive_design(df: DataFrame, origin: Column | None = None,
                        n_rows: Column | None = None) -> DataFrame:
    """F13 + F14: the 24-column design of the additive model.

    By default the origin and row count are the series' own (min date,
    row count) over ``df``; pass the training values to continue a fitted
    series' trend on later dates.
    """
    w = Window.partitionBy(*SERIES)
    origin = origin if origin is not None else F.min("date").over(w)
    n_rows = n_rows if n_rows is not None else F.count(F.lit(1)).over(w)
    t = F.datediff(F.col("date"), origin).cast("double")
    keep = [c for c in df.columns if c not in REGRESSOR_NAMES]
    return df.select(*keep, *regressor_columns(df), *trend_columns(t, n_rows.cast("double")),
                     *fourier_columns())


def forward_rows(features: DataFrame, calendar: DataFrame, series: DataFrame,
                 horizons: Sequence[int] = (7, 30, 90), recent: int = 28) -> DataFrame:
    """forward feature rows for every series x horizon x future day.

    Recent statistics come from each series' last ``recent`` rows (mean and
    sample std of units, last price, department and category); every lag and
    rolling feature takes the recent mean (std for the rolling stds), price
    change is 0 and relative price 1.  Future days start after the last date
    of the whole history.  Holiday and SNAP flags come from ``calendar``
    (extended over the horizon), 0 where a day is missing.
    """
    w_desc = Window.partitionBy(*SERIES).orderBy(F.col("date").desc())
    last = (features.select(*SERIES, "date", "sales_units", "sell_price", "dept_id", "cat_id", "state_id")
            .withColumn("_rn", F.row_number().over(w_desc))
            .filter(F.col("_rn") <= recent)
            .groupBy(*SERIES)
            .agg(F.avg("sales_units").alias("_avg"), F.stddev_samp("sales_units").alias("_std"),
                 F.max_by("sell_price", "date").alias("sell_price"),
                 F.max_by("dept_id", "date").alias("dept_id"),
                 F.max_by("cat_id", "date").alias("cat_id"),
                 F.max_by("state_id", "date").alias("state_id")))
    last_date = features.agg(F.max("date")).scalar()
    hz = F.explode(F.array(*[F.lit(h) for h in horizons]))
    rows = (series.select(*SERIES).distinct().join(last, SERIES, "inner")
            .select("*", hz.alias("horizon_days"))
            .withColumn("_d", F.explode(F.sequence(F.date_add(last_date, 1),
                                                   F.date_add(last_date, F.col("horizon_days"))))))
    d = F.col("_d")
    dow = cal.weekday_mon0(d)
    c = calendar.select("date_str", F.col("is_holiday").alias("_hol"), "snap_CA", "snap_TX", "snap_WI")
    out = (rows.withColumn("date_str", F.date_format(d, "yyyy-MM-dd"))
           .join(F.broadcast(c), "date_str", "left"))
    a, s = F.col("_avg"), F.col("_std")
    return out.select(
        "item_id", "store_id", "dept_id", "cat_id", "state_id", "date_str",
        F.col("date_str").alias("forecast_date"), d.alias("date"),
        dow.alias("day_of_week"), F.dayofmonth(d).alias("day_of_month"), F.month(d).alias("month"),
        F.quarter(d).alias("quarter"), F.when(dow.isin(5, 6), 1).otherwise(0).alias("is_weekend"),
        F.coalesce("_hol", F.lit(0)).alias("is_holiday"),
        F.coalesce(snap_for_state(), F.lit(0)).alias("snap_indicator"),
        "sell_price", F.lit(0.0).alias("price_change_pct"), F.lit(1.0).alias("price_rel_to_cat"),
        a.alias("sales_lag_7"), a.alias("sales_lag_14"), a.alias("sales_lag_28"),
        a.alias("sales_roll_mean_7"), a.alias("sales_roll_mean_14"), a.alias("sales_roll_mean_28"),
        s.alias("sales_roll_std_7"), s.alias("sales_roll_std_28"), "horizon_days")
