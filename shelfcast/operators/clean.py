"""Cleaning operators (C1-C13): dedup, parsing, coercion, imputation, unpivot.

All functions are ``DataFrame -> DataFrame`` transforms, lazy but for the price median (``clean_prices``).  Row order of a
raw feed is carried explicitly in an ordering column (``ingest_ord`` by
default) because a distributed frame has no intrinsic order; keep-first
deduplication ranks on it instead of relying on ``dropDuplicates``, whose
survivor is arbitrary.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.quantiles import exact_quantiles
from shelfcast.session import materialize

#: Bytes of a source file that one task reads where keep-first is staged: it sorts a task's rows before they are combined.
KEEP_FIRST_BYTES = 16 * 2**20
DAY_ID_PREFIX = "d_"
SALES_ID_COLS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
EVENT_COLS = ["event_name_1", "event_type_1", "event_name_2", "event_type_2"]
SNAP_COLS = ["snap_CA", "snap_TX", "snap_WI"]
# Per-column defaults used when a calendar number cannot be parsed (fixed values)
CALENDAR_INT_DEFAULTS = {"wm_yr_wk": 0, "wday": 1, "month": 1, "year": 2022}


def _order_cols(df: DataFrame, keys: Sequence[str], order_by) -> list[Column]:
    if order_by is None:
        order_by = "ingest_ord" if "ingest_ord" in df.columns else None
    if order_by is None:
        raise ValueError("keep-first needs the arrival order: an ingest_ord column (the readers attach it) or order_by")
    if isinstance(order_by, (str, Column)):
        order_by = [order_by]
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def keep_first(df: DataFrame, keys: Sequence[str], order_by=None) -> DataFrame:
    """Keep the first row per key (nulls compare equal) in arrival order.

    Expressed as an aggregation, ``min_by(row, arrival order)`` per key, so
    Spark combines map-side before the shuffle: a key holding a third of
    all rows reaches the reducer as one partial row per input partition
    instead of one sorted window partition.
    """
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    order = F.struct(*_order_cols(df, keys, order_by))
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*payload), order).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c)
                          for c in df.columns])


def number(col: str) -> Column:
    """A column's number; null for text, NaN and infinities."""
    v = F.col(col).cast("string").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def coerce_int(col: str, default: int) -> Column:
    """Numeric coercion with a default for values that are no number or no int, truncated."""
    return F.coalesce(number(col).try_cast("int"), F.lit(default))


def clean_calendar(df: DataFrame, order_by=None) -> DataFrame:
    """C6 = C1 (dedup on raw date) -> C2 (parse) -> C3 (coerce) -> C4 (events) -> C5 (holiday)."""
    df = keep_first(df, ["date"], order_by)                                  # C1
    parsed = F.try_to_date(F.col("date").cast("string"), "yyyy-MM-dd")
    df = df.withColumn("date", parsed).filter(F.col("date").isNotNull())      # C2
    df = df.withColumn("date_str", F.date_format("date", "yyyy-MM-dd"))
    for c, d in CALENDAR_INT_DEFAULTS.items():                               # C3
        df = df.withColumn(c, coerce_int(c, d))
    for c in EVENT_COLS:                                                     # C4
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("None")))
    for c in SNAP_COLS:
        if c in df.columns:
            df = df.withColumn(c, coerce_int(c, 0))
    if "event_name_1" in df.columns:                                         # C5
        ev = F.col("event_name_1")
        df = df.withColumn("is_holiday", F.when(~ev.isin("None", ""), 1).otherwise(0))
    else:
        df = df.withColumn("is_holiday", F.lit(0))
    if "ingest_ord" in df.columns:
        df = df.drop("ingest_ord")
    return df


def clean_prices(df: DataFrame, order_by=None, trim_first: bool = False) -> DataFrame:
    """C9 = C1 (dedup store,item,week) -> C7 (trim keys) -> C8 (median imputation) -> round.

    The dedup runs before trimming by default (padded duplicates survive,
    as in the source platform); ``trim_first=True`` trims first.

    C8: null or non-positive prices become the exact median of the valid
    prices (``quantiles.exact_quantiles``), taken before they are rounded.  The
    deduplicated rows are staged first, as the median reads them a few times.
    """
    keys = ["store_id", "item_id", "wm_yr_wk"]

    def _trim(x: DataFrame) -> DataFrame:
        return (x.withColumn("store_id", F.trim(F.col("store_id").cast("string")))
                 .withColumn("item_id", F.trim(F.col("item_id").cast("string"))))

    if trim_first:
        df = _trim(df)
    df = keep_first(df, keys, order_by)
    if not trim_first:
        df = _trim(df)
    df = df.withColumn("wm_yr_wk", coerce_int("wm_yr_wk", 0))
    df = df.withColumn("sell_price", number("sell_price"))
    df = materialize(df, KEEP_FIRST_BYTES)
    valid = F.col("sell_price").isNotNull() & (F.col("sell_price") > 0)
    median, = exact_quantiles(df.filter(valid), "sell_price", [0.5])
    fixed = F.when(valid, F.col("sell_price")).otherwise(F.lit(median))
    out = df.withColumn("sell_price", F.round(fixed.cast("decimal(20,6)"), 2).cast("double"))
    if "ingest_ord" in out.columns:
        out = out.drop("ingest_ord")
    return out


def day_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(DAY_ID_PREFIX)]


def unpivot_days(df: DataFrame, id_cols: Sequence[str] = SALES_ID_COLS,
                 day_cols: Sequence[str] | None = None) -> DataFrame:
    """Wide ``d_1..d_n`` columns -> long (ids, d, sales_units).

    ``posexplode`` over one array column plus a literal array of names: a
    single Generate node however many day columns there are (Spark's
    ``unpivot`` would plan one projection per column).  The expression is
    passed as one SQL string - thousands of ``F.col`` calls would each be a
    round trip to the JVM.
    """
    day_cols = list(day_cols if day_cols is not None else day_columns(df))
    names = ", ".join(f"'{c}'" for c in day_cols)
    values = ", ".join(f"CAST(`{c}` AS STRING)" for c in day_cols)
    ids = [f"`{c}`" for c in id_cols]
    return (df.selectExpr(*ids, f"posexplode(array({values})) AS (_pos, sales_units)")
              .selectExpr(*ids, f"element_at(array({names}), _pos + 1) AS d", "sales_units"))


def clean_units(col: str = "sales_units") -> Column:
    """C11: parse units; what is no number or no int -> 0, negatives clipped to 0, truncated to int."""
    return F.greatest(F.coalesce(number(col).try_cast("int"), F.lit(0)), F.lit(0))


def attach_dates(long_df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Map day id -> date_str; rows whose day id is not in the calendar are dropped.

    The calendar has one row per day (thousands at most), so it is broadcast
    by hint; the fact side is never shuffled for this join.  Of several dates
    with one day id the last counts.
    """
    days = calendar.select("d", "date_str").dropna(subset=["d"]).groupBy("d").agg(F.max("date_str").alias("date_str"))
    return long_df.join(F.broadcast(days), "d", "inner")


def clean_and_melt_sales(sales_wide: DataFrame, calendar: DataFrame, order_by=None) -> DataFrame:
    """C13 = C1 (dedup on id) -> C10 (unpivot) -> C11 (units) -> C12 (dates).

    The first row of each id is found on (id, arrival order) alone and the
    wide rows are semi-joined with it, so the days are unpivoted after the
    deduplication and never shuffled.
    """
    id_cols = [c for c in SALES_ID_COLS if c in sales_wide.columns]
    wide = sales_wide.withColumn("ingest_ord", F.struct(*_order_cols(sales_wide, ["id"], order_by)))
    first = wide.groupBy("id").agg(F.min("ingest_ord").alias("_ord")).withColumnRenamed("id", "_id")
    kept = wide.join(first, wide["id"].eqNullSafe(first["_id"]) & (wide["ingest_ord"] == first["_ord"]), "left_semi")
    long_df = unpivot_days(kept, id_cols).withColumn("sales_units", clean_units("sales_units"))
    return attach_dates(long_df, calendar).select(*id_cols, "d", "sales_units", "date_str")
