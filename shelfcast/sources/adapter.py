"""Driver-table adapter: TPC-H-style tables -> the retail data model.

The platform's natural inputs are a wide daily sales file, a calendar and a
weekly price list.  The test tables are order lines, so this module derives
those inputs from them with plain joins and aggregations (all lazy, all
distributed):

* product   : ``part.p_type`` (first word) -> department/category,
              ``p_size % 4 + 1`` -> item number within the department
* store     : supplier -> nation -> region; region -> state, nation parity -> store
* day       : ``l_shipdate`` as a date; units = sum of ``l_quantity``
* price list: invoiced lines (``l_linestatus = 'F'``), average unit price per
              (store, item, retail week) in whole cents.  Weeks with only open
              lines have no price, which exercises the default-price branch.
* raw feeds : the same lines rendered as the platform's dirty raw inputs:
              returned lines (``l_returnflag = 'R'``) carry negative units and
              refund (negative) prices, open lines carry no price yet.

Small dimension tables (nation: 25 rows, region: 5 rows) are broadcast by an
explicit hint - their size is fixed by the schema.  ``part`` and ``supplier``
grow with the scale factor and are left to the planner (broadcast only below
``spark.sql.autoBroadcastJoinThreshold``, sort-merge join beyond).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions import calendar as cal

# ---------------------------------------------------------------------------
# Fixed mapping values of the adapter (part type -> department, region -> state)
TYPE_TO_DEPT = [
    ("STANDARD", "FOODS_1"),
    ("SMALL", "FOODS_2"),
    ("LARGE", "HOUSEHOLD_1"),
    ("ECONOMY", "HOUSEHOLD_2"),
    ("MEDIUM", "HOBBIES_1"),
    ("PROMO", "HOBBIES_2"),
]
REGION_TO_STATE = [
    ("AFRICA", "CA"),
    ("AMERICA", "TX"),
    ("ASIA", "WI"),
    ("EUROPE", "EU"),
]
OTHER_STATE = "ME"
# On-hand stock: days of lead time, and cover factors
ON_HAND_DAYS, ON_HAND_FACTORS = 7, [0.3, 0.7, 1.2, 1.8, 3.5]
# ---------------------------------------------------------------------------

SERIES_COLS = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col: Column, pairs, default) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr.otherwise(default)


def products(part: DataFrame) -> DataFrame:
    """p_partkey -> item_id, dept_id, cat_id."""
    kind = F.upper(F.split(F.trim(F.col("p_type")), " ").getItem(0))
    dept = _case(kind, TYPE_TO_DEPT, F.lit("GENERAL_1"))
    item_no = F.lpad((F.pmod(F.col("p_size"), F.lit(4)) + 1).cast("string"), 3, "0")
    return (part.select("p_partkey", "p_type", "p_size")
            .withColumn("dept_id", dept)
            .withColumn("cat_id", F.regexp_extract("dept_id", r"^(.*)_[^_]*$", 1))
            .withColumn("item_id", F.concat_ws("_", "dept_id", item_no))
            .select("p_partkey", "item_id", "dept_id", "cat_id"))


def geography(nation: DataFrame, region: DataFrame) -> DataFrame:
    """n_nationkey -> store_id, state_id (25 x 5 rows: fixed by the schema)."""
    return (nation.select("n_nationkey", "n_regionkey")
            .join(F.broadcast(region.select("r_regionkey", "r_name")),
                  F.col("n_regionkey") == F.col("r_regionkey"))
            .withColumn("state_id", _case(F.col("r_name"), REGION_TO_STATE, F.lit(OTHER_STATE)))
            .withColumn("store_id", F.concat_ws("_", "state_id",
                                                (F.pmod("n_nationkey", F.lit(2)) + 1).cast("string")))
            .select("n_nationkey", "store_id", "state_id"))


def stores(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """s_suppkey -> store_id, state_id."""
    return (supplier.select("s_suppkey", "s_nationkey")
            .join(F.broadcast(geography(nation, region)), F.col("s_nationkey") == F.col("n_nationkey"))
            .select("s_suppkey", "store_id", "state_id"))


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with its retail series key and day.

    Join order: lines x part x supplier, each side a plain (projected) table
    so the planner sizes it correctly - broadcast while small, sort-merge
    at scale - then the fixed-size geography lookup, always broadcast.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    prod = products(read_table(spark, sf_dir, "part"))
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    geo = geography(read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region"))
    return (li.join(prod, li.l_partkey == prod.p_partkey)
            .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey"))
            .withColumn("date", F.to_date("l_shipdate"))
            .drop("p_partkey", "s_suppkey", "s_nationkey", "n_nationkey"))


def series_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (series, day): shipped units and the invoiced partial sums.

    Both the sales fact and the weekly price list are derived from this one
    aggregate, so the order lines are scanned and joined once; the map-side
    partial aggregation shrinks the lines to series-days before the shuffle.
    """
    invoiced = F.col("l_linestatus") == "F"
    return (sales_lines(spark, sf_dir)
            .groupBy(*SERIES_COLS, "date")
            .agg(F.sum("l_quantity").alias("units"),
                 F.sum(F.when(invoiced, F.col("l_quantity"))).alias("inv_qty"),
                 F.sum(F.when(invoiced, F.col("l_extendedprice").cast("decimal(18,2)")))
                 .alias("inv_amount")))


def fact_sales(spark: SparkSession, sf_dir: str, days: DataFrame | None = None) -> DataFrame:
    """fact_sales: (id, item_id, dept_id, cat_id, store_id, state_id, date_str, sales_units)."""
    days = days if days is not None else series_days(spark, sf_dir)
    return days.select(F.concat_ws("_", "item_id", "store_id").alias("id"), *SERIES_COLS,
                       F.date_format("date", "yyyy-MM-dd").alias("date_str"),
                       F.col("units").cast("int").alias("sales_units"))


def fact_prices(spark: SparkSession, sf_dir: str, days: DataFrame | None = None) -> DataFrame:
    """fact_prices: weekly price list (store_id, item_id, wm_yr_wk, sell_price double).

    Average invoiced unit price per (store, item, retail week) in whole cents,
    half-up, from an exact decimal amount.  Weeks without invoiced lines get
    no price row.
    """
    days = days if days is not None else series_days(spark, sf_dir)
    weekly = (days.filter(F.col("inv_qty").isNotNull())
              .withColumn("wm_yr_wk", cal.wm_yr_wk("date"))
              .groupBy("store_id", "item_id", "wm_yr_wk")
              .agg(F.sum("inv_amount").cast("double").alias("amount"), F.sum("inv_qty").alias("qty")))
    cents = F.floor(F.col("amount") / F.col("qty") * F.lit(100.0) + F.lit(0.5))
    return weekly.select("store_id", "item_id", "wm_yr_wk", (cents / F.lit(100.0)).alias("sell_price"))


def first_ship_day(spark: SparkSession, sf_dir: str):
    """Day 1 of the exports: the earliest ship date, as a scalar subquery.

    A one-column scan of the order lines (no joins), evaluated once.
    """
    return read_table(spark, sf_dir, "lineitem").agg(F.min(F.to_date("l_shipdate"))).scalar()


def _ingest_order():
    """Arrival order of a line in the raw feeds (a total order over distinct lines)."""
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                    "l_extendedprice")


def raw_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar feed as it arrives: one calendar record stamped on every order line.

    Columns follow the raw calendar file (date string, wm_yr_wk, weekday, wday,
    month, year, d, events, SNAP flags) plus ``ingest_ord`` (arrival order).
    Duplicates per date are expected and removed by ``clean_calendar``.
    """
    lines = read_table(spark, sf_dir, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    start = first_ship_day(spark, sf_dir)
    d = F.col("date")
    return (lines.select(
                F.date_format(d, "yyyy-MM-dd").alias("date"),
                cal.wm_yr_wk(d).alias("wm_yr_wk"),
                cal.weekday_name(d).alias("weekday"),
                cal.wday(d).alias("wday"),
                F.month(d).alias("month"),
                F.year(d).alias("year"),
                F.concat(F.lit("d_"), (F.datediff(d, start) + 1).cast("string")).alias("d"),
                cal.holiday_name(d).alias("event_name_1"),
                cal.holiday_type(d).alias("event_type_1"),
                F.lit(None).cast("string").alias("event_name_2"),
                F.lit(None).cast("string").alias("event_type_2"),
                cal.snap_flag(d, "CA").alias("snap_CA"),
                cal.snap_flag(d, "TX").alias("snap_TX"),
                cal.snap_flag(d, "WI").alias("snap_WI"),
                _ingest_order().alias("ingest_ord"),
            ))


def raw_price_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price feed as it arrives: one quote per order line, keyed by ship week.

    Open lines have no invoiced price yet (null), returned lines carry a
    refund price (negative).  Many quotes share a key; ``clean_prices`` keeps
    the first by ``ingest_ord``.
    """
    lines = sales_lines(spark, sf_dir)
    unit = F.floor(F.col("l_extendedprice").cast("decimal(18,2)").cast("double")
                   / F.col("l_quantity") * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)
    price = (F.when(F.col("l_linestatus") == "O", F.lit(None).cast("double"))
             .when(F.col("l_returnflag") == "R", -unit).otherwise(unit))
    return lines.select(
        "store_id", "item_id", cal.wm_yr_wk("date").alias("wm_yr_wk"),
        price.alias("sell_price"),
        _ingest_order().alias("ingest_ord"))


def net_sales_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily net units per series and day id: shipped minus returned (may be negative)."""
    lines = sales_lines(spark, sf_dir)
    start = first_ship_day(spark, sf_dir)
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return (lines.withColumn("day_no", F.datediff("date", start) + 1)
            .groupBy(*SERIES_COLS, "day_no")
            .agg(F.sum(signed).cast("int").alias("units")))


def day_count(spark: SparkSession, sf_dir: str) -> int:
    """Number of days spanned by the ship dates (a single scalar on the driver)."""
    r = (read_table(spark, sf_dir, "lineitem")
         .agg(F.datediff(F.max(F.to_date("l_shipdate")), F.min(F.to_date("l_shipdate"))))
         .first())
    return int(r[0]) + 1


def raw_sales_wide_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The wide daily export rendered as CSV text lines (one string column ``value``).

    One row per series: id columns, then net units for d_1..d_n, empty when
    the series has no line that day.  Built as a single string expression,
    so the plan never carries thousands of columns; returns the lines and
    the day column names (the file layout).
    """
    n = day_count(spark, sf_dir)
    long = net_sales_long(spark, sf_dir)
    # the days that have units, in order, per series (bounded by the calendar span); the gaps become commas
    slot = F.struct("day_no", F.coalesce(F.col("units").cast("string"), F.lit("")).alias("v"))
    per = long.groupBy(*SERIES_COLS).agg(F.array_sort(F.collect_list(slot)).alias("_days"))
    filled = F.transform("_days", lambda x, i: F.concat(
        F.repeat(F.lit(","), x["day_no"] - F.when(i == 0, F.lit(1)).otherwise(F.get("_days", i - 1)["day_no"])), x["v"]))
    days = F.concat(F.array_join(filled, ""), F.repeat(F.lit(","), F.lit(n) - F.element_at("_days", -1)["day_no"]))
    line = F.concat_ws(",", F.concat_ws("_", "item_id", "store_id"), *SERIES_COLS, days)
    return per.select(line.alias("value")), [f"d_{i}" for i in range(1, n + 1)]


def on_hand_snapshot(stats: DataFrame, sales: DataFrame) -> DataFrame:
    """The on-hand stock of each series, which the driver tables lack: an input of the planning operators.

    current_inventory = max(0, round(avg x days x factor)); the factor is picked
    from ``ON_HAND_FACTORS`` by the series' total units modulo their number.
    """
    series = ["item_id", "store_id"]
    totals = sales.groupBy(*series).agg(F.sum("sales_units").alias("_tot"))
    factors = F.array(*[F.lit(x) for x in ON_HAND_FACTORS])
    factor = F.element_at(factors, (F.pmod(F.col("_tot"), F.lit(len(ON_HAND_FACTORS))) + 1).cast("int"))
    stock = F.floor(F.col("avg_demand") * F.lit(ON_HAND_DAYS) * factor + F.lit(0.5))
    return stats.join(totals, series).select(*series, F.greatest(F.lit(0), stock).cast("int").alias("current_inventory"))
