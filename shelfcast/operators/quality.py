"""Data quality checks (V1-V7).

Each check returns a one-row DataFrame with the audit schema
``dataset, check, status, total_records, failed_records, details``.
Every statistic is one aggregate over the input (partial aggregation on the
executors, a single small final step), never a driver-side loop.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.rounding import int_div
from shelfcast.operators.quantiles import exact_quantiles

CHECK_COLUMNS = ["dataset", "check", "status", "total_records", "failed_records", "details"]


def _py_list(cols: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{c}'" for c in cols) + "]"


def fmt_1dp(x: Column) -> Column:
    """Render a non-negative double with one decimal, rounded half-up (engine independent)."""
    q = F.floor(x * F.lit(10.0) + F.lit(0.5)).cast("long")
    return F.concat(int_div(q, F.lit(10)).cast("string"), F.lit("."),
                    F.pmod(q, F.lit(10)).cast("string"))


def _row(dataset: str | Column, check: str, status: Column, total: Column,
         failed: Column, details: Column) -> list[Column]:
    ds = F.lit(dataset) if isinstance(dataset, str) else dataset
    return [ds.alias("dataset"), F.lit(check).alias("check"), status.alias("status"),
            total.cast("long").alias("total_records"), failed.cast("long").alias("failed_records"),
            details.alias("details")]


def _pass_fail(failed: Column) -> Column:
    return F.when(failed == 0, F.lit("PASSED")).otherwise(F.lit("FAILED"))


def check_missing_records(df: DataFrame, dataset_name: str, key_cols: Sequence[str]) -> DataFrame:
    """V1: null counts over the key columns; FAILED if any."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(key_cols)])
    parts = []
    for i, c in enumerate(key_cols):
        if i:
            parts.append(F.lit(", "))
        parts += [F.lit(f"'{c}': "), F.col(f"_null_{i}").cast("string")]
    total_nulls = reduce(lambda a, b: a + b, [F.col(f"_null_{i}") for i in range(len(key_cols))])
    details = F.concat(F.lit("Null counts per column: {"), *parts, F.lit("}"))
    return counts.select(*_row(dataset_name, "Missing Key Records", _pass_fail(total_nulls),
                               F.col("_n"), total_nulls, details))


def check_duplicate_records(df: DataFrame, dataset_name: str, unique_subset: Sequence[str]) -> DataFrame:
    """V2: rows beyond the first per key (null keys compare equal, as in a group by)."""
    per_key = df.groupBy(*unique_subset).agg(F.count(F.lit(1)).alias("_c"))
    stats = per_key.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_n"),
                        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("_dup"))
    details = F.concat(F.lit(f"Duplicates on {_py_list(unique_subset)}: "), F.col("_dup").cast("string"))
    return stats.select(*_row(dataset_name, "Duplicate Key Records", _pass_fail(F.col("_dup")),
                              F.col("_n"), F.col("_dup"), details))


def check_pricing_integrity(prices: DataFrame, max_price: float = 1000.0) -> DataFrame:
    """V3: prices that are null, <= 0 or above the commercial ceiling."""
    p = F.col("sell_price")
    stats = prices.agg(F.count(F.lit(1)).alias("_n"),
                       F.count_if((p <= 0) | (p > max_price) | p.isNull()).alias("_bad"))
    details = F.concat(F.lit("Records with price <= 0 or > $1000: "), F.col("_bad").cast("string"))
    return stats.select(*_row("sell_prices", "Pricing Integrity", _pass_fail(F.col("_bad")),
                              F.col("_n"), F.col("_bad"), details))


def check_sales_outliers(sales: DataFrame, iqr_mult: float = 4.0) -> DataFrame:
    """V4: units above q75 + 4*IQR; status is always INFO.

    The exact quartiles (linear interpolation) come from a few passes over the
    units (``quantiles.exact_quantiles``); one more counts what is above.
    """
    lower, upper = exact_quantiles(sales, "sales_units", [0.25, 0.75])
    bound = F.lit(None if lower is None else upper + iqr_mult * (upper - lower)).cast("double")
    stats = sales.agg(F.count(F.lit(1)).alias("_total"), F.count_if(F.col("sales_units") > bound).alias("_out")).withColumn("_b", bound)
    details = F.concat(F.lit("Sales units > "), fmt_1dp(F.col("_b")), F.lit(" ("),
                       F.col("_out").cast("string"), F.lit(" high spikes flagged for awareness)"))
    return stats.select(*_row("sales", "Sales Outlier Detection", F.lit("INFO"),
                              F.col("_total"), F.col("_out"), details))


def check_date_completeness(calendar: DataFrame, date_col: str = "date_str") -> DataFrame:
    """V5: (max - min + 1) - distinct days; total_records is the distinct day count."""
    d = F.to_date(F.col(date_col))
    stats = calendar.agg(F.min(d).alias("_lo"), F.max(d).alias("_hi"),
                         F.count_distinct(d).alias("_days"))
    missing = F.datediff("_hi", "_lo") + 1 - F.col("_days")
    details = F.concat(F.lit("Date span "), F.date_format("_lo", "yyyy-MM-dd"), F.lit(" to "),
                       F.date_format("_hi", "yyyy-MM-dd"), F.lit(", missing days: "),
                       missing.cast("string"))
    return stats.select(*_row("calendar", "Date Continuity & Completeness", _pass_fail(missing),
                              F.col("_days"), F.greatest(missing, F.lit(0)), details))


def check_foreign_key(fact: DataFrame, dim: DataFrame, keys: Sequence[str], dataset_name: str,
                      dim_name: str) -> DataFrame:
    """V7: fact rows whose key has no dimension row (declared FK, checked by anti join)."""
    orphans = fact.select(*keys).join(dim.select(*keys).distinct(), list(keys), "left_anti")
    stats = fact.agg(F.count(F.lit(1)).alias("_n")).select(
        "_n", orphans.agg(F.count(F.lit(1))).scalar().alias("_bad"))
    details = F.concat(F.lit(f"Rows without {dim_name} on {_py_list(keys)}: "),
                       F.col("_bad").cast("string"))
    return stats.select(*_row(dataset_name, "Foreign Key Integrity", _pass_fail(F.col("_bad")),
                              F.col("_n"), F.col("_bad"), details))


def key_checks(df: DataFrame, dataset: str, keys: Sequence[str], not_null: Sequence[str], max_price: float | None = None,
               dates: bool = False) -> DataFrame:
    """V1 and V2 of a dataset, with V3 (``max_price``) or V5 (``dates``), from one aggregate by key.

    Each key's rows are counted with their nulls and bad prices; one more
    aggregate sums the keys.  The rows carry ``_at``, their order here.
    """
    p = F.col("sell_price")
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_c"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(not_null)],
        *([F.count_if((p <= 0) | (p > max_price) | p.isNull()).alias("_bad")] if max_price is not None else []))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    d = F.to_date(keys[0]) if dates else None
    stats = per_key.agg(
        total("_c").alias("_n"), total(F.col("_c") - 1).alias("_dup"), *[total(f"_null_{i}").alias(f"_null_{i}") for i in range(len(not_null))],
        *([total("_bad").alias("_bad")] if max_price is not None else []),
        *([F.min(d).alias("_lo"), F.max(d).alias("_hi"), F.count_distinct(d).alias("_days")] if dates else []))
    nulls = reduce(lambda a, b: a + b, [F.col(f"_null_{i}") for i in range(len(not_null))])
    listed = F.concat_ws(", ", *[F.concat(F.lit(f"'{c}': "), F.col(f"_null_{i}").cast("string")) for i, c in enumerate(not_null)])
    rows = [_row(dataset, "Missing Key Records", _pass_fail(nulls), F.col("_n"), nulls, F.concat(F.lit("Null counts per column: {"), listed, F.lit("}"))),
            _row(dataset, "Duplicate Key Records", _pass_fail(F.col("_dup")), F.col("_n"), F.col("_dup"),
                 F.concat(F.lit(f"Duplicates on {_py_list(keys)}: "), F.col("_dup").cast("string")))]
    if max_price is not None:
        rows.append(_row(dataset, "Pricing Integrity", _pass_fail(F.col("_bad")), F.col("_n"), F.col("_bad"),
                         F.concat(F.lit("Records with price <= 0 or > $1000: "), F.col("_bad").cast("string"))))
    if dates:
        missing = F.datediff("_hi", "_lo") + 1 - F.col("_days")
        rows.append(_row(dataset, "Date Continuity & Completeness", _pass_fail(missing), F.col("_days"), F.greatest(missing, F.lit(0)),
                         F.concat(F.lit("Date span "), F.date_format("_lo", "yyyy-MM-dd"), F.lit(" to "), F.date_format("_hi", "yyyy-MM-dd"),
                                  F.lit(", missing days: "), missing.cast("string"))))
    return stats.select(F.inline(F.array(*[F.struct(*r, F.lit(i).alias("_at")) for i, r in enumerate(rows)])))


def run_all_checks(calendar: DataFrame, prices: DataFrame, sales: DataFrame) -> DataFrame:
    """V6: the nine standard checks as one DataFrame (check order kept in ``check_no``).

    One keyed aggregate per dataset; the sales are read a few times more for
    the quartiles of V4, so pass them staged.
    """
    parts = [
        (1, key_checks(calendar, "calendar", ["date_str"], ["date_str", "wm_yr_wk", "wday"], dates=True)),
        (4, key_checks(prices, "sell_prices", ["store_id", "item_id", "wm_yr_wk"], ["store_id", "item_id", "wm_yr_wk", "sell_price"], max_price=1000.0)),
        (7, key_checks(sales, "sales", ["item_id", "store_id", "date_str"], ["item_id", "store_id", "date_str", "sales_units"])),
        (9, check_sales_outliers(sales).withColumn("_at", F.lit(0))),
    ]
    return reduce(DataFrame.unionByName, [c.withColumn("check_no", F.col("_at") + first).drop("_at") for first, c in parts])


# V7, the declared constraints of each warehouse table: primary key (empty: a generated number),
# further NOT NULL columns, foreign keys (column, table; the referenced column has the same name)
CONSTRAINTS = {
    "dim_stores": (["store_id"], ["state_id"], []),
    "dim_categories": (["cat_id"], [], []),
    "dim_departments": (["dept_id"], ["cat_id"], [("cat_id", "dim_categories")]),
    "dim_products": (["item_id"], ["dept_id", "cat_id"], [("dept_id", "dim_departments"), ("cat_id", "dim_categories")]),
    "dim_calendar": (["date_str"], ["wm_yr_wk", "weekday", "wday", "month", "year", "d_id"], []),
    "fact_sales": (["item_id", "store_id", "date_str"], ["sales_units"],
                   [("item_id", "dim_products"), ("store_id", "dim_stores"), ("date_str", "dim_calendar")]),
    "fact_prices": (["store_id", "item_id", "wm_yr_wk"], ["sell_price"], [("item_id", "dim_products"), ("store_id", "dim_stores")]),
    "fact_forecast_results": ([], ["forecast_date", "item_id", "store_id", "model_used", "forecast_demand", "horizon_days"], []),
    "fact_inventory_recommendations": (
        [], ["evaluation_date", "item_id", "store_id", "current_inventory", "average_daily_demand", "demand_std_dev", "lead_time_days",
             "safety_stock", "reorder_point", "forecast_demand_lt", "recommended_order_qty", "days_of_supply", "inventory_status",
             "risk_level", "stockout_risk_pct", "overstock_risk_pct"], []),
}


def table_constraints(name: str, tables: dict[str, DataFrame], primary_key: Sequence[str], not_null: Sequence[str],
                      foreign_keys: Sequence[tuple[str, str]]) -> DataFrame:
    """V7 for one table, from one scan of it: primary key, NOT NULL columns, and each foreign key.

    Every row gets a membership mark per foreign key (a left join with the
    referenced keys, which the planner sizes); rows are then counted by primary key with
    their nulls and missing marks, and the keys are summed.  Without a primary key
    the rows are counted directly.  A null foreign key has no row either.
    """
    columns = list(dict.fromkeys([*primary_key, *not_null, *[c for c, _ in foreign_keys]]))
    nulls = list(dict.fromkeys([*primary_key, *not_null]))
    rows = tables[name].select(*columns)
    for i, (c, dim) in enumerate(foreign_keys):
        keys = tables[dim].select(F.col(c).alias(f"_k{i}")).distinct()
        rows = rows.join(keys, F.col(c) == F.col(f"_k{i}"), "left")
    counts = [F.count(F.lit(1)).alias("_c"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(nulls)],
              *[F.count_if(F.col(f"_k{i}").isNull()).alias(f"_orphan_{i}") for i in range(len(foreign_keys))]]
    names = [f"_null_{i}" for i in range(len(nulls))] + [f"_orphan_{i}" for i in range(len(foreign_keys))]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    if primary_key:
        stats = rows.groupBy(*primary_key).agg(*counts).agg(total("_c").alias("_n"), total(F.col("_c") - 1).alias("_dup"), *[total(c).alias(c) for c in names])
    else:
        stats = rows.agg(*counts).withColumnRenamed("_c", "_n")
    out = []
    if primary_key:
        out.append(_row(name, "Primary Key Uniqueness", _pass_fail(F.col("_dup")), F.col("_n"), F.col("_dup"),
                        F.concat(F.lit(f"Duplicates on {_py_list(primary_key)}: "), F.col("_dup").cast("string"))))
    if nulls:
        bad = reduce(lambda a, b: a + b, [F.col(f"_null_{i}") for i in range(len(nulls))])
        listed = F.concat_ws(", ", *[F.concat(F.lit(f"'{c}': "), F.col(f"_null_{i}").cast("string")) for i, c in enumerate(nulls)])
        out.append(_row(name, "Not Null Columns", _pass_fail(bad), F.col("_n"), bad, F.concat(F.lit("Null counts per column: {"), listed, F.lit("}"))))
    for i, (c, dim) in enumerate(foreign_keys):
        bad = F.col(f"_orphan_{i}")
        out.append(_row(name, "Foreign Key Integrity", _pass_fail(bad), F.col("_n"), bad,
                        F.concat(F.lit(f"Rows without {dim} on {_py_list([c])}: "), bad.cast("string"))))
    return stats.select(F.inline(F.array(*[F.struct(*r) for r in out])))


def constraint_suite(tables: dict[str, DataFrame], constraints: dict = CONSTRAINTS) -> DataFrame:
    """V7 over the declared constraints of the tables given by name (those that aren't given are left out)."""
    return reduce(DataFrame.unionByName, [table_constraints(n, tables, *spec) for n, spec in constraints.items() if n in tables])


def foreign_key_suite(tables: dict[str, DataFrame]) -> DataFrame:
    """The foreign keys alone, every table scanned once for all of its own."""
    return reduce(DataFrame.unionByName, [table_constraints(n, tables, [], [], fks) for n, (_, _, fks) in CONSTRAINTS.items() if fks])


def summarize_checks(checks: DataFrame) -> DataFrame:
    """V6 summary: total / passed / failed / info counts (one row)."""
    s = F.col("status")
    return checks.agg(F.count(F.lit(1)).alias("total_checks"),
                      F.count_if(s == "PASSED").alias("passed_checks"),
                      F.count_if(s == "FAILED").alias("failed_checks"),
                      F.count_if(s == "INFO").alias("info_checks"))
