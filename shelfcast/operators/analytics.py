"""Analytical queries behind the dashboard, reports and scenarios.

Per-SKU drill-downs take an optional item/store; without one they run for
every series at once (window functions partitioned by the series), which is
how a batch job precomputes the explorer.  Global KPIs are single
aggregates; top-k reports use ``orderBy(...).limit(k)`` (Spark plans a
TakeOrderedAndProject: per-partition top-k, then a k-row merge).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions import inventory as inv
from shelfcast.functions.rounding import half_up, ratio_half_up

SERIES = ["item_id", "store_id"]
# Fixed values of the dashboard and report formulas (unit price for approximate
# revenue, unit value, base lead time, price elasticity, demand-value markup)
APPROX_UNIT_PRICE = 5.50
UNIT_VALUE = 5.00
BASE_LEAD_TIME = 7
PRICE_ELASTICITY = -1.2
DEMAND_VALUE_MARKUP = 1.6
PLANNING_COLUMNS = ["item_id", "store_id", "current_inventory", "average_daily_demand",
                    "safety_stock", "reorder_point", "recommended_order_qty",
                    "days_of_supply", "inventory_status", "risk_level",
                    "stockout_risk_pct", "suggested_replenishment_date", "estimated_order_cost"]
FORECAST_SHEET_COLUMNS = ["forecast_date", "item_id", "store_id", "model_used", "forecast_demand",
                          "confidence_lower", "confidence_upper", "horizon_days"]


def _cents_sum(col: str) -> Column:
    """Exact sum of a 2-decimal double column (as whole cents), returned in units."""
    return F.sum(F.round(F.col(col) * F.lit(100.0)).cast("long")) / F.lit(100.0)


def sales_totals(fact_sales: DataFrame) -> DataFrame:
    """Q1: total units and approximate revenue (units x 5.50)."""
    return fact_sales.agg(F.sum("sales_units").alias("total_units_sold")).select(
        "total_units_sold", (F.col("total_units_sold") * F.lit(APPROX_UNIT_PRICE)).alias("total_revenue_approx"))


def forward_total(forecasts: DataFrame, horizon: int = 30) -> DataFrame:
    """Q2: total forward forecast for one horizon."""
    return (forecasts.filter(F.col("actual_demand").isNull() & (F.col("horizon_days") == horizon))
            .agg(_cents_sum("forecast_demand").alias("total_forecast_demand")))


def _kpi_aggs() -> list[Column]:
    rl, st = F.col("risk_level"), F.col("inventory_status")
    return [F.count_distinct("item_id").alias("total_skus"),
            F.sum("current_inventory").alias("total_inventory_units"),
            F.count_if(rl == inv.HIGH).alias("high_risk_count"),
            F.count_if(st == inv.CRITICAL).alias("stockout_count"),
            F.count_if(st == inv.OVERSTOCK).alias("overstock_count"),
            F.sum("recommended_order_qty").alias("total_order_qty"),
            F.sum(F.col("estimated_order_cost").cast("decimal(14,2)")).alias("total_order_cost")]


def inventory_kpis(recs: DataFrame) -> DataFrame:
    """Q3: network inventory KPIs."""
    return recs.agg(*_kpi_aggs())


def category_mix(product_mart: DataFrame) -> DataFrame:
    """Q4: revenue and units per category and the category's share of revenue (%)."""
    total = product_mart.agg(F.sum("total_revenue")).scalar()
    return (product_mart.groupBy("cat_id")
            .agg(F.sum("total_revenue").alias("total_revenue"), F.sum("total_units_sold").alias("total_units"))
            .withColumn("revenue_share_pct",
                        half_up(F.col("total_revenue").cast("double") / total.cast("double") * F.lit(100.0), 2)))


def monthly_trend(monthly: DataFrame) -> DataFrame:
    """Q5: network units and revenue per month with a 'YYYY-Mmm' label, in calendar order."""
    return (monthly.groupBy("year", "month")
            .agg(F.sum("monthly_sales_units").alias("units"), F.sum("monthly_revenue").alias("revenue"))
            .withColumn("period", F.concat(F.col("year").cast("string"), F.lit("-M"),
                                           F.lpad(F.col("month").cast("string"), 2, "0")))
            .orderBy("year", "month"))


def health_score(recs: DataFrame) -> DataFrame:
    """Q6: 100 - high-risk series per distinct SKU (%), clipped to [0, 100]."""
    k = inventory_kpis(recs)
    score = F.lit(100.0) - F.col("high_risk_count") / F.greatest(F.lit(1), F.col("total_skus")) * F.lit(100.0)
    return k.select("total_skus", "high_risk_count",
                    half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 1).alias("health_score"),
                    half_up(F.col("high_risk_count") / F.greatest(F.lit(1), F.col("total_skus")) * F.lit(100.0), 1)
                    .alias("high_risk_catalog_pct"))


def store_scorecard(store_mart: DataFrame) -> DataFrame:
    """Q7: store table with display strings ('$1,234.56', '1,234')."""
    return store_mart.select(
        "store_id", "store_name", "region", "total_units_sold", "total_gross_revenue",
        F.concat(F.lit("$"), F.format_number(F.col("total_gross_revenue").cast("double"), 2)).alias("revenue_display"),
        F.format_number(F.col("total_units_sold").cast("double"), 0).alias("units_display"))


def hierarchy(products: DataFrame, departments: DataFrame, cat_id: str | Column | None = None,
              dept_id: str | Column | None = None) -> DataFrame:
    """Q8: products of the selected department (default: first department of the
    selected/first category); all products when the department has none."""
    cat = F.lit(cat_id) if isinstance(cat_id, str) else cat_id
    if cat is None:
        cat = departments.agg(F.min("cat_id")).scalar()
    dept = F.lit(dept_id) if isinstance(dept_id, str) else dept_id
    if dept is None:
        dept = departments.filter(F.col("cat_id") == cat).agg(F.min("dept_id")).scalar()
    in_dept = products.filter(F.col("dept_id") == dept).agg(F.count(F.lit(1))).scalar()
    return (products.filter((F.col("dept_id") == dept) | (in_dept == 0))
            .select("item_id", "dept_id", "cat_id", "product_name", "unit_cost")
            .orderBy("item_id"))


def hierarchy_levels(stores: DataFrame, departments: DataFrame) -> DataFrame:
    """Q8: the lists above the products: stores, categories, and departments under their category."""
    def level(name: str, df: DataFrame, parent: Column, key: str) -> DataFrame:
        return df.select(F.lit(name).alias("level"), parent.alias("parent_id"), F.col(key).alias("id")).distinct()

    none = F.lit(None).cast("string")
    return (level("store", stores, none, "store_id").unionByName(level("category", departments, none, "cat_id"))
            .unionByName(level("department", departments, F.col("cat_id"), "dept_id")))


def _series_filter(df: DataFrame, item: str | None, store: str | None) -> DataFrame:
    if item is not None:
        df = df.filter(F.col("item_id") == item)
    if store is not None:
        df = df.filter(F.col("store_id") == store)
    return df


def sku_history(fact_sales: DataFrame, item: str | None = None, store: str | None = None,
                last_n: int | None = None) -> DataFrame:
    """Q9: daily history of a SKU (or all series); optionally only the last ``last_n`` days."""
    df = _series_filter(fact_sales, item, store).select(*SERIES, "date_str", "sales_units")
    if last_n is not None:
        w = Window.partitionBy(*SERIES).orderBy(F.col("date_str").desc())
        df = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= last_n).drop("_rn")
    return df


def sku_forecast(forecasts: DataFrame, horizon: int, item: str | None = None,
                 store: str | None = None) -> DataFrame:
    """Q10: forward forecast rows of a horizon, first ``horizon`` dates per series and model."""
    df = _series_filter(forecasts, item, store).filter(
        F.col("actual_demand").isNull() & (F.col("horizon_days") == horizon))
    w = Window.partitionBy(*SERIES, "model_used").orderBy("forecast_date")
    return (df.withColumn("_rn", F.dense_rank().over(w)).filter(F.col("_rn") <= horizon)
            .select(*SERIES, "forecast_date", "model_used", "forecast_demand", "confidence_lower",
                    "confidence_upper", "horizon_days"))


def sku_kpis(fact_sales: DataFrame, forecasts: DataFrame, products: DataFrame, horizon: int = 30,
             item: str | None = None, store: str | None = None) -> DataFrame:
    """Q11: per series: 30-day average demand, horizon total and daily run-rate, growth %
    against max(0.1, history) and demand value = total x unit cost x 1.6."""
    hist = (sku_history(fact_sales, item, store, last_n=30).groupBy(*SERIES)
            .agg((F.sum("sales_units") / F.count("sales_units")).alias("avg_hist_demand")))
    fc = (sku_forecast(forecasts, horizon, item, store).groupBy(*SERIES)
          .agg(_cents_sum("forecast_demand").alias("total_horizon_forecast"),
               (_cents_sum("forecast_demand") / F.count(F.lit(1))).alias("avg_forecast_daily")))
    cost = products.select("item_id", "unit_cost")
    df = hist.join(fc, SERIES, "left").join(cost, "item_id", "left")
    tot = F.coalesce("total_horizon_forecast", F.lit(0.0))
    avg_fc = F.coalesce("avg_forecast_daily", F.lit(0.0))
    growth = (avg_fc - F.col("avg_hist_demand")) / F.greatest(F.lit(0.1), F.col("avg_hist_demand")) * F.lit(100.0)
    return df.select(*SERIES, half_up("avg_hist_demand", 2).alias("avg_hist_demand"),
                     half_up(tot, 2).alias("total_horizon_forecast"), half_up(avg_fc, 2).alias("avg_forecast_daily"),
                     half_up(growth, 1).alias("growth_pct"),
                     half_up(tot * F.coalesce(F.col("unit_cost"), F.lit(UNIT_VALUE)) * F.lit(DEMAND_VALUE_MARKUP), 2)
                     .alias("demand_value"))


def forecast_schedule(sku_fc: DataFrame) -> DataFrame:
    """Q12: schedule projection of a SKU forecast."""
    keep = [c for c in SERIES if c in sku_fc.columns]
    return sku_fc.select(*keep, "forecast_date", "forecast_demand", "confidence_lower",
                         "confidence_upper", "model_used")


def filter_recs(recs: DataFrame, store: str | None = None, risk: str | None = None,
                status: str | None = None) -> DataFrame:
    """Q13: optional store / risk level / status filters (pushed into the plan)."""
    if store is not None:
        recs = recs.filter(F.col("store_id") == store)
    if risk is not None:
        recs = recs.filter(F.col("risk_level") == risk)
    if status is not None:
        recs = recs.filter(F.col("inventory_status") == status)
    return recs


def filtered_kpis(recs: DataFrame) -> DataFrame:
    """Q14: on hand, order units, order cost, high-risk count, average days of supply."""
    return recs.agg(F.sum("current_inventory").alias("total_on_hand"),
                    F.sum("recommended_order_qty").alias("total_reorder_qty"),
                    F.sum(F.col("estimated_order_cost").cast("decimal(14,2)")).alias("total_po_cost"),
                    F.count_if(F.col("risk_level") == inv.HIGH).alias("high_risk_items"),
                    F.coalesce(ratio_half_up(F.sum(F.round(F.col("days_of_supply") * F.lit(10.0)).cast("long")),
                                             F.count("days_of_supply"), 1, 1), F.lit(0.0)).alias("avg_days_of_supply"),
                    F.count(F.lit(1)).alias("filtered_skus"))


def risk_distribution(recs: DataFrame) -> DataFrame:
    """Q15."""
    return recs.groupBy("risk_level").agg(F.count(F.lit(1)).alias("count"))


def top_reorders(recs: DataFrame, n: int = 10) -> DataFrame:
    """Q16: top-n by recommended order quantity (ties: item, store)."""
    return (recs.orderBy(F.col("recommended_order_qty").desc(), "item_id", "store_id").limit(n)
            .select(*SERIES, "current_inventory", "safety_stock", "recommended_order_qty"))


def holdout_rows(forecasts: DataFrame) -> DataFrame:
    """Q17: holdout (actual known) rows."""
    return forecasts.filter(F.col("actual_demand").isNotNull()).select(
        "model_used", "forecast_date", "item_id", "store_id", "actual_demand", "forecast_demand",
        "forecast_error", "horizon_days")


def scenario_impact(recs: DataFrame, scenarios: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Q18: what-if impact of each scenario row on the network, or on each group of ``by``.

    scenarios: (scenario_id, price_change_pct, promo_uplift_pct,
    holiday_surge_pct, lead_time_delay_days) - many scenarios in one job.
    The network baseline is one aggregate over the recommendations, read as
    a single struct-valued scalar subquery (evaluated once; no join).  With
    ``by``, one aggregate row per group takes up the parameter table as an array.
    """
    demand = _cents_sum("average_daily_demand")          # exact: values carry 2 decimals
    risk_tenths = F.sum(F.round(F.col("stockout_risk_pct") * F.lit(10.0)).cast("long"))
    base = F.struct(
        demand.alias("demand"),
        F.sum("safety_stock").alias("ss"),
        F.sum("recommended_order_qty").alias("qty"),
        (demand * F.lit(APPROX_UNIT_PRICE)).alias("revenue"),
        F.sum(F.col("estimated_order_cost").cast("decimal(14,2)")).cast("double").alias("cost"),
        F.sum("current_inventory").alias("on_hand"),
        (risk_tenths / F.count(F.lit(1)) / F.lit(10.0)).alias("risk"))
    by = list(by)
    if by:
        table = scenarios.agg(F.collect_list(F.struct(*scenarios.columns))).scalar()
        scenarios = recs.groupBy(*by).agg(base.alias("_base")).withColumn("_s", F.explode(table)).select(*by, "_base", "_s.*")
    else:
        # one subquery in the plan: attach it once, then read its fields
        scenarios = scenarios.withColumn("_base", recs.agg(base).scalar())
    b = F.col("_base")
    b_dem, b_ss, b_qty, b_rev = b["demand"], b["ss"], b["qty"], b["revenue"]
    b_cost, on_hand, b_risk = b["cost"], b["on_hand"], b["risk"]
    p = F.col("price_change_pct") / F.lit(100.0)
    mult = F.greatest(F.lit(0.1), F.lit(1.0) + F.lit(PRICE_ELASTICITY) * p
                      + F.col("promo_uplift_pct") / F.lit(100.0) + F.col("holiday_surge_pct") / F.lit(100.0))
    sim_lt = F.lit(BASE_LEAD_TIME) + F.col("lead_time_delay_days")
    sim_demand = b_dem * mult
    sim_rev = b_rev * mult * (F.lit(1.0) + p)
    sim_ss = F.floor(b_ss * F.sqrt(sim_lt / F.lit(float(BASE_LEAD_TIME))) * F.sqrt(mult)
                     + F.lit(0.5)).cast("long")
    sim_qty = F.floor(F.greatest(F.lit(0.0), sim_demand * sim_lt + sim_ss - on_hand) + F.lit(0.5)).cast("long")
    sim_risk = F.least(F.lit(100.0), F.greatest(F.lit(0.0), b_risk * mult
                                                * (F.lit(1.0) + F.col("lead_time_delay_days") / F.lit(10.0))))
    return scenarios.select(
        *by, "scenario_id", half_up(mult, 4).alias("demand_multiplier"),
        half_up(b_dem, 2).alias("baseline_daily_demand"), half_up(sim_demand, 2).alias("sim_daily_demand"),
        half_up(b_rev, 2).alias("baseline_daily_revenue"), half_up(sim_rev, 2).alias("sim_daily_revenue"),
        b_ss.alias("baseline_safety_stock"), sim_ss.alias("sim_safety_stock"),
        b_qty.alias("baseline_reorder_qty"), sim_qty.alias("sim_reorder_qty"),
        half_up(b_cost, 2).alias("baseline_order_cost"), (sim_qty * F.lit(UNIT_VALUE)).alias("sim_order_cost"),
        half_up(b_risk, 2).alias("baseline_stockout_risk"), half_up(sim_risk, 2).alias("sim_stockout_risk"),
        half_up((sim_demand - b_dem) / b_dem * F.lit(100.0), 1).alias("demand_delta_pct"),
        half_up((sim_rev - b_rev) / b_rev * F.lit(100.0), 1).alias("revenue_delta_pct"),
        half_up((sim_ss - b_ss) / b_ss * F.lit(100.0), 1).alias("safety_stock_delta_pct"),
        half_up(sim_risk - b_risk, 1).alias("risk_delta"))


def kpi_summary(recs: DataFrame, reporting_date: Column | None = None) -> DataFrame:
    """Executive summary as (metric_no, metric, value) text rows."""
    d = reporting_date if reporting_date is not None else F.date_format(F.current_date(), "yyyy-MM-dd")
    a = recs.agg(F.count(F.lit(1)).alias("n"), F.sum("current_inventory").alias("inv"),
                 F.sum("recommended_order_qty").alias("qty"),
                 F.sum(F.col("estimated_order_cost").cast("decimal(14,2)")).alias("cost"),
                 F.count_if(F.col("inventory_status") == inv.CRITICAL).alias("so"),
                 F.count_if(F.col("inventory_status") == inv.OVERSTOCK).alias("os"),
                 F.count_distinct("store_id").alias("stores"))
    rows = [
        ("Total Monitored SKUs", F.col("n").cast("string")),
        ("Total On-Hand Inventory Units", F.format_number(F.col("inv").cast("double"), 0)),
        ("Total Forecast Replenishment Units", F.format_number(F.col("qty").cast("double"), 0)),
        ("Estimated Replenishment Cost", F.concat(F.lit("$"), F.format_number(F.col("cost"), 2))),
        ("Critical Stockout Alert Count", F.col("so").cast("string")),
        ("Excess Overstock Alert Count", F.col("os").cast("string")),
        ("Stores Operating", F.col("stores").cast("string")),
        ("Reporting Date", d),
    ]
    arr = F.array(*[F.struct(F.lit(i + 1).alias("metric_no"), F.lit(m).alias("metric"), v.alias("value"))
                    for i, (m, v) in enumerate(rows)])
    return a.select(F.inline(arr))


def planning_sheet(recs: DataFrame) -> DataFrame:
    """R2."""
    return recs.select(*[c for c in PLANNING_COLUMNS if c in recs.columns])


def forecast_sheet(forecasts: DataFrame, n: int | None = None) -> DataFrame:
    """Forward rows in (date, item, store, model, horizon) order; the first ``n`` if the caller asks for a page."""
    sheet = (forecasts.filter(F.col("actual_demand").isNull())
             .orderBy("forecast_date", "item_id", "store_id", "model_used", "horizon_days"))
    return (sheet if n is None else sheet.limit(n)).select(*FORECAST_SHEET_COLUMNS)


def store_sheet(store_mart: DataFrame) -> DataFrame:
    """R4."""
    return store_mart


def briefing_totals(recs: DataFrame) -> DataFrame:
    """SKUs, on hand, order units, cost, high-risk share %, stockouts."""
    return recs.agg(F.count(F.lit(1)).alias("total_skus"), F.sum("current_inventory").alias("total_inventory"),
                    F.sum("recommended_order_qty").alias("total_reorder"),
                    F.sum(F.col("estimated_order_cost").cast("decimal(14,2)")).alias("total_cost"),
                    F.count_if(F.col("risk_level") == inv.HIGH).alias("high_risk_count"),
                    F.count_if(F.col("inventory_status") == inv.CRITICAL).alias("stockouts")) \
        .withColumn("high_risk_share_pct",
                    half_up(F.col("high_risk_count") / F.greatest(F.lit(1), F.col("total_skus")) * F.lit(100.0), 1))


def priority_items(recs: DataFrame, n: int = 12) -> DataFrame:
    """Top-n high-risk series by stockout risk, labelled Stockout / Overstock."""
    return (recs.filter(F.col("risk_level") == inv.HIGH)
            .orderBy(F.col("stockout_risk_pct").desc(), "item_id", "store_id").limit(n)
            .select(*SERIES, "current_inventory", "safety_stock", "reorder_point", "recommended_order_qty",
                    "suggested_replenishment_date", "stockout_risk_pct",
                    F.when(F.col("inventory_status") == inv.CRITICAL, F.lit("Stockout"))
                    .otherwise(F.lit("Overstock")).alias("alert_type")))
