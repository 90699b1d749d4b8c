"""The nightly batch run: ETL -> SQL models -> forecasting -> inventory -> marts -> reports.

Each stage writes its tables (Parquet) under one run folder in the shared
checkpoint location and the next stage reads them back: lineage is cut at
every stage boundary, a lost executor only recomputes inside the current
stage, and every table can be inspected after the run.  The two marts that
depend on forecasts and recommendations are built after those exist (the
source platform built them first and so lagged a run).
"""

from __future__ import annotations

import time
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfcast.operators import analytics, clean, dims, evaluate, marts, quality
from shelfcast.plans.warehouse import ModelRun, Warehouse, decimals_to_double
from shelfcast.session import shared_dir
from shelfcast.sources import io

SERIES = ["item_id", "store_id"]


class StageWriter:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.tables, self.timings = spark, root.rstrip("/"), {}, {}
        self.bucketed: list[str] = []

    def put_bucketed(self, name: str, df: DataFrame, keys, sort_by=()) -> DataFrame:
        """Stage table bucketed by the series key, so later stages reuse its partitioning."""
        path = f"{self.root}/{name}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"{name}_{uuid.uuid4().hex[:10]}"
        out = io.write_bucketed(df, table, path, keys, buckets, sort_by)
        self.bucketed.append(table)
        self.tables[name] = path
        return out

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.tables[name] = path
        return self.spark.read.parquet(path)

    def stage(self, name: str, fn: Callable[[], None]) -> None:
        t0 = time.time()
        fn()
        self.timings[name] = round(time.time() - t0, 3)


def run_platform(spark: SparkSession, sf_dir: str, out_dir: str | None = None, test_days: int = 30,
                 gbt_params: dict | None = None, with_models: bool = True) -> dict:
    """Run every stage over the driver tables in ``sf_dir``; returns table paths and stage timings."""
    out = StageWriter(spark, out_dir or shared_dir(spark, "platform-run"))
    # joins keyed on (store, item, week) may reuse the (item, store) bucketing
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return _run(spark, sf_dir, out, test_days, gbt_params, with_models)
    finally:
        spark.conf.set(setting, before)
        for table in out.bucketed:  # external tables: the files stay
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def _run(spark: SparkSession, sf_dir: str, out: StageWriter, test_days: int, gbt_params: dict | None, with_models: bool) -> dict:
    raw = Warehouse(spark, sf_dir)
    t: dict[str, DataFrame] = {}

    def etl():
        t["calendar"] = out.put("processed_calendar", raw.clean_calendar)
        t["prices"] = out.put("processed_prices", clean.clean_prices(raw.raw_prices))
        t["sales"] = out.put("processed_sales", clean.clean_and_melt_sales(raw.raw_sales_wide, t["calendar"]))
        checks = out.put("quality_checks", quality.run_all_checks(t["calendar"], t["prices"], t["sales"]))
        io.append_validation_log(checks, path=f"{out.root}/sys_validation_logs")
        io.write_quality_report(checks, f"{out.root}/data_quality_report")
        t["dim_calendar"] = out.put("dim_calendar", dims.dim_calendar(t["calendar"]))
        # both facts bucketed by series: the price join, the series windows and the
        # per-series aggregates downstream then run without shuffling the facts again
        t["fact_sales"] = out.put_bucketed("fact_sales", dims.fact_sales_table(t["sales"]), SERIES,
                                           SERIES + ["date_str"])
        t["fact_prices"] = out.put_bucketed("fact_prices", dims.fact_prices_table(t["prices"]), SERIES)
        for name, fn in (("dim_stores", dims.dim_stores), ("dim_categories", dims.dim_categories),
                         ("dim_departments", dims.dim_departments)):
            t[name] = out.put(name, fn(t["fact_sales"]))
        t["dim_products"] = out.put("dim_products", dims.dim_products(t["fact_sales"], t["fact_prices"]))

    def models_sql():
        daily = marts.int_daily_sales(marts.stg_sales(t["fact_sales"]), marts.stg_calendar(t["dim_calendar"]),
                                      marts.stg_prices(t["fact_prices"]))
        t["daily"] = out.put("int_daily_sales", daily)
        out.put("int_weekly_sales", marts.int_weekly_sales(t["daily"]))
        t["monthly"] = out.put("int_monthly_sales", marts.int_monthly_sales(t["daily"]))
        t["product_mart"] = out.put("mart_product_performance", marts.mart_product_performance(t["daily"]))
        t["store_mart"] = out.put("mart_store_performance",
                                  marts.mart_store_performance(t["daily"], t["dim_stores"]))

    w = Warehouse(spark, sf_dir)

    def forecasting():
        for k in ("fact_sales", "fact_prices", "dim_calendar", "dim_products"):
            w.__dict__[k] = t[k]
        w.__dict__["calendar"] = t["calendar"]
        if with_models:
            run = ModelRun(w, test_days, gbt_params)
            t["forecasts"] = out.put("fact_forecast_results", run.fact_forecast_results)
            out.put("feature_importances", run.tree.feature_importances(spark))
            out.put("additive_coefficients", run.coefficients)
        else:
            t["forecasts"] = out.put("fact_forecast_results", w.forecasts)

    def inventory():
        w.__dict__["forecasts"] = t["forecasts"]
        t["recs"] = out.put("fact_inventory_recommendations", w.recommendations)

    def late_marts():
        out.put("mart_inventory_health", marts.mart_inventory_health(t["recs"]))
        out.put("mart_forecast_accuracy", marts.mart_forecast_accuracy(t["forecasts"]))
        out.put("forecast_scorecard", evaluate.scorecard(t["forecasts"]))

    def reports():
        recs = t["recs"]
        out.put("report_kpi_summary", analytics.kpi_summary(recs))
        io.export_csv(decimals_to_double(analytics.planning_sheet(recs)), f"{out.root}/report_inventory_planning")
        io.export_csv(analytics.forecast_sheet(t["forecasts"]), f"{out.root}/report_demand_forecasts")
        io.export_csv(decimals_to_double(t["store_mart"]), f"{out.root}/report_store_performance")
        out.put("report_briefing_totals", analytics.briefing_totals(recs))
        out.put("report_priority_items", analytics.priority_items(recs))
        io.export_csv(decimals_to_double(io.purchase_orders(recs)), f"{out.root}/purchase_orders")

    for name, fn in (("etl", etl), ("sql_models", models_sql), ("forecasting", forecasting),
                     ("inventory", inventory), ("late_marts", late_marts), ("reports", reports)):
        out.stage(name, fn)
    return {"root": out.root, "tables": out.tables, "timings": out.timings}
