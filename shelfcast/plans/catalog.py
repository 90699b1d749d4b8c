"""Registry of named queries: Spark implementation + DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)``, builds a ``Warehouse`` over the driver
tables and returns one DataFrame.  Money leaves as doubles
(``decimals_to_double``) so that both engines report the same types.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfcast.plans import oracle as O
from shelfcast.plans.warehouse import ModelRun, Warehouse, decimals_to_double

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Warehouse], DataFrame]) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return decimals_to_double(fn(Warehouse(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = O.with_base(sql)
        return run
    return deco


# ---------------------------------------------------------------- SQL models
@register("stg_sales", "SELECT * FROM stg_sales")
def _stg_sales(w: Warehouse) -> DataFrame:
    """T1"""
    return w.stg_sales


@register("stg_calendar", "SELECT * FROM stg_calendar")
def _stg_calendar(w: Warehouse) -> DataFrame:
    """T2 (over D5 of C6 of the feed)"""
    return w.stg_calendar


@register("stg_prices", "SELECT store_id, item_id, wm_yr_wk, CAST(sell_price AS DOUBLE) AS sell_price "
                        "FROM stg_prices")
def _stg_prices(w: Warehouse) -> DataFrame:
    """T3"""
    return w.stg_prices


@register("int_daily_sales", """
    SELECT * REPLACE (CAST(sell_price AS DOUBLE) AS sell_price,
                      CAST(daily_revenue AS DOUBLE) AS daily_revenue) FROM daily""")
def _int_daily_sales(w: Warehouse) -> DataFrame:
    """T4 / F1 join"""
    return w.daily


@register("int_weekly_sales", f"""
    SELECT store_id, item_id, dept_id, cat_id, wm_yr_wk, year,
           CAST(SUM(sales_units) AS BIGINT) AS weekly_sales_units,
           CAST(SUM(daily_revenue) AS DOUBLE) AS weekly_revenue,
           {O.avg_hu('sell_price', 2, 2)} AS avg_weekly_price,
           MAX(is_holiday) AS had_holiday, MAX(is_snap_day) AS had_snap_day
    FROM daily GROUP BY store_id, item_id, dept_id, cat_id, wm_yr_wk, year""")
def _int_weekly_sales(w: Warehouse) -> DataFrame:
    """T5"""
    return w.weekly


@register("int_monthly_sales", f"""
    SELECT store_id, cat_id, dept_id, year, month,
           CAST(SUM(sales_units) AS BIGINT) AS monthly_sales_units,
           CAST(SUM(daily_revenue) AS DOUBLE) AS monthly_revenue,
           COUNT(DISTINCT item_id) AS active_products_count,
           {O.avg_hu('daily_revenue', 2, 2)} AS avg_daily_revenue
    FROM daily GROUP BY store_id, cat_id, dept_id, year, month""")
def _int_monthly_sales(w: Warehouse) -> DataFrame:
    """T6"""
    return w.monthly


@register("mart_product_performance", f"""
    SELECT item_id, cat_id, dept_id, COUNT(DISTINCT store_id) AS stores_count,
           CAST(SUM(sales_units) AS BIGINT) AS total_units_sold,
           CAST(SUM(daily_revenue) AS DOUBLE) AS total_revenue,
           {O.avg_hu('sales_units', 2, 0)} AS avg_daily_units,
           {O.avg_hu('sell_price', 2, 2)} AS avg_selling_price,
           MAX(sales_units) AS max_single_day_units, MIN(sales_units) AS min_single_day_units
    FROM daily GROUP BY item_id, cat_id, dept_id""")
def _mart_product_performance(w: Warehouse) -> DataFrame:
    """T7 (flagship)"""
    return w.product_mart


@register("mart_store_performance", f"""
    SELECT d.store_id, s.state_id, s.store_name, s.region,
           COUNT(DISTINCT d.item_id) AS total_skus_stocked,
           CAST(SUM(d.sales_units) AS BIGINT) AS total_units_sold,
           CAST(SUM(d.daily_revenue) AS DOUBLE) AS total_gross_revenue,
           {O.avg_hu('d.daily_revenue', 2, 2)} AS avg_store_daily_revenue,
           CAST(SUM(CASE WHEN d.cat_id = 'FOODS' THEN d.daily_revenue ELSE 0 END) AS DOUBLE) AS foods_revenue,
           CAST(SUM(CASE WHEN d.cat_id = 'HOBBIES' THEN d.daily_revenue ELSE 0 END) AS DOUBLE) AS hobbies_revenue,
           CAST(SUM(CASE WHEN d.cat_id = 'HOUSEHOLD' THEN d.daily_revenue ELSE 0 END) AS DOUBLE) AS household_revenue
    FROM daily d LEFT JOIN dim_stores s ON d.store_id = s.store_id
    GROUP BY d.store_id, s.state_id, s.store_name, s.region""")
def _mart_store_performance(w: Warehouse) -> DataFrame:
    """T8"""
    return w.store_mart


# ---------------------------------------------------------------- cleaning (C)
@register("clean_calendar", "SELECT * FROM clean_calendar")
def _clean_calendar(w: Warehouse) -> DataFrame:
    """C1-C6 over the per-line calendar feed (dedup per date)"""
    return w.clean_calendar


@register("clean_prices", "SELECT * FROM clean_prices")
def _clean_prices(w: Warehouse) -> DataFrame:
    """C1, C7-C9 over the per-line price quotes"""
    return w.clean_prices


@register("clean_and_melt_sales", "SELECT * FROM clean_sales")
def _clean_sales(w: Warehouse) -> DataFrame:
    """Wide daily file -> long, units cleaned, days mapped to dates"""
    return w.clean_sales


# ---------------------------------------------------------------- quality (V)
@register("quality_checks", O.quality_sql("clean_calendar", "clean_prices", "clean_sales"))
def _quality_checks(w: Warehouse) -> DataFrame:
    """V1-V6 over the three cleaned datasets"""
    from shelfcast.operators import quality
    from shelfcast.session import materialize
    return quality.run_all_checks(materialize(w.clean_calendar), materialize(w.clean_prices),
                                  materialize(w.clean_sales))


@register("quality_summary", f"""
    SELECT count(*) AS total_checks, count(*) FILTER (WHERE status = 'PASSED') AS passed_checks,
           count(*) FILTER (WHERE status = 'FAILED') AS failed_checks,
           count(*) FILTER (WHERE status = 'INFO') AS info_checks
    FROM ({O.quality_sql('clean_calendar', 'fact_prices', 'fact_sales')})""")
def _quality_summary(w: Warehouse) -> DataFrame:
    """V6 summary over the warehouse facts (calendar, price list, daily sales)"""
    from shelfcast.operators import quality
    return quality.summarize_checks(quality.run_all_checks(w.calendar, w.fact_prices, w.fact_sales))


O.register_cte("dim_categories", "SELECT DISTINCT cat_id FROM fact_sales")


@register("foreign_key_checks", " UNION ALL ".join(O.foreign_key_sql(t, d, k) for t, _, _, keys in O.CONSTRAINTS for d, k in keys))
def _foreign_keys(w: Warehouse) -> DataFrame:
    """V7: the eight declared foreign keys, each table scanned once for all of its own"""
    from shelfcast.operators import quality
    return quality.foreign_key_suite({n: getattr(w, n) for n in quality.CONSTRAINTS if hasattr(type(w), n)})


@register("foreign_key_orphans", O.foreign_key_sql("fact_sales", "dim_calendar", "date_str", dim_src="(SELECT * FROM dim_calendar WHERE is_holiday = 0)"))
def _foreign_key_orphans(w: Warehouse) -> DataFrame:
    """V7 with orphans: sales against a calendar of working days, so that the holidays' rows fail"""
    from shelfcast.operators import quality
    tables = {"fact_sales": w.fact_sales, "dim_calendar": w.dim_calendar.filter("is_holiday = 0")}
    return quality.table_constraints("fact_sales", tables, [], [], [("date_str", "dim_calendar")])


def _warehouse_tables(w: Warehouse) -> dict[str, DataFrame]:
    dims = {n: getattr(w, n) for n in ("dim_stores", "dim_categories", "dim_departments", "dim_products", "dim_calendar", "fact_sales", "fact_prices")}
    return dims | {"fact_forecast_results": w.forecasts, "fact_inventory_recommendations": w.recommendations}


@register("constraint_checks", O.constraints_sql({"fact_forecast_results": "SELECT * FROM forecasts", "fact_inventory_recommendations": "SELECT * FROM recs"}))
def _constraint_checks(w: Warehouse) -> DataFrame:
    """V7: every declared primary key, NOT NULL column and foreign key of the warehouse"""
    from shelfcast.operators import quality
    return quality.constraint_suite(_warehouse_tables(w))


@register("constraint_failures", O.constraints_sql({
    "dim_stores": "SELECT * FROM dim_stores WHERE state_id <> 'TX'",
    "dim_departments": "SELECT dept_id, CASE WHEN dept_id = 'FOODS_2' THEN NULL ELSE cat_id END AS cat_id FROM dim_departments",
    "fact_sales": """SELECT * REPLACE (CASE WHEN sales_units > 45 THEN NULL ELSE sales_units END AS sales_units,
                                       CASE WHEN sales_units = 44 THEN NULL ELSE item_id END AS item_id) FROM fact_sales
                     UNION ALL SELECT * FROM fact_sales WHERE store_id = 'WI_2'""",
    "fact_prices": "SELECT * FROM fact_prices UNION ALL SELECT * REPLACE ('NOWHERE_1' AS store_id) FROM fact_prices WHERE sell_price > 5 AND store_id = 'CA_1'"},
    ["dim_stores", "dim_categories", "dim_departments", "dim_products", "dim_calendar", "fact_sales", "fact_prices"]))
def _constraint_failures(w: Warehouse) -> DataFrame:
    """V7 over the warehouse with planted failures of each kind"""
    from pyspark.sql import functions as F
    from shelfcast.operators import quality
    t = _warehouse_tables(w)
    sales, prices, units = t["fact_sales"], t["fact_prices"], F.col("sales_units")
    t["dim_stores"] = t["dim_stores"].filter("state_id <> 'TX'")
    t["dim_departments"] = t["dim_departments"].withColumn("cat_id", F.when(F.col("dept_id") != "FOODS_2", F.col("cat_id")))
    planted = sales.withColumn("item_id", F.when(units != 44, F.col("item_id"))).withColumn("sales_units", F.when(units <= 45, units))
    t["fact_sales"] = planted.unionByName(sales.filter("store_id = 'WI_2'"))
    t["fact_prices"] = prices.unionByName(prices.filter("sell_price > 5 and store_id = 'CA_1'").withColumn("store_id", F.lit("NOWHERE_1")))
    return quality.constraint_suite({n: d for n, d in t.items() if n not in ("fact_forecast_results", "fact_inventory_recommendations")})


# ---------------------------------------------------------------- dimensions (D)
@register("dim_stores", "SELECT * FROM dim_stores")
def _dim_stores(w: Warehouse) -> DataFrame:
    """D1"""
    return w.dim_stores


def _title_sql(c: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(replace({c}, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'), "
            "lambda x: upper(x[1]) || lower(x[2:])), '')")


@register("dim_categories", f"""
    SELECT cat_id, {_title_sql('cat_id')} AS category_name FROM (SELECT DISTINCT cat_id FROM fact_sales)""")
def _dim_categories(w: Warehouse) -> DataFrame:
    """D2"""
    return w.dim_categories


@register("dim_departments", f"""
    SELECT dept_id, cat_id, {_title_sql('dept_id')} AS department_name FROM (SELECT DISTINCT dept_id, cat_id FROM fact_sales)""")
def _dim_departments(w: Warehouse) -> DataFrame:
    """D3"""
    return w.dim_departments




@register("dim_products", "SELECT * FROM dim_products")
def _dim_products(w: Warehouse) -> DataFrame:
    """D4"""
    return w.dim_products


@register("dim_calendar", "SELECT * FROM dim_calendar")
def _dim_calendar(w: Warehouse) -> DataFrame:
    """D5 (calendar dimension from the cleaned feed)"""
    return w.dim_calendar


@register("fact_tables", """
    SELECT 'fact_sales' AS table_name, count(*) AS row_count, CAST(sum(sales_units) AS BIGINT) AS total_units,
           count(DISTINCT item_id || '|' || store_id) AS series_count FROM fact_sales
    UNION ALL
    SELECT 'fact_prices', count(*), 0, count(DISTINCT item_id || '|' || store_id) FROM fact_prices""")
def _fact_tables(w: Warehouse) -> DataFrame:
    """D6 fact projections, summarised per table"""
    from pyspark.sql import functions as F
    from shelfcast.operators import dims
    s = dims.fact_sales_table(w.fact_sales).agg(
        F.lit("fact_sales").alias("table_name"), F.count(F.lit(1)).alias("row_count"),
        F.sum("sales_units").alias("total_units"),
        F.count_distinct(F.concat_ws("|", "item_id", "store_id")).alias("series_count"))
    p = dims.fact_prices_table(w.fact_prices).agg(
        F.lit("fact_prices").alias("table_name"), F.count(F.lit(1)).alias("row_count"),
        F.lit(0).cast("long").alias("total_units"),
        F.count_distinct(F.concat_ws("|", "item_id", "store_id")).alias("series_count"))
    return s.unionByName(p)


@register("generate_calendar", "SELECT * REPLACE (CAST(d AS VARCHAR) AS d) FROM (SELECT date_str AS date, "
          "wm_yr_wk, weekday, wday, month, year, d, CASE WHEN event_name_1 = 'None' THEN NULL ELSE event_name_1 END "
          "AS event_name_1, CASE WHEN event_type_1 = 'None' THEN NULL ELSE event_type_1 END AS event_type_1, "
          "CAST(NULL AS VARCHAR) AS event_name_2, CAST(NULL AS VARCHAR) AS event_type_2, snap_CA, snap_TX, "
          "snap_WI, is_holiday FROM calendar)")
def _generate_calendar(w: Warehouse) -> DataFrame:
    """Calendar spine over the ship-date range"""
    return w.calendar_generated


@register("future_dates", """
    SELECT item_id, store_id, last_date, strftime(CAST(last_date AS DATE) + CAST(i AS INTEGER), '%Y-%m-%d')
           AS forecast_date
    FROM (SELECT item_id, store_id, max(date_str) AS last_date FROM fact_sales GROUP BY item_id, store_id),
         range(1, 31) t(i)""")
def _future_dates(w: Warehouse) -> DataFrame:
    """The next 30 dates after each series' last sale"""
    from pyspark.sql import functions as F
    from shelfcast.operators import dims
    last = w.fact_sales.groupBy("item_id", "store_id").agg(F.max("date_str").alias("last_date"))
    return dims.future_dates(last.withColumn("last_date", F.to_date("last_date")), 30)


# ---------------------------------------------------------------- features (F)
FEATURE_DOUBLES = ["sin_month", "cos_month", "sell_price", "sales_roll_mean_7", "sales_roll_mean_14",
                   "sales_roll_mean_28", "sales_roll_std_7", "sales_roll_std_28", "price_lag_7",
                   "price_change_pct", "price_rel_to_cat"]


def _round6_sql(cols, src: str, extra: str = "") -> str:
    rep = ", ".join(f"{O.half_up(c, 6)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}{extra}) FROM {src}"


@register("features", _round6_sql(FEATURE_DOUBLES, "features", ", CAST(date AS VARCHAR) AS date"))
def _features(w: Warehouse) -> DataFrame:
    """Base join, temporal, cyclical, lags, rolling mean/std, price change,
    relative price, group totals, null fill (doubles rounded to 6 dp for the oracle)"""
    from shelfcast.plans.warehouse import round_doubles
    return round_doubles(w.features, 6)


@register("holdout_split", """
    SELECT item_id, store_id, (SELECT split_date FROM split) AS split_date,
           count(*) FILTER (WHERE date_str <= (SELECT split_date FROM split)) AS train_rows,
           count(*) FILTER (WHERE date_str > (SELECT split_date FROM split)) AS test_rows
    FROM fact_sales GROUP BY item_id, store_id""")
def _holdout_split(w: Warehouse) -> DataFrame:
    """train/test split at the 30th latest distinct date, per series counts"""
    from pyspark.sql import functions as F
    from shelfcast.operators import features as fe
    s = fe.split_date(w.fact_sales, 30)
    return (w.fact_sales.groupBy("item_id", "store_id")
            .agg(F.count_if(F.col("date_str") <= s).alias("train_rows"),
                 F.count_if(F.col("date_str") > s).alias("test_rows"))
            .select("item_id", "store_id", s.alias("split_date"), "train_rows", "test_rows"))


def _design_sql() -> str:
    from shelfcast.operators.features import TWO_PI as TP, YEAR_DAYS
    cols = ["trend_linear", "trend_quad", "changepoint_0", "changepoint_1", "changepoint_2",
            "is_holiday", "snap_indicator", "sell_price"]
    four = []
    for k in range(1, 4):
        a = f"CAST({TP * k!r} AS DOUBLE) * dow / 7.0"
        four += [f"sin({a}) AS sin_week_{k}", f"cos({a}) AS cos_week_{k}"]
    for k in range(1, 6):
        a = f"CAST({TP * k!r} AS DOUBLE) * doy / {YEAR_DAYS}"
        four += [f"sin({a}) AS sin_year_{k}", f"cos({a}) AS cos_year_{k}"]
    cps = ", ".join(f"greatest(0.0, t - floor({float(i)} * (n - 1) / 4.0)) / {YEAR_DAYS} AS changepoint_{i - 1}"
                    for i in range(1, 4))
    inner = f"""
        SELECT item_id, store_id, date_str, sales_units,
               CAST(is_holiday AS DOUBLE) AS is_holiday, CAST(snap_indicator AS DOUBLE) AS snap_indicator,
               sell_price, t / {YEAR_DAYS} AS trend_linear, (t / {YEAR_DAYS}) * (t / {YEAR_DAYS}) AS trend_quad,
               {cps}, {", ".join(four)}
        FROM (SELECT *, CAST(date - min(date) OVER (PARTITION BY item_id, store_id) AS DOUBLE) AS t,
                     CAST(count(*) OVER (PARTITION BY item_id, store_id) AS DOUBLE) AS n,
                     CAST(isodow(date) - 1 AS DOUBLE) AS dow, CAST(dayofyear(date) AS DOUBLE) AS doy
              FROM fbase)"""
    names = cols + [f"{f}_week_{k}" for k in range(1, 4) for f in ("sin", "cos")] + \
        [f"{f}_year_{k}" for k in range(1, 6) for f in ("sin", "cos")]
    return _round6_sql(names, f"({inner})")


@register("additive_design", _design_sql())
def _additive_design(w: Warehouse) -> DataFrame:
    """Fourier, trend, changepoint and regressor columns of the additive model"""
    from shelfcast.operators import features as fe
    from shelfcast.plans.warehouse import round_doubles
    d = fe.add_additive_design(w.feature_base.select(
        "item_id", "store_id", "date_str", "sales_units", "is_holiday", "snap_indicator", "sell_price", "date"))
    return round_doubles(d.drop("date"), 6)


O.register_cte("last28", """
    SELECT item_id, store_id, avg(sales_units) AS a, stddev_samp(sales_units) AS sd,
           arg_max(sell_price, date) AS sell_price, arg_max(dept_id, date) AS dept_id,
           arg_max(cat_id, date) AS cat_id, arg_max(state_id, date) AS state_id
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id, store_id ORDER BY date DESC) AS rn FROM features)
    WHERE rn <= 28 GROUP BY item_id, store_id""")
O.register_cte("hz_calendar", f"""
    SELECT strftime(date, '%Y-%m-%d') AS date_str,
           CAST(CASE WHEN {O.holiday('date', 1)} IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS is_holiday,
           {O.snap('date', 'CA')} AS snap_CA, {O.snap('date', 'TX')} AS snap_TX, {O.snap('date', 'WI')} AS snap_WI
    FROM (SELECT CAST(start_date + CAST(i AS INTEGER) AS DATE) AS date
          FROM bounds, range(0, CAST(end_date - start_date AS BIGINT) + 91) t(i))""")


@register("forward_features", _round6_sql(
    ["sell_price", "sales_lag_7", "sales_lag_14", "sales_lag_28", "sales_roll_mean_7", "sales_roll_mean_14",
     "sales_roll_mean_28", "sales_roll_std_7", "sales_roll_std_28"], """(
    SELECT l.item_id, l.store_id, l.dept_id, l.cat_id, l.state_id, strftime(d, '%Y-%m-%d') AS date_str,
           strftime(d, '%Y-%m-%d') AS forecast_date, CAST(d AS VARCHAR) AS date,
           CAST(isodow(d) - 1 AS INTEGER) AS day_of_week, CAST(day(d) AS INTEGER) AS day_of_month,
           CAST(month(d) AS INTEGER) AS month, CAST(quarter(d) AS INTEGER) AS quarter,
           CAST(CASE WHEN isodow(d) IN (6, 7) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
           coalesce(c.is_holiday, 0) AS is_holiday,
           coalesce(CAST(CASE WHEN l.state_id = 'CA' THEN c.snap_CA WHEN l.state_id = 'TX' THEN c.snap_TX
                              WHEN l.state_id = 'WI' THEN c.snap_WI ELSE 0 END AS INTEGER), 0) AS snap_indicator,
           l.sell_price, 0.0 AS price_change_pct, 1.0 AS price_rel_to_cat,
           a AS sales_lag_7, a AS sales_lag_14, a AS sales_lag_28, a AS sales_roll_mean_7,
           a AS sales_roll_mean_14, a AS sales_roll_mean_28, sd AS sales_roll_std_7, sd AS sales_roll_std_28,
           horizon_days
    FROM last28 l
    JOIN (SELECT DISTINCT item_id, store_id FROM features WHERE date_str <= (SELECT split_date FROM split)) s
      ON l.item_id = s.item_id AND l.store_id = s.store_id,
         (VALUES (7), (30), (90)) h(horizon_days), range(1, 91) t(i),
         LATERAL (SELECT (SELECT max(date) FROM features) + CAST(i AS INTEGER) AS d)
    LEFT JOIN hz_calendar c ON c.date_str = strftime(d, '%Y-%m-%d')
    WHERE i <= horizon_days)"""))
def _forward_features(w: Warehouse) -> DataFrame:
    """forward feature rows (series x horizon x day) from each series' last 28 days"""
    from shelfcast.operators import features as fe
    from shelfcast.plans.warehouse import round_doubles
    train, _ = fe.time_split(w.features, 30)
    return round_doubles(fe.forward_rows(w.features, w.horizon_calendar, train), 6)


# ---------------------------------------------------------------- baseline forecasts (M10), T10
@register("baseline_forecast", "SELECT * FROM baseline_forward")
def _baseline_forecast(w: Warehouse) -> DataFrame:
    """Recent-mean forward forecast (7/30/90 days) for every series"""
    return w.baseline_forward


@register("baseline_holdout", "SELECT * FROM baseline_holdout")
def _baseline_holdout(w: Warehouse) -> DataFrame:
    """M10 on the 30-day holdout (actuals and errors filled)"""
    return w.baseline_holdout


@register("mart_forecast_accuracy", f"""
    SELECT model_used, horizon_days, count(*) AS total_forecast_points,
           {O.ratio_hu('SUM(abs(CAST(round(actual_demand * 100.0) AS BIGINT) - CAST(round(forecast_demand * 100.0) AS BIGINT)))', 'count(*)', 3, 2)} AS mae,
           {O.half_up('sqrt(CAST(SUM((CAST(round(actual_demand * 100.0) AS BIGINT) - CAST(round(forecast_demand * 100.0) AS BIGINT)) * (CAST(round(actual_demand * 100.0) AS BIGINT) - CAST(round(forecast_demand * 100.0) AS BIGINT))) AS DOUBLE) / count(*)) / 100.0', 3)} AS rmse,
           {O.half_up('avg(CASE WHEN actual_demand <> 0 THEN abs(actual_demand - forecast_demand) / actual_demand END) * 100.0', 2)} AS mape_pct
    FROM forecasts WHERE actual_demand IS NOT NULL GROUP BY model_used, horizon_days""")
def _mart_forecast_accuracy(w: Warehouse) -> DataFrame:
    """T10 over the forecast fact table"""
    return w.accuracy_mart


# ---------------------------------------------------------------- inventory (I), T9
@register("recent_demand_stats", f"""
    SELECT item_id, store_id, {O.half_up('avg_demand', 6)} AS avg_demand, {O.half_up('std_demand', 6)} AS std_demand,
           max_demand FROM recent90""")
def _recent_stats(w: Warehouse) -> DataFrame:
    """Mean, max, population std of the last 90 days per series"""
    from shelfcast.plans.warehouse import round_doubles
    return round_doubles(w.recent_stats, 6)


@register("lead_time_forecast", "SELECT * FROM lt_forecast")
def _lead_time_forecast(w: Warehouse) -> DataFrame:
    """7-day forward forecast total per series"""
    from shelfcast.operators import inventory
    return inventory.lead_time_forecast(w.forecasts, 7)


@register("on_hand_snapshot", "SELECT * FROM on_hand")
def _on_hand(w: Warehouse) -> DataFrame:
    """Adapter output: the on-hand stock per series that I3 takes as input"""
    return w.on_hand


@register("inventory_recommendations", "SELECT * FROM recs")
def _recommendations(w: Warehouse) -> DataFrame:
    """fact_inventory_recommendations"""
    return w.recommendations


@register("mart_inventory_health", """
    SELECT store_id, count(DISTINCT item_id) AS total_monitored_skus,
           CAST(SUM(current_inventory) AS BIGINT) AS total_inventory_units,
           CAST(SUM(current_inventory) AS BIGINT) * 5.0 AS estimated_inventory_value,
           count(*) FILTER (WHERE risk_level = 'High Risk') AS high_risk_sku_count,
           count(*) FILTER (WHERE risk_level = 'Medium Risk') AS medium_risk_sku_count,
           count(*) FILTER (WHERE risk_level = 'Low Risk') AS low_risk_sku_count,
           count(*) FILTER (WHERE inventory_status = 'Critical Stockout Risk') AS stockout_alert_count,
           count(*) FILTER (WHERE inventory_status = 'Excess Overstock') AS overstock_alert_count,
           CAST(SUM(recommended_order_qty) AS BIGINT) AS total_recommended_replenishment_units,
           CAST(SUM(estimated_order_cost) AS DOUBLE) AS total_replenishment_cost
    FROM recs GROUP BY store_id""")
def _mart_inventory_health(w: Warehouse) -> DataFrame:
    """T9"""
    return w.inventory_mart


# ---------------------------------------------------------------- evaluation (E)
@register("forecast_metrics", f"""
    SELECT model_used, n_points, mae, rmse, coalesce(mape_pct, 0.0) AS mape_pct,
           {O.half_up('''coalesce(CASE WHEN n_points > 1 THEN CASE WHEN (n_points * saa - sa * sa) = 0
                THEN CASE WHEN see * n_points = 0 THEN 1.0 ELSE 0.0 END
                ELSE 1.0 - (see * n_points) / (n_points * saa - sa * sa) END END, 0.0)''', 3)} AS r2
    FROM (SELECT model_used, {O.error_stats_sql(3, 3, 2, 'n_points', 'actual_demand > 0')}
          FROM forecasts WHERE actual_demand IS NOT NULL AND forecast_demand IS NOT NULL GROUP BY model_used)""")
def _forecast_metrics(w: Warehouse) -> DataFrame:
    """MAE, RMSE, MAPE, R2 per model"""
    from shelfcast.operators import evaluate
    return evaluate.calculate_metrics(w.forecasts)


_SCORECARD_SQL = f"""
    SELECT model_used, mae, rmse, coalesce(mape_pct, 0.0) AS mape_pct,
           {O.half_up('1.0 - (see * evaluated_points) / ((evaluated_points * saa - sa * sa) + 1e-8 * 10000.0 * evaluated_points)', 3)} AS r2,
           evaluated_points
    FROM (SELECT model_used, {O.error_stats_sql(2, 2, 1, 'evaluated_points', 'actual_demand > 0')}
          FROM forecasts WHERE actual_demand IS NOT NULL GROUP BY model_used)"""


@register("accuracy_scorecard", _SCORECARD_SQL)
def _accuracy_scorecard(w: Warehouse) -> DataFrame:
    """Dashboard scorecard per model"""
    from shelfcast.operators import evaluate
    return evaluate.scorecard(w.forecasts)


@register("champion_model", f"SELECT * FROM ({_SCORECARD_SQL}) ORDER BY rmse, model_used LIMIT 1")
def _champion_model(w: Warehouse) -> DataFrame:
    """Lowest-RMSE model of the scorecard"""
    from shelfcast.operators import evaluate
    return evaluate.champion(evaluate.scorecard(w.forecasts))


def _compared_sql(first: str, second: str, source: str) -> str:
    """E2 over two labels of ``source`` (SQL with model_used, rmse)."""
    return f"""
    SELECT CASE WHEN coalesce(a, 0.0) <= coalesce(b, 0.0) THEN '{first}' ELSE '{second}' END AS champion_model, a AS tree_rmse, b AS additive_rmse
    FROM (SELECT max(CASE WHEN model_used = '{first}' THEN rmse END) AS a, max(CASE WHEN model_used = '{second}' THEN rmse END) AS b FROM ({source}))"""


_RMSE_SQL = f"""SELECT model_used, {O.error_stats_sql(3, 3, 2, 'n_points', 'actual_demand > 0')} FROM {{0}}
    WHERE actual_demand IS NOT NULL AND forecast_demand IS NOT NULL GROUP BY model_used"""


@register("baseline_comparison", _compared_sql(O.HOLDOUT_BASELINE_LABEL, O.SMOOTHING_LABEL, _RMSE_SQL.format("forecasts")))
def _baseline_comparison(w: Warehouse) -> DataFrame:
    """E2 between the two forecasters that SQL can repeat"""
    from shelfcast.operators import evaluate, forecast
    return evaluate.compare_models(w.forecasts, forecast.HOLDOUT_BASELINE_LABEL, forecast.SMOOTHING_LABEL)


_TIED_SQL = f"""(SELECT * FROM smoothing_holdout UNION ALL SELECT * REPLACE ('Another ' || model_used AS model_used) FROM smoothing_holdout)"""


@register("tied_comparison", f"""
    SELECT c.*, s.model_used AS scorecard_champion FROM ({_compared_sql(O.SMOOTHING_LABEL, 'Another ' + O.SMOOTHING_LABEL, _RMSE_SQL.format(_TIED_SQL))}) c,
           (SELECT model_used FROM ({_SCORECARD_SQL.replace('FROM forecasts', 'FROM ' + _TIED_SQL)}) ORDER BY rmse, model_used LIMIT 1) s""")
def _tied_comparison(w: Warehouse) -> DataFrame:
    """E2 and E4 on a planted tie: the comparison keeps its first model, the scorecard the first by name"""
    from pyspark.sql import functions as F
    from shelfcast.operators import evaluate, forecast
    own = w.smoothing_holdout
    tied = own.unionByName(own.withColumn("model_used", F.concat(F.lit("Another "), "model_used")))
    best = evaluate.champion(evaluate.scorecard(tied)).select("model_used").scalar()
    return evaluate.compare_models(tied, forecast.SMOOTHING_LABEL, "Another " + forecast.SMOOTHING_LABEL).withColumn("scorecard_champion", best)


@register("residual_histogram", f"""
    SELECT model_used, bin, {O.half_up('lo + bin * (hi - lo) / 35.0', 6)} AS bin_start, count(*) AS points
    FROM (SELECT r.model_used, lo, hi,
                 CASE WHEN hi = lo THEN 0 ELSE CAST(least(34, floor((residual - lo) / ((hi - lo) / 35.0))) AS INTEGER)
                 END AS bin
          FROM (SELECT model_used, actual_demand - forecast_demand AS residual FROM forecasts
                WHERE actual_demand IS NOT NULL) r
          JOIN (SELECT model_used, min(actual_demand - forecast_demand) AS lo,
                       max(actual_demand - forecast_demand) AS hi
                FROM forecasts WHERE actual_demand IS NOT NULL GROUP BY model_used) m
            ON r.model_used = m.model_used)
    GROUP BY model_used, bin, lo, hi""")
def _residual_histogram(w: Warehouse) -> DataFrame:
    """E5: 35-bin residual histogram per model"""
    from shelfcast.operators import evaluate
    from shelfcast.plans.warehouse import round_doubles
    return round_doubles(evaluate.residual_histogram(w.forecasts), 6)


@register("actual_vs_forecast_sample", """
    SELECT * FROM forecasts WHERE actual_demand IS NOT NULL
    ORDER BY md5('42|' || model_used || '|' || item_id || '|' || store_id || '|' || forecast_date) LIMIT 500""")
def _sample(w: Warehouse) -> DataFrame:
    """Repeatable sample of at most 500 holdout rows"""
    from shelfcast.operators import evaluate
    return evaluate.actual_vs_forecast_sample(w.forecasts)


@register("trend_lines", f"""
    SELECT model_used, {O.half_up('regr_slope(forecast_demand, actual_demand)', 6)} AS slope,
           {O.half_up('regr_intercept(forecast_demand, actual_demand)', 6)} AS intercept,
           {O.half_up('regr_r2(forecast_demand, actual_demand)', 6)} AS r2, count(*) AS points
    FROM forecasts WHERE actual_demand IS NOT NULL GROUP BY model_used""")
def _trend_lines(w: Warehouse) -> DataFrame:
    """OLS trend of forecast on actual per model"""
    from shelfcast.operators import evaluate
    from shelfcast.plans.warehouse import round_doubles
    return round_doubles(evaluate.trend_lines(w.forecasts), 6)


# ---------------------------------------------------------------- analytics (Q)
def _an():
    from shelfcast.operators import analytics
    return analytics


@register("sales_totals", """
    SELECT CAST(SUM(sales_units) AS BIGINT) AS total_units_sold,
           CAST(SUM(sales_units) AS DOUBLE) * CAST(5.5 AS DOUBLE) AS total_revenue_approx FROM fact_sales""")
def _sales_totals(w: Warehouse) -> DataFrame:
    """Q1"""
    return _an().sales_totals(w.fact_sales)


@register("forward_total", """
    SELECT SUM(CAST(round(forecast_demand * 100.0) AS BIGINT)) / 100.0 AS total_forecast_demand
    FROM forecasts WHERE actual_demand IS NULL AND horizon_days = 30""")
def _forward_total(w: Warehouse) -> DataFrame:
    """Q2"""
    return _an().forward_total(w.forecasts, 30)


_KPI_SQL = """
    SELECT count(DISTINCT item_id) AS total_skus, CAST(SUM(current_inventory) AS BIGINT) AS total_inventory_units,
           count(*) FILTER (WHERE risk_level = 'High Risk') AS high_risk_count,
           count(*) FILTER (WHERE inventory_status = 'Critical Stockout Risk') AS stockout_count,
           count(*) FILTER (WHERE inventory_status = 'Excess Overstock') AS overstock_count,
           CAST(SUM(recommended_order_qty) AS BIGINT) AS total_order_qty,
           CAST(SUM(estimated_order_cost) AS DOUBLE) AS total_order_cost FROM recs"""


@register("inventory_kpis", _KPI_SQL)
def _inventory_kpis(w: Warehouse) -> DataFrame:
    """Q3"""
    return _an().inventory_kpis(w.recommendations)


@register("category_mix", f"""
    SELECT cat_id, CAST(SUM(total_revenue) AS DOUBLE) AS total_revenue, CAST(SUM(total_units_sold) AS BIGINT)
           AS total_units,
           {O.half_up('CAST(SUM(total_revenue) AS DOUBLE) / (SELECT CAST(SUM(total_revenue) AS DOUBLE) FROM product_mart) * 100.0', 2)}
           AS revenue_share_pct
    FROM product_mart GROUP BY cat_id""")
def _category_mix(w: Warehouse) -> DataFrame:
    """Q4"""
    return _an().category_mix(w.product_mart)


@register("monthly_trend", """
    SELECT year, month, CAST(SUM(monthly_sales_units) AS BIGINT) AS units, CAST(SUM(monthly_revenue) AS DOUBLE) AS revenue,
           CAST(year AS VARCHAR) || '-M' || lpad(CAST(month AS VARCHAR), 2, '0') AS period
    FROM monthly GROUP BY year, month""")
def _monthly_trend(w: Warehouse) -> DataFrame:
    """Q5"""
    return _an().monthly_trend(w.monthly)


@register("health_score", f"""
    SELECT total_skus, high_risk_count,
           {O.half_up('least(100.0, greatest(0.0, 100.0 - high_risk_count / greatest(1, total_skus) * 100.0))', 1)}
           AS health_score,
           {O.half_up('high_risk_count / greatest(1, total_skus) * 100.0', 1)} AS high_risk_catalog_pct
    FROM ({_KPI_SQL})""")
def _health_score(w: Warehouse) -> DataFrame:
    """Q6"""
    return _an().health_score(w.recommendations)


@register("store_scorecard", """
    SELECT store_id, store_name, region, total_units_sold, total_gross_revenue,
           '$' || format('{:,.2f}', total_gross_revenue) AS revenue_display,
           format('{:,}', total_units_sold) AS units_display FROM store_mart""")
def _store_scorecard(w: Warehouse) -> DataFrame:
    """Q7"""
    return _an().store_scorecard(w.store_mart)


@register("hierarchy_products", """
    SELECT item_id, dept_id, cat_id, product_name, unit_cost FROM dim_products
    WHERE dept_id = (SELECT min(dept_id) FROM dim_departments
                     WHERE cat_id = (SELECT min(cat_id) FROM dim_departments))
       OR (SELECT count(*) FROM dim_products WHERE dept_id = (SELECT min(dept_id) FROM dim_departments
           WHERE cat_id = (SELECT min(cat_id) FROM dim_departments))) = 0""")
def _hierarchy(w: Warehouse) -> DataFrame:
    """Q8: default drill-down (first category, its first department)"""
    return _an().hierarchy(w.dim_products, w.dim_departments)


@register("hierarchy_levels", """
    SELECT DISTINCT 'store' AS level, CAST(NULL AS VARCHAR) AS parent_id, store_id AS id FROM dim_stores
    UNION ALL SELECT DISTINCT 'category', NULL, cat_id FROM dim_departments
    UNION ALL SELECT DISTINCT 'department', cat_id, dept_id FROM dim_departments""")
def _hierarchy_levels(w: Warehouse) -> DataFrame:
    """Q8: stores, categories and departments by category"""
    return _an().hierarchy_levels(w.dim_stores, w.dim_departments)


@register("sku_history_recent", """
    SELECT item_id, store_id, date_str, sales_units FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id, store_id ORDER BY date_str DESC) AS rn FROM fact_sales)
    WHERE rn <= 90""")
def _sku_history(w: Warehouse) -> DataFrame:
    """Q9: last 90 days of every series"""
    return _an().sku_history(w.fact_sales, last_n=90)


_SKU_FC_SQL = """
    SELECT item_id, store_id, forecast_date, model_used, forecast_demand, confidence_lower, confidence_upper,
           horizon_days FROM (
        SELECT *, dense_rank() OVER (PARTITION BY item_id, store_id, model_used ORDER BY forecast_date) AS rn
        FROM forecasts WHERE actual_demand IS NULL AND horizon_days = 30) WHERE rn <= 30"""


@register("sku_forecast", _SKU_FC_SQL)
def _sku_forecast(w: Warehouse) -> DataFrame:
    """Q10: 30-day forward forecast of every series"""
    return _an().sku_forecast(w.forecasts, 30)


@register("sku_kpis", f"""
    SELECT h.item_id, h.store_id, {O.half_up('h.a', 2)} AS avg_hist_demand,
           {O.half_up('coalesce(f.tot, 0.0)', 2)} AS total_horizon_forecast,
           {O.half_up('coalesce(f.avg_fc, 0.0)', 2)} AS avg_forecast_daily,
           {O.half_up('(coalesce(f.avg_fc, 0.0) - h.a) / greatest(0.1, h.a) * 100.0', 1)} AS growth_pct,
           {O.half_up('coalesce(f.tot, 0.0) * coalesce(p.unit_cost, 5.0) * CAST(1.6 AS DOUBLE)', 2)} AS demand_value
    FROM (SELECT item_id, store_id, SUM(sales_units) / count(sales_units) AS a FROM (
              SELECT *, row_number() OVER (PARTITION BY item_id, store_id ORDER BY date_str DESC) AS rn
              FROM fact_sales) WHERE rn <= 30 GROUP BY item_id, store_id) h
    LEFT JOIN (SELECT item_id, store_id, SUM(CAST(round(forecast_demand * 100.0) AS BIGINT)) / 100.0 AS tot,
                      SUM(CAST(round(forecast_demand * 100.0) AS BIGINT)) / 100.0 / count(*) AS avg_fc
               FROM ({_SKU_FC_SQL}) GROUP BY item_id, store_id) f
      ON h.item_id = f.item_id AND h.store_id = f.store_id
    LEFT JOIN dim_products p ON h.item_id = p.item_id""")
def _sku_kpis(w: Warehouse) -> DataFrame:
    """Q11: per-series explorer KPIs"""
    return _an().sku_kpis(w.fact_sales, w.forecasts, w.dim_products, 30)


@register("forecast_schedule", f"""
    SELECT item_id, store_id, forecast_date, forecast_demand, confidence_lower, confidence_upper, model_used
    FROM ({_SKU_FC_SQL})""")
def _forecast_schedule(w: Warehouse) -> DataFrame:
    """Q12"""
    a = _an()
    return a.forecast_schedule(a.sku_forecast(w.forecasts, 30))


@register("filter_recommendations", """
    SELECT * REPLACE (CAST(estimated_order_cost AS DOUBLE) AS estimated_order_cost) FROM recs
    WHERE risk_level = 'High Risk'""")
def _filter_recs(w: Warehouse) -> DataFrame:
    """Q13: recommendations filtered to one risk level"""
    return _an().filter_recs(w.recommendations, risk="High Risk")


@register("filtered_kpis", f"""
    SELECT CAST(SUM(current_inventory) AS BIGINT) AS total_on_hand,
           CAST(SUM(recommended_order_qty) AS BIGINT) AS total_reorder_qty,
           CAST(SUM(estimated_order_cost) AS DOUBLE) AS total_po_cost,
           count(*) FILTER (WHERE risk_level = 'High Risk') AS high_risk_items,
           coalesce({O.ratio_hu('SUM(CAST(round(days_of_supply * 10.0) AS BIGINT))', 'count(days_of_supply)', 1, 1)}, 0.0)
           AS avg_days_of_supply, count(*) AS filtered_skus FROM recs""")
def _filtered_kpis(w: Warehouse) -> DataFrame:
    """Q14"""
    return _an().filtered_kpis(w.recommendations)


@register("risk_distribution", "SELECT risk_level, count(*) AS count FROM recs GROUP BY risk_level")
def _risk_distribution(w: Warehouse) -> DataFrame:
    """Q15"""
    return _an().risk_distribution(w.recommendations)


@register("top_reorders", """
    SELECT item_id, store_id, current_inventory, safety_stock, recommended_order_qty FROM recs
    ORDER BY recommended_order_qty DESC, item_id, store_id LIMIT 10""")
def _top_reorders(w: Warehouse) -> DataFrame:
    """Q16: top-10 order quantities"""
    return _an().top_reorders(w.recommendations)


@register("holdout_rows", """
    SELECT model_used, forecast_date, item_id, store_id, actual_demand, forecast_demand, forecast_error,
           horizon_days FROM forecasts WHERE actual_demand IS NOT NULL""")
def _holdout_rows(w: Warehouse) -> DataFrame:
    """Q17"""
    return _an().holdout_rows(w.forecasts)


def _scenario_sql(by: str = "") -> str:
    mult = ("greatest(0.1, 1.0 + CAST(-1.2 AS DOUBLE) * (price_change_pct / 100.0) + promo_uplift_pct / 100.0 "
            "+ holiday_surge_pct / 100.0)")
    sim_dem = f"(b.demand * {mult})"
    sim_rev = f"(b.revenue * {mult} * (1.0 + price_change_pct / 100.0))"
    sim_lt = "(7 + lead_time_delay_days)"
    sim_ss = f"CAST(floor(b.ss * sqrt({sim_lt} / 7.0) * sqrt({mult}) + 0.5) AS BIGINT)"
    sim_qty = f"CAST(floor(greatest(0.0, {sim_dem} * {sim_lt} + {sim_ss} - b.on_hand) + 0.5) AS BIGINT)"
    sim_risk = f"least(100.0, greatest(0.0, b.risk * {mult} * (1.0 + lead_time_delay_days / 10.0)))"
    H = O.half_up
    grid = ("SELECT CAST(p AS DOUBLE) AS price_change_pct, CAST(pr AS DOUBLE) AS promo_uplift_pct, "
            "CAST(h AS DOUBLE) AS holiday_surge_pct, CAST(d AS INTEGER) AS lead_time_delay_days "
            "FROM range(-30, 31, 5) a(p), range(0, 51, 5) b(pr), range(0, 101, 10) c(h), range(0, 22) e(d)")
    base = ("SELECT SUM(CAST(round(average_daily_demand * 100.0) AS BIGINT)) / 100.0 AS demand, "
            "CAST(SUM(safety_stock) AS BIGINT) AS ss, CAST(SUM(recommended_order_qty) AS BIGINT) AS qty, "
            "SUM(CAST(round(average_daily_demand * 100.0) AS BIGINT)) / 100.0 * CAST(5.5 AS DOUBLE) AS revenue, "
            "CAST(SUM(estimated_order_cost) AS DOUBLE) AS cost, CAST(SUM(current_inventory) AS BIGINT) AS on_hand, "
            "SUM(CAST(round(stockout_risk_pct * 10.0) AS BIGINT)) / count(*) / 10.0 AS risk FROM recs")
    if by:
        base = base.replace("SELECT ", f"SELECT {by}, ", 1) + f" GROUP BY {by}"
    return f"""
    SELECT {by + ", " if by else ""}CAST(price_change_pct AS VARCHAR) || '/' || CAST(promo_uplift_pct AS VARCHAR) || '/' ||
           CAST(holiday_surge_pct AS VARCHAR) || '/' || CAST(lead_time_delay_days AS VARCHAR) AS scenario_id,
           {H(mult, 4)} AS demand_multiplier, {H('b.demand', 2)} AS baseline_daily_demand,
           {H(sim_dem, 2)} AS sim_daily_demand, {H('b.revenue', 2)} AS baseline_daily_revenue,
           {H(sim_rev, 2)} AS sim_daily_revenue, b.ss AS baseline_safety_stock, {sim_ss} AS sim_safety_stock,
           b.qty AS baseline_reorder_qty, {sim_qty} AS sim_reorder_qty, {H('b.cost', 2)} AS baseline_order_cost,
           {sim_qty} * CAST(5.0 AS DOUBLE) AS sim_order_cost, {H('b.risk', 2)} AS baseline_stockout_risk,
           {H(sim_risk, 2)} AS sim_stockout_risk,
           {H(f'({sim_dem} - b.demand) / b.demand * 100.0', 1)} AS demand_delta_pct,
           {H(f'({sim_rev} - b.revenue) / b.revenue * 100.0', 1)} AS revenue_delta_pct,
           {H(f'({sim_ss} - b.ss) / b.ss * 100.0', 1)} AS safety_stock_delta_pct,
           {H(f'{sim_risk} - b.risk', 1)} AS risk_delta
    FROM ({grid}) s, ({base}) b"""


@register("scenario_impact", _scenario_sql())
def _scenario_impact(w: Warehouse) -> DataFrame:
    """Q18: the whole what-if grid against the network baseline"""
    return _an().scenario_impact(w.recommendations, w.scenarios)


@register("scenario_impact_by_store", _scenario_sql("store_id"))
def _scenario_impact_by_store(w: Warehouse) -> DataFrame:
    """Q18: the whole what-if grid against each store's baseline"""
    return _an().scenario_impact(w.recommendations, w.scenarios, by=["store_id"])


# ---------------------------------------------------------------- reports (R)
@register("kpi_summary", """
    SELECT * FROM (VALUES (1, 'Total Monitored SKUs'), (2, 'Total On-Hand Inventory Units'),
                          (3, 'Total Forecast Replenishment Units'), (4, 'Estimated Replenishment Cost'),
                          (5, 'Critical Stockout Alert Count'), (6, 'Excess Overstock Alert Count'),
                          (7, 'Stores Operating'), (8, 'Reporting Date')) m(metric_no, metric)
    JOIN (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS metric_no,
                 unnest([CAST(count(*) AS VARCHAR), format('{:,}', CAST(SUM(current_inventory) AS BIGINT)),
                         format('{:,}', CAST(SUM(recommended_order_qty) AS BIGINT)),
                         '$' || format('{:,.2f}', CAST(SUM(estimated_order_cost) AS DOUBLE)),
                         CAST(count(*) FILTER (WHERE inventory_status = 'Critical Stockout Risk') AS VARCHAR),
                         CAST(count(*) FILTER (WHERE inventory_status = 'Excess Overstock') AS VARCHAR),
                         CAST(count(DISTINCT store_id) AS VARCHAR), max(evaluation_date)]) AS value
          FROM recs) v USING (metric_no)""")
def _kpi_summary(w: Warehouse) -> DataFrame:
    """R1 (reporting date = evaluation date, for repeatability)"""
    from pyspark.sql import functions as F
    d = w.recommendations.agg(F.max("evaluation_date")).scalar()
    return _an().kpi_summary(w.recommendations, d)


@register("planning_sheet", """
    SELECT item_id, store_id, current_inventory, average_daily_demand, safety_stock, reorder_point,
           recommended_order_qty, days_of_supply, inventory_status, risk_level, stockout_risk_pct,
           suggested_replenishment_date, CAST(estimated_order_cost AS DOUBLE) AS estimated_order_cost FROM recs""")
def _planning_sheet(w: Warehouse) -> DataFrame:
    """R2"""
    return _an().planning_sheet(w.recommendations)


@register("forecast_sheet", """
    SELECT forecast_date, item_id, store_id, model_used, forecast_demand, confidence_lower, confidence_upper,
           horizon_days FROM forecasts WHERE actual_demand IS NULL""")
def _forecast_sheet(w: Warehouse) -> DataFrame:
    """The whole forecast sheet"""
    return _an().forecast_sheet(w.forecasts)


@register("briefing_totals", """
    SELECT count(*) AS total_skus, CAST(SUM(current_inventory) AS BIGINT) AS total_inventory,
           CAST(SUM(recommended_order_qty) AS BIGINT) AS total_reorder,
           CAST(SUM(estimated_order_cost) AS DOUBLE) AS total_cost,
           count(*) FILTER (WHERE risk_level = 'High Risk') AS high_risk_count,
           count(*) FILTER (WHERE inventory_status = 'Critical Stockout Risk') AS stockouts,
           floor(count(*) FILTER (WHERE risk_level = 'High Risk') / greatest(1, count(*)) * 100.0 * 10.0 + 0.5) / 10.0
           AS high_risk_share_pct FROM recs""")
def _briefing_totals(w: Warehouse) -> DataFrame:
    """R5"""
    return _an().briefing_totals(w.recommendations)


@register("priority_items", """
    SELECT item_id, store_id, current_inventory, safety_stock, reorder_point, recommended_order_qty,
           suggested_replenishment_date, stockout_risk_pct,
           CASE WHEN inventory_status = 'Critical Stockout Risk' THEN 'Stockout' ELSE 'Overstock' END AS alert_type
    FROM recs WHERE risk_level = 'High Risk' ORDER BY stockout_risk_pct DESC, item_id, store_id LIMIT 12""")
def _priority_items(w: Warehouse) -> DataFrame:
    """Top-12 high-risk series"""
    return _an().priority_items(w.recommendations)


# ---------------------------------------------------------------- models (M), E2, R4
@register("category_codes", """
    SELECT 'store_id' AS column_name, store_id AS label, CAST(dense_rank() OVER (ORDER BY store_id) - 1 AS DOUBLE) AS code
    FROM (SELECT DISTINCT store_id FROM fact_sales WHERE date_str <= (SELECT split_date FROM split))
    UNION ALL
    SELECT 'cat_id', cat_id, CAST(dense_rank() OVER (ORDER BY cat_id) - 1 AS DOUBLE)
    FROM (SELECT DISTINCT cat_id FROM fact_sales WHERE date_str <= (SELECT split_date FROM split))
    UNION ALL
    SELECT 'dept_id', dept_id, CAST(dense_rank() OVER (ORDER BY dept_id) - 1 AS DOUBLE)
    FROM (SELECT DISTINCT dept_id FROM fact_sales WHERE date_str <= (SELECT split_date FROM split))""")
def _category_codes(w: Warehouse) -> DataFrame:
    """M1: label codes (alphabetical, fitted on the training period) of store, category, department"""
    from functools import reduce
    from pyspark.sql import functions as F
    from shelfcast.operators import features as fe
    from shelfcast.operators import forecast
    train, _ = fe.time_split(w.fact_sales, 30)
    parts = [codes.select(F.lit(c).alias("column_name"), "label", F.col("code").cast("double").alias("code")) for c, codes in forecast.fit_codes(train).items()]
    return reduce(DataFrame.unionByName, parts)


@register("coded_holdout", """
    SELECT store_id, cat_id, dept_id, coalesce(s.code, 0.0) AS store_code, coalesce(c.code, 0.0) AS cat_code, coalesce(d.code, 0.0) AS dept_code, count(*) AS rows
    FROM (SELECT CASE WHEN store_id = 'WI_1' THEN 'NEW_1' WHEN store_id = 'WI_2' THEN NULL ELSE store_id END AS store_id, cat_id, dept_id FROM fact_sales
          WHERE date_str > (SELECT split_date FROM split)) t
    LEFT JOIN (SELECT store_id AS k, CAST(dense_rank() OVER (ORDER BY store_id) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT store_id FROM train_sales)) s ON s.k = store_id
    LEFT JOIN (SELECT cat_id AS k, CAST(dense_rank() OVER (ORDER BY cat_id) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT cat_id FROM train_sales)) c ON c.k = cat_id
    LEFT JOIN (SELECT dept_id AS k, CAST(dense_rank() OVER (ORDER BY dept_id) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT dept_id FROM train_sales)) d ON d.k = dept_id
    GROUP BY ALL""")
def _coded_holdout(w: Warehouse) -> DataFrame:
    """M1: the test period coded with the training period's codes; unseen and null labels get 0"""
    from pyspark.sql import functions as F
    from shelfcast.operators import features as fe
    from shelfcast.operators import forecast
    train, test = fe.time_split(w.fact_sales, 30)
    store = F.when(F.col("store_id") == "WI_1", F.lit("NEW_1")).when(F.col("store_id") != "WI_2", F.col("store_id"))
    columns = [c for c, _ in forecast.CATEGORICALS]
    coded = forecast.encode_categoricals(test.select(*columns).withColumn("store_id", store), forecast.fit_codes(train))
    return coded.groupBy(*columns, *[c for _, c in forecast.CATEGORICALS]).agg(F.count(F.lit(1)).alias("rows"))


_runs: dict[tuple[str, str], ModelRun] = {}


def _model_run(w: Warehouse) -> ModelRun:
    """One fitted run per application and directory, shared by the model queries; the last one is kept."""
    key = (w.spark.sparkContext.applicationId, w.sf_dir)
    if key not in _runs:
        _runs.clear()
        _runs[key] = ModelRun(w)
    return _runs[key]


@register("additive_coefficients")
def _additive_coefficients(w: Warehouse) -> DataFrame:
    """M5: per-series ridge fit (intercept, 24 coefficients, residual std, origin, size)"""
    return _model_run(w).coefficients


@register("additive_gradient", """
    SELECT item_id, store_id, count(*) AS n_train, CAST(0 AS DOUBLE) AS gradient FROM features WHERE date_str <= (SELECT split_date FROM split)
    GROUP BY item_id, store_id HAVING count(*) >= 14 AND (item_id, store_id) IN (SELECT (item_id, store_id) FROM features WHERE date_str > (SELECT split_date FROM split))""")
def _additive_gradient(w: Warehouse) -> DataFrame:
    """M5: the ridge objective's largest relative slope at each series' coefficients, from the rows themselves: 0 at 9 decimals"""
    from shelfcast.operators import forecast
    from shelfcast.plans.warehouse import round_doubles
    m = _model_run(w)
    return round_doubles(forecast.ridge_gradient(forecast.design_rows(m.train, m.test), m.coefficients), 9)


@register("additive_holdout")
def _additive_holdout(w: Warehouse) -> DataFrame:
    """M6: additive model scored on the holdout"""
    from shelfcast.operators import forecast
    m = _model_run(w)
    out = forecast._with_actuals(forecast.score_additive(m.test, m.coefficients), 30)
    return out.select(*forecast.FORECAST_COLUMNS)


@register("additive_forecast_horizon")
def _additive_horizon(w: Warehouse) -> DataFrame:
    """M7: 30-day additive forecast after each fitted series' history"""
    from shelfcast.operators import forecast
    m = _model_run(w)
    return forecast.additive_horizon(m.coefficients, m.train, w.horizon_calendar, 30)


@register("model_forecasts")
def _model_forecasts(w: Warehouse) -> DataFrame:
    """M2-M4, M6, M9: fact_forecast_results (tree + additive holdout, tree forward 7/30/90)"""
    return _model_run(w).fact_forecast_results


@register("feature_importances")
def _feature_importances(w: Warehouse) -> DataFrame:
    """M8: tree feature importances, descending"""
    return _model_run(w).tree.feature_importances(w.spark)


@register("model_comparison")
def _model_comparison(w: Warehouse) -> DataFrame:
    """Champion between the tree and the additive model on the holdout"""
    from shelfcast.operators import evaluate
    from shelfcast.session import materialize
    return evaluate.compare_models(materialize(_model_run(w).fact_forecast_results))


@register("store_sheet", f"""
    SELECT d.store_id, s.state_id, s.store_name, s.region,
           COUNT(DISTINCT d.item_id) AS total_skus_stocked,
           CAST(SUM(d.sales_units) AS BIGINT) AS total_units_sold,
           CAST(SUM(d.daily_revenue) AS DOUBLE) AS total_gross_revenue,
           {O.avg_hu('d.daily_revenue', 2, 2)} AS avg_store_daily_revenue,
           CAST(SUM(CASE WHEN d.cat_id = 'FOODS' THEN d.daily_revenue ELSE 0 END) AS DOUBLE) AS foods_revenue,
           CAST(SUM(CASE WHEN d.cat_id = 'HOBBIES' THEN d.daily_revenue ELSE 0 END) AS DOUBLE) AS hobbies_revenue,
           CAST(SUM(CASE WHEN d.cat_id = 'HOUSEHOLD' THEN d.daily_revenue ELSE 0 END) AS DOUBLE) AS household_revenue
    FROM daily d LEFT JOIN dim_stores s ON d.store_id = s.store_id
    GROUP BY d.store_id, s.state_id, s.store_name, s.region""")
def _store_sheet(w: Warehouse) -> DataFrame:
    """Store performance sheet (full mart)"""
    return _an().store_sheet(w.store_mart)


# ---------------------------------------------------------------- sources and sinks (S)
def _io():
    from shelfcast.sources import io
    return io


def _scratch(w: Warehouse, name: str) -> str:
    from shelfcast.session import shared_dir
    return shared_dir(w.spark, name)


@register("prices_csv_roundtrip", "SELECT * FROM clean_prices")
def _prices_csv(w: Warehouse) -> DataFrame:
    """S9 -> S2 -> C9: raw price quotes exported as CSV in arrival order, read back by S2, cleaned"""
    from shelfcast.operators import clean
    path = _scratch(w, "prices-csv")
    _io().export_csv_in_order(w.raw_prices, path, "ingest_ord")
    return clean.clean_prices(_io().read_prices_csv(w.spark, path))


@register("calendar_csv_roundtrip", """
    SELECT date_str AS date, wm_yr_wk, weekday, wday, month, year, d, event_name_1, event_type_1,
           event_name_2, event_type_2, snap_CA, snap_TX, snap_WI, date_str, is_holiday FROM clean_calendar""")
def _calendar_csv(w: Warehouse) -> DataFrame:
    """S9 -> S1 -> C6: the calendar feed exported as CSV in arrival order, read with the calendar schema, cleaned"""
    from pyspark.sql import functions as F
    from shelfcast.operators import clean
    from shelfcast.session import materialize
    path = _scratch(w, "calendar-csv")
    feed = w.raw_calendar.withColumn("is_holiday", F.lit(None).cast("int"))
    _io().export_csv_in_order(feed, path, "ingest_ord")
    return materialize(clean.clean_calendar(_io().read_calendar_csv(w.spark, path)), clean.KEEP_FIRST_BYTES)



@register("processed_sales_by_year", """
    SELECT CAST(substr(date_str, 1, 4) AS INTEGER) AS year, count(*) AS row_count,
           CAST(SUM(sales_units) AS BIGINT) AS units FROM clean_sales GROUP BY 1""")
def _processed_sales(w: Warehouse) -> DataFrame:
    """Cleaned datasets written as Parquet (sales partitioned by year) and read back"""
    from pyspark.sql import functions as F
    path = _scratch(w, "processed")
    paths = _io().write_processed(w.clean_calendar, w.clean_prices, w.clean_sales, path)
    sales = w.spark.read.parquet(paths["sales"])
    return sales.groupBy("year").agg(F.count(F.lit(1)).alias("row_count"), F.sum("sales_units").alias("units"))


@register("features_by_store", """
    SELECT store_id, count(*) AS row_count, CAST(SUM(sales_units) AS BIGINT) AS units FROM features
    GROUP BY store_id""")
def _features_by_store(w: Warehouse) -> DataFrame:
    """Feature dataset written partitioned by store and read back per store"""
    from pyspark.sql import functions as F
    path = _scratch(w, "features")
    _io().write_features(w.features, path)
    f = w.spark.read.parquet(path)
    return f.groupBy("store_id").agg(F.count(F.lit(1)).alias("row_count"), F.sum("sales_units").alias("units"))


@register("fact_layout_by_month", """
    SELECT substr(date_str, 1, 7) AS month, count(*) AS row_count, CAST(SUM(sales_units) AS BIGINT) AS units
    FROM fact_sales GROUP BY 1""")
def _fact_layout(w: Warehouse) -> DataFrame:
    """S14 (+S6): sales fact written partitioned by month, clustered by store/item, read back"""
    from pyspark.sql import functions as F
    path = _scratch(w, "fact-layout")
    _io().write_fact_layout(w.fact_sales, path, "date_str")
    f = w.spark.read.parquet(path)
    return f.groupBy("month").agg(F.count(F.lit(1)).alias("row_count"), F.sum("sales_units").alias("units"))


@register("parameterized_query", """
    SELECT store_id, count(*) AS series_days, CAST(SUM(sales_units) AS BIGINT) AS units FROM fact_sales
    GROUP BY store_id HAVING count(*) >= 1""")
def _parameterized_query(w: Warehouse) -> DataFrame:
    """Parameterised SQL over a registered view (named marker, no string formatting)"""
    w.fact_sales.createOrReplaceTempView("fact_sales_v")
    return _io().read_query(w.spark, "SELECT store_id, count(*) AS series_days, SUM(sales_units) AS units "
                                     "FROM fact_sales_v GROUP BY store_id HAVING count(*) >= :min_rows",
                            {"min_rows": 1})


@register("purchase_orders", """
    SELECT * REPLACE (CAST(estimated_order_cost AS DOUBLE) AS estimated_order_cost) FROM recs
    WHERE recommended_order_qty > 0""")
def _purchase_orders(w: Warehouse) -> DataFrame:
    """Purchase-order lines (recommendations with a positive order quantity)"""
    return _io().purchase_orders(w.recommendations)


@register("forecast_csv_roundtrip", f"""
    SELECT item_id, store_id, forecast_date, forecast_demand, confidence_lower, confidence_upper, model_used
    FROM ({_SKU_FC_SQL})""")
def _forecast_csv(w: Warehouse) -> DataFrame:
    """30-day forecast schedule exported as CSV and read back"""
    path = _scratch(w, "forecast-csv")
    sched = _an().forecast_schedule(_an().sku_forecast(w.forecasts, 30))
    _io().sku_forecast_export(sched, path)
    return w.spark.read.csv(path, header=True, schema=sched.schema)


@register("quality_log", f"""
    SELECT dataset AS dataset_name, "check" AS check_name, status, total_records AS records_evaluated, failed_records, details
    FROM ({O.quality_sql('clean_calendar', 'fact_prices', 'fact_sales')})""")
def _quality_log(w: Warehouse) -> DataFrame:
    """Checks appended to the audit log and read back, but for the run's time"""
    from shelfcast.operators import quality
    path = _scratch(w, "validation-log")
    _io().append_validation_log(quality.run_all_checks(w.calendar, w.fact_prices, w.fact_sales), path=path)
    return w.spark.read.parquet(path).drop("run_timestamp")


@register("table_append", """
    SELECT store_id, item_id, wm_yr_wk, sell_price FROM fact_prices
    UNION ALL SELECT store_id, item_id, wm_yr_wk, sell_price FROM fact_prices WHERE sell_price > 5""")
def _table_append(w: Warehouse) -> DataFrame:
    """A table replaced, then appended to, and read back"""
    path = _scratch(w, "table")
    prices = w.fact_prices.select("store_id", "item_id", "wm_yr_wk", "sell_price")
    _io().write_table(prices.limit(1), "prices", "overwrite", path)
    _io().write_table(prices, "prices", "overwrite", path)
    _io().write_table(prices.filter("sell_price > 5"), "prices", "append", path)
    return w.spark.read.parquet(path)


@register("quality_report")
def _quality_report(w: Warehouse) -> DataFrame:
    """S10 + S11: checks appended to the audit log and rendered as the one-row JSON report"""
    from shelfcast.operators import quality
    from shelfcast.session import materialize
    checks = materialize(quality.run_all_checks(w.calendar, w.fact_prices, w.fact_sales))
    _io().append_validation_log(checks, path=_scratch(w, "validation-log"))
    return _io().quality_report(checks)


@register("feature_base", """
    SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM fbase""")
def _feature_base(w: Warehouse) -> DataFrame:
    """base series query (sales x calendar x price list, SNAP by state, default price)"""
    return w.feature_base


@register("quality_report_rows", f"""
    SELECT CAST(check_no AS INTEGER) AS position, count(*) OVER () AS total_checks, count(*) FILTER (WHERE status = 'PASSED') OVER () AS passed_checks,
           count(*) FILTER (WHERE status = 'FAILED') OVER () AS failed_checks, count(*) FILTER (WHERE status = 'INFO') OVER () AS info_checks,
           dataset, "check", status, total_records, failed_records, details
    FROM ({O.quality_sql('clean_calendar', 'fact_prices', 'fact_sales')})""")
def _quality_report_rows(w: Warehouse) -> DataFrame:
    """The report written as JSON and read back, but for its time"""
    from shelfcast.operators import quality
    path = _scratch(w, "quality-report")
    _io().write_quality_report(quality.run_all_checks(w.calendar, w.fact_prices, w.fact_sales), path)
    return _io().read_quality_report(w.spark, path)


@register("typed_tables", """
    SELECT 'dim_calendar' AS table_name, count(*) AS row_count, 15 AS column_count, CAST(sum(wm_yr_wk) AS BIGINT) AS checksum FROM dim_calendar
    UNION ALL SELECT 'dim_stores', count(*), 4, CAST(sum(length(store_id)) AS BIGINT) FROM dim_stores
    UNION ALL SELECT 'dim_products', count(*), 5, CAST(sum(CAST(round(unit_cost * 100.0) AS BIGINT)) AS BIGINT) FROM dim_products
    UNION ALL SELECT 'fact_sales', count(*), 8, CAST(sum(sales_units) AS BIGINT) FROM fact_sales
    UNION ALL SELECT 'fact_prices', count(*), 4, CAST(sum(CAST(round(sell_price * 100.0) AS BIGINT)) AS BIGINT) FROM fact_prices
    UNION ALL SELECT 'fact_forecast_results', 0, 10, NULL""")
def _typed_tables(w: Warehouse) -> DataFrame:
    """The empty typed tables made in a database of their own, five of them loaded, all read back"""
    from functools import reduce
    from pyspark.sql import functions as F
    path = _scratch(w, "typed-tables")
    database = path.rsplit("/", 1)[-1].replace("-", "_")
    _io().init_schemas(w.spark, path, database)
    _io().init_schemas(w.spark, path, database)  # again: they exist
    cents = lambda c: F.sum(F.round(F.col(c) * 100.0).cast("long"))
    sums = {"dim_calendar": F.sum("wm_yr_wk"), "dim_stores": F.sum(F.length("store_id")), "dim_products": cents("unit_cost"),
            "fact_sales": F.sum("sales_units"), "fact_prices": cents("sell_price")}
    for name in sums:
        _io().load_table(getattr(w, name), f"{database}.{name}")
    sums["fact_forecast_results"] = F.sum("horizon_days")
    parts = []
    for name, total in sums.items():
        t = w.spark.table(f"{database}.{name}")
        parts.append(t.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.lit(len(t.columns)).alias("column_count"), total.cast("long").alias("checksum")))
    out = reduce(DataFrame.unionByName, parts).checkpoint()
    w.spark.sql(f"DROP DATABASE {database} CASCADE")  # the tables' files stay
    return out


@register("table_replace", """
    SELECT 'after a failed run' AS state, store_id, count(*) AS row_count, SUM(CAST(round(sell_price * 100.0) AS BIGINT))::BIGINT AS cents FROM fact_prices GROUP BY store_id
    UNION ALL
    SELECT 'after the next run', store_id, count(*), SUM(CAST(round(sell_price * 100.0) AS BIGINT))::BIGINT FROM fact_prices WHERE sell_price > 5 GROUP BY store_id""")
def _table_replace(w: Warehouse) -> DataFrame:
    """A replacement that fails halfway leaves the old rows; the next one shows the new"""
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F
    root = _scratch(w, "replaced")
    table = root.rsplit("/", 1)[-1].replace("-", "_")
    prices = w.fact_prices.select("store_id", "item_id", "wm_yr_wk", "sell_price")
    _io().replace_table(prices, table, root)
    broken = F.when(F.col("store_id") == "TX_1", F.raise_error(F.lit("lost halfway")).cast("double")).otherwise(F.col("sell_price"))
    try:
        _io().replace_table(prices.withColumn("sell_price", broken), table, root)
        raise AssertionError("the broken rows were written")
    except PySparkException:
        pass

    def state(name: str) -> DataFrame:
        return w.spark.table(table).groupBy(F.lit(name).alias("state"), "store_id").agg(
            F.count(F.lit(1)).alias("row_count"), F.sum(F.round(F.col("sell_price") * 100.0).cast("long")).alias("cents"))

    old = state("after a failed run")
    _io().replace_table(prices.filter("sell_price > 5"), table, root)
    out = old.unionByName(state("after the next run"))
    out.columns  # both are resolved to their folders before the table's name goes
    w.spark.sql(f"DROP TABLE {table}")
    return out
