"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The driver tables are pre-registered as views.  ``base`` holds the shared
CTEs (adapter, calendar, staging, daily table); each query is ``WITH <base>
<final select>``.  Unused CTEs are dropped by DuckDB's planner.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values, stated here once more so that a wrong value on either side shows
HOLIDAYS = [
    ("01-01", "NewYear", "National"), ("01-20", "MartinLutherKingDay", "National"), ("02-02", "SuperBowl", "Sporting"),
    ("02-14", "ValentinesDay", "Cultural"), ("03-17", "StPatricksDay", "Cultural"), ("04-05", "Easter", "Cultural"),
    ("05-25", "MemorialDay", "National"), ("07-04", "IndependenceDay", "National"), ("09-07", "LaborDay", "National"),
    ("10-31", "Halloween", "Cultural"), ("11-26", "Thanksgiving", "National"), ("12-25", "Christmas", "National"),
    ("12-31", "NewYearsEve", "Cultural"),
]
SNAP_DAYS = {"CA": [1, 2, 3, 5, 6, 7, 9, 10], "TX": [1, 3, 5, 6, 7, 9, 10, 11], "WI": [2, 3, 5, 8, 9, 11, 12]}
STORES = [
    ("CA_1", "Sacramento Supercenter", "Pacific"), ("CA_2", "San Francisco Metro", "Pacific"), ("TX_1", "Dallas Supercenter", "South Central"),
    ("TX_2", "Austin Central", "South Central"), ("WI_1", "Milwaukee North", "Midwest"), ("WI_2", "Madison West", "Midwest"),
]
TYPE_TO_DEPT = [("STANDARD", "FOODS_1"), ("SMALL", "FOODS_2"), ("LARGE", "HOUSEHOLD_1"), ("ECONOMY", "HOUSEHOLD_2"), ("MEDIUM", "HOBBIES_1"), ("PROMO", "HOBBIES_2")]
REGION_TO_STATE = [("AFRICA", "CA"), ("AMERICA", "TX"), ("ASIA", "WI"), ("EUROPE", "EU")]
OTHER_STATE = "ME"
BASELINE_LABEL, HOLDOUT_BASELINE_LABEL, SMOOTHING_LABEL = "LightGBM / Prophet", "Baseline (Recent Mean)", "Exponential Smoothing"
# ---------------------------------------------------------------------------


def _case(expr: str, pairs, default: str) -> str:
    whens = " ".join(f"WHEN {expr} = '{k}' THEN '{v}'" for k, v in pairs)
    return f"CASE {whens} ELSE {default} END"


def wm_yr_wk(d: str) -> str:
    return (f"CAST('1' || substr(CAST(isoyear({d}) AS VARCHAR), 3, 2) || "
            f"lpad(CAST(weekofyear({d}) AS VARCHAR), 2, '0') AS INTEGER)")


def avg_hu(expr: str, scale: int = 2, src_scale: int = 0) -> str:
    """Exact average rounded half-up, integer arithmetic (matches rounding.avg_half_up)."""
    shift = scale - src_scale
    num = f"SUM(CAST(({expr}) * {10 ** src_scale} AS BIGINT))" if src_scale else f"SUM(CAST({expr} AS BIGINT))"
    den = f"COUNT({expr})"
    return (f"CAST((({num}) * {2 * 10 ** shift} + {den}) // (2 * {den}) AS DOUBLE) / {float(10 ** scale)}")


def ratio_hu(num: str, den: str, scale: int = 2, src_scale: int = 0) -> str:
    shift = scale - src_scale
    return (f"CASE WHEN ({den}) > 0 THEN CAST((CAST({num} AS HUGEINT) * {2 * 10 ** shift} + ({den})) "
            f"// (2 * ({den})) AS DOUBLE) / {float(10 ** scale)} END")


def half_up(expr: str, scale: int = 2) -> str:
    f = float(10 ** scale)
    return f"(floor(({expr}) * {f} + 0.5) / {f})"


def holiday(d: str, idx: int) -> str:
    whens = " ".join(f"WHEN strftime({d}, '%m-%d') = '{h[0]}' THEN '{h[idx]}'" for h in HOLIDAYS)
    return f"CASE {whens} END"


def snap(d: str, state: str) -> str:
    days = ", ".join(str(x) for x in SNAP_DAYS[state])
    return f"CAST(CASE WHEN day({d}) IN ({days}) THEN 1 ELSE 0 END AS INTEGER)"


DEPT_CASE = _case("upper(split_part(trim(p_type), ' ', 1))", TYPE_TO_DEPT, "'GENERAL_1'")
STATE_CASE = _case("r_name", REGION_TO_STATE, f"'{OTHER_STATE}'")
STORE_VALUES = ", ".join(f"('{s}', '{n}', '{r}')" for s, n, r in STORES)

BASE_CTES = {
    "prod": f"""
        SELECT p_partkey, dept_id, regexp_extract(dept_id, '^(.*)_[^_]*$', 1) AS cat_id,
               dept_id || '_' || lpad(CAST(((p_size % 4) + 4) % 4 + 1 AS VARCHAR), 3, '0') AS item_id
        FROM (SELECT p_partkey, p_size, {DEPT_CASE} AS dept_id FROM part)""",
    "geo": f"""
        SELECT s_suppkey, state_id,
               state_id || '_' || CAST(((n_nationkey % 2) + 2) % 2 + 1 AS VARCHAR) AS store_id
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN (SELECT r_regionkey, {STATE_CASE} AS state_id FROM region) r ON n_regionkey = r.r_regionkey""",
    "lines": """
        SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity,
               l.l_extendedprice, l.l_returnflag, l.l_linestatus,
               p.item_id, p.dept_id, p.cat_id, g.store_id, g.state_id,
               CAST(l.l_shipdate AS DATE) AS date
        FROM lineitem l JOIN prod p ON l.l_partkey = p.p_partkey
        JOIN geo g ON l.l_suppkey = g.s_suppkey""",
    "fact_sales": """
        SELECT item_id || '_' || store_id AS id, item_id, dept_id, cat_id, store_id, state_id,
               strftime(date, '%Y-%m-%d') AS date_str, CAST(SUM(l_quantity) AS INTEGER) AS sales_units
        FROM lines GROUP BY item_id, dept_id, cat_id, store_id, state_id, date""",
    "fact_prices": f"""
        SELECT store_id, item_id, wm_yr_wk,
               floor(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / SUM(l_quantity)
                     * 100.0 + 0.5) / 100.0 AS sell_price
        FROM (SELECT *, {wm_yr_wk('date')} AS wm_yr_wk FROM lines WHERE l_linestatus = 'F')
        GROUP BY store_id, item_id, wm_yr_wk""",
    "bounds": """
        SELECT min(CAST(l_shipdate AS DATE)) AS start_date, max(CAST(l_shipdate AS DATE)) AS end_date
        FROM lineitem""",
    "cal_days": """
        SELECT CAST(start_date + CAST(i AS INTEGER) AS DATE) AS date, i
        FROM bounds, range(0, CAST(end_date - start_date AS BIGINT) + 1) t(i)""",
    "calendar": f"""
        SELECT strftime(date, '%Y-%m-%d') AS date_str, {wm_yr_wk('date')} AS wm_yr_wk,
               dayname(date) AS weekday, CAST(dayofweek(date) + 1 AS INTEGER) AS wday,
               CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year,
               'd_' || CAST(i + 1 AS VARCHAR) AS d,
               coalesce({holiday('date', 1)}, 'None') AS event_name_1,
               coalesce({holiday('date', 2)}, 'None') AS event_type_1,
               'None' AS event_name_2, 'None' AS event_type_2,
               {snap('date', 'CA')} AS snap_CA, {snap('date', 'TX')} AS snap_TX,
               {snap('date', 'WI')} AS snap_WI,
               CAST(CASE WHEN {holiday('date', 1)} IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS is_holiday
        FROM cal_days""",
    "clean_calendar": f"""
        SELECT CAST(date AS VARCHAR) AS date, {wm_yr_wk('date')} AS wm_yr_wk, dayname(date) AS weekday,
               CAST(dayofweek(date) + 1 AS INTEGER) AS wday, CAST(month(date) AS INTEGER) AS month,
               CAST(year(date) AS INTEGER) AS year,
               'd_' || CAST(CAST(date - (SELECT start_date FROM bounds) AS BIGINT) + 1 AS VARCHAR) AS d,
               coalesce({holiday('date', 1)}, 'None') AS event_name_1,
               coalesce({holiday('date', 2)}, 'None') AS event_type_1,
               'None' AS event_name_2, 'None' AS event_type_2,
               {snap('date', 'CA')} AS snap_CA, {snap('date', 'TX')} AS snap_TX, {snap('date', 'WI')} AS snap_WI,
               strftime(date, '%Y-%m-%d') AS date_str,
               CAST(CASE WHEN {holiday('date', 1)} IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS is_holiday
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)""",
    "dim_calendar": """
        SELECT date_str, wm_yr_wk, weekday, wday, month, year, d AS d_id, event_name_1, event_type_1,
               event_name_2, event_type_2, snap_CA, snap_TX, snap_WI, is_holiday FROM clean_calendar""",
    "stg_sales": """
        SELECT id, item_id, dept_id, cat_id, store_id, state_id, date_str,
               CAST(sales_units AS INTEGER) AS sales_units,
               CAST(CASE WHEN sales_units > 0 THEN 1 ELSE 0 END AS INTEGER) AS is_active_sale
        FROM fact_sales""",
    "stg_calendar": """
        SELECT date_str, CAST(wm_yr_wk AS INTEGER) AS wm_yr_wk, weekday, CAST(wday AS INTEGER) AS wday,
               CAST(month AS INTEGER) AS month, CAST(year AS INTEGER) AS year, d_id,
               COALESCE(event_name_1, 'None') AS event_name_1, COALESCE(event_type_1, 'None') AS event_type_1,
               COALESCE(event_name_2, 'None') AS event_name_2, COALESCE(event_type_2, 'None') AS event_type_2,
               CAST(COALESCE(snap_CA, 0) AS INTEGER) AS snap_CA, CAST(COALESCE(snap_TX, 0) AS INTEGER) AS snap_TX,
               CAST(COALESCE(snap_WI, 0) AS INTEGER) AS snap_WI,
               CAST(COALESCE(is_holiday, 0) AS INTEGER) AS is_holiday,
               CAST(CASE WHEN wday IN (1, 2) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend
        FROM dim_calendar""",
    "stg_prices": """
        SELECT store_id, item_id, CAST(wm_yr_wk AS INTEGER) AS wm_yr_wk,
               CAST(sell_price AS DECIMAL(10, 2)) AS sell_price FROM fact_prices""",
    "daily": """
        SELECT s.id, s.item_id, s.dept_id, s.cat_id, s.store_id, s.state_id, s.date_str,
               c.wm_yr_wk, c.weekday, c.wday, c.month, c.year, c.event_name_1, c.event_type_1,
               c.is_holiday, c.is_weekend,
               CAST(CASE WHEN s.state_id = 'CA' THEN c.snap_CA WHEN s.state_id = 'TX' THEN c.snap_TX
                         WHEN s.state_id = 'WI' THEN c.snap_WI ELSE 0 END AS INTEGER) AS is_snap_day,
               s.sales_units,
               CAST(COALESCE(p.sell_price, 5.00) AS DECIMAL(10, 2)) AS sell_price,
               ROUND(s.sales_units * CAST(COALESCE(p.sell_price, 5.00) AS DECIMAL(10, 2)), 2) AS daily_revenue
        FROM stg_sales s
        JOIN stg_calendar c ON s.date_str = c.date_str
        LEFT JOIN stg_prices p ON s.store_id = p.store_id AND s.item_id = p.item_id
                              AND c.wm_yr_wk = p.wm_yr_wk""",
    "dim_stores": f"""
        SELECT d.store_id, d.state_id, COALESCE(k.store_name, 'Store ' || d.store_id) AS store_name,
               COALESCE(k.region, 'General') AS region
        FROM (SELECT DISTINCT store_id, state_id FROM fact_sales) d
        LEFT JOIN (VALUES {STORE_VALUES}) k(store_id, store_name, region) ON d.store_id = k.store_id""",
}

_extra_ctes: dict[str, str] = {}


def register_cte(name: str, sql: str) -> None:
    _extra_ctes[name] = sql


def with_base(body: str) -> str:
    ctes = {**BASE_CTES, **_extra_ctes}
    parts = ",\n".join(f"{k} AS ({v})" for k, v in ctes.items())
    return f"WITH {parts}\n{body}"


# ---------------------------------------------------------------- raw feeds, cleaning
UNIT_PRICE = "floor(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) / l_quantity * 100.0 + 0.5) / 100.0"
INGEST = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"

register_cte("raw_prices", f"""
    SELECT store_id, item_id, {wm_yr_wk('date')} AS wm_yr_wk,
           CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_returnflag = 'R' THEN -({UNIT_PRICE})
                ELSE {UNIT_PRICE} END AS sell_price, {INGEST}
    FROM lines""")
register_cte("prices_first", f"""
    SELECT trim(store_id) AS store_id, trim(item_id) AS item_id, wm_yr_wk, sell_price
    FROM (SELECT *, row_number() OVER (PARTITION BY store_id, item_id, wm_yr_wk ORDER BY {INGEST}) AS rn
          FROM raw_prices) WHERE rn = 1""")
register_cte("clean_prices", """
    SELECT store_id, item_id, wm_yr_wk,
           CAST(ROUND(CAST(CASE WHEN sell_price IS NOT NULL AND sell_price > 0 THEN sell_price
                ELSE (SELECT quantile_cont(sell_price, 0.5) FROM prices_first WHERE sell_price > 0) END
                AS DECIMAL(20, 6)), 2) AS DOUBLE) AS sell_price
    FROM prices_first""")
register_cte("series", "SELECT DISTINCT item_id, dept_id, cat_id, store_id, state_id FROM lines")
register_cte("net_units", """
    SELECT item_id, store_id, date,
           SUM(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS units
    FROM lines GROUP BY item_id, store_id, date""")
register_cte("clean_sales", """
    SELECT s.item_id || '_' || s.store_id AS id, s.item_id, s.dept_id, s.cat_id, s.store_id, s.state_id,
           c.d, CAST(greatest(coalesce(CAST(n.units AS INTEGER), 0), 0) AS INTEGER) AS sales_units, c.date_str
    FROM series s CROSS JOIN clean_calendar c
    LEFT JOIN net_units n ON n.item_id = s.item_id AND n.store_id = s.store_id
                         AND n.date = CAST(c.date AS DATE)""")


def _v_missing(src: str, ds: str, cols: list[str], check: str = "Missing Key Records") -> str:
    nulls = [f"count(*) - count({c})" for c in cols]
    parts = " || ', ' || ".join(f"'''{c}'': ' || CAST({n} AS VARCHAR)" for c, n in zip(cols, nulls))
    total = " + ".join(f"({n})" for n in nulls)
    return (f"SELECT '{ds}' AS dataset, '{check}' AS \"check\", "
            f"CASE WHEN {total} = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, "
            f"count(*) AS total_records, CAST({total} AS BIGINT) AS failed_records, "
            f"'Null counts per column: {{' || {parts} || '}}' AS details FROM {src}")


def _v_dups(src: str, ds: str, cols: list[str], check: str = "Duplicate Key Records") -> str:
    keys = ", ".join(cols)
    lst = "[" + ", ".join(f"''{c}''" for c in cols) + "]"
    return (f"SELECT '{ds}' AS dataset, '{check}' AS \"check\", "
            f"CASE WHEN coalesce(sum(c - 1), 0) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, "
            f"CAST(coalesce(sum(c), 0) AS BIGINT) AS total_records, "
            f"CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS failed_records, "
            f"'Duplicates on {lst}: ' || CAST(CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS VARCHAR) AS details "
            f"FROM (SELECT count(*) AS c FROM {src} GROUP BY {keys})")


def fmt_1dp(x: str) -> str:
    q = f"CAST(floor(({x}) * 10.0 + 0.5) AS BIGINT)"
    return f"(CAST({q} // 10 AS VARCHAR) || '.' || CAST(({q} % 10 + 10) % 10 AS VARCHAR))"


def quality_sql(cal: str, prices: str, sales: str) -> str:
    """V6: the nine checks over the three cleaned datasets (as one UNION ALL)."""
    bound = (f"(SELECT q[2] + 4.0 * (q[2] - q[1]) FROM (SELECT quantile_cont(sales_units, [0.25, 0.75]) AS q "
             f"FROM {sales}))")
    checks = [
        _v_missing(cal, "calendar", ["date_str", "wm_yr_wk", "wday"]),
        _v_dups(cal, "calendar", ["date_str"]),
        (f"SELECT 'calendar' AS dataset, 'Date Continuity & Completeness' AS \"check\", "
         f"CASE WHEN m = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, days AS total_records, "
         f"CAST(greatest(m, 0) AS BIGINT) AS failed_records, "
         f"'Date span ' || strftime(lo, '%Y-%m-%d') || ' to ' || strftime(hi, '%Y-%m-%d') || "
         f"', missing days: ' || CAST(m AS VARCHAR) AS details FROM ("
         f"SELECT lo, hi, days, CAST(hi - lo AS BIGINT) + 1 - days AS m FROM ("
         f"SELECT min(CAST(date_str AS DATE)) AS lo, max(CAST(date_str AS DATE)) AS hi, "
         f"count(DISTINCT CAST(date_str AS DATE)) AS days FROM {cal}))"),
        _v_missing(prices, "sell_prices", ["store_id", "item_id", "wm_yr_wk", "sell_price"]),
        _v_dups(prices, "sell_prices", ["store_id", "item_id", "wm_yr_wk"]),
        (f"SELECT 'sell_prices' AS dataset, 'Pricing Integrity' AS \"check\", "
         f"CASE WHEN b = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, n AS total_records, b AS failed_records, "
         f"'Records with price <= 0 or > $1000: ' || CAST(b AS VARCHAR) AS details FROM ("
         f"SELECT count(*) AS n, CAST(count(*) FILTER (WHERE sell_price <= 0 OR sell_price > 1000.0 "
         f"OR sell_price IS NULL) AS BIGINT) AS b FROM {prices})"),
        _v_missing(sales, "sales", ["item_id", "store_id", "date_str", "sales_units"]),
        _v_dups(sales, "sales", ["item_id", "store_id", "date_str"]),
        (f"SELECT 'sales' AS dataset, 'Sales Outlier Detection' AS \"check\", 'INFO' AS status, "
         f"count(*) AS total_records, CAST(count(*) FILTER (WHERE sales_units > {bound}) AS BIGINT) AS failed_records, "
         f"'Sales units > ' || {fmt_1dp(bound)} || ' (' || "
         f"CAST(count(*) FILTER (WHERE sales_units > {bound}) AS VARCHAR) || "
         f"' high spikes flagged for awareness)' AS details FROM {sales}"),
    ]
    return " UNION ALL ".join(f"SELECT *, {i + 1} AS check_no FROM ({c})" for i, c in enumerate(checks))


def foreign_key_sql(fact: str, dim: str, key: str, fact_src: str = "", dim_src: str = "") -> str:
    return f"""
    SELECT '{fact}' AS dataset, 'Foreign Key Integrity' AS "check", CASE WHEN b = 0 THEN 'PASSED' ELSE 'FAILED' END AS status,
           n AS total_records, b AS failed_records, 'Rows without {dim} on [''{key}'']: ' || CAST(b AS VARCHAR) AS details
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM {dim_src or dim} d WHERE d.{key} = f.{key})) AS b
          FROM {fact_src or fact} f)"""


# The declared constraints (primary key, NOT NULL columns, foreign keys)
CONSTRAINTS = [
    ("dim_stores", "store_id", "store_id state_id", []),
    ("dim_categories", "cat_id", "cat_id", []),
    ("dim_departments", "dept_id", "dept_id cat_id", [("dim_categories", "cat_id")]),
    ("dim_products", "item_id", "item_id dept_id cat_id", [("dim_departments", "dept_id"), ("dim_categories", "cat_id")]),
    ("dim_calendar", "date_str", "date_str wm_yr_wk weekday wday month year d_id", []),
    ("fact_sales", "item_id store_id date_str", "item_id store_id date_str sales_units",
     [("dim_products", "item_id"), ("dim_stores", "store_id"), ("dim_calendar", "date_str")]),
    ("fact_prices", "store_id item_id wm_yr_wk", "store_id item_id wm_yr_wk sell_price", [("dim_products", "item_id"), ("dim_stores", "store_id")]),
    ("fact_forecast_results", "", "forecast_date item_id store_id model_used forecast_demand horizon_days", []),
    ("fact_inventory_recommendations", "", "evaluation_date item_id store_id current_inventory average_daily_demand demand_std_dev lead_time_days "
     "safety_stock reorder_point forecast_demand_lt recommended_order_qty days_of_supply inventory_status risk_level stockout_risk_pct overstock_risk_pct", []),
]


def constraints_sql(sources: dict[str, str], tables: list[str] | None = None) -> str:
    """V7 over the declared constraints; ``sources`` has the SQL of tables that aren't a CTE of their name."""
    src = lambda t: f"({sources[t]})" if t in sources else t
    parts = []
    for name, key, columns, foreign in CONSTRAINTS:
        if tables and name not in tables:
            continue
        if key:
            parts.append(_v_dups(src(name), name, key.split(), "Primary Key Uniqueness"))
        parts.append(_v_missing(src(name), name, columns.split(), "Not Null Columns"))
        parts += [foreign_key_sql(name, d, k, src(name), src(d)) for d, k in foreign]
    return " UNION ALL ".join(f"({x})" for x in parts)


# ---------------------------------------------------------------- features (F)
TWO_PI = "CAST(6.283185307179586 AS DOUBLE)"
W_SERIES = "PARTITION BY item_id, store_id ORDER BY date"


def _roll(fn: str, k: int) -> str:
    frame = f"OVER ({W_SERIES} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(sales_units) {frame} >= 3 THEN {fn}(sales_units) {frame} END"


register_cte("fbase", """
    SELECT s.id, s.item_id, s.dept_id, s.cat_id, s.store_id, s.state_id, s.date_str, s.sales_units,
           c.wm_yr_wk, c.weekday, c.wday, c.month, c.year, c.event_name_1, c.event_type_1, c.is_holiday,
           CAST(CASE WHEN s.state_id = 'CA' THEN c.snap_CA WHEN s.state_id = 'TX' THEN c.snap_TX
                     WHEN s.state_id = 'WI' THEN c.snap_WI ELSE 0 END AS INTEGER) AS snap_indicator,
           CAST(COALESCE(p.sell_price, 5.0) AS DOUBLE) AS sell_price, CAST(s.date_str AS DATE) AS date
    FROM fact_sales s JOIN dim_calendar c ON s.date_str = c.date_str
    LEFT JOIN fact_prices p ON s.store_id = p.store_id AND s.item_id = p.item_id AND c.wm_yr_wk = p.wm_yr_wk""")
register_cte("feat_w", f"""
    SELECT *, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
           CAST(quarter(date) AS INTEGER) AS quarter,
           CAST(CASE WHEN isodow(date) IN (6, 7) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
           CAST(dayofyear(date) AS INTEGER) AS day_of_year,
           sin({TWO_PI} * month / 12.0) AS sin_month, cos({TWO_PI} * month / 12.0) AS cos_month,
           {", ".join(f"lag(sales_units, {k}) OVER ({W_SERIES}) AS sales_lag_{k}" for k in (7, 14, 28, 60))},
           {", ".join(f"{_roll('avg', k)} AS sales_roll_mean_{k}" for k in (7, 14, 28))},
           {", ".join(f"{_roll('stddev_samp', k)} AS sales_roll_std_{k}" for k in (7, 28))},
           lag(sell_price, 7) OVER ({W_SERIES}) AS price_lag_7
    FROM fbase""")
register_cte("features", """
    SELECT f.* REPLACE (
               coalesce(sales_lag_7, 0) AS sales_lag_7, coalesce(sales_lag_14, 0) AS sales_lag_14,
               coalesce(sales_lag_28, 0) AS sales_lag_28, coalesce(sales_lag_60, 0) AS sales_lag_60,
               coalesce(sales_roll_mean_7, 0.0) AS sales_roll_mean_7,
               coalesce(sales_roll_mean_14, 0.0) AS sales_roll_mean_14,
               coalesce(sales_roll_mean_28, 0.0) AS sales_roll_mean_28,
               coalesce(sales_roll_std_7, 0.0) AS sales_roll_std_7,
               coalesce(sales_roll_std_28, 0.0) AS sales_roll_std_28,
               coalesce(price_lag_7, 0.0) AS price_lag_7),
           coalesce((sell_price - price_lag_7) / nullif(price_lag_7, 0.0), 0.0) AS price_change_pct,
           coalesce(sell_price / cp.cat_price, 1.0) AS price_rel_to_cat,
           sd.store_sales_momentum_7, cd.cat_sales_momentum_7
    FROM feat_w f
    LEFT JOIN (SELECT cat_id, date_str, SUM(CAST(round(sell_price * 100.0) AS BIGINT))
                      / COUNT(sell_price) / 100.0 AS cat_price FROM feat_w GROUP BY cat_id, date_str) cp
           ON f.cat_id = cp.cat_id AND f.date_str = cp.date_str
    LEFT JOIN (SELECT store_id, date_str, CAST(SUM(sales_units) AS BIGINT) AS store_sales_momentum_7
               FROM feat_w GROUP BY store_id, date_str) sd ON f.store_id = sd.store_id AND f.date_str = sd.date_str
    LEFT JOIN (SELECT cat_id, date_str, CAST(SUM(sales_units) AS BIGINT) AS cat_sales_momentum_7
               FROM feat_w GROUP BY cat_id, date_str) cd ON f.cat_id = cd.cat_id AND f.date_str = cd.date_str""")
register_cte("split", """
    SELECT min(date_str) AS split_date FROM (SELECT DISTINCT date_str FROM fact_sales
                                             ORDER BY date_str DESC LIMIT 30)""")


# ---------------------------------------------------------------- baseline forecasts
def _baseline_vals(d: str, label: str) -> str:
    mult = f"CASE WHEN isodow({d}) IN (6, 7) THEN CAST(1.3 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END"
    proj = f"greatest(0.0, {half_up(f'(s / n) * {mult}', 1)})"
    std = "CASE WHEN n > 1 THEN sqrt(CAST(n * ss - s * s AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) END"
    z = "CAST(1.96 AS DOUBLE)"
    return (f"{proj} AS forecast_demand, "
            f"CASE WHEN ({std}) IS NULL THEN 0.0 ELSE greatest(0.0, {half_up(f'{proj} - {z} * ({std})', 1)}) END "
            f"AS confidence_lower, {half_up(f'{proj} + {z} * ({std})', 1)} AS confidence_upper, "
            f"'{label}' AS model_used")


def _recent(src: str, n: int) -> str:
    return (f"SELECT item_id, store_id, count(*) AS n, SUM(CAST(sales_units AS BIGINT)) AS s, "
            f"SUM(CAST(sales_units AS BIGINT) * sales_units) AS ss, max(date_str) AS last_date "
            f"FROM (SELECT *, row_number() OVER (PARTITION BY item_id, store_id ORDER BY date_str DESC) AS rn "
            f"FROM {src}) WHERE rn <= {n} GROUP BY item_id, store_id")


register_cte("recent30", _recent("fact_sales", 30))
register_cte("baseline_forward", f"""
    SELECT strftime(d, '%Y-%m-%d') AS forecast_date, item_id, store_id, {_baseline_vals('d', BASELINE_LABEL)},
           CAST(NULL AS DOUBLE) AS actual_demand, CAST(NULL AS DOUBLE) AS forecast_error, horizon_days
    FROM (SELECT *, CAST(last_date AS DATE) + CAST(i AS INTEGER) AS d
          FROM recent30, (VALUES (7), (30), (90)) h(horizon_days), range(1, 91) t(i) WHERE i <= horizon_days)""")
register_cte("train_sales", "SELECT * FROM fact_sales WHERE date_str <= (SELECT split_date FROM split)")
register_cte("recent30_train", _recent("train_sales", 30))
register_cte("baseline_holdout", f"""
    SELECT t.date_str AS forecast_date, t.item_id, t.store_id,
           {_baseline_vals('CAST(t.date_str AS DATE)', HOLDOUT_BASELINE_LABEL)},
           CAST(t.sales_units AS DOUBLE) AS actual_demand,
           CAST(t.sales_units AS DOUBLE) - {half_up(
               "(s / n) * CASE WHEN isodow(CAST(t.date_str AS DATE)) IN (6, 7) THEN CAST(1.3 AS DOUBLE) "
               "ELSE CAST(0.95 AS DOUBLE) END", 1)} AS forecast_error,
           30 AS horizon_days
    FROM fact_sales t JOIN recent30_train r ON t.item_id = r.item_id AND t.store_id = r.store_id
    WHERE t.date_str > (SELECT split_date FROM split)""")
_SMOOTHED = half_up("greatest(0.0, level)", 1)
_SMOOTHED_STD = "CASE WHEN n > 1 THEN sqrt(CAST(n * ss - s * s AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) END"
register_cte("smoothed", f"""
    SELECT item_id, store_id, {_SMOOTHED} AS p, CAST(1.96 AS DOUBLE) * ({_SMOOTHED_STD}) AS half
    FROM (SELECT item_id, store_id, count(*) AS n, SUM(CAST(sales_units AS BIGINT)) AS s, SUM(CAST(sales_units AS BIGINT) * sales_units) AS ss,
                 list_reduce(list(CAST(sales_units AS DOUBLE) ORDER BY date_str),
                             lambda l, y: CAST(0.25 AS DOUBLE) * y + CAST(0.75 AS DOUBLE) * l) AS level
          FROM (SELECT *, row_number() OVER (PARTITION BY item_id, store_id ORDER BY date_str DESC) AS rn FROM train_sales)
          WHERE rn <= 90 GROUP BY item_id, store_id)""")
register_cte("smoothing_holdout", f"""
    SELECT t.date_str AS forecast_date, t.item_id, t.store_id, '{SMOOTHING_LABEL}' AS model_used, CAST(t.sales_units AS DOUBLE) AS actual_demand,
           p AS forecast_demand, CASE WHEN half IS NULL THEN 0.0 ELSE greatest(0.0, {half_up('p - half', 1)}) END AS confidence_lower,
           {half_up('p + half', 1)} AS confidence_upper, CAST(t.sales_units AS DOUBLE) - p AS forecast_error, 30 AS horizon_days
    FROM fact_sales t JOIN smoothed r ON t.item_id = r.item_id AND t.store_id = r.store_id
    WHERE t.date_str > (SELECT split_date FROM split)""")
register_cte("forecasts", """
    SELECT forecast_date, item_id, store_id, model_used, actual_demand, forecast_demand, confidence_lower,
           confidence_upper, forecast_error, horizon_days FROM baseline_holdout
    UNION ALL
    SELECT * FROM smoothing_holdout
    UNION ALL
    SELECT forecast_date, item_id, store_id, model_used, actual_demand, forecast_demand, confidence_lower,
           confidence_upper, forecast_error, horizon_days FROM baseline_forward""")


# ---------------------------------------------------------------- inventory (I)
_PRODUCTS_SQL = f"""
    SELECT s.item_id, s.dept_id, s.cat_id,
           split_part(s.item_id, '_', 1) || ' Product #' || split_part(s.item_id, '_', -1) AS product_name,
           coalesce({ratio_hu('p.c6', 'p.n10', 2, 2)}, 3.0) AS unit_cost
    FROM (SELECT DISTINCT item_id, dept_id, cat_id FROM fact_sales) s
    LEFT JOIN (SELECT item_id, SUM(CAST(round(sell_price * 100.0) AS BIGINT)) * 6 AS c6,
                      COUNT(sell_price) * 10 AS n10 FROM fact_prices GROUP BY item_id) p
      ON s.item_id = p.item_id"""
register_cte("dim_products", _PRODUCTS_SQL)
register_cte("recent90", """
    SELECT item_id, store_id, s / n AS avg_demand,
           sqrt(CAST(n * ss - s * s AS DOUBLE) / CAST(n * n AS DOUBLE)) AS std_demand,
           CAST(mx AS DOUBLE) AS max_demand
    FROM (SELECT item_id, store_id, count(*) AS n, SUM(CAST(sales_units AS BIGINT)) AS s,
                 SUM(CAST(sales_units AS BIGINT) * sales_units) AS ss, max(sales_units) AS mx
          FROM (SELECT *, row_number() OVER (PARTITION BY item_id, store_id ORDER BY date_str DESC) AS rn
                FROM fact_sales) WHERE rn <= 90 GROUP BY item_id, store_id)""")
register_cte("lt_forecast", """
    SELECT item_id, store_id, SUM(CAST(round(forecast_demand * 100.0) AS BIGINT)) / 100.0
           AS forecast_lead_time_demand
    FROM forecasts WHERE actual_demand IS NULL AND horizon_days = 7 GROUP BY item_id, store_id""")
register_cte("on_hand", """
    SELECT r.item_id, r.store_id,
           CAST(greatest(0, floor(r.avg_demand * 7 *
                [CAST(0.3 AS DOUBLE), CAST(0.7 AS DOUBLE), CAST(1.2 AS DOUBLE), CAST(1.8 AS DOUBLE),
                 CAST(3.5 AS DOUBLE)][CAST(t.tot % 5 AS INTEGER) + 1] + 0.5)) AS INTEGER) AS current_inventory
    FROM recent90 r JOIN (SELECT item_id, store_id, SUM(sales_units) AS tot FROM fact_sales
                          GROUP BY item_id, store_id) t ON r.item_id = t.item_id AND r.store_id = t.store_id""")
register_cte("rec_base", """
    SELECT r.item_id, r.store_id, coalesce(o.current_inventory, 0) AS current_inventory,
           r.avg_demand AS a, r.std_demand AS sd,
           coalesce(f.forecast_lead_time_demand, r.avg_demand * 7) AS fc,
           CAST(greatest(1, CAST(ceil(CAST(1.65 AS DOUBLE) * r.std_demand * sqrt(CAST(7 AS DOUBLE))) AS INTEGER))
                AS INTEGER) AS safety_stock,
           coalesce(CAST(p.unit_cost AS DOUBLE), 5.0) AS unit_cost
    FROM recent90 r LEFT JOIN lt_forecast f ON r.item_id = f.item_id AND r.store_id = f.store_id
    LEFT JOIN on_hand o ON r.item_id = o.item_id AND r.store_id = o.store_id
    LEFT JOIN dim_products p ON r.item_id = p.item_id""")
register_cte("rec_pol", f"""
    SELECT *, CAST(greatest(1, CAST(ceil(a * 7 + safety_stock) AS INTEGER)) AS INTEGER) AS reorder_point,
           CAST(greatest(0, CAST(ceil(fc + safety_stock - current_inventory) AS INTEGER)) AS INTEGER)
               AS recommended_order_qty,
           {half_up('a', 2)} AS average_daily_demand
    FROM rec_base""")
register_cte("recs", f"""
    SELECT (SELECT max(date_str) FROM fact_sales) AS evaluation_date, item_id, store_id, current_inventory,
           average_daily_demand, {half_up('sd', 2)} AS demand_std_dev, 7 AS lead_time_days, safety_stock,
           reorder_point, {half_up('fc', 2)} AS forecast_demand_lt, recommended_order_qty,
           {half_up('current_inventory / greatest(0.1, a)', 1)} AS days_of_supply, unit_cost,
           CAST(CAST(recommended_order_qty AS DECIMAL(10, 0)) * CAST(unit_cost AS DECIMAL(10, 2))
                AS DECIMAL(14, 2)) AS estimated_order_cost,
           CASE WHEN current_inventory < safety_stock THEN 'Critical Stockout Risk'
                WHEN current_inventory <= reorder_point THEN 'Reorder Needed'
                WHEN dos > 24.5 THEN 'Excess Overstock' ELSE 'Healthy Buffer' END AS inventory_status,
           CASE WHEN current_inventory < safety_stock THEN 'High Risk'
                WHEN current_inventory <= reorder_point THEN 'Medium Risk'
                WHEN dos > 24.5 THEN CASE WHEN dos > 24.5 * 1.5 THEN 'High Risk' ELSE 'Medium Risk' END
                ELSE 'Low Risk' END AS risk_level,
           {half_up('least(100.0, greatest(0.0, (daily * 7 + safety_stock - current_inventory) '
                    '/ greatest(1.0, daily * 7 + safety_stock) * 100.0))', 1)} AS stockout_risk_pct,
           {half_up('CASE WHEN dos > 24.5 THEN least(100.0, greatest(0.0, (dos - 24.5) / 24.5 * 100.0)) '
                    'ELSE 0.0 END', 1)} AS overstock_risk_pct,
           strftime(CAST((SELECT max(date_str) FROM fact_sales) AS DATE) + CAST(
               CASE WHEN current_inventory < safety_stock THEN 1
                    WHEN current_inventory <= reorder_point
                         THEN greatest(1, CAST(trunc((current_inventory - safety_stock) / daily) AS INTEGER))
                    WHEN dos > 24.5 THEN CAST(trunc(dos) AS INTEGER)
                    ELSE greatest(1, CAST(trunc((current_inventory - reorder_point) / daily) AS INTEGER)) END
               AS INTEGER), '%Y-%m-%d') AS suggested_replenishment_date
    FROM (SELECT *, greatest(0.1, average_daily_demand) AS daily,
                 current_inventory / greatest(0.1, average_daily_demand) AS dos FROM rec_pol)""")


# ---------------------------------------------------------------- marts used by analytics
register_cte("product_mart", f"""
    SELECT item_id, cat_id, dept_id, COUNT(DISTINCT store_id) AS stores_count,
           CAST(SUM(sales_units) AS BIGINT) AS total_units_sold, SUM(daily_revenue) AS total_revenue
    FROM daily GROUP BY item_id, cat_id, dept_id""")
register_cte("monthly", """
    SELECT store_id, cat_id, dept_id, year, month, CAST(SUM(sales_units) AS BIGINT) AS monthly_sales_units,
           SUM(daily_revenue) AS monthly_revenue FROM daily GROUP BY store_id, cat_id, dept_id, year, month""")
register_cte("store_mart", """
    SELECT d.store_id, s.store_name, s.region, CAST(SUM(d.sales_units) AS BIGINT) AS total_units_sold,
           CAST(SUM(d.daily_revenue) AS DOUBLE) AS total_gross_revenue
    FROM daily d LEFT JOIN dim_stores s ON d.store_id = s.store_id GROUP BY d.store_id, s.store_name, s.region""")
register_cte("dim_departments", "SELECT DISTINCT dept_id, cat_id FROM fact_sales")
E_CENTS = ("(CAST(round(actual_demand * 100.0) AS BIGINT) - CAST(round(forecast_demand * 100.0) AS BIGINT))")
A_CENTS = "CAST(round(actual_demand * 100.0) AS BIGINT)"


def error_stats_sql(mae_s: int, rmse_s: int, mape_s: int, count_name: str, mape_keep: str) -> str:
    return (f"count(*) AS {count_name}, {ratio_hu(f'SUM(abs({E_CENTS}))', 'count(*)', mae_s, 2)} AS mae, "
            f"{half_up(f'sqrt(CAST(SUM({E_CENTS} * {E_CENTS}) AS DOUBLE) / count(*)) / 100.0', rmse_s)} AS rmse, "
            f"{half_up(f'avg(CASE WHEN {mape_keep} THEN abs(actual_demand - forecast_demand) / actual_demand END) * 100.0', mape_s)} AS mape_pct, "
            f"CAST(SUM({E_CENTS} * {E_CENTS}) AS DOUBLE) AS see, CAST(SUM({A_CENTS}) AS DOUBLE) AS sa, "
            f"CAST(SUM({A_CENTS} * {A_CENTS}) AS DOUBLE) AS saa")
