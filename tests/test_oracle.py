"""Registered queries against their DuckDB oracle on the smallest driver tables."""
import os

import duckdb
import pytest

from conftest import SF_SMALL

FAST = ["stg_sales", "int_daily_sales", "int_weekly_sales", "mart_product_performance",
        "mart_store_performance", "clean_prices", "dim_products", "features", "baseline_forecast",
        "inventory_recommendations", "forecast_metrics", "scenario_impact", "kpi_summary", "quality_summary"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF_SMALL}/{f}'")
    return c


def _rows(pdf):
    import pandas as pd
    cols = sorted(pdf.columns)

    def norm(v):
        if v is None or (isinstance(v, float) and pd.isna(v)):
            return None
        return float(v) if isinstance(v, float) else (int(v) if hasattr(v, "__int__") and not isinstance(v, str)
                                                     else str(v))
    return sorted((tuple(norm(r[c]) for c in cols) for r in pdf[cols].to_dict("records")), key=repr), cols


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    s_rows, s_cols = _rows(E.queries()[name](spark, SF_SMALL).toPandas())
    o_rows, o_cols = _rows(con.sql(E.oracle_sql()[name]).df())
    assert s_cols == o_cols
    assert s_rows == o_rows


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 70


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "total_revenue" in df.columns
