import numpy as np
import pandas as pd

from shelfcast.operators import features as fe


def _frame(spark):
    rng = np.random.default_rng(7)
    rows = []
    for item, n in (("A", 40), ("B", 12)):
        d0 = pd.Timestamp("2023-01-01")
        for i in range(n):
            rows.append((item, "CA_1", (d0 + pd.Timedelta(days=i)).date(), int(rng.poisson(8)),
                         float(round(rng.uniform(1, 3), 2)) if i % 5 else 0.0))
    pdf = pd.DataFrame(rows, columns=["item_id", "store_id", "date", "sales_units", "sell_price"])
    return pdf, spark.createDataFrame(pdf)


def test_lags_and_rolling_match_pandas(spark):
    pdf, df = _frame(spark)
    out = fe.add_price_change(fe.add_rolling_std(fe.add_rolling_mean(fe.add_lags(df)))).toPandas()
    out = out.sort_values(["item_id", "store_id", "date"]).reset_index(drop=True)
    ref = pdf.sort_values(["item_id", "store_id", "date"]).reset_index(drop=True)
    g = ref.groupby(["item_id", "store_id"])["sales_units"]
    for k in (7, 14, 28, 60):
        exp = g.shift(k)
        np.testing.assert_allclose(out[f"sales_lag_{k}"].astype(float), exp, equal_nan=True)
    for k in (7, 14, 28):
        exp = g.transform(lambda x: x.shift(1).rolling(window=k, min_periods=3).mean())
        np.testing.assert_allclose(out[f"sales_roll_mean_{k}"].astype(float), exp, equal_nan=True, rtol=1e-12)
    for k in (7, 28):
        exp = g.transform(lambda x: x.shift(1).rolling(window=k, min_periods=3).std())
        np.testing.assert_allclose(out[f"sales_roll_std_{k}"].astype(float), exp, equal_nan=True, rtol=1e-9)
    lag = ref.groupby(["item_id", "store_id"])["sell_price"].shift(7)
    exp = ((ref["sell_price"] - lag) / lag.replace(0, np.nan)).fillna(0.0)
    np.testing.assert_allclose(out["price_change_pct"], exp, rtol=1e-12)


def test_temporal_and_fourier(spark):
    pdf, df = _frame(spark)
    t = fe.add_temporal(df).toPandas()
    dates = pd.to_datetime(t["date"])
    assert (t["day_of_week"] == dates.dt.dayofweek).all()
    assert (t["is_weekend"] == dates.dt.dayofweek.isin([5, 6]).astype(int)).all()
    assert (t["day_of_year"] == dates.dt.dayofyear).all()
    four = df.select("date", *fe.fourier_columns()).toPandas()
    d = pd.to_datetime(four["date"])
    np.testing.assert_allclose(four["sin_week_2"], np.sin(2 * np.pi * 2 * d.dt.dayofweek / 7.0), atol=1e-12)
    np.testing.assert_allclose(four["cos_year_5"], np.cos(2 * np.pi * 5 * d.dt.dayofyear / 365.25), atol=1e-12)


def test_changepoints_follow_linspace(spark):
    pdf, df = _frame(spark)
    out = fe.add_additive_design(df).filter("item_id = 'A'").orderBy("date").toPandas()
    n = 40
    cps = np.linspace(0, n - 1, 5, dtype=int)[1:-1]
    t = np.arange(n)
    for i, cp in enumerate(cps):
        np.testing.assert_allclose(out[f"changepoint_{i}"], np.maximum(0, t - cp) / 365.25, atol=1e-12)
    np.testing.assert_allclose(out["trend_quad"], (t / 365.25) ** 2, atol=1e-12)


def test_time_split(spark):
    pdf, df = _frame(spark)
    df = df.withColumn("date_str", df["date"].cast("string"))
    train, test = fe.time_split(df, 5)
    dates = sorted(pdf["date"].astype(str).unique())
    split = dates[-5]
    assert train.agg({"date_str": "max"}).first()[0] == split
    assert test.select("date_str").distinct().count() == 4
