import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shelfcast.operators import evaluate
from shelfcast.operators import features as fe
from shelfcast.operators import forecast


def _series(spark, n=60, seed=42, noiseless=False):
    rng = np.random.default_rng(seed)
    d = pd.date_range("2023-01-01", periods=n, freq="D")
    if noiseless:
        units = 5.0 + 2.0 * np.sin(2 * np.pi * d.dayofweek / 7.0) + 3.0 * (np.arange(n) % 7 == 0)
    else:
        units = rng.poisson(10, n).astype(float)
    pdf = pd.DataFrame({"item_id": "FOODS_1_001", "store_id": "CA_1", "date": d.date,
                        "date_str": d.strftime("%Y-%m-%d"), "sales_units": units,
                        "is_holiday": (np.arange(n) % 7 == 0).astype(int), "snap_indicator": 0,
                        "sell_price": 3.5})
    return pdf, spark.createDataFrame(pdf)


def test_additive_fit_predict_reference_case(spark):
    _, df = _series(spark)
    coefs = forecast.fit_additive(df)
    pred = forecast.score_additive(df, coefs).toPandas()
    assert len(pred) == 60
    assert {"forecast_demand", "confidence_lower", "confidence_upper"} <= set(pred.columns)
    assert (pred["forecast_demand"] >= 0).all()
    assert (pred["confidence_lower"] <= pred["forecast_demand"]).all()
    assert (pred["forecast_demand"] <= pred["confidence_upper"]).all()
    again = forecast.score_additive(df, forecast.fit_additive(df)).toPandas()
    np.testing.assert_allclose(pred.sort_values("date_str")["forecast_demand"],
                               again.sort_values("date_str")["forecast_demand"])


def test_ridge_matches_closed_form(spark):
    pdf, df = _series(spark, noiseless=True)
    design = fe.add_additive_design(df).orderBy("date").toPandas()
    X = design[fe.ADDITIVE_FEATURES].to_numpy(float)
    y = design["sales_units"].to_numpy(float)
    Xc, yc = X - X.mean(0), y - y.mean()
    beta = np.linalg.solve(Xc.T @ Xc + np.eye(X.shape[1]), Xc.T @ yc)
    row = forecast.fit_additive(df).first()
    np.testing.assert_allclose(row.coef, beta, rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(row.intercept, y.mean() - X.mean(0) @ beta, rtol=1e-6)


def test_short_series_skipped(spark):
    _, df = _series(spark, n=10)
    assert forecast.fit_additive(df).count() == 0


def test_metrics_reference_case(spark):
    df = spark.createDataFrame([("m", 10.0, 12.0), ("m", 20.0, 18.0), ("m", 30.0, 33.0), ("m", 40.0, 38.0)],
                               "model_used string, actual_demand double, forecast_demand double")
    r = evaluate.calculate_metrics(df).first()
    assert r.mae == 2.25 and r.rmse == 2.291 and r.mape_pct == 11.25 and r.r2 == 0.958
    assert r.r2 > 0.9


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("one", 5.0, 4.0), ("flat", 3.0, 3.0), ("flat", 3.0, 3.0)],
                               "model_used string, actual_demand double, forecast_demand double")
    r = {x.model_used: x for x in evaluate.calculate_metrics(df).collect()}
    assert r["one"].r2 == 0.0                       # a single point scores 0
    assert r["flat"].r2 == 1.0 and r["flat"].mae == 0.0   # constant actuals, perfect fit


def test_baseline_weekend_lift(spark):
    pdf, df = _series(spark, n=40)
    fc = forecast.baseline_forecast(df, horizons=(7,)).toPandas()
    avg = pdf["sales_units"].iloc[-30:].mean()
    d = pd.to_datetime(fc["forecast_date"])
    exp = np.where(d.dt.dayofweek >= 5, np.floor(avg * 1.3 * 10 + 0.5) / 10, np.floor(avg * 0.95 * 10 + 0.5) / 10)
    np.testing.assert_allclose(fc["forecast_demand"], exp)
    assert fc["forecast_date"].min() == (pd.Timestamp(pdf["date_str"].max()) + pd.Timedelta(days=1)).strftime("%Y-%m-%d")


def test_gbt_beats_mean_and_intervals(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in ("CA_1", "TX_1"):
        for i in range(120):
            d = pd.Timestamp("2023-01-01") + pd.Timedelta(days=i)
            base = 20 if d.dayofweek >= 5 else 5
            rows.append(("FOODS_1_001", "FOODS_1", "FOODS", s, d.strftime("%Y-%m-%d"), float(base + rng.normal(0, 1)),
                         int(d.dayofweek), int(d.dayofweek >= 5)))
    df = spark.createDataFrame(rows, "item_id string, dept_id string, cat_id string, store_id string, "
                                     "date_str string, sales_units double, day_of_week int, is_weekend int")
    train, test = fe.time_split(df, 20)
    model = forecast.GlobalTreeModel(maxIter=20).fit(train)
    p = model.predict(test).toPandas()
    mse_model = ((p["sales_units"] - p["forecast_demand"]) ** 2).mean()
    mse_mean = ((p["sales_units"] - train.agg(F.avg("sales_units")).first()[0]) ** 2).mean()
    assert mse_model < mse_mean
    assert (p["confidence_lower"] <= p["forecast_demand"]).all() and (p["forecast_demand"] >= 0).all()
    imp = model.feature_importances(spark).collect()
    assert len(imp) == 21 and imp[0].importance >= imp[-1].importance


def test_training_tasks_follow_the_rows_not_the_shuffle_partitions(spark):
    rows = spark.range(4000).select(F.concat(F.lit("s"), F.col("id") % 7).alias("store_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("cat_id"),
                                    F.lit("d").alias("dept_id"), F.col("id").alias("sales_lag_7"), (F.col("id") % 11).alias("sales_units"))
    model = forecast.GlobalTreeModel()
    model.codes = forecast.fit_codes(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        cached, data = model._training_rows(rows, "sales_units")
        assert data.count() == 4000 and data.agg(F.sum("_label")).first()[0] == sum(i % 11 for i in range(4000))
        assert data.rdd.getNumPartitions() <= forecast.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
        cached.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert forecast.training_tasks(spark, 10**9) == 20_000
