import tempfile

from conftest import SF_SMALL
from shelfcast.plans.nightly import run_platform


def test_platform_run_without_models(spark):
    root = tempfile.mkdtemp(prefix="shelfcast-nightly-")
    res = run_platform(spark, SF_SMALL, out_dir=root, with_models=False)
    assert list(res["timings"]) == ["etl", "sql_models", "forecasting", "inventory", "late_marts", "reports"]
    recs = spark.read.parquet(res["tables"]["fact_inventory_recommendations"])
    sales = spark.read.parquet(res["tables"]["fact_sales"])
    assert recs.count() == sales.select("item_id", "store_id").distinct().count()
    checks = spark.read.parquet(res["tables"]["quality_checks"])
    assert checks.count() == 9
    assert spark.read.parquet(f"{root}/sys_validation_logs").count() == 9
    acc = spark.read.parquet(res["tables"]["mart_forecast_accuracy"]).collect()
    assert len(acc) == 2 and all(r.total_forecast_points > 0 for r in acc)  # both forecasters that need no training


def test_platform_run_with_models(spark):
    """Full model path (tree + additive) on the smallest tables; few trees to keep the test short."""
    root = tempfile.mkdtemp(prefix="shelfcast-nightly-m-")
    res = run_platform(spark, SF_SMALL, out_dir=root, gbt_params={"maxIter": 5})
    fc = spark.read.parquet(res["tables"]["fact_forecast_results"])
    models = {r.model_used for r in fc.select("model_used").distinct().collect()}
    assert models == {"GBT", "Prophet (Additive GAM)"}
    fwd = fc.filter("actual_demand IS NULL")
    assert fwd.select("horizon_days").distinct().count() == 3
    assert fc.filter("forecast_demand < 0 OR confidence_lower > forecast_demand").count() == 0
    assert spark.read.parquet(res["tables"]["feature_importances"]).count() == 21
    acc = {r.model_used for r in spark.read.parquet(res["tables"]["mart_forecast_accuracy"]).collect()}
    assert acc == {"GBT", "Prophet (Additive GAM)"}
