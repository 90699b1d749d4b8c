"""Forecast evaluation (E1-E7) - grouped aggregates over the holdout rows.

Forecasts are stored rounded to cents and actuals are whole units, so errors
are aggregated exactly as integer cents; only square roots and final ratios
are doubles (computed the same way in every engine).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.rounding import half_up, ratio_half_up
from shelfcast.operators.forecast import ADDITIVE_LABEL, GBT_LABEL

HIST_BINS = 35


def _cents(col: str) -> Column:
    return F.round(F.col(col) * F.lit(100.0)).cast("long")


def _sum_exact(x: Column) -> Column:
    """Sum of integers that may pass the range of a long."""
    return F.sum(x.cast("decimal(28,0)"))


def _err_cents() -> Column:
    return _cents("actual_demand") - _cents("forecast_demand")


def error_stats(mape_mode: str = "positive", mae_scale: int = 3, rmse_scale: int = 3,
                mape_scale: int = 2, count_name: str = "total_forecast_points") -> list[Column]:
    """Aggregates: point count, MAE, RMSE, MAPE %.

    ``mape_mode='nullif'`` skips zero actuals (SQL NULLIF), ``'positive'``
    keeps only positive actuals.
    """
    e = _err_cents()
    a = F.col("actual_demand")
    keep = (a != 0) if mape_mode == "nullif" else (a > 0)
    ape = F.when(keep, F.abs(a - F.col("forecast_demand")) / a)
    n = F.count(F.lit(1))
    return [
        n.alias(count_name),
        ratio_half_up(F.sum(F.abs(e)), n, mae_scale, 2).alias("mae"),
        half_up(F.sqrt(_sum_exact(e * e).cast("double") / n) / F.lit(100.0), rmse_scale).alias("rmse"),
        half_up(F.avg(ape) * F.lit(100.0), mape_scale).alias("mape_pct"),
    ]


def _r2(n: Column, see: Column, sa: Column, saa: Column, eps: float = 0.0) -> Column:
    """1 - SSres/SStot from integer-cent sums; SStot = 0 -> 1 if perfect else 0 (eps = 0)."""
    ss_res = see.cast("double") * n.cast("double")
    ss_tot = n.cast("double") * saa.cast("double") - sa.cast("double") * sa.cast("double")
    if eps:
        return F.lit(1.0) - ss_res / (ss_tot + F.lit(eps * 1e4) * n.cast("double"))
    return (F.when(ss_tot == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - ss_res / ss_tot))


def calculate_metrics(forecasts: DataFrame, by: str = "model_used") -> DataFrame:
    """MAE, RMSE, MAPE (actual > 0, x100), R2 per model; null pairs dropped.

    R2 is 0 for a single point; rounding 3/3/2/3.
    """
    df = forecasts.filter(F.col("actual_demand").isNotNull() & F.col("forecast_demand").isNotNull())
    e, ac = _err_cents(), _cents("actual_demand")
    n = F.count(F.lit(1))
    stats = df.groupBy(by).agg(
        *error_stats("positive", 3, 3, 2, "n_points"),
        _sum_exact(e * e).alias("_see"), F.sum(ac).alias("_sa"), _sum_exact(ac * ac).alias("_saa"))
    r2 = F.when(F.col("n_points") > 1, _r2(F.col("n_points"), F.col("_see"), F.col("_sa"), F.col("_saa")))
    return stats.select(by, "n_points", "mae", "rmse", F.coalesce("mape_pct", F.lit(0.0)).alias("mape_pct"),
                        half_up(F.coalesce(r2, F.lit(0.0)), 3).alias("r2"))


def compare_models(forecasts: DataFrame, tree_label: str = GBT_LABEL,
                   additive_label: str = ADDITIVE_LABEL) -> DataFrame:
    """champion = tree model if its rounded RMSE <= the additive model's (tie -> tree)."""
    m = calculate_metrics(forecasts.filter(F.col("model_used").isin(tree_label, additive_label)))
    tree_rmse = F.max(F.when(F.col("model_used") == tree_label, F.col("rmse")))
    add_rmse = F.max(F.when(F.col("model_used") == additive_label, F.col("rmse")))
    return m.agg(tree_rmse.alias("tree_rmse"), add_rmse.alias("additive_rmse")).select(
        F.when(F.coalesce(F.col("tree_rmse"), F.lit(0.0)) <= F.coalesce(F.col("additive_rmse"), F.lit(0.0)),
               F.lit(tree_label)).otherwise(F.lit(additive_label)).alias("champion_model"),
        "tree_rmse", "additive_rmse")


def scorecard(forecasts: DataFrame) -> DataFrame:
    """Per model MAE/RMSE (2 dp), MAPE % (1 dp), R2 with +1e-8 (3 dp), point count."""
    df = forecasts.filter(F.col("actual_demand").isNotNull())
    e, ac = _err_cents(), _cents("actual_demand")
    stats = df.groupBy("model_used").agg(
        *error_stats("positive", 2, 2, 1, "evaluated_points"),
        _sum_exact(e * e).alias("_see"), F.sum(ac).alias("_sa"), _sum_exact(ac * ac).alias("_saa"))
    r2 = _r2(F.col("evaluated_points"), F.col("_see"), F.col("_sa"), F.col("_saa"), eps=1e-8)
    return stats.select("model_used", "mae", "rmse", F.coalesce("mape_pct", F.lit(0.0)).alias("mape_pct"),
                        half_up(r2, 3).alias("r2"), "evaluated_points")


def champion(scorecard_df: DataFrame) -> DataFrame:
    """The model with the lowest scorecard RMSE (ties: model name)."""
    return scorecard_df.orderBy(F.col("rmse").asc(), F.col("model_used").asc()).limit(1)


def residual_histogram(forecasts: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """E5: equal-width histogram of (actual - forecast) per model over [min, max]."""
    df = forecasts.filter(F.col("actual_demand").isNotNull()).select(
        "model_used", (F.col("actual_demand") - F.col("forecast_demand")).alias("residual"))
    rng = df.groupBy("model_used").agg(F.min("residual").alias("_lo"), F.max("residual").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("residual") - F.col("_lo")) / width).cast("int")))
    return (df.join(F.broadcast(rng), "model_used")
            .withColumn("bin", b)
            .groupBy("model_used", "bin")
            .agg(F.count(F.lit(1)).alias("points"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
            .select("model_used", "bin",
                    (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))
                    .alias("bin_start"), "points"))


def actual_vs_forecast_sample(forecasts: DataFrame, n: int = 500, seed: int = 42) -> DataFrame:
    """A repeatable sample of at most ``n`` holdout rows (hash order, not a random draw)."""
    df = forecasts.filter(F.col("actual_demand").isNotNull())
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "model_used", "item_id", "store_id", "forecast_date"))
    return df.orderBy(key).limit(n)


def trend_lines(forecasts: DataFrame) -> DataFrame:
    """OLS line of forecast on actual per model (slope, intercept, R2)."""
    df = forecasts.filter(F.col("actual_demand").isNotNull())
    y, x = F.col("forecast_demand"), F.col("actual_demand")
    return df.groupBy("model_used").agg(F.regr_slope(y, x).alias("slope"),
                                        F.regr_intercept(y, x).alias("intercept"),
                                        F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("points"))
