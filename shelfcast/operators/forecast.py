"""Forecasting (M1-M10): a global boosted-tree model, an additive model per series,
a recent-mean baseline, and the combined forecast fact table.

* Global model (M1-M4, M8): MLlib ``GBTRegressor`` - distributed training,
  scoring with ``transform`` (JVM side, no Python in the scoring path).
* Additive model (M5-M7): trend + Fourier + regressors, ridge (alpha = 1,
  free intercept) per item-store series.  The design matrix and the sums of
  its products (Gram sums) are native; one row a series with those sums
  reaches Python, where a batch of series is solved at once.
  Scoring joins the coefficients back and evaluates the dot product with
  native higher-order functions.
* Baseline (M10): recent-mean forecast with a weekend lift; pure SQL.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.inventory import z_for_confidence
from shelfcast.functions.rounding import half_up
from shelfcast.operators import features as fe
from shelfcast.operators.codes import ordinal_codes, with_code
from shelfcast.operators.inventory import samp_std_from_sums

SERIES = ["item_id", "store_id"]
GBT_LABEL = "GBT"
# Model labels written to model_used, as the platform's reports expect them
ADDITIVE_LABEL = "Prophet (Additive GAM)"
BASELINE_LABEL = "LightGBM / Prophet"
HOLDOUT_BASELINE_LABEL = "Baseline (Recent Mean)"
SMOOTHING_LABEL = "Exponential Smoothing"
FORECAST_COLUMNS = ["forecast_date", "item_id", "store_id", "model_used", "actual_demand",
                    "forecast_demand", "confidence_lower", "confidence_upper", "forecast_error",
                    "horizon_days"]
TREE_FEATURES = [
    "day_of_week", "day_of_month", "month", "quarter", "is_weekend",
    "is_holiday", "snap_indicator", "sell_price", "price_change_pct",
    "price_rel_to_cat", "sales_lag_7", "sales_lag_14", "sales_lag_28",
    "sales_roll_mean_7", "sales_roll_mean_14", "sales_roll_mean_28",
    "sales_roll_std_7", "sales_roll_std_28", "store_code", "cat_code", "dept_code",
]
CATEGORICALS = [("store_id", "store_code"), ("cat_id", "cat_code"), ("dept_id", "dept_code")]
# Fixed hyper-parameters of the global model (learning rate, leaves ~ depth 5,
# feature and row fraction, estimators, seed)
GBT_PARAMS = dict(stepSize=0.05, maxDepth=5, subsamplingRate=0.8, featureSubsetStrategy="0.8",
                  maxIter=150, seed=42)
# Execution settings (they do not change the fitted model).  Measured at sf0.1,
# 30 trees: default node handling 24 s; node-id cache 32-34 s; 1 GB level
# buffers 28 s - so the defaults stay.  Checkpointing every 10 trees applies
# when the node-id cache is switched on for deep trees.
GBT_EXECUTION = dict(cacheNodeIds=False, maxMemoryInMB=256, checkpointInterval=10)
# Rows of a training task, and tasks a core below which they are not merged: every tree
# runs two stages a level over all tasks, however few rows each of them has
TRAIN_ROWS, TASKS_PER_CORE = 50_000, 2
MIN_TRAIN_ROWS = 14
RIDGE_ALPHA = 1.0
# Exponential smoothing: weight of the newest day, and days that are folded
SMOOTHING_ALPHA, SMOOTHING_DAYS = 0.25, 90


def interval(pred: Column, resid_std: Column, confidence_level: float = 0.95) -> list[Column]:
    """M4/M6: clipped point forecast with a symmetric normal interval, rounded to cents."""
    z = F.lit(z_for_confidence(confidence_level))
    p = F.greatest(F.lit(0.0), pred)
    return [half_up(p, 2).alias("forecast_demand"),
            half_up(F.greatest(F.lit(0.0), p - z * resid_std), 2).alias("confidence_lower"),
            half_up(p + z * resid_std, 2).alias("confidence_upper")]


# --------------------------------------------------------------------------- global model
def fit_codes(train: DataFrame) -> dict[str, DataFrame]:
    """M1: the label codes of each categorical column that ``train`` has (a table a column)."""
    return {c: ordinal_codes(train, c) for c, _ in CATEGORICALS if c in train.columns}


def encode_categoricals(df: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    """M1: alphabetical label codes; unseen labels -> 0, absent column -> 0."""
    for c, code in CATEGORICALS:
        df = with_code(df, codes[c], c, code) if c in df.columns and c in codes else df.withColumn(code, F.lit(0.0))
    return df


def training_tasks(spark, rows: int) -> int:
    """Tasks that ``rows`` training rows are worth: by their number, not by the shuffle partitions of the joins before."""
    return max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-rows // TRAIN_ROWS))


class GlobalTreeModel:
    """M2-M4: one boosted-tree regressor over all series."""

    def __init__(self, **params):
        self.params = {**GBT_PARAMS, **GBT_EXECUTION, **params}
        self.codes: dict[str, DataFrame] = {}
        self.model = None
        self.residual_std: float = 1.0

    def _assemble(self, df: DataFrame) -> DataFrame:
        df = encode_categoricals(df, self.codes)
        for c in TREE_FEATURES:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(0.0))
        cols = [F.col(c).cast("double").alias(c) if c in TREE_FEATURES else F.col(c) for c in df.columns]
        return VectorAssembler(inputCols=TREE_FEATURES, outputCol="_features",
                               handleInvalid="keep").transform(df.select(*cols))

    def _training_rows(self, train: DataFrame, target_col: str) -> tuple[DataFrame, DataFrame]:
        """``(_features, _label)``, persisted, and the same merged without a shuffle where it is in more parts than its rows are worth.

        The label joins leave ``spark.sql.shuffle.partitions`` parts, however few the rows.
        """
        data = self._assemble(train).select("_features", F.col(target_col).cast("double").alias("_label")).persist()
        tasks = training_tasks(train.sparkSession, data.count())
        return data, data.coalesce(tasks) if data.rdd.getNumPartitions() > tasks else data

    def fit(self, train: DataFrame, target_col: str = "sales_units") -> "GlobalTreeModel":
        self.codes = fit_codes(train)
        from shelfcast.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(train.sparkSession)
        cached, data = self._training_rows(train, target_col)
        gbt = GBTRegressor(featuresCol="_features", labelCol="_label", predictionCol="_pred",
                           **self.params)
        self.model = gbt.fit(data)
        r = self.model.transform(data).agg(F.count(F.lit(1)).alias("n"),
                                           F.stddev_pop(F.col("_label") - F.col("_pred")).alias("s")).first()
        self.residual_std = float(r["s"]) if r["n"] and r["n"] > 1 and r["s"] is not None else 1.0
        cached.unpersist()
        return self

    def predict(self, df: DataFrame, confidence_level: float = 0.95) -> DataFrame:
        scored = self.model.transform(self._assemble(df))
        keep = [c for c in df.columns]
        return scored.select(*keep, *interval(F.col("_pred"), F.lit(self.residual_std), confidence_level),
                             F.lit(GBT_LABEL).alias("model_used"))

    def feature_importances(self, spark) -> DataFrame:
        """M8: (feature, importance) sorted by importance, descending."""
        imp = self.model.featureImportances.toArray().tolist()
        return (spark.createDataFrame(list(zip(TREE_FEATURES, [float(x) for x in imp])),
                                      "feature string, importance double")
                .orderBy(F.col("importance").desc(), "feature"))


# --------------------------------------------------------------------------- additive model
#: Columns of a Gram row: 1, the design, the target.
MOMENTS = ["_one", *fe.ADDITIVE_FEATURES, "_target"]
COEF_SCHEMA = ("item_id string, store_id string, intercept double, coef array<double>, "
               "residual_std double, n_train long, origin date")
#: What a Gram row must share to be added: the series, and the trend's origin and length.
GRAM_KEYS = [*SERIES, "origin", "n_train"]


def design_rows(train: DataFrame, test: DataFrame | None = None, target_col: str = "sales_units",
                min_rows: int = MIN_TRAIN_ROWS) -> DataFrame:
    """The additive design of the series that are fitted, with ``origin``, ``n_train`` and ``_target``.

    Series with fewer than ``min_rows`` training rows, or (when ``test`` is
    given) without test rows, are skipped.
    """
    w = Window.partitionBy(*SERIES)
    t = train.withColumn("n_train", F.count(F.lit(1)).over(w)).withColumn("origin", F.min("date").over(w)).filter(F.col("n_train") >= min_rows)
    if test is not None:
        t = t.join(test.select(*SERIES).distinct(), SERIES, "left_semi")
    design = fe.add_additive_design(t, origin=F.col("origin"), n_rows=F.col("n_train"))
    return design.select(*GRAM_KEYS, *[F.col(c).cast("double").alias(c) for c in fe.ADDITIVE_FEATURES],
                         F.lit(1.0).alias("_one"), F.col(target_col).cast("double").alias("_target"))


def _pairs() -> list[tuple[int, int]]:
    k = len(MOMENTS)
    return [(i, j) for i in range(k) for j in range(i, k)]


def gram_sums(design: DataFrame) -> DataFrame:
    """One row a series: ``GRAM_KEYS`` and ``gram``, the sums of all products of two of ``MOMENTS`` (upper triangle).

    Plain sums, combined before the shuffle; rows of two disjoint parts of the same training period add
    up to those of the whole (``add_grams``).
    """
    sums = [F.sum(F.col(MOMENTS[i]) * F.col(MOMENTS[j])).alias(f"_{i}_{j}") for i, j in _pairs()]
    return design.groupBy(*GRAM_KEYS).agg(*sums).select(*GRAM_KEYS, F.array(*[f"_{i}_{j}" for i, j in _pairs()]).alias("gram"))


def add_grams(a: DataFrame, b: DataFrame) -> DataFrame:
    """Gram rows of two parts of the same training period, added; a series may be in one of them only."""
    both = a.select(*GRAM_KEYS, F.col("gram").alias("_a")).join(b.select(*GRAM_KEYS, F.col("gram").alias("_b")), GRAM_KEYS, "full")
    total = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(F.zip_with("_a", "_b", lambda x, y: x + y))
    return both.select(*GRAM_KEYS, total.alias("gram"))


def _solve(batches):
    """Ridge with a free intercept of each Gram row: (Xc'Xc + aI) b = Xc'yc, all rows of a batch at once."""
    k = len(MOMENTS)
    at = np.array(_pairs())
    for pdf in batches:
        if not len(pdf):
            continue
        g = np.zeros((len(pdf), k, k))
        g[:, at[:, 0], at[:, 1]] = np.vstack(pdf["gram"].to_numpy())
        g[:, at[:, 1], at[:, 0]] = g[:, at[:, 0], at[:, 1]]
        n = g[:, 0, 0]
        mean = g[:, 0, 1:] / n[:, None]
        centred = g[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        xx, xy, yy = centred[:, :-1, :-1], centred[:, :-1, -1], centred[:, -1, -1]
        beta = np.linalg.solve(xx + RIDGE_ALPHA * np.eye(k - 2), xy[:, :, None])[:, :, 0]
        intercept = mean[:, -1] - (mean[:, :-1] * beta).sum(axis=1)
        square = yy - 2 * (beta * xy).sum(axis=1) + np.einsum("si,sij,sj->s", beta, xx, beta)
        std = np.where(n > 1, np.sqrt(np.maximum(square, 0.0) / n), 1.0)
        yield pd.DataFrame({"item_id": pdf["item_id"], "store_id": pdf["store_id"], "intercept": intercept, "coef": beta.tolist(),
                            "residual_std": std, "n_train": n.astype(int), "origin": pdf["origin"]})


def solve_additive(grams: DataFrame) -> DataFrame:
    """Per-series ridge coefficients (+ residual std, training origin and size) of Gram rows, one row a series to Python."""
    return grams.select(*SERIES, "origin", "gram").mapInPandas(_solve, COEF_SCHEMA)


def _design_vector() -> Column:
    return F.array(*[F.col(c).cast("double") for c in fe.ADDITIVE_FEATURES])


def fit_additive(train: DataFrame, test: DataFrame | None = None, target_col: str = "sales_units",
                 min_rows: int = MIN_TRAIN_ROWS) -> DataFrame:
    """M5: per-series ridge coefficients from Gram sums (see ``design_rows`` for the series that are skipped)."""
    return solve_additive(gram_sums(design_rows(train, test, target_col, min_rows)))


def ridge_gradient(design: DataFrame, coefs: DataFrame) -> DataFrame:
    """The largest slope of each series' ridge objective at its coefficients, relative to its terms: 0 at the optimum.

    From the design rows themselves, not from their Gram sums: ``(item_id, store_id, n_train, gradient)``.
    """
    rows = design.join(coefs.select(*SERIES, "intercept", "coef"), SERIES)
    x = _design_vector()
    fit = F.aggregate(F.zip_with("coef", x, lambda a, b: a * b), F.col("intercept"), lambda s, v: s + v)
    rows = rows.withColumn("_resid", F.col("_target") - fit)
    names = fe.ADDITIVE_FEATURES
    sums = rows.groupBy(*SERIES, "n_train", "coef").agg(
        F.sum("_resid").alias("_g"), F.sum(F.abs("_resid")).alias("_m"),
        *[F.sum(F.col("_resid") * F.col(c)).alias(f"_g{i}") for i, c in enumerate(names)],
        *[F.sum(F.abs(F.col("_resid") * F.col(c))).alias(f"_m{i}") for i, c in enumerate(names)])
    slopes = [F.abs(F.col("_g")) / F.greatest(F.col("_m"), F.lit(1.0))] + [
        F.abs(F.col(f"_g{i}") - RIDGE_ALPHA * F.col("coef")[i]) / F.greatest(F.col(f"_m{i}"), F.lit(1.0)) for i in range(len(names))]
    return sums.select(*SERIES, "n_train", F.greatest(*slopes).alias("gradient"))


def score_additive(df: DataFrame, coefs: DataFrame, confidence_level: float = 0.95) -> DataFrame:
    """M6: dot(coef, design) + intercept with the training origin; interval as M4."""
    cols = list(df.columns)
    joined = df.join(coefs, SERIES, "inner")
    design = fe.add_additive_design(joined, origin=F.col("origin"), n_rows=F.col("n_train"))
    dot = F.aggregate(F.zip_with("coef", _design_vector(), lambda a, b: a * b), F.lit(0.0),
                      lambda acc, v: acc + v) + F.col("intercept")
    keep = [c for c in cols if c in design.columns]
    return design.select(*keep, *interval(dot, F.col("residual_std"), confidence_level),
                         F.lit(ADDITIVE_LABEL).alias("model_used"))


def additive_horizon(coefs: DataFrame, history: DataFrame, calendar: DataFrame,
                     horizon_days: int = 30) -> DataFrame:
    """M7: forward forecast of every fitted series, ``horizon_days`` from its last history date.

    Regressors: holiday and SNAP (by the series' state) from ``calendar``
    (0 where absent), price = the last price of the history.
    """
    from shelfcast.operators.dims import future_dates
    from shelfcast.operators.marts import snap_for_state
    last = (history.groupBy(*SERIES)
            .agg(F.max("date").alias("last_date"), F.max_by("sell_price", "date").alias("sell_price"),
                 F.max_by("state_id", "date").alias("state_id")))
    rows = future_dates(last, horizon_days).withColumn("date", F.to_date("forecast_date"))
    c = calendar.select(F.col("date_str").alias("forecast_date"), F.col("is_holiday").alias("_hol"),
                        "snap_CA", "snap_TX", "snap_WI")
    rows = rows.join(F.broadcast(c), "forecast_date", "left").select(
        *SERIES, "forecast_date", "date", "sell_price",
        F.coalesce("_hol", F.lit(0)).alias("is_holiday"),
        F.coalesce(snap_for_state(), F.lit(0)).alias("snap_indicator"))
    return score_additive(rows, coefs).withColumn("horizon_days", F.lit(horizon_days))


# --------------------------------------------------------------------------- baseline
def _recent(sales: DataFrame, last_n: int, date_col: str = "date_str") -> DataFrame:
    w = Window.partitionBy(*SERIES).orderBy(F.col(date_col).desc())
    u = F.col("sales_units").cast("long")
    return (sales.select(*SERIES, date_col, "sales_units").withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= last_n).groupBy(*SERIES)
            .agg(F.count(u).alias("_n"), F.sum(u).alias("_s"), F.sum(u * u).alias("_ss"),
                 F.max(date_col).alias("last_date")))


def _baseline_values(d: Column, avg: Column, std: Column, label: str) -> list[Column]:
    mult = F.when(F.weekday(d).isin(5, 6), F.lit(1.3)).otherwise(F.lit(0.95))
    proj = F.greatest(F.lit(0.0), half_up(avg * mult, 1))
    return [proj.alias("forecast_demand"),
            F.greatest(F.lit(0.0), half_up(proj - F.lit(1.96) * std, 1)).alias("confidence_lower"),
            half_up(proj + F.lit(1.96) * std, 1).alias("confidence_upper"),
            F.lit(label).alias("model_used")]


def baseline_forecast(sales: DataFrame, horizons: Sequence[int] = (7, 30, 90), recent: int = 30,
                      label: str = BASELINE_LABEL) -> DataFrame:
    """Mean of each series' last ``recent`` days x 1.3 (Sat/Sun) or 0.95, +-1.96 std.

    Forward rows start the day after each series' own last date.
    """
    st = _recent(sales, recent)
    n, s, ss = F.col("_n"), F.col("_s"), F.col("_ss")
    hz = F.explode(F.array(*[F.lit(h) for h in horizons]))
    rows = st.select("*", hz.alias("horizon_days")).withColumn(
        "_d", F.explode(F.sequence(F.date_add(F.to_date("last_date"), 1),
                                   F.date_add(F.to_date("last_date"), F.col("horizon_days")))))
    return rows.select(
        F.date_format("_d", "yyyy-MM-dd").alias("forecast_date"), *SERIES,
        *_baseline_values(F.col("_d"), s / n, samp_std_from_sums(n, s, ss), label),
        F.lit(None).cast("double").alias("actual_demand"),
        F.lit(None).cast("double").alias("forecast_error"), "horizon_days",
    ).select(*FORECAST_COLUMNS)


def baseline_holdout(sales: DataFrame, test_days: int = 30, recent: int = 30,
                     label: str = HOLDOUT_BASELINE_LABEL) -> DataFrame:
    """M10 on the holdout: train on dates <= split, forecast each test day of the series."""
    train, test = fe.time_split(sales, test_days)
    st = _recent(train, recent)
    n, s, ss = F.col("_n"), F.col("_s"), F.col("_ss")
    rows = test.select(*SERIES, "date_str", "sales_units").join(st, SERIES, "inner")
    d = F.to_date("date_str")
    vals = _baseline_values(d, s / n, samp_std_from_sums(n, s, ss), label)
    out = rows.select(F.col("date_str").alias("forecast_date"), *SERIES, *vals,
                      F.col("sales_units").cast("double").alias("actual_demand"))
    return (out.withColumn("forecast_error", F.col("actual_demand") - F.col("forecast_demand"))
            .withColumn("horizon_days", F.lit(test_days)).select(*FORECAST_COLUMNS))


def smoothed_level(values: Column, alpha: float = SMOOTHING_ALPHA) -> Column:
    """Simple exponential smoothing as an ordered fold: the level starts at the first value, then alpha * y + (1 - alpha) * level."""
    first, rest = values[0].cast("double"), F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, first, lambda level, y: F.lit(alpha) * y.cast("double") + F.lit(1 - alpha) * level)


def smoothing_holdout(sales: DataFrame, test_days: int = 30, recent: int = SMOOTHING_DAYS, label: str = SMOOTHING_LABEL) -> DataFrame:
    """M10 beside the recent mean: each series' smoothed level over its last ``recent`` training days, on each test day.

    The interval is +-1.96 sample standard deviations of those days.  A series' days in one
    array are bounded by ``recent``.
    """
    train, test = fe.time_split(sales, test_days)
    w = Window.partitionBy(*SERIES).orderBy(F.col("date_str").desc())
    u = F.col("sales_units").cast("long")
    days = train.select(*SERIES, "date_str", "sales_units").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= recent)
    st = days.groupBy(*SERIES).agg(F.count(u).alias("_n"), F.sum(u).alias("_s"), F.sum(u * u).alias("_ss"),
                                   F.array_sort(F.collect_list(F.struct("date_str", "sales_units"))).alias("_days"))
    level = smoothed_level(F.transform("_days", lambda d: d["sales_units"]))
    st = st.select(*SERIES, half_up(F.greatest(F.lit(0.0), level), 1).alias("_level"), samp_std_from_sums(F.col("_n"), F.col("_s"), F.col("_ss")).alias("_std"))
    rows = test.select(*SERIES, "date_str", "sales_units").join(st, SERIES, "inner")
    p, half = F.col("_level"), F.lit(1.96) * F.col("_std")
    return rows.select(
        F.col("date_str").alias("forecast_date"), *SERIES, F.lit(label).alias("model_used"), F.col("sales_units").cast("double").alias("actual_demand"),
        p.alias("forecast_demand"), F.greatest(F.lit(0.0), half_up(p - half, 1)).alias("confidence_lower"), half_up(p + half, 1).alias("confidence_upper"),
        (F.col("sales_units").cast("double") - p).alias("forecast_error"), F.lit(test_days).alias("horizon_days")).select(*FORECAST_COLUMNS)


# --------------------------------------------------------------------------- M9
# The fact table itself is assembled by ``plans.warehouse.ModelRun`` (fits both
# models once and unions tree holdout, additive holdout and tree forward rows).
def _with_actuals(pred: DataFrame, test_days: int) -> DataFrame:
    return (pred.withColumn("actual_demand", F.col("sales_units").cast("double"))
            .withColumn("forecast_error", F.col("actual_demand") - F.col("forecast_demand"))
            .withColumn("horizon_days", F.lit(test_days))
            .withColumn("forecast_date", F.col("date_str")))
