"""Lazily built warehouse over one scale-factor directory of driver tables.

``Warehouse(spark, sf_dir)`` exposes every table of the platform as a
property that composes the operators.  Most are lazy: Catalyst sees one plan
from the Parquet scans to the requested table.  ``series_days``,
``clean_calendar`` and ``raw_sales_wide`` (stage boundaries) and ``ModelRun`` run jobs when they are
first read.  For the nightly batch run
(``plans.nightly``) the same properties are materialised stage by stage.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.operators import clean, dims, marts
from shelfcast.sources import adapter


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Output step: exact DECIMAL money columns become doubles and dates ISO strings."""
    def out(f):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name)
        return F.col(f.name)
    return df.select(*[out(f) for f in df.schema.fields])


class Warehouse:
    def __init__(self, spark: SparkSession, sf_dir: str, overrides: dict | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        # tables supplied from outside (e.g. materialised by a previous stage)
        for k, v in (overrides or {}).items():
            self.__dict__[k] = v

    # ---- sources --------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        return adapter.read_table(self.spark, self.sf_dir, name)

    @cached_property
    def series_days(self) -> DataFrame:
        """Series-day aggregate of the order lines, computed once (stage boundary).

        Both facts derive from it; column pruning would otherwise give the
        two branches different plans and the lines would be scanned, joined
        and shuffled twice.
        """
        from shelfcast.session import materialize
        return materialize(adapter.series_days(self.spark, self.sf_dir))

    @cached_property
    def fact_sales(self) -> DataFrame:
        return adapter.fact_sales(self.spark, self.sf_dir, self.series_days)

    @cached_property
    def fact_prices(self) -> DataFrame:
        return adapter.fact_prices(self.spark, self.sf_dir, self.series_days)

    @cached_property
    def calendar_bounds(self) -> DataFrame:
        d = F.to_date("l_shipdate")
        return self.table("lineitem").agg(F.min(d).alias("start_date"), F.max(d).alias("end_date"))

    @cached_property
    def calendar_generated(self) -> DataFrame:
        return dims.calendar_between(self.calendar_bounds)

    @cached_property
    def calendar(self) -> DataFrame:
        """The calendar as delivered, cleaned: a day that the feed lacks is missing here too."""
        return self.clean_calendar

    # ---- dimensions -----------------------------------------------------
    @cached_property
    def dim_calendar(self) -> DataFrame:
        return dims.dim_calendar(self.calendar)

    @cached_property
    def dim_stores(self) -> DataFrame:
        return dims.dim_stores(self.fact_sales)

    @cached_property
    def dim_categories(self) -> DataFrame:
        return dims.dim_categories(self.fact_sales)

    @cached_property
    def dim_departments(self) -> DataFrame:
        return dims.dim_departments(self.fact_sales)

    @cached_property
    def dim_products(self) -> DataFrame:
        return dims.dim_products(self.fact_sales, self.fact_prices)

    # ---- SQL models -----------------------------------------------------
    @cached_property
    def stg_sales(self) -> DataFrame:
        return marts.stg_sales(self.fact_sales)

    @cached_property
    def stg_calendar(self) -> DataFrame:
        return marts.stg_calendar(self.dim_calendar)

    @cached_property
    def stg_prices(self) -> DataFrame:
        return marts.stg_prices(self.fact_prices)

    @cached_property
    def daily(self) -> DataFrame:
        return marts.int_daily_sales(self.stg_sales, self.stg_calendar, self.stg_prices)

    @cached_property
    def weekly(self) -> DataFrame:
        return marts.int_weekly_sales(self.daily)

    @cached_property
    def monthly(self) -> DataFrame:
        return marts.int_monthly_sales(self.daily)

    @cached_property
    def product_mart(self) -> DataFrame:
        return marts.mart_product_performance(self.daily)

    @cached_property
    def store_mart(self) -> DataFrame:
        return marts.mart_store_performance(self.daily, self.dim_stores)

    # ---- raw feeds and cleaning (C, V) ----------------------------------
    @cached_property
    def raw_calendar(self) -> DataFrame:
        return adapter.raw_calendar(self.spark, self.sf_dir)

    @cached_property
    def raw_prices(self) -> DataFrame:
        return adapter.raw_price_quotes(self.spark, self.sf_dir)

    @cached_property
    def raw_sales_wide(self) -> DataFrame:
        """The wide daily export as the platform receives it: a CSV file (S9 out, S3 in).

        The export is written once to the shared folder as text lines (no
        2,500-column plan) and read back by the wide-file reader.
        """
        from shelfcast.session import shared_dir
        from shelfcast.sources import io
        path = shared_dir(self.spark, "sales-wide-export")
        lines, day_cols = adapter.raw_sales_wide_lines(self.spark, self.sf_dir)
        lines.write.mode("overwrite").text(path)
        return io.read_sales_wide_csv(self.spark, path, day_cols)

    @cached_property
    def clean_calendar(self) -> DataFrame:
        """A row a day, staged: the feed is one record an order line, and many tables need the calendar."""
        from shelfcast.session import materialize
        return materialize(clean.clean_calendar(self.raw_calendar), clean.KEEP_FIRST_BYTES)

    @cached_property
    def clean_prices(self) -> DataFrame:
        return clean.clean_prices(self.raw_prices)

    @cached_property
    def clean_sales(self) -> DataFrame:
        return clean.clean_and_melt_sales(self.raw_sales_wide, self.clean_calendar)

    # ---- features (F) ---------------------------------------------------
    @cached_property
    def feature_base(self) -> DataFrame:
        from shelfcast.operators import features
        return features.load_base(self.fact_sales, self.dim_calendar, self.fact_prices)

    @cached_property
    def features(self) -> DataFrame:
        from shelfcast.operators import features
        return features.build_features(self.feature_base)

    @cached_property
    def horizon_calendar(self) -> DataFrame:
        """Calendar extended 90 days past the last sale (for forward rows)."""
        b = self.calendar_bounds.select("start_date", F.date_add("end_date", 90).alias("end_date"))
        return dims.dim_calendar(clean.clean_calendar(dims.calendar_between(b), order_by="date"))

    # ---- forecasts (M10 baseline; models) -------------------------------
    @cached_property
    def baseline_forward(self) -> DataFrame:
        from shelfcast.operators import forecast
        return forecast.baseline_forecast(self.fact_sales)

    @cached_property
    def baseline_holdout(self) -> DataFrame:
        from shelfcast.operators import forecast
        return forecast.baseline_holdout(self.fact_sales)

    @cached_property
    def smoothing_holdout(self) -> DataFrame:
        from shelfcast.operators import forecast
        return forecast.smoothing_holdout(self.fact_sales)

    @cached_property
    def forecasts(self) -> DataFrame:
        """Forecast fact table of the SQL-checkable forecasters: both on the holdout, the recent mean forward."""
        return self.baseline_holdout.unionByName(self.smoothing_holdout).unionByName(self.baseline_forward)

    # ---- inventory (I) --------------------------------------------------
    @cached_property
    def recent_stats(self) -> DataFrame:
        from shelfcast.operators import inventory
        return inventory.recent_stats(self.fact_sales)

    @cached_property
    def on_hand(self) -> DataFrame:
        return adapter.on_hand_snapshot(self.recent_stats, self.fact_sales)

    @cached_property
    def recommendations(self) -> DataFrame:
        from shelfcast.operators import inventory
        return inventory.recommendations(self.fact_sales, self.forecasts, self.on_hand,
                                         self.dim_products, stats=self.recent_stats)

    @cached_property
    def inventory_mart(self) -> DataFrame:
        return marts.mart_inventory_health(self.recommendations)

    @cached_property
    def accuracy_mart(self) -> DataFrame:
        return marts.mart_forecast_accuracy(self.forecasts)

    # ---- scenarios (Q18) ------------------------------------------------
    @cached_property
    def scenarios(self) -> DataFrame:
        """What-if grid, every setting of the scenario page: price -30..30 and promo 0..50 by 5,
        holiday 0..100 by 10, delay 0..21 by 1 - a parameter table of fixed size."""
        def steps(lo: int, hi: int, by: int) -> Column:
            return F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(by)))

        s = self.spark.range(1).select(steps(-30, 30, 5).alias("price_change_pct"))
        s = s.select("*", steps(0, 50, 5).alias("promo_uplift_pct"))
        s = s.select("*", steps(0, 100, 10).alias("holiday_surge_pct"))
        s = s.select("*", steps(0, 21, 1).alias("lead_time_delay_days"))
        pct = ["price_change_pct", "promo_uplift_pct", "holiday_surge_pct"]
        s = s.select(*[F.col(c).cast("double") for c in pct], "lead_time_delay_days")
        sid = F.concat_ws("/", *[F.col(c).cast("string") for c in
                                 ("price_change_pct", "promo_uplift_pct", "holiday_surge_pct",
                                  "lead_time_delay_days")])
        return s.select(sid.alias("scenario_id"), "*")


def round_doubles(df: DataFrame, scale: int = 6) -> DataFrame:
    """Output step for statistics: every double rounded half-up at ``scale`` decimals."""
    from shelfcast.functions.rounding import half_up
    return df.select(*[half_up(f.name, scale).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


class ModelRun:
    """Forecasting stage over a warehouse: features materialised once, models fitted once."""

    def __init__(self, w: Warehouse, test_days: int = 30, gbt_params: dict | None = None):
        from shelfcast.operators import features as fe
        from shelfcast.session import materialize
        self.w = w
        self.test_days = test_days
        self.gbt_params = gbt_params or {}
        self.features = materialize(w.features)
        self.train, self.test = fe.time_split(self.features, test_days)

    @cached_property
    def coefficients(self) -> DataFrame:
        from shelfcast.operators import forecast
        from shelfcast.session import materialize
        return materialize(forecast.fit_additive(self.train, self.test))

    @cached_property
    def tree(self):
        from shelfcast.operators import forecast
        return forecast.GlobalTreeModel(**self.gbt_params).fit(self.train)

    @cached_property
    def fact_forecast_results(self) -> DataFrame:
        from shelfcast.operators import features as fe
        from shelfcast.operators import forecast
        tree_hold = forecast._with_actuals(self.tree.predict(self.test), self.test_days)
        add_hold = forecast._with_actuals(forecast.score_additive(self.test, self.coefficients),
                                          self.test_days)
        fwd = fe.forward_rows(self.features, self.w.horizon_calendar, self.train)
        tree_fwd = (self.tree.predict(fwd).withColumn("actual_demand", F.lit(None).cast("double"))
                    .withColumn("forecast_error", F.lit(None).cast("double")))
        cols = forecast.FORECAST_COLUMNS
        return (tree_hold.select(*cols).unionByName(add_hold.select(*cols))
                .unionByName(tree_fwd.select(*cols)))
