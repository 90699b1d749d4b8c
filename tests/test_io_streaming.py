import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from shelfcast.operators import clean
from shelfcast.plans.warehouse import Warehouse
from shelfcast.sources import io
from shelfcast.streaming.ingest import ingest_daily_sales


def test_csv_roundtrip_and_schemas(spark):
    root = tempfile.mkdtemp(prefix="shelfcast-io-")
    cal = spark.createDataFrame([("2023-01-01", 12252, "Sunday", 1, 1, 2023, "d_1", None, None, None, None, 1, 1, 0, 0),
                                 ("bad", 12252, "Monday", 2, 1, 2023, "d_2", "NewYear", "National", None, None, 1, 0, 1, 1)],
                                "date string, wm_yr_wk int, weekday string, wday int, month int, year int, d string, "
                                "event_name_1 string, event_type_1 string, event_name_2 string, event_type_2 string, "
                                "snap_CA int, snap_TX int, snap_WI int, is_holiday int")
    io.export_csv(cal, f"{root}/cal")
    back = io.read_calendar_csv(spark, f"{root}/cal")
    assert back.count() == 2 and clean.clean_calendar(back).count() == 1
    made = io.init_schemas(spark, f"{root}/wh")
    assert "fact_inventory_recommendations" in made
    assert spark.table("fact_sales").count() == 0
    q = io.read_query(spark, "SELECT :x AS v", {"x": 7}).first()
    assert q.v == 7


def test_quality_report_and_log(spark):
    root = tempfile.mkdtemp(prefix="shelfcast-q-")
    w = Warehouse(spark, SF_SMALL)
    from shelfcast.operators import quality
    checks = quality.run_all_checks(w.calendar, w.fact_prices, w.fact_sales)
    rep = io.quality_report(checks).first()
    assert rep.total_checks == 9 and len(rep.checks) == 9
    assert rep.checks[0]["check"] == "Missing Key Records"
    io.append_validation_log(checks, path=f"{root}/log")
    io.append_validation_log(checks, path=f"{root}/log")
    assert spark.read.parquet(f"{root}/log").count() == 18


def test_fact_layout(spark):
    root = tempfile.mkdtemp(prefix="shelfcast-layout-")
    w = Warehouse(spark, SF_SMALL)
    io.write_fact_layout(w.fact_sales, f"{root}/fs", "date_str")
    back = spark.read.parquet(f"{root}/fs")
    assert back.count() == w.fact_sales.count()
    assert "month" in back.columns
    plan = back.filter(F.col("month") == "1999-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "month" in plan


def test_streaming_ingest(spark):
    root = tempfile.mkdtemp(prefix="shelfcast-stream-")
    land = f"{root}/landing"
    os.makedirs(land)
    wide = spark.createDataFrame([("A_CA_1", "A", "D", "C", "CA_1", "CA", "3", "-1"),
                                  ("B_CA_1", "B", "D", "C", "CA_1", "CA", "x", "4")],
                                 "id string, item_id string, dept_id string, cat_id string, store_id string, "
                                 "state_id string, d_1 string, d_2 string")
    wide.coalesce(1).write.option("header", True).csv(f"{land}/day1")
    cal = spark.createDataFrame([("d_1", "2023-01-01"), ("d_2", "2023-01-02")], "d string, date_str string")
    ingest_daily_sales(spark, f"{land}/*", cal, f"{root}/fact", f"{root}/ckpt", ["d_1", "d_2"])
    out = {(r.id, r.d): r.sales_units for r in spark.read.parquet(f"{root}/fact").collect()}
    assert out == {("A_CA_1", "d_1"): 3, ("A_CA_1", "d_2"): 0, ("B_CA_1", "d_1"): 0, ("B_CA_1", "d_2"): 4}
    # a batch that is tried again replaces what it wrote
    assert [r.batch_id for r in spark.read.parquet(f"{root}/fact").select("batch_id").distinct().collect()] == [0]
    # a second run with no new files appends nothing
    ingest_daily_sales(spark, f"{land}/*", cal, f"{root}/fact", f"{root}/ckpt", ["d_1", "d_2"])
    assert spark.read.parquet(f"{root}/fact").count() == 4


def test_export_in_order_writes_part_files_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "EXPORT_ROWS", 100)
    path = str(tmp_path / "csv")
    feed = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("v"), F.struct(((F.col("id") * 7919) % 3000).alias("k"), F.lit(1)).alias("ingest_ord"))
    assert io.export_csv_in_order(feed, path, "ingest_ord") == 3000
    files = sorted((tmp_path / "csv").glob("part-*"))
    parts = [[int(v) for v in f.read_text().split()[1:]] for f in files]
    assert [v for p in parts for v in p] == list(range(3000))
    assert len(parts) == 30 and max(map(len, parts)) <= 300   # ranges are sampled
    empty = str(tmp_path / "empty")
    assert io.export_csv_in_order(feed.filter("v < 0"), empty, "ingest_ord") == 0


def test_staging_reads_small_splits(spark, tmp_path):
    from shelfcast.session import SPLIT_BYTES, materialize
    path = str(tmp_path / "prices")
    rows = spark.range(20000).select(F.lit("s").alias("store_id"), F.lit("i").alias("item_id"), F.col("id").alias("wm_yr_wk"), F.lit("1.5").alias("sell_price"))
    rows.coalesce(1).write.option("header", True).csv(path)
    before = spark.conf.get(SPLIT_BYTES)
    staged = materialize(io.read_prices_csv(spark, path), 2**14)
    assert staged.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism and staged.count() == 20000
    assert spark.conf.get(SPLIT_BYTES) == before
    try:
        spark.conf.set(SPLIT_BYTES, "8k")   # a session that reads less keeps its setting
        assert materialize(io.read_prices_csv(spark, path), 2**14).rdd.getNumPartitions() > staged.rdd.getNumPartitions()
    finally:
        spark.conf.set(SPLIT_BYTES, before)
