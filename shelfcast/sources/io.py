"""Sources and sinks (S1-S14): CSV in, Parquet/table out, query in, report files out.

Paths are whatever the cluster provides (object store, HDFS, a shared
folder); nothing here assumes a local disk.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.sources import schemas


def with_arrival(df: DataFrame) -> DataFrame:
    """``ingest_ord`` of rows just read from files: file name, place of the block in it, row of the block."""
    return df.withColumn("ingest_ord", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                                F.monotonically_increasing_id().alias("line")))


def read_calendar_csv(spark: SparkSession, path: str) -> DataFrame:
    """Calendar file with an explicit schema (no inference pass), with its arrival order."""
    return with_arrival(spark.read.csv(path, header=True, schema=schemas.CALENDAR_RAW, mode="PERMISSIVE"))


def read_prices_csv(spark: SparkSession, path: str) -> DataFrame:
    """Weekly price file, with its arrival order; numbers read as text and coerced by the cleaner."""
    return with_arrival(spark.read.csv(path, header=True, schema=schemas.PRICES_RAW, mode="PERMISSIVE"))


def read_sales_wide_csv(spark: SparkSession, path: str, day_cols: Sequence[str] | None = None) -> DataFrame:
    """S3: wide daily sales file; every value read as text.

    With a header line the d_* column set is taken from the file; files
    without a header need ``day_cols`` (the layout) and are read with an
    explicit schema.  ``ingest_ord`` records the arrival order (file, then
    line), which keep-first deduplication ranks on.
    """
    reader = spark.read.option("inferSchema", False)
    if day_cols is None:
        df = reader.option("header", True).csv(path)
    else:
        cols = schemas.SALES_ID + list(day_cols)
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in cols])
        df = reader.option("header", False).schema(schema).csv(path)
    return with_arrival(df)


def _by_range(df: DataFrame, *cols: str) -> DataFrame:
    """Rows dealt by ranges of ``cols``: a large part of the first column is many tasks, a small one few files."""
    return df.repartitionByRange(*cols)


def write_processed(calendar: DataFrame, prices: DataFrame, sales: DataFrame, out_dir: str) -> dict:
    """Cleaned datasets as Parquet; sales partitioned by year (partition pruning on dates)."""
    paths = {k: f"{out_dir.rstrip('/')}/{k}" for k in ("calendar", "prices", "sales")}
    calendar.write.mode("overwrite").parquet(paths["calendar"])
    prices.write.mode("overwrite").parquet(paths["prices"])
    (sales.withColumn("year", F.substring("date_str", 1, 4).cast("int"))
     .transform(lambda df: _by_range(df, "year", "date_str", "store_id", "item_id")).write.mode("overwrite").partitionBy("year").parquet(paths["sales"]))
    return paths


def write_features(features: DataFrame, path: str) -> None:
    """Feature dataset, partitioned by store (per-store model reads prune the rest)."""
    _by_range(features, "store_id", "item_id", "date_str").write.mode("overwrite").partitionBy("store_id").parquet(path)


def write_table(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None) -> None:
    """Replace or append a warehouse table (catalog table, or Parquet at ``path``)."""
    if path is not None:
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).saveAsTable(name)


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int,
                   sort_by: Sequence[str] = ()) -> DataFrame:
    """S6 variant: a fact written bucketed (and sorted) by its series key.

    Later joins, aggregates and windows clustered on ``keys`` (or a superset
    of them) read the buckets without a shuffle.  Returns the table.
    """
    w = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys)  # one file a bucket
    if sort_by:
        w = w.sortBy(*sort_by)
    w.option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def read_query(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    """Parameterised SQL (named ``:markers``), never string-formatted values."""
    return spark.sql(sql, args=params or {})


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def init_schemas(spark: SparkSession, location: str | None = None, database: str | None = None) -> list[str]:
    """Create the empty typed warehouse tables if absent, in a database (made if absent) or the current one."""
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{location.rstrip('/')}'" if location else ""))
    made = []
    for name, schema in schemas.WAREHOUSE_TABLES.items():
        loc = f" LOCATION '{location.rstrip('/')}/{name}'" if location else ""
        table = f"{database}.{name}" if database else name
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({_ddl(schema)}) USING parquet{loc}")
        made.append(table)
    return made


def load_table(df: DataFrame, table: str) -> None:
    """S8 + S6: rows appended to a typed table, every column cast to the table's type by name."""
    target = df.sparkSession.table(table).schema
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target]).write.mode("append").insertInto(table)


def replace_table(df: DataFrame, table: str, root: str) -> str:
    """Replace a table as a whole, so that a run that fails halfway leaves the old rows.

    The rows are written to a fresh folder under ``root``; only when all are
    there, the table is pointed at it, which is the commit.  Old folders stay for readers
    that began before (``root`` may be cleared of all but the current one later).  The
    columns must be those the table has.  Returns the folder.
    """
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{uuid.uuid4().hex[:12]}"
    exists = spark.catalog.tableExists(table)
    if exists and [(f.name, f.dataType) for f in spark.table(table).schema] != [(f.name, f.dataType) for f in df.schema]:
        raise ValueError(f"{table} has other columns")
    df.write.parquet(path)
    if exists:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
        spark.catalog.refreshTable(table)
    else:
        spark.sql(f"CREATE TABLE {table} ({_ddl(df.schema)}) USING parquet LOCATION '{path}'")
    return path


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export of any table (header row, one folder of part files)."""
    df.write.mode("overwrite").option("header", True).csv(path)


#: Rows of a sorted part file.
EXPORT_ROWS = 500_000


def export_csv_in_order(df: DataFrame, path: str, order_by: str) -> int:
    """S9 in the order of a column (dropped): part files by ranges of it, each sorted by one task of bounded size.

    The number of part files follows the number of rows, which is counted first and returned.
    """
    rows = df.count()
    dealt = df.repartitionByRange(max(1, -(-rows // EXPORT_ROWS)), order_by).sortWithinPartitions(order_by)
    export_csv(dealt.drop(order_by), path)
    return rows


def append_validation_log(checks: DataFrame, name: str = "sys_validation_logs",
                          path: str | None = None) -> DataFrame:
    """Quality results appended to the audit log with the run timestamp."""
    log = checks.select(F.current_timestamp().alias("run_timestamp"),
                        F.col("dataset").alias("dataset_name"), F.col("check").alias("check_name"),
                        "status", F.col("total_records").alias("records_evaluated"),
                        "failed_records", "details")
    write_table(log, name, "append", path)
    return log


def quality_report(checks: DataFrame) -> DataFrame:
    """One-row report: summary counts plus the ordered list of check results."""
    s = F.col("status")
    return checks.agg(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("execution_timestamp"),
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(s == "PASSED").alias("passed_checks"),
        F.count_if(s == "FAILED").alias("failed_checks"),
        F.count_if(s == "INFO").alias("info_checks"),
        F.transform(F.array_sort(F.collect_list(F.struct(
            "check_no", "dataset", "check", "status", "total_records", "failed_records", "details"))),
            lambda c: c.dropFields("check_no")).alias("checks"))


#: The report's JSON fields but its time.
REPORT_FIELDS = ("total_checks long, passed_checks long, failed_checks long, info_checks long, checks array<struct<dataset: string, "
                 "`check`: string, status: string, total_records: long, failed_records: long, details: string>>")


def read_quality_report(spark: SparkSession, path: str) -> DataFrame:
    """S11 read back: a row a check in the report's order (``position`` from 1), with the report's counts."""
    report = spark.read.schema(REPORT_FIELDS).json(path)
    counts = [c for c in report.columns if c != "checks"]
    rows = report.select(*counts, F.posexplode("checks").alias("_at", "_check"))
    return rows.select((F.col("_at") + 1).alias("position"), *counts, "_check.*")


def write_quality_report(checks: DataFrame, path: str) -> None:
    """S11 sink: the report as a single JSON document (nine checks: one small row)."""
    quality_report(checks).coalesce(1).write.mode("overwrite").json(path)


def purchase_orders(recs: DataFrame) -> DataFrame:
    """Recommendations with something to order."""
    return recs.filter(F.col("recommended_order_qty") > 0)


def sku_forecast_export(schedule: DataFrame, path: str) -> None:
    """Forecast schedule CSV (one SKU/horizon or all)."""
    export_csv(schedule, path)


def write_fact_layout(df: DataFrame, path: str, date_col: str, cluster: Sequence[str] = ("store_id", "item_id"),
                      mode: str = "overwrite") -> None:
    """Facts partitioned by month of the date, rows clustered by store and item in each file."""
    month = F.date_format(F.to_date(F.col(date_col)), "yyyy-MM")
    (_by_range(df.withColumn("month", month), "month", *cluster)
     .sortWithinPartitions("month", *cluster).write.mode(mode).partitionBy("month").parquet(path))
