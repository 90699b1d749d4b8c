"""Incremental daily ingestion with Structured Streaming.

The platform is a daily batch: each day a new wide sales export lands and is
cleaned and appended to the sales fact.  Expressed as a streaming query with
``trigger(availableNow=True)``, every scheduled run processes exactly the
files that arrived since the last run (tracked in the checkpoint), then
stops - no file bookkeeping of our own, and a failed run resumes from the
checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.operators import clean
from shelfcast.session import materialize


def _wide_schema(day_cols: list[str]) -> T.StructType:
    ids = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
    return T.StructType([T.StructField(c, T.StringType(), True) for c in ids + day_cols])


def first_arrivals(batch: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Of a delivery's wide rows, those whose id no earlier delivery had: ``(id, ...)`` unchanged."""
    if seen is None:
        return batch
    known = seen.select(F.col("id").alias("_id"))
    return batch.join(known, F.col("id").eqNullSafe(F.col("_id")), "left_anti")


def ingest_daily_sales(spark: SparkSession, landing_dir: str, calendar: DataFrame, target_path: str,
                       checkpoint_path: str, day_cols: list[str], file_format: str = "csv"):
    """Clean newly landed wide sales files (C10-C13) and append them to ``target_path``.

    ``day_cols`` fixes the file layout (streaming sources need a schema).
    The first row of an id counts, within a delivery by arrival order and across
    deliveries by a table of the ids seen so far (``<checkpoint_path>-ids``, a row an id with
    the batch that brought it), so a later file can't replace an earlier row.  A batch
    writes its own partition ``batch_id`` of the target and of that table, and reads
    the partitions of earlier batches alone: a batch that is tried again
    finds what it found before and replaces what it wrote.  Returns the
    finished ``StreamingQuery``.
    """
    reader = spark.readStream.schema(_wide_schema(day_cols))
    if file_format == "csv":
        reader = reader.option("header", True)
    raw = reader.format(file_format).load(landing_dir)
    ids_path = f"{checkpoint_path.rstrip('/')}-ids"

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        arrived = materialize(batch.withColumn("ingest_ord", F.monotonically_increasing_id()))
        seen = spark.read.schema("id string, batch_id long").parquet(ids_path).filter(F.col("batch_id") < batch_id) if batch_id else None
        fresh = first_arrivals(arrived, seen)
        cleaned = clean.clean_and_melt_sales(fresh, calendar)
        cleaned.write.mode("overwrite").parquet(f"{target_path}/batch_id={batch_id}")
        fresh.select("id").distinct().write.mode("overwrite").parquet(f"{ids_path}/batch_id={batch_id}")

    query = (raw.writeStream.foreachBatch(per_batch)
             .option("checkpointLocation", checkpoint_path)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
