"""Ordinal codes of labels (M1), however many labels there are.

Distinct labels are dealt into ranges and numbered inside each; a range's
first code is the number of labels in the ranges before it.  Only those counts
(one per range) pass through the driver, never the labels.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import materialize


def ordinal_codes(df: DataFrame, column: str) -> DataFrame:
    """``(label, code long)``: the distinct non-null labels of a column in ascending order, codes from 0.

    The dealt labels are staged, so that both steps after see the same ranges.
    """
    labels = df.select(F.col(column).alias("label")).filter(F.col("label").isNotNull()).distinct()
    dealt = materialize(labels.repartitionByRange("label").withColumn("part", F.spark_partition_id()))
    sizes = sorted(dealt.groupBy("part").count().collect())  # a row a range
    starts = accumulate([0] + [r["count"] for r in sizes])
    first = df.sparkSession.createDataFrame([(r.part, s) for r, s in zip(sizes, starts)], "part int, first long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("label")) - 1
    return dealt.withColumn("place", place).join(F.broadcast(first), "part").select("label", (F.col("first") + F.col("place")).alias("code"))


def with_code(df: DataFrame, codes: DataFrame, column: str, code: str) -> DataFrame:
    """``df`` with the code of a column's label as a double; labels without a code, and null, get 0."""
    known = codes.select(F.col("label").alias(f"_label_{code}"), F.col("code").cast("double").alias(f"_{code}"))
    joined = df.join(known, F.col(column) == F.col(f"_label_{code}"), "left")
    return joined.withColumn(code, F.coalesce(f"_{code}", F.lit(0.0))).drop(f"_label_{code}", f"_{code}")
