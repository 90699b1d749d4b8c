"""SparkSession helpers.

Library code never creates a session on its own; callers pass one in.  This
module only offers a builder with settings that suit the workload (AQE on,
UTC session time zone, Arrow for pandas exchange) and the lookup of the
shared checkpoint folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "shelfcast", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SHELFCAST_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets this to executor-visible storage; only when the session
    has none and runs in local mode (tests), a folder under the system temp
    dir is registered; elsewhere a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shelfcast-ckpt-")
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir() or base


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for written stage tables)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"
_UNITS = {"": 1, "b": 1, "k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40, "p": 2**50}


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?b?)", size.strip().lower()).groups()
    return int(number) * _UNITS[unit if unit == "b" else unit.rstrip("b")]


def materialize(df: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    Used where one intermediate feeds several independent aggregates (the
    quality checks, model training).  The checkpoint lives in the shared
    folder, so a lost executor does not force recomputation from the source.

    ``split_bytes`` lowers what one task reads of the source files, where a task
    sorts all rows it has read; a session that reads less at once keeps its setting.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(SPLIT_BYTES)
    if split_bytes is None or _bytes(before) <= split_bytes:
        return df.checkpoint(eager=True)
    spark.conf.set(SPLIT_BYTES, str(split_bytes))
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(SPLIT_BYTES, before)
