"""Intermediate tables: a work folder that driver and executors share, and tables stored there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, or in one set here if that is unset and all is on one machine.

    Without that setting a cluster has no folder known to be shared, which is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="spark-ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


#: Rows of a table that is broadcast by `if_small` at most.
SMALL = 100_000


def if_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, to be broadcast if it has no more than so many rows; beyond that the join is Spark's to choose."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Whether Spark removes the shuffle files of a job when it ends; they stay else until the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back, which cuts its lineage and survives lost executors; shuffle files of the write go with it."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(CLEAN_UP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
