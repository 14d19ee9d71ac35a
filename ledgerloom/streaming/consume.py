"""Structured Streaming forms: idempotent intake, session flushes, and a batch consumer with retries and dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once_each(stream: DataFrame, key: str, time: str, within: str = "1 day") -> DataFrame:
    """Drops events whose key was seen within the time to live."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, key: str, time: str, idle: str = "30 minutes") -> DataFrame:
    """A row a session: events of one key with no pause of `idle`."""
    return stream.withWatermark(time, idle).groupBy(F.session_window(time, idle).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def rolling_alerts(stream: DataFrame, floor: int, least: int = 3) -> DataFrame:
    """Structuring over sliding windows of a day, an hour apart: an approximation of the exact row-wise batch rule."""
    windows = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day", "1 hour").alias("w"), "account")
    return windows.agg(F.count("*").alias("n"), F.sum("amount").alias("total")).where((F.col("n") >= least) & (F.col("total") >= floor)).select("account", F.col("w.start").alias("start"), "n", "total")


def with_retries(stream: DataFrame, retry: str) -> DataFrame:
    """The stream together with the rows that a consumer put back into the table `retry`, which is made if absent."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(retry)
    return stream.unionByName(spark.readStream.schema(stream.schema).option("recursiveFileLookup", "true").parquet(retry))


def consumer(handle: Callable[[DataFrame], DataFrame], done: str, dead: str, retries: int = 3, retry: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: `handle` adds boolean `ok`; good rows are stored, bad ones after their last try are dead letters.

    Other bad rows, where ok is false or null, go to the table `retry` (beside `done` if not given) with one more in retry_count, from which
    `with_retries` feeds them in again; with availableNow that is the next start.
    """
    again = retry or f"{done.rstrip('/')}-retry"

    def run(batch: DataFrame, epoch: int) -> None:
        tries = F.coalesce(F.col("retry_count"), F.lit(0)) + 1
        bad = ~F.coalesce(F.col("ok"), F.lit(False))
        held = handle(batch).persist()
        # an epoch that is run again replaces what it wrote before
        held.where("ok").drop("ok").write.mode("overwrite").parquet(f"{done.rstrip('/')}/epoch={epoch}")
        held.where(bad & (tries >= retries)).drop("ok").write.mode("overwrite").parquet(f"{dead.rstrip('/')}/epoch={epoch}")
        back = held.where(bad & (tries < retries)).withColumn("retry_count", tries.cast(batch.schema["retry_count"].dataType)).select(*batch.columns)
        back.write.mode("overwrite").parquet(f"{again.rstrip('/')}/epoch={epoch}")
        held.unpersist()

    return run
