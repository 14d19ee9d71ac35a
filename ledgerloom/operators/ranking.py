"""Running totals and ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.storage import stored, workspace


def running_totals(rows: DataFrame, group: str, order: str, weight: Column, name: str) -> DataFrame:
    """rows with the sum of `weight` of its group's rows up to each row, in ascending order; equal places count in any order.

    Rows are sorted by ranges of (group, order), so a group spreads over as many ranges as it fills; each range adds up its own rows, and what the ranges before
    it have of its first group is a window over the ranges, of which there are as many as shuffle partitions at most.
    """
    path = workspace(rows.sparkSession)
    placed = rows.withColumn("__weight", weight).repartitionByRange(group, order).withColumn("__range", F.spark_partition_id())
    held = stored(placed, f"{path}/ranges")
    sums = held.groupBy(F.col(group).alias("__g"), F.col("__range").alias("__r")).agg(F.sum("__weight").alias("__s"))
    before = sums.select("__g", "__r", (F.sum("__s").over(Window.partitionBy("__g").orderBy("__r")) - F.col("__s")).alias("__before"))
    inside = F.sum("__weight").over(Window.partitionBy(group, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    met = held.withColumn("__inside", inside).join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r")))
    return met.withColumn(name, F.col("__inside") + F.col("__before")).select(*rows.columns, name)


def ranked_counts(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, k, upto, n): each distinct value of a group with its count, the count up to it, and the group's."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    upto = running_totals(counts, group, value, F.col("k"), "upto")
    whole = upto.groupBy(F.col(group).alias("__group")).agg(F.sum("k").alias("n"))
    return upto.join(whole, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
