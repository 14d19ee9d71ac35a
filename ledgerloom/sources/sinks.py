"""Sinks: partitioned statements, semicolon text, JSON vouchers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_statements(rows: DataFrame, path: str, by: str = "bank_code") -> None:
    rows.write.mode("append").partitionBy(by).parquet(path)


def write_delimited(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def vouchers_as_json(lines: DataFrame) -> DataFrame:
    """(entry_id, voucher): one JSON object an entry, its lines in account order."""
    line = F.struct("account", "side", "amount")
    return lines.groupBy("entry_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(line)).alias("lines"))).alias("voucher"))
