"""Canonical views over the driver's tables: transactions, invoices, bank lines, journal lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx_id, account, amount, ts, is_credit, narration): money in minor units, time in epoch seconds UTC."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("tx_id"),
        F.col("user_id").alias("account"),
        F.round(F.col("value") * 100).cast("long").alias("amount"),
        F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000000").alias("ts"),
        F.col("event_type").isin("purchase", "signup").alias("is_credit"),
        F.concat_ws(" ", "event_type", "props").alias("narration"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(invoice_id, doc_ref, customer, party, amount, ts) from orders and customers."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("invoice_id"),
        F.concat(F.lit("HD-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("doc_ref"),
        F.col("o_custkey").alias("customer"),
        F.col("c_name").alias("party"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"),
        F.expr("unix_micros(CAST(o_orderdate AS TIMESTAMP)) DIV 1000000").alias("ts"),
    )


def bank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of the invoices: some absent, some short by a fee, late, or without a reference."""
    fee = F.when(F.col("invoice_id") % 10 >= 4, (F.col("invoice_id") % 10 - 3) * 1100).otherwise(0)
    return (
        invoices(spark, sf_dir)
        .where("invoice_id % 10 <> 9")
        .select(
            F.col("invoice_id").alias("line_id"),
            F.when(F.col("invoice_id") % 7 == 0, F.lit("")).otherwise(F.col("doc_ref")).alias("ref"),
            "customer",
            "party",
            (F.col("amount") - fee).cast("long").alias("amount"),
            (F.col("ts") + (F.col("invoice_id") % 100) * 3600).alias("ts"),
        )
    )


def journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, account, side, amount): each order debits receivables 131 and credits revenue 511 and tax 3331."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("gross"))
    net = F.expr("gross * 10 DIV 11")
    lines = F.array(
        F.struct(F.lit("131").alias("account"), F.lit("D").alias("side"), F.col("gross").alias("amount")),
        F.struct(F.lit("511").alias("account"), F.lit("C").alias("side"), net.alias("amount")),
        F.struct(F.lit("3331").alias("account"), F.lit("C").alias("side"), (F.col("gross") - net).alias("amount")),
    )
    return orders.select("entry_id", F.inline(lines))


#: The same views in DuckDB, as common table expressions by name.
VIEW_SQL = {
    "txn": """txn AS (SELECT event_id AS tx_id, user_id AS account, CAST(round(value * 100) AS BIGINT) AS amount, epoch_us(ts) // 1000000 AS ts,
        event_type IN ('purchase', 'signup') AS is_credit, event_type || ' ' || props AS narration FROM events)""",
    "inv": """inv AS (SELECT o_orderkey AS invoice_id, 'HD-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS doc_ref, o_custkey AS customer, c_name AS party,
        CAST(round(o_totalprice * 100) AS BIGINT) AS amount, epoch_us(o_orderdate) // 1000000 AS ts FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "bank": """bank AS (SELECT invoice_id AS line_id, CASE WHEN invoice_id % 7 = 0 THEN '' ELSE doc_ref END AS ref, customer, party,
        CAST(amount - CASE WHEN invoice_id % 10 >= 4 THEN (invoice_id % 10 - 3) * 1100 ELSE 0 END AS BIGINT) AS amount, ts + (invoice_id % 100) * 3600 AS ts FROM inv WHERE invoice_id % 10 <> 9)""",
    "jl": """jl AS (SELECT entry_id, unnest(['131', '511', '3331']) AS account, unnest(['D', 'C', 'C']) AS side, unnest([gross, gross * 10 // 11, gross - gross * 10 // 11]) AS amount
        FROM (SELECT o_orderkey AS entry_id, CAST(round(o_totalprice * 100) AS BIGINT) AS gross FROM orders))""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """The head of an oracle query that uses the named views."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(VIEW_SQL[n] for n in names)
