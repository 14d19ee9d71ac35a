"""Ledgers as JSON texts, read as variants: entries of any shape, and texts that are no JSON kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of an entry, and the type of each.
FIELDS = {"id": "string", "account_id": "string", "doc_no": "string", "entry_date": "long", "entry_type": "string", "amount": "long", "partner_code": "string", "partner_name": "string", "description": "string"}


def field(entry: Column, name: str, kind: str) -> Column:
    """A field of a variant; null where it is absent or of another type."""
    return F.try_variant_get(entry, F.lit(f"$.{name}"), kind)


def ledger_json(files: DataFrame) -> DataFrame:
    """(file, entry_no, the FIELDS) of each entry of (file, content): a JSON array of entries, one in an object under `entries`, or one entry alone."""
    read = files.select("file", F.try_parse_json("content").alias("v")).where("v IS NOT NULL")
    kind = F.schema_of_variant("v")
    held = F.try_variant_get("v", F.lit("$.entries"), "variant")
    lists = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", F.lit("$"), "array<variant>")).when(held.isNotNull(), held.cast("array<variant>")).otherwise(F.array("v"))
    entries = read.select("file", F.posexplode(lists).alias("entry_no", "entry"))
    return entries.select("file", F.col("entry_no").cast("long").alias("entry_no"), *[field(F.col("entry"), n, k).alias(n) for n, k in FIELDS.items()])


def rejected_json(files: DataFrame) -> DataFrame:
    """(file, reason): `no JSON`, or `no entries` for an array without one."""
    v = F.try_parse_json("content")
    empty = F.size(F.try_variant_get(v, F.lit("$"), "array<variant>")) == 0
    return files.select("file", F.when(v.isNull(), "no JSON").when(empty, "no entries").alias("reason")).where("reason IS NOT NULL")
