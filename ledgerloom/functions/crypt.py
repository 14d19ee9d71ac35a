"""Encryption of single fields with AES-GCM. Keys come from a table, so that no plan or log holds one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most; a table of keys with more is refused.
MOST_KEYS = 1_000


def _keyed(rows: DataFrame, keys: DataFrame, key_id: str) -> DataFrame:
    """rows with `__key`, null where the key is unknown; `keys` is (key_id, key) with keys of 16, 24 or 32 bytes."""
    if keys.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys")
    return rows.join(F.broadcast(keys.select(F.col("key_id").alias(key_id), F.col("key").alias("__key"))), key_id, "left")


def _bound(row_id: str, column: str) -> Column:
    """What a cipher text is bound to: it opens only in its own row and column."""
    return F.concat_ws(":", F.lit(column), F.col(row_id).cast("string"))


def encrypt_fields(rows: DataFrame, columns: list[str], keys: DataFrame, key_id: str, row_id: str) -> DataFrame:
    """rows with the columns as base64 cipher texts: nonce, cipher text and tag. Each has a random nonce of its own; nulls stay null, and an unknown key gives null."""
    made = {c: F.when(F.col("__key").isNotNull(), F.base64(F.aes_encrypt(F.encode(F.col(c).cast("string"), "UTF-8"), F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.encode(_bound(row_id, c), "UTF-8")))) for c in columns}
    return _keyed(rows, keys, key_id).withColumns(made).drop("__key").select(*rows.columns)


def decrypt_fields(rows: DataFrame, columns: list[str], keys: DataFrame, key_id: str, row_id: str) -> DataFrame:
    """The reverse; null where the key is unknown or wrong, or the text was changed or moved to another row."""
    made = {c: F.when(F.col("__key").isNotNull(), F.decode(F.try_aes_decrypt(F.unbase64(F.col(c)), F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"), F.encode(_bound(row_id, c), "UTF-8")), "UTF-8")) for c in columns}
    return _keyed(rows, keys, key_id).withColumns(made).drop("__key").select(*rows.columns)
