"""SQLite tables as a Spark data source: `spark.read.format("sqlite_table").option("path", ..).option("table", ..).load()`.

Conditions that SQLite can check are pushed into its WHERE, the rest stay with Spark; row ids are cut into ranges, one partition each. The file must lie where all
executors can open it. Call `register` once a session.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: Rows of a partition, and of a fetch.
ROWS, FETCH = 100_000, 1_000
OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


class Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], rows: int) -> None:
        self.path, self.table, self.columns, self.rows = path, table, columns, rows
        self.conditions: list[str] = []
        self.values: list[Any] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = _quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            plain = isinstance(getattr(f, "value", None), (int, float, str)) and not isinstance(getattr(f, "value", None), bool)
            if name and type(f) in OPERATORS and plain:
                self.conditions.append(f"{name} {OPERATORS[type(f)]} ?")
                self.values.append(f.value)
            elif name and isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value):
                self.conditions.append(f"{name} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif name and isinstance(f, (IsNull, IsNotNull)):
                self.conditions.append(f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with _connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        return [Range(k, k + self.rows) for k in range(low, high + 1, self.rows)] if low is not None else []

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # an empty table has no ranges
            return
        where = " AND ".join(["rowid >= ?", "rowid < ?", *self.conditions])
        with _connect(self.path) as db:
            held = db.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.table)} WHERE {where}", [partition.low, partition.high, *self.values])
            while rows := held.fetchmany(FETCH):
                yield from rows


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        """Columns by their declared types, by SQLite's rules of affinity; the schema given to `read` goes before it."""
        with _connect(self.options["path"]) as db:
            declared = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not declared:
            raise ValueError(f"no table {self.options['table']}")

        def kind(text: str) -> Any:
            text = text.upper()
            if "INT" in text:
                return LongType()
            if any(t in text for t in ("CHAR", "CLOB", "TEXT")):
                return StringType()
            return BinaryType() if "BLOB" in text or not text else DoubleType()

        return StructType([StructField(c[1], kind(c[2])) for c in declared])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], schema.fieldNames(), int(self.options.get("rows", ROWS)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
