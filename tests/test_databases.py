"""SQLite tables with pushed conditions, and stepped scores by hand."""

import sqlite3

from pyspark.sql import functions as F

from ledgerloom.operators import reconcile
from ledgerloom.sources import databases


def test_sqlite_table(spark, tmp_path):
    path = str(tmp_path / "bank.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE lines (id INTEGER PRIMARY KEY, status TEXT, amount INTEGER, rate REAL, "odd ""name" VARCHAR(9))')
        db.executemany("INSERT INTO lines VALUES (?, ?, ?, ?, ?)", [(k, ["UNMATCHED", "MATCHED", None][k % 3], k * 10, k / 2, f"n{k}") for k in range(1, 251)])
        db.execute("CREATE TABLE none (id INTEGER)")
    databases.register(spark)
    df = spark.read.format("sqlite_table").option("path", path).option("table", "lines").option("rows", 60).load()
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "bigint", "double", "string"]
    assert df.rdd.getNumPartitions() == 5 and df.count() == 250
    some = df.where((F.col("status") == "UNMATCHED") & (F.col("amount") > 1_000) & F.col("id").isin(102, 105, 250) & (F.length('odd "name') > 2))
    assert sorted(r.id for r in some.collect()) == [102, 105]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "status" not in plan.split("Filter", 1)[1].split("BatchScan")[0] if "Filter" in plan else True
    assert df.where("status IS NULL").count() == 83
    empty = spark.read.format("sqlite_table").option("path", path).option("table", "none").load()
    assert empty.count() == 0


def test_reader_pushes_what_it_can():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringContains

    reader = databases.SqliteReader("p", "t", ["a"], 10)
    left = list(reader.pushFilters([EqualTo(("a",), 5), GreaterThan(("b",), "x"), StringContains(("a",), "z"), In(("c",), (1, 2)), IsNotNull(("a",)), EqualTo(("s", "x"), 1)]))
    assert reader.conditions == ['"a" = ?', '"b" > ?', '"c" IN (?, ?)', '"a" IS NOT NULL'] and reader.values == [5, "x", 1, 2]
    assert [type(f).__name__ for f in left] == ["StringContains", "EqualTo"]


def test_stepped_edges(spark):
    lines = spark.createDataFrame([(1, "CREDIT", "ACME", "x", 100_000, 0), (2, "CREDIT", "", "TT TIEN acme", 98_900, 90_000), (3, "DEBIT", "ACME", "", 100_000, 0), (4, "CREDIT", "ACME", "", 100_500, 0)], "line_id long, direction string, party string, narration string, amount long, ts long")
    entries = spark.createDataFrame([(10, "CREDIT", "ACME", 100_000, 0)], "entry_id long, direction string, partner string, amount long, ts long")
    got = {r.line_id: (r.entry_id, r.fee, round(r.score, 4)) for r in reconcile.stepped_edges(lines, entries).collect()}
    assert got[1] == (10, 0, 1.0) and got[2][:2] == (10, 1_100) and 3 not in got and 4 not in got
