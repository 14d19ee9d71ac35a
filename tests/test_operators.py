"""Library operators against the DuckDB oracle and small pure-Python models."""

import itertools
import random

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.text import jaro_micro, jaro_winkler_bps
from ledgerloom.operators import ledger, reconcile, records
from ledgerloom.plans import metric_queries, money_queries, party_queries, registry, source_queries, voucher_queries  # noqa: F401  they register their queries
from ledgerloom.plans.session import shared_checkpoints
from ledgerloom.sources import sinks, statements

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    oracle = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(oracle.columns)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    want = sorted(repr([plain(r[oracle.columns.index(c)]) for c in sorted(df.columns)]) for r in oracle.fetchall())
    assert got == want


def test_assignment_is_the_serial_walk(spark):
    shared_checkpoints(spark)
    rng = random.Random(3)
    edges = sorted({(rng.randrange(30), rng.randrange(25)) for _ in range(90)})
    want, used = {}, set()
    for line in range(30):
        for inv in sorted(i for x, i in edges if x == line):
            if inv not in used:
                want[line] = inv
                used.add(inv)
                break
    got = {r.line_id: r.invoice_id for r in reconcile.assign(spark.createDataFrame(edges, "line_id long, invoice_id long"), []).collect()}
    assert got == want


def test_assignment_of_many_equal_payments(spark):
    """Eighty equal lines and invoices of one customer, with a few lines and invoices that belong to some of them only."""
    edges = [(x, i) for x in range(10, 90) for i in range(100, 180)] + [(5, 103), (5, 101), (95, 100), (95, 500), (40 + 100, 179), (1000, 500)]
    want, used = {}, set()
    for line in sorted({x for x, _ in edges}):
        for inv in sorted(i for x, i in edges if x == line):
            if inv not in used:
                want[line] = inv
                used.add(inv)
                break
    got = {r.line_id: r.invoice_id for r in reconcile.assign(spark.createDataFrame(edges, "line_id long, invoice_id long"), []).collect()}
    assert got == want


@given(st.lists(st.integers(1, 40), min_size=2, max_size=9), st.integers(2, 120))
def test_subset_sum_finds_what_there_is(amounts, target):
    items = list(enumerate(amounts))
    there = any(sum(c) == target for k in range(2, 9) for c in itertools.combinations(amounts, k))
    found = reconcile.subset_sum(target, items)
    assert (found is not None) == there
    if found:
        assert len(found) >= 2 and sum(amounts[i] for i in found) == target


def test_splits_of_a_customer_with_many_invoices(spark):
    """Every line that is a sum of a few invoices is found among 60 unequal ones; a search that runs out says so."""
    shared_checkpoints(spark)
    rng = random.Random(4)
    inv = [(c * 100 + k, c, 2 * rng.randrange(10**8, 10**9)) for c in range(3) for k in range(60)]
    amount = {i: a for i, _, a in inv}
    lines = [(c * 10 + j, c, sum(amount[c * 100 + 5 * j + k] for k in range(n))) for c in range(3) for j, n in enumerate((2, 3, 2, 3))]
    lines += [(1000, 0, lines[0][2]), (1001, 1, 6 * 10**9 + 1), (1002, 2, -5)]
    made = spark.createDataFrame(lines, "line_id long, customer long, amount long"), spark.createDataFrame(inv, "invoice_id long, customer long, amount long")
    got = {r.line_id: (r.status, r.invoice_ids) for r in reconcile.splits(*made).collect()}
    used = [i for status, ids in got.values() if status == "SPLIT" for i in ids]
    assert len(used) == len(set(used))
    for i, _, total in lines[:12]:
        assert got[i][0] == "SPLIT" and sum(amount[x] for x in got[i][1]) == total
    assert got[1001] == ("EXHAUSTED", None) and 1002 not in got


def test_blocks_of_a_hot_customer_agree(spark, monkeypatch):
    """Many lines of one customer, searched in many blocks that want the same invoices: each is used once, and nothing is left that one block would find."""
    monkeypatch.setattr(reconcile, "LINES_PER_BLOCK", 2)
    shared_checkpoints(spark)
    rng = random.Random(5)
    inv = [(k, 7, rng.choice([100, 200, 300, rng.randrange(1, 10**6)])) for k in range(40)]
    lines = [(k, 7, sum(inv[i][2] for i in rng.sample(range(40), rng.randrange(2, 7)))) for k in range(30)] + [(99, 8, 5), (98, 7, 10**12)]
    made = spark.createDataFrame(lines, "line_id long, customer long, amount long"), spark.createDataFrame(inv, "invoice_id long, customer long, amount long")
    got = {r.line_id: (r.status, r.invoice_ids) for r in reconcile.splits(*made).collect()}
    amount, total = {i: a for i, _, a in inv}, {i: a for i, _, a in lines}
    used = [i for status, ids in got.values() if status == "SPLIT" for i in ids]
    assert len(used) == len(set(used)) and 99 not in got and 98 not in got
    assert all(sum(amount[i] for i in ids) == total[k] for k, (status, ids) in got.items() if status == "SPLIT")
    free = [(i, a) for i, a in amount.items() if i not in set(used)]
    for k, t in total.items():
        if k not in got:
            assert reconcile.few_items(t, free)[0] is None and reconcile.subset_sum(t, free) is None


def test_equal_lines_of_a_hot_customer_need_one_round(spark, monkeypatch):
    """Lines of one amount would find the same invoices in every block, so they stand in one; each gets its own at once."""
    shared_checkpoints(spark)
    monkeypatch.setattr(reconcile, "LINES_PER_BLOCK", 16)
    rng, written = random.Random(6), []
    kinds = [[rng.randrange(10**7, 10**8) for _ in range(3)] for _ in range(3)]
    inv = [(k * 100 + 10 * i + j, 7, a) for i, parts in enumerate(kinds) for j, a in enumerate(parts) for k in range(16)]
    lines = [(i * 100 + k, 7, sum(parts)) for i, parts in enumerate(kinds) for k in range(16)]
    stored = reconcile.stored
    monkeypatch.setattr(reconcile, "stored", lambda df, path: written.append(path.rsplit("/")[-1]) or stored(df, path))
    made = spark.createDataFrame(lines, "line_id long, customer long, amount long"), spark.createDataFrame(inv, "invoice_id long, customer long, amount long")
    got = reconcile.splits(*made).collect()
    used = [i for r in got for i in r.invoice_ids]
    assert len(got) == 48 and len(used) == len(set(used)) == 144 and "found-1" not in written


@given(st.lists(st.integers(1, 30), min_size=2, max_size=14), st.integers(2, 200), st.sampled_from([1, 2, 3, 1_024]), st.sampled_from([7, 100_000]))
def test_search_by_stretches_takes_the_same_steps(amounts, target, stretch, steps):
    """The search over stretches of the items gives what a search over one list of them, greatest first, gives."""
    items, most = list(enumerate(amounts)), 4
    down = sorted(((i, a) for i, a in items if a <= target), key=lambda x: (-x[1], x[0]))
    stack, left_steps, want = [(0, target, ())], steps, None
    while stack and left_steps:
        left_steps -= 1
        k, left, chosen = stack.pop()
        if left == 0:
            if len(chosen) >= 2:
                want = (sorted(chosen), True)
                break
            continue
        if k == len(down) or len(chosen) == most or sum(a for _, a in down[k : k + most - len(chosen)]) < left:
            continue
        stack.append((next((j for j in range(k, len(down)) if down[j][1] < down[k][1]), len(down)), left, chosen))
        if down[k][1] <= left:
            stack.append((k + 1, left - down[k][1], (*chosen, down[k][0])))
    held, reconcile.STRETCH = reconcile.STRETCH, stretch
    try:
        assert reconcile.search(target, items, most, steps) == (want or (None, not stack))
    finally:
        reconcile.STRETCH = held


def test_wide_split_query(spark):
    lines, inv = registry.wide_lines(spark, SF)
    total, amount = {r.line_id: r.amount for r in lines.collect()}, {r.invoice_id: r.amount for r in inv.collect()}
    got = registry.QUERIES["join_wide_splits"](spark, SF).collect()
    assert {r.line_id: sum(amount[i] for i in r.invoice_ids) for r in got if r.status == "SPLIT"}.items() <= total.items()
    assert sum(r.status == "SPLIT" for r in got) > 0.9 * len(total)
    used = [i for r in got for i in r.invoice_ids or []]
    assert len(used) == len(set(used))


def test_split_query_finds_every_merged_line(spark):
    lines = {r.line_id: r.amount for r in registry.merged_lines(spark, SF).collect()}
    amount = {r.invoice_id: r.amount for r in registry.invoices(spark, SF).collect()}
    got = registry.QUERIES["udf_subset_sum_splits"](spark, SF).collect()
    assert {r.line_id: sum(amount[i] for i in r.invoice_ids) for r in got if r.status == "SPLIT"} == lines and len(got) == len(lines)


@given(st.text("abcd", max_size=8), st.text("abcd", max_size=8))
def test_jaro_is_near_the_float_form(a, b):
    want = duckdb.connect().execute("SELECT jaro_similarity(?, ?)", [a, b]).fetchone()[0] if a and b else 0
    assert abs(jaro_micro(a, b) / 1e6 - want) < 1e-5
    assert 0 <= jaro_winkler_bps(a, b) <= 10_000


def test_merkle_root_of_three_leaves_splits_two_and_one():
    import hashlib

    h = lambda b: hashlib.sha256(b).digest()
    a, b, c = (h(b"\0" + x) for x in (b"a", b"b", b"c"))
    assert records.merkle_root([b"a", b"b", b"c"]) == h(b"\1" + h(b"\1" + a + b) + c).hex()


def test_statement_formats(spark):
    files = spark.createDataFrame([("a.csv", "﻿Bank\nDate;Ref;Debit;Credit;Text\n01/02/2026;R1;;1.000;in\nx\n02/02/2026;R2;(500);;out\n"), ("b.sta", ":20:X\n:25:1\n:61:260201D500,NTRFR9\n:86:one\ntwo\n:62F:C1\n")], "file string, content string")
    kinds = {r.file: (r.k, r.d) for r in files.select("file", statements.container_format(F.col("file"), F.col("content")).alias("k"), statements.delimiter(F.col("content")).alias("d")).collect()}
    assert kinds["a.csv"] == ("CSV", ";") and kinds["b.sta"][0] == "MT940"
    names = {"date": ["Date"], "ref": ["Ref"], "debit": ["Debit"], "credit": ["Credit"], "narration": ["Text"]}
    rows = [tuple(r) for r in statements.delimited(files.where("file = 'a.csv'"), names).select("ref_code", "posting_type", "amount").orderBy("row_id").collect()]
    assert rows == [("R1", "credit", 1000), ("R2", "debit", 500)]
    assert [tuple(r) for r in statements.mt940(files.where("file = 'b.sta'")).collect()] == [("b.sta", 1, "R9", "debit", 500, "one two", "20260201")]


def test_delimited_rows_keep_continued_narrations(spark):
    files = spark.createDataFrame([("a.csv", "Date;Ref;Debit;Credit;Text\nintro\n01/02/2026;R1;;1.000;in\nx y\n;;;;more\n\n02/02/2026;R2;(500);;out\n03/02/2026;R3;0;;none\nlost\n")], "file string, content string")
    names = {"date": ["Date"], "ref": ["Ref"], "debit": ["Debit"], "credit": ["Credit"], "narration": ["Text"]}
    rows = [tuple(r) for r in statements.delimited(files, names).select("row_id", "ref_code", "amount", "narration", "value_date").orderBy("row_id").collect()]
    assert rows == [(2, "R1", 1000, "in x y more", "01/02/2026"), (6, "R2", 500, "out", "02/02/2026")]


def test_third_tier_matches_sums_in_both_directions(spark):
    shared_checkpoints(spark)
    lines = spark.createDataFrame([(1, 1, 300), (2, 1, 70), (3, 1, 80), (4, 2, 300), (5, 1, 999)], "line_id long, customer long, amount long")
    inv = spark.createDataFrame([(10, 1, 100), (11, 1, 200), (12, 1, 150), (13, 2, 100), (14, 3, 200)], "invoice_id long, customer long, amount long")
    got = sorted(tuple(r) for r in reconcile.composites(lines, inv).select("line_id", "invoice_id").collect())
    assert got == [(1, 10), (1, 11), (2, 12), (3, 12)]


def test_three_tiers_use_each_side_once(spark):
    lines = {r.line_id: r.amount for r in registry.bank_lines(spark, SF).collect()}
    amount = {r.invoice_id: r.amount for r in registry.invoices(spark, SF).collect()}
    got = [tuple(r) for r in registry.QUERIES["join_three_tiers"](spark, SF).select("line_id", "invoice_id", "tier").collect()]
    single, parts = [r for r in got if r[2] < 3], [r for r in got if r[2] == 3 and None not in r]
    for side in (0, 1):
        ids = [r[side] for r in single]
        assert len(ids) == len(set(ids)) and not set(ids) & {r[side] for r in parts}
    by_line, by_inv = {}, {}
    for a, b, _ in parts:
        by_line.setdefault(a, []).append(b)
        by_inv.setdefault(b, []).append(a)
    for a, b, _ in parts:
        assert lines[a] == sum(amount[x] for x in by_line[a]) or amount[b] == sum(lines[x] for x in by_inv[b])


def test_sinks_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(1, "131", "D", 5), (1, "511", "C", 5)], "entry_id long, account string, side string, amount long")
    assert '"account":"131"' in sinks.vouchers_as_json(lines).first().voucher
    sinks.write_delimited(lines, str(tmp_path / "csv"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "csv")).count() == 2
    sinks.write_statements(lines.withColumnRenamed("account", "bank_code"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("bank_code = '131'").count() == 1


def test_shares_add_up(spark):
    parts = spark.createDataFrame([("g", k, w, 100) for k, w in enumerate([1, 1, 1, 4])], "g string, k long, w long, total long")
    assert sorted(r.share for r in ledger.allocate(parts, "g", "total", "w", "k").collect()) == [14, 14, 15, 57]


def test_streams_run_to_their_end(spark, tmp_path):
    from ledgerloom.streaming import consume

    rows = spark.createDataFrame([("a", "2026-01-01 00:00:00", 0), ("a", "2026-01-01 00:01:00", 2), ("b", "2026-01-02 00:00:00", 2)], "key string, at string, retry_count int")
    rows.select("key", F.to_timestamp("at").alias("ts"), "retry_count").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp, retry_count int").parquet(str(tmp_path / "in"))
    consume.once_each(stream, "key", "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2
    handle = consume.consumer(lambda df: df.withColumn("ok", F.col("key") == "a"), str(tmp_path / "done"), str(tmp_path / "dead"))
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "done")).count() == 2 and spark.read.parquet(str(tmp_path / "dead")).count() == 1


def test_consumer_retries_until_the_last_try(spark, tmp_path):
    from ledgerloom.streaming import consume

    done, dead, retry = (str(tmp_path / x) for x in ("done", "dead", "retry"))
    spark.createDataFrame([("good", 0), ("bad", 0), ("null", 0), ("second", 0)], "key string, retry_count int").write.parquet(str(tmp_path / "in"))
    verdict = F.when(F.col("key") == "null", F.lit(None)).otherwise((F.col("key") == "good") | ((F.col("key") == "second") & (F.col("retry_count") == 1)))
    handle = consume.consumer(lambda df: df.withColumn("ok", verdict.cast("boolean")), done, dead, 3, retry)
    for _ in range(4):
        stream = spark.readStream.schema("key string, retry_count int").parquet(str(tmp_path / "in"))
        consume.with_retries(stream, retry).writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = [sorted((r.key, r.retry_count) for r in spark.read.parquet(t).collect()) for t in (done, dead)]
    assert got == [[("good", 0), ("second", 1)], [("bad", 2), ("null", 2)]]
