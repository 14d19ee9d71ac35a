"""Batches that die between two writes, templates that mislead, dictionaries in parts."""

import random
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from ledgerloom.functions import remarks
from ledgerloom.operators import index
from ledgerloom.plans import storage
from ledgerloom.sources import commits, templates
from ledgerloom.sources.templates import Parser


def test_a_batch_is_visible_as_a_whole(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "b")
    lines = spark.createDataFrame([("f", 1, 5), ("f", 2, 7), ("g", 3, 1)], "file string, line_id long, amount long")
    assert commits.persist_statements(spark, base, 1, lines)
    assert not commits.persist_statements(spark, base, 1, lines.limit(1)) and commits.table(spark, base, "lines").count() == 3
    whole, written = commits.stage, []

    def dies(base, batch, tables):
        name = next(iter(tables))
        whole(base, batch, {name: tables[name]})
        written.append(name)
        raise OSError("lost")

    matches = spark.createDataFrame([(1, 10), (2, 11)], "line_id long, invoice_id long")
    monkeypatch.setattr(commits, "stage", dies)
    try:
        commits.persist_matches(spark, base, 2, matches)
    except OSError:
        pass
    monkeypatch.setattr(commits, "stage", whole)
    assert written == ["matches"] and commits.committed(spark, base) == [1]
    assert {r.status for r in commits.statuses(spark, base).collect()} == {"UNMATCHED"}
    assert commits.persist_matches(spark, base, 2, matches) and commits.committed(spark, base) == [1, 2]
    assert {(r.side, r.id): r.status for r in commits.statuses(spark, base).collect()} == {("line", 1): "MATCHED", ("line", 2): "MATCHED", ("line", 3): "UNMATCHED", ("invoice", 10): "MATCHED", ("invoice", 11): "MATCHED"}
    assert [(r.batch, r.action, r.part, r.rows) for r in commits.table(spark, base, "audit").orderBy("batch", "part").collect()] == [(1, "STATEMENT_IMPORTED", "headers", 2), (1, "STATEMENT_IMPORTED", "lines", 3), (2, "MATCHES_CONFIRMED", "matches", 2)]


def test_index_replaces_documents(spark, tmp_path):
    base = str(tmp_path / "i")
    docs = spark.createDataFrame([(1, "red fox", "a"), (2, "red red dog", "b"), (3, None, "a")], "doc_id long, text string, kind string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<double>")
    index.build(spark, base, 1, docs, vectors, ["kind"])
    asked = spark.createDataFrame([(9, ["red", "red", "cat"])], "query_id long, terms array<string>")
    assert [r.doc_id for r in index.sparse_search(spark, base, asked, 5).orderBy("rank").collect()] == [2, 1]
    assert [r.doc_id for r in index.sparse_search(spark, base, asked, 5, F.col("kind") == "a").collect()] == [1]
    index.build(spark, base, 2, docs.where("doc_id = 2").withColumn("text", F.lit("blue")), vectors.where("doc_id = 2"), ["kind"])
    assert [r.doc_id for r in index.sparse_search(spark, base, asked, 5).collect()] == [1]
    query = spark.createDataFrame([(9, [0.6, 0.8])], "vec_id long, embedding array<double>")
    assert [(r.doc_id, r.score) for r in index.dense_search(spark, base, query, 5).orderBy("rank").collect()] == [(2, 0.8), (1, 0.6)]


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    folders = [Path(str(f)) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for d in folders for f in d.rglob("shuffle_*")}

    before = files()
    rows = spark.range(20_000).groupBy((F.col("id") % 9_973).alias("k")).count()
    made = storage.stored(rows, f"{tmp_path}/t")
    for _ in range(50):  # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(storage.CLEAN_UP) == "false"
    assert made.count() == 9_973


def test_index_keeps_vectors_without_a_document(spark, tmp_path):
    base = str(tmp_path / "v")
    docs = spark.createDataFrame([(1, "red", "a"), (2, "blue", "a")], "doc_id long, text string, kind string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (7, [0.6, 0.8])], "doc_id long, embedding array<double>")
    index.build(spark, base, 1, docs, vectors, ["kind"])
    index.build(spark, base, 2, docs.where("doc_id = 2"), vectors.where("doc_id = 9"), ["kind"])
    query = spark.createDataFrame([(9, [0.6, 0.8])], "vec_id long, embedding array<double>")
    assert [r.doc_id for r in index.dense_search(spark, base, query, 5).orderBy("rank").collect()] == [7, 1]
    asked = spark.createDataFrame([(9, None, [0.6, 0.8])], "query_id long, terms array<string>, embedding array<double>")
    assert [r.doc_id for r in index.hybrid_search(spark, base, asked, 5).orderBy("rank").collect()] == [7, 1]


def test_tables_of_all_documents_do_not_go_through_the_driver(spark, tmp_path, monkeypatch):
    base, plans, stored = str(tmp_path / "d"), [], index.stored
    monkeypatch.setattr(index, "stored", lambda df, path: plans.append(df) or stored(df, path))
    docs = spark.createDataFrame([(1, "red", "a"), (2, "blue", "a")], "doc_id long, text string, kind string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<double>")
    index.build(spark, base, 1, docs, vectors, ["kind"])
    index.build(spark, base, 2, docs.where("doc_id = 2"), vectors.where("doc_id = 2"), ["kind"])
    asked = spark.createDataFrame([(9, ["red", "blue"])], "query_id long, terms array<string>")
    assert [r.doc_id for r in index.sparse_search(spark, base, asked, 5, F.col("kind") == "a").orderBy("rank").collect()] == [1, 2]
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in (index.latest(spark, base, "vectors"), *plans)]
    assert "BroadcastHashJoin" not in plans[0] and "ShuffledHashJoin" in plans[0]
    # one small table only is broadcast: the terms that are asked for
    assert len(plans) == 2 and plans[1].count("BroadcastHashJoin") <= 1 and plans[1].count("ShuffledHashJoin") >= 3


def test_dispatch_goes_on_where_a_parse_does_not_add_up(spark):
    table = spark.createDataFrame([(0, "liar", ["CSV"], [".csv"], [], [("any", "x", 9)]), (1, "true", [], [], [], [("full_text", "zz", 1)]), (2, "none", ["PDF"], [], [], [])], templates.TEMPLATE)

    def parser(amount, closing):
        return Parser(lambda f: f.select("file", F.lit("credit").alias("posting_type"), F.lit(amount).cast("long").alias("amount")), lambda f: f.select("file", F.lit(0).cast("long").alias("opening"), F.lit(closing).cast("long").alias("closing")))

    files = spark.createDataFrame([("a.csv", "x zz"), ("b.bin", "zz"), ("c.csv", "x")], "file string, content string")
    assert {tuple(r) for r in templates.scores(files, table).select("file", "template", "score").collect()} == {("a.csv", "liar", 14), ("a.csv", "true", 1), ("b.bin", "true", 1), ("c.csv", "liar", 14), ("c.csv", "true", 0)}
    rows, verdicts = templates.dispatch(files, table, {"liar": parser(5, 6), "true": parser(7, 7)})
    assert {tuple(r) for r in verdicts.collect()} == {("a.csv", "true", 2), ("b.bin", "true", 1), ("c.csv", "true", 2)}
    assert {(r.file, r.amount, r.template) for r in rows.collect()} == {("a.csv", 7, "true"), ("b.bin", 7, "true"), ("c.csv", 7, "true")}
    _, lost = templates.dispatch(files, table, {"liar": parser(5, 6)})
    assert {(r.file, r.template) for r in lost.collect()} == {(f, None) for f in ("a.csv", "b.bin", "c.csv")}


def test_full_text_rules_see_the_whole_text(spark):
    rules = [("full_text", "zz", 7), ("header_text", "zz", 2)]
    table = spark.createDataFrame([(0, "late", [], [], [], rules)], templates.TEMPLATE)
    files = spark.createDataFrame([("far.csv", "x" * 70_000 + "zz"), ("near.csv", "zz" + "x" * 70_000), ("not.csv", "x" * 70_000)], "file string, content string")
    assert {(r.file, r.score) for r in templates.scores(files, table).collect()} == {("far.csv", 7), ("near.csv", 9), ("not.csv", 0)}


def test_dictionary_hits_equal_all_places(spark, monkeypatch):
    rng = random.Random(10)
    texts = [(k, None if k == 3 else "".join(rng.choice("abß ") for _ in range(rng.randrange(60)))) for k in range(40)]
    patterns = {"".join(rng.choice("abß") for _ in range(rng.randrange(1, 5))) for _ in range(40)}
    rows, known = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([*[(p,) for p in patterns], ("",), (None,)], "pattern string")
    want = {(k, p, s) for k, t in texts for p in patterns for s in range(len(t or "")) if (t or "").startswith(p, s)}
    for signs in (1 << 20, 30):
        monkeypatch.setattr(remarks, "AUTOMATON_SIGNS", signs)
        got = remarks.dictionary_hits(rows, known, "id", "text").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_long_words_are_joined_and_not_passed_over(spark, monkeypatch):
    rng = random.Random(11)
    texts = [(k, None if k == 3 else "".join(rng.choice("aab\u00df\U0001f642" + " " * (k % 2)) for _ in range(rng.choice([0, 9, 60, 700])))) for k in range(30)]
    cut = [t[a : a + n] for _, t in texts[::3] if t for n in (5, 9, 10, 16, 256, 257, 300) for a in (0, len(t) // 2, max(0, len(t) - n))]
    patterns = {*cut, "a" * 9, "aaaaaaaaaa", "zzzzzzzzz", "a\nb" * 4} - {""}
    rows, known = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    want = sorted((k, p, s) for k, t in texts for p in patterns for s in range(len(t or "")) if (t or "").startswith(p, s))
    assert sorted(tuple(r) for r in remarks.dictionary_hits(rows, known, "id", "text").collect()) == want
    # words alone need no automaton, however many they are
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    words = {p for p in patterns if 9 <= len(p) <= 256 and not set(p) & set(" \n")}
    got = remarks.dictionary_hits(rows, spark.createDataFrame([(p,) for p in words], "pattern string"), "id", "text").collect()
    assert sorted(tuple(r) for r in got) == [w for w in want if w[1] in words] and got


def test_entities_by_hand(spark):
    cases = {
        "CK hd 88, HD-2026-77 mst 0312345678-001 call +84912345678 FT123456": (["88", "2026-77"], ["0312345678-001"], ["0312345678", "+84912345678"], ["FT123456"]),
        "CK...TIEN,,MAY--BOM//HD::88": (["88"], [], [], []),
        "": ([], [], [], []),
        "0912345678": ([], ["0912345678"], ["0912345678"], []),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", remarks.entities(F.col("t")).alias("e")).collect()
    assert {r.t: (r.e.invoices, r.e.tax_codes, r.e.phones, r.e.traces) for r in rows} == cases
    said = spark.createDataFrame([("tt tien hang",), ("luong T3",), ("xyz",)], "t string").select("t", remarks.expanded(F.col("t")).alias("x")).select("t", "x", remarks.intent(F.col("x")).alias("i")).collect()
    assert {r.t: (r.x, r.i.intent) for r in said} == {"tt tien hang": ("thanh toán tien hang", "PAYMENT"), "luong T3": ("luong t3", "PAYROLL"), "xyz": ("xyz", "OTHER")}


def test_words_are_counted_without_a_shuffle():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 10]), pa.array([["a", "b", "a"], [], None, ["b"]])], ["doc_id", "t"])
    got = sorted(tuple(r.values()) for b in index.count_terms(iter([rows])) for r in b.to_pylist())
    assert got == [("a", 7, 2), ("b", 7, 1), ("b", 10, 1)]


def test_no_pair_of_query_and_document_is_shuffled(spark, tmp_path, monkeypatch):
    """Three documents of each block come out for each query, however many share its words; the answer is that of all pairs."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("red "), F.repeat(F.lit("blue "), (F.col("id") % 7).cast("int"))).alias("text"), F.lit("a").alias("kind"))
    base = f"file://{tmp_path}/words"
    index.build(spark, base, 1, docs, spark.createDataFrame([], "doc_id long, embedding array<float>"), ["kind"])
    asked = spark.range(5).select(F.col("id").alias("query_id"), F.array(F.lit("red"), F.lit("blue")).alias("terms"))
    monkeypatch.setattr(index, "BLOCK_DOCS", 16, raising=False)
    found = index.sparse_search(spark, base, asked, 3)
    assert "hashpartitioning(query_id, doc_id" not in found._jdf.queryExecution().toString() and "query_id#" in found._jdf.queryExecution().toString()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" not in plan.split("MapInArrow")[0] and "MapInArrow" in plan
    assert {(r.query_id, r["rank"], r.doc_id) for r in found.collect()} == {(q, k + 1, 6 + 7 * k) for q in range(5) for k in range(3)}
