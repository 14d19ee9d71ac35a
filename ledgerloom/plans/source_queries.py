"""Queries of tables with unknown headers, strict amounts, chart checks, cash-flow sections and searches of many queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import money as M
from ledgerloom.operators import ledger as L
from ledgerloom.operators import retrieval as V
from ledgerloom.plans.registry import ASKED, BANK, BM25, JL, query
from ledgerloom.sources import sinks
from ledgerloom.sources import statements as P
from ledgerloom.sources.adapters import bank_lines, journal_lines, table

SHEET = "Sổ phụ ngân hàng|x\nNgày GD|Số tiền|Nội dung|Số dư\n"


def sheets(spark, d):
    """A file for each customer: one signed amount, dates only where they change, balances only on some lines."""
    k = F.col("line_id")
    row = F.concat_ws("|", F.when(k % 3 == 0, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).otherwise(""), F.concat(F.when(k % 2 == 0, "-").otherwise(""), F.col("amount").cast("string")), F.lit("said"), F.when(k % 5 == 0, "777").otherwise(""))
    lines = bank_lines(spark, d).where("amount > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", row.alias("r")))), lambda x: x["r"]), "\n")
    return lines.groupBy(F.col("customer").alias("k")).agg(F.concat(F.lit(SHEET), body).alias("content")).select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("file"), "content")


@query(
    "io_table_rows",
    f"""{BANK}, r AS (SELECT 'f' || customer AS file, row_number() OVER (PARTITION BY customer ORDER BY line_id) + 1 AS line_no, CASE WHEN line_id % 3 = 0 THEN '2024-01-' || lpad(CAST(line_id % 28 + 1 AS VARCHAR), 2, '0') END AS date, CASE WHEN line_id % 2 = 0 THEN amount ELSE 0 END AS debit, CASE WHEN line_id % 2 = 0 THEN 0 ELSE amount END AS credit, CASE WHEN line_id % 5 = 0 THEN 777 END AS said FROM bank WHERE amount > 0)
    SELECT file, CAST(line_no AS INT) AS line_no, last_value(date IGNORE NULLS) OVER w AS date, debit, credit, CAST(coalesce(said, sum(credit - debit) OVER w) AS BIGINT) AS balance FROM r WINDOW w AS (PARTITION BY file ORDER BY line_no)""",
)
def _(spark, d):
    return P.table_rows(sheets(spark, d)).drop("narration")


@query("io_best_header", f"{BANK} SELECT DISTINCT 'f' || customer AS file, CAST(1 AS INT) AS line_no, CAST(85 AS INT) AS score, 'date,amount,narration,balance' AS roles FROM bank WHERE amount > 0")
def _(spark, d):
    return P.best_header(sheets(spark, d)).withColumn("roles", F.array_join("roles", ","))


STRICT = ["15.000.000 VND", "(50.000)", "-1,234.56", "01/02/2024", "1-2", "abc 5", "12%", "", "7,5", "380.000 đồng"]


@query("num_parse_strict", f"SELECT s_suppkey AS id, [15000000, 50000, 1234, NULL, NULL, NULL, NULL, NULL, 7, 380000][s_suppkey % 10 + 1]::BIGINT AS amount, [15000000, -50000, -1234, NULL, NULL, NULL, NULL, NULL, 7, 380000][s_suppkey % 10 + 1]::BIGINT AS signed_amount FROM supplier")
def _(spark, d):
    text = F.element_at(F.array(*[F.lit(x) for x in STRICT]), (F.col("s_suppkey") % 10 + 1).cast("int"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), M.parse_strict(text).alias("amount"), M.parse_strict(text, True).alias("signed_amount"))


TREE = ["CASE WHEN s_suppkey % 11 = 10 THEN 9 ELSE s_suppkey END AS code", "CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 4 THEN s_suppkey + 100000 WHEN 3 THEN s_suppkey - 1 WHEN 2 THEN s_suppkey + 1 ELSE s_suppkey - 1 END AS parent", "CASE WHEN s_suppkey % 7 = 1 THEN 'A' ELSE 'B' END AS kind"]


@query(
    "agg_chart_faults",
    f"""WITH RECURSIVE t AS (SELECT {', '.join(TREE)} FROM supplier), one AS (SELECT code, min(parent) AS parent FROM (SELECT DISTINCT code, parent FROM t WHERE parent IN (SELECT code FROM t)) GROUP BY 1),
    walk AS (SELECT code, parent, 1 AS n FROM one UNION ALL SELECT walk.code, one.parent, n + 1 FROM walk JOIN one ON walk.parent = one.code WHERE n < (SELECT count(*) + 2 FROM one))
    SELECT code, 'DUPLICATE' AS fault FROM t GROUP BY code HAVING count(*) > 1 UNION ALL SELECT code, 'MISSING_PARENT' FROM t WHERE parent IS NOT NULL AND parent NOT IN (SELECT code FROM t)
    UNION ALL SELECT t.code, 'OTHER_KIND' FROM t JOIN (SELECT code, min(kind) AS kind FROM t GROUP BY 1) p ON t.parent = p.code WHERE p.kind <> t.kind UNION ALL SELECT DISTINCT code, 'CYCLE' FROM walk WHERE n > (SELECT count(*) FROM one)""",
)
def _(spark, d):
    return L.chart_faults(table(spark, d, "supplier").selectExpr(*TREE))


@query(
    "agg_cash_flow_sections",
    f"""{JL}, f AS (SELECT entry_id % 12 AS period, CASE account WHEN '131' THEN 'operating' WHEN '511' THEN 'investing' ELSE 'financing' END AS section, CASE WHEN side = 'D' THEN amount ELSE 0 END AS inflow, CASE WHEN side = 'C' THEN amount ELSE 0 END AS outflow FROM jl),
    s AS (SELECT period, CAST(sum(CASE WHEN section = 'operating' THEN inflow - outflow ELSE 0 END) AS BIGINT) AS operating, CAST(sum(CASE WHEN section = 'investing' THEN inflow - outflow ELSE 0 END) AS BIGINT) AS investing, CAST(sum(CASE WHEN section = 'financing' THEN inflow - outflow ELSE 0 END) AS BIGINT) AS financing FROM f GROUP BY 1)
    SELECT *, operating + investing + financing AS net, CAST(500 + sum(operating + investing + financing) OVER (ORDER BY period) AS BIGINT) AS closing FROM s""",
)
def _(spark, d):
    side = F.col("side")
    section = F.when(F.col("account") == "131", "operating").when(F.col("account") == "511", "investing").otherwise("financing")
    flows = journal_lines(spark, d).select((F.col("entry_id") % 12).alias("period"), section.alias("section"), F.when(side == "D", F.col("amount")).otherwise(0).alias("inflow"), F.when(side == "C", F.col("amount")).otherwise(0).alias("outflow"))
    return L.cash_flow_sections(flows, 500)


@query(
    "ret_knn_each",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN label % 2 = 0 THEN 0.5 ELSE 1.0 END AS w, label FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, round(greatest(0, list_dot_product(q.e, c.e)) * c.w, 6) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND c.label <> 9)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
)
def _(spark, d):
    """The ten nearest of every hundredth vector among all that a filter leaves, weighed by a decay."""
    v = table(spark, d, "embeddings").withColumn("weight", F.when(F.col("label") % 2 == 0, 0.5).otherwise(1.0))
    return V.nearest_to_each(v.where("label <> 9").select("vec_id", "embedding", "weight"), v.where("vec_id % 100 = 0").select("vec_id", "embedding"), 10)


@query(
    "ret_merged_ranks",
    f"""WITH {BM25}, a AS (SELECT doc_id, 'sparse' AS origin, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 30), b AS (SELECT vec_id AS doc_id, 'dense' AS origin, row_number() OVER (ORDER BY round(CAST(embedding[1] AS DOUBLE), 6) DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 30),
    u AS (SELECT doc_id, origin, 0.7::DOUBLE / (60 + rank) AS p FROM b UNION ALL SELECT doc_id, origin, 0.3::DOUBLE / (60 + rank) FROM a) SELECT doc_id, min(origin) AS origin, round(sum(p), 9) AS score FROM u GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10""",
)
def _(spark, d):
    sparse = V.ranked(V.bm25(table(spark, d, "documents"), ASKED), "doc_id", 30).withColumn("origin", F.lit("sparse"))
    dense = V.ranked(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("score")), "doc_id", 30).withColumn("origin", F.lit("dense"))
    return V.merged_ranks(dense, sparse, "doc_id", (0.7, 0.3), 10, ["origin"])


@query("sink_voucher_json", f"""{JL} SELECT entry_id, '{{"lines":[' || string_agg('{{"account":"' || account || '","side":"' || side || '","amount":' || amount || '}}', ',' ORDER BY account) || ']}}' AS voucher FROM jl GROUP BY 1""")
def _(spark, d):
    return sinks.vouchers_as_json(journal_lines(spark, d))


@query("io_synthetic_lines", "SELECT 'all' AS load, 50000 AS n, true AS mix_holds")
def _(spark, d):
    """A load of 50000 lines and whether its kinds come as often as stated, give or take a tenth of a per cent."""
    made = P.synthetic_lines(spark, 50_000).groupBy("kind").count()
    want = spark.createDataFrame([("EXACT", 45_000), ("FUZZY", 3_750), ("SPLIT", 1_150), ("UNRESOLVED", 100)], "kind string, want long")
    met = want.join(made, "kind").agg(F.sum("count").cast("int").alias("n"), F.max(F.abs(F.col("count") - F.col("want"))).alias("off"), F.count("*").alias("k"))
    return met.select(F.lit("all").alias("load"), "n", ((F.col("off") < 500) & (F.col("k") == 4)).alias("mix_holds"))
