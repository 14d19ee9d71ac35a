"""Queries of summaries, windows, filters, queues, retrieval and graph helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import browse as B
from ledgerloom.operators import metrics as X
from ledgerloom.operators import reconcile as R
from ledgerloom.operators import retrieval as V
from ledgerloom.plans.registry import BANK, BAND, EXACT, INV, JL, MONTHS, TXN, months, query
from ledgerloom.sources.adapters import bank_lines, invoices, journal_lines, table, transactions

TURNS = "turns AS (SELECT tx_id, account, ts, CASE WHEN tx_id % 7 = 0 THEN 'err' WHEN tx_id % 11 = 0 THEN 'skip' ELSE 'ok' END AS outcome, amount AS latency_ms, tx_id % 100 AS prompt_tokens, tx_id % 57 AS completion_tokens FROM txn)"


def turns(spark, d) -> DataFrame:
    k = F.col("tx_id")
    return transactions(spark, d).select(k, "account", "ts", F.when(k % 7 == 0, "err").when(k % 11 == 0, "skip").otherwise("ok").alias("outcome"), F.col("amount").alias("latency_ms"), (k % 100).alias("prompt_tokens"), (k % 57).alias("completion_tokens"))


@query("agg_telemetry", f"{TXN}, {TURNS} SELECT count(*) AS turns, count(*) FILTER (WHERE outcome = 'ok') AS ok, count(*) FILTER (WHERE outcome = 'err') AS err, round(avg(latency_ms), 2) AS avg_latency, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM turns WHERE ts >= 1705000000")
def _(spark, d):
    return X.telemetry(turns(spark, d), 1_705_000_000)


@query(
    "agg_index_percentiles",
    f"{TXN}, {TURNS}, r AS (SELECT outcome, latency_ms, row_number() OVER (PARTITION BY outcome ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY outcome) AS n FROM turns) SELECT outcome, n, max(CASE WHEN i = least(n - 1, n * 50 // 100) THEN latency_ms END) AS p50, max(CASE WHEN i = least(n - 1, n * 95 // 100) THEN latency_ms END) AS p95 FROM r GROUP BY 1, 2",
)
def _(spark, d):
    return X.by_index(turns(spark, d), "outcome", "latency_ms")


STATUS = f"st AS (SELECT line_id, amount, CASE WHEN line_id IN (SELECT line_id FROM ({EXACT})) THEN 'EXACT' WHEN line_id IN (SELECT line_id FROM ({BAND})) THEN 'BAND' ELSE 'NONE' END AS status FROM bank)"


def statuses(spark, d) -> DataFrame:
    lines, inv = bank_lines(spark, d), invoices(spark, d)
    exact = R.exact_edges(lines, inv).select("line_id").distinct().withColumn("e", F.lit(1))
    band = R.band_edges(lines, inv).select("line_id").distinct().withColumn("b", F.lit(1))
    return lines.join(exact, "line_id", "left").join(band, "line_id", "left").select("line_id", "amount", F.when(F.col("e") == 1, "EXACT").when(F.col("b") == 1, "BAND").otherwise("NONE").alias("status"))


@query("agg_match_rates", f"{BANK}, {STATUS}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'NONE') AS matched FROM st) SELECT total, matched, matched * 100 // total AS rate_pct, round(matched / total * 100, 1) AS rate_1dp, matched * 10000 // total AS rate_bps FROM c")
def _(spark, d):
    return X.match_rates(statuses(spark, d), "status")


@query("agg_voucher_status", f"{BANK}, {STATUS} SELECT status, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM st GROUP BY ROLLUP (status)")
def _(spark, d):
    return statuses(spark, d).rollup("status").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query(
    "agg_table_counts",
    "SELECT 'customer' AS table_name, count(*) AS n, CAST(round(sum(c_acctbal) * 100) AS BIGINT) AS total FROM customer UNION ALL SELECT 'supplier', count(*), CAST(round(sum(s_acctbal) * 100) AS BIGINT) FROM supplier UNION ALL SELECT 'documents', count(*), NULL FROM documents UNION ALL SELECT 'events', count(*), NULL FROM events",
)
def _(spark, d):
    return X.table_counts({n: table(spark, d, n) for n in ("customer", "supplier", "documents", "events")}, {"customer": "c_acctbal", "supplier": "s_acctbal"})


@query("agg_margins", f"WITH {MONTHS} SELECT period, CASE WHEN revenue = 0 THEN 0 ELSE CAST(floor((revenue - cogs) * 10000 / revenue + 0.5) AS BIGINT) END AS gross_bps, CASE WHEN revenue = 0 THEN 0 ELSE CAST(floor((revenue - deductions - cogs - expense) * 10000 / revenue + 0.5) AS BIGINT) END AS net_bps FROM months")
def _(spark, d):
    gross, net = F.col("revenue") - F.col("cogs"), F.col("revenue") - F.col("deductions") - F.col("cogs") - F.col("expense")
    return months(spark, d).select("period", X.margin_bps(gross, F.col("revenue")).alias("gross_bps"), X.margin_bps(net, F.col("revenue")).alias("net_bps"))


@query(
    "agg_workbench",
    f"""{BANK}, {STATUS}, m AS (SELECT i.amount - b.amount AS difference, CASE WHEN line_id % 2 = 0 THEN 0 ELSE i.amount - b.amount END AS fee FROM bank b JOIN inv i ON line_id = invoice_id)
    SELECT (SELECT CAST(sum(amount) AS BIGINT) FROM st) AS total_bank, (SELECT CAST(sum(amount) AS BIGINT) FROM inv) AS total_ledger, (SELECT count(*) FROM st WHERE status <> 'NONE') AS matched, (SELECT count(*) FROM st WHERE status = 'NONE') AS unmatched,
    (SELECT round(count(*) FILTER (WHERE status <> 'NONE') / count(*) * 100, 1) FROM st) AS match_rate, (SELECT count(*) FROM m) AS matches, (SELECT count(*) FROM m WHERE difference <> 0 AND fee = 0) AS unexplained, (SELECT sum(amount) FROM st) = (SELECT sum(amount) FROM inv) AS equal""",
)
def _(spark, d):
    inv = invoices(spark, d)
    met = bank_lines(spark, d).join(inv.select("invoice_id", F.col("amount").alias("billed")), F.col("line_id") == F.col("invoice_id"))
    gap = F.col("billed") - F.col("amount")
    matches = met.select(gap.alias("difference"), F.when(F.col("line_id") % 2 == 0, F.lit(0)).otherwise(gap).alias("fee"))
    return X.workbench(statuses(spark, d).select("amount", (F.col("status") != "NONE").alias("matched")), inv, matches)


@query(
    "join_manual_match",
    f"""{BANK}, g AS (SELECT customer AS match_id, min(invoice_id) AS low, max(invoice_id) AS high FROM inv GROUP BY 1), b AS (SELECT match_id, sum(amount) AS net_bank FROM g JOIN bank ON line_id IN (low, high) GROUP BY 1), l AS (SELECT match_id, sum(amount) AS net_ledger FROM g JOIN inv ON invoice_id IN (low, low + 1) GROUP BY 1)
    SELECT match_id, CAST(net_bank AS BIGINT) AS net_bank, CAST(net_ledger AS BIGINT) AS net_ledger, CAST(net_bank - net_ledger AS BIGINT) AS difference FROM b JOIN l USING (match_id)""",
)
def _(spark, d):
    inv = invoices(spark, d)
    groups = inv.groupBy(F.col("customer").alias("match_id")).agg(F.min("invoice_id").alias("low"), F.max("invoice_id").alias("high")).select("match_id", F.array("low", "high").alias("bank_ids"), F.array("low", F.col("low") + 1).alias("ledger_ids"))
    return X.manual_match(groups, bank_lines(spark, d).select(F.col("line_id").alias("id"), "amount"), inv.select(F.col("invoice_id").alias("id"), "amount"))


POOLS = ["s_suppkey AS account", "CASE WHEN s_suppkey % 9 = 4 THEN 'MASTER_POOL' WHEN s_suppkey % 2 = 0 THEN 'COLLECTIONS' ELSE 'PAYROLL' END AS kind", "CAST(round(s_acctbal * 100) AS BIGINT) AS balance", "100000 AS threshold", "s_suppkey * 20000 AS buffer"]


@query("join_cash_sweeps", f"WITH a AS (SELECT {', '.join(POOLS)} FROM supplier) SELECT account AS source, (SELECT min(account) FROM a WHERE kind = 'MASTER_POOL') AS target, balance - buffer AS excess FROM a WHERE kind = 'COLLECTIONS' AND balance > threshold AND balance > buffer")
def _(spark, d):
    return X.sweeps(table(spark, d, "supplier").selectExpr(*POOLS))


PATH = "path AS (SELECT account, ts // 86400 - 19722 AS day, CAST(30000 + sum(sum(CASE WHEN is_credit THEN amount ELSE -amount END)) OVER (PARTITION BY account ORDER BY ts // 86400) AS BIGINT) AS balance FROM txn GROUP BY account, ts // 86400)"


def path(spark, d) -> DataFrame:
    daily = transactions(spark, d).groupBy("account", F.expr("ts DIV 86400 - 19722").alias("day")).agg(F.sum(F.when(F.col("is_credit"), F.col("amount")).otherwise(-F.col("amount"))).alias("net"))
    return daily.select("account", "day", (F.lit(30_000) + F.sum("net").over(Window.partitionBy("account").orderBy("day"))).alias("balance"))


@query("win_lowest_point", f"{TXN}, {PATH} SELECT account, arg_min(day, (balance, day)) AS day, min(balance) AS balance, CAST(coalesce(min(day) FILTER (WHERE balance < 15000), 999) AS INT) AS runway, CASE WHEN coalesce(min(day) FILTER (WHERE balance < 15000), 999) <= 14 THEN 'CRITICAL' WHEN coalesce(min(day) FILTER (WHERE balance < 15000), 999) <= 30 THEN 'WARNING' ELSE 'SAFE' END AS health FROM path GROUP BY account")
def _(spark, d):
    return X.lowest_points(path(spark, d), 15_000)


@query("agg_burn_runway", f"{TXN}, o AS (SELECT account, sum(CASE WHEN NOT is_credit THEN amount ELSE 0 END) AS outflow, sum(amount) AS total FROM txn GROUP BY 1), b AS (SELECT *, CAST(floor(outflow / 30 + 0.5) AS BIGINT) AS burn FROM o) SELECT account, burn, CASE WHEN burn > 0 THEN CAST(floor(total / burn + 0.5) AS BIGINT) ELSE 999 END AS runway FROM b")
def _(spark, d):
    o = transactions(spark, d).groupBy("account").agg(F.sum(F.when(~F.col("is_credit"), F.col("amount")).otherwise(0)).alias("outflow"), F.sum("amount").alias("total"))
    burn, lasts = X.runway(F.col("outflow"), F.col("total"))
    return o.select("account", burn.alias("burn"), lasts.alias("runway"))


STATED = "stated AS (SELECT account AS statement, tx_id AS row_id, CASE WHEN is_credit THEN amount ELSE -amount END AS net, CASE WHEN tx_id % 3 = 0 THEN CAST(1000 + sum(CASE WHEN is_credit THEN amount ELSE -amount END) OVER (PARTITION BY account ORDER BY tx_id) AS BIGINT) + CASE WHEN tx_id % 17 = 0 THEN 7 ELSE 0 END END AS balance FROM txn)"


def stated(spark, d) -> DataFrame:
    net = F.when(F.col("is_credit"), F.col("amount")).otherwise(-F.col("amount"))
    rows = transactions(spark, d).select(F.col("account").alias("statement"), F.col("tx_id").alias("row_id"), net.alias("net"))
    sums = F.sum("net").over(Window.partitionBy("statement").orderBy("row_id"))
    return rows.withColumn("balance", F.when(F.col("row_id") % 3 == 0, 1000 + sums + F.when(F.col("row_id") % 17 == 0, 7).otherwise(0)))


@query(
    "win_first_breaks",
    f"""WITH RECURSIVE {TXN.removeprefix('WITH ')}, {STATED}, n AS (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY row_id) AS r FROM stated),
    walk AS (SELECT statement, CAST(0 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS row_id, CAST(1000 AS BIGINT) AS carried, CAST(NULL AS BIGINT) AS expected, CAST(NULL AS BIGINT) AS actual, false AS broken FROM (SELECT DISTINCT statement FROM stated)
        UNION ALL SELECT n.statement, n.r, n.row_id, CASE WHEN balance > 0 THEN balance ELSE carried + net END, carried + net, balance, balance > 0 AND balance <> carried + net FROM walk JOIN n ON n.statement = walk.statement AND n.r = walk.r + 1 WHERE broken IS NOT TRUE)
    SELECT statement, row_id, expected, actual FROM walk WHERE broken""",
)
def _(spark, d):
    return X.first_breaks(stated(spark, d), 1000)


@query(
    "agg_statement_invariants",
    f"""{TXN}, s AS (SELECT account AS statement, sum(CASE WHEN is_credit THEN amount ELSE 0 END) AS credits, sum(CASE WHEN is_credit THEN 0 ELSE amount END) AS debits, arg_min(5000 + CASE WHEN is_credit THEN 0 ELSE 0 END, tx_id) AS fo, 5000 + sum(CASE WHEN is_credit THEN amount ELSE -amount END) AS lb FROM txn GROUP BY 1),
    h AS (SELECT *, CASE WHEN statement % 4 IN (1, 3) THEN NULL ELSE 5000 END AS o, CASE WHEN statement % 4 = 2 OR statement % 4 = 3 THEN NULL ELSE 5000 + credits - debits + CASE WHEN statement % 8 = 0 THEN 2 WHEN statement % 12 = 0 THEN 9 ELSE 0 END END AS c FROM s)
    SELECT statement, CAST(coalesce(o, CASE WHEN c IS NULL THEN fo ELSE c - credits + debits END) AS BIGINT) AS opening, CAST(coalesce(c, CASE WHEN o IS NULL THEN lb ELSE o + credits - debits END) AS BIGINT) AS closing, CAST(credits AS BIGINT) AS credits, CAST(debits AS BIGINT) AS debits, CAST(c - o - credits + debits AS BIGINT) AS difference,
    CASE WHEN o IS NULL OR c IS NULL THEN 'INFERRED' WHEN c - o = credits - debits THEN 'OK' WHEN abs(c - o - credits + debits) <= 5 THEN 'WITHIN_TOLERANCE' ELSE 'MISMATCH' END AS status FROM h""",
)
def _(spark, d):
    tx = transactions(spark, d)
    net = F.when(F.col("is_credit"), F.col("amount")).otherwise(-F.col("amount"))
    rows = tx.select(F.col("account").alias("statement"), F.col("tx_id").alias("row_id"), F.when(F.col("is_credit"), "credit").otherwise("debit").alias("posting_type"), "amount", net.alias("net"))
    rows = rows.withColumn("balance_after", 5000 + F.sum("net").over(Window.partitionBy("statement").orderBy("row_id")))
    s = F.col("statement")
    ends = rows.groupBy("statement").agg((5000 + F.sum("net")).alias("end"))
    off = F.when(s % 8 == 0, 2).when(s % 12 == 0, 9).otherwise(0)
    heads = ends.select(s, F.when(~(s % 4).isin(1, 3), F.lit(5000).cast("long")).alias("opening"), F.when(~(s % 4).isin(2, 3), F.col("end") + off).alias("closing"))
    return X.statement_checks(heads, rows, tolerance=5)


@query(
    "agg_trial_balance_totals",
    f"""{JL}, t AS (SELECT account, sum(CASE WHEN side = 'D' AND entry_id < 3000 THEN amount ELSE 0 END) AS od, sum(CASE WHEN side = 'C' AND entry_id < 3000 THEN amount ELSE 0 END) AS oc, sum(CASE WHEN side = 'D' AND entry_id >= 3000 THEN amount ELSE 0 END) AS pd, sum(CASE WHEN side = 'C' AND entry_id >= 3000 THEN amount ELSE 0 END) AS pc FROM jl GROUP BY 1)
    SELECT CAST(sum(od) AS BIGINT) AS opening_debit, CAST(sum(oc) AS BIGINT) AS opening_credit, CAST(sum(pd) AS BIGINT) AS period_debit, CAST(sum(pc) AS BIGINT) AS period_credit, CAST(sum(greatest(od + pd - oc - pc, 0)) AS BIGINT) AS closing_debit, CAST(sum(greatest(oc + pc - od - pd, 0)) AS BIGINT) AS closing_credit,
    sum(od) = sum(oc) AS opening_balanced, sum(pd) = sum(pc) AS period_balanced, sum(greatest(od + pd - oc - pc, 0)) = sum(greatest(oc + pc - od - pd, 0)) AS closing_balanced FROM t""",
)
def _(spark, d):
    def part(side: str, early: bool):
        return F.sum(F.when((F.col("side") == side) & ((F.col("entry_id") < 3000) == early), F.col("amount")).otherwise(0))

    t = journal_lines(spark, d).groupBy("account").agg(part("D", True).alias("opening_debit"), part("C", True).alias("opening_credit"), part("D", False).alias("period_debit"), part("C", False).alias("period_credit"))
    end = F.col("opening_debit") + F.col("period_debit") - F.col("opening_credit") - F.col("period_credit")
    zero = F.lit(0).cast("long")
    return X.trial_balance_totals(t.withColumn("closing_debit", F.greatest(end, zero)).withColumn("closing_credit", F.greatest(-end, zero)))


# --- filters and browsing -------------------------------------------------------------------------------------------------------------


@query("flt_optional_conditions", f"{TXN} SELECT tx_id FROM txn WHERE account = 7 AND ts >= 1704500000 AND amount < 15000")
def _(spark, d):
    return B.matching(transactions(spark, d), {"account": 7, "is_credit": None}, {"ts": 1_704_500_000}, {"amount": 15_000, "ts": None}).select("tx_id")


@query("flt_free_text", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (contains(lower(o_orderpriority), 'high') OR contains(lower(CAST(o_orderkey AS VARCHAR)), 'high'))")
def _(spark, d):
    rows = B.matching(table(spark, d, "orders"), {"o_orderstatus": "O"}).withColumn("key_text", F.col("o_orderkey").cast("string"))
    return rows.where(B.found_in("HIGH", ["o_orderpriority", "key_text"])).select("o_orderkey")


RULES = [{"id": "FEE", "priority": 10, "direction": "debit", "patterns": ["error", "view"], "highest": 3000}, {"id": "BIG", "priority": 30, "lowest": 20_000}, {"id": "BANK", "priority": 20, "banks": [1, 2], "direction": "credit"}]


@query("flt_posting_rules", f"{TXN} SELECT tx_id, CASE WHEN amount >= 20000 THEN 'BIG' WHEN account % 5 IN (1, 2) AND is_credit THEN 'BANK' WHEN NOT is_credit AND amount <= 3000 AND (contains(lower(narration), 'error') OR contains(lower(narration), 'view')) THEN 'FEE' ELSE 'DEFAULT' END AS rule FROM txn")
def _(spark, d):
    return B.rule_hits(transactions(spark, d).withColumn("bank", F.col("account") % 5), RULES)


@query("flt_role_permissions", f"{TXN} SELECT tx_id FROM txn WHERE ((account % 3 = 0 AND tx_id % 4 IN (0, 1)) OR (account % 3 = 1 AND tx_id % 4 = 2)) AND account <> tx_id % 16")
def _(spark, d):
    asked = transactions(spark, d).select("tx_id", (F.col("account") % 3).alias("role"), (F.col("tx_id") % 4).alias("tool"), F.col("account").alias("maker"), (F.col("tx_id") % 16).alias("checker"))
    return B.allowed(asked, spark.createDataFrame([(0, 0), (0, 1), (1, 2)], "role long, tool long")).select("tx_id")


@query("top_oldest_batch", f"{TXN} SELECT tx_id, ts FROM txn WHERE NOT is_credit ORDER BY ts, tx_id LIMIT 25")
def _(spark, d):
    return B.oldest_first(transactions(spark, d).where("NOT is_credit").select("tx_id", "ts"), ["ts", "tx_id"], 25)


@query("top_bounded_queues", f"{TXN} SELECT account, tx_id FROM txn QUALIFY row_number() OVER (PARTITION BY account ORDER BY ts DESC, tx_id DESC) <= 20")
def _(spark, d):
    return B.bounded_queues(transactions(spark, d), "account", ["ts", "tx_id"], 20).select("account", "tx_id")


@query("top_browse_latest", f"{TXN} SELECT 'event' AS kind, tx_id AS id FROM (SELECT * FROM txn ORDER BY ts DESC, tx_id DESC LIMIT 100) UNION ALL SELECT 'turn', conv_id * 1000 + turn FROM (SELECT * FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 100)")
def _(spark, d):
    events = transactions(spark, d).orderBy(F.col("ts").desc(), F.col("tx_id").desc()).limit(100).select(F.lit("event").alias("kind"), F.col("tx_id").alias("id"))
    said = table(spark, d, "conversations").orderBy(F.col("conv_id").desc(), F.col("turn").desc()).limit(100)
    return events.union(said.select(F.lit("turn"), F.col("conv_id") * 1000 + F.col("turn")))


@query("win_version_chains", f"WITH RECURSIVE {INV.removeprefix('WITH ')}, v AS (SELECT invoice_id AS version, CASE WHEN invoice_id % 10 = 0 THEN NULL ELSE invoice_id - 1 END AS parent FROM inv), w AS (SELECT version AS item, version, 0 AS place FROM v WHERE version % 3 = 0 UNION ALL SELECT item, parent, place + 1 FROM w JOIN v USING (version) WHERE parent IN (SELECT version FROM v)) SELECT item, version, CAST(place AS BIGINT) AS place FROM w")
def _(spark, d):
    k = F.col("invoice_id")
    versions = invoices(spark, d).select(k.alias("version"), F.when(k % 10 != 0, k - 1).alias("parent"))
    heads = versions.where("version % 3 = 0").select(F.col("version").alias("item"), F.col("version").alias("current"))
    return B.version_chains(heads, versions, 16)


@query("sweep_due", f"{TXN}, i AS (SELECT account, max(ts) AS last_ts FROM txn GROUP BY 1 HAVING max(ts) < 1706500000) SELECT account AS key, last_ts, (SELECT count(*) FROM i) > 5 AS has_more FROM i ORDER BY last_ts, account LIMIT 5")
def _(spark, d):
    first, more = B.due_for_sweep(transactions(spark, d).select(F.col("account").alias("key"), "ts"), 1_706_500_000, 5)
    return first.crossJoin(more)


@query("sink_cascading_delete", "SELECT 'PURGE' AS action, 'orders' AS table_name, count(*) AS deleted FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'PURGE', 'customer', count(*) FROM customer WHERE c_nationkey = 3")
def _(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "key")
    _, audit = B.deletion({"orders": table(spark, d, "orders").withColumnRenamed("o_custkey", "key"), "customer": c}, "key", c.where("c_nationkey = 3"), "PURGE")
    return audit


@query(
    "join_resolve_contacts",
    """WITH c AS (SELECT p_partkey AS contact, p_name AS key FROM part), a AS (SELECT p_partkey AS ask, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) || ' ' || p_brand ELSE split_part(p_name, ' ', 2) END AS key FROM part WHERE p_partkey < 60),
    e AS (SELECT ask, count(*) AS n, min(contact) AS contact FROM a JOIN c USING (key) GROUP BY 1), p AS (SELECT ask, count(*) AS n, min(contact) AS contact FROM a JOIN c ON contains(' ' || c.key || ' ', ' ' || a.key || ' ') GROUP BY 1)
    SELECT ask, CASE WHEN coalesce(e.n, p.n) IS NULL THEN 'NOT_FOUND' WHEN coalesce(e.n, p.n) = 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS status, CASE WHEN coalesce(e.n, p.n) = 1 THEN coalesce(e.contact, p.contact) END AS contact FROM a LEFT JOIN e USING (ask) LEFT JOIN p USING (ask)""",
)
def _(spark, d):
    parts = table(spark, d, "part")
    k = F.col("p_partkey")
    asked = parts.where("p_partkey < 60").select(k.alias("ask"), F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" "), "p_brand")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("key"))
    return B.resolve_contacts(asked, parts.select(k.alias("contact"), F.col("p_name").alias("key")))


# --- retrieval and graph ----------------------------------------------------------------------------------------------------------------

TERMS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


@query("ret_prefix_search", f"SELECT doc_id FROM documents WHERE len(list_filter({TERMS}, lambda t: starts_with(t, 'the'))) > 0 AND len(list_filter({TERMS}, lambda t: starts_with(t, 'an'))) > 0")
def _(spark, d):
    return V.prefix_hits(table(spark, d, "documents"), "The an")


@query(
    "ret_two_stage_rank",
    """WITH s AS (SELECT p_partkey AS id, p_size % 10 AS score, p_partkey * 7919 % 1009 / 1009.0 AS r1, p_partkey % 5 / 4.0 AS penalty FROM part), f AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 30),
    r AS (SELECT id, row_number() OVER (ORDER BY r1 DESC, score DESC, id) - 1 AS rank, penalty FROM f), m AS (SELECT id, rank + 3 * penalty AS mixed, rank FROM r) SELECT id, row_number() OVER (ORDER BY mixed, rank) AS place FROM m QUALIFY place <= 10""",
)
def _(spark, d):
    k = F.col("p_partkey")
    scored = table(spark, d, "part").select(k.alias("id"), (F.col("p_size") % 10).alias("score"))
    return V.two_stage(scored, "id", F.col("id") * 7919 % 1009 / 1009.0, F.col("id") % 5 / 4.0, 10)


@query("ret_reinforced", f"{TXN}, a AS (SELECT account * 10 AS c, count(*) AS n, max(ts) AS t FROM txn GROUP BY 1) SELECT c_custkey, CAST(c_custkey % 3 + coalesce(n, 0) AS BIGINT) AS access_count, greatest(1700000000, coalesce(t, 0)) AS last_ts FROM customer LEFT JOIN a ON c = c_custkey")
def _(spark, d):
    memories = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("access_count"), F.lit(1_700_000_000).cast("long").alias("last_ts"))
    return V.reinforced(memories, transactions(spark, d).select((F.col("account") * 10).alias("c_custkey"), "ts"), "c_custkey")


LINKS = "links AS (SELECT account AS source, tx_id % 13 AS target, CASE WHEN is_credit THEN 'pays' ELSE 'asks' END AS relation, CAST(amount AS DOUBLE) AS weight, tx_id AS ts FROM txn)"


def links(spark, d) -> DataFrame:
    return transactions(spark, d).select(F.col("account").alias("source"), (F.col("tx_id") % 13).alias("target"), F.when(F.col("is_credit"), "pays").otherwise("asks").alias("relation"), F.col("amount").cast("double").alias("weight"), F.col("tx_id").alias("ts"))


@query("graph_edge_upsert", f"{TXN}, {LINKS}, n AS (SELECT * FROM links WHERE ts % 4 = 0 UNION ALL SELECT target, source, relation, weight, ts FROM links WHERE ts % 4 = 0 UNION ALL SELECT * FROM links WHERE ts % 4 <> 0) SELECT source, target, relation, arg_max(weight, (ts, weight)) AS weight, max(ts) AS ts FROM n GROUP BY 1, 2, 3")
def _(spark, d):
    all_ = links(spark, d)
    return V.edge_upsert(all_.where("ts % 4 <> 0"), all_.where("ts % 4 = 0"))


@query("graph_transition_shares", f"{TXN}, {LINKS}, w AS (SELECT source, target, sum(CASE WHEN source % 6 = 0 THEN -weight ELSE weight - 2000 END) AS weight FROM links GROUP BY 1, 2), s AS (SELECT *, greatest(weight, 0) AS p, sum(greatest(weight, 0)) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS n FROM w) SELECT source, target, round(CASE WHEN total > 0 THEN p / total ELSE 1.0 / n END, 9) AS share FROM s")
def _(spark, d):
    weighed = links(spark, d).groupBy("source", "target").agg(F.sum(F.when(F.col("source") % 6 == 0, -F.col("weight")).otherwise(F.col("weight") - 2000)).alias("weight"))
    return V.transition_shares(weighed).withColumn("share", F.round("share", 9))


@query("graph_live_edges", f"{TXN}, {LINKS} SELECT source, target, weight FROM links WHERE ts % 5 <> 0 UNION ALL SELECT target, source, weight FROM links WHERE ts % 5 <> 0")
def _(spark, d):
    return V.live_edges(links(spark, d).withColumn("obsolete", F.when(F.col("ts") % 5 == 0, 1).otherwise(0)))


@query("num_recall_update", f"{TXN} SELECT tx_id, CASE WHEN is_credit THEN least((tx_id % 10 + 1) * 1.5, 10.0) ELSE greatest((tx_id % 10 + 1) * 0.8, 1.0) END::DOUBLE AS strength, 1706600000 - ts >= 86400 * (tx_id % 10 + 1) AS due FROM txn")
def _(spark, d):
    held = (F.col("tx_id") % 10 + 1).cast("double")
    return transactions(spark, d).select("tx_id", V.recall_update(held, F.col("is_credit")).alias("strength"), V.due(F.lit(1_706_600_000), F.col("ts"), held, 86_400).alias("due"))


@query(
    "num_penalties",
    f"""{TXN}, s AS (SELECT account, CASE tx_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'timeout' ELSE 'note' END AS kind, CASE tx_id % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'refuted' END AS evidence, CASE WHEN tx_id % 7 <> 0 THEN tx_id % 6 END AS mk FROM txn),
    t AS (SELECT account, kind, evidence, count(DISTINCT mk) + sum(CASE WHEN mk IS NULL THEN 1 ELSE 0 END) AS n FROM s GROUP BY ALL), w AS (SELECT account, sum(CASE kind WHEN 'error' THEN 1.0 WHEN 'timeout' THEN 0.5 ELSE 0 END * CASE WHEN evidence = 'confirmed' THEN 1.0 WHEN evidence = 'refuted' THEN 0 ELSE 0.5 END * n) AS t FROM t GROUP BY 1)
    SELECT account, CAST(round(CASE WHEN t > 0 THEN t / (t + 2) ELSE 0 END, 9) AS DOUBLE) AS penalty FROM w""",
)
def _(spark, d):
    k = F.col("tx_id")
    signals = transactions(spark, d).select("account", F.when(k % 3 == 0, "error").when(k % 3 == 1, "timeout").otherwise("note").alias("kind"), F.when(k % 5 == 0, "confirmed").when(k % 5 == 1, "refuted").alias("evidence"), F.when(k % 7 != 0, k % 6).alias("merge_key"))
    return V.penalties(signals, {"error": 1.0, "timeout": 0.5}, "account")


@query("num_tokens_per_second", f"{TXN}, {TURNS} SELECT tx_id, CASE WHEN latency_ms > 0 THEN round(completion_tokens * 1000 / latency_ms, 6) ELSE 0 END AS tps FROM turns")
def _(spark, d):
    return turns(spark, d).select("tx_id", V.tokens_per_second(F.col("completion_tokens"), F.col("latency_ms")).alias("tps"))


@query(
    "arr_mean_pool",
    """WITH g AS (SELECT label, vec_id % 3 AS part, list(embedding ORDER BY vec_id) AS vs, list(CASE WHEN vec_id % 4 = 0 THEN 0 ELSE 1 END ORDER BY vec_id) AS mk FROM embeddings GROUP BY 1, 2),
    e AS (SELECT label, vec_id % 3 AS part, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) WHERE vec_id % 4 <> 0 GROUP BY ALL), n AS (SELECT label, part, sqrt(sum(x * x)) AS norm FROM e GROUP BY ALL)
    SELECT label, part, round(max(CASE WHEN i = 1 THEN x END) / any_value(norm), 6) AS first_value, round(max(CASE WHEN i = 64 THEN x END) / any_value(norm), 6) AS last_value FROM e JOIN n USING (label, part) GROUP BY ALL""",
)
def _(spark, d):
    held = table(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 3).alias("part")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("r"))
    pooled = V.mean_pooled(F.col("r.embedding"), F.transform("r", lambda x: F.when(x["vec_id"] % 4 == 0, 0).otherwise(1)))
    return held.withColumn("v", pooled).where(F.exists("v", lambda x: x != 0)).select("label", "part", F.round(F.get("v", F.lit(0)), 6).alias("first_value"), F.round(F.get("v", F.lit(63)), 6).alias("last_value"))


@query(
    "arr_centroid_margins",
    """WITH c AS (SELECT (SELECT embedding FROM embeddings WHERE vec_id = 0) AS one, (SELECT embedding FROM embeddings WHERE vec_id = 1) AS two), s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], one::DOUBLE[]) AS a, list_dot_product(embedding::DOUBLE[], two::DOUBLE[]) AS b FROM embeddings, c)
    SELECT vec_id, round(a, 6) AS to_one, round(b, 6) AS to_two, CASE WHEN abs(a - b) < 0.05 THEN 'UNSURE' WHEN a > b THEN 'ONE' ELSE 'TWO' END AS class FROM s""",
)
def _(spark, d):
    e = table(spark, d, "embeddings")
    one, two = (e.where(f"vec_id = {k}").select(F.col("embedding").alias(n)) for k, n in ((0, "one"), (1, "two")))
    a, b, kind = V.margins(F.col("embedding"), F.col("one"), F.col("two"), 0.05)
    return e.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(two)).select("vec_id", F.round(a, 6).alias("to_one"), F.round(b, 6).alias("to_two"), kind.alias("class"))


