"""Every registered query of the library's own operators, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import ledger as L
from ledgerloom.operators import reconcile as R
from ledgerloom.operators import records as C
from ledgerloom.operators import retrieval as V
from ledgerloom.operators import surveillance as S
from ledgerloom.plans.session import shared_checkpoints, ship_package
from ledgerloom.sources import statements as P
from ledgerloom.sources.adapters import bank_lines, invoices, journal_lines, table, transactions, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TXN, INV, BANK, JL = (with_views(*v) for v in (("txn",), ("inv",), ("inv", "bank"), ("jl",)))


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- surveillance ---------------------------------------------------------------------------------------------------

HIGH = "SELECT tx_id, account, 'HIGH_VALUE' AS rule, 1 AS ordinal FROM txn WHERE amount >= 20000"
STRUCT = """SELECT * FROM (SELECT *, count(*) OVER w AS n, sum(amount) OVER w AS total, min((ts, tx_id)) OVER w AS opened FROM txn WHERE amount >= 2000 AND amount < 20000
    WINDOW w AS (PARTITION BY account ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)) WHERE n >= 3 AND total >= 20000"""
HOUR = "(((ts + 25200) % 86400 + 86400) % 86400) // 3600"
NIGHT = f"""SELECT account, count(*) AS n, sum(amount) AS total, arg_min(tx_id, (ts, tx_id)) AS tx_id FROM txn WHERE {HOUR} >= 23 OR {HOUR} < 5
    GROUP BY account HAVING count(*) >= 3 OR sum(amount) >= 20000"""
MULE = """SELECT i.account, i.tx_id AS in_id, i.amount AS in_amount, arg_min(o.tx_id, (o.ts, o.tx_id)) AS out_id FROM txn i JOIN txn o ON i.account = o.account AND i.is_credit AND NOT o.is_credit
    AND i.amount >= 2000 AND o.ts BETWEEN i.ts AND i.ts + 3600 AND o.amount * 10000 >= i.amount * 9500 GROUP BY 1, 2, 3"""
BURST = """SELECT tx_id, account FROM (SELECT *, ts - lag(ts) OVER w AS back, lead(ts) OVER w - ts AS ahead FROM txn WINDOW w AS (PARTITION BY account ORDER BY ts, tx_id)) WHERE back < 60 OR ahead < 60"""
SURGE = """SELECT tx_id, account, most FROM (SELECT *, max(n) OVER (PARTITION BY account ORDER BY ts RANGE BETWEEN CURRENT ROW AND 3600 FOLLOWING) AS most FROM
    (SELECT *, count(*) OVER (PARTITION BY account ORDER BY ts RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM txn)) WHERE most >= 3"""
MEDIAN = """med AS (SELECT CAST(sum(amount) // count(*) AS BIGINT) AS median FROM (SELECT amount, row_number() OVER (ORDER BY amount) AS r, count(*) OVER () AS n FROM txn) WHERE r IN ((n + 1) // 2, n // 2 + 1)),
    mads AS (SELECT median, CAST(sum(dev) // count(*) AS BIGINT) AS mad FROM (SELECT median, abs(amount - median) AS dev, row_number() OVER (ORDER BY abs(amount - median)) AS r, count(*) OVER () AS n FROM txn, med) WHERE r IN ((n + 1) // 2, n // 2 + 1) GROUP BY median)"""
OUTLIER = "SELECT tx_id, account, CAST(6745 * abs(amount - median) // greatest(1, mad) AS BIGINT) AS z_bps FROM txn, mads WHERE 6745 * abs(amount - median) // greatest(1, mad) > 35000"


@query("aml_high_value", f"{TXN} {HIGH}")
def _(spark, d):
    return S.high_value(transactions(spark, d))


@query("win_structuring", f"{TXN} SELECT tx_id, account, n, CAST(total AS BIGINT) AS total FROM ({STRUCT})")
def _(spark, d):
    return S.structuring(transactions(spark, d)).select("tx_id", "account", "n", "total")


@query("agg_night_activity", f"{TXN} SELECT account, n, CAST(total AS BIGINT) AS total, tx_id FROM ({NIGHT})")
def _(spark, d):
    return S.night_activity(transactions(spark, d))


@query("join_transit_mule", f"{TXN} {MULE}")
def _(spark, d):
    return S.mule_pairs(transactions(spark, d))


@query("win_bursts", f"{TXN} {BURST}")
def _(spark, d):
    return S.bursts(transactions(spark, d))


@query("win_velocity_surge", f"{TXN} {SURGE}")
def _(spark, d):
    return S.surges(transactions(spark, d))


@query(
    "win_forward_72h",
    f"""{TXN}, opened AS (SELECT *, CAST(count(*) OVER w >= 3 AND sum(amount) OVER w >= 40000 AS INT) AS hit FROM txn
    WINDOW w AS (PARTITION BY account ORDER BY ts RANGE BETWEEN CURRENT ROW AND 259200 FOLLOWING))
    SELECT tx_id, account FROM (SELECT *, max(hit) OVER (PARTITION BY account ORDER BY ts RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW) AS member FROM opened) WHERE member = 1""",
)
def _(spark, d):
    return S.forward_window(transactions(spark, d))


@query("agg_median_mad", f"{TXN}, {MEDIAN} SELECT median, mad FROM mads")
def _(spark, d):
    return S.median_and_mad(transactions(spark, d)).select("median", "mad")


@query("aml_outliers", f"{TXN}, {MEDIAN} {OUTLIER}")
def _(spark, d):
    return S.outliers(transactions(spark, d))


@query("agg_daily_structuring", f"{TXN} SELECT ts // 86400 AS day, account, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM txn WHERE amount >= 2000 AND amount < 20000 GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(amount) >= 20000")
def _(spark, d):
    return S.daily_structuring(transactions(spark, d))


@query("join_keyword_hits", f"{TXN} SELECT tx_id, keyword FROM (SELECT tx_id, CASE WHEN contains(lower(narration), 'error') THEN 'error' WHEN contains(lower(narration), 'signup') THEN 'signup' END AS keyword FROM txn) WHERE keyword IS NOT NULL")
def _(spark, d):
    return S.keyword_hits(transactions(spark, d), ["error", "signup"])


@query(
    "agg_volume_surge",
    f"{TXN}, v AS (SELECT account, ts // 86400 AS day, CAST(sum(amount) AS BIGINT) AS total FROM txn GROUP BY 1, 2), w AS (SELECT *, sum(total) OVER (PARTITION BY account) AS all_days, count(*) OVER (PARTITION BY account) AS n FROM v), b AS (SELECT account, day, total, CAST((all_days - total) // (n - 1) AS BIGINT) AS baseline FROM w WHERE n > 1) SELECT * FROM b WHERE total > 3 * baseline",
)
def _(spark, d):
    return S.volume_surges(transactions(spark, d))


@query(
    "agg_daily_structuring_members",
    f"{TXN}, i AS (SELECT ts // 86400 AS day, account, tx_id, amount FROM txn WHERE amount >= 2000 AND amount < 20000) SELECT day, account, tx_id FROM i QUALIFY count(*) OVER (PARTITION BY day, account) >= 3 AND sum(amount) OVER (PARTITION BY day, account) >= 20000",
)
def _(spark, d):
    return S.daily_members(transactions(spark, d))


# --- reconciliation ---------------------------------------------------------------------------------------------------

KEY = "regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '^(HD|INV)0+', '\\1')"
EXACT = f"SELECT line_id, invoice_id FROM bank b JOIN inv i ON b.ref <> '' AND {KEY.format('b.ref')} = {KEY.format('i.doc_ref')} AND b.amount = i.amount AND abs(b.ts - i.ts) <= 86400"
BAND = """SELECT line_id, invoice_id, i.amount - b.amount AS fee, abs(b.ts - i.ts) AS lag FROM bank b JOIN inv i ON b.customer = i.customer
    AND (i.amount = b.amount OR i.amount - b.amount BETWEEN 1100 AND 11000) AND abs(b.ts - i.ts) <= 259200"""


@query("join_exact_edges", f"{BANK} {EXACT}")
def _(spark, d):
    return R.exact_edges(bank_lines(spark, d), invoices(spark, d))


@query("join_band_edges", f"{BANK} {BAND}")
def _(spark, d):
    return R.band_edges(bank_lines(spark, d), invoices(spark, d))


@query("join_residual_lines", f"{BANK}, e AS ({EXACT}) SELECT line_id, amount FROM bank WHERE line_id NOT IN (SELECT line_id FROM e)")
def _(spark, d):
    lines = bank_lines(spark, d)
    return R.residual(lines, R.exact_edges(lines, invoices(spark, d)), "line_id").select("line_id", "amount")


@query("join_nearest_amount", f"{BANK} SELECT line_id, arg_min(invoice_id, (abs(b.amount - i.amount), invoice_id)) AS invoice_id, min(abs(b.amount - i.amount)) AS distance FROM bank b JOIN inv i USING (customer) GROUP BY line_id")
def _(spark, d):
    return R.nearest(bank_lines(spark, d), invoices(spark, d))


def cited_bank_lines(spark, d):
    """Bank lines of which every second one without a reference of its own cites its invoice in the narration."""
    narration = F.when((F.col("ref") == "") & (F.col("line_id") % 2 == 0), F.concat(F.lit("TT TIEN HANG HD "), F.lpad(F.col("line_id").cast("string"), 8, "0"), F.lit(" CK"))).otherwise("ck")
    return bank_lines(spark, d).select("*", narration.alias("narration"), F.lit("CREDIT").alias("direction"))


@query("join_three_tiers")
def _(spark, d):
    """Lines matched one to one by tier 1 and then by tier 2, and the rest by sums in tier 3, a row for each part; checked against the serial walk in the tests."""
    shared_checkpoints(spark)
    return R.three_tiers(cited_bank_lines(spark, d), invoices(spark, d))


MERGED = "merged AS (SELECT customer * 1000000 + 1 AS line_id, customer, CAST(sum(amount) AS BIGINT) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY invoice_id) AS r FROM inv) WHERE r <= 2 GROUP BY customer HAVING count(*) = 2)"


def merged_lines(spark, d):
    first = F.row_number().over(Window.partitionBy("customer").orderBy("invoice_id"))
    two = invoices(spark, d).withColumn("r", first).where("r <= 2").groupBy("customer").agg(F.sum("amount").alias("amount"), F.count("*").alias("n")).where("n = 2")
    return two.select((F.col("customer") * 1_000_000 + 1).alias("line_id"), "customer", "amount")


@query(
    "join_pair_splits",
    f"""{INV}, {MERGED} SELECT line_id, (m).a AS first_id, (m).b AS second_id FROM (SELECT line_id, min({{'a': x.invoice_id, 'b': y.invoice_id}}) AS m FROM merged
    JOIN inv x USING (customer) JOIN inv y ON y.customer = x.customer AND x.invoice_id < y.invoice_id AND x.amount + y.amount = merged.amount GROUP BY line_id)""",
)
def _(spark, d):
    return R.pair_splits(merged_lines(spark, d), invoices(spark, d))


@query("udf_subset_sum_splits")
def _(spark, d):
    shared_checkpoints(spark)
    return R.splits(merged_lines(spark, d), invoices(spark, d))


def wide_lines(spark, d):
    """Lines that are the sum of the first three to eight invoices of their customer, by the customer's number; a third of all invoices belong to one customer."""
    hot = invoices(spark, d).withColumn("customer", F.when(F.col("invoice_id") % 3 == 0, 0).otherwise(F.col("customer") + 1))
    first = F.row_number().over(Window.partitionBy("customer").orderBy("invoice_id"))
    some = hot.where("customer > 0").withColumn("r", first).where("r <= 3 + customer % 6").groupBy("customer").agg(F.sum("amount").alias("amount"))
    many = hot.where("customer = 0").groupBy(F.expr("invoice_id DIV 3000").alias("k")).agg(F.sum(F.when(F.col("invoice_id") % 3000 < 15, F.col("amount"))).alias("amount"))
    lines = some.select((F.col("customer") * 1_000_000 + 1).alias("line_id"), "customer", "amount").union(many.where("amount > 0").select("k", F.lit(0).cast("long"), "amount"))
    return lines, hot


@query("join_wide_splits")
def _(spark, d):
    """Sums of up to eight invoices, a third of them of one customer."""
    shared_checkpoints(spark)
    return R.splits(*wide_lines(spark, d))


@query("agg_match_counters", f"{BANK}, e AS ({EXACT}), b2 AS ({BAND}) SELECT CASE WHEN line_id IN (SELECT line_id FROM e) THEN 'EXACT' WHEN line_id IN (SELECT line_id FROM b2) THEN 'BAND' ELSE 'NONE' END AS status, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM bank GROUP BY 1")
def _(spark, d):
    lines, inv = bank_lines(spark, d), invoices(spark, d)
    exact = R.exact_edges(lines, inv).select("line_id").distinct().withColumn("e", F.lit(1))
    band = R.band_edges(lines, inv).select("line_id").distinct().withColumn("b", F.lit(1))
    status = F.when(F.col("e") == 1, "EXACT").when(F.col("b") == 1, "BAND").otherwise("NONE")
    return lines.join(exact, "line_id", "left").join(band, "line_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("udf_jaro_winkler_names")
def _(spark, d):
    """Similarity of neighbouring supplier names, on distinct pairs only."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    pairs = s.alias("a").join(s.alias("b"), F.col("b.s_suppkey") == F.col("a.s_suppkey") + 1).select(F.col("a.s_suppkey").alias("id"), F.col("a.s_name").alias("a"), F.col("b.s_name").alias("b"))
    return pairs.withColumn("bps", T.jaro_winkler("a", "b"))


@query("join_left_matrix", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'")
def _(spark, d):
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    return o.where("o_orderstatus = 'F'").join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select("o_orderkey", "c_name", "n_name")


@query("join_semi_metadata", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def _(spark, d):
    items = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45")
    return table(spark, d, "part").join(items, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


# --- ledger ---------------------------------------------------------------------------------------------------------------

SUMS = "CAST(sum(CASE WHEN side = 'D' THEN amount ELSE 0 END) AS BIGINT) AS debit, CAST(sum(CASE WHEN side = 'C' THEN amount ELSE 0 END) AS BIGINT) AS credit"
BALANCES = "SELECT code, kind, CAST(sum(CASE WHEN side = normal THEN amount ELSE -amount END) AS BIGINT) AS balance FROM jl JOIN chart ON account = code GROUP BY 1, 2"


@query("agg_entry_checks", f"{JL} SELECT entry_id, n_lines, debit, credit, n_lines >= 2 AND least > 0 AND debit = credit AS balanced FROM (SELECT entry_id, count(*) AS n_lines, {SUMS}, min(amount) AS least FROM jl GROUP BY 1)")
def _(spark, d):
    return L.entry_checks(journal_lines(spark, d))


CURRENCY = "CASE WHEN entry_id % 10 = 3 AND account = '511' OR entry_id % 4 = 1 THEN 'USD' ELSE 'VND' END"


@query("agg_entry_currency_checks", f"{JL}, c AS (SELECT *, {CURRENCY} AS currency FROM jl) SELECT entry_id, n_lines, debit, credit, currencies, n_lines >= 2 AND least > 0 AND debit = credit AND currencies = 1 AS balanced FROM (SELECT entry_id, count(*) AS n_lines, {SUMS}, min(amount) AS least, count(DISTINCT currency) AS currencies FROM c GROUP BY 1)")
def _(spark, d):
    return L.entry_checks(journal_lines(spark, d).withColumn("currency", F.expr(CURRENCY)), "currency")


@query(
    "agg_equation_by_currency",
    f"""{JL}, {L.chart_sql()}, c AS (SELECT currency, kind, CASE WHEN (normal = 'D') = (side = 'D') THEN amount ELSE -amount END AS v FROM (SELECT *, {CURRENCY} AS currency FROM jl) JOIN chart ON account = code),
    t AS (SELECT currency, CAST(sum(CASE WHEN kind IN ('ASSET', 'EXPENSE') THEN v ELSE 0 END) AS BIGINT) AS left_side, CAST(sum(CASE WHEN kind IN ('LIABILITY', 'EQUITY', 'REVENUE') THEN v ELSE 0 END) AS BIGINT) AS right_side FROM c GROUP BY currency) SELECT *, left_side = right_side AS holds FROM t""",
)
def _(spark, d):
    return L.equation_by_currency(journal_lines(spark, d).withColumn("currency", F.expr(CURRENCY)), L.chart(spark))


@query("agg_account_balances", f"{JL}, {L.chart_sql()} {BALANCES}")
def _(spark, d):
    return L.balances(journal_lines(spark, d), L.chart(spark))


@query("agg_coa_roll_up", f"WITH RECURSIVE {JL.removeprefix('WITH ')}, {L.chart_sql()}, up AS (SELECT code, code AS ancestor FROM chart UNION ALL SELECT up.code, parent FROM up JOIN chart ON up.ancestor = chart.code WHERE parent IS NOT NULL) SELECT ancestor AS code, CAST(sum(balance) AS BIGINT) AS balance FROM ({BALANCES}) b JOIN up USING (code) GROUP BY 1")
def _(spark, d):
    return L.roll_up(journal_lines(spark, d), L.chart(spark))


@query("agg_coa_validation", f"WITH {L.chart_sql()} SELECT c.code, c.parent IS NOT NULL AND p.code IS NULL AS missing_parent, p.kind IS NOT NULL AND p.kind <> c.kind AS other_kind, c.code NOT IN (SELECT parent FROM chart WHERE parent IS NOT NULL) AS is_leaf FROM chart c LEFT JOIN chart p ON c.parent = p.code")
def _(spark, d):
    c = L.chart(spark)
    p = c.select(F.col("code").alias("p_code"), F.col("kind").alias("p_kind"))
    kids = c.where("parent IS NOT NULL").select(F.col("parent").alias("k_code")).distinct()
    joined = c.join(p, F.col("parent") == F.col("p_code"), "left").join(kids, F.col("code") == F.col("k_code"), "left")
    return joined.select("code", (F.col("parent").isNotNull() & F.col("p_code").isNull()).alias("missing_parent"), (F.col("p_kind").isNotNull() & F.coalesce(F.col("p_kind") != F.col("kind"), F.lit(False))).alias("other_kind"), F.col("k_code").isNull().alias("is_leaf"))


@query("agg_trial_balance", f"{JL} SELECT coalesce(account, 'TOTAL') AS account, {SUMS} FROM jl GROUP BY ROLLUP (account)")
def _(spark, d):
    return L.trial_balance(journal_lines(spark, d))


@query("agg_accounting_equation", f"{JL}, {L.chart_sql()}, b AS ({BALANCES}), t AS (SELECT CAST(sum(CASE WHEN kind IN ('ASSET', 'EXPENSE') THEN balance ELSE 0 END) AS BIGINT) AS left_side, CAST(sum(CASE WHEN kind IN ('LIABILITY', 'EQUITY', 'REVENUE') THEN balance ELSE 0 END) AS BIGINT) AS right_side FROM b) SELECT *, left_side = right_side AS holds FROM t")
def _(spark, d):
    return L.equation(journal_lines(spark, d), L.chart(spark))


MONTHS = """months AS (SELECT strftime(l_shipdate, '%Y-%m') AS period, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue, CAST(sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS BIGINT) AS deductions,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE CAST(round(l_extendedprice * 60) AS BIGINT) END) AS BIGINT) AS cogs, CAST(sum(CAST(round(l_quantity * 1000) AS BIGINT)) AS BIGINT) AS expense FROM lineitem GROUP BY 1)"""


def months(spark, d):
    def minor(x):
        return F.round(F.expr(x)).cast("long")

    cogs = F.when(F.col("l_returnflag") == "R", minor("l_extendedprice * 100")).otherwise(minor("l_extendedprice * 60"))
    return table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("period")).agg(F.sum(minor("l_extendedprice * 100")).alias("revenue"), F.sum(minor("l_extendedprice * l_discount * 100")).alias("deductions"), F.sum(cogs).alias("cogs"), F.sum(minor("l_quantity * 1000")).alias("expense"))


@query("agg_income_statement", f"WITH {MONTHS}, p AS (SELECT *, revenue - deductions AS net_revenue, revenue - deductions - cogs AS gross_profit, revenue - deductions - cogs - expense AS before_tax FROM months), t AS (SELECT *, CASE WHEN before_tax > 0 THEN before_tax * 2000 // 10000 ELSE 0 END AS tax FROM p) SELECT *, before_tax - tax AS after_tax FROM t")
def _(spark, d):
    return L.income_statement(months(spark, d))


@query("agg_cash_flow", f"WITH {MONTHS} SELECT period, revenue - deductions AS inflow, cogs + expense AS outflow, revenue - deductions - cogs - expense AS net, CAST(sum(revenue - deductions - cogs - expense) OVER (ORDER BY period) AS BIGINT) AS closing FROM months")
def _(spark, d):
    flows = months(spark, d).select("period", (F.col("revenue") - F.col("deductions")).alias("inflow"), (F.col("cogs") + F.col("expense")).alias("outflow"))
    # one row a month: bounded by the calendar
    return flows.withColumn("net", F.col("inflow") - F.col("outflow")).withColumn("closing", F.sum("net").over(Window.orderBy("period")))


@query("agg_vat_return", f"WITH {MONTHS}, s AS (SELECT period, cogs AS sales_8, revenue AS sales_10, expense * 30 AS input_tax FROM months), t AS (SELECT *, sales_8 * 8 // 100 + sales_10 * 10 // 100 AS output_tax FROM s) SELECT period, output_tax, input_tax, greatest(0, output_tax - input_tax) AS payable, greatest(0, input_tax - output_tax) AS carried FROM t")
def _(spark, d):
    return L.vat_return(months(spark, d).select("period", F.col("cogs").alias("sales_8"), F.col("revenue").alias("sales_10"), (F.col("expense") * 30).alias("input_tax")))


@query("num_vat_unbundle", f"{INV} SELECT invoice_id, amount * 100 // 110 AS net, amount - amount * 100 // 110 AS vat FROM inv")
def _(spark, d):
    net, vat = L.unbundle(F.col("amount"), 10)
    return invoices(spark, d).select("invoice_id", net.alias("net"), vat.alias("vat"))


@query(
    "agg_largest_remainder",
    """WITH p AS (SELECT s_nationkey AS g, s_suppkey AS k, CAST(s_suppkey % 7 + 1 AS BIGINT) AS w, CAST(1000003 AS BIGINT) AS total FROM supplier), q AS (SELECT *, sum(w) OVER (PARTITION BY g) AS aw FROM p),
    r AS (SELECT *, total * w // aw AS share, total * w % aw AS rest FROM q), u AS (SELECT *, total - sum(share) OVER (PARTITION BY g) AS spare, row_number() OVER (PARTITION BY g ORDER BY rest DESC, k) AS rk FROM r)
    SELECT g, k, CAST(share + CASE WHEN rk <= spare THEN 1 ELSE 0 END AS BIGINT) AS share FROM u""",
)
def _(spark, d):
    parts = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 7 + 1).alias("w"), F.lit(1_000_003).cast("long").alias("total"))
    return L.allocate(parts, "g", "total", "w", "k")


RUNNING = "lines AS (SELECT account, tx_id, CASE WHEN is_credit THEN amount ELSE -amount END AS movement, CAST(sum(CASE WHEN is_credit THEN amount ELSE -amount END) OVER (PARTITION BY account ORDER BY tx_id) AS BIGINT) + CASE WHEN tx_id % 997 = 0 THEN 5 ELSE 0 END AS balance FROM txn)"


@query("win_balance_continuity", f"{TXN}, {RUNNING}, e AS (SELECT *, lag(balance) OVER (PARTITION BY account ORDER BY tx_id) + movement AS expected FROM lines) SELECT account, tx_id, balance, expected FROM e WHERE expected <> balance")
def _(spark, d):
    signed = F.when(F.col("is_credit"), F.col("amount")).otherwise(-F.col("amount"))
    lines = transactions(spark, d).select("account", "tx_id", signed.alias("movement"))
    held = lines.withColumn("balance", F.sum("movement").over(Window.partitionBy("account").orderBy("tx_id")) + F.when(F.col("tx_id") % 997 == 0, 5).otherwise(0))
    return L.running_breaks(held, "account", "tx_id")


@query("win_cash_forecast", f"{TXN}, f AS (SELECT ts // 86400 AS day, CAST(sum(CASE WHEN is_credit THEN amount ELSE -amount END) AS BIGINT) AS net FROM txn GROUP BY 1), b AS (SELECT *, CAST(50000000 + sum(net) OVER (ORDER BY day) AS BIGINT) AS balance FROM f) SELECT *, min(balance) OVER (ORDER BY day) AS lowest, balance < 49000000 AS breach FROM b")
def _(spark, d):
    signed = F.when(F.col("is_credit"), F.col("amount")).otherwise(-F.col("amount"))
    flows = transactions(spark, d).groupBy(F.expr("ts DIV 86400").alias("day")).agg(F.sum(signed).alias("net"))
    return L.cash_forecast(flows, 50_000_000, 49_000_000)


@query("num_solvency_ratios", "SELECT c_custkey, CASE WHEN b > 0 THEN least(a * 10000 // greatest(b, 1), 999999) ELSE 999999 END AS dscr_bps FROM (SELECT c_custkey, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS a, c_custkey % 13 * 10000 AS b FROM customer)")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.round(F.abs("c_acctbal") * 100).cast("long").alias("a"), (F.col("c_custkey") % 13 * 10_000).alias("b"))
    return c.select("c_custkey", L.ratio_bps(F.col("a"), F.col("b")).cast("long").alias("dscr_bps"))


GROUP_SQL = "CASE WHEN days < 10 THEN 1 WHEN days <= 90 THEN 2 WHEN days <= 180 THEN 3 WHEN days <= 360 THEN 4 ELSE 5 END"


@query("num_debt_groups", f"{INV}, g AS (SELECT invoice_id, amount, {GROUP_SQL} AS debt_group FROM (SELECT *, invoice_id % 500 AS days FROM inv)) SELECT invoice_id, debt_group, CAST(CASE WHEN debt_group < 5 THEN amount * 75 // 10000 ELSE 0 END + amount * CASE debt_group WHEN 1 THEN 0 WHEN 2 THEN 5 WHEN 3 THEN 20 WHEN 4 THEN 50 ELSE 100 END // 100 AS BIGINT) AS provision FROM g")
def _(spark, d):
    g = invoices(spark, d).withColumn("debt_group", L.debt_group(F.col("invoice_id") % 500))
    return g.select("invoice_id", "debt_group", L.provision(F.col("amount"), F.col("debt_group")).alias("provision"))


@query("num_approval_tiers", f"{INV} SELECT CASE WHEN amount < 5000000 THEN 0 WHEN amount < 20000000 THEN 1 WHEN amount < 40000000 THEN 2 ELSE 3 END AS tier, count(*) AS n FROM inv GROUP BY 1")
def _(spark, d):
    return invoices(spark, d).groupBy(L.approval_tier(F.col("amount")).alias("tier")).agg(F.count("*").alias("n"))


@query("num_stress_scenarios", "SELECT c_mktsegment, scenario, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) * keep // 100 AS stressed FROM customer, (VALUES ('base', 100), ('moderate', 85), ('severe', 70)) AS s(scenario, keep) WHERE c_acctbal > 0 GROUP BY c_mktsegment, scenario, keep")
def _(spark, d):
    cases = spark.createDataFrame([("base", 100), ("moderate", 85), ("severe", 70)], "scenario string, keep long")
    totals = table(spark, d, "customer").where("c_acctbal > 0").groupBy("c_mktsegment").agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("t"))
    return totals.crossJoin(F.broadcast(cases)).select("c_mktsegment", "scenario", F.expr("t * keep DIV 100").alias("stressed"))


# --- retrieval ----------------------------------------------------------------------------------------------------------------

ASKED = ["the", "of"]
BM25 = """toks AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM documents),
    c AS (SELECT count(*) AS n, avg(len(t)) AS al FROM toks), h AS (SELECT doc_id, len(t) AS len, q AS term, len(list_filter(t, lambda x: x = q)) AS tf FROM toks, (SELECT unnest(['the', 'of']) AS q)),
    df AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY term),
    bm AS (SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / al))), 6) AS score FROM h JOIN df USING (term), c WHERE tf > 0 GROUP BY doc_id)"""


@query("ret_bm25", f"WITH {BM25} SELECT * FROM bm")
def _(spark, d):
    return V.bm25(table(spark, d, "documents"), ASKED)


@query("ret_knn", "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (CASE WHEN i = 1 THEN 1.0 WHEN i = 2 THEN 0.5 ELSE 0.0 END))), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def _(spark, d):
    return V.nearest_vectors(table(spark, d, "embeddings"), [1.0, 0.5] + [0.0] * 62, 20)


@query(
    "ret_hybrid_rrf",
    f"""WITH {BM25}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 30)),
    e AS (SELECT vec_id AS doc_id, round(CAST(embedding[1] AS DOUBLE), 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 30), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e)
    SELECT doc_id, round(sum(p), 9) AS score FROM (SELECT doc_id, 1.0::DOUBLE / (60 + rank) AS p FROM a UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + rank) FROM b) GROUP BY doc_id""",
)
def _(spark, d):
    sparse = V.ranked(V.bm25(table(spark, d, "documents"), ASKED), "doc_id", 30)
    dense = V.ranked(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("score")), "doc_id", 30)
    return V.fuse(sparse, dense, "doc_id")


@query("num_retention", "SELECT event_id, round(greatest(0.05, least(1.0, exp(-(event_id % 200) / (30 * (1 + 0.2 * ln(1 + event_id % 7)))))), 6) AS retention FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(V.retention(F.col("event_id") % 200, F.col("event_id") % 7), 6).alias("retention"))


EDGES = "ed AS (SELECT c_nationkey AS source, s_nationkey AS target, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
STEP = "p{1} AS (SELECT coalesce(m.node, s.node) AS node, coalesce(m.m, 0) + 0.15 * coalesce(s.s, 0) AS p FROM (SELECT target AS node, sum(p * share) * 0.85 AS m FROM p{0} JOIN sh ON node = source WHERE p > 1e-7 GROUP BY 1) m FULL JOIN st s ON m.node = s.node)"


@query("ret_personalised_pagerank", f"WITH {EDGES}, sh AS (SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS share FROM ed), st AS (SELECT unnest([0, 1]) AS node, CAST(0.5 AS DOUBLE) AS s), p0 AS (SELECT node, s AS p FROM st), {STEP.format(0, 1)}, {STEP.format(1, 2)}, {STEP.format(2, 3)} SELECT node, round(p, 6) AS p FROM p3 WHERE p > 1e-6")
def _(spark, d):
    o, li, c, s = (table(spark, d, x) for x in ("orders", "lineitem", "customer", "supplier"))
    pairs = o.join(li, o.o_orderkey == li.l_orderkey).select("o_custkey", "l_suppkey").distinct()
    edges = pairs.join(c, pairs.o_custkey == c.c_custkey).join(s, pairs.l_suppkey == s.s_suppkey).groupBy(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target")).agg(F.count("*").cast("double").alias("weight"))
    return V.personalised_rank(edges, spark.createDataFrame([(0,), (1,)], "node int"))


@query("arr_label_centroids", "SELECT label, i AS at, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", (F.col("p") + 1).cast("long").alias("at")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


# --- metrics and records -------------------------------------------------------------------------------------------------------------


@query("agg_nearest_rank", f"{TXN} SELECT is_credit, count(*) AS n, CAST(quantile_disc(amount, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(amount, 0.95) AS DOUBLE) AS p95, min(amount) AS low, max(amount) AS high, round(avg(amount), 4) AS mean, round(stddev_pop(amount), 4) AS deviation FROM txn GROUP BY 1")
def _(spark, d):
    return C.nearest_rank(transactions(spark, d), "is_credit", "amount")


SAID = "CASE WHEN d.n_chars > 200 AND NOT contains(d.text, '***') AND NOT contains(d.text, ' | ') THEN 1 ELSE 0 END"


@query("agg_classification", f"WITH c AS (SELECT sum(CASE WHEN quality = 1 AND said = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN quality = 0 AND said = 1 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN quality = 1 AND said = 0 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN quality = 0 AND said = 0 THEN 1 ELSE 0 END)::BIGINT AS tn FROM (SELECT quality, {SAID} AS said FROM labels l JOIN documents d USING (doc_id))) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c")
def _(spark, d):
    said = F.when((F.col("n_chars") > 200) & ~F.contains("text", F.lit("***")) & ~F.contains("text", F.lit(" | ")), 1).otherwise(0)
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", said.alias("said"))
    return C.classification(rows, "quality", "said")


@query("agg_by_role", "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 2) AS mean_chars, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"), F.round(F.avg(F.length("text")), 2).alias("mean_chars"), F.countDistinct("conv_id").alias("conversations"))


@query("agg_distinct_and_nulls", "SELECT role, count(DISTINCT k) + sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END)::BIGINT AS tally FROM (SELECT role, nullif(conv_id % 10, 0) AS k FROM conversations) GROUP BY role")
def _(spark, d):
    k = F.nullif(F.col("conv_id") % 10, F.lit(0).cast("long"))
    return table(spark, d, "conversations").select("role", k.alias("k")).groupBy("role").agg((F.countDistinct("k") + F.sum(F.col("k").isNull().cast("int"))).alias("tally"))


@query("set_union_having", "SELECT k, max(t) AS last FROM (SELECT conv_id AS k, max(turn) AS t FROM conversations GROUP BY 1 UNION ALL SELECT vec_id, max(label) FROM embeddings GROUP BY 1) GROUP BY k HAVING max(t) < 5")
def _(spark, d):
    a = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("k")).agg(F.max("turn").alias("t"))
    b = table(spark, d, "embeddings").groupBy(F.col("vec_id").alias("k")).agg(F.max("label").cast("long").alias("t"))
    return a.unionByName(b).groupBy("k").agg(F.max("t").alias("last")).where("last < 5")


@query("top_latest_orders", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def _(spark, d):
    return C.newest(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 100)


@query("top_per_customer", f"{INV} SELECT customer, invoice_id, amount, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY amount DESC, invoice_id) AS r FROM inv) WHERE r <= 3")
def _(spark, d):
    return C.top_per_group(invoices(spark, d).select("customer", "invoice_id", "amount"), "customer", [F.col("amount").desc(), F.col("invoice_id")], 3)


@query("win_latest_state", f"{TXN} SELECT account, tx_id, amount, ts FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, tx_id DESC) AS r FROM txn) WHERE r = 1")
def _(spark, d):
    return C.latest(transactions(spark, d).select("account", "tx_id", "amount", "ts"), "account", ["ts", "tx_id"])


@query("win_version_history", f"{TXN}, o AS (SELECT account, tx_id AS valid_from, is_credit, lag(is_credit) OVER (PARTITION BY account ORDER BY tx_id) AS old FROM txn), n AS (SELECT * FROM o WHERE old IS NULL OR old <> is_credit) SELECT account, valid_from, is_credit, lead(valid_from) OVER (PARTITION BY account ORDER BY valid_from) AS valid_until FROM n")
def _(spark, d):
    return C.changes(transactions(spark, d), "account", ["tx_id"], "is_credit")


@query("win_forward_fill", f"{TXN}, s AS (SELECT account, tx_id, CASE WHEN tx_id % 3 = 0 THEN amount END AS seen FROM txn) SELECT account, tx_id, last_value(seen IGNORE NULLS) OVER (PARTITION BY account ORDER BY tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM s")
def _(spark, d):
    return C.forward_filled(transactions(spark, d).select("account", "tx_id", F.when(F.col("tx_id") % 3 == 0, F.col("amount")).alias("seen")), "account", "tx_id", "seen")


@query("io_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -c_custkey, 'X' FROM customer WHERE c_custkey % 50 = 0")
def _(spark, d):
    held = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = held.where("c_custkey % 5 = 0").select("c_custkey").union(held.where("c_custkey % 50 = 0").select(-F.col("c_custkey"))).withColumn("segment", F.lit("X"))
    return C.upsert(held, new, "c_custkey")


@query("win_hash_chain", "WITH r AS (SELECT user_id, event_id, sha256(CAST(event_id AS VARCHAR)) AS h FROM events), c AS (SELECT *, CASE WHEN event_id % 500 = 7 THEN 'bad' ELSE coalesce(lag(h) OVER w, repeat('0', 64)) END AS prev, coalesce(lag(h) OVER w, repeat('0', 64)) AS want FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id FROM c WHERE prev <> want")
def _(spark, d):
    r = table(spark, d, "events").select("user_id", "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("record_hash"))
    good = F.coalesce(F.lag("record_hash").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit("0" * 64))
    return C.chain_breaks(r.withColumn("prev_hash", F.when(F.col("event_id") % 500 == 7, F.lit("bad")).otherwise(good)), "user_id", "event_id")


@query("udf_merkle_roots")
def _(spark, d):
    """One root for each account's events; checked against a direct computation in the tests."""
    return C.merkle_roots(table(spark, d, "events"), "user_id", "event_id", "event_id")


@query("udf_word_errors")
def _(spark, d):
    """Edit operations between neighbouring turns of a conversation."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("next", F.lead("text").over(by)).where("next IS NOT NULL")
    return rows.select("conv_id", "turn", T.word_errors("text", "next").alias("e")).select("conv_id", "turn", "e.*")


@query("agg_word_error_rate")
def _(spark, d):
    """One row: all operations between neighbouring turns, all words of the first ones, and their rate in basis points."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("next", F.lead("text").over(by)).where("next IS NOT NULL")
    counted = rows.select(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"), T.word_errors("text", "next").alias("e"))
    sums = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("words", "words"), ("substitutions", "e.substitutions"), ("deletions", "e.deletions"), ("insertions", "e.insertions"))])
    return sums.withColumn("rate_bps", F.expr("CASE WHEN words > 0 THEN (substitutions + deletions + insertions) * 10000 DIV words END"))


# --- scalar functions ---------------------------------------------------------------------------------------------------------------


@query("txt_core_names", "SELECT s_suppkey, trim(regexp_replace(upper(s_name), '[^A-Z0-9]+', ' ', 'g')) AS core FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.core_name(F.col("s_name")).alias("core"))


@query("txt_doc_refs", f"{INV} SELECT invoice_id, translate(doc_ref, '-_/ .', '') AS bare, {KEY.format('doc_ref')} AS ref FROM inv")
def _(spark, d):
    return invoices(spark, d).select("invoice_id", T.bare_ref(F.col("doc_ref")).alias("bare"), T.doc_ref(F.col("doc_ref")).alias("ref"))


@query("txt_refs_in_text", f"{INV} SELECT invoice_id, array_to_string(regexp_extract_all('pay ' || doc_ref || ' and ' || doc_ref || '1', '([A-Z]{{2,3}}-?[0-9]{{3,}})', 1), ',') AS refs FROM inv")
def _(spark, d):
    text = F.concat(F.lit("pay "), "doc_ref", F.lit(" and "), "doc_ref", F.lit("1"))
    return invoices(spark, d).select("invoice_id", F.array_join(T.refs_in(text), ",").alias("refs"))


@query("txt_containment", "WITH p AS (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda w: w <> '') AS ws, p_type AS t FROM part) SELECT p_partkey, CAST(CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: contains(t, w))) * 10000 // len(ws) ELSE 0 END AS BIGINT) AS bps FROM p")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.containment_bps(T.words(F.col("p_name")), F.col("p_type")).alias("bps"))


MASK = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}', '[CARD]', 'g'), '(api_key|password|token)=[^ ]+', '\1=[SECRET]', 'g'), '[0-9]{9,}', '[NUMBER]', 'g')"


@query("pii_mask", f"SELECT doc_id, md5({MASK}) AS masked_md5 FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.mask_secrets(F.col("text"))).alias("masked_md5"))


@query("date_local_hours", f"{TXN} SELECT {HOUR} AS hour, count(*) AS n FROM txn GROUP BY 1")
def _(spark, d):
    return transactions(spark, d).groupBy(S.local_hour(F.col("ts")).cast("long").alias("hour")).agg(F.count("*").alias("n"))


@query("flt_first_matching_rule", f"{TXN} SELECT tx_id, CASE WHEN amount >= 20000 AND is_credit THEN 'large_in' WHEN amount >= 20000 THEN 'large_out' WHEN contains(narration, 'view') THEN 'view' ELSE 'default' END AS rule FROM txn")
def _(spark, d):
    rules = [((F.col("amount") >= 20_000) & F.col("is_credit"), "large_in"), (F.col("amount") >= 20_000, "large_out"), (F.contains("narration", F.lit("view")), "view")]
    out = F.lit("default")
    for cond, name in reversed(rules):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return transactions(spark, d).select("tx_id", out.alias("rule"))


@query("flt_metadata_window", "SELECT event_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def _(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase' AND ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-12'").select("event_id")


@query("agg_bank_totals", f"{TXN}, t AS (SELECT account % 5 AS bank, CAST(sum(CASE WHEN is_credit THEN amount ELSE 0 END) AS BIGINT) AS inflow, CAST(sum(CASE WHEN NOT is_credit THEN amount ELSE 0 END) AS BIGINT) AS outflow FROM txn GROUP BY 1) SELECT bank, inflow, outflow, inflow - outflow AS net FROM t")
def _(spark, d):
    t = transactions(spark, d).groupBy((F.col("account") % 5).alias("bank")).agg(F.sum(F.when(F.col("is_credit"), F.col("amount")).otherwise(0)).alias("inflow"), F.sum(F.when(~F.col("is_credit"), F.col("amount")).otherwise(0)).alias("outflow"))
    return t.withColumn("net", F.col("inflow") - F.col("outflow"))


# --- sources -----------------------------------------------------------------------------------------------------------------------------


def _files(lines: DataFrame, head: str, row) -> DataFrame:
    """One statement file for each customer, so that files grow in number and not in size."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", row.alias("r")))), lambda x: x["r"]), "\n")
    return lines.groupBy(F.col("customer").alias("k")).agg(F.concat(F.lit(head), body).alias("content")).select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("file"), "content")


PARSED = f"{BANK} SELECT 'f' || customer AS file, ref AS ref_code, 'credit' AS posting_type, amount FROM bank WHERE amount > 0"


@query("io_delimited_statements", PARSED)
def _(spark, d):
    row = F.concat_ws(";", F.lit("2024-01-01"), "ref", F.lit(""), T.thousand_dots(F.col("amount")), F.lit("paid"))
    files = _files(bank_lines(spark, d), "Bank statement\nAccount;1\nDate;Ref;Debit;Credit;Narration\n", row)
    rows = P.delimited(files, {"date": ["Date"], "ref": ["Ref"], "debit": ["Debit"], "credit": ["Credit"], "narration": ["Narration"]})
    return rows.select("file", "ref_code", "posting_type", "amount")


@query("io_mt940_statements", PARSED)
def _(spark, d):
    row = F.concat(F.lit(":61:240101"), F.lit("C"), F.col("amount").cast("string"), F.lit(",NTRF"), F.col("ref"), F.lit("\n:86:paid\nin full"))
    return P.mt940(_files(bank_lines(spark, d), ":20:S\n:25:ACC\n:60F:C240101VND0,\n", row)).select("file", "ref_code", "posting_type", "amount")


@query("io_camt053_statements", PARSED)
def _(spark, d):
    row = F.concat(F.lit("<Ntry><NtryRef>"), "ref", F.lit('</NtryRef><Amt Ccy="VND">'), F.col("amount").cast("string"), F.lit("</Amt><CdtDbtInd>CRDT</CdtDbtInd></Ntry>"))
    return P.camt053(_files(bank_lines(spark, d), "<Document><BkToCstmrStmt>", row)).select("file", "ref_code", "posting_type", "amount")
