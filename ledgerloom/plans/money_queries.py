"""Queries of the money, date and credit functions, over figures derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates as D
from ledgerloom.functions import money as M
from ledgerloom.operators import credit as K
from ledgerloom.plans.registry import BANK, TXN, query
from ledgerloom.sources.adapters import bank_lines, invoices, table, transactions


def written_amounts(spark, d) -> DataFrame:
    """(id, text): the total of each order as nine kinds of statement write it."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, part = M.div(cents, 100), F.lpad((cents % 100).cast("string"), 2, "0")
    us = F.concat(F.format_number(whole, 0), F.lit("."), part)
    dotted = F.translate(F.format_number(whole, 0), ",", ".")
    local = F.concat(dotted, F.lit(","), part)
    kinds = [local, us, F.concat(whole.cast("string"), F.lit(","), part), F.concat(F.lit("("), local, F.lit(")")), F.concat(F.lit("-"), us), whole.cast("string"), dotted, F.concat(F.lit(" VND "), local, F.lit(" CR")), F.lit("—")]
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*kinds), (F.col("o_orderkey") % 9 + 1).cast("int")).alias("text"))


@query(
    "num_parse_amounts",
    """WITH o AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderkey % 9 AS kind FROM orders)
    SELECT id, CASE WHEN kind IN (0, 1, 2) THEN cents WHEN kind IN (3, 4, 7) THEN -cents WHEN kind IN (5, 6) THEN cents // 100 * 100 ELSE 0 END AS amount FROM o""",
)
def _(spark, d):
    return written_amounts(spark, d).select("id", M.parse_amount(F.col("text"), 2, strip=["VND"]).alias("amount"))


@query(
    "num_parse_stated_separators",
    "WITH o AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderkey % 9 AS kind FROM orders) SELECT id, CASE WHEN kind = 3 THEN -cents ELSE cents END AS local, CASE WHEN kind = 3 THEN -(cents // 100) ELSE cents // 100 END AS whole FROM o WHERE kind IN (0, 2, 3)",
)
def _(spark, d):
    rows = written_amounts(spark, d).where("id % 9 IN (0, 2, 3)")
    return rows.select("id", M.parse_amount(F.col("text"), 2, ".", ",").alias("local"), M.parse_amount(F.col("text"), 0, ".", ",").alias("whole"))


#: Every fifth amount is so large that most of its ratios leave 64 bits.
RATIO = ["o_orderkey AS id", "CASE WHEN o_orderkey % 5 = 0 THEN 9000000000000000000 - o_orderkey ELSE CAST(round(o_totalprice * 100) AS BIGINT) - 20000000 END AS amount", "o_orderkey % 13 - 3 AS num", "o_orderkey % 4 AS den"]


@query(
    "num_times_ratio",
    f"""WITH o AS (SELECT {', '.join(RATIO)} FROM orders), p AS (SELECT id, den, CAST(amount AS HUGEINT) * num AS v FROM o)
    SELECT id, CASE WHEN den <> 0 THEN TRY_CAST(CASE WHEN abs(v) % den * 2 < den OR (abs(v) % den * 2 = den AND abs(v) // den % 2 = 0) THEN abs(v) // den ELSE abs(v) // den + 1 END * sign(v) AS BIGINT) END AS amount FROM p""",
)
def _(spark, d):
    rows = table(spark, d, "orders").selectExpr(*RATIO)
    return rows.select("id", M.times_ratio(F.col("amount"), F.col("num"), F.col("den")).alias("amount"))


@query(
    "num_checked_money",
    """WITH o AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS a, 9223372036854775807 - o_orderkey * 1000000000 AS b, CASE WHEN o_orderkey % 3 = 0 THEN 'USD' ELSE 'VND' END AS ca FROM orders)
    SELECT id, CASE WHEN ca = 'VND' THEN TRY_CAST(CAST(a AS HUGEINT) + b AS BIGINT) END AS total, CASE WHEN ca = 'VND' THEN a - b END AS difference, TRY_CAST(CAST(a AS HUGEINT) * 1000000000000 AS BIGINT) AS product FROM o""",
)
def _(spark, d):
    a, b, ca, cb = F.col("a"), F.col("b"), F.col("ca"), F.lit("VND")
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS id", "CAST(round(o_totalprice * 100) AS BIGINT) AS a", "9223372036854775807 - o_orderkey * 1000000000 AS b", "CASE WHEN o_orderkey % 3 = 0 THEN 'USD' ELSE 'VND' END AS ca")
    return rows.select("id", M.checked("add", a, b, ca, cb).alias("total"), M.checked("subtract", a, b, ca, cb).alias("difference"), M.checked("multiply", a, F.lit(10**12).cast("long"), ca, cb).alias("product"))


@query("num_unbundle_any_rate", "WITH o AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) % 50 AS gross FROM orders), n AS (SELECT id, gross, CASE WHEN gross <= 0 THEN NULL WHEN gross < 2 OR gross * 10000 // 10800 = 0 THEN gross ELSE gross * 10000 // 10800 END AS net FROM o) SELECT id, net, gross - net AS tax FROM n")
def _(spark, d):
    net, tax = M.unbundled(F.col("gross"), 800)
    return table(spark, d, "orders").selectExpr("o_orderkey AS id", "CAST(round(o_totalprice * 100) AS BIGINT) % 50 AS gross").select("id", net.alias("net"), tax.alias("tax"))


@query(
    "join_fee_schedule",
    f"{BANK} SELECT line_id, i.amount - b.amount AS fee, i.amount - b.amount IN (1100, 2200, 3300, 5500, 7700, 8800, 9900, 11000) AS listed, i.amount - b.amount BETWEEN 1100 AND 11000 AS in_range, CASE WHEN i.amount = b.amount THEN 'EXACT' WHEN i.amount - b.amount IN (1100, 2200, 3300, 5500, 7700, 8800, 9900, 11000) THEN 'SHORT_BY_FEE' ELSE 'OTHER' END AS direction FROM bank b JOIN inv i ON line_id = invoice_id",
)
def _(spark, d):
    inv = invoices(spark, d).select("invoice_id", F.col("amount").alias("invoiced"))
    met = bank_lines(spark, d).join(inv, F.col("line_id") == F.col("invoice_id")).withColumn("fee", F.col("invoiced") - F.col("amount"))
    return met.select("line_id", "fee", M.in_fee_schedule(F.col("fee"), M.FEES).alias("listed"), M.in_fee_schedule(F.col("fee"), between=M.FEE_RANGE).alias("in_range"), M.fee_direction(F.col("amount"), F.col("invoiced")).alias("direction"))


FEE_TEXT = "CASE l_linenumber % 4 WHEN 0 THEN 'thu phi dich vu' WHEN 1 THEN 'ck hd ' || l_orderkey || ' phi 7700 vnd' WHEN 2 THEN 'CK phi 7701' ELSE 'thanh toan' END"


@query(
    "num_split_fees",
    f"""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_orderkey % 5 = 0 THEN 11000 ELSE CAST(round(l_extendedprice) AS BIGINT) END AS gross, l_linenumber % 4 AS kind FROM lineitem),
    f AS (SELECT *, CASE WHEN kind = 0 OR gross IN (1100, 2200, 3300, 5500, 7700, 8800, 9900, 11000) THEN gross WHEN kind = 1 AND gross > 7700 THEN 7700 ELSE 0 END AS fee FROM l) SELECT id, line, fee, gross - fee AS principal FROM f""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS line", "CASE WHEN l_orderkey % 5 = 0 THEN 11000 ELSE CAST(round(l_extendedprice) AS BIGINT) END AS gross", f"{FEE_TEXT} AS narration")
    fee = M.split_fee(F.col("gross"), F.col("narration"))
    return rows.select("id", "line", fee.alias("fee"), (F.col("gross") - fee).alias("principal"))


# --- dates ----------------------------------------------------------------------------------------------------------------


@query(
    "date_parse",
    """WITH o AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000000 // 86400 * 86400 AS day, o_orderkey % 86400 AS clock, o_orderkey % 9 AS kind FROM orders)
    SELECT id, CASE kind WHEN 0 THEN day + clock WHEN 1 THEN day + clock // 60 * 60 WHEN 2 THEN day WHEN 3 THEN day + clock WHEN 4 THEN day WHEN 5 THEN day WHEN 6 THEN day WHEN 7 THEN day END AS at FROM o""",
)
def _(spark, d):
    """Times of orders in every known form; what is no date is null."""
    day, clock = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 86_400
    h, m, s = (F.lpad(x.cast("string"), 2, "0") for x in (M.div(clock, 3600), M.div(clock % 3600, 60), clock % 60))
    kinds = [
        F.concat(F.date_format(day, "dd/MM/yyyy "), h, F.lit(":"), m, F.lit(":"), s), F.concat(F.date_format(day, "dd/MM/yyyy "), h, F.lit(":"), m), F.date_format(day, "dd/MM/yyyy"),
        F.concat(F.date_format(day, "yyyy-MM-dd "), h, F.lit(":"), m, F.lit(":"), s), F.date_format(day, " yyyy-MM-dd "), F.date_format(day, "dd-MM-yyyy"), F.date_format(day, "yyMMdd"), F.date_format(day, "yyyyMMdd"), F.lit("31/02/2024"),
    ]
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*kinds), (F.col("o_orderkey") % 9 + 1).cast("int")).alias("text"))
    return rows.select("id", D.parse_date(F.col("text")).alias("at"))


@query(
    "date_parse_loose",
    "WITH o AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000000 // 86400 * 86400 AS day, o_orderkey % 4 AS kind FROM orders) SELECT id, CASE kind WHEN 3 THEN NULL WHEN 0 THEN day + 43200 ELSE day END AS at FROM o",
)
def _(spark, d):
    """Spreadsheet day numbers, epoch milliseconds and seconds; rubbish is null."""
    days = F.unix_date(F.col("o_orderdate").cast("date"))
    kinds = [F.concat((days + 25_569).cast("string"), F.lit(".5")), (days.cast("long") * 86_400_000).cast("string"), (days.cast("long") * 86_400).cast("string"), F.lit("n/a")]
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*kinds), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("text"))
    return rows.select("id", D.parse_loose(F.col("text")).alias("at"))


@query(
    "date_effective_and_valid",
    f"{TXN} SELECT tx_id, CASE WHEN tx_id % 3 = 0 THEN ts ELSE ts + 86400 END AS at, (tx_id % 4 = 0 OR ts - 5 <= 1705000000) AND (tx_id % 5 = 0 OR 1705000000 < ts + 600000) AS valid, 1705000000 > ts + 604800 AS expired FROM txn",
)
def _(spark, d):
    now = F.lit(1_705_000_000)
    value = F.when(F.col("tx_id") % 3 != 0, F.col("ts") + 86_400).otherwise(F.lit(0))
    since, until = F.when(F.col("tx_id") % 4 != 0, F.col("ts") - 5), F.when(F.col("tx_id") % 5 != 0, F.col("ts") + 600_000)
    return transactions(spark, d).select("tx_id", D.effective(value, F.col("ts")).alias("at"), D.valid_at(now, since, until).alias("valid"), D.expired(F.col("ts"), 604_800, now).alias("expired"))


@query(
    "date_mt940",
    "WITH o AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000000 // 86400 * 86400 AS day, o_orderkey % 2 AS kind FROM orders) SELECT id, day AS value_at, CASE WHEN kind = 0 THEN day END AS entry_at FROM o",
)
def _(spark, d):
    day = F.col("o_orderdate")
    body = F.concat(F.date_format(day, "yyMMdd"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "MMdd")).otherwise(""), F.lit("C500,25NTRF"))
    value, entry = D.mt940_dates(body)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), value.alias("value_at"), entry.alias("entry_at"))


# --- credit -----------------------------------------------------------------------------------------------------------------

#: A company's figures from its key; the same expressions in both dialects.
COMPANY = {
    "id": "c_custkey", "ebitda": "c_custkey * 7919 % 100003 * 1000", "ebit": "c_custkey * 7919 % 100003 * 800 - 9000000", "capex": "c_custkey * 104729 % 50021 * 700", "principal": "CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE c_custkey * 31 % 3001 * 6000 END",
    "interest": "CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE c_custkey * 37 % 2003 * 3000 END", "cash": "c_custkey * 11 % 977 * 9000", "securities": "c_custkey * 13 % 499 * 5000", "receivable": "c_custkey * 17 % 1009 * 8000", "inventory": "c_custkey * 19 % 769 * 3000",
    "current_assets": "CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_custkey * 23 % 997 * 25000 END", "liabilities": "CASE WHEN c_custkey % 19 = 0 THEN 0 ELSE c_custkey * 29 % 1201 * 10000 END", "days_overdue": "c_custkey % 400", "restructured": "c_custkey % 7 = 0",
}
COMPANY_SQL = "WITH company AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in COMPANY.items()) + " FROM customer)"
BPS = "CASE WHEN {1} = 0 THEN 999999 ELSE least(999999, {0} * 10000 // nullif({1}, 0)) END"
DSCR = "CASE WHEN {service} = 0 OR {ebitda} < {capex} THEN 0 ELSE least(999999, ({ebitda} - {capex}) * 10000 // nullif({service}, 0)) END"
KIND = "CASE WHEN {service} = 0 THEN 'DEBT_FREE' WHEN {ebitda} < {capex} OR {dscr} < 10000 THEN 'DISTRESSED' WHEN {dscr} < 13000 THEN 'WATCHLIST' ELSE 'HEALTHY' END"
PLAIN = {"service": "(principal + interest)", "ebitda": "ebitda", "capex": "capex"}
SOLVENCY = f"""SELECT id, CAST({DSCR.format(**PLAIN)} AS BIGINT) AS dscr_bps, {KIND.format(**PLAIN, dscr=DSCR.format(**PLAIN))} AS dscr_kind, ebitda - capex - principal - interest AS dscr_buffer, CAST({BPS.format("(cash + securities + receivable)", "liabilities")} AS BIGINT) AS quick_bps,
    CASE WHEN {BPS.format("(cash + securities + receivable)", "liabilities")} >= 15000 THEN 'STRONG' WHEN {BPS.format("(cash + securities + receivable)", "liabilities")} >= 10000 THEN 'ADEQUATE' ELSE 'CRITICAL' END AS quick_kind,
    CAST({BPS.format("CASE WHEN current_assets = 0 THEN cash + securities + receivable + inventory ELSE current_assets END", "liabilities")} AS BIGINT) AS current_bps, CAST({BPS.format("(cash + securities)", "liabilities")} AS BIGINT) AS cash_bps,
    CAST(CASE WHEN interest = 0 THEN 999999 WHEN ebit <= 0 THEN 0 ELSE least(999999, ebit * 10000 // nullif(interest, 0)) END AS BIGINT) AS interest_cover_bps FROM company"""
HARD = """hard AS (SELECT id, scenario, ebitda * ef // 10000 AS ebitda, capex * cf // 10000 AS capex, principal + interest + interest * i // 10000 AS service FROM company, (VALUES ('BASE', 10000, 10000, 0), ('MODERATE', 8500, 10000, 1500), ('SEVERE', 7000, 11000, 3000)) AS s (scenario, ef, cf, i))"""
STRESSED = f"SELECT *, dscr_bps >= 10000 AND kind <> 'DISTRESSED' AS passes FROM (SELECT id, scenario, CAST({DSCR.format(service='service', ebitda='ebitda', capex='capex')} AS BIGINT) AS dscr_bps, {KIND.format(service='service', ebitda='ebitda', capex='capex', dscr=DSCR.format(service='service', ebitda='ebitda', capex='capex'))} AS kind, ebitda - capex - service AS buffer FROM hard)"
GROUP = "CASE WHEN days_overdue < 10 THEN 1 WHEN days_overdue <= 90 THEN 2 WHEN days_overdue <= 180 THEN 3 WHEN days_overdue <= 360 THEN 4 ELSE 5 END"
GROUP = f"CASE WHEN restructured THEN least(5, {GROUP} + 1) ELSE {GROUP} END"


def companies(spark, d) -> DataFrame:
    return table(spark, d, "customer").selectExpr(*[f"{e} AS {n}" for n, e in COMPANY.items()])


@query("num_solvency", f"{COMPANY_SQL} {SOLVENCY}")
def _(spark, d):
    return K.solvency(companies(spark, d))


@query("num_stress_by_company", f"{COMPANY_SQL}, {HARD} {STRESSED}")
def _(spark, d):
    return K.stressed(companies(spark, d))


@query(
    "num_provisions",
    f"{COMPANY_SQL}, g AS (SELECT id, principal, {GROUP} AS debt_group FROM company) SELECT id, debt_group, CASE WHEN debt_group < 5 THEN principal * 75 // 10000 ELSE 0 END AS general, principal * [0, 500, 2000, 5000, 10000][debt_group] // 10000 AS specific FROM g",
)
def _(spark, d):
    general, specific = K.provisions(F.col("principal"), F.col("debt_group"))
    return companies(spark, d).withColumn("debt_group", K.debt_group(F.col("days_overdue"), F.col("restructured"))).select("id", "debt_group", general.alias("general"), specific.alias("specific"))


@query(
    "num_underwriting",
    f"""{COMPANY_SQL}, {HARD}, s AS ({SOLVENCY}), t AS ({STRESSED}), j AS (SELECT c.id, {GROUP} AS g, dscr_kind, quick_kind, passes, greatest(ebitda - capex, 0) * 10000 // 13000 * 3 AS most FROM company c JOIN s USING (id) JOIN t ON t.id = c.id AND scenario = 'MODERATE')
    SELECT id, decision, CAST(CASE decision WHEN 'REJECTED' THEN 0 WHEN 'APPROVED' THEN most ELSE most * 60 // 100 END AS BIGINT) AS credit_limit FROM (SELECT *, CASE WHEN g >= 3 OR dscr_kind = 'DISTRESSED' THEN 'REJECTED' WHEN dscr_kind = 'HEALTHY' AND quick_kind <> 'CRITICAL' AND g = 1 AND passes THEN 'APPROVED' ELSE 'CONDITIONAL' END AS decision FROM j)""",
)
def _(spark, d):
    return K.underwriting(companies(spark, d))


@query(
    "num_native_ratios",
    f"""{COMPANY_SQL}, r AS (SELECT id, ebitda - capex AS noi, principal + interest AS service, cash + securities + receivable AS liquid, liabilities FROM company),
    q AS (SELECT *, CASE WHEN service <= 0 THEN 9990000 ELSE sign(noi) * (abs(noi) * 10000 // nullif(service, 0)) END AS cover, CASE WHEN liabilities <= 0 THEN 9990000 ELSE liquid * 10000 // nullif(liabilities, 0) END AS quick FROM r)
    SELECT id, CAST(cover AS BIGINT) AS cover_bps, CASE WHEN service <= 0 THEN 'DEBT_FREE' WHEN noi <= 0 OR cover < 10000 THEN 'DISTRESSED' WHEN cover < 13000 THEN 'WATCHLIST' ELSE 'HEALTHY' END AS cover_kind, CAST(quick AS BIGINT) AS quick_bps, CASE WHEN quick >= 10000 THEN 'STRONG' WHEN quick >= 8000 THEN 'ADEQUATE' ELSE 'CRITICAL' END AS quick_kind FROM q""",
)
def _(spark, d):
    cover, kind = K.native_coverage(F.col("ebitda"), F.col("capex"), F.col("principal") + F.col("interest"))
    quick, liquid = K.native_quick(F.col("cash") + F.col("securities") + F.col("receivable"), F.col("liabilities"))
    return companies(spark, d).select("id", cover.alias("cover_bps"), kind.alias("cover_kind"), quick.alias("quick_bps"), liquid.alias("quick_kind"))


@query(
    "agg_income_tax_final",
    f"{COMPANY_SQL}, t AS (SELECT id, CASE WHEN ebit + inventory > 0 THEN (ebit + inventory) * 2000 // 10000 ELSE 0 END AS due, receivable AS paid FROM company) SELECT id, CAST(due AS BIGINT) AS due, CAST(greatest(due - paid, 0) AS BIGINT) AS to_pay, CAST(greatest(paid - due, 0) AS BIGINT) AS overpaid FROM t",
)
def _(spark, d):
    due, to_pay, overpaid = K.income_tax_final(F.col("ebit"), F.col("inventory"), F.col("receivable"))
    return companies(spark, d).select("id", due.alias("due"), to_pay.alias("to_pay"), overpaid.alias("overpaid"))


@query(
    "num_certificates",
    f"{BANK}, b AS (SELECT customer, CAST(sum(amount) AS BIGINT) AS closing FROM bank GROUP BY 1), i AS (SELECT customer, CAST(sum(amount) AS BIGINT) AS ledger, CAST(sum(CASE WHEN invoice_id % 10 = 9 THEN amount ELSE 0 END) AS BIGINT) AS transit FROM inv GROUP BY 1) SELECT customer, closing + transit AS adjusted, closing + transit - ledger AS variance, closing + transit = ledger AS certified FROM b JOIN i USING (customer)",
)
def _(spark, d):
    """Each customer's payments and open invoices against all its invoices."""
    closing = bank_lines(spark, d).groupBy("customer").agg(F.sum("amount").alias("closing"))
    ledger = invoices(spark, d).groupBy("customer").agg(F.sum("amount").alias("ledger"), F.sum(F.when(F.col("invoice_id") % 10 == 9, F.col("amount")).otherwise(0)).alias("transit"))
    adjusted, variance, certified = K.certificate(F.col("closing"), F.col("transit"), F.lit(0).cast("long"), F.col("ledger"))
    return closing.join(ledger, "customer").select("customer", adjusted.alias("adjusted"), variance.alias("variance"), certified.alias("certified"))


@query(
    "num_quarantine_tiers",
    f"{TXN} SELECT tx_id, CASE WHEN tx_id % 50 = 0 OR amount * 20000 >= 400000000 THEN 'CRITICAL' WHEN amount * 20000 >= 100000000 THEN 'HIGH' WHEN amount * 20000 >= 10000000 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM txn",
)
def _(spark, d):
    return transactions(spark, d).select("tx_id", K.quarantine_tier(F.col("amount") * 20_000, F.col("tx_id") % 50 == 0).alias("tier"))


@query(
    "num_report_actions",
    f"{TXN}, s AS (SELECT tx_id, CASE tx_id % 4 WHEN 0 THEN 85 WHEN 1 THEN 60 WHEN 2 THEN 35 ELSE 5 END AS score FROM txn) SELECT tx_id, score, CASE WHEN score >= 80 THEN 'FILE_REPORT' WHEN score >= 50 THEN 'COMPLIANCE_HOLD' ELSE 'ENHANCED_DUE_DILIGENCE' END AS action FROM s",
)
def _(spark, d):
    severity = F.element_at(F.array(*[F.lit(x) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]), (F.col("tx_id") % 4 + 1).cast("int"))
    score, action = K.report_action(severity, {"CRITICAL": 85, "HIGH": 60, "MEDIUM": 35})
    return transactions(spark, d).select("tx_id", score.alias("score"), action.alias("action"))


@query(
    "win_cash_horizon",
    f"""{TXN}, f AS (SELECT account, ts // 86400 - 19722 AS day, sum(CASE WHEN is_credit THEN amount ELSE -amount END) AS net FROM txn GROUP BY 1, 2),
    p AS (SELECT a.account, day, 20000 + coalesce(sum(net) OVER (PARTITION BY a.account ORDER BY day), 0) AS balance FROM (SELECT account, unnest(range(1, 21)) AS day FROM (SELECT DISTINCT account FROM txn)) a LEFT JOIN f USING (account, day))
    SELECT account, CAST(arg_max(balance, day) AS BIGINT) AS end_balance, CAST(least(20000, min(balance)) AS BIGINT) AS lowest, CAST(min(CASE WHEN balance < 15000 THEN day END) AS INT) AS first_below, least(20000, min(balance)) < 15000 AS short FROM p GROUP BY account""",
)
def _(spark, d):
    t = transactions(spark, d)
    flows = t.select("account", F.expr("ts DIV 86400 - 19722").alias("day"), F.when(F.col("is_credit"), F.col("amount")).otherwise(-F.col("amount")).alias("net"))
    return K.cash_horizon(flows, t.select("account").distinct().withColumn("start", F.lit(20_000).cast("long")), 15_000, 20)
