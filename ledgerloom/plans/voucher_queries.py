"""Queries of vouchers, the other screens and matching forms, chains, JSON helpers and stated facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import documents as J
from ledgerloom.operators import reconcile as R
from ledgerloom.operators import records as C
from ledgerloom.operators import retrieval as V
from ledgerloom.operators import surveillance as S
from ledgerloom.operators import vouchers as W
from ledgerloom.plans.registry import BANK, EXACT, TXN, query
from ledgerloom.plans.session import shared_checkpoints
from ledgerloom.sources.adapters import bank_lines, invoices, table, transactions

KINDS = ["RECEIPT", "PAYMENT", "RECEIPT_WITH_FEE", "FEE", "FIXED", "SETTLED", "NONE"]
SLIPS = f"slips AS (SELECT tx_id AS voucher_id, {KINDS!r}[tx_id % 7 + 1] AS kind, is_credit, amount, CASE WHEN tx_id % 2 = 0 THEN 110 END AS fee, CASE WHEN tx_id % 3 = 0 THEN amount + 50 END AS invoice_amount, '1121' AS bank_account, CASE WHEN tx_id % 5 = 0 THEN '1388' END AS partner_account FROM txn)"
PARTNER = "coalesce(partner_account, CASE WHEN is_credit THEN '131' ELSE '331' END)"
NET = "CASE WHEN amount < 2 OR amount * 10000 // 11000 = 0 THEN amount ELSE amount * 10000 // 11000 END"
VOUCHERS = f"""vl AS (SELECT * FROM (
    SELECT voucher_id, kind, unnest([bank_account, {PARTNER}]) AS account, unnest(['D', 'C']) AS side, unnest([amount, amount]) AS amount FROM slips WHERE kind = 'RECEIPT'
    UNION ALL SELECT voucher_id, kind, unnest([{PARTNER}, bank_account]), unnest(['D', 'C']), unnest([amount, amount]) FROM slips WHERE kind = 'PAYMENT'
    UNION ALL SELECT voucher_id, kind, unnest([bank_account, '6427', {PARTNER}]), unnest(['D', 'D', 'C']), unnest([amount - coalesce(fee, 0), coalesce(fee, 0), amount]) FROM slips WHERE kind = 'RECEIPT_WITH_FEE'
    UNION ALL SELECT voucher_id, kind, unnest(['6427', '1331', bank_account]), unnest(['D', 'D', 'C']), unnest([{NET}, amount - {NET}, amount]) FROM slips WHERE kind = 'FEE'
    UNION ALL SELECT voucher_id, kind, unnest(['6425', bank_account]), unnest(['D', 'C']), unnest([500, 500]) FROM slips WHERE kind = 'FIXED'
    UNION ALL SELECT voucher_id, kind, unnest([bank_account, '131']), unnest(['D', 'C']), unnest([coalesce(invoice_amount, amount), amount]) FROM slips WHERE kind = 'SETTLED') WHERE amount > 0)"""


def slips(spark, d) -> DataFrame:
    k = F.col("tx_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 7 + 1).cast("int"))
    return transactions(spark, d).select(k.alias("voucher_id"), kind.alias("kind"), "is_credit", "amount", F.when(k % 2 == 0, F.lit(110).cast("long")).alias("fee"), F.when(k % 3 == 0, F.col("amount") + 50).alias("invoice_amount"), F.lit("1121").alias("bank_account"), F.when(k % 5 == 0, "1388").alias("partner_account"))


@query("num_voucher_lines", f"{TXN}, {SLIPS}, {VOUCHERS} SELECT voucher_id, kind, account, side, CAST(amount AS BIGINT) AS amount FROM vl")
def _(spark, d):
    return W.voucher_lines(slips(spark, d))


@query("agg_voucher_checks", f"{TXN}, {SLIPS}, {VOUCHERS}, s AS (SELECT voucher_id, CAST(sum(CASE WHEN side = 'D' THEN amount ELSE 0 END) AS BIGINT) AS debit, CAST(sum(CASE WHEN side = 'C' THEN amount ELSE 0 END) AS BIGINT) AS credit, count(*) AS n_lines FROM vl GROUP BY 1) SELECT *, CASE WHEN n_lines < 2 THEN 'TOO_FEW_LINES' WHEN debit <> credit THEN 'UNBALANCED' ELSE 'DRAFT' END AS status FROM s")
def _(spark, d):
    return W.voucher_checks(W.voucher_lines(slips(spark, d)))


@query(
    "sink_voucher_xml",
    f"""{TXN}, {SLIPS}, {VOUCHERS} SELECT voucher_id, '<VoucherData><Header><VoucherNo>' || voucher_id || '</VoucherNo><TotalAmount>' || CAST(sum(CASE WHEN side = 'D' THEN amount ELSE 0 END) AS BIGINT) || '</TotalAmount></Header><Details>' ||
    string_agg('<Line><AccountCode>' || account || '</AccountCode><PostingType>' || CASE side WHEN 'D' THEN 'Nợ' ELSE 'Có' END || '</PostingType><Amount>' || amount || '</Amount></Line>', '' ORDER BY account, side, CAST(amount AS VARCHAR)) || '</Details></VoucherData>' AS xml FROM vl GROUP BY voucher_id""",
)
def _(spark, d):
    return W.as_xml(W.voucher_lines(slips(spark, d)))


@query("num_vouchers_of_matches", f"{BANK}, e AS ({EXACT}), m AS (SELECT line_id, amount FROM bank WHERE line_id IN (SELECT line_id FROM e)) SELECT line_id AS voucher_id, 'SETTLED' AS kind, unnest(['1121', '131']) AS account, unnest(['D', 'C']) AS side, amount FROM m")
def _(spark, d):
    """Receipts of the lines that tier 1 matched."""
    lines, inv = bank_lines(spark, d), invoices(spark, d)
    met = R.exact_edges(lines, inv).select("line_id").distinct().join(lines, "line_id")
    none = F.lit(None).cast("long")
    rows = met.select(F.col("line_id").alias("voucher_id"), F.lit("SETTLED").alias("kind"), F.lit(True).alias("is_credit"), "amount", none.alias("fee"), none.alias("invoice_amount"), F.lit("1121").alias("bank_account"), F.lit(None).cast("string").alias("partner_account"))
    return W.voucher_lines(rows)


@query("sink_match_status", f"{BANK}, e AS ({EXACT}) SELECT line_id, CASE WHEN line_id IN (SELECT line_id FROM e) THEN 'MATCHED' ELSE 'UNMATCHED' END AS status FROM bank")
def _(spark, d):
    lines = bank_lines(spark, d).withColumn("status", F.lit("UNMATCHED"))
    return R.settled(lines, R.exact_edges(lines, invoices(spark, d)), "line_id").select("line_id", "status")


@query("io_insert_or_ignore", "SELECT c_custkey, c_mktsegment AS segment FROM customer UNION ALL SELECT -c_custkey, 'X' FROM customer WHERE c_custkey % 50 = 0 AND c_custkey <> 0")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = c.where("c_custkey % 50 = 0").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("X").alias("segment"))
    return C.insert_or_ignore(c, new, "c_custkey")


CITED = """ln AS (SELECT line_id, ref, 'ck thanh toan HD ' || lpad(CAST(line_id AS VARCHAR), 8, '0') || CASE WHEN line_id % 4 = 0 THEN ' va INV-2024-' || lpad(CAST(line_id AS VARCHAR), 5, '0') ELSE '' END AS narration, CASE WHEN line_id % 6 = 0 THEN 'D' ELSE 'C' END AS direction, amount, ts FROM bank),
    en AS (SELECT invoice_id AS entry_id, CASE WHEN invoice_id % 4 = 0 THEN 'INV' || lpad(CAST(invoice_id AS VARCHAR), 5, '0') ELSE doc_ref END AS doc_no, 'C' AS direction, amount, ts, party AS partner FROM inv)"""


def cited_lines(spark, d) -> DataFrame:
    k = F.col("line_id")
    said = F.concat(F.lit("ck thanh toan HD "), F.lpad(k.cast("string"), 8, "0"), F.when(k % 4 == 0, F.concat(F.lit(" va INV-2024-"), F.lpad(k.cast("string"), 5, "0"))).otherwise(""))
    return bank_lines(spark, d).select(k, "ref", said.alias("narration"), F.when(k % 6 == 0, "D").otherwise("C").alias("direction"), "amount", "ts")


def cited_entries(spark, d) -> DataFrame:
    k = F.col("invoice_id")
    return invoices(spark, d).select(k.alias("entry_id"), F.when(k % 4 == 0, F.concat(F.lit("INV"), F.lpad(k.cast("string"), 5, "0"))).otherwise(F.col("doc_ref")).alias("doc_no"), F.lit("C").alias("direction"), "amount", "ts", F.col("party").alias("partner"))


@query("join_cited_edges", f"{BANK}, {CITED} SELECT line_id, entry_id FROM ln JOIN en ON line_id = entry_id AND ln.amount = en.amount AND ln.direction = en.direction AND abs(ln.ts - en.ts) <= 86400 AND line_id % 4 <> 0")
def _(spark, d):
    return R.cited_edges(cited_lines(spark, d), cited_entries(spark, d))


@query("join_cited_without_year", f"{BANK}, {CITED} SELECT line_id, entry_id FROM ln JOIN en ON line_id = entry_id AND ln.amount = en.amount AND ln.direction = en.direction AND (abs(ln.ts - en.ts) <= 86400 OR ln.ts // 86400 = en.ts // 86400)")
def _(spark, d):
    return R.cited_edges(cited_lines(spark, d), cited_entries(spark, d), without_year=True)


# the year in INV-2024-.. is a reference of its own too, to invoice 2024
@query(
    "join_remark_links",
    f"""{BANK}, {CITED} SELECT line_id, entry_id, 0.99 + 0.0::DOUBLE AS score FROM ln JOIN en ON line_id = entry_id AND line_id % 4 <> 0
    UNION ALL SELECT line_id, b.invoice_id, CASE WHEN a.party = b.party THEN 0.99 ELSE 0.85 END FROM ln JOIN inv a ON a.invoice_id = line_id JOIN inv b ON b.invoice_id = 2024 WHERE line_id % 4 = 0""",
)
def _(spark, d):
    said = F.concat("narration", F.lit(" cho "), "who")
    lines = cited_lines(spark, d).join(cited_entries(spark, d).select(F.col("entry_id").alias("line_id"), F.col("partner").alias("who")), "line_id").withColumn("narration", said)
    return R.remark_links(lines, cited_entries(spark, d))


# --- the other screens --------------------------------------------------------------------------------------------------------------

ANYPAIR = "SELECT i.tx_id AS in_id, o.tx_id AS out_id FROM txn i JOIN txn o ON i.is_credit AND NOT o.is_credit AND i.amount >= 2000 AND o.ts BETWEEN i.ts AND i.ts + 900 AND o.amount >= i.amount * 95 // 100"
PLAIN = f"""fwd AS (SELECT *, CAST(count(*) OVER w >= 3 AND sum(amount) OVER w >= 40000 AS INT) AS hit FROM txn WHERE amount < 20000 WINDOW w AS (PARTITION BY account ORDER BY ts RANGE BETWEEN CURRENT ROW AND 259200 FOLLOWING)),
    al AS (SELECT tx_id, 'HIGH_VALUE' AS rule, CASE WHEN amount >= 30000 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM txn WHERE amount >= 20000
    UNION ALL SELECT tx_id, 'STRUCTURING', 'HIGH' FROM (SELECT *, max(hit) OVER (PARTITION BY account ORDER BY ts RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW) AS member FROM fwd) WHERE member = 1
    UNION ALL SELECT out_id, 'PASS_THROUGH', 'CRITICAL' FROM ({ANYPAIR}))"""


@query("join_any_account_pairs", f"{TXN} {ANYPAIR}")
def _(spark, d):
    return S.any_account_pairs(transactions(spark, d))


@query("aml_plain_screen", f"{TXN}, {PLAIN} SELECT * FROM al")
def _(spark, d):
    return S.plain_screen(transactions(spark, d))


@query(
    "aml_plain_report",
    f"""{TXN}, {PLAIN}, s AS (SELECT account, count(severity) AS n, coalesce(sum(CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 20 END), 0) AS s, coalesce(bool_or(severity = 'CRITICAL'), false) AS c FROM txn LEFT JOIN al USING (tx_id) GROUP BY 1)
    SELECT account, n AS alerts, CAST(least(s, 100) AS INT) AS risk_score, CASE WHEN least(s, 100) >= 70 OR c THEN 'FILE_REPORT' WHEN s >= 40 THEN 'COMPLIANCE_HOLD' WHEN n > 0 THEN 'ENHANCED_DUE_DILIGENCE' ELSE 'NORMAL' END AS action FROM s""",
)
def _(spark, d):
    tx = transactions(spark, d)
    alerts = S.plain_counts(tx).join(tx.select("tx_id", "account"), "tx_id")
    return S.plain_report(alerts, tx.select("account").distinct(), "account")


@query("aml_risk_profiles", f"{TXN} SELECT tx_id, CASE WHEN amount % 10001 >= 7000 THEN 'CRITICAL' WHEN amount % 10001 >= 5000 THEN 'HIGH' WHEN amount % 10001 >= 2500 THEN 'MEDIUM' ELSE 'LOW' END AS profile FROM txn")
def _(spark, d):
    return transactions(spark, d).select("tx_id", S.risk_profile(F.col("amount") % 10_001).alias("profile"))


# --- hashes and documents ---------------------------------------------------------------------------------------------------------------

KEY = b"audit key"
INNER, OUTER = ("".join(f"{b ^ pad:02x}" for b in KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C))


@query("bin_hmac", f"{TXN} SELECT tx_id, sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(narration)))) AS mac FROM txn")
def _(spark, d):
    return transactions(spark, d).select("tx_id", C.hmac_sha256(KEY, F.encode("narration", "UTF-8")).alias("mac"))


def _mac(payload: str) -> str:
    return f"sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode('p' || ts || 'ae' || sha256(encode({payload}))))))"


@query("win_chain_records", f"{TXN} SELECT tx_id AS seq_id, {_mac('narration')} = {_mac('CASE WHEN tx_id % 10 = 0 THEN $$other$$ ELSE narration END')} AS sound FROM txn")
def _(spark, d):
    """Records whose hash was made over other fields are found."""
    tx = transactions(spark, d)
    body = F.encode(F.concat(F.lit("p"), F.col("ts").cast("string"), F.lit("a"), F.lit("e"), F.sha2(F.encode("narration", "UTF-8"), 256)), "UTF-8")
    rows = tx.select(F.col("tx_id").alias("seq_id"), F.lit("p").alias("prev_hash"), "ts", F.lit("a").alias("actor"), F.lit("e").alias("event"), F.when(F.col("tx_id") % 10 == 0, "other").otherwise(F.col("narration")).alias("payload"), C.hmac_sha256(KEY, body).alias("record_hash"))
    return C.chain_records(rows, KEY).select("seq_id", "sound")


@query("bin_merkle_proofs")
def _(spark, d):
    """A proof for each event of each user; the tests lead every one back to its root."""
    shared_checkpoints(spark)
    return C.merkle_proofs(table(spark, d, "events"), "user_id", "event_id", "event_id")


BLOB = "'{\"z\": ' || tx_id || ', \"a\": {\"my_token\": \"t' || tx_id || '\", \"x\": [1, true]}, \"acc_stk\": \"9\"}'"


@query("json_canonical", f"""{TXN} SELECT tx_id, '{{"a":{{"my_token":"t' || tx_id || '","x":[1,true]}},"acc_stk":"9","z":' || tx_id || '}}' AS canonical, '{{"z": ' || tx_id || ', "a": {{"my_token": "[REDACTED_SECRET]", "x": [1, true]}}, "acc_stk": "[REDACTED_BANK_ACCOUNT]"}}' AS hidden, tx_id >= 500 AS fits FROM txn""")
def _(spark, d):
    text = F.expr(BLOB)
    schema = {"type": "object", "required": ["z", "a"], "properties": {"z": {"type": "integer"}, "a": {"type": "object", "properties": {"x": {"type": "array"}}}}}
    ok = J.meets_schema(F.when(F.col("tx_id") >= 500, text).otherwise(F.lit('{"z": "no", "a": {}}')), schema)
    return transactions(spark, d).select("tx_id", J.canonical_json(text).alias("canonical"), J.hide_keys(text).alias("hidden"), ok.alias("fits"))


def _clean(x: str) -> str:
    edge = J.EDGE.replace("'", "''")
    return f"trim(regexp_replace(trim(regexp_replace(trim({x}), '{J.OPENING}', '', 'i')), '{edge}', '', 'g'))"


def _named(x: str) -> str:
    return f"(length({x}) BETWEEN 2 AND 80 AND NOT list_contains({J.PRONOUNS!r}, lower({x})) AND regexp_matches({x}, '[\\p{{L}}\\p{{N}}]'))"


TOLD = "[" + ", ".join(f"{{'relation': '{r}', 'phrase': '{p}'}}" for r, p in J.PHRASES) + "]"
#: Each third turn is given a link and a stated fact, as the invented prose states few.
SPOKEN = "CASE WHEN conv_id % 3 = 0 THEN text || chr(10) || 'User: see [[Node ' || conv_id % 7 || ']] and [[B|b]], yes, Anna works at (Acme ' || turn || '). Well Ha Noi is the capital of Viet Nam; she IS a friend of it' ELSE text END"
FACT_SQL = f"""WITH c AS (SELECT conv_id, turn, {SPOKEN} AS text FROM conversations),
    l AS (SELECT conv_id, turn, text, list_transform(list_filter(list_transform(regexp_extract_all(text, '(?s){J.LINK}', 1), lambda x: trim(split_part(x, '|', 1))), lambda x: strlen(x) BETWEEN 1 AND 80), lambda x: {_clean("x")}) AS links,
        list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '(?im){J.ROLE}', '', 'g'), '{J.CLAUSE_END}'), lambda x: trim(x)), lambda x: strlen(x) >= 5) AS clauses FROM c),
    s AS (SELECT *, list_filter(list_transform(clauses, lambda c: list_filter(list_transform(list_filter({TOLD}, lambda p: contains(lower(c), p.phrase)),
            lambda p: {{'subject': {_clean("c[1 : instr(lower(c), p.phrase) - 1]")}, 'relation': p.relation, 'object': {_clean("c[instr(lower(c), p.phrase) + length(p.phrase) :]")}}}),
            lambda t: {_named("t.subject")} AND {_named("t.object")} AND lower(t.subject) <> lower(t.object))), lambda told: len(told) > 0) AS told,
        list_distinct(list_filter(list_transform(range(1, len(links)), lambda i: {{'subject': links[i], 'relation': 'links_to', 'object': links[i + 1]}}), lambda t: t.subject <> t.object)) AS beside FROM l),
    f AS (SELECT conv_id, turn, unnest(list_reduce(list_prepend(beside, told), lambda found, new: list_concat(found, list_filter(new, lambda t: NOT list_contains(found, t))[1:1]))) AS t FROM s)
    SELECT conv_id, turn, t.subject AS subject, t.relation AS relation, t.object AS object FROM f"""


def facts(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.expr(SPOKEN).alias("text"))
    return turns.select("conv_id", "turn", F.inline(J.triples(F.col("text"))))


@query("graph_triples", FACT_SQL)
def _(spark, d):
    """Links and stated facts of every turn of every conversation."""
    return facts(spark, d)





@query(
    "graph_fact_edges",
    f"""WITH said AS ({FACT_SQL}), e AS (SELECT subject AS source, object AS target, relation, 1.0 / (turn + 1) AS weight, conv_id * 1000 + turn AS ts FROM said),
    b AS (SELECT * FROM e UNION ALL SELECT target, source, relation, weight, ts FROM e) SELECT source, target, relation, round(arg_max(weight, (ts, weight)), 9) AS weight, max(ts) AS ts FROM b GROUP BY 1, 2, 3""",
)
def _(spark, d):
    """The facts of all turns as edges both ways; what is said last of a pair and relation counts."""
    new = facts(spark, d).select(F.col("subject").alias("source"), F.col("object").alias("target"), "relation", (1 / (F.col("turn") + 1)).alias("weight"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ts"))
    return V.edge_upsert(new.limit(0), new).withColumn("weight", F.round("weight", 9))
