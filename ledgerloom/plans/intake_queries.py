"""Queries of files in other forms: XML messages, workbooks, HTML, JSON ledgers; and encrypted fields. Files hold the bank lines of a customer, a new one for
each hundred thousand line numbers, as files do in life."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ledgerloom.functions import crypt
from ledgerloom.plans.registry import BANK, query
from ledgerloom.sources import iso20022, json_ledgers, sheets
from ledgerloom.sources.adapters import bank_lines, table

PER_FILE = 100_000
LINES = f"lines AS (SELECT *, 'f' || customer || '-' || (line_id // {PER_FILE}) AS file, row_number() OVER (PARTITION BY customer, line_id // {PER_FILE} ORDER BY line_id) AS row_id FROM bank WHERE amount > 0)"


def filed(spark, d, line: Column) -> DataFrame:
    """(customer, file, body): the lines of a file, one after another; a file has a bounded number of them."""
    lines = bank_lines(spark, d).where("amount > 0").withColumn("file", F.expr(f"concat('f', customer, '-', line_id DIV {PER_FILE})"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("line_id", line.alias("x")))), lambda r: r["x"])
    return lines.groupBy("customer", "file").agg(held.alias("lines"))


def messages(spark, d) -> DataFrame:
    """Statements for even customers and transfers for odd ones, with and without prefixes, by three channels."""
    p = F.when(F.col("customer") % 4 < 2, "ns:").otherwise("")

    def tag(name: str, *inside: Column) -> Column:
        return F.concat(F.lit("<"), p, F.lit(f"{name}>"), *inside, F.lit("</"), p, F.lit(f"{name}>"))

    def text(name: str, x: Column | str) -> Column:
        return tag(name, F.lit(x) if isinstance(x, str) else x)

    amount, day = F.concat(F.expr("amount DIV 100").cast("string"), F.lit("."), F.lpad((F.col("amount") % 100).cast("string"), 2, "0")), F.lit("2024-01-02")
    credit = F.col("line_id") % 2 == 0
    party = tag("RltdPties", F.when(credit, tag("Dbtr", text("Nm", F.col("party")))).otherwise(tag("Cdtr", text("Nm", F.col("party")))), F.when(credit, tag("DbtrAcct", tag("Id", tag("Othr", text("Id", F.col("customer").cast("string")))))).otherwise(""))
    detail = tag("TxDtls", tag("Refs", text("EndToEndId", F.col("ref"))), party, tag("RmtInf", text("Ustrd", "paid &amp; done"), text("Ustrd", "twice")))
    money = F.concat(F.lit("<"), p, F.lit('Amt Ccy="VND">'), amount, F.lit("</"), p, F.lit("Amt>"))
    entry = tag("Ntry", money, F.when(credit, text("CdtDbtInd", "CRDT")).otherwise(text("CdtDbtInd", "DBIT")), tag("BookgDt", text("Dt", day)), tag("NtryDtls", detail))
    settled = F.concat(F.lit("<"), p, F.lit('IntrBkSttlmAmt Ccy="VND">'), amount, F.lit("</"), p, F.lit("IntrBkSttlmAmt>"))
    transfer = tag("CdtTrfTxInf", tag("PmtId", text("TxId", F.concat(F.lit("T"), F.col("line_id").cast("string")))), settled, text("IntrBkSttlmDt", day), tag("Dbtr", text("Nm", F.col("party"))), tag("DbtrAcct", tag("Id", text("IBAN", "VN01"))), tag("CdtrAcct", tag("Id", text("IBAN", F.col("customer").cast("string")))))
    even = F.col("customer") % 2 == 0
    files = filed(spark, d, F.when(even, entry).otherwise(transfer))
    body = F.array_join("lines", "\n")
    number = F.col("customer").cast("string")
    balances = F.concat(*[tag("Bal", tag("Tp", tag("CdOrPrtry", text("Cd", code))), text("Amt", F.concat(number, F.lit(".50"))), text("CdtDbtInd", side)) for code, side in (("OPBD", "CRDT"), ("CLBD", "DBIT"))])
    statement = tag("BkToCstmrStmt", tag("Stmt", tag("Acct", tag("Id", text("IBAN", number))), balances, body))
    inner = F.when(even, statement).otherwise(tag("FIToFICstmrCdtTrf", body))
    space = F.when(p == "", ' xmlns="urn:iso:std:iso:20022"').otherwise(' xmlns:ns="urn:iso:std:iso:20022"')
    said = F.when(F.col("customer") % 5 == 0, "<!-- by NAPAS -->").when(F.col("customer") % 5 == 1, "<!-- nostro -->").otherwise("")
    content = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), F.lit("<"), p, F.lit("Document"), space, F.lit(">"), said, inner, F.lit("</"), p, F.lit("Document>"))
    broken = F.col("customer") % 50 == 49
    return files.select("file", F.when(broken, F.lit("no <xml")).otherwise(content).alias("content"))


CHANNEL = "CASE customer % 5 WHEN 0 THEN 'NAPAS' WHEN 1 THEN 'BILATERAL' ELSE 'CITAD' END"


@query(
    "io_iso20022_rows",
    f"""{BANK}, {LINES} SELECT file, {CHANNEL} AS channel, CASE WHEN customer % 2 = 0 THEN 'camt.053' ELSE 'pacs.008' END AS kind, CAST(customer AS VARCHAR) AS account, row_id,
    CASE WHEN customer % 2 = 1 THEN 'T' || line_id WHEN ref <> '' THEN ref END AS ref_code, CASE WHEN customer % 2 = 1 OR line_id % 2 = 0 THEN 'credit' ELSE 'debit' END AS posting_type, amount, '2024-01-02' AS value_date, party AS counterparty,
    CASE WHEN customer % 2 = 1 THEN 'VN01' WHEN line_id % 2 = 0 THEN CAST(customer AS VARCHAR) END AS counterparty_account, CASE WHEN customer % 2 = 0 THEN 'paid & done twice' END AS narration FROM lines WHERE customer % 50 <> 49""",
)
def _(spark, d):
    """The entries and transfers of XML messages with nested parties."""
    return iso20022.rows(messages(spark, d), places=2)


@query("io_iso20022_balances", f"{BANK}, {LINES} SELECT DISTINCT file, CAST(customer AS VARCHAR) AS account, customer * 100 + 50 AS opening, -(customer * 100 + 50) AS closing FROM lines WHERE customer % 2 = 0 AND customer % 50 <> 49")
def _(spark, d):
    return iso20022.balances(messages(spark, d), places=2)


@F.pandas_udf(BinaryType())
def workbook_of(lines: pd.Series) -> pd.Series:
    """A workbook of a title over four columns, a header, and rows of which each second has its day merged with the one before."""

    def one(held) -> bytes:
        rows = [["Statement", None, None, None], ["Day", "Ref", "Amount", "Party"], *[[cell if k or i % 2 == 0 else None for k, cell in enumerate(r.split("|"))] for i, r in enumerate(held)]]
        return sheets.workbook_bytes("Tháng 1 & 2", rows, ["A1:D1", *[f"A{i}:A{i + 1}" for i in range(3, len(rows), 2)]])

    return lines.map(one)


def row_cells() -> Column:
    """A line as four cells; of its day, which a second row of two has from the row before, only the first stays in the workbook."""
    return F.concat_ws("|", F.concat(F.lit("day "), (F.col("line_id") % 28).cast("string")), F.col("ref"), F.col("amount").cast("string"), F.col("party"))


@query(
    "io_workbook_rows",
    f"""{BANK}, {LINES}, days AS (SELECT file, row_id, 'day ' || CASE WHEN row_id % 2 = 0 THEN lag(line_id) OVER (PARTITION BY file ORDER BY row_id) % 28 ELSE line_id % 28 END || '|' || ref || '|' || amount || '|' || party AS cells FROM lines)
    SELECT file, 'Tháng 1 & 2' AS sheet, row_id + 2 AS row_no, cells FROM days UNION ALL SELECT DISTINCT file, 'Tháng 1 & 2', 1, 'Statement|Statement|Statement|Statement' FROM lines UNION ALL SELECT DISTINCT file, 'Tháng 1 & 2', 2, 'Day|Ref|Amount|Party' FROM lines""",
)
def _(spark, d):
    """All rows of workbooks, merged cells filled."""
    books = filed(spark, d, row_cells()).select("file", workbook_of("lines").alias("content"))
    return sheets.workbooks(books).where("fault IS NULL").select("file", "sheet", "row_no", F.array_join("cells", "|").alias("cells"))


@query(
    "io_html_tables",
    f"""{BANK}, {LINES} SELECT file, CAST(1 AS BIGINT) AS table_no, row_id AS row_no, 'day ' || (line_id % 28) || '|' || ref || '|' || amount || '|' || party AS cells FROM lines
    UNION ALL SELECT DISTINCT file, 1, 0, 'Day|Ref <no>|Amount|Party' FROM lines UNION ALL SELECT DISTINCT file, 0, 0, 'a b|c' FROM lines""",
)
def _(spark, d):
    """The tables of statements in HTML."""
    row = F.concat(F.lit("<tr><td class='d'>"), F.array_join(F.split(row_cells(), r"\|"), "</td>\n<td>"), F.lit("</td></tr>"))
    head = "<html><!-- <table><tr><td>no</td></tr></table> --><TABLE border=0><tr><td>a&nbsp;<b>b</b><td>c</tr></TABLE><table><tr><th>Day<th>Ref &lt;no&gt;</th><th>Amount</th><th>Party</th></tr>"
    pages = filed(spark, d, row).select("file", F.concat(F.lit(head), F.array_join("lines", "\n"), F.lit("</table></html>")).alias("html"))
    return sheets.html_rows(pages, "file", "html").withColumn("cells", F.array_join("cells", "|"))


ITEM = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(
    "io_page_lists",
    f"""WITH p AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g'), '(?is)<ul(?:\\s[^>]*)?>(.*?)</ul>', 1) AS lists FROM pages),
    l AS (SELECT page_id, unnest(lists) AS l, unnest(range(len(lists))) AS table_no FROM p), r AS (SELECT page_id, table_no, regexp_extract_all(l, '(?is)<li(?:\\s[^>]*)?>(.*?)</li>', 1) AS items FROM l),
    i AS (SELECT page_id, table_no, unnest(items) AS x, unnest(range(len(items))) AS row_no FROM r) SELECT page_id, table_no, row_no, {ITEM} AS item FROM i""",
)
def _(spark, d):
    """Every list of every page, item by item."""
    return sheets.html_rows(table(spark, d, "pages"), "page_id", "html", "ul", "li", "").select("page_id", "table_no", "row_no", F.get("cells", F.lit(0)).alias("item"))


def ledgers(spark, d) -> DataFrame:
    """JSON ledgers in three forms; every seventh customer's is cut off, and some amounts are texts or absent."""
    amount = F.when(F.col("line_id") % 11 == 0, F.lit(None)).when(F.col("line_id") % 5 == 0, F.concat(F.lit('"'), F.col("amount").cast("string"), F.lit('"'))).otherwise(F.col("amount").cast("string"))
    entry = F.concat(F.lit('{"id": "E'), F.col("line_id").cast("string"), F.lit('", "doc_no": "'), F.col("ref"), F.lit('", "partner_name": "'), F.col("party"), F.lit('"'), F.coalesce(F.concat(F.lit(', "amount": '), amount), F.lit("")), F.lit(', "more": {"x": [1]}}'))
    files, kind = filed(spark, d, entry), F.col("customer") % 3
    whole = F.concat(F.lit("["), F.array_join("lines", ", "), F.lit("]"))
    content = F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit('{"entries": '), whole, F.lit("}"))).otherwise(F.get("lines", F.lit(0)))
    return files.select("file", F.when(F.col("customer") % 7 == 3, F.substring(content, F.lit(1), F.length(content) - 2)).otherwise(content).alias("content"))


@query(
    "io_json_ledger",
    f"{BANK}, {LINES} SELECT file, row_id - 1 AS entry_no, 'E' || line_id AS id, ref AS doc_no, party AS partner_name, CASE WHEN line_id % 11 <> 0 THEN amount END AS amount FROM lines WHERE customer % 7 <> 3 AND (customer % 3 < 2 OR row_id = 1)",
)
def _(spark, d):
    return json_ledgers.ledger_json(ledgers(spark, d)).select("file", "entry_no", "id", "doc_no", "partner_name", "amount")


@query("io_json_rejected", f"{BANK}, {LINES} SELECT DISTINCT file, 'no JSON' AS reason FROM lines WHERE customer % 7 = 3")
def _(spark, d):
    return json_ledgers.rejected_json(ledgers(spark, d))


@query("io_event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    """The properties of every event, as variants."""
    return table(spark, d, "events").select("event_id", json_ledgers.field(F.try_parse_json("props"), "k", "long").alias("k"))


@query(
    "sec_field_encryption",
    "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS opened, NULL::VARCHAR AS moved, CASE WHEN c_custkey % 3 < 2 THEN length(c_name) END AS plain_length, CASE WHEN c_custkey % 3 < 2 THEN 1 ELSE 0 END AS alike FROM customer",
)
def _(spark, d):
    """Names encrypted and opened again; in another row's place they do not open, nor with no key; and how many other customers share a cipher text."""
    keys = spark.createDataFrame([(0, b"0123456789abcdef"), (1, b"0123456789abcdef0123456789abcdef")], "key_id int, key binary")
    names = table(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 3).cast("int").alias("k"))
    from ledgerloom.plans.storage import stored, workspace

    closed = stored(crypt.encrypt_fields(names.withColumn("sealed", F.col("c_name")), ["sealed"], keys, "k", "c_custkey"), f"{workspace(spark)}/sealed")
    opened = crypt.decrypt_fields(closed, ["sealed"], keys, "k", "c_custkey").select("c_custkey", F.col("sealed").alias("opened"))
    other = crypt.decrypt_fields(closed.select((F.col("c_custkey") + 3).alias("c_custkey"), "k", "sealed"), ["sealed"], keys, "k", "c_custkey").select((F.col("c_custkey") - 3).alias("c_custkey"), F.col("sealed").alias("moved"))
    alike = closed.groupBy("sealed").agg(F.count("*").alias("alike")).where("sealed IS NOT NULL")
    size = (F.octet_length(F.unbase64("sealed")) - 28).cast("long")
    return closed.join(opened, "c_custkey").join(other, "c_custkey").join(alike, "sealed", "left").select("c_custkey", "c_name", "opened", "moved", size.alias("plain_length"), F.coalesce("alike", F.lit(0)).cast("int").alias("alike"))
