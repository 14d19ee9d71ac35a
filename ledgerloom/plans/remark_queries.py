"""Queries of remarks, dictionaries, contacts, templates with fallback, and small filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import remarks
from ledgerloom.operators import browse
from ledgerloom.operators.records import top_per_group
from ledgerloom.plans.mask_queries import BOTH, literal, texts
from ledgerloom.plans.party_queries import PAIR_SQL, UP, pairs
from ledgerloom.plans.registry import BANK, TXN, query
from ledgerloom.sources import iso20022, statements, templates
from ledgerloom.sources.adapters import bank_lines, table, transactions
from ledgerloom.sources.templates import Parser

MEMOS = [
    "CK tien hd 88 va hd-2026-77", "TT hdon 131 MST 0312345678-001", "tam ung luong d1 gd2", "CK...TIEN,,MAY--BOM//HD::88", "phi dv thang 3", "luong T3 NPS123456 ft0099887766", "rut tien 0912345678 +84987654321", "dieu chuyen noi bo VN1234567", "thanh toan INV_001/A so 4910",
    "chuyển khoản HĐ 15 đặt cọc", "hello", "VAT gtgt ib mb 0312345678", "0312345678901 BIDV12345",
]
WITH_MEMOS = "WITH " + BOTH.format(literal(MEMOS), len(MEMOS))


def _list(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_extract_all({x}, '{flags}{pattern}', 1)"


def _once(x: str) -> str:
    """A list without repeats, in its order."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


LOW = "lower(trim(text))"
FOUND = f"list_transform({_list(LOW, chr(92) + 'b' + remarks.INVOICE + chr(92) + 'b')}, lambda e: upper(e))"
DENSE = f"list_transform({_list(LOW, remarks.DENSE)}, lambda e: upper(e))[1:1]"


@query(
    "txt_entities",
    f"""{WITH_MEMOS}, e AS (SELECT kind, id, CAST(turn AS BIGINT) AS turn, {FOUND} AS found, {DENSE} AS dense, {_list('text', chr(92) + 'b' + remarks.TAX + chr(92) + 'b')} AS tax, {_list('text', remarks.PHONE + chr(92) + 'b')} AS phone,
        list_transform({_list('text', chr(92) + 'b' + remarks.TRACE + chr(92) + 'b', '(?i)')}, lambda e: upper(e)) AS trace FROM t)
    SELECT kind, id, turn, array_to_string({_once('(CASE WHEN len(found) > 0 THEN found ELSE dense END)')}, ',') AS invoices, array_to_string({_once('tax')}, ',') AS tax_codes, array_to_string({_once('phone')}, ',') AS phones, array_to_string({_once('trace')}, ',') AS traces FROM e""",
)
def _(spark, d):
    """Invoices, tax codes, phones and traces in every text and turn."""
    found = texts(spark, d, MEMOS).select("kind", "id", "turn", remarks.entities(F.col("text")).alias("e"))
    return found.select("kind", "id", "turn", *[F.array_join(f"e.{c}", ",").alias(c) for c in ("invoices", "tax_codes", "phones", "traces")])


FORMS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in remarks.ABBREVIATIONS.items()) + "}"
EXPANDED = f"array_to_string(list_transform(list_filter(regexp_split_to_array(lower(trim(text)), '[^\\p{{L}}\\p{{M}}0-9_]+'), lambda w: w <> ''), lambda w: coalesce({FORMS}[w], w)), ' ')"


def _case(field: int) -> str:
    out = "CASE"
    for name, sure, plain, bare in remarks.INTENTS:
        hits = [f"regexp_matches({x}, '{p}')" for x, p in (("n", plain), ("lower(replace(replace(strip_accents(n), 'đ', 'd'), 'Đ', 'D'))", bare)) if p]
        out += f" WHEN {' OR '.join(hits)} THEN " + (f"'{name}'" if field == 0 else str(sure))
    return out + (" ELSE 'OTHER' END" if field == 0 else " ELSE 0.5 END")


@query("txt_intents", f"{WITH_MEMOS}, e AS (SELECT kind, id, CAST(turn AS BIGINT) AS turn, {EXPANDED} AS n FROM t) SELECT kind, id, turn, sha256(n) AS normalized_sha256, {_case(0)} AS intent, CAST({_case(1)} AS DOUBLE) AS confidence FROM e")
def _(spark, d):
    """Every text and turn with short forms written out, and what it is for."""
    rows = texts(spark, d, MEMOS).select("kind", "id", "turn", remarks.expanded(F.col("text")).alias("n"))
    return rows.withColumn("i", remarks.intent(F.col("n"))).select("kind", "id", "turn", F.sha2(F.col("n").cast("binary"), 256).alias("normalized_sha256"), "i.intent", "i.confidence")


PATTERNS = r"SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]{9,}')) AS pattern FROM conversations"


@query(
    "txt_dictionary_hits",
    f"""WITH p AS ({PATTERNS}) SELECT pattern, count(*) AS docs, CAST(min(instr(text, pattern) - 1) AS BIGINT) AS least_start
    FROM p JOIN documents ON contains(text, pattern) GROUP BY pattern""",
)
def _(spark, d):
    """Every long word of the conversations in every document."""
    words = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]{9,})"), F.lit(1))).alias("pattern"))
    found = remarks.dictionary_hits(table(spark, d, "documents"), words, "doc_id", "text")
    return found.groupBy("pattern").agg(F.count_distinct("doc_id").alias("docs"), F.min("start").alias("least_start"))


@query("txt_contact_keys", f"WITH {PAIR_SQL} SELECT id, trim(regexp_replace(lower({UP.format('name')}), '\\s+', ' ', 'g')) AS lookup_key FROM pairs")
def _(spark, d):
    return pairs(spark, d).select("id", remarks.contact_key(F.col("name")).alias("lookup_key"))


ACCOUNTS = "accts AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN 'CLOSED' ELSE 'ACTIVE' END AS status, ['VCB', 'TCB', 'MB'][s_suppkey % 3 + 1] AS bank, ['NAPAS', 'CITAD'][s_suppkey % 2 + 1] AS channel, CAST(round(s_acctbal * 100) AS BIGINT) AS balance, CASE WHEN s_suppkey % 4 > 0 THEN 300000 END AS reserve FROM supplier)"


@query("flt_channels", f"WITH {ACCOUNTS} SELECT id, status = 'ACTIVE' AS active, coalesce(balance < reserve, false) AS breached, bank = 'NAPAS' OR channel = 'NAPAS' OR bank = 'TCB' OR channel = 'TCB' AS displayed FROM accts")
def _(spark, d):
    """Active accounts, those below their reserve, and those of chosen banks or channels."""

    def pick(values: list[str]) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("s_suppkey") % len(values) + 1).cast("int"))

    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("id"), F.when(k % 9 == 0, "CLOSED").otherwise("ACTIVE").alias("status"), pick(["VCB", "TCB", "MB"]).alias("bank"), pick(["NAPAS", "CITAD"]).alias("channel"), F.round(F.col("s_acctbal") * 100).cast("long").alias("balance"), F.when(k % 4 > 0, 300_000).alias("reserve"))
    return browse.channel_flags(rows, ["NAPAS", "TCB"])


@query(
    "json_capped_lists",
    f"{TXN}, g AS (SELECT account, list(tx_id ORDER BY tx_id) AS ids FROM txn WHERE tx_id % 3 = 0 GROUP BY account) SELECT account, '[' || array_to_string(list_transform(ids[1:50], lambda x: '\"' || x || '\"'), ',') || ']' AS text, CAST(least(len(ids), 50) AS INT) AS n FROM g",
)
def _(spark, d):
    """Lists of ids as JSON, the first fifty of each, and read back."""
    rows = top_per_group(transactions(spark, d).where("tx_id % 3 = 0"), "account", [F.col("tx_id")], 50)
    lists = rows.groupBy("account").agg(F.transform(F.array_sort(F.collect_list("tx_id")), lambda x: x.cast("string")).alias("ids"))
    return lists.select("account", F.to_json("ids").alias("text")).withColumn("n", F.size(F.from_json("text", "array<string>")))


# --- templates and fallback -------------------------------------------------------------------------------------------------------

TEMPLATES = [
    (0, "swift", ["MT940", "CSV", "UNKNOWN"], [".sta", ".txt"], ["3A32303A"], [("header_text", "(?m)^:20:", 30), ("filename", "(?i)swift", 10)]),
    (1, "iso", ["CAMT053"], [".xml"], ["3C3F786D6C"], [("full_text", "BkToCstmrStmt", 30)]),
    (2, "text", ["CSV", "MT940", "UNKNOWN"], [".csv", ".sta", ".txt"], [], [("header_text", "(?i)date;ref;debit;credit", 20), ("any", "(?i)statement", 5)]),
]
COLUMNS = {"date": ["Date"], "ref": ["Ref"], "debit": ["Debit"], "credit": ["Credit"], "narration": ["Note"]}


def _text_balances(files: DataFrame) -> DataFrame:
    opening, closing = (F.regexp_extract("content", rf"(?m)^{word};(-?[0-9]+)", 1).try_cast("long") for word in ("Opening", "Closing"))
    return files.select("file", opening.alias("opening"), closing.alias("closing"))


PARSERS = {
    "swift": Parser(statements.mt940, statements.mt940_balances),
    "iso": Parser(iso20022.rows, iso20022.balances),
    "text": Parser(lambda files: statements.delimited(files, COLUMNS), _text_balances),
}


def mixed_files(spark, d) -> DataFrame:
    """Files of three kinds; some text files look like MT940 and have its ending, and some of each kind do not add up."""
    lines = bank_lines(spark, d).where("amount > 0").withColumn("k", F.col("customer"))
    kind, amount, even = F.col("k") % 3, F.col("amount").cast("string"), F.col("line_id") % 2 == 0
    swift = F.concat(F.lit(":61:2401010101"), F.when(even, "C").otherwise("D"), amount, F.lit(",NTRF"), F.col("line_id").cast("string"), F.lit("\n:86:paid"))
    iso = F.concat(F.lit("<Ntry><NtryRef>"), F.col("line_id").cast("string"), F.lit("</NtryRef><Amt>"), amount, F.lit("</Amt><CdtDbtInd>"), F.when(even, "CRDT").otherwise("DBIT"), F.lit("</CdtDbtInd></Ntry>"))
    text = F.concat(F.lit("2024-01-01;"), F.col("line_id").cast("string"), F.lit(";"), F.when(even, "").otherwise(amount), F.lit(";"), F.when(even, amount).otherwise(""), F.lit(";paid"))
    line = F.when(kind == 0, swift).when(kind == 1, iso).otherwise(text)
    net = F.sum(F.when(even, F.col("amount")).otherwise(-F.col("amount")))
    files = lines.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", line.alias("x")))), lambda r: r["x"]), "\n").alias("body"), net.alias("net"))
    closing = F.col("net") + F.when(F.col("k") % 20 == 19, 1).otherwise(0)
    side, size = F.when(closing < 0, "D").otherwise("C"), F.abs(closing).cast("string")
    as_swift = F.concat(F.lit(":20:x\n:25:1\n:60F:C240101VND0,\n"), F.col("body"), F.lit("\n:62F:"), side, F.lit("240102VND"), size, F.lit(","))
    balance = "<Bal><Tp><CdOrPrtry><Cd>{0}</Cd></CdOrPrtry></Tp><Amt>"
    as_iso = F.concat(F.lit('<?xml version="1.0"?><Document><BkToCstmrStmt><Stmt>' + balance.format("OPBD") + "0</Amt><CdtDbtInd>CRDT</CdtDbtInd></Bal>" + balance.format("CLBD")), size, F.lit("</Amt><CdtDbtInd>"), F.when(closing < 0, "DBIT").otherwise("CRDT"), F.lit("</CdtDbtInd></Bal>"), F.col("body"), F.lit("</Stmt></BkToCstmrStmt></Document>"))
    head = F.when(F.col("k") % 7 == 3, ":20:exported\n:25:from a statement\n").otherwise("")
    as_text = F.concat(head, F.lit("Opening;0\nClosing;"), closing.cast("string"), F.lit("\nDate;Ref;Debit;Credit;Note\n"), F.col("body"))
    ending = F.when(kind == 0, ".txt").when(kind == 1, ".xml").when(F.col("k") % 7 == 3, ".sta").otherwise(".csv")
    return files.select(F.concat(F.lit("f"), F.col("k").cast("string"), ending).alias("file"), F.when(kind == 0, as_swift).when(kind == 1, as_iso).otherwise(as_text).alias("content"))


ENDING = "CASE customer % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.xml' ELSE CASE WHEN customer % 7 = 3 THEN '.sta' ELSE '.csv' END END"
CUSTOMERS = f"files AS (SELECT customer, 'f' || customer || {ENDING} AS file, count(*) AS n, CAST(sum(CASE WHEN line_id % 2 = 0 THEN amount ELSE -amount END) AS BIGINT) AS net FROM bank WHERE amount > 0 GROUP BY customer)"


@query(
    "io_template_scores",
    f"""{BANK}, {CUSTOMERS} SELECT file, unnest(CASE WHEN customer % 3 = 0 THEN ['swift', 'text'] WHEN customer % 3 = 1 THEN ['iso'] WHEN customer % 7 = 3 THEN ['swift', 'text'] ELSE ['text'] END) AS template,
    unnest(CASE WHEN customer % 3 = 0 THEN [45, 5] WHEN customer % 3 = 1 THEN [45] WHEN customer % 7 = 3 THEN [45, 30] ELSE [25] END) AS score FROM files""",
)
def _(spark, d):
    """Every file's score by every template that does not exclude it."""
    return templates.scores(mixed_files(spark, d), spark.createDataFrame(TEMPLATES, templates.TEMPLATE)).select("file", "template", "score")


@query(
    "io_dispatched_files",
    f"""{BANK}, {CUSTOMERS} SELECT file, CASE WHEN customer % 20 <> 19 THEN CASE customer % 3 WHEN 0 THEN 'swift' WHEN 1 THEN 'iso' ELSE 'text' END END AS template,
    CASE WHEN customer % 20 = 19 THEN CASE WHEN customer % 3 = 0 OR customer % 3 = 2 AND customer % 7 = 3 THEN 2 ELSE 1 END WHEN customer % 3 = 2 AND customer % 7 = 3 THEN 2 ELSE 1 END AS tries,
    CASE WHEN customer % 20 <> 19 THEN n ELSE 0 END AS n, CASE WHEN customer % 20 <> 19 THEN net ELSE 0 END AS net FROM files""",
)
def _(spark, d):
    """Which parser read each file, in which try, and what it read; files that add up in none have none."""
    rows, verdicts = templates.dispatch(mixed_files(spark, d), spark.createDataFrame(TEMPLATES, templates.TEMPLATE), PARSERS)
    sums = rows.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.when(F.col("posting_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))).alias("net"))
    return verdicts.join(sums, "file", "left").select("file", "template", "tries", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("net", F.lit(0)).alias("net"))
