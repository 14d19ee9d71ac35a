"""Statement files as DataFrames: delimited text with a sought header, MT940 and CAMT.053, from a text column of whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import let, parse_amount
from ledgerloom.functions.text import unmarked_upper
from ledgerloom.plans.storage import if_small

CANONICAL = ["file", "row_id", "ref_code", "posting_type", "amount", "balance_after", "narration", "value_date"]


def container_format(name: Column, content: Column) -> Column:
    """What a file holds, by its first characters and markers and then its extension."""
    head = F.substring(F.regexp_replace(content, "^﻿", ""), 1, 4096)
    return (
        F.when(F.startswith(content, F.lit("PK\u0003\u0004")), "XLSX")
        .when(F.startswith(content, F.lit("%PDF")), "PDF")
        .when(F.contains(head, F.lit("BkToCstmrStmt")), "CAMT053")
        .when(F.contains(head, F.lit(":20:")) & F.contains(head, F.lit(":25:")), "MT940")
        .when(F.contains(F.lower(head), F.lit("<table")), "HTML")
        .when(F.lower(name).endswith(".csv") | F.lower(name).endswith(".txt"), "CSV")
        .otherwise("UNKNOWN")
    )


def delimiter(content: Column) -> Column:
    """The most frequent of ; tab | , in the first 20 lines, in that order on ties."""
    lines = F.array_join(F.slice(F.split(content, "\n"), 1, 20), "\n")
    counts = [(d, F.length(lines) - F.length(F.replace(lines, F.lit(d)))) for d in (";", "\t", "|", ",")]
    most = F.greatest(*[c for _, c in counts])
    out = F.lit(",")
    for d, c in reversed(counts):
        out = F.when((c == most) & (c > 0), F.lit(d)).otherwise(out)
    return out


DELIMITERS = (";", "\t", "|", ",")


def quoted_cells(line: Column, delimiter: Column) -> Column:
    """The cells of a line, cut at the delimiter outside double quotes; quotes around a cell go and doubled ones in it are one."""
    out = F.array().cast("array<string>")
    for d in DELIMITERS:
        found = F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(rf'\Q{d}\E((?:\s*"(?:[^"]|"")*"\s*)?[^\Q{d}\E]*)'), F.lit(1))
        out = F.when(delimiter == d, found).otherwise(out)
    bare = F.transform(out, lambda c: F.trim(c))
    return F.transform(bare, lambda c: F.when(c.rlike('(?s)^".*"$') & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def quoted_delimiter(content: Column, lines: int = 15) -> Column:
    """The delimiter that most evenly cuts the first lines: its count outside quotes, times the share of lines that have it, times one and how even they are."""
    first = F.filter(F.slice(F.split(content, "\r?\n"), 1, lines), lambda x: F.trim(x) != "")
    bare = F.transform(first, lambda x: F.regexp_replace(x, '"(?:[^"]|"")*"', ""))
    def best(bare: Column) -> Column:
        scores = []
        for place, d in enumerate(DELIMITERS):
            counts = F.transform(bare, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d))))
            scores.append(_evenness(counts, place, d))
        return F.array_max(F.array(*scores))

    return let(bare, lambda b: F.when(best(b)["score"] > 0, best(b)["d"]).otherwise(","))


def _evenness(counts: Column, place: int, d: str) -> Column:
    """(score, an order for ties, delimiter) of one delimiter's counts in the lines."""

    def rated(n: Column) -> Column:
        having = F.filter(n, lambda x: x > 0)
        usual = F.size(F.filter(having, lambda x: x == F.element_at(having, 1)))
        total = F.aggregate(n, F.lit(0), lambda a, x: a + x)
        return F.when(F.size(having) > 0, total * (F.size(having) / F.size(n)) * (1 + usual / F.size(having))).otherwise(F.lit(0.0))

    return F.struct(let(counts, rated).alias("score"), F.lit(-place).alias("order"), F.lit(d).alias("d"))


def metadata(files: DataFrame, patterns: dict[str, str], first_lines: int = 20) -> DataFrame:
    """(file, a column for each pattern): the first group of each pattern in the first lines, or null."""
    head = F.array_join(F.slice(F.split("content", "\r?\n"), 1, first_lines), "\n")
    return files.select("file", *[F.nullif(F.trim(F.regexp_extract(head, p, 1)), F.lit("")).alias(name) for name, p in patterns.items()])


def signature_scores(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, bank, score): 5 for the bank's mark in the file name and 1 for each keyword in the first 8 KiB; the best bank, ties to the first name.

    `rules` has (bank, mark, keywords); a handful of rows, broadcast.
    """
    head, name = F.upper(F.substring("content", 1, 8192)), F.upper("file")
    score = F.when(F.contains(name, F.upper("mark")), 5).otherwise(0) + F.size(F.filter("keywords", lambda k: F.contains(head, F.upper(k))))
    met = files.crossJoin(if_small(rules, 1_000)).select("file", "bank", score.alias("score")).where("score > 0")
    return met.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("s"), "bank")).alias("b")).select("file", "b.bank", (-F.col("b.s")).alias("score"))


# What a column is, by patterns of its head in lower case without marks, in the order in which they are tried, and what finding it is worth.
ROLES = [
    ("date", r"^(ngay|date|transaction date|ngay giao dich|ngay gd)", 30),
    ("debit", r"(ghi no|debit|rut ra|chi ra|^no$)", 25),
    ("credit", r"(ghi co|credit|gui vao|thu vao|^co$)", 25),
    ("balance", r"(so du|balance)", 15),
    ("amount", r"(so tien|amount|gia tri)", 20),
    ("code", r"(ma gd|so but toan|reference|^ref|so ct)", 15),
    ("narration", r"(noi dung|dien giai|narration|description|mo ta)", 20),
    ("counterparty", r"(doi tac|counterparty|partner|nguoi thu huong)", 10),
]


def column_role(head: Column) -> Column:
    """The role of a column head, or null."""
    plain, out = F.lower(unmarked_upper(F.trim(head))), F.lit(None).cast("string")
    for role, pattern, _ in reversed(ROLES):
        out = F.when(plain.rlike(pattern), role).otherwise(out)
    return out


def best_header(files: DataFrame, most_lines: int = 15) -> DataFrame:
    """(file, line_no, score, roles) of the first of the first lines with the highest sum of worth of its roles, each counted once; a date and an amount, debit or credit are needed."""
    cut = files.select("file", quoted_delimiter(F.col("content")).alias("d"), F.slice(F.split("content", "\r?\n"), 1, most_lines).alias("lines"))
    lines = cut.select("file", "d", F.posexplode("lines").alias("line_no", "line"))
    roles = lines.withColumn("roles", F.transform(quoted_cells(F.col("line"), F.col("d")), column_role))
    distinct = F.array_distinct(F.array_compact("roles"))
    worth = F.aggregate(distinct, F.lit(0), lambda acc, r: acc + F.element_at(F.create_map(*[x for role, _, w in ROLES for x in (F.lit(role), F.lit(w))]), r))
    usable = F.array_contains(distinct, "date") & F.arrays_overlap(distinct, F.array(*[F.lit(x) for x in ("amount", "debit", "credit")]))
    scored = roles.where(usable).withColumn("score", worth)
    return scored.groupBy("file").agg(F.max_by(F.struct("line_no", "score", "roles"), F.struct("score", -F.col("line_no"))).alias("h")).select("file", "h.line_no", "h.score", "h.roles")


def table_rows(files: DataFrame, places: int = 0) -> DataFrame:
    """(file, line_no, date, debit, credit, balance, narration) of the lines behind each file's best header, whatever its columns are called.

    A missing date is the one above; one signed amount is a debit if negative; a balance that is not stated is the sum of all so far.
    """
    head = best_header(files)
    sources = files.select("file", quoted_delimiter(F.col("content")).alias("d"), F.regexp_replace("content", "^\ufeff", "").alias("text"))
    lines = sources.select("file", "d", F.posexplode(F.split("text", "\r?\n")).alias("no", "line"))
    rows = lines.join(head, "file").where("no > line_no AND trim(line) <> ''").withColumn("cells", quoted_cells(F.col("line"), F.col("d")))

    def cell(role: str) -> Column:
        return F.nullif(F.get("cells", F.nullif(F.array_position("roles", F.lit(role)), F.lit(0)).cast("int") - 1), F.lit(""))

    def money(role: str) -> Column:
        return F.when(cell(role).rlike("[0-9]"), parse_amount(cell(role), places))

    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"m_debit": money("debit"), "m_credit": money("credit"), "m_amount": money("amount")})
    signed = F.col("m_amount")
    debit, credit = F.coalesce("m_debit", F.when(signed < 0, -signed), zero), F.coalesce("m_credit", F.when(signed > 0, signed), zero)
    order = Window.partitionBy("file").orderBy("no")
    filled = rows.select("file", F.col("no").alias("line_no"), F.last(cell("date"), ignorenulls=True).over(order).alias("date"), debit.alias("debit"), credit.alias("credit"), money("balance").alias("said"), cell("narration").alias("narration"))
    return filled.select("file", "line_no", "date", "debit", "credit", F.coalesce("said", F.sum(F.col("credit") - F.col("debit")).over(Window.partitionBy("file").orderBy("line_no"))).alias("balance"), "narration")


def synthetic_lines(spark: SparkSession, n: int, seed: int = 0, banks: int = 5) -> DataFrame:
    """(line_id, bank, amount, kind, ts) of a repeatable test load: of a thousand lines 900 are exact, 75 short of a fee, 23 split and 2 without an invoice."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1000))
    kind = F.when(draw < 900, "EXACT").when(draw < 975, "FUZZY").when(draw < 998, "SPLIT").otherwise("UNRESOLVED")
    amount = F.lit(1_000_000) + F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(9_000_000)) - F.when(kind == "FUZZY", 11_000).otherwise(0)
    return spark.range(n).select(F.col("id").alias("line_id"), F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(banks)).alias("bank"), amount.alias("amount"), kind.alias("kind"), (F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"))


# What begins a line of totals, as whole words.
TOTALS = r"(?iu)^\s*(tổng|tong|cộng|cong phat sinh|totals?|sum|số dư cuối)(?![\p{L}\p{N}])"


def below_header(files: DataFrame, aliases: dict[str, list[str]], least: int, stop: str) -> DataFrame:
    """Rows (file, d, line_no, line, cells, at, names, ended) of the lines after each file's header."""
    known = F.array(*[F.lit(a.lower()) for names in aliases.values() for a in names])
    text = F.regexp_replace("content", "^\ufeff", "")
    # the delimiter is found before the lines are dealt out, or each line would carry its whole file along
    sources = files.select("file", delimiter(text).alias("d"), text.alias("text"))
    lines = sources.select("file", "d", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    cells = lines.withColumn("cells", quoted_cells(F.col("line"), F.col("d")))
    header = cells.where(F.size(F.array_intersect(F.transform("cells", F.lower), known)) >= least).groupBy("file").agg(F.min(F.struct("line_no", "cells")).alias("h"))
    rows = cells.join(header.select("file", F.col("h.line_no").alias("at"), F.transform("h.cells", F.lower).alias("names")), "file").where("line_no > at")
    return rows.withColumn("ended", F.coalesce(F.get(F.filter("cells", lambda c: c != ""), F.lit(0)).rlike(stop), F.lit(False)))


def ends(files: DataFrame, aliases: dict[str, list[str]], least: int = 3, stop: str = TOTALS) -> DataFrame:
    """(file, line_no, lines_after): the line of totals at which the rows of a file end, if one does, and how many filled lines follow it."""
    rows = below_header(files, aliases, least, stop).where("exists(cells, c -> c <> '')")
    last = rows.groupBy("file").agg(F.min(F.when(F.col("ended"), F.col("line_no"))).alias("line_no"), F.collect_list("line_no").alias("lines"))
    return last.where("line_no IS NOT NULL").select("file", F.col("line_no").cast("long").alias("line_no"), F.expr("size(filter(lines, l -> l > line_no))").cast("long").alias("lines_after"))


def delimited(files: DataFrame, aliases: dict[str, list[str]], least: int = 3, places: int = 0, stop: str = TOTALS) -> DataFrame:
    """Canonical rows from (file, content): the header is the first line with at least `least` known column names.

    `aliases` maps ref, debit, credit, narration and date, or `amount` for one signed column, to the names a header may use. Lines
    after the header up to the first whose first filled cell matches `stop` (see `ends`) are cut with the file's delimiter, quotes respected; lines
    without an amount continue the narration of the row before them. Amounts have `places` digits of minor units.
    """
    rows = below_header(files, aliases, least, stop)
    order = Window.partitionBy("file").orderBy("line_no")

    def cell(what: str) -> Column:
        spots = [F.get("cells", F.nullif(F.array_position("names", F.lit(n.lower())), F.lit(0)).cast("int") - 1) for n in aliases.get(what, [])]
        return F.coalesce(*spots) if spots else F.lit(None).cast("string")

    def money(what: str) -> Column:
        return F.when(cell(what).rlike("[0-9]") & ~cell(what).rlike(r"[\p{L}&&[^VNDCR]]"), parse_amount(cell(what), places))

    rows = rows.withColumns({"m_debit": money("debit"), "m_credit": money("credit"), "m_amount": money("amount"), "m_balance": money("balance")})
    signed = F.col("m_amount")
    debit, credit = F.coalesce("m_debit", F.when(signed < 0, -signed)), F.coalesce("m_credit", F.when(signed > 0, signed))
    kind = F.when(F.coalesce(credit, F.lit(0)) != 0, "credit").otherwise("debit")
    value = F.abs(F.when(kind == "credit", credit).otherwise(debit))
    begins = debit.isNotNull() | credit.isNotNull()
    solid = F.array_join(F.filter("cells", lambda c: c != ""), " ")
    part = F.when(begins, cell("narration")).otherwise(F.coalesce(F.nullif(cell("narration"), F.lit("")), solid))
    balance = F.col("m_balance")
    head = F.struct(F.col("line_no").cast("long").alias("row_id"), cell("ref").alias("ref_code"), kind.alias("posting_type"), value.alias("amount"), balance.alias("balance_after"), cell("date").alias("value_date"))
    # cells and the header's names end here: what is sorted holds the parsed fields of a line only
    slim = rows.select("file", "line_no", "ended", F.when(begins, F.col("line_no")).alias("begun"), F.when(begins, head).alias("head"), part.alias("part"))
    inside = slim.withColumn("over", F.max("ended").over(order)).withColumn("entry", F.last("begun", ignorenulls=True).over(order))
    parsed = inside.where("NOT over AND entry IS NOT NULL").select("file", "line_no", "entry", "head", "part")
    joined = parsed.groupBy("file", "entry").agg(
        F.min_by("head", "line_no").alias("h"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") != "", F.struct("line_no", "part")))), lambda x: x["part"]), " ").alias("narration"),
    )
    return joined.where("h.amount > 0").select("file", "h.row_id", "h.ref_code", "h.posting_type", "h.amount", "h.balance_after", "narration", "h.value_date")


def ledger_text(files: DataFrame, aliases: dict[str, list[str]], places: int = 0) -> DataFrame:
    """(file, row_id, doc_no, entry_type, amount, date, partner): receivables are CREDIT and payables DEBIT entries of a ledger in the form of `delimited`."""
    rows = delimited(files, {"ref": aliases["doc_no"], "credit": aliases["receivable"], "debit": aliases["payable"], "narration": aliases["partner"], "date": aliases["date"]}, places=places)
    return rows.select("file", "row_id", F.col("ref_code").alias("doc_no"), F.upper("posting_type").alias("entry_type"), "amount", F.col("value_date").alias("date"), F.col("narration").alias("partner"))


def fixed_point(text: Column, places: int) -> Column:
    """Minor units from digits with an optional decimal dot or comma."""
    return parse_amount(F.translate(text, ",", "."), places, "none", ".")


def mt940_balances(files: DataFrame, places: int = 0) -> DataFrame:
    """(file, account, opening, closing) from :25:, :60F: or :60M:, and :62F: or :62M:; a debit balance is negative."""
    def balance(tag: str) -> Column:
        kind, text = (F.regexp_extract("content", rf"(?m)^:{tag}[FM]:([CD])\d{{6}}[A-Z]{{3}}([0-9,]+)", g) for g in (1, 2))
        return F.when(text != "", F.when(kind == "D", -fixed_point(text, places)).otherwise(fixed_point(text, places)))

    return files.select("file", F.nullif(F.trim(F.regexp_extract("content", r"(?m)^:25:(.*)$", 1)), F.lit("")).alias("account"), balance("60").alias("opening"), balance("62").alias("closing"))


def mt940(files: DataFrame, places: int = 0) -> DataFrame:
    """Canonical rows from (file, content): a :61: line, and the :86: lines up to the next tag as its narration."""
    lines = files.select("file", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"))
    order = Window.partitionBy("file").orderBy("line_no")
    tag = F.nullif(F.regexp_extract("line", r"^:([0-9]{2}[A-Z]?):", 1), F.lit(""))
    tagged = lines.withColumn("tag", F.last(tag, ignorenulls=True).over(order)).withColumn("entry", F.sum(F.when(tag == "61", 1).otherwise(0)).over(order))
    body = F.regexp_replace("line", r"^:[0-9]{2}[A-Z]?:", "")
    parts = tagged.where("entry > 0 AND tag IN ('61', '86')").withColumn("body", body).where("tag = '61' OR trim(body) <> ''")
    joined = parts.groupBy("file", "entry").agg(
        F.min_by(F.when(F.col("tag") == "61", F.col("body")), "line_no").alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == "86", F.struct("line_no", "body")))), lambda x: x["body"]), " ").alias("narration"),
    )
    pattern = r"^([0-9]{6})([0-9]{4})?(R?[CD])[A-Z]?([0-9]+),([0-9]*)N?[A-Z]{0,3}(.*)$"
    return joined.select(
        "file",
        F.col("entry").cast("long").alias("row_id"),
        F.trim(F.regexp_extract("head", pattern, 6)).alias("ref_code"),
        F.when(F.regexp_extract("head", pattern, 3).endswith("C"), "credit").otherwise("debit").alias("posting_type"),
        fixed_point(F.concat(F.regexp_extract("head", pattern, 4), F.lit("."), F.regexp_extract("head", pattern, 5)), places).alias("amount"),
        "narration",
        F.concat(F.lit("20"), F.regexp_extract("head", pattern, 1)).alias("value_date"),
    )


def camt053_balances(files: DataFrame, places: int = 0) -> DataFrame:
    """(file, account, opening, closing) from the balances with codes OPBD or PRCD and CLBD or ITBD; a debit balance is negative."""
    parts = F.regexp_extract_all("content", F.lit(r"(?s)<Bal(?:\s[^>]*)?>(.*?)</Bal>"), F.lit(1))

    def balance(codes: str) -> Column:
        mine = F.get(F.filter(parts, lambda b: b.rlike(rf"<Cd>\s*({codes})\s*</Cd>")), F.lit(0))
        value = fixed_point(F.regexp_extract(mine, r"<Amt[^>]*>\s*([0-9.]+)", 1), places)
        return F.when(mine.isNotNull(), F.when(mine.rlike(r"<CdtDbtInd>\s*DBIT"), -value).otherwise(value))

    account = F.regexp_extract("content", r"(?s)<Acct(?:\s[^>]*)?>.*?<(?:IBAN|Id)>\s*([^<\s][^<]*)<", 1)
    return files.select("file", F.nullif(F.trim(account), F.lit("")).alias("account"), balance("OPBD|PRCD").alias("opening"), balance("CLBD|ITBD").alias("closing"))


def camt053(files: DataFrame, places: int = 0) -> DataFrame:
    """Canonical rows from (file, content): one for each Ntry element."""
    entries = files.select("file", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)<Ntry(?:\s[^>]*)?>(.*?)</Ntry>"), F.lit(1))).alias("at", "e"))

    def inner(name: str) -> Column:
        return F.regexp_extract("e", rf"(?s)<{name}[^>]*>([^<]*)</{name}>", 1)

    return entries.select(
        "file",
        (F.col("at") + 1).cast("long").alias("row_id"),
        inner("NtryRef").alias("ref_code"),
        F.when(inner("CdtDbtInd") == "CRDT", "credit").otherwise("debit").alias("posting_type"),
        fixed_point(F.trim(inner("Amt")), places).alias("amount"),
        inner("Ustrd").alias("narration"),
        inner("Dt").alias("value_date"),
    )
