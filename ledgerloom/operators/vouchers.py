"""Voucher lines from rules, their checks, and their forms for other systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import unbundled

# The default accounts of the voucher rules.
DEFAULTS = {"fee_expense_account": "6427", "fee_tax_account": "6425", "input_vat_account": "1331", "customer": "131", "vendor": "331"}
# The lines of each kind of voucher: account, side, amount formula, and its rate or amount.
TEMPLATES = {
    "RECEIPT": [("bank_account", "D", "full", 0), ("partner_account", "C", "full", 0)],
    "PAYMENT": [("partner_account", "D", "full", 0), ("bank_account", "C", "full", 0)],
    "RECEIPT_WITH_FEE": [("bank_account", "D", "net_received", 0), ("fee_expense_account", "D", "deducted_fee", 0), ("partner_account", "C", "full", 0)],
    "FEE": [("fee_expense_account", "D", "net_exclusive", 1000), ("input_vat_account", "D", "vat_portion", 1000), ("bank_account", "C", "full", 0)],
    "FIXED": [("fee_tax_account", "D", "fixed", 500), ("bank_account", "C", "fixed", 500)],
    "SETTLED": [("bank_account", "D", "invoice", 0), ("131", "C", "full", 0)],
}


def _account(name: str) -> Column:
    if name == "bank_account":
        return F.col("bank_account")
    if name == "partner_account":
        return F.coalesce("partner_account", F.when(F.col("is_credit"), DEFAULTS["customer"]).otherwise(DEFAULTS["vendor"]))
    return F.lit(DEFAULTS.get(name, name))


def _amount(formula: str, value: int) -> Column:
    amount, fee = F.col("amount"), F.coalesce("fee", F.lit(0).cast("long"))
    if formula in ("net_exclusive", "vat_portion"):
        return unbundled(amount, value)[formula == "vat_portion"]
    return {"full": amount, "deducted_fee": fee, "net_received": amount - fee, "invoice": F.coalesce("invoice_amount", "amount"), "fixed": F.lit(value).cast("long")}[formula]


def voucher_lines(rows: DataFrame, templates: dict[str, list[tuple[str, str, str, int]]] | None = None) -> DataFrame:
    """(voucher_id, kind, account, side, amount) from rows (voucher_id, kind, is_credit, amount, fee, invoice_amount, bank_account, partner_account).

    Lines of amounts that are not positive are left out; a kind without a template gives none.
    """
    lines = F.array().cast("array<struct<account:string,side:string,amount:bigint>>")
    for kind, parts in (templates or TEMPLATES).items():
        made = F.array(*[F.struct(_account(a).alias("account"), F.lit(s).alias("side"), _amount(f, v).cast("long").alias("amount")) for a, s, f, v in parts])
        lines = F.when(F.col("kind") == kind, made).otherwise(lines)
    return rows.select("voucher_id", "kind", F.inline(lines)).where("amount > 0")


def voucher_checks(lines: DataFrame) -> DataFrame:
    """(voucher_id, debit, credit, n_lines, status) : DRAFT, or why it is rejected."""
    debit, credit = (F.sum(F.when(F.col("side") == s, F.col("amount")).otherwise(0)) for s in ("D", "C"))
    sums = lines.groupBy("voucher_id").agg(debit.alias("debit"), credit.alias("credit"), F.count("*").alias("n_lines"))
    return sums.withColumn("status", F.when(F.col("n_lines") < 2, "TOO_FEW_LINES").when(F.col("debit") != F.col("credit"), "UNBALANCED").otherwise("DRAFT"))


def as_xml(lines: DataFrame) -> DataFrame:
    """(voucher_id, xml): a document for each voucher, lines by account and side; signs of markup in accounts are escaped."""

    def safe(x: Column) -> Column:
        return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    one = F.concat(F.lit("<Line><AccountCode>"), safe(F.col("account")), F.lit("</AccountCode><PostingType>"), F.when(F.col("side") == "D", "Nợ").otherwise("Có"), F.lit("</PostingType><Amount>"), F.col("amount").cast("string"), F.lit("</Amount></Line>"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("account", "side", one.alias("x")))), lambda p: p["x"]), "")
    total = F.sum(F.when(F.col("side") == "D", F.col("amount")).otherwise(0)).cast("string")
    head = F.concat(F.lit("<VoucherData><Header><VoucherNo>"), F.col("voucher_id").cast("string"), F.lit("</VoucherNo><TotalAmount>"), total, F.lit("</TotalAmount></Header><Details>"))
    return lines.groupBy("voucher_id").agg(F.concat(head, parts, F.lit("</Details></VoucherData>")).alias("xml"))
