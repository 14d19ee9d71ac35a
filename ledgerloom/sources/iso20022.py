"""ISO 20022 messages by Spark's XML reader: account statements (camt.053) and credit transfers (pacs.008), with prefixes and nested parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.statements import fixed_point

_AMOUNT = "struct<_VALUE:string,_Ccy:string>"
_ACCOUNT = "struct<Id:struct<IBAN:string,Othr:struct<Id:string>>,Nm:string,Ccy:string>"
_PARTY = "struct<Nm:string>"
_DAY = "struct<Dt:string,DtTm:string>"
_NOTE = "struct<Ustrd:array<string>>"
_DETAIL = f"struct<Refs:struct<EndToEndId:string,TxId:string,AcctSvcrRef:string>,RltdPties:struct<Dbtr:{_PARTY},DbtrAcct:{_ACCOUNT},Cdtr:{_PARTY},CdtrAcct:{_ACCOUNT}>,RmtInf:{_NOTE}>"
_ENTRY = f"struct<NtryRef:string,Amt:{_AMOUNT},CdtDbtInd:string,BookgDt:{_DAY},ValDt:{_DAY},AcctSvcrRef:string,NtryDtls:struct<TxDtls:array<{_DETAIL}>>,AddtlNtryInf:string>"
_BALANCE = f"struct<Tp:struct<CdOrPrtry:struct<Cd:string>>,Amt:{_AMOUNT},CdtDbtInd:string>"
_TRANSFER = f"struct<PmtId:struct<EndToEndId:string,TxId:string>,IntrBkSttlmAmt:{_AMOUNT},InstdAmt:{_AMOUNT},IntrBkSttlmDt:string,Dbtr:{_PARTY},DbtrAcct:{_ACCOUNT},Cdtr:{_PARTY},CdtrAcct:{_ACCOUNT},RmtInf:{_NOTE}>"
STATEMENTS = f"BkToCstmrStmt struct<Stmt:array<struct<Acct:{_ACCOUNT},Bal:array<{_BALANCE}>,Ntry:array<{_ENTRY}>>>>"
BALANCES = f"BkToCstmrStmt struct<Stmt:array<struct<Acct:{_ACCOUNT},Bal:array<{_BALANCE}>>>>"
TRANSFERS = f"FIToFICstmrCdtTrf struct<GrpHdr:struct<SttlmInf:struct<ClrSys:struct<Prtry:string>>>,CdtTrfTxInf:array<{_TRANSFER}>>"
SCHEMA = f"{STATEMENTS}, {TRANSFERS}"


def channel(file: Column, content: Column) -> Column:
    """The channel of a message by words of its file name and text: SWIFT, NAPAS, BILATERAL, else CITAD."""
    name, text = F.upper(file), F.upper(content)
    swift = F.contains(name, F.lit("SWIFT")) | text.rlike(r"SWIFT|PACS\.008")
    napas = F.contains(name, F.lit("NAPAS")) | F.contains(text, F.lit("NAPAS"))
    return F.when(swift, "SWIFT").when(napas, "NAPAS").when(F.contains(name, F.lit("BILATERAL")) | text.rlike("NOSTRO|VOSTRO"), "BILATERAL").otherwise("CITAD")


def messages(files: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """(file, channel, m): each text as a message of `schema`; m is null for what is no XML."""
    read = F.from_xml(F.trim("content"), schema, {"rowTag": "Document", "ignoreNamespace": "true", "mode": "PERMISSIVE"})
    return files.select("file", channel(F.col("file"), F.col("content")).alias("channel"), read.alias("m"))


def listed(files: DataFrame, schema: str, within: str, name: str) -> DataFrame:
    """(file, channel, at, s): the elements `within.name` of messages that have some; only texts that name the message are read, and each of them once.

    Places come from an outer explosion: for a plain one Spark puts a condition on the list before it, which reads the text again.
    """
    read = messages(files.where(F.contains("content", F.lit(within))), schema)
    return read.select("file", "channel", F.posexplode_outer(F.col(f"m.{within}.{name}")).alias("at", "s")).where("at IS NOT NULL")


def account_id(account: Column) -> Column:
    return F.coalesce(account["Id"]["IBAN"], account["Id"]["Othr"]["Id"])


def amount_of(text: Column, places: int) -> Column:
    return F.when(text.isNotNull(), F.abs(fixed_point(F.trim(text), places)))


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in texts])


def rows(files: DataFrame, places: int = 0) -> DataFrame:
    """(file, channel, kind, account, row_id, ref_code, posting_type, amount, value_date, counterparty, counterparty_account, narration) of each entry or transfer.

    The reference is the end-to-end id, then the transaction's and the bank's. An entry has the first of its details; its counterparty is the debtor of a credit
    and the creditor of a debit. A transfer is a credit from its debtor.
    """
    statements = listed(files, STATEMENTS, "BkToCstmrStmt", "Stmt")
    entries = statements.select("file", "channel", account_id(F.col("s.Acct")).alias("account"), F.posexplode("s.Ntry").alias("at", "e"))
    detail = F.get(F.col("e.NtryDtls.TxDtls"), F.lit(0))
    credit = F.upper(F.col("e.CdtDbtInd")) != "DBIT"
    parties = detail["RltdPties"]
    one = entries.select(
        "file", "channel", F.lit("camt.053").alias("kind"), "account", (F.col("at") + 1).cast("long").alias("row_id"),
        first_filled(detail["Refs"]["EndToEndId"], detail["Refs"]["TxId"], F.col("e.NtryRef"), F.col("e.AcctSvcrRef")).alias("ref_code"),
        F.when(credit, "credit").otherwise("debit").alias("posting_type"), amount_of(F.col("e.Amt._VALUE"), places).alias("amount"),
        F.coalesce("e.ValDt.Dt", "e.BookgDt.Dt", F.substring("e.BookgDt.DtTm", 1, 10)).alias("value_date"),
        F.when(credit, parties["Dbtr"]["Nm"]).otherwise(parties["Cdtr"]["Nm"]).alias("counterparty"),
        F.when(credit, account_id(parties["DbtrAcct"])).otherwise(account_id(parties["CdtrAcct"])).alias("counterparty_account"),
        F.coalesce(F.array_join(detail["RmtInf"]["Ustrd"], " "), F.col("e.AddtlNtryInf")).alias("narration"),
    )
    transfers = listed(files, TRANSFERS, "FIToFICstmrCdtTrf", "CdtTrfTxInf").withColumnRenamed("s", "t")
    two = transfers.select(
        "file", "channel", F.lit("pacs.008").alias("kind"), account_id(F.col("t.CdtrAcct")).alias("account"), (F.col("at") + 1).cast("long").alias("row_id"),
        first_filled(F.col("t.PmtId.EndToEndId"), F.col("t.PmtId.TxId")).alias("ref_code"), F.lit("credit").alias("posting_type"), amount_of(F.coalesce("t.IntrBkSttlmAmt._VALUE", "t.InstdAmt._VALUE"), places).alias("amount"),
        F.col("t.IntrBkSttlmDt").alias("value_date"), F.col("t.Dbtr.Nm").alias("counterparty"), account_id(F.col("t.DbtrAcct")).alias("counterparty_account"), F.array_join("t.RmtInf.Ustrd", " ").alias("narration"),
    )
    return one.union(two)


def balances(files: DataFrame, places: int = 0) -> DataFrame:
    """(file, account, opening, closing) of statements: the last balance with code OPBD or PRCD, and with CLBD or CLAV; a debit balance is negative."""
    s = listed(files, BALANCES, "BkToCstmrStmt", "Stmt")

    def balance(codes: list[str]) -> Column:
        mine = F.try_element_at(F.filter("s.Bal", lambda b: F.upper(b["Tp"]["CdOrPrtry"]["Cd"]).isin(codes)), F.lit(-1))
        value = amount_of(mine["Amt"]["_VALUE"], places)
        return F.when(F.upper(mine["CdtDbtInd"]) == "DBIT", -value).otherwise(value)

    return s.select("file", account_id(F.col("s.Acct")).alias("account"), F.when(F.size("s.Bal") > 0, balance(["OPBD", "PRCD"])).alias("opening"), F.when(F.size("s.Bal") > 0, balance(["CLBD", "CLAV"])).alias("closing"))
