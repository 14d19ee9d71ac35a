"""Summaries of telemetry, matching, reports and treasury; each a single pass of partial aggregates unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import div
from ledgerloom.operators.ranking import ranked_counts


def since(rows: DataFrame, time: str, start: int | None) -> DataFrame:
    """All rows, or those from a start on."""
    return rows if start is None else rows.where(F.col(time) >= start)


def telemetry(turns: DataFrame, start: int | None = None) -> DataFrame:
    """One row of (turns, ok, err, avg_latency, prompt_tokens, completion_tokens) over (ts, outcome, latency_ms, prompt_tokens, completion_tokens)."""
    rows = since(turns, "ts", start)
    return rows.agg(
        F.count("*").alias("turns"),
        F.count_if(F.col("outcome") == "ok").alias("ok"),
        F.count_if(F.col("outcome") == "err").alias("err"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 2).alias("avg_latency"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
    )


def by_index(rows: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(group, n, p50, p95 ..): of each group's ascending values the one at place floor(n * share), from 0 and at most the last.

    Ranks run over the counts of distinct values, sorted by ranges, so no group is in one place.
    """
    upto = ranked_counts(rows, group, value)
    picks = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col(value))).alias(f"p{round(q * 100)}") for q in shares]
    return upto.groupBy(group).agg(F.max("n").alias("n"), *picks)


def match_rates(lines: DataFrame, status: str) -> DataFrame:
    """One row of (total, matched, rate_pct, rate_1dp, rate_bps): whole per cents and basis points are cut, the other is rounded to one digit."""
    c = lines.agg(F.count("*").alias("total"), F.count_if(F.col(status) != "NONE").alias("matched"))
    total = F.greatest("total", F.lit(1).cast("long"))
    return c.select("total", "matched", div(F.col("matched") * 100, total).alias("rate_pct"), F.round(F.col("matched") / total * 100, 1).alias("rate_1dp"), div(F.col("matched") * 10_000, total).alias("rate_bps"))


def counts_by_tier(matched: DataFrame, tiers: list[int]) -> DataFrame:
    """One row with a count for each tier."""
    return matched.agg(*[F.count_if(F.col("tier") == t).alias(f"tier{t}") for t in tiers])


def table_counts(tables: dict[str, DataFrame], sums: dict[str, str]) -> DataFrame:
    """(table_name, n, total): the rows of each table and the sum of a column where one is named."""
    made = None
    for name, df in tables.items():
        total = F.round(F.sum(sums[name]) * 100).cast("long") if name in sums else F.lit(None).cast("long")
        row = df.agg(F.count("*").alias("n"), total.alias("total")).select(F.lit(name).alias("table_name"), "n", "total")
        made = row if made is None else made.union(row)
    return made


def margin_bps(part: Column, revenue: Column) -> Column:
    """A margin in basis points, rounded half up; 0 without revenue."""
    return F.when(revenue == 0, F.lit(0).cast("long")).otherwise(F.floor(part * 10_000 / revenue + 0.5).cast("long"))


def workbench(bank: DataFrame, ledger: DataFrame, matches: DataFrame) -> DataFrame:
    """One row over bank (amount, matched), ledger (amount) and matches (difference, fee): totals, counts, rate, unexplained differences, equality."""
    b = bank.agg(F.sum("amount").alias("total_bank"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))
    g = ledger.agg(F.sum("amount").alias("total_ledger"))
    m = matches.agg(F.count("*").alias("matches"), F.count_if((F.col("difference") != 0) & (F.col("fee") == 0)).alias("unexplained"))
    rate = F.round(F.col("matched") / F.greatest(F.col("matched") + F.col("unmatched"), F.lit(1).cast("long")) * 100, 1)
    return b.crossJoin(g).crossJoin(m).select("total_bank", "total_ledger", "matched", "unmatched", rate.alias("match_rate"), "matches", "unexplained", (F.col("total_bank") == F.col("total_ledger")).alias("equal"))


def manual_match(groups: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """(match_id, net_bank, net_ledger, difference) of groups (match_id, bank_ids, ledger_ids) of which both sides have a known id."""

    def side(ids: str, rows: DataFrame, name: str) -> DataFrame:
        flat = groups.select("match_id", F.explode(F.array_distinct(ids)).alias("id"))
        return flat.join(rows, "id").groupBy("match_id").agg(F.sum("amount").alias(name))

    met = side("bank_ids", bank, "net_bank").join(side("ledger_ids", ledger, "net_ledger"), "match_id")
    return met.withColumn("difference", F.col("net_bank") - F.col("net_ledger"))


def sweeps(accounts: DataFrame) -> DataFrame:
    """(source, target, excess): what collection accounts above their threshold hold beyond their buffer, to the first master pool."""
    pool = accounts.where("kind = 'MASTER_POOL'").agg(F.min("account").alias("target")).where("target IS NOT NULL")
    over = accounts.where("kind = 'COLLECTIONS' AND balance > threshold AND balance - buffer > 0")
    return over.crossJoin(F.broadcast(pool)).select(F.col("account").alias("source"), "target", (F.col("balance") - F.col("buffer")).alias("excess"))


def lowest_points(path: DataFrame, reserve: int) -> DataFrame:
    """(account, day, balance, runway, health) from (account, day, balance): the first lowest point, the first day below the reserve or 999, and its class."""
    low = path.groupBy("account").agg(F.min(F.struct("balance", "day")).alias("low"), F.coalesce(F.min(F.when(F.col("balance") < reserve, F.col("day"))), F.lit(999)).cast("int").alias("runway"))
    return low.select("account", F.col("low.day").alias("day"), F.col("low.balance").alias("balance"), "runway", F.when(F.col("runway") <= 14, "CRITICAL").when(F.col("runway") <= 30, "WARNING").otherwise("SAFE").alias("health"))


def runway(outflow: Column, total: Column) -> tuple[Column, Column]:
    """(daily burn, days that the total lasts or 999 without burn)."""
    burn = F.floor(outflow / 30 + 0.5).cast("long")
    return burn, F.when(burn > 0, F.floor(total / burn + 0.5).cast("long")).otherwise(F.lit(999).cast("long"))


def first_breaks(rows: DataFrame, opening: int = 0) -> DataFrame:
    """(statement, row_id, expected, actual): each statement's first row whose stated balance is not the balance before plus its net.

    A row without a balance carries the expected one on, so between stated balances nets are summed; after the first break nothing counts.
    """
    order = Window.partitionBy("statement").orderBy("row_id")
    said = F.when(F.col("balance") > 0, F.col("balance"))
    run = rows.withColumn("upto", F.sum("net").over(order))
    checked = run.withColumn("before", F.last(said - F.col("upto"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    expected = F.coalesce("before", F.lit(opening)) + F.col("upto")
    broken = checked.withColumn("expected", expected).where((F.col("balance") > 0) & (F.col("balance") != F.col("expected")))
    return broken.groupBy("statement").agg(F.min(F.struct("row_id", "expected", F.col("balance").alias("actual"))).alias("b")).select("statement", "b.*")


def statement_checks(heads: DataFrame, rows: DataFrame, tolerance: int = 0, infer: bool = True) -> DataFrame:
    """(statement, opening, closing, credits, debits, difference, status) from heads (statement, opening, closing) and rows (statement, row_id, posting_type, amount, balance_after).

    A missing end is inferred from the other, or both from the first and last stated balances. Status: OK, WITHIN_TOLERANCE, MISMATCH, INFERRED or UNKNOWN.
    """
    credit = F.col("posting_type") == "credit"
    net = F.when(credit, F.col("amount")).otherwise(-F.col("amount"))
    sums = rows.groupBy("statement").agg(
        F.sum(F.when(credit, F.col("amount")).otherwise(0)).alias("credits"),
        F.sum(F.when(~credit, F.col("amount")).otherwise(0)).alias("debits"),
        F.min_by(F.col("balance_after") - net, "row_id").alias("first_opening"),
        F.max_by("balance_after", "row_id").alias("last_balance"),
    )
    zero = F.lit(0).cast("long")
    met = heads.join(sums, "statement", "left").withColumn("credits", F.coalesce("credits", zero)).withColumn("debits", F.coalesce("debits", zero))
    moved = F.col("credits") - F.col("debits")
    both = F.col("opening").isNotNull() & F.col("closing").isNotNull()
    none = F.col("opening").isNull() & F.col("closing").isNull()
    opened = F.coalesce("opening", F.when(none, F.col("first_opening")).otherwise(F.col("closing") - moved)) if infer else F.col("opening")
    closed = F.coalesce("closing", F.when(none, F.col("last_balance")).otherwise(F.col("opening") + moved)) if infer else F.col("closing")
    gap = F.when(both, F.col("closing") - F.col("opening") - moved)
    status = F.when(both & (gap == 0), "OK").when(both & (F.abs(gap) <= tolerance), "WITHIN_TOLERANCE").when(both, "MISMATCH").when(opened.isNotNull() | closed.isNotNull(), "INFERRED").otherwise("UNKNOWN")
    return met.select("statement", opened.alias("opening"), closed.alias("closing"), "credits", "debits", gap.alias("difference"), status.alias("status"))


def trial_balance_totals(lines: DataFrame) -> DataFrame:
    """One row: six totals of (opening_debit, opening_credit, period_debit, period_credit, closing_debit, closing_credit) and whether each pair agrees."""
    names = [f"{when}_{side}" for when in ("opening", "period", "closing") for side in ("debit", "credit")]
    totals = lines.agg(*[F.sum(n).alias(n) for n in names])
    return totals.select(*names, *[(F.col(f"{w}_debit") == F.col(f"{w}_credit")).alias(f"{w}_balanced") for w in ("opening", "period", "closing")])
