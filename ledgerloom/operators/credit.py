"""Credit risk, tax and treasury rules as column expressions over one row a company, period or item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import div

MOST_BPS = 999_999


def bps(part: Column, whole: Column, most: int = MOST_BPS) -> Column:
    """part / whole in basis points, saturated; a whole of 0 saturates too."""
    wide = div(part.cast("decimal(28,0)") * 10_000, F.nullif(whole, F.lit(0).cast("long")).cast("decimal(19,0)"))
    return F.coalesce(F.least(wide, F.lit(most).cast("long")), F.lit(most)).cast("long")


def coverage(ebitda: Column, capex: Column, service: Column) -> tuple[Column, Column, Column]:
    """(ratio in basis points, category, buffer) of what is left after investment over what debts ask for."""
    left = F.greatest(ebitda - capex, F.lit(0).cast("long"))
    ratio = F.when((service == 0) | (ebitda < capex), F.lit(0).cast("long")).otherwise(bps(left, service))
    kind = F.when(service == 0, "DEBT_FREE").when((ebitda < capex) | (ratio < 10_000), "DISTRESSED").when(ratio < 13_000, "WATCHLIST").otherwise("HEALTHY")
    return ratio, kind, ebitda - capex - service


def solvency(rows: DataFrame) -> DataFrame:
    """Ratios of rows (id, ebitda, ebit, capex, principal, interest, cash, securities, receivable, inventory, current_assets, liabilities)."""
    service = F.col("principal") + F.col("interest")
    dscr, kind, buffer = coverage(F.col("ebitda"), F.col("capex"), service)
    liquid = F.col("cash") + F.col("securities") + F.col("receivable")
    quick = bps(liquid, F.col("liabilities"))
    current = F.when(F.col("current_assets") == 0, liquid + F.col("inventory")).otherwise(F.col("current_assets"))
    cover = F.when(F.col("interest") == 0, F.lit(MOST_BPS).cast("long")).when(F.col("ebit") <= 0, F.lit(0).cast("long")).otherwise(bps(F.col("ebit"), F.col("interest")))
    return rows.select(
        "id",
        dscr.alias("dscr_bps"),
        kind.alias("dscr_kind"),
        buffer.alias("dscr_buffer"),
        quick.alias("quick_bps"),
        F.when(quick >= 15_000, "STRONG").when(quick >= 10_000, "ADEQUATE").otherwise("CRITICAL").alias("quick_kind"),
        bps(current, F.col("liabilities")).alias("current_bps"),
        bps(F.col("cash") + F.col("securities"), F.col("liabilities")).alias("cash_bps"),
        cover.alias("interest_cover_bps"),
    )


# Of each scenario the factors on earnings and investment and the rise of interest, in basis points.
SCENARIOS = [("BASE", 10_000, 10_000, 0), ("MODERATE", 8_500, 10_000, 1_500), ("SEVERE", 7_000, 11_000, 3_000)]


def stressed(rows: DataFrame) -> DataFrame:
    """(id, scenario, dscr_bps, kind, buffer, passes) for each row and scenario."""
    each = rows.withColumn("s", F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(e).alias("e"), F.lit(c).alias("c"), F.lit(i).alias("i")) for n, e, c, i in SCENARIOS])))
    ebitda, capex = div(F.col("ebitda") * F.col("s.e"), 10_000), div(F.col("capex") * F.col("s.c"), 10_000)
    ratio, kind, buffer = coverage(ebitda, capex, F.col("principal") + F.col("interest") + div(F.col("interest") * F.col("s.i"), 10_000))
    return each.select("id", "s.scenario", ratio.alias("dscr_bps"), kind.alias("kind"), buffer.alias("buffer")).withColumn("passes", (F.col("dscr_bps") >= 10_000) & (F.col("kind") != "DISTRESSED"))


def debt_group(days: Column, restructured: Column) -> Column:
    """1 (standard) to 5 (loss) by days overdue; a restructured debt is one group worse."""
    group = F.when(days < 10, 1).when(days <= 90, 2).when(days <= 180, 3).when(days <= 360, 4).otherwise(5)
    return F.when(restructured, F.least(group + 1, F.lit(5))).otherwise(group)


def provisions(principal: Column, group: Column) -> tuple[Column, Column]:
    """(general, specific) provisions of a debt: 0.75 % but for losses, and 0, 5, 20, 50, 100 % by group."""
    rate = F.element_at(F.array(*[F.lit(r) for r in (0, 500, 2_000, 5_000, 10_000)]), group)
    return F.when(group < 5, div(principal * 75, 10_000)).otherwise(F.lit(0).cast("long")), div(principal * rate, 10_000)


def underwriting(rows: DataFrame) -> DataFrame:
    """(id, decision, credit_limit) from the solvency columns, days_overdue and restructured."""
    stress = stressed(rows).where("scenario = 'MODERATE'").select("id", "passes")
    group = debt_group(F.col("days_overdue"), F.col("restructured"))
    judged = rows.withColumn("debt_group", group).join(solvency(rows), "id").join(stress, "id")
    most = div(F.greatest(F.col("ebitda") - F.col("capex"), F.lit(0).cast("long")) * 10_000, 13_000) * 3
    decision = (
        F.when((F.col("debt_group") >= 3) | (F.col("dscr_kind") == "DISTRESSED"), "REJECTED")
        .when((F.col("dscr_kind") == "HEALTHY") & (F.col("quick_kind") != "CRITICAL") & (F.col("debt_group") == 1) & F.col("passes"), "APPROVED")
        .otherwise("CONDITIONAL")
    )
    limit = F.when(decision == "REJECTED", F.lit(0).cast("long")).when(decision == "APPROVED", most).otherwise(div(most * 60, 100))
    return judged.select("id", decision.alias("decision"), limit.alias("credit_limit"))


def native_coverage(ebitda: Column, capex: Column, service: Column) -> tuple[Column, Column]:
    """(ratio in basis points, category) with the other set of rules: no saturation, negative ratios, 9990000 without debts."""
    left = ebitda - capex
    ratio = F.when(service <= 0, F.lit(9_990_000).cast("long")).otherwise(div(left * 10_000, F.greatest(service, F.lit(1).cast("long"))))
    return ratio, F.when(service <= 0, "DEBT_FREE").when((left <= 0) | (ratio < 10_000), "DISTRESSED").when(ratio < 13_000, "WATCHLIST").otherwise("HEALTHY")


def native_quick(liquid: Column, liabilities: Column) -> tuple[Column, Column]:
    ratio = F.when(liabilities <= 0, F.lit(9_990_000).cast("long")).otherwise(div(liquid * 10_000, F.greatest(liabilities, F.lit(1).cast("long"))))
    return ratio, F.when(ratio >= 10_000, "STRONG").when(ratio >= 8_000, "ADEQUATE").otherwise("CRITICAL")


def income_tax_final(profit: Column, added: Column, paid: Column, rate_bps: int = 2_000) -> tuple[Column, Column, Column]:
    """(liability, still to pay, overpaid) of a year's income tax."""
    base = profit + added
    due = F.when(base > 0, div(base * rate_bps, 10_000)).otherwise(F.lit(0).cast("long"))
    return due, F.greatest(due - paid, F.lit(0).cast("long")), F.greatest(paid - due, F.lit(0).cast("long"))


def certificate(closing: Column, deposits: Column, withdrawals: Column, ledger: Column) -> tuple[Column, Column, Column]:
    """(adjusted bank balance, variance, certified) of a reconciliation."""
    adjusted = closing + deposits - withdrawals
    return adjusted, adjusted - ledger, adjusted == ledger


def quarantine_tier(amount: Column, alerted: Column) -> Column:
    return F.when(alerted | (amount >= 400_000_000), "CRITICAL").when(amount >= 100_000_000, "HIGH").when(amount >= 10_000_000, "MEDIUM").otherwise("LOW")


def report_action(severity: Column, weights: dict[str, int], file_from: int = 80, hold_from: int = 50) -> tuple[Column, Column]:
    """(risk score of at most 100, what to do) of a suspicious-transaction report."""
    score = F.lit(5)
    for name, weight in weights.items():
        score = F.when(severity == name, F.lit(min(100, weight))).otherwise(score)
    return score, F.when(score >= file_from, "FILE_REPORT").when(score >= hold_from, "COMPLIANCE_HOLD").otherwise("ENHANCED_DUE_DILIGENCE")


def cash_horizon(flows: DataFrame, starts: DataFrame, reserve: int, days: int) -> DataFrame:
    """(account, end_balance, lowest, first_below, short) of a day-by-day projection over `days` (1 to 90) from (account, day, net) and (account, start).

    Days without a flow repeat the balance before, so only days with flows are looked at; a day after the first holds all its flows.
    """
    days = min(max(days, 1), 90)
    daily = flows.where(F.col("day").between(1, days)).groupBy("account", "day").agg(F.sum("net").alias("net"))
    path = daily.join(starts, "account").withColumn("balance", F.col("start") + F.sum("net").over(Window.partitionBy("account").orderBy("day")))
    found = path.groupBy("account").agg(F.max_by("balance", "day").alias("end_balance"), F.min("balance").alias("least"), F.min(F.when(F.col("balance") < reserve, F.col("day"))).alias("dip"))
    first = F.when(F.col("start") < reserve, F.lit(1))  # a start below the reserve shows on day 1 unless that day's flows lift it
    joined = starts.join(found, "account", "left").join(path.where("day = 1").select("account", F.col("balance").alias("one")), "account", "left")
    lowest = F.least("start", F.coalesce("least", "start"))
    began = F.when(F.coalesce("one", "start") < reserve, first)
    gap = F.when(F.col("start") < reserve, began)
    return joined.select("account", F.coalesce("end_balance", "start").alias("end_balance"), lowest.alias("lowest"), F.coalesce(gap, "dip").cast("int").alias("first_below"), (lowest < reserve).alias("short"))
