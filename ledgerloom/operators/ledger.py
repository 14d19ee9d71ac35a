"""Double-entry checks, balances, statements, tax and risk over journal lines (entry_id, account, side, amount)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans.storage import if_small, stored, workspace

#: A chart of accounts: (code, parent, kind, normal side).
CHART = [
    ("1", None, "ASSET", "D"),
    ("13", "1", "ASSET", "D"),
    ("131", "13", "ASSET", "D"),
    ("3", None, "LIABILITY", "C"),
    ("33", "3", "LIABILITY", "C"),
    ("333", "33", "LIABILITY", "C"),
    ("3331", "333", "LIABILITY", "C"),
    ("5", None, "REVENUE", "C"),
    ("51", "5", "REVENUE", "C"),
    ("511", "51", "REVENUE", "C"),
]


def chart(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHART, "code string, parent string, kind string, normal string")


def chart_sql() -> str:
    """The chart as DuckDB VALUES."""
    rows = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in CHART)
    return f"chart AS (SELECT * FROM (VALUES {rows}) AS t(code, parent, kind, normal))"


def signed(debit_normal: Column) -> Column:
    """Amount with the sign of the account's normal side."""
    same = (F.col("side") == "D") == debit_normal
    return F.when(same, F.col("amount")).otherwise(-F.col("amount"))


def entry_checks(lines: DataFrame, currency: str | None = None) -> DataFrame:
    """Per entry: number of lines, debit, credit, and whether it is a valid balanced entry; with a column of currencies also `currencies`, of which a valid entry has one."""
    debit = F.sum(F.when(F.col("side") == "D", F.col("amount")).otherwise(0))
    credit = F.sum(F.when(F.col("side") == "C", F.col("amount")).otherwise(0))
    kinds = F.count_distinct(currency) if currency else F.lit(1).cast("long")
    sums = lines.groupBy("entry_id").agg(F.count("*").alias("n_lines"), debit.alias("debit"), credit.alias("credit"), F.min("amount").alias("least"), kinds.alias("currencies"))
    valid = (F.col("n_lines") >= 2) & (F.col("least") > 0) & (F.col("debit") == F.col("credit")) & (F.col("currencies") == 1)
    return sums.select("entry_id", "n_lines", "debit", "credit", *(["currencies"] if currency else []), valid.alias("balanced"))


def balances(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """Balance by normal side; lines are summed by account before they meet the chart."""
    sums = lines.groupBy("account", "side").agg(F.sum("amount").alias("amount"))
    joined = sums.join(if_small(accounts), sums.account == accounts.code)
    return joined.groupBy("code", "kind").agg(F.sum(signed(F.col("normal") == "D")).alias("balance"))


def roll_up(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """Balance of every account with all below it: each code meets its ancestors level by level, as deep as the chart."""
    closure = accounts.select("code", F.col("code").alias("ancestor"))
    level, out = closure, closure
    for _ in range(accounts.count()):
        up = accounts.select(F.col("code").alias("ancestor"), "parent").where("parent IS NOT NULL")
        level = level.join(up, "ancestor").select("code", F.col("parent").alias("ancestor"))
        out = out.union(level)
        if not level.limit(1).count():
            break
    leaf = balances(lines, accounts).select("code", "balance")
    return leaf.join(if_small(out), "code").groupBy(F.col("ancestor").alias("code")).agg(F.sum("balance").alias("balance"))


def trial_balance(lines: DataFrame) -> DataFrame:
    """Debit and credit turnover by account, with a total row."""
    debit = F.sum(F.when(F.col("side") == "D", F.col("amount")).otherwise(0)).alias("debit")
    credit = F.sum(F.when(F.col("side") == "C", F.col("amount")).otherwise(0)).alias("credit")
    return lines.rollup("account").agg(debit, credit).select(F.coalesce("account", F.lit("TOTAL")).alias("account"), "debit", "credit")


def _sides() -> list[Column]:
    left = F.sum(F.when(F.col("kind").isin("ASSET", "EXPENSE"), F.col("balance")).otherwise(0)).alias("left_side")
    right = F.sum(F.when(F.col("kind").isin("LIABILITY", "EQUITY", "REVENUE"), F.col("balance")).otherwise(0)).alias("right_side")
    return [left, right]


def equation(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """Assets and expenses against liabilities, equity and revenue."""
    return balances(lines, accounts).agg(*_sides()).withColumn("holds", F.col("left_side") == F.col("right_side"))


def equation_by_currency(lines: DataFrame, accounts: DataFrame, currency: str = "currency") -> DataFrame:
    """The same for each currency; money of different ones never adds up."""
    sums = lines.groupBy(currency, "account", "side").agg(F.sum("amount").alias("amount"))
    joined = sums.join(if_small(accounts), sums.account == accounts.code).groupBy(currency, "code", "kind").agg(F.sum(signed(F.col("normal") == "D")).alias("balance"))
    return joined.groupBy(currency).agg(*_sides()).withColumn("holds", F.col("left_side") == F.col("right_side"))


def income_statement(months: DataFrame, tax_bps: int = 2_000) -> DataFrame:
    """(period, revenue, deductions, cogs, expense) to net revenue, gross profit, profit before and after tax; tax only on profit."""
    lines = months.withColumn("net_revenue", F.col("revenue") - F.col("deductions")).withColumn("gross_profit", F.col("net_revenue") - F.col("cogs")).withColumn("before_tax", F.col("gross_profit") - F.col("expense"))
    tax = F.expr(f"CASE WHEN before_tax > 0 THEN before_tax * {tax_bps} DIV 10000 ELSE 0 END")
    return lines.withColumn("tax", tax).withColumn("after_tax", F.col("before_tax") - F.col("tax"))


def vat_return(sales: DataFrame) -> DataFrame:
    """(period, sales_8, sales_10, input_tax): output tax by integer division, payable or carried forward."""
    due = sales.withColumn("output_tax", F.expr("sales_8 * 8 DIV 100 + sales_10 * 10 DIV 100")).withColumn("net", F.col("output_tax") - F.col("input_tax"))
    return due.select("period", "output_tax", "input_tax", F.greatest(F.lit(0), F.col("net")).alias("payable"), F.greatest(F.lit(0), -F.col("net")).alias("carried"))


def unbundle(gross: Column, rate_percent: int) -> tuple[Column, Column]:
    """(net, tax) of an amount that includes tax; net is cut off and both add up to gross."""
    net = F.call_function("div", gross * 100, F.lit(100 + rate_percent).cast("long"))
    return net, gross - net


def allocate(parts: DataFrame, group: str, total: str, weight: str, key: str) -> DataFrame:
    """Largest-remainder shares of `total` by weight inside each group; shares add up to the total exactly."""
    every = Window.partitionBy(group)
    weighed = parts.withColumn("all_weight", F.sum(weight).over(every)).withColumn("share", F.expr(f"{total} * {weight} DIV all_weight")).withColumn("rest", F.expr(f"{total} * {weight} % all_weight"))
    spare = F.col(total) - F.sum("share").over(every)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("rest").desc(), key))
    return weighed.withColumn("spare", spare).withColumn("rank", rank).select(group, key, (F.col("share") + F.when(F.col("rank") <= F.col("spare"), 1).otherwise(0)).alias("share"))


def running_breaks(lines: DataFrame, group: str, order: str) -> DataFrame:
    """Rows whose balance is not the previous balance plus their own movement."""
    by = Window.partitionBy(group).orderBy(order)
    return lines.withColumn("expected", F.lag("balance").over(by) + F.col("movement")).where("expected <> balance").select(group, order, "balance", "expected")


def cash_forecast(flows: DataFrame, opening: int, reserve: int) -> DataFrame:
    """(day, net) to running balance, running minimum and whether the reserve is breached; days are few by nature."""
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    ran = flows.withColumn("balance", F.lit(opening) + F.sum("net").over(upto))
    return ran.withColumn("lowest", F.min("balance").over(upto)).withColumn("breach", F.col("balance") < reserve)


def ratio_bps(a: Column, b: Column, top: int = 999_999) -> Column:
    """a / b in basis points by integer division, at most `top`; `top` when b is not positive."""
    return F.when(b > 0, F.least(F.call_function("div", a * 10_000, F.greatest(b, F.lit(1))), F.lit(top))).otherwise(F.lit(top))


def debt_group(days: Column) -> Column:
    return F.when(days < 10, 1).when(days <= 90, 2).when(days <= 180, 3).when(days <= 360, 4).otherwise(5)


def provision(principal: Column, group: Column) -> Column:
    """General 0.75 % but for group 5, and specific 0, 5, 20, 50 or 100 % by group."""
    general = F.when(group < 5, F.call_function("div", principal * 75, F.lit(10_000).cast("long"))).otherwise(F.lit(0))
    percent = F.when(group == 1, 0).when(group == 2, 5).when(group == 3, 20).when(group == 4, 50).otherwise(100)
    return general + F.call_function("div", principal * percent, F.lit(100).cast("long"))


def approval_tier(amount: Column, bounds: tuple[int, ...] = (5_000_000, 20_000_000, 40_000_000)) -> Column:
    tier = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        tier = F.when(amount < bounds[k], k).otherwise(tier)
    return tier


def chart_faults(accounts: DataFrame) -> DataFrame:
    """(code, fault) of a chart (code, parent, kind): DUPLICATE, MISSING_PARENT, OTHER_KIND than its parent's, or CYCLE.

    Cycles are what is left when accounts that lead to a top are taken away, doubling the way at each step.
    """
    known = accounts.select("code", "parent", "kind")
    double = known.groupBy("code").count().where("count > 1").select("code", F.lit("DUPLICATE").alias("fault"))
    up = known.select(F.col("code").alias("p"), F.col("kind").alias("p_kind")).dropDuplicates(["p"])
    met = known.where("parent IS NOT NULL").join(up, F.col("parent") == F.col("p"), "left")
    missing = met.where("p IS NULL").select("code", F.lit("MISSING_PARENT"))
    other = met.where("p_kind <> kind").select("code", F.lit("OTHER_KIND"))
    steps = met.where("p IS NOT NULL").select("code", F.col("parent").alias("to")).dropDuplicates(["code"])
    n, hop, path = steps.count(), 1, workspace(accounts.sparkSession)
    while hop <= n:  # after more steps than there are accounts only those on or below a cycle still lead on
        steps = stored(steps.alias("a").join(steps.alias("b"), F.col("a.to") == F.col("b.code")).select(F.col("a.code"), F.col("b.to")), f"{path}/steps-{hop}")
        hop = 2 * hop if steps.limit(1).count() else n + 1
    return double.union(missing).union(other).union(steps.select("code", F.lit("CYCLE")))


def cash_flow_sections(flows: DataFrame, opening: int = 0) -> DataFrame:
    """(period, operating, investing, financing, net, closing) from (period, section, inflow, outflow); one row a period, so the running sum is bounded by the calendar."""
    net = F.col("inflow") - F.col("outflow")
    sums = flows.groupBy("period").agg(*[F.sum(F.when(F.col("section") == s, net).otherwise(0)).alias(s) for s in ("operating", "investing", "financing")])
    total = sums.withColumn("net", F.col("operating") + F.col("investing") + F.col("financing"))
    return total.withColumn("closing", F.lit(opening) + F.sum("net").over(Window.orderBy("period")))
