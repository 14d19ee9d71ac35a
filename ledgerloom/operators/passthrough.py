"""Pass-through without a time limit, and the rule set of five detectors that it belongs to.

Transactions are (tx_id, amount, ts, is_credit, narration); tx_id gives their order in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import div

#: Places of the input in a block. A window never holds more of one key than the rows of a block.
BLOCK = 1 << 16


def _spans(low: Column, high: Column, levels: int) -> Column:
    """The whole numbers from low to high as at most two aligned spans of each width 2**level: an array of (level, at)."""

    def of(level: int) -> Column:
        width = F.lit(1 << level).cast("long")
        left, right = div(low + width - 1, width), div(high + 1, width)
        take = F.array(F.when(left % 2 == 1, left), F.when((right % 2 == 1), right - 1))
        return F.when(left < right, F.array_distinct(F.array_compact(take))).otherwise(F.array().cast("array<bigint>"))

    def named(level: int) -> Column:
        return F.transform(of(level), lambda at: F.struct(F.lit(level).alias("level"), at.alias("at")))

    return F.concat(*[named(k) for k in range(levels)])


def later_drains(tx: DataFrame, floor: int = 2_000, least_percent: int = 90, most_percent: int = 100) -> DataFrame:
    """(in_id, out_id): for each credit of at least `floor` the first debit later in the input, on any account and after any time, of least to most per cent of it.

    The amounts asked for are cut into aligned spans, two of each width at most, and each debit stands in one span of each width; so a credit asks a few
    dozen spans for their next debit, however many debits the span has. The next one in the same block of the input comes from a window, and else from
    the first debits of later blocks. No pair is made that is not asked for, and no key of an account or a day.
    """
    into = tx.where(F.col("is_credit") & (F.col("amount") >= floor)).select(F.col("tx_id").alias("pos"), div(F.col("amount") * least_percent + 99, 100).alias("low"), div(F.col("amount") * most_percent, 100).alias("high"))
    out = tx.where(~F.col("is_credit") & (F.col("amount") > 0)).select(F.col("tx_id").alias("pos"), "amount")
    widest = into.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0] or 1
    levels = int(widest).bit_length()
    there = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("amount", k).alias("at")) for k in range(levels)])
    debits = out.select("pos", F.explode(there).alias("span")).select("span.*", "pos")
    asked = into.where("low <= high").select("pos", F.explode(_spans(F.col("low"), F.col("high"), levels)).alias("span")).select("span.*", "pos")
    block = F.expr(f"pos DIV {BLOCK}").alias("block")
    both = debits.select("level", "at", block, "pos", F.col("pos").alias("out")).union(asked.select("level", "at", block, "pos", F.lit(None).cast("long")))
    # from the last place backwards: a frame that only grows is worked on once, one that shrinks is read again for each row
    ahead = Window.partitionBy("level", "at", "block").orderBy(-F.col("pos")).rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("next", F.min("out").over(ahead)).where("out IS NULL")
    # spans without a debit in the rest of the block: the first one of the blocks after it
    firsts = debits.groupBy("level", "at", block).agg(F.min("pos").alias("first"))
    open_ = near.where("next IS NULL").select("level", "at", "block").distinct().withColumn("first", F.lit(None).cast("long"))
    later = Window.partitionBy("level", "at").orderBy(-F.col("block")).rangeBetween(Window.unboundedPreceding, -1)
    far = firsts.withColumn("asks", F.lit(False)).union(open_.withColumn("asks", F.lit(True))).withColumn("far", F.min("first").over(later)).where("asks").select("level", "at", "block", "far")
    found = near.join(far, ["level", "at", "block"], "left").select(F.col("pos").alias("in_id"), F.coalesce("next", "far").alias("out_id"))
    return found.where("out_id IS NOT NULL").groupBy("in_id").agg(F.min("out_id").alias("out_id"))


def five_detectors(tx: DataFrame, keywords: list[str], high: int = 20_000, critical: int = 30_000, night_floor: int = 10_000, least: int = 3, floor: int = 2_000) -> DataFrame:
    """(kind, severity, alert, tx_id, total): a row for each transaction of each alert of high values, structuring days, money at night, pass-through and listed words.

    Nights are 23:00 to 04:59 of the clock that ts is on; an alert is named by its first transaction, or its day.
    """
    day = F.expr("ts DIV 86400")

    def one(rows: DataFrame, kind: str, severity: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), severity.alias("severity"), F.col("tx_id").alias("alert"), "tx_id", F.col("amount").alias("total"))

    worst, bad = F.lit("CRITICAL"), F.lit("HIGH")
    hour = F.expr("pmod(ts, 86400) DIV 3600")
    text, hit = F.lower("narration"), F.lit(False)
    for word in keywords:
        hit = hit | F.contains(text, F.lit(word.lower()))
    small = tx.where((F.col("amount") > 0) & (F.col("amount") < high)).withColumn("day", day)
    days = small.groupBy("day").agg(F.count("*").alias("n"), F.sum("amount").alias("total")).where((F.col("n") >= least) & (F.col("total") >= high))  # no more than days in the calendar
    split = small.join(F.broadcast(days), "day").select(F.lit("STRUCTURING_SMURFING"), worst, F.col("day"), "tx_id", "total")
    pairs = later_drains(tx, floor).join(tx.select(F.col("tx_id").alias("in_id"), "amount"), "in_id")
    drained = pairs.select(F.lit("RAPID_PASS_THROUGH"), worst, F.col("in_id"), F.explode(F.array("in_id", "out_id")), "amount")
    out = one(tx.where(F.col("amount") >= high), "HIGH_VALUE", F.when(F.col("amount") >= critical, worst).otherwise(bad)).union(split)
    return out.union(one(tx.where((F.col("amount") >= night_floor) & ((hour >= 23) | (hour < 5))), "NIGHT_VELOCITY", bad)).union(drained).union(one(tx.where(hit), "WATCHLIST_HIT", worst))
