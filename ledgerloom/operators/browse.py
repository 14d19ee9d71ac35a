"""Filters with optional parts, browsing, queues, retention and version chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.storage import if_small, stored, workspace


def matching(rows: DataFrame, equal: dict[str, object] | None = None, at_least: dict[str, object] | None = None, below: dict[str, object] | None = None) -> DataFrame:
    """Rows that meet every stated condition; a value of None states nothing, and without any all rows stay."""
    keep = F.lit(True)
    for name, value in (equal or {}).items():
        keep = keep if value is None else keep & (F.col(name) == value)
    for name, value in (at_least or {}).items():
        keep = keep if value is None else keep & (F.col(name) >= value)
    for name, value in (below or {}).items():
        keep = keep if value is None else keep & (F.col(name) < value)
    return rows.where(keep)


def found_in(text: str, columns: list[str]) -> Column:
    """Whether any of the columns holds a text, case aside; an empty text is in all."""
    hit = F.lit(text == "")
    for c in columns:
        hit = hit | F.contains(F.lower(c), F.lit(text.lower()))
    return F.coalesce(hit, F.lit(False))


def rule_hits(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """(tx_id, rule): the rule of highest priority whose conditions all hold, else `DEFAULT`.

    A rule has an id, a priority and any of direction, banks, lowest, highest, patterns (one must match the narration).
    """
    chosen = F.lit("DEFAULT")
    for rule in sorted(rules, key=lambda r: r["priority"]):
        keep = F.lit(True)
        if "direction" in rule:
            keep = keep & (F.col("is_credit") == (rule["direction"] == "credit"))
        if "banks" in rule:
            keep = keep & F.col("bank").isin(rule["banks"])
        if "lowest" in rule:
            keep = keep & (F.col("amount") >= rule["lowest"])
        if "highest" in rule:
            keep = keep & (F.col("amount") <= rule["highest"])
        if "patterns" in rule:
            keep = keep & F.col("narration").rlike("(?i)" + "|".join(rule["patterns"]))
        chosen = F.when(keep, rule["id"]).otherwise(chosen)
    return rows.select("tx_id", chosen.alias("rule"))


def allowed(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """Requests (role, tool, maker, checker) that the role table (role, tool) permits and whose maker does not check their own work."""
    return requests.join(if_small(permissions), ["role", "tool"], "left_semi").where("maker <> checker")


def oldest_first(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def bounded_queues(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Rows that a queue of at most `most` a key still holds after the oldest were put out; ties by the later columns of `order`.

    The rank is cut off inside the window's sort, so a hot key keeps `most` rows in memory.
    """
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__place", F.row_number().over(newest)).where(F.col("__place") <= most).drop("__place")


def version_chains(heads: DataFrame, versions: DataFrame, most: int = 1000) -> DataFrame:
    """(item, version, place): from each item's current version along its parents, until there is none, one was met before, or `most` are listed.

    Ways double in length each round, so a chain of `most` versions takes about log2(most) rounds; each is stored, or plans would double too.
    """
    path = workspace(heads.sparkSession)
    steps = versions.select(F.col("version").alias("from_version"), F.col("parent").alias("to_version"))
    jumps, hop = steps.where("to_version IS NOT NULL"), 1
    reached = heads.join(versions.select("version"), F.col("current") == F.col("version")).select("item", "version", F.lit(0).cast("long").alias("place"))
    while hop < most:
        onward = reached.join(jumps, reached["version"] == jumps["from_version"]).select("item", F.col("to_version").alias("version"), (F.col("place") + hop).alias("place"))
        onward = onward.join(versions.select("version"), "version", "left_semi").select("item", "version", "place")
        # a version met again keeps its first place
        reached = stored(reached.union(onward).groupBy("item", "version").agg(F.min("place").alias("place")), f"{path}/reached-{hop}")
        double = jumps.alias("a").join(jumps.alias("b"), F.col("a.to_version") == F.col("b.from_version")).select(F.col("a.from_version"), F.col("b.to_version"))
        jumps, hop = stored(double, f"{path}/jumps-{hop}"), 2 * hop
        if not jumps.limit(1).count():
            break
    return reached.where(F.col("place") < most)


def deletion(tables: dict[str, DataFrame], key: str, gone: DataFrame, audit: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(what is left of each table, audit rows (action, table_name, deleted)) after the keys in `gone` are taken out of all of them."""
    left, counts = {}, None
    for name, df in tables.items():
        left[name] = df.join(gone.select(key), key, "left_anti")
        row = df.join(gone.select(key), key, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(audit).alias("action"), F.lit(name).alias("table_name"), "deleted")
        counts = row if counts is None else counts.union(row)
    return left, counts


def due_for_sweep(activity: DataFrame, cutoff: int, batch: int) -> tuple[DataFrame, DataFrame]:
    """(the `batch` keys longest idle before the cutoff, one row has_more) from (key, ts)."""
    idle = activity.groupBy("key").agg(F.max("ts").alias("last_ts")).where(F.col("last_ts") < cutoff)
    first = idle.orderBy("last_ts", "key").limit(batch + 1)
    place = F.row_number().over(Window.orderBy("last_ts", "key"))  # at most batch + 1 rows
    return first.withColumn("r", place).where(F.col("r") <= batch).drop("r"), first.agg((F.count("*") > batch).alias("has_more"))


def resolve_contacts(asked: DataFrame, contacts: DataFrame) -> DataFrame:
    """(ask, status, contact): of contacts (contact, key) the one with the asked key, else the one that has it as whole words; FOUND, AMBIGUOUS or NOT_FOUND.

    Words of keys are indexed, so a request meets only contacts that share its first word.
    """
    exact = asked.join(contacts, "key").select("ask", "contact", F.lit(0).alias("stage"))
    words = contacts.select("contact", F.col("key").alias("full"), F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    partial = asked.where("key <> ''").withColumn("word", F.split_part("key", F.lit(" "), F.lit(1))).join(words, "word").where(F.contains(F.concat(F.lit(" "), "full", F.lit(" ")), F.concat(F.lit(" "), "key", F.lit(" "))))
    both = exact.union(partial.select("ask", "contact", F.lit(1))).groupBy("ask", "stage").agg(F.count("*").alias("n"), F.min("contact").alias("contact"))
    best = both.groupBy("ask").agg(F.min_by(F.struct("n", "contact"), "stage").alias("b"))
    out = asked.join(best, "ask", "left")
    status = F.when(F.col("b").isNull(), "NOT_FOUND").when(F.col("b.n") == 1, "FOUND").otherwise("AMBIGUOUS")
    return out.select("ask", status.alias("status"), F.when(F.col("b.n") == 1, F.col("b.contact")).alias("contact"))


def channel_flags(accounts: DataFrame, chosen: list[str]) -> DataFrame:
    """(id, active, breached, displayed) of accounts (id, status, bank, channel, balance, reserve): a balance below a stated reserve breaches it, and an account is displayed whose
    bank or channel is chosen, or any if ALL is."""
    shown = F.lit(True) if "ALL" in chosen else F.col("bank").isin(chosen) | F.col("channel").isin(chosen)
    return accounts.select("id", (F.col("status") == "ACTIVE").alias("active"), F.coalesce(F.col("balance") < F.col("reserve"), F.lit(False)).alias("breached"), F.coalesce(shown, F.lit(False)).alias("displayed"))
