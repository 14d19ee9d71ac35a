"""Screening against lists of names, accounts and words. Lists are small tables, broadcast after a check of their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import let
from ledgerloom.functions.names import winkler_bps, with_bonus
from ledgerloom.functions.text import unmarked_upper
from ledgerloom.plans.storage import if_small

#: Entries of a list whose index is broadcast at most.
MOST_BROADCAST = 10_000
# The words among suspicious ones that weigh more.
STRONG_WORDS = ["USDT", "BINANCE", "P2P", "OKX", "BYBIT"]


def distinct_texts(rows: DataFrame, text: str) -> DataFrame:
    """(text, said): the distinct texts of a column but null, twice. `said` hangs on a count, so that Spark does not push what a query asks of it below the grouping, onto every row."""
    return rows.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("n")).select(text, F.when(F.col("n") > 0, F.col(text)).alias("said"))


def by_text(rows: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """rows with the columns that `found`, a row for some of the distinct texts of the column `text`, has for theirs; rows whose text it lacks go."""
    made = found.withColumnRenamed(text, "__text")
    return rows.join(if_small(made), F.col(text) == F.col("__text")).drop("__text")


def keyword_alerts(rows: DataFrame, keywords: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(tx_id, `keep`, list, entry): the first keyword of the list that stands in a narration, marks and case aside. Only distinct narrations are searched."""
    found = F.lit(None).cast("string")
    for word in reversed(keywords):
        found = F.when(F.contains(F.col("t"), unmarked_upper(F.lit(word))), F.lit(word)).otherwise(found)
    texts = distinct_texts(rows, "narration").select("narration", unmarked_upper(F.col("said")).alias("t"))
    hits = texts.select("narration", found.alias("entry")).where("entry IS NOT NULL")
    return by_text(rows.select("tx_id", *keep, "narration"), "narration", hits).select("tx_id", *keep, F.lit("KEYWORD").alias("list"), "entry")


def account_alerts(rows: DataFrame, listed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(tx_id, `keep`, list, entry): the first listed account (position, account) on either side of a transaction."""
    first = if_small(listed.groupBy("account").agg(F.min("position").alias("p")), MOST_BROADCAST)
    own, other = first.select(F.col("account").alias("__own"), F.col("p").alias("p_own")), first.select(F.col("account").alias("__other"), F.col("p").alias("p_other"))
    met = rows.join(own, F.col("account") == F.col("__own"), "left").join(other, F.col("counter_account") == F.col("__other"), "left").where("p_own IS NOT NULL OR p_other IS NOT NULL")
    entry = F.when(F.col("p_other").isNull() | (F.col("p_own") <= F.col("p_other")), F.col("__own")).otherwise(F.col("__other"))
    return met.select("tx_id", *keep, F.lit("ACCOUNT").alias("list"), entry.cast("string").alias("entry"))


def least_jaro(least_bps: int, same: int) -> int:
    """The least Jaro similarity in basis points that reaches least_bps with `same` equal first letters."""
    return next((j for j in range(10_001) if with_bonus(j, same) >= least_bps), 10_001)


def lettered(df: DataFrame, name: str, least: int) -> DataFrame:
    """df with `tokens`, a name's letters numbered by how often each came before, and `prefix`, those that a partner must share one of.

    With Jaro from `least` on, shared letters m meet m / |a| + m / |b| >= (3 least - 10000) / 10000 = 1 + r. As m <= |b|, also m >= r |a|, so of
    any fixed order the first |a| - ceil(r |a|) + 1 tokens of either name hold a shared one. The order puts later repeats, and letters late in the
    alphabet, first, as these are rare.
    """
    letters = F.array_sort(F.filter(F.split(F.col(name), ""), lambda x: x != ""))
    numbered = F.transform(letters, lambda x, i: F.struct((i - F.array_position(letters, x) + 1).alias("k"), x.alias("x")))
    tokens = F.transform(F.sort_array(numbered, asc=False), lambda t: F.concat(t["x"], t["k"].cast("string")))
    least_shared = F.greatest(F.lit(1), F.ceil(F.length(name) * max(0, 3 * least - 20_000) / 10_000))
    return df.withColumn("tokens", tokens).withColumn("prefix", F.slice("tokens", F.lit(1), F.greatest(F.lit(0), F.length(name) - least_shared + 1).cast("int")))


def similar_names(names: DataFrame, listed: DataFrame, least_bps: int) -> DataFrame:
    """Rows (name, entry, position) for each distinct `name` and listed (position, entry, other) whose Jaro-Winkler similarity is least_bps or more.

    Candidates share a letter of their prefixes (see `lettered`); of those the numbers of shared letters, which bound the similarity for the
    first letters that agree, leave few for the comparison itself. Nothing at or over the threshold is ruled out.
    """
    needs = [least_jaro(least_bps, same) for same in range(5)]
    own = lettered(names.where("name <> ''"), "name", min(needs))
    index = lettered(listed.where("other <> ''"), "other", min(needs)).withColumnRenamed("tokens", "other_tokens")
    index = index.withColumn("token", F.explode("prefix")).drop("prefix")
    if listed.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        index = F.broadcast(index)
    met = own.withColumn("token", F.explode("prefix")).join(index, "token").select("name", "tokens", "position", "entry", "other", "other_tokens")
    x, y = F.length("name").cast("long"), F.length("other").cast("long")
    need = F.lit(needs[0])
    for same in range(1, 5):
        need = F.when(F.substring("name", 1, same) == F.substring("other", 1, same), needs[same]).otherwise(need)
    shared = F.size(F.array_intersect("tokens", "other_tokens"))
    pairs = met.where(shared * (x + y) * 10_000 >= (3 * need - 10_000) * x * y).select("name", "position", "entry", "other").distinct()
    return pairs.where(winkler_bps("name", "other") >= least_bps).select("name", "entry", "position")


def name_alerts(rows: DataFrame, listed: DataFrame, least_bps: int = 9_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(tx_id, `keep`, list, entry): the first listed name (position, name) that a counterparty's name is like. Only distinct names are compared."""
    own = distinct_texts(rows.where("counterparty <> ''"), "counterparty").select("counterparty", unmarked_upper(F.col("said")).alias("name"))
    entries = listed.select("position", F.col("name").alias("entry"), unmarked_upper(F.col("name")).alias("other"))
    like = similar_names(own.select("name").distinct(), entries, least_bps).groupBy("name").agg(F.min_by("entry", "position").alias("entry"))
    hits = own.join(like, "name").select("counterparty", "entry")
    return by_text(rows.select("tx_id", *keep, "counterparty"), "counterparty", hits).select("tx_id", *keep, F.lit("NAME").alias("list"), "entry")


def watchlist(rows: DataFrame, keywords: list[str], accounts: DataFrame, names: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All alerts of rows (tx_id, account, counter_account, counterparty, narration), one at most for each list; `keep` names further columns of the rows."""
    return keyword_alerts(rows, keywords, keep).unionByName(account_alerts(rows, accounts, keep)).unionByName(name_alerts(rows, names, keep=keep))


def narration_risk(narration: Column, clusters: dict[str, list[str]]) -> Column:
    """(bps, category): 9500 for a phrase of several words, 9200 or 8600 for a single word (up to three letters only standing alone); the
    greatest, ties to the first. Words that only resemble one are `resembling`'s."""
    listed = [(c, w) for c, words in clusters.items() for w in words]

    def risk(text: Column) -> Column:
        found = []
        for k, (category, word) in enumerate(listed):
            plain = unmarked_upper(F.lit(word))
            hit = F.contains(F.concat(F.lit(" "), F.trim(text), F.lit(" ")), F.concat(F.lit(" "), plain, F.lit(" "))) if len(word) <= 3 else F.contains(text, plain)
            score = 9_500 if " " in word else 9_200 if word.upper() in STRONG_WORDS else 8_600
            found.append(F.when(hit, F.struct(F.lit(score).alias("bps"), F.lit(-k).alias("order"), F.lit(category).alias("category"))))
        best = F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<bps:int,order:int,category:string>")
        return F.struct(F.coalesce(best["bps"], F.lit(0)).alias("bps"), best["category"].alias("category"))

    return let(F.regexp_replace(unmarked_upper(narration), r"\s+", " "), risk)


def resembling(rows: DataFrame, clusters: dict[str, list[str]], least_bps: int = 9_200, key: str = "tx_id", text: str = "narration") -> DataFrame:
    """(key, bps, category): 8300 where a word of more than four letters of a narration resembles a single listed word of more than four."""
    spark = rows.sparkSession
    single = [(k, c, w) for k, (c, w) in enumerate((c, w) for c, ws in clusters.items() for w in ws) if " " not in w and len(w) > 4]
    listed = spark.createDataFrame(single, "position int, entry string, word string").withColumn("other", unmarked_upper(F.col("word")))
    words = rows.select(key, F.explode(F.array_distinct(F.split(unmarked_upper(F.col(text)), r"\s+"))).alias("name")).where("length(name) > 4")
    first = similar_names(words.select("name").distinct(), listed, least_bps).groupBy("name").agg(F.min(F.struct("position", F.col("entry").alias("category"))).alias("h"))
    return words.join(if_small(first), "name").groupBy(key).agg(F.min("h").alias("h")).select(key, F.lit(8_300).alias("bps"), "h.category")


def whole_risk(rows: DataFrame, clusters: dict[str, list[str]]) -> DataFrame:
    """(tx_id, bps, category) of every row's narration: the greater of narration_risk and resembling, worked out once for each distinct narration."""
    texts = distinct_texts(rows, "narration")
    like = resembling(texts, clusters, key="narration", text="said").select("narration", F.col("bps").alias("l_bps"), F.col("category").alias("l_category"))
    met = texts.select("narration", narration_risk(F.col("said"), clusters).alias("r")).join(like, "narration", "left")
    less = F.coalesce(F.col("l_bps") > F.col("r.bps"), F.lit(False))
    found = met.select("narration", F.when(less, F.col("l_bps")).otherwise(F.col("r.bps")).alias("bps"), F.when(less, F.col("l_category")).otherwise(F.col("r.category")).alias("category"))
    risky = by_text(rows.select("tx_id", "narration"), "narration", found)
    return risky.select("tx_id", "bps", "category").union(rows.where("narration IS NULL").select("tx_id", F.lit(0), F.lit(None).cast("string")))
