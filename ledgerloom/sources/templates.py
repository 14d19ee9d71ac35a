"""Which parser reads a file: templates scored against files, and the next best one where a parse does not add up."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.storage import stored, workspace
from ledgerloom.sources.statements import container_format

TEMPLATE = "position int, template string, formats array<string>, extensions array<string>, magic array<string>, rules array<struct<target:string,pattern:string,score:int>>"
#: Templates at most, as every file meets each of them, and signs of a text that are its header, which `header_text` rules are about.
MOST_TEMPLATES, HEADER = 1_000, 4_096


class Parser(NamedTuple):
    """What reads a kind of file: rows (file, posting_type, amount, ..) and balances (file, opening, closing) from (file, content)."""

    rows: Callable[[DataFrame], DataFrame]
    balances: Callable[[DataFrame], DataFrame]


def scores(files: DataFrame, templates: DataFrame) -> DataFrame:
    """(file, template, position, score) of (file, content) against every template that does not exclude it.

    A file whose format or extension is not among those stated is excluded, and one without a stated magic number unless it is text. An extension counts
    5, a magic number 10, and each rule that matches its own score; a rule's target is `filename`, `header_text`, `full_text` (the whole text), or else either of the first two.
    """
    if templates.limit(MOST_TEMPLATES + 1).count() > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    seen = files.select("file", container_format(F.col("file"), F.col("content")).alias("format"), F.substring("content", 1, HEADER).alias("head"), F.col("content").alias("full"), F.hex(F.encode(F.substring("content", 1, 16), "UTF-8")).alias("first"))
    met = seen.crossJoin(F.broadcast(templates))
    name = F.lower("file")
    fits = (F.size("formats") == 0) | F.array_contains("formats", F.col("format"))
    ends = F.exists("extensions", lambda e: F.endswith(name, F.lower(e)))
    begins = F.exists("magic", lambda m: F.startswith(F.col("first"), F.upper(m)))

    def hit(rule: Column) -> Column:
        header, file = F.regexp(F.col("head"), rule["pattern"]), F.regexp(F.col("file"), rule["pattern"])
        return F.when(rule["target"] == "filename", file).when(rule["target"] == "header_text", header).when(rule["target"] == "full_text", F.regexp(F.col("full"), rule["pattern"])).otherwise(header | file)

    rules = F.aggregate(F.filter("rules", hit), F.lit(0), lambda acc, r: acc + r["score"])
    score = F.when(F.size("extensions") > 0, 5).otherwise(0) + F.when(begins, 10).otherwise(0) + rules
    allowed = fits & ((F.size("extensions") == 0) | ends) & ((F.size("magic") == 0) | begins | F.col("format").isin("CSV", "UNKNOWN"))
    return met.where(allowed).select("file", "template", "position", score.cast("int").alias("score"))


def adds_up(rows: DataFrame, balances: DataFrame) -> DataFrame:
    """(file) of all that have rows and whose opening balance with credits and debits gives the closing one, where both are stated."""
    signed = F.when(F.col("posting_type") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    sums = rows.groupBy("file").agg(F.sum(signed).alias("net"))
    return sums.join(balances, "file", "left").where("opening IS NULL OR closing IS NULL OR opening + net = closing").select("file")


def dispatch(files: DataFrame, templates: DataFrame, parsers: dict[str, Parser]) -> tuple[DataFrame, DataFrame]:
    """(rows with `template`, verdicts (file, template, tries)): each file read by the best template whose parse adds up, tried in order of score and position.

    In a round, each file left goes to its next template, and each parser reads its files in one job; what adds up is kept. Files that none can read
    have a null template. Rounds are at most as many as templates, and each has only what the last one left.
    """
    path = workspace(files.sparkSession)
    ranked = scores(files, templates).groupBy("file").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "position", "template"))).alias("order"))
    left = stored(files.join(ranked, "file", "left").select("file", "content", F.coalesce(F.transform("order", lambda x: x["template"]), F.array().cast("array<string>")).alias("order")), f"{path}/files")
    rounds = left.agg(F.max(F.size("order"))).first()[0] or 0
    read, verdicts = None, None
    for turn in range(rounds):
        mine = left.withColumn("template", F.get("order", F.lit(turn)))
        done = None
        for name, parser in parsers.items():
            chosen = mine.where(F.col("template") == name).select("file", "content")
            rows = stored(parser.rows(chosen).withColumn("template", F.lit(name)), f"{path}/{turn}-{name}")
            good = stored(adds_up(rows, parser.balances(chosen)), f"{path}/{turn}-{name}-good")
            kept, verdict = rows.join(good, "file", "left_semi"), good.select("file", F.lit(name).alias("template"), F.lit(turn + 1).alias("tries"))
            read = kept if read is None else read.unionByName(kept, allowMissingColumns=True)
            verdicts = verdict if verdicts is None else verdicts.union(verdict)
            done = good if done is None else done.union(good)
        left = stored(left.join(done, "file", "left_anti"), f"{path}/left-{turn}")
        if not left.limit(1).count():
            break
    unread = left.select("file", F.lit(None).cast("string").alias("template"), F.size("order").alias("tries"))
    return read, unread if verdicts is None else verdicts.union(unread)
