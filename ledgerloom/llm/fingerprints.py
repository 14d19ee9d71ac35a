"""Operator 1: document fingerprints from closed syncmers. DataFrame operations only.

A text becomes short units: each run of up to UNIT signs inside a word. Every K consecutive units form a k-mer, every S
a smaller window inside it. A k-mer is kept (a closed syncmer) when the smallest hash among its inner windows lies
at its first or last place, which depends on nothing outside the k-mer; so equal passages yield equal anchors
wherever they stand. A fingerprint holds the smallest `SKETCH` distinct anchor hashes, ascending, each with the first place it stands at.
Two fingerprints are compared by position: of the smallest hashes of either, those in both are matched, and a match counts if it stands at the
same place in both, or if another match is moved by as many units; so passages count that keep their order and distances, and single anchors
that agree by chance do not.

Defined cases: a null text counts as empty; a text without units has an empty fingerprint, which is like only another
empty one; a text of fewer than K units has the hashes of its single units as anchors. Rows with a null id come first, in the order of a hash
of their texts; repeated rows follow each other like any; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import let
from ledgerloom.llm.common import block_of

UNIT, K, S, SKETCH = 4, 4, 2, 64
#: K - S + 1 = 3 inner windows: the smallest lies at an edge unless the middle one is smaller than both.
assert K - S == 2


def with_anchors(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """df with array column `name` of (position, hash); positions count units."""
    units, inner = f"__{name}_units", f"__{name}_inner"
    out = df.withColumn(units, F.transform(F.regexp_extract_all(F.col(text_col), F.lit(rf"\S{{1,{UNIT}}}"), F.lit(0)), lambda u: F.xxhash64(u)))
    out = out.withColumn(
        inner,
        F.when(F.size(units) >= K, F.transform(F.sequence(F.lit(0), F.size(units) - S), lambda i: F.xxhash64(F.get(units, i), F.get(units, i + 1)))).otherwise(F.array().cast("array<bigint>")),
    )
    h = F.col(inner)
    last = F.size(inner) - 3
    closed = F.filter(F.sequence(F.lit(0), last), lambda i: ~((F.get(h, i + 1) < F.get(h, i)) & (F.get(h, i + 1) < F.get(h, i + 2))))
    long_ = F.transform(closed, lambda i: F.struct(i.alias("position"), F.xxhash64(F.get(h, i), F.get(h, i + 2)).alias("hash")))
    short = F.transform(F.col(units), lambda u, i: F.struct(i.alias("position"), u.alias("hash")))
    return out.withColumn(name, F.when(F.size(inner) >= 3, long_).otherwise(short)).drop(units, inner)


def with_sketch(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """df with array column `name` of (hash, position): the smallest SKETCH distinct anchor hashes, ascending, with their first positions."""
    anchors = f"__{name}_anchors"
    ordered = F.sort_array(F.transform(F.col(anchors), lambda a: F.struct(a["hash"].alias("hash"), a["position"].alias("position"))))
    first = let(ordered, lambda held: F.filter(held, lambda a, i: (i == 0) | (F.get(held, i - 1)["hash"] != a["hash"])))
    return with_anchors(df, text_col, anchors).withColumn(name, F.slice(first, 1, SKETCH)).drop(anchors)


def likeness(one: Column, two: Column) -> Column:
    """The share of matches by position among the smallest SKETCH hashes of either sketch; 1 for two empty ones."""

    def compared(held: Column) -> Column:
        a, b = held["a"], held["b"]
        either = F.slice(F.sort_array(F.array_union(a["hash"], b["hash"])), 1, SKETCH)
        spots = F.transform(a, lambda x: F.struct(x["hash"].alias("hash"), x["position"].alias("position"), F.array_position(b["hash"], x["hash"]).cast("int").alias("at")))
        moved = let(F.struct(spots.alias("spots"), F.element_at(either, -1).alias("last")), lambda m: F.transform(F.filter(m["spots"], lambda x: (x["at"] > 0) & (x["hash"] <= m["last"])), lambda x: F.get(b, x["at"] - 1)["position"] - x["position"]))
        agree = let(moved, lambda shifts: F.size(F.filter(shifts, lambda s: (s == 0) | (F.size(F.filter(shifts, lambda t: t == s)) > 1))))
        return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(agree / F.size(either))

    return let(F.struct(one.alias("a"), two.alias("b")), compared)


def as_text(sketch: Column) -> Column:
    """Each hash in sixteen hexadecimal digits, and its position in as many as it takes, between a colon and a comma."""
    return F.array_join(F.transform(sketch, lambda a: F.concat(F.lpad(F.hex(a["hash"]), 16, "0"), F.lit(":"), F.hex(a["position"].cast("long")))), ",")


def with_next(docs: DataFrame, id_col: str, tie: str, prepare: Callable[[DataFrame], DataFrame], columns: list[str], rows_per_block: int = 256) -> DataFrame:
    """docs, what `prepare` adds, and under `next` the `columns` of the document that follows in ascending id (after the last: the first).

    Rows of null ids come first, in the order of a hash of `tie`. Rows are dealt into blocks of about as many rows (see block_of); the first
    row of each block also goes, as a guest, to the block before it, so that one shuffle by block holds every pair. Only one row a
    block is broadcast, of ids and hashes. `prepare` runs after the shuffle, so what it adds is not moved.
    """
    n = docs.count()
    placed = docs.withColumn("__block", block_of(docs, id_col, F.col(tie), max(rows_per_block, n >> 16))).withColumn("__tie", F.xxhash64(tie))
    place = F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.col("__tie").alias("tie"))
    firsts = placed.groupBy("__block").agg(F.min(place).alias("__first"))
    host = F.coalesce(F.lag("__block").over(Window.orderBy("__block")), F.max("__block").over(Window.partitionBy(F.lit(0))))
    hosted = placed.join(F.broadcast(firsts.select(F.col("__block").alias("__of"), "__first", host.alias("__host"))), (F.col("__block") == F.col("__of")) & (place == F.col("__first")), "left")
    at_home = F.struct(F.col("__block").alias("block"), F.lit(0).alias("guest"))
    abroad = F.when(F.col("__host").isNotNull(), F.struct(F.col("__host").alias("block"), F.lit(1).alias("guest")))
    dealt = hosted.withColumn("__stay", F.explode(F.array_compact(F.array(at_home, abroad)))).withColumn("__to", F.col("__stay.block")).withColumn("__guest", F.col("__stay.guest"))
    there = prepare(dealt.drop("__block", "__of", "__first", "__host", "__stay").repartition("__to"))
    order = Window.partitionBy("__to").orderBy("__guest", F.col(id_col).asc_nulls_first(), "__tie", tie)
    return there.withColumn("next", F.lead(F.struct(*columns)).over(order)).where("__guest = 0").drop("__to", "__guest", "__tie")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    The edited text has the last floor(n / 4) code points of the text replaced by the first as many (or all) of the
    next document in ascending id, after the last the first; a document alone in its table follows itself.
    """
    own = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    paired = with_next(own, "doc_id", "text", lambda df: with_sketch(df, "text", "sketch"), ["text", "sketch"])
    sized = paired.withColumn("n_chars", F.length("text").cast("long")).withColumn("quarter", F.expr("CAST(length(text) DIV 4 AS INT)"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.col("quarter")).cast("int"))
    edited = sized.select("doc_id", "n_chars", "sketch", F.col("next.sketch").alias("next_sketch"), F.concat(kept, F.substring(F.col("next.text"), F.lit(1), F.col("quarter"))).alias("edited"))
    return with_sketch(edited, "edited", "edited_sketch").select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def positional_matches(docs: DataFrame, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ref_doc, shift, n): n anchors of a document, `least` or more, stand in the same order and distance in an earlier one.

    Each anchor is looked up under the first (doc_id, position) that has it; anchors that agree in document and shift, how many units later
    they stand here, are counted. So every document meets the first place of each anchor only, however many share it. Rows without an id
    take no part; of repeated ids all rows count together; an empty table gives no rows.
    """
    own = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    anchors = with_anchors(own, "text", "a").select("doc_id", F.inline(F.array_distinct("a")))
    first = anchors.groupBy("hash").agg(F.min(F.struct("doc_id", "position")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last").select("hash", "first")
    met = anchors.join(first, "hash").where("doc_id > first.doc_id")
    counted = met.groupBy("doc_id", F.col("first.doc_id").alias("ref_doc"), (F.col("position") - F.col("first.position")).alias("shift")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)
