"""Operator 13: how five filters interact, with duplicates found by sorting.

Failure conditions of a text: A under 200 words; B 100 * distinct words < 50 * words; C 100 * [A-Z] > 2 * code points; D any of `#$%&*|`; E identical to a text
with a smaller doc_id. For E the table is sorted by ranges of (text fingerprint, doc_id), and inside a range by (fingerprint, full text, doc_id); a row
is compared with its predecessor, so that nothing but the last text is held, and a text with any number of copies spreads over as many ranges as it
fills. Bounds of ranges are drawn from fingerprints and ids, never from texts. At the border of two ranges a text may go on: rows with the first fingerprint
of a range stay open, each range tells the smallest doc_id of each text with its last fingerprint, and those few facts settle the open rows.

A document is then a mask of five bits. Masks are counted by part, and every figure of the report is a sum of such counts, so parts add up.

Defined cases: a null text is an empty one, a null source the part ""; a row with a null doc_id never fails E nor makes others fail it, and has no labels; rows that repeat
an id and its text are no copies of each other; a document is good (toxic) if any of its label rows says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored, workspace

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SIGNS = 200, 50, 2, b"#$%&*|"
UPPER = bytes(range(65, 91))
#: The bytes of UTF-8 that begin no code point.
INNER = bytes(range(0x80, 0xC0))
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text whose words are listed at once.
LISTED = 1 << 20
#: mask: failures; open: with the first fingerprint of a range; told: no document, but the smallest id of a text with the last one.
SCANNED = "doc_id long, part string, mask int, open boolean, told boolean, key binary, low long"


def own_failures(text: bytes) -> int:
    """The bits of A to D."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        cut = BLANK.search(text, at + LISTED)
        to = cut.start() if cut else len(text)
        words = text[at:to].split()  # of bytes, by ASCII white space
        n, at = n + len(words), to
        seen.update(words)
    upper, points = (len(text) - len(text.translate(None, some)) for some in (UPPER, INNER))
    fails = n < MIN_WORDS, 100 * len(seen) < MIN_DISTINCT * n, 100 * upper > MAX_UPPER * (len(text) - points), len(text.translate(None, SIGNS)) < len(text)
    return sum(1 << k for k, f in enumerate(fails) if f)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of (fp, text, doc_id, part), in order, as rows of SCANNED."""
    names = ["doc_id", "part", "mask", "open", "told", "key", "low"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    first = fp = text = low = key = None
    mask, told = 0, {}
    for batch in batches:
        out = []
        ids, parts, prints = (batch.column(c).to_pylist() for c in ("doc_id", "part", "fp"))
        for doc_id, part, this, held in zip(ids, parts, prints, batch.column("text"), strict=True):
            now = held.as_py()
            if this != fp or now != text:
                if this != fp:
                    told = {}
                elif text is not None:
                    told[hashlib.sha256(text).digest()] = low
                first = this if first is None else first
                fp, text, low, mask = this, now, None, own_failures(now)
                key = hashlib.sha256(now).digest() if this == first else None
            low = doc_id if low is None else low
            copy = doc_id is not None and doc_id > low
            out.append((doc_id, part, mask | copy << 4, this == first, False, key, low))
        if out:
            yield table(out)
    if text is not None:
        told[hashlib.sha256(text).digest()] = low
        yield table([(None, None, None, False, True, k, v) for k, v in told.items()])


def failures(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, part, mask), one for each row of docs (doc_id long, part string, text string)."""
    printed = docs.select(F.xxhash64("text").alias("fp"), F.encode("text", "UTF-8").alias("text"), "doc_id", "part")
    sorted_ = printed.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    rows = stored(sorted_.mapInArrow(scan, SCANNED), f"{path}/scanned")
    before = rows.where("told").groupBy("key").agg(F.min("low").alias("earlier"))
    opened = rows.where("open AND NOT told").join(F.broadcast(before), "key", "left")  # a row for each range and text of its last fingerprint
    late = F.coalesce(F.col("doc_id") > F.least("low", "earlier"), F.lit(False))
    settled = opened.withColumn("mask", F.col("mask").bitwiseOR(F.when(late, 16).otherwise(0)))
    return rows.where("NOT open AND NOT told").select("doc_id", "part", "mask").union(settled.select("doc_id", "part", "mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic): how many documents, and how many of them are labelled so."""
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    none = F.lit(0).cast("long")
    all_ = failed.groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", none.alias("good"), none.alias("toxic"))
    known = failed.join(said.where("good + toxic > 0"), "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    both = all_.union(known.select("part", "mask", none, "good", "toxic"))
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def report(counts: DataFrame) -> DataFrame:
    """The figures of every part, order and step from counts (part, mask, n, good, toxic) that may be partial sums."""
    summed = counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    parts = summed.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("held"))  # 32 masks at most

    def array(c: str) -> Column:
        return F.expr(f"transform(sequence(0, {MASKS - 1}), m -> coalesce(held[m].{c}, 0L))").alias(c)

    def passing(c: str) -> Column:  # for each set of filters, the documents that fail none of them
        return F.expr(f"transform(sequence(0, {MASKS - 1}), s -> aggregate(transform({c}, (x, m) -> if(m & s = 0, x, 0L)), 0L, (x, y) -> x + y))").alias(f"{c}_passing")

    arrays = parts.select("part", array("n"), array("good"), array("toxic"))
    # a document with k failures is removed by each of its filters in 120 / k of the orders
    share = F.expr(f"transform(sequence(0, {len(FILTERS) - 1}), k -> aggregate(transform(n, (x, m) -> if((m >> k) & 1 = 1, x * (120L div bit_count(m)), 0L)), 0L, (x, y) -> x + y))")
    held = arrays.select("part", "n", passing("n"), passing("good"), passing("toxic"), share.alias("shapley"))
    orders = F.split(F.lit(" ".join("".join(o) for o in permutations(FILTERS))), " ")
    rows = held.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    places = F.expr(f"transform(split(filter_order, ''), c -> instr('{FILTERS}', c) - 1)")
    rows = rows.withColumn("places", places).withColumn("k", F.get("places", F.col("step") - 1)).withColumn("bit", F.expr("shiftleft(1, k)"))
    rows = rows.withColumn("before", F.expr("aggregate(slice(places, 1, step - 1), 0, (x, k) -> x | shiftleft(1, k))"))

    def gone(c: str) -> Column:
        return F.expr(f"{c}_passing[before] - {c}_passing[before | bit]")

    figures = {"kept": F.expr("n_passing[before | bit]"), "removed": gone("n"), "redundant": F.expr("n_passing[0] - n_passing[bit]") - gone("n"), "unique_fails": F.expr("n[bit]"), "good_lost": gone("good"), "toxic_lost": gone("toxic"), "shapley": F.expr("shapley[k]")}
    return rows.select("part", "filter_order", "step", *[c.cast("long").alias(n) for n, c in figures.items()])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    path = workspace(docs.sparkSession)
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), *[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((part_col, "part"), (text_col, "text"))])
    return report(stored(mask_counts(failures(slim, path), labels), f"{path}/counts"))
