"""Operator 3: exact passages that repeat, by a sparse suffix array.

Only suffixes at content-selected minimiser positions are kept, and of those only ones whose minimiser occurs twice in
the corpus. A suffix record has the hashes of the next `window` words as its key and of the `window` words before, read
backwards. Records are sorted by anchor and key; neighbours in that order share the longest prefixes. A record is
compared with the NEIGHBOURS before it and with the earliest record of its anchor so far: each pair is extended right
along the keys and left along what precedes, and when both together span at least `window` words, the
span of the later place is a duplicate. All spans given are exact copies of an earlier place.

Copies that share little to the right of their anchor sort far apart, and those in other partitions do not meet. So every run of `window` words that selects a
kept anchor and lies inside none of those spans is looked up by its hash: the earliest place of a run is never inside
a span, so each later one meets it, and together exactly the words of repeated runs are covered.

Partitions are ranges of the sorted records, so neither a common phrase nor a passage of a third of all documents is one task's, and
only neighbours across a border do not meet; a task streams its records and holds only a few of them, so that no group is ever collected.

Defined cases: null or short texts have no suffix; null doc_ids take no part; repeated rows of a doc_id count as one
document when their texts are equal and otherwise the greatest text stands for it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.anchors import repeated_anchors
from ledgerloom.llm.common import maybe_member, stored, workspace
from ledgerloom.llm.lempelziv import earlier_runs, run_rows
from ledgerloom.llm.wordhash import gram_hashes, pieces, word_hashes

GRAM, NEIGHBOURS = 8, 3
RECORD = "anchor long, key binary, before binary, doc_id long, position int"


def suffix_rows(docs: DataFrame, window: int) -> DataFrame:
    """From (doc_id, text, anchors): one record for each anchor, with 32-bit hashes of the words on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(2)
            for at, data, offsets in pieces(batch.column(1)):
                words, first = word_hashes(data, offsets)
                grams = gram_hashes(words, GRAM)
                short = (words >> np.uint64(32)).astype(">u4")
                out: list[list] = [[], [], [], [], []]
                for k in range(len(offsets) - 1):
                    a, b = int(first[k]), int(first[k + 1])
                    for p in lists[at + k].values.to_pylist():
                        if a + p + GRAM <= b:
                            row = grams[a + p], short[a + p : min(b, a + p + window)].tobytes(), short[max(a, a + p - window) : a + p][::-1].tobytes(), ids[at + k], p
                            for c, v in zip(out, row, strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(out[0], np.uint64).view(np.int64)), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32())], ["anchor", "key", "before", "doc_id", "position"])

    return docs.select("doc_id", "text", "anchors").mapInArrow(run, RECORD)


def common_words(one: bytes, two: bytes) -> int:
    """How many leading 32-bit words two binary strings share."""
    n = min(len(one), len(two)) // 4
    differ = np.flatnonzero(np.frombuffer(one, np.uint32, n) != np.frombuffer(two, np.uint32, n))
    return int(differ[0]) if len(differ) else n


def neighbour_matches(sorted_records: DataFrame, window: int) -> DataFrame:
    """Rows (doc_id, start, stop, ref_doc_id): for each compared pair that shares `window` words, the span of the later one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, anchor, before, earliest = ["doc_id", "start", "stop", "ref_doc_id"], None, [], None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if row[0] != anchor:
                    anchor, before, earliest = row[0], [], None
                for other in before if earliest is None or earliest in before else [*before, earliest]:
                    right, left = common_words(other[1], row[1]), common_words(other[2], row[2])
                    if left + right >= window:
                        old, new = (other, row) if other[3:] < row[3:] else (row, other)
                        out.append((new[3], new[4] - left, new[4] + right, old[3]))
                before = [row, *before[: NEIGHBOURS - 1]]
                earliest = row if earliest is None or row[3:] < earliest[3:] else earliest
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names)

    return sorted_records.mapInArrow(run, "doc_id long, start int, stop int, ref_doc_id long")


def repeated_passages(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, stop, ref_doc_id): word spans of at least `window` words that stand somewhere before.

    ref_doc_id is the smallest document that a part of the span was compared with or looked up in; spans of one document do not overlap.
    """
    path = workspace(docs.sparkSession)
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("doc_id IS NOT NULL")
    anchors = stored(repeated_anchors(slim, GRAM, window, path).select("doc_id", F.array_distinct("anchors").alias("anchors")), f"{path}/anchors")
    likely = maybe_member(slim, anchors, "doc_id").where("__maybe").select("doc_id", "text")

    def texts(facts: DataFrame) -> DataFrame:
        held = [c for c in facts.columns if c != "doc_id"]
        return likely.join(facts, "doc_id").groupBy("doc_id").agg(F.max_by(F.struct("text", *held), F.col("text")).alias("d")).select("doc_id", "d.*")

    order = ["anchor", "key", "doc_id", "position"]
    records = suffix_rows(texts(anchors), window).repartitionByRange(*order).sortWithinPartitions(*order)
    matches = stored(neighbour_matches(records, window), f"{path}/matches")
    known = matches.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("known"))
    runs = stored(run_rows(texts(anchors.join(known, "doc_id", "left")), window, GRAM), f"{path}/runs")
    rest = earlier_runs(runs, path).select("doc_id", F.col("position").alias("start"), (F.col("position") + window).alias("stop"), F.col("first.doc_id").alias("ref_doc_id"))
    spans = matches.union(rest).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "ref_doc_id"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,stop:int,ref_doc_id:bigint>>")
    merged = F.aggregate(
        "spans",
        empty,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"), F.least(F.element_at(acc, -1)["ref_doc_id"], s["ref_doc_id"]).alias("ref_doc_id")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return spans.select("doc_id", F.explode(merged).alias("s")).select("doc_id", "s.start", "s.stop", "s.ref_doc_id")
