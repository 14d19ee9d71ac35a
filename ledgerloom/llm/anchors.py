"""Anchors that repeat: content-selected positions of words that occur in at least two places of the corpus.

Every run of `window` words selects its smallest `gram`-word hash (its minimiser), so two equal runs select the same
place in both. Only anchors seen twice can belong to a repeated run; the rest of the corpus is never indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored
from ledgerloom.llm.wordhash import inside, minimiser_positions, pieces, word_hashes


def chosen(words: np.ndarray, first: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, text) of the distinct anchors of the texts of a piece; positions count words of the piece."""
    starts, counts = inside(first, window)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64), starts
    at, grams = minimiser_positions(words, gram, window)
    picked, text = at[starts], np.repeat(np.arange(len(counts)), counts)
    new = np.append(True, (picked[1:] != picked[:-1]) | (text[1:] != text[:-1]))
    picked = picked[new]
    return picked, grams[picked], text[new]


def anchor_rows(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """Rows (anchor, doc_id, position) of all documents with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, data, offsets in pieces(batch.column(1)):
                words, first = word_hashes(data, offsets)
                picked, hashes, text = chosen(words, first, gram, window)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids[at + text].astype(np.int64)), pa.array((picked - first[text]).astype(np.int32))], ["anchor", "doc_id", "position"])

    return docs.mapInArrow(run, "anchor long, doc_id long, position int")


def repeated_anchors(docs: DataFrame, gram: int, window: int, path: str) -> DataFrame:
    """Rows (doc_id, anchors): the positions, ascending, of each document's anchors that occur at least twice.

    Counting pre-aggregates before the shuffle; the repeated ones are stored, so that Spark can split the join where an anchor is hot.
    """
    rows = anchor_rows(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), gram, window)
    twice = stored(rows.groupBy("anchor").agg(F.count("*").alias("seen")).where("seen > 1").select("anchor"), f"{path}/repeated")
    return rows.join(twice, "anchor").groupBy("doc_id").agg(F.sort_array(F.collect_list("position")).alias("anchors"))
