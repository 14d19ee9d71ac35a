"""Operator 7: pack tokenised documents into fixed windows by concatenating and cutting.

Two passes over partition token totals: the first tokenises every partition once, stores ids with a running
offset inside the partition, and so fixes the order; the second turns the partitions' totals into global
offsets by a prefix sum and cuts at multiples of the window, without moving any ids between tasks.

Defined cases: a null or empty text is the end id alone; null doc_ids and repeated rows are packed like any row; an
empty table gives no rows; other columns are ignored. Only the last sequence can be short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored, workspace
from ledgerloom.llm.tokenids import encoder
from ledgerloom.llm.wordhash import pieces

TOKENS = "doc_id long, part int, part_start long, n_tokens long, ids binary"


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, part, part_start, n_tokens, ids): ids little-endian 32-bit, closed by end_id, in the order read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, upto = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, data, offsets in pieces(batch.column(1)):
                ids, counts = coder.encode(data, offsets, end_id)
                n, ends = len(counts), np.cumsum(counts)
                held = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                cols = [batch.column(0).slice(at, n), pa.array(np.full(n, part, np.int32)), pa.array(upto + ends - counts), pa.array(counts), held.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "part_start", "n_tokens", "ids"])
                upto += int(ends[-1])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, TOKENS)


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    A piece is the part of one document inside one window; `ids` holds its ids as little-endian 32-bit
    integers, so the pieces of a sequence in order of offset are the sequence itself.
    """
    tokens = stored(tokenised(docs, vocabulary, end_id, id_col, text_col), f"{workspace(docs.sparkSession)}/tokens")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row per input partition: a bounded table, whatever the number of documents
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    begin = F.col("base") + F.col("part_start")
    placed = tokens.join(F.broadcast(bases), "part").withColumn("begin", begin).withColumn("end", begin + F.col("n_tokens"))
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(F.expr(f"begin DIV {window}"), F.expr(f"(end - 1) DIV {window}"))))
    low = F.greatest("begin", F.col("sequence_id") * window)
    high = F.least("end", (F.col("sequence_id") + 1) * window)
    return cut.select(
        "doc_id",
        (low - F.col("begin")).alias("start"),
        (high - low).alias("length"),
        F.substring("ids", ((low - F.col("begin")) * 4 + 1).cast("int"), ((high - low) * 4).cast("int")).alias("ids"),
        F.col("n_tokens").alias("doc_tokens"),
        "sequence_id",
        (low - F.col("sequence_id") * window).alias("offset"),
    )
