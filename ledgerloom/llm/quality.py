"""Operator 5: quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal updates.

Words are runs of ASCII letters, digits and bytes above 127, or runs of one kind of other sign; signs of a run beyond the third
count no more, and words in capitals also count in lower case. A text's features are its words and pairs of
neighbouring words, hashed into 2**BITS places, each counted once and scaled to unit length, and a few shares
(repeated words, signs, capitals, length). A score is the dot product with the weights through a sigmoid.

Training reads all labelled documents outside the held-out third, in shards of about SHARD_ROWS by a hash of doc_id: updates are sequential in a shard,
shards run beside one another, and the weights are the mean of the shards' by their rows. Every document is scored over its whole text. Labels,
lang, source and doc_id are never features.

Defined cases: null or empty texts have only the bias as feature; labels that are null or not 0 or 1 are left out;
without labels of both kinds the score is the share of label 1 (one half without any); null doc_ids are
scored and count as held out only by the remainder rule on the empty string; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.common import maybe_member, small_batches, stored, workspace
from ledgerloom.llm.wordhash import _LOWER, mix64, pieces, span_hashes

BITS, EXTRA = 18, 8
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-4, 1e-4, 3
#: Rows of a shard of the training rows, and weights of a part in which shards' weights are added up.
SHARD_ROWS, PART = 4_000, 1 << 14

#: Classes of bytes: 0 white space, 1 part of a word, then one class for each other ASCII sign.
_KIND = np.ones(256, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
for _n, _b in enumerate([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), *range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]):
    _KIND[_b] = 2 + _n


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices, values, first): the sparse vectors of the texts of one piece, one after the other."""
    n_texts = len(offsets) - 1
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    edges = np.flatnonzero(edge)
    starts, ends = edges[:-1], edges[1:]
    solid = kind[starts] != 0 if len(data) else np.zeros(0, dtype=bool)
    starts, ends = starts[solid], ends[solid]
    text = np.searchsorted(offsets, starts, side="right") - 1
    sign = kind[starts] > 1 if len(starts) else np.zeros(0, dtype=bool)
    cut = np.where(sign, np.minimum(ends, starts + 3), ends)
    upper = np.append(0, np.cumsum((data >= 65) & (data <= 90)))
    shouted = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 1)
    words = span_hashes(_LOWER[data], starts, cut) if len(starts) else np.zeros(0, dtype=np.uint64)
    pair = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    # in pairs a word that is not a sign stands for its kind, so that layout is learnt besides vocabulary
    shape = np.where(sign, words, np.where(shouted, np.uint64(1), np.uint64(2)))
    layout = mix64(shape[:-1] * np.uint64(0xD6E8FEB86659FD93) + shape[1:] + np.uint64(7))
    same = text[1:] == text[:-1]
    keys = np.concatenate([words, pair[same], layout[same]])
    owner = np.concatenate([text, text[1:][same], text[1:][same]])
    place = (keys >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique(owner.astype(np.int64) << BITS | place)
    owner, place = both >> BITS, both & ((1 << BITS) - 1)
    count = np.bincount(owner, minlength=n_texts)
    n_words = np.maximum(np.bincount(text, minlength=n_texts), 1)
    distinct = np.bincount(np.unique(text.astype(np.uint64) << np.uint64(40) | (words >> np.uint64(24))).astype(np.int64) >> 40, minlength=n_texts)
    size = np.maximum(np.diff(offsets), 1)
    extra = np.stack([
        np.ones(n_texts),
        distinct / n_words,
        np.bincount(text, weights=sign, minlength=n_texts) / n_words,
        np.bincount(text, weights=shouted, minlength=n_texts) / n_words,
        np.log1p(size) / 10,
        np.log1p(n_words) / 10,
        (distinct / n_words) ** 2,
        np.diff(upper[offsets]) / size,
    ], axis=1)
    first = np.append(0, np.cumsum(count + EXTRA))
    indices, values = np.empty(first[-1], dtype=np.int64), np.empty(first[-1])
    at = np.arange(len(owner)) + EXTRA * (owner + 1)
    indices[at], values[at] = place, (1 / np.sqrt(np.maximum(count, 1)))[owner]
    head = (first[:-1, None] + np.arange(EXTRA)).ravel()
    indices[head], values[head] = np.tile(np.arange(EXTRA) + (1 << BITS), n_texts), extra.ravel()
    return indices, values, first


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Weights after EPOCHS passes of per-coordinate FTRL-proximal updates in the order given."""
    z, n = np.zeros((1 << BITS) + EXTRA), np.zeros((1 << BITS) + EXTRA)

    def weight(i: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for (i, x), y in zip(rows, labels, strict=True):
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weight(np.arange(len(z))).astype(np.float32)


def train(examples: DataFrame) -> np.ndarray:
    """Weights from all rows (doc_id, text, label) such as `labelled` gives; only their mean over the shards, of a fixed size, comes to the driver."""
    small_batches(examples.sparkSession)
    size = (1 << BITS) + EXTRA
    n, least, most = examples.agg(F.count("label"), F.min("label"), F.max("label")).first()
    w = np.zeros(size, dtype=np.float32)
    if not n or least == most:
        w[1 << BITS] = 0 if not n else 20 if most else -20
        return w

    def run(table: pa.Table) -> pa.Table:
        rows, table = [], table.sort_by([("o", "ascending"), ("text", "ascending")])
        for batch in table.select(["text"]).to_batches(max_chunksize=1000):
            for _, data, offsets in pieces(batch.column(0)):
                i, x, first = features(data, offsets)
                i, x = i.astype(np.int32), x.astype(np.float32)
                rows += [(i[a:b], x[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        sums = len(rows) * ftrl(rows, table["label"].to_numpy()).astype(np.float64)
        parts = [sums[at : at + PART].tobytes() for at in range(0, size, PART)]
        return pa.table({"part": pa.array(range(len(parts)), pa.int32()), "some": table["shard"][:1].combine_chunks().take(pa.array([0] * len(parts))), "sums": pa.array(parts, pa.binary())})

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer()) for x in table["sums"]], axis=0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    order = F.xxhash64("doc_id")
    dealt = examples.select("text", F.col("label").cast("int").alias("label"), order.alias("o"), F.pmod(order, F.lit(-(-n // SHARD_ROWS))).cast("int").alias("shard"))
    # stored, so that the shuffled texts go at once
    made = stored(dealt.groupBy("shard").applyInArrow(run, "part int, some int, sums binary"), f"{workspace(examples.sparkSession)}/shards")
    summed = made.groupBy("part", F.col("some") % 64).applyInArrow(add, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary")
    for row in summed.collect():
        part = np.frombuffer(row["sums"])
        w[row["part"] * PART : row["part"] * PART + len(part)] = part / n
    return w


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """Rows (doc_id, score), and `keep` as a third column if given. The weights have a fixed size and are broadcast."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    cols = [docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")] + ([keep.alias("keep")] if keep is not None else [])
    slim = docs.select(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            out = [np.zeros(0)]
            for _, data, offsets in pieces(batch.column(1)):
                i, x, first = features(data, offsets)
                out.append(1 / (1 + np.exp(-np.clip(np.add.reduceat(w[i] * x, first[:-1]), -35, 35))))
            rest = [batch.column(k) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out)), *rest], ["doc_id", "score", "keep"][: 2 + len(rest)])

    schema = StructType().add("doc_id", "long").add("score", "double")
    return slim.mapInArrow(run, StructType([*schema, slim.schema["keep"]]) if keep is not None else schema)


def cross_scores(examples: DataFrame, weights_of: Callable[[DataFrame], np.ndarray] = None, folds: int = 2) -> DataFrame:
    """Rows (score, label) of the training rows themselves, each scored with weights from the other folds only."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds))
    made = None
    for k in range(folds):
        weights = (weights_of or train)(examples.where(fold != k))
        part = score(examples.where(fold == k), weights, keep=F.col("label").cast("int")).select("score", F.col("keep").alias("label"))
        made = part if made is None else made.union(part)
    return made


def threshold(scored: DataFrame, lose: float) -> float:
    """The score below which at most the share `lose` of the good rows (label 1) of (score, label) lies, and never above one half."""
    good = stored(scored.where("label = 1").select("score"), f"{workspace(scored.sparkSession)}/good")
    lowest = good.orderBy("score").limit(max(1, math.ceil(lose * good.count())))
    at = lowest.agg(F.max("score")).first()[0]
    return 0.5 if at is None else min(0.5, at)


def remainder(id_: Column) -> Column:
    """crc32 of the doc_id as text, modulo 3."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 3


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows (doc_id, text, label): all documents with a label whose remainder is not 1; only those that may have one are shuffled."""
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(remainder(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.min("quality").alias("label"))
    slim = docs.select("doc_id", "text")
    return maybe_member(slim, usable, "doc_id").where("__maybe").select("doc_id", "text").join(usable.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "label")
