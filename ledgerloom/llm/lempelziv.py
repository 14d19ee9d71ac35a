"""Operator 10: substring dedup by relative Lempel-Ziv parsing.

The corpus is its own reference, cut into blocks by the hash of what stands there: every run of `window` words that
may repeat is indexed under 128 bits of hashes with the earliest place it starts at. A document is parsed against all
of that index from its first word on: a factor opens at a run that stands earlier, goes on while the earliest place of the next run is the
next word of the same passage, and is a copy of one earlier passage of at least `window` words. The next factor starts where
it ends. Around that boundary every run that straddles it is checked in the index too: one that stands earlier, in whichever
passage, makes the two factors meet there; otherwise words between factors are literals. Words inside factors go.

Which runs may repeat is known beforehand: those whose anchor (see anchors.py) occurs twice. Later copies of whole
word sequences are found by a digest first and are all factor, if long enough.

Defined cases: a null or blank text has no words and nothing to remove; texts shorter than the window stay; rows with
a null doc_id stay whole and are nobody's reference; of repeated doc_ids, equal texts are one document and each row
gets its result, and of unequal texts the words of the greatest are used for all; other columns are kept, but for columns of
the names n_words, n_removed and kept, which give way to the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.anchors import repeated_anchors
from ledgerloom.llm.common import left_join_few, maybe_member, stored, workspace
from ledgerloom.llm.wordhash import gram_hashes, inside, minimiser_positions, mix64, pieces, word_bounds, word_hashes

GRAM = 5


def sequence_digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, s1, s2): a 128-bit digest of each word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in pieces(batch.column(1)):
                words, first = word_hashes(data, offsets)
                place = (np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
                sums = []
                for salt in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
                    total = np.append(np.uint64(0), np.cumsum(mix64(words + mix64(place + np.uint64(salt))), dtype=np.uint64))
                    sums.append(pa.array((total[first[1:]] - total[first[:-1]]).view(np.int64)))
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(np.diff(first)), *sums], ["doc_id", "n_words", "s1", "s2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, s1 long, s2 long")


def run_rows(docs: DataFrame, window: int, gram: int = GRAM) -> DataFrame:
    """From (doc_id, text, anchors): rows (run, check, doc_id, position) of the runs of words whose anchor is among `anchors`.

    Where docs has a column `known`, an array of structs (start, stop), runs inside one of those spans are left out.
    """
    spans = ["known"] if "known" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for at, data, offsets in pieces(batch.column(1)):
                words, first = word_hashes(data, offsets)
                starts, counts = inside(first, window)
                if not len(starts):
                    continue
                wanted = np.zeros(len(words) + 1, dtype=bool)
                for k in range(len(offsets) - 1):
                    wanted[first[k] + np.minimum(lists[at + k].values.to_numpy(), first[k + 1] - first[k])] = True
                picked, _ = minimiser_positions(words, gram, window)
                text = np.repeat(np.arange(len(counts)), counts)
                keep = wanted[picked[starts]]
                if spans:
                    keep &= ~inside_spans(batch.column(3).slice(at, len(offsets) - 1), first, window)[starts]
                starts, text = starts[keep], text[keep]
                hashes = [pa.array(gram_hashes(w, window)[starts].view(np.int64)) for w in (words, mix64(words ^ np.uint64(0x2545F4914F6CDD1D)))]
                yield pa.RecordBatch.from_arrays([*hashes, pa.array(ids[at + text].astype(np.int64)), pa.array((starts - first[text]).astype(np.int32))], ["run", "check", "doc_id", "position"])

    return docs.select("doc_id", "text", "anchors", *spans).mapInArrow(run, "run long, check long, doc_id long, position int")


def inside_spans(lists: pa.Array, first: np.ndarray, window: int) -> np.ndarray:
    """For each word of a piece, whether the run of `window` words from there lies inside one of its text's spans."""
    turns = np.zeros(int(first[-1]) + 1, dtype=np.int32)
    for k in range(len(lists)):
        if lists[k].is_valid:
            held = lists[k].values
            start, stop = (first[k] + held.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            fits = (stop - start >= window) & (stop <= first[k + 1])
            np.add.at(turns, start[fits], 1)
            np.add.at(turns, stop[fits] - window + 1, -1)
    return np.cumsum(turns[:-1]) > 0


def earlier_runs(runs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, position, first) of the stored `runs` that stand somewhere before; first is the earliest (doc_id, position).

    The index is a table of its own, so that Spark can split the side of the runs where one run is hot.
    """
    earliest = runs.groupBy("run", "check").agg(F.min(F.struct("doc_id", "position")).alias("first"), F.count("*").alias("seen")).where("seen > 1").select("run", "check", "first")
    met = runs.join(stored(earliest, f"{path}/earliest"), ["run", "check"])
    return met.where("doc_id <> first.doc_id OR position <> first.position").select("doc_id", "position", "first")


def parse(position: np.ndarray, ref_doc: np.ndarray, ref_position: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors (start, stop, ref_doc, ref_start) of one text from the ascending positions of its repeated runs and their earliest places.

    Stops are exclusive. A factor that opens inside the one before starts where that ends.
    """
    if not len(position):
        return position, position, ref_doc, ref_position
    follows = (np.diff(position) == 1) & (np.diff(ref_position) == 1) & (ref_doc[1:] == ref_doc[:-1])
    opens = np.flatnonzero(np.append(True, ~follows))
    stop = position[np.append(opens[1:], len(position)) - 1] + window
    start = np.maximum(position[opens], np.append(0, stop[:-1]))
    return start, stop, ref_doc[opens], ref_position[opens] + start - position[opens]


FACTORS = "array<struct<start:int,stop:int,ref_doc:bigint,ref_start:int>>"


def parsed(found: DataFrame, window: int) -> DataFrame:
    """Rows (doc_id, factors) from rows (doc_id, position, first)."""
    lists = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", "first"))).alias("r"))
    slim = lists.select("doc_id", F.col("r.position").alias("p"), F.col("r.first.doc_id").alias("d"), F.col("r.first.position").alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [parse(*(batch.column(c)[k].values.to_numpy() for c in (1, 2, 3)), window) for k in range(batch.num_rows)]
            ends = np.append(0, np.cumsum([len(m[0]) for m in made])).astype(np.int32)
            cols = [np.concatenate([m[c] for m in made]).astype(t) for c, t in enumerate((np.int32, np.int32, np.int64, np.int32))]
            held = pa.StructArray.from_arrays([pa.array(c) for c in cols], ["start", "stop", "ref_doc", "ref_start"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), held)], ["doc_id", "factors"])

    return slim.mapInArrow(run, f"doc_id long, factors {FACTORS}")


def factors(docs: DataFrame, window: int = 20, path: str | None = None) -> DataFrame:
    """Rows (doc_id, factors): the factors of each document that has any, as structs (start, stop, ref_doc, ref_start) in words."""
    path = path or workspace(docs.sparkSession)
    known = docs.where("doc_id IS NOT NULL")
    digests = stored(sequence_digests(known), f"{path}/digests")
    first_of = digests.where(f"n_words >= {window}").groupBy("s1", "s2", "n_words").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    copies = digests.join(first_of, ["s1", "s2", "n_words"]).where("doc_id > first_doc").groupBy("doc_id").agg(F.max(F.struct("n_words", "first_doc")).alias("c"))
    whole = stored(copies.select("doc_id", "c.n_words", "c.first_doc"), f"{path}/whole")
    marked = left_join_few(known.select("doc_id", "text"), whole.select("doc_id", F.lit(True).alias("__copy")), "doc_id").where("__copy IS NULL").select("doc_id", "text")
    anchors = stored(repeated_anchors(marked, GRAM, window, path), f"{path}/anchors")
    likely = maybe_member(marked, anchors, "doc_id").where("__maybe").select("doc_id", "text")
    texts = likely.join(anchors, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("anchors").alias("anchors")) if _repeats(digests) else likely.join(anchors, "doc_id")
    runs = stored(run_rows(texts, window), f"{path}/runs")
    entire = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop"), F.col("first_doc").alias("ref_doc"), F.lit(0).alias("ref_start")))
    return stored(parsed(earlier_runs(runs, path), window).union(whole.select("doc_id", entire.cast(FACTORS))), f"{path}/factors")


def _repeats(digests: DataFrame) -> bool:
    """Whether a doc_id stands in more than one row."""
    return bool(digests.groupBy("doc_id").count().where("count > 1").limit(1).count())


def strip(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs with columns n_words, n_removed, kept (the words outside factors, joined by one space); all rows stay."""
    found = factors(docs.select("doc_id", "text"), window).select("doc_id", F.col("factors").alias("__factors"))
    held = [docs[c] for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    wide = docs.select("doc_id", "text", F.struct(*held).alias("__row"))
    joined = left_join_few(wide, found, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists = batch.column(0), batch.column(2)
            for at, data, offsets in pieces(batch.column(1)):
                starts, ends, first = word_bounds(data, offsets)
                raw, n_words, n_removed, kept = data.tobytes(), np.diff(first), [], []
                for k in range(len(offsets) - 1):
                    a, b = int(first[k]), int(first[k + 1])
                    gone = np.zeros(b - a + 1, dtype=np.int32)
                    if lists[at + k].is_valid:
                        own = lists[at + k].values
                        start, stop = (np.minimum(own.field(i).to_numpy(), b - a) for i in (0, 1))
                        np.add.at(gone, start, 1)
                        np.add.at(gone, stop, -1)
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + a
                    n_removed.append(b - a - len(stay))
                    kept.append(b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
                n = len(kept)
                cols = [rows.slice(at, n), pa.array(n_words.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["__row", "n_words", "n_removed", "kept"])

    schema = StructType([joined.schema["__row"]]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    out = joined.select("__row", F.col("text").cast("string"), "__factors").mapInArrow(run, schema)
    return out.select("__row.*", "n_words", "n_removed", "kept")
