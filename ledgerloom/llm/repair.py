"""Operator 6: token ids as binary files, compressed by Re-Pair grammars.

Documents are tokenised in ascending doc_id order and cut into shards of about SHARD_IDS ids. In each shard frequent pairs of
neighbouring ids are replaced by nonterminals, round after round: a round counts all pairs, takes those that occur at
least MIN_COUNT times as new rules, and replaces their occurrences from the left. Rounds go on until no
pair is that frequent or a round shortens the sequence by less than MIN_GAIN. A file row holds the rules, the length each nonterminal
expands to, the sequence and each document's first symbol, so any stretch of ids can be decoded without the rest: the sums of the
lengths say which symbols hold it (`decode_range`, `read_ranges`), and documents never share a symbol.

The files are Parquet, so that they can be written to and read from any store Spark knows: a row a
shard, with columns part, shard, part_start (ids before it in its part), doc_ids, doc_nulls, doc_tokens, doc_symbols, rules, lengths, symbols (little-endian binary).

Defined cases: a null or empty text is the end id alone; a null doc_id sorts first; repeated rows are encoded
each; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import workspace
from ledgerloom.llm.tokenids import encoder
from ledgerloom.llm.wordhash import pieces

SHARD_IDS = 1 << 20
MIN_COUNT, MIN_GAIN = 64, 0.01
FILES = "part int, shard int, part_start long, first_doc long, n_tokens long, doc_ids binary, doc_nulls binary, doc_tokens binary, doc_symbols binary, n_terminals long, rules binary, lengths binary, symbols binary"


def compress(ids: np.ndarray, ends: np.ndarray, n_terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbol ends of documents, rules (m, 2), expansion lengths of the m nonterminals)."""
    seq, lengths = ids.astype(np.int64), np.ones(n_terminals, dtype=np.int64)
    last = np.zeros(len(seq), dtype=bool)
    last[ends - 1] = True
    rules: list[np.ndarray] = []
    while len(seq) > 1:
        base = len(lengths)
        pairs = seq[:-1] * base + seq[1:]
        free = ~last[:-1]
        # pairs are counted in a table of hashed keys first; only those in full cells are counted exactly
        cell = (pairs * 0x9E3779B1 >> 7) & 0xFFFFF
        full = np.bincount(cell[free], minlength=1 << 20)[cell] >= MIN_COUNT
        at = np.flatnonzero(full & free)
        keys, counts = np.unique(pairs[at], return_counts=True)
        keys = keys[counts >= MIN_COUNT]
        if not len(keys):
            break
        spot = np.minimum(np.searchsorted(keys, pairs[at]), len(keys) - 1)
        hit = keys[spot] == pairs[at]
        at, spot = at[hit], spot[hit]
        # in a run of overlapping occurrences every other one is replaced
        starts = np.append(True, np.diff(at) != 1)
        even = (at - np.maximum.accumulate(np.where(starts, at, 0))) % 2 == 0
        at, spot = at[even], spot[even]
        used, spot = np.unique(spot, return_inverse=True)
        made = np.stack([keys[used] // base, keys[used] % base], axis=1)
        rules.append(made)
        lengths = np.concatenate([lengths, lengths[made[:, 0]] + lengths[made[:, 1]]])
        seq[at] = base + spot
        last[at] |= last[at + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        gain = len(at) / len(seq)
        seq, last = seq[keep], last[keep]
        if gain < MIN_GAIN:
            break
    grammar = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64)
    return seq, np.flatnonzero(last) + 1, grammar, lengths[n_terminals:]


def expand(symbols: np.ndarray, rules: np.ndarray, n_terminals: int) -> np.ndarray:
    """The ids behind symbols: rules are undone from the latest, whole rounds at once."""
    out = symbols.astype(np.int64)
    while len(out) and int(out.max()) >= n_terminals:
        big = out >= n_terminals
        begin = np.cumsum(big) - big + np.arange(len(out))
        wide = np.empty(len(out) + int(big.sum()), dtype=np.int64)
        wide[begin[~big]] = out[~big]
        pair = rules[out[big] - n_terminals]
        wide[begin[big]], wide[begin[big] + 1] = pair[:, 0], pair[:, 1]
        out = wide
    return out


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise, compress and write docs in ascending doc_id order: later files hold larger ids, and rows in a file ascend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, shard, upto = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        n_terminals = coder.tokenizer.get_vocab_size(with_added_tokens=True)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, upto
            doc_ids = [d for ids, _, _ in held for d in ids]
            counts = np.concatenate([c for _, c, _ in held])
            symbols, ends, rules, lengths = compress(np.concatenate([i for _, _, i in held]), np.cumsum(counts), n_terminals)
            wide = "<u2" if n_terminals + len(rules) <= 1 << 16 else "<u4"
            known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
            absent = np.packbits([d is None for d in doc_ids])
            row = [part, shard, upto, doc_ids[0], int(counts.sum()), known.tobytes(), absent.tobytes(), counts.astype("<u4").tobytes(), ends.astype("<u4").tobytes(), n_terminals]
            row += [rules.astype(wide).tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(wide).tobytes()]
            shard, upto = shard + 1, upto + int(counts.sum())
            held.clear()
            names = [x.split()[0] for x in FILES.split(", ")]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for at, data, offsets in pieces(batch.column(1)):
                ids, counts = coder.encode(data, offsets, end_id)
                held.append((batch.column(0).slice(at, len(counts)).to_pylist(), counts, ids))
                if sum(len(x[2]) for x in held) >= SHARD_IDS:
                    yield flush()
        if held:
            yield flush()

    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    parts = max(1, slim.rdd.getNumPartitions())
    ordered = slim.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, FILES).write.mode("overwrite").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document: (doc_id, start, n_tokens, ids): ids little-endian 32-bit, start counted over all documents before.

    Only one total a part is broadcast.
    """
    files = spark.read.schema(FILES).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, rules_n = row["n_terminals"], len(row["lengths"]) // 4
                wide = "<u2" if n + rules_n <= 1 << 16 else "<u4"
                doc_ids, counts = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
                ids = expand(np.frombuffer(row["symbols"], wide), np.frombuffer(row["rules"], wide).reshape(rules_n, 2).astype(np.int64), n)
                ends = np.cumsum(counts)
                held = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                no_id = np.unpackbits(np.frombuffer(row["doc_nulls"], np.uint8), count=len(doc_ids)).astype(bool)
                cols = [pa.array(doc_ids, mask=no_id), pa.array(np.full(len(counts), row["part"], np.int32)), pa.array(row["part_start"] + ends - counts), pa.array(counts), held]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "part_start", "n_tokens", "ids"])

    decoded = files.drop("first_doc", "n_tokens").mapInArrow(run, "doc_id long, part int, part_start long, n_tokens long, ids binary")
    return decoded.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def decode_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, n_terminals: int, start: int, stop: int) -> np.ndarray:
    """The ids at start to stop (exclusive) of what symbols expand to; only the symbols that hold them are expanded."""
    size = np.ones(len(symbols), dtype=np.int64)
    big = symbols >= n_terminals
    size[big] = lengths[symbols[big].astype(np.int64) - n_terminals]
    ends = np.cumsum(size)
    first, last = np.searchsorted(ends, [start, stop - 1], side="right") if stop > start else (0, -1)
    before = ends[first] - size[first] if stop > start else 0
    return expand(symbols[first : last + 1], rules, n_terminals)[start - before : stop - before]


def decode_document(symbols: np.ndarray, ends: np.ndarray, rules: np.ndarray, n_terminals: int, at: int) -> np.ndarray:
    """The ids of the document at one place of a shard, from its own symbols only."""
    return expand(symbols[(ends[at - 1] if at else 0) : ends[at]], rules, n_terminals)


def read_ranges(spark, path: str, wanted: DataFrame) -> DataFrame:
    """Rows (name, at, ids) for each shard that holds a part of the stretch [start, stop) of all ids, from rows (name, start, stop) of `wanted`.

    `at` is the part's place in the stretch. Stretches meet the shards they lie in through shard numbers of
    about SHARD_IDS ids each, and only the symbols inside are expanded; shards are read, not whole tables of documents.
    """
    files = spark.read.schema(FILES).parquet(path)
    sizes = files.select("part", "shard", "part_start", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))

    def cells(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.call_function("div", low, F.lit(SHARD_IDS).cast("long")), F.call_function("div", high - 1, F.lit(SHARD_IDS).cast("long"))))

    begin = F.col("base") + F.col("part_start")
    placed = sizes.join(F.broadcast(bases), "part").select("part", "shard", begin.alias("begin"), (begin + F.col("n_tokens")).alias("end"))
    asked = wanted.where("stop > start").select("name", "start", "stop", cells(F.col("start"), F.col("stop")).alias("cell"))
    met = asked.join(placed.withColumn("cell", cells(F.col("begin"), F.col("end"))), "cell").where("start < end AND begin < stop").drop("cell").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, rules_n = row["n_terminals"], len(row["lengths"]) // 4
                wide = "<u2" if n + rules_n <= 1 << 16 else "<u4"
                low, high = max(row["start"], row["begin"]), min(row["stop"], row["end"])
                symbols, rules = np.frombuffer(row["symbols"], wide), np.frombuffer(row["rules"], wide).reshape(rules_n, 2).astype(np.int64)
                ids = decode_range(symbols, rules, np.frombuffer(row["lengths"], "<u4"), n, low - row["begin"], high - row["begin"])
                yield pa.RecordBatch.from_arrays([pa.array([row["name"]], pa.string()), pa.array([low - row["start"]], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], ["name", "at", "ids"])

    held = files.select("part", "shard", "n_terminals", "rules", "lengths", "symbols")
    return met.select(F.col("name").cast("string"), "start", "stop", "part", "shard", "begin", "end").join(held, ["part", "shard"]).mapInArrow(run, "name string, at long, ids binary")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files into a new folder of the work space and read them back."""
    path = f"{workspace(docs.sparkSession)}/token-files"
    write_token_files(docs, path, vocabulary, end_id, id_col, text_col)
    return read_token_files(docs.sparkSession, path)
