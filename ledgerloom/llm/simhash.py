"""Operator 11: SimHash near-duplicates by pigeonring filtering.

A bit of a 64-bit fingerprint is one where more than half of the hashes of a text's shingles, repeats included, have it set. Texts link
when their fingerprints differ in at most `within` bits.

The 64 bits are cut into a ring of segments. If two fingerprints differ in at most t of all bits, then from one of the m segments on, every chain
of l consecutive segments differs in at most floor(l t / m) bits: were there a first chain over its budget from every start, those chains,
laid end to end round the ring, would hold more than t. The first segments of a chain have a budget of nothing, so they are an index key; the longer chains are
checked next and the last one, round the whole ring, is the full Hamming check.

Equal fingerprints are one class, and only classes are compared. Buckets of at most `FEW` classes give their pairs, through the budgets. A larger
bucket, as a group of near copies makes, gives no pairs: each of its classes is dealt out under the values that half of `within` flips outside
the key lead to (for an odd `within` also with one bit left out). Classes that meet there are within reach of each other, and any two that are within reach meet, so each
links to the smallest, and the rows grow with the bucket, not with its square.

Defined cases: a null text, or one without words, has fingerprint zero and links like any other; with fewer than n words the whole sequence is
the one shingle; a null doc_id takes no part in links and has a null component; repeated rows are members of their class; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import components, stored, workspace
from ledgerloom.llm.wordhash import _LOWER, inside, pieces, word_bounds

BITS, SEED = 64, 42
#: Segments of the ring.
SEGMENTS = 5
#: Buckets with at most this many classes give all pairs.
FEW = 32
#: Parts of a bucket while its size is joined to its members.
SALTS = 16
#: A class with more than one row in so many is joined by broadcast: there can be no more such classes than this.
HOT_SHARE = 1024
#: Shingles whose bits are counted at once.
COUNTED = 1 << 15
#: The bits of each byte value, lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_bytes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(joined, begins, ends, owner): the words of a piece one blank apart, the byte bounds of each shingle there, and the text it is of."""
    starts, ends, first = word_bounds(data, offsets)
    size = ends - starts
    upto = np.cumsum(size + 1)
    begin = upto - size - 1
    joined = np.full(int(upto[-1]) if len(upto) else 0, 0x20, dtype=np.uint8)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[place + np.repeat(begin, size)] = data[place + np.repeat(starts, size)]
    words = np.diff(first)
    whole, counts = inside(first, n)
    short = np.flatnonzero((words > 0) & (words < n))
    low = np.concatenate([whole, first[short]]).astype(np.int64)
    high = np.concatenate([whole + n - 1, first[short] + words[short] - 1]).astype(np.int64)
    owner = np.concatenate([np.repeat(np.arange(len(words)), counts), short])
    order = np.argsort(owner, kind="stable")
    low, high = low[order], high[order]
    return joined.tobytes(), begin[low], begin[high] + size[high], owner[order]


def piece_fingerprints(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each text of a piece, as uint64."""
    joined, begins, ends, owner = shingle_bytes(_LOWER[data], offsets, n)
    texts = len(offsets) - 1
    ones, digest = np.zeros((texts, BITS), dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(owner), COUNTED):
        spans = zip(begins[at : at + COUNTED].tolist(), ends[at : at + COUNTED].tolist(), strict=True)
        own = owner[at : at + COUNTED]
        held = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(own))
        spot = (np.searchsorted(there := np.unique(own), own) * 8)[:, None] + np.arange(8)
        seen = np.bincount((spot * 256 + held.view(np.uint8).reshape(-1, 8)).ravel(), minlength=len(there) * 2048)
        ones[there] += np.rint(seen.reshape(-1, 256) @ BYTE_BITS).astype(np.int64).reshape(-1, BITS)
    total = np.bincount(owner, minlength=texts)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """Rows (doc_id, fp), one for each row of docs (doc_id long, text string): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in pieces(batch.column(1)):
                made = piece_fingerprints(data, offsets, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(made)), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def ring(segments: int) -> list[int]:
    """The bits of each segment, as masks; the first ones are a bit wider where 64 does not divide."""
    cuts = [-(-BITS * k // segments) for k in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def chains(segments: int) -> list[list[int]]:
    """For each start, the bits of the chains of 1 to all segments from there on."""
    masks, out = ring(segments), []
    for start in range(segments):
        upto = 0
        out.append([upto := upto | masks[(start + k) % segments] for k in range(segments)])
    return out


def budgets(within: int, segments: int) -> list[int]:
    """How many bits the chains of 1 to all segments may differ in."""
    return [k * within // segments for k in range(1, segments + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def longs(values: list[int]) -> Column:
    return F.array(*[F.lit(signed(v)).cast("long") for v in values])


def bucketed(classes: DataFrame, within: int, segments: int) -> DataFrame:
    """Rows (start, key, node, fp): each class under the bits of the segments from each start on that may not differ."""
    free = sum(b == 0 for b in budgets(within, segments))
    keys = longs([c[free - 1] for c in chains(segments)])
    spots = F.transform(keys, lambda mask, start: F.struct(start.alias("start"), F.col("fp").bitwiseAND(mask).alias("key")))
    return classes.select("node", "fp", F.explode(spots).alias("spot")).select("spot.start", "spot.key", "node", "fp")


def with_sizes(entries: DataFrame) -> DataFrame:
    """The entries of buckets with more than one class, with the number of classes m; a large bucket's are spread over SALTS parts."""
    sizes = entries.groupBy("start", "key").agg(F.count("*").alias("m")).where("m > 1")
    wide = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = entries.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    return salted.join(wide, ["start", "key", "salt"]).drop("salt")


def pairs_in_budget(few: DataFrame, within: int, segments: int) -> DataFrame:
    """Pairs (a, b) of nodes of one bucket whose chains all stay within their budgets, the last of which is `within` itself."""
    parts = F.array(*[longs(c) for c in chains(segments)])
    apart = F.col("p.fp").bitwiseXOR(F.col("q.fp"))
    own = F.get(parts, F.col("p.start"))
    fits = (F.col("p.start") == F.col("q.start")) & (F.col("p.key") == F.col("q.key")) & (F.col("p.node") < F.col("q.node"))
    for k, budget in enumerate(budgets(within, segments)):
        fits = fits & (F.bit_count(apart.bitwiseAND(F.get(own, F.lit(k)))) <= budget)
    return few.alias("p").join(few.alias("q"), fits).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))


def stars(many: DataFrame, within: int, segments: int) -> DataFrame:
    """Pairs (a, b) of nodes of large buckets: whoever meets under one value links to the smallest there; see the module's docstring."""
    free = sum(b == 0 for b in budgets(within, segments))
    loose = F.get(longs([~c[free - 1] & ((1 << BITS) - 1) for c in chains(segments)]), F.col("start"))
    bits = F.expr(f"filter(transform(sequence(0, {BITS - 1}), k -> shiftleft(1L, k)), f -> (f & loose) <> 0)")
    flips = "concat(array(0L), bits)" if within > 1 else "array(0L)"
    out = "bits" if within % 2 else "array(0L)"
    moves = F.expr(f"flatten(transform({flips}, f -> transform({out}, o -> struct(f AS flip, ~o AS held))))")
    dealt = many.withColumn("loose", loose).withColumn("bits", bits).select("start", "node", "fp", F.explode(moves).alias("move"))
    value = F.col("fp").bitwiseXOR(F.col("move.flip")).bitwiseAND(F.col("move.held"))
    met = dealt.groupBy("start", F.col("move.held").alias("held"), value.alias("value")).agg(F.collect_set("node").alias("nodes")).where("size(nodes) > 1")
    return met.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).where("a <> b").distinct()


def links(classes: DataFrame, within: int, segments: int, path: str) -> DataFrame:
    """Pairs (a, b) of nodes such that the components are those of all pairs within reach; `classes` has (node, fp)."""
    sized = stored(with_sizes(bucketed(classes, within, segments)), f"{path}/buckets")
    close = pairs_in_budget(sized.where(F.col("m") <= FEW), within, segments)
    return stored(close.union(stars(sized.where(F.col("m") > FEW), within, segments)).distinct(), f"{path}/links")


def labelled(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """rows with component_id. A class with more than its HOT_SHARE of all rows is joined by broadcast, as there can be no more than that."""
    own = classes.join(found, "node", "left").select("fp", "copies", F.coalesce("comp.doc", "node.doc").alias("component_id"))
    n = rows.count()
    hot = own.where(F.col("copies") * HOT_SHARE > n).select("fp", F.col("component_id").alias("hot_id"))
    marked = rows.join(F.broadcast(hot), "fp", "left")
    rest = marked.where("hot_id IS NULL AND doc_id IS NOT NULL").join(own.select("fp", "component_id"), "fp")
    known = marked.where("hot_id IS NOT NULL OR doc_id IS NULL").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("hot_id")))
    return known.unionByName(rest).drop("hot_id")


def simhash_components(docs: DataFrame, n: int = 3, within: int = 2, segments: int = SEGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of docs; component_id is the smallest doc_id reachable by links.

    `within` is 1 to 3 bits, and there are more segments than that.
    """
    if not 1 <= within <= 3 or segments <= within:
        raise ValueError("fingerprints link at one to three differing bits, on a ring of more segments than that")
    path = workspace(docs.sparkSession)
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = stored(fingerprints(slim, n), f"{path}/fingerprints")
    known = rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"))
    classes = stored(known.select(F.struct("doc", "fp").alias("node"), "fp", "copies"), f"{path}/classes")
    found = components(links(classes.select("node", "fp"), within, segments, path), path)
    return labelled(rows, classes, found)
