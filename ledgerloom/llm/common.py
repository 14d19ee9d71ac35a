"""What the operators share: the work folder, stored intermediate tables, sparse joins, row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans import storage

#: Bits of the widest membership filter that is broadcast: 2**24 bits, so at most 262144 rows of 64 bits. Up to a quarter million ids, one
#: foreign id in 64 passes it.
MAX_FILTER_BITS = 1 << 24


#: Quantiles of a key that block_of computes at most.
MOST_BOUNDS = 1 << 10

#: Rows of an Arrow batch between Spark and Python: whole texts can be long, so far fewer than Spark's default.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once; called by whatever hands whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share, in a session whose Python workers hold few texts at once."""
    small_batches(spark)
    return storage.workspace(spark)


stored = storage.stored


def text_of(df: DataFrame, text_col: str) -> Column:
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def membership(ids: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A Bloom filter with one hash over the ids, as rows (word, bits), and its number of bits.

    The number of bits follows the number of ids up to MAX_FILTER_BITS, which bounds what is broadcast.
    """
    n, width = ids.count(), 1 << 12
    while width < min(64 * n, MAX_FILTER_BITS):
        width <<= 1
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(width))
    words = ids.select((bit / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {width}) % 64 AS INT))").alias("mask"))
    return words.groupBy("word").agg(F.bit_or("mask").alias("mask")), width


def maybe_member(docs: DataFrame, ids: DataFrame, key: str, flag: str = "__maybe") -> DataFrame:
    """docs with a boolean column: false where the key is certainly not among ids. No shuffle of docs."""
    words, width = membership(ids, key)
    spot, word, mask = (free_name(docs, c) for c in ("spot", "word", "mask"))
    words = F.broadcast(words.select(F.col("word").alias(word), F.col("mask").alias(mask)))
    out = docs.withColumn(spot, F.pmod(F.xxhash64(docs[key]), F.lit(width))).join(words, (F.col(spot) / 64).cast("long") == F.col(word), "left")
    hit = F.coalesce(F.expr(f"getbit(`{mask}`, cast(`{spot}` % 64 AS INT)) = 1"), F.lit(False))
    return out.withColumn(flag, hit).drop(spot, word, mask)


def left_join_few(docs: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """docs LEFT JOIN facts ON key, when facts concern few of the docs: only rows that may match are shuffled."""
    extra = [f for f in facts.schema.fields if f.name != key]
    flag = free_name(docs, "maybe")
    tagged = maybe_member(docs, facts, key, flag)
    rest = tagged.where(f"NOT `{flag}`").drop(flag)
    for f in extra:
        rest = rest.withColumn(f.name, F.lit(None).cast(f.dataType))
    hits = tagged.where(f"`{flag}`").drop(flag).join(facts, key, "left")
    return rest.unionByName(hits)


def block_of(rows: DataFrame, key: str, tie: Column, rows_per_block: int) -> Column:
    """The number of a row's block: blocks ascend with the key (nulls first, by a hash of `tie`) and hold about `rows_per_block` rows each.

    Bounds are quantiles of the key, at most MOST_BOUNDS of them, so that blocks follow the rows and not the range of the
    keys; between two bounds blocks are of equal width. Rows that agree in the key share a block, but for nulls.
    """
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
    wanted = max(1, n // rows_per_block)
    k = min(wanted, MOST_BOUNDS)
    bounds = sorted(set(rows.approxQuantile(key, [i / k for i in range(k)], 0.25 / k))) or [0.0]
    parts = -(-wanted // k)
    held, at = F.lit(bounds), F.col(key).cast("double")

    # binary search for the last bound that is not above the key
    def halve(acc: Column, _: Column) -> Column:
        middle = F.call_function("div", acc["low"] + acc["high"] + 1, F.lit(2).cast("long"))
        right = F.get(held, middle.cast("int")) <= at
        return F.struct(F.when(right, middle).otherwise(acc["low"]).alias("low"), F.when(right, acc["high"]).otherwise(middle - 1).alias("high"))

    whole = F.struct(F.lit(0).cast("long").alias("low"), F.lit(len(bounds) - 1).cast("long").alias("high"))
    spot = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length()))), whole, halve, lambda acc: acc["low"])
    low, high = F.get(held, spot.cast("int")), F.coalesce(F.get(held, (spot + 1).cast("int")), F.lit(bounds[-1] + 1))
    inner = F.least(F.greatest(F.floor((at - low) / (high - low) * parts), F.lit(0)), F.lit(parts - 1))
    null_blocks = max(1, nulls // rows_per_block)
    width = (1 << 62) // null_blocks + 1
    first = F.floor((F.shiftright(F.xxhash64(tie), 1) + F.lit(1 << 62)) / F.lit(2.0 * width)) - null_blocks
    return F.when(F.col(key).isNull(), F.greatest(first, F.lit(-null_blocks))).otherwise(spot * parts + inner).cast("long")


def numbered(rows: DataFrame, key: str, ties: list[Column], name: str, rows_per_block: int = 1000) -> DataFrame:
    """Global row numbers from 0 in ascending key order (nulls first), without one task that sees all rows.

    A first pass counts rows per block (see block_of), their running sum gives each block's first number, and a window inside
    each block gives the rest. Only the block counts are broadcast, at most a few for each bound and each thousand rows of a
    65536th of the table. Rows equal in the key and in `ties` get neighbouring numbers in any order.
    """
    n = rows.count()
    tie = F.concat_ws(":", *ties)
    block, local, before, size = (free_name(rows, c) for c in ("block", "local", "before", "size"))
    placed = rows.withColumn(block, block_of(rows, key, tie, max(rows_per_block, n >> 16)))
    sizes = placed.groupBy(block).agg(F.count("*").alias(size))
    starts = sizes.select(block, (F.sum(size).over(Window.orderBy(block)) - F.col(size)).alias(before))
    rank = F.row_number().over(Window.partitionBy(block).orderBy(F.col(key).asc_nulls_first(), *ties))
    return placed.withColumn(local, rank).join(F.broadcast(starts), block).withColumn(name, F.col(before) + F.col(local) - 1).drop(block, local, before)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not use, in any case of letters."""
    used = {c.lower() for c in df.columns}
    while f"__{name}" in used:
        name += "_"
    return f"__{name}"


def components(edges: DataFrame, path: str) -> DataFrame:
    """Connected components of the edges (a, b): rows (node, comp), comp the smallest node of each component.

    Every node takes the smallest label among its neighbours' and its own, then the label of that label
    (pointer jumping), until nothing changes. Each round is written out, so lineage stays short. The
    driver only sees the number of changes.
    """
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), f"{path}/edges")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("comp")).select("node", F.least("node", "comp").alias("comp")), f"{path}/labels-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        roots = step.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        jumped = step.join(roots, "comp").select("node", "old", F.least("comp", "root").alias("comp"))
        made = stored(jumped, f"{path}/labels-{turn}")
        labels = made.select("node", "comp")
        if not made.where("old <> comp").limit(1).count():
            return labels
