"""Operator 2: mix sources to target weights by Poisson replication.

Each source has a mean repetition rate, target weight times corpus size over source size; a document's count is the
inverse of that Poisson distribution at a number drawn from a hash of seed and document, so reruns agree. Documents
are exploded by their counts and shuffled globally by a hash of document and copy. DataFrame operations only.

Sizes count the characters of all documents. Without stated weights, a source's target is its size to the power
`alpha`, which lifts small sources. Means above 200 are sums of equal smaller Poisson parts, each with its own hash.

Defined cases: a null source is a source of its own; a source without any character, or a stated weight
for a source that is absent, leaves its documents at rate 1 or has no effect; a source without a stated weight
gets weight 0 and goes; rows of equal doc_ids (a null one counts as empty) with equal sources share their counts; a tiny source with a
large target weight is repeated as often as that asks for, without a bound; an empty table gives no rows; other columns are kept, but a
column named replica gives way to the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 200.0
#: Rates of at most this many sources are broadcast; with more, they are joined by salted source.
BROADCAST_SOURCES = 50_000
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, source_col: str, text_col: str) -> DataFrame:
    """Rows (source, rate, parts, cdf): mean repetitions, and the distribution function of rate / parts."""
    sizes = docs.groupBy(docs[source_col].alias("source")).agg(F.sum(F.coalesce(F.length(docs[text_col]), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    weighed = sizes.withColumn("weight", weight)
    totals = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rated = weighed.crossJoin(F.broadcast(totals)).withColumn(
        "rate", F.when(F.col("size") > 0, F.col("all_size") * (F.col("weight") / F.col("all_weight")) / F.col("size")).otherwise(F.lit(1.0))
    )
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    mean = F.col("rate") / F.col("parts")
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int"))
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return rated.withColumn("parts", parts).select("source", "rate", "parts", F.aggregate(steps, first, add, lambda acc: acc["cdf"]).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns of docs and `replica` (int from 0), one row per copy, in a global random order."""
    table = rates(docs, weights, alpha, source_col, text_col)
    held = [docs[c] for c in docs.columns if c.lower() != "replica"]
    whole = docs.select(F.struct(*held).alias("__row"), F.xxhash64(docs[id_col], docs[source_col], docs[text_col]).alias("__salt_of"), F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("__id"), docs[source_col].alias("__source"))
    if table.count() <= BROADCAST_SOURCES:
        rated = whole.join(F.broadcast(table), F.col("__source").eqNullSafe(F.col("source")), "left")
    else:
        # a hot source meets SALTS copies of its rate instead of one
        salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = whole.withColumn("__salt", F.pmod(F.col("__salt_of"), F.lit(SALTS)).cast("int"))
        rated = own.join(salted, (own["__salt"] == salted["__salt"]) & own["__source"].eqNullSafe(salted["source"]), "left")
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: uniform(F.lit(seed), F.col("__id"), j))
    count = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter("cdf", lambda c: c <= u)))
    copies = rated.withColumn("__count", count).where("__count > 0").withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("__count") - 1)))
    order = F.xxhash64(F.lit(seed), "__id", "replica", "__salt_of")
    spread = copies.select("__row", "replica", order.alias("__order")).repartition("__order").sortWithinPartitions("__order")
    return spread.select("__row.*", "replica")


def mix_sql(alpha: float = 0.5, seed: int = 0) -> str:
    """The same rows in DuckDB."""
    return f"""
    WITH RECURSIVE numbered AS (SELECT *, row_number() OVER () AS rid FROM documents),
    sizes AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
    weighed AS (SELECT *, pow(size, {alpha}) AS weight FROM sizes),
    rated AS (SELECT source, CASE WHEN size > 0 THEN (SELECT sum(size) FROM weighed) * (weight / (SELECT sum(weight) FROM weighed)) / size ELSE 1.0 END AS rate FROM weighed),
    parted AS (SELECT source, greatest(1, ceil(rate / {PART}))::INT AS parts, rate / greatest(1, ceil(rate / {PART})) AS mean FROM rated),
    cdf AS (
        SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parted
        UNION ALL SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 20)
    ),
    draws AS (
        SELECT d.rid, d.source, ('0x' || substr(md5('{seed}:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || j), 1, 13))::BIGINT / CAST({1 << 52} AS DOUBLE) AS u
        FROM numbered d JOIN parted r ON d.source IS NOT DISTINCT FROM r.source, LATERAL (SELECT unnest(range(1, r.parts + 1)) AS j)
    ),
    counts AS (SELECT rid, count(*) AS n FROM draws JOIN cdf ON draws.source IS NOT DISTINCT FROM cdf.source AND c <= u GROUP BY rid)
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(unnest(range(0, n)) AS INT) AS replica FROM numbered d JOIN counts USING (rid)
    """
