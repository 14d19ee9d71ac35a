"""Vector, keyword and graph retrieval."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.storage import if_small

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def nearest_vectors(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k vectors of largest cosine with one query vector, for unit vectors; ties to the smaller id."""
    score = dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select("vec_id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(k)


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(docs: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of documents with any query term; only counts of query terms are kept from each text."""
    asked = [q.lower() for q in query]

    def count(term: str) -> Column:
        return F.size(F.filter("t", lambda x: x == term))

    counted = docs.select("doc_id", terms(F.coalesce("text", F.lit(""))).alias("t"))
    sized = counted.select("doc_id", F.size("t").alias("len"), F.explode(F.array(*[F.struct(F.lit(q).alias("term"), count(q).alias("tf")) for q in asked])).alias("c")).select("doc_id", "len", "c.*")
    corpus = counted.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_len"))
    hits = sized.where("tf > 0")
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    joined = hits.join(if_small(frequency), "term").crossJoin(F.broadcast(corpus))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return joined.groupBy("doc_id").agg(F.round(F.sum(idf * weight), 6).alias("score"))


def ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The first k by score with their rank."""
    top = scored.orderBy(F.col("score").desc(), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), key)))


def fuse(one: DataFrame, two: DataFrame, key: str, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    parts = one.select(key, (F.lit(weights[0]) / (RRF_K + F.col("rank"))).alias("part")).union(two.select(key, (F.lit(weights[1]) / (RRF_K + F.col("rank"))).alias("part")))
    return parts.groupBy(key).agg(F.round(F.sum("part"), 9).alias("score"))


def retention(days: Column, accesses: Column) -> Column:
    """Forgetting curve with a longer half-life for what is often used, between 0.05 and 1."""
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.exp(-days / (30 * (1 + 0.2 * F.log1p(accesses))))))


def personalised_rank(edges: DataFrame, seeds: DataFrame, steps: int = 3, damping: float = 0.85) -> DataFrame:
    """(node, p): a few steps of personalised PageRank over (source, target, weight), rows normalised by source."""
    shares = edges.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("source"))).select("source", "target", "share")
    start = seeds.select("node", (F.lit(1.0) / F.lit(float(seeds.count()))).alias("s"))
    p = start.select("node", F.col("s").alias("p"))
    for _ in range(steps):
        moved = p.where("p > 1e-7").join(shares, p["node"] == shares["source"]).groupBy(F.col("target").alias("node")).agg((F.sum(F.col("p") * F.col("share")) * damping).alias("m"))
        p = moved.join(start, "node", "full").select("node", (F.coalesce("m", F.lit(0.0)) + (1 - damping) * F.coalesce("s", F.lit(0.0))).alias("p"))
    return p.where("p > 1e-6").select("node", F.round("p", 6).alias("p"))


def prefix_hits(docs: DataFrame, query: str) -> DataFrame:
    """(doc_id) of the documents in which every term of the query begins some term; a query without terms finds nothing."""
    asked = [t for t in re.split(r"[^\w]+", query.lower()) if t]
    t = terms(F.coalesce("text", F.lit("")))
    keep = F.lit(bool(asked))
    for word in asked:
        keep = keep & _begins(t, word)
    return docs.where(keep).select("doc_id")


def _begins(tokens: Column, word: str) -> Column:
    return F.exists(tokens, lambda x: F.startswith(x, F.lit(word)))


def two_stage(scored: DataFrame, key: str, rerank: Column, penalty: Column, k: int) -> DataFrame:
    """(key, place): first the max(3 k, 10) best by `score`, all rows if fewer than that score above 0; these by `rerank`, and last by their
    rank plus three times a penalty in [0, 1]; the first k. Ties keep the order before."""
    wanted = max(3 * k, 10)
    hits = scored.where("score > 0").limit(wanted).count()
    first = scored if hits < wanted else scored.orderBy(F.col("score").desc(), key).limit(wanted)
    again = first.withColumn("r1", rerank).withColumn("penalty", F.least(F.greatest(penalty, F.lit(0.0)), F.lit(1.0)))
    # a penalty moves a row by three places at most, so what lies beyond k + 3 cannot come in
    top = again.orderBy(F.col("r1").desc(), F.col("score").desc(), key).limit(k + 3)
    ranked_ = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("r1").desc(), F.col("score").desc(), key)) - 1)
    mixed = ranked_.withColumn("mixed", F.col("rank") + 3 * F.col("penalty")).orderBy("mixed", "rank").limit(k)
    return mixed.select(key, F.row_number().over(Window.orderBy("mixed", "rank")).alias("place"))


def reinforced(memories: DataFrame, accesses: DataFrame, key: str) -> DataFrame:
    """memories with access_count and last_ts brought up to date from an access log (key, ts)."""
    seen = accesses.groupBy(key).agg(F.count("*").alias("__n"), F.max("ts").alias("__last"))
    met = memories.join(seen, key, "left")
    return met.withColumn("access_count", F.col("access_count") + F.coalesce("__n", F.lit(0))).withColumn("last_ts", F.greatest("last_ts", "__last")).drop("__n", "__last")


def edge_upsert(edges: DataFrame, new: DataFrame, both_ways: bool = True) -> DataFrame:
    """Edges (source, target, relation, weight, ts) with the latest weight of each (source, target, relation), new ones in both directions if asked."""
    back = new.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", "weight", "ts")
    all_ = edges.unionByName(new.unionByName(back) if both_ways else new)
    return all_.groupBy("source", "target", "relation").agg(F.max(F.struct("ts", "weight")).alias("e")).select("source", "target", "relation", "e.weight", "e.ts")


def transition_shares(edges: DataFrame) -> DataFrame:
    """(source, target, share): weights below 0 count 0, and a source whose weights add up to 0 goes to its targets alike."""
    w = F.greatest("weight", F.lit(0.0))
    sums = edges.groupBy("source").agg(F.sum(w).alias("total"), F.count("*").alias("n"))
    return edges.join(sums, "source").select("source", "target", F.when(F.col("total") > 0, w / F.col("total")).otherwise(F.lit(1.0) / F.col("n")).alias("share"))


def live_edges(edges: DataFrame) -> DataFrame:
    """Edges that are not obsolete, in both directions."""
    held = edges.where("obsolete = 0").select("source", "target", "weight")
    return held.union(held.select("target", "source", "weight"))


def recall_update(strength: Column, right: Column) -> Column:
    """Memory strength after an answer: half as much again up to 10, or a fifth less down to 1."""
    return F.when(right, F.least(strength * 1.5, F.lit(10.0))).otherwise(F.greatest(strength * 0.8, F.lit(1.0)))


def due(now: Column, last: Column, strength: Column, interval: int) -> Column:
    return now - last >= interval * strength


def penalties(signals: DataFrame, kinds: dict[str, float], group: str) -> DataFrame:
    """(group, penalty): t / (t + 2) of weights of kind times evidence (confirmed 1, refuted 0, else one half) over distinct merge keys and rows without one."""
    weight = F.lit(0.0)
    for kind, w in kinds.items():
        weight = F.when(F.col("kind") == kind, F.lit(w)).otherwise(weight)
    proof = F.when(F.col("evidence") == "confirmed", 1.0).when(F.col("evidence") == "refuted", 0.0).otherwise(0.5)
    tally = signals.groupBy(group, "kind", "evidence").agg((F.count_distinct("merge_key") + F.count_if(F.col("merge_key").isNull())).alias("n"))
    total = tally.groupBy(group).agg(F.sum(weight * proof * F.col("n")).alias("t"))
    return total.select(group, F.round(F.when(F.col("t") > 0, F.col("t") / (F.col("t") + 2)).otherwise(0.0), 9).alias("penalty"))


def tokens_per_second(tokens: Column, ms: Column) -> Column:
    return F.when(ms > 0, F.round(tokens * 1000 / ms, 6)).otherwise(F.lit(0.0))


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is 1, at length 1; zeros if there is none."""
    pairs = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda p: p["m"] == 1)
    zero = F.transform(F.get(vectors, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(pairs, zero, lambda acc, p: F.zip_with(acc, p["v"], lambda x, y: x + y.cast("double")))
    mean = F.transform(total, lambda x: x / F.greatest(F.size(pairs), F.lit(1)))
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(mean, lambda x: x / norm)).otherwise(mean)


def margins(vector: Column, one: Column, two: Column, least: float) -> tuple[Column, Column, Column]:
    """(similarity to one, to two, class) of a unit vector and two unit centroids; a margin below `least` is UNSURE."""
    a, b = dot(vector, one), dot(vector, two)
    return a, b, F.when(F.abs(a - b) < least, "UNSURE").when(a > b, "ONE").otherwise("TWO")


#: Vectors of a block in a search of many queries.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024


def _blocks(rows: DataFrame, n: int, columns: list[str], prefix: str) -> DataFrame:
    """Rows (block, a list for each column) of about equal size, dealt by a hash of the id."""
    grouped = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("r"))
    return grouped.select(F.col("block").alias(f"{prefix}_block"), *[(F.flatten(f"r.{c}") if c == "embedding" else F.col(f"r.{c}")).alias(f"{prefix}_{c}") for c in columns])


def nearest_to_each(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query vector the k rows of vectors (vec_id, embedding, weight) of largest max(0, cosine) * weight, itself left out.

    Vectors have unit length and one size; `weight` carries decay, and filters belong on the inputs. Blocks of queries meet blocks of vectors in a
    grid of cells, each a matrix product, of which k rows a query are kept; ties go to the smaller id after rounding to six digits.
    """
    dim = (vectors.select(F.size("embedding")).first() or [0])[0]
    n, m = (max(1, -(-df.count() // size)) for df, size in ((vectors, BLOCK_ROWS), (queries, QUERY_ROWS)))
    tall = _blocks(vectors, n, ["vec_id", "embedding", "weight"], "v").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    broad = _blocks(queries, m, ["vec_id", "embedding"], "q").withColumn("v_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, flat, weight, asked, asked_flat = (batch.column(c)[r].values.to_numpy() for c in ("v_vec_id", "v_embedding", "v_weight", "q_vec_id", "q_embedding"))
                scores = np.round(np.maximum(asked_flat.astype(np.float64).reshape(-1, dim) @ flat.astype(np.float64).reshape(-1, dim).T, 0) * weight, 6)
                scores[asked[:, None] == ids[None, :]] = -1
                for q, row in enumerate(scores):
                    best = np.lexsort((ids, -row))[:k]
                    best = best[row[best] >= 0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), asked[q])), pa.array(ids[best]), pa.array(row[best])], ["query_id", "vec_id", "score"])

    cells = tall.join(broad, ["v_block", "q_block"]).repartition(min(n * m, 10_000), "v_block", "q_block")
    found = cells.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merged_ranks(dense: DataFrame, sparse: DataFrame, key: str, weights: tuple[float, float], k: int, fields: list[str]) -> DataFrame:
    """(key, fields, score): ranked lists merged by weights over 60 and the rank; a row's fields come from the dense list where it has one; the k best."""
    parts = dense.select(key, *fields, "rank", F.lit(0).alias("side")).unionByName(sparse.select(key, *fields, "rank", F.lit(1).alias("side")))
    share = F.when(F.col("side") == 0, weights[0]).otherwise(weights[1]) / (RRF_K + F.col("rank"))
    merged = parts.groupBy(key).agg(F.round(F.sum(share), 9).alias("score"), F.min_by(F.struct(*fields), "side").alias("f"))
    return merged.select(key, "f.*", "score").orderBy(F.col("score").desc(), key).limit(k)
