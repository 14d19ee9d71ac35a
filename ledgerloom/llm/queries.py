"""One query for each operator of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import audit, fingerprints, jaccard, lempelziv, mixing, packing, quality, repair, sharding, simhash, spelling, suffixes, topk
from ledgerloom.llm.tokenids import vocabulary_path
from ledgerloom.plans.session import ship_package

N_SHARDS, WINDOW, QUERY_EVERY, TOP_K, SCALE = 40, 1024, 50, 5, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of every text and its edited text."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents replicated towards tempered source weights, with the number of each copy."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word spans of 50 words or more that stand elsewhere before."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law `rows`."""
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.shard(slim, N_SHARDS, "doc_id", [F.col("text_crc32"), F.col("size")])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document from weights trained on labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(quality.labelled(docs, table(spark, sf_dir, "labels")))
    scored = quality.score(docs, weights)
    return scored.select("doc_id", (quality.remainder(F.col("doc_id")) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files hold of each document."""
    read = repair.token_files(table(spark, sf_dir, "documents"), vocabulary_path())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 1024 ids."""
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), WINDOW)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector against all others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & topk.usable(F.col("embedding")))
    whole = rows.select("vec_id", topk.whole_numbers(F.col("embedding"), SCALE).alias("x"))
    return topk.top_k(whole.where(F.col("vec_id") % QUERY_EVERY == 0), whole, TOP_K)


def op10_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document stand in runs of 20 words seen before, and a digest of the others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lempelziv.strip(docs, 20).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op11_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of every text and components of those at two or fewer differing bits."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), n=3, within=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its more frequent near word and the end of that chain; runs lose a sign by their hash."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), min_length=6, min_n=5, ratio=5, lose_every=199)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, by source, for all orders of them."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = [op1_syncmer_fingerprints, op2_poisson_mix, op3_repeated_passages, op4_feistel_shards, op5_quality_scores]
    ops += [op6_repair_token_files, op7_concat_and_cut, op8_ngram_jaccard, op9_exact_top_k, op10_relative_lempel_ziv]
    ops += [op11_simhash_pigeonring, op12_spelling_variants, op13_filter_audit]
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP8_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m.low, d.doc_id)) AS BIGINT) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) m USING (doc_id)
"""

OP9_SQL = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {TOP_K}
"""

OP10_SQL = rf"""
WITH w AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
runs AS (SELECT doc_id, p, array_to_string(ws[p : p + 19], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w)),
earliest AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS nth FROM runs),
gone AS (SELECT DISTINCT doc_id, p + i AS p FROM earliest, (SELECT unnest(range(0, 20)) AS i) WHERE nth > 1),
kept AS (
    SELECT x.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(x.word, ' ' ORDER BY x.p) FILTER (WHERE gone.p IS NULL) AS kept
    FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


OP13_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS.format("text")} AS ws FROM documents),
f AS (
    SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
        regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM w
),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, k.i AS step, o[1 : k.i - 1] AS earlier, o[k.i] AS own FROM o, k),
t AS (SELECT part, filter_order, step, n, good, toxic, fails[own] AS hit, len(list_filter(earlier, lambda i: fails[i])) > 0 AS out, len(list_filter(fails, lambda x: x)) AS n_fails, own FROM m, s),
r AS (
    SELECT part, filter_order, step, any_value(own) AS own, sum(n) FILTER (WHERE NOT out AND NOT hit) AS kept, sum(n) FILTER (WHERE NOT out AND hit) AS removed, sum(n) FILTER (WHERE out AND hit) AS redundant,
        sum(n) FILTER (WHERE hit AND n_fails = 1) AS unique_fails, sum(good) FILTER (WHERE NOT out AND hit) AS good_lost, sum(toxic) FILTER (WHERE NOT out AND hit) AS toxic_lost
    FROM t GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
    CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM r
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    made = {"op2_poisson_mix": mixing.mix_sql(), "op8_ngram_jaccard": OP8_SQL, "op9_exact_top_k": OP9_SQL, "op10_relative_lempel_ziv": OP10_SQL, "op13_filter_audit": OP13_SQL}
    return made | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
