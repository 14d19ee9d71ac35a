"""Ranks by ranges, and word alignments against the plain table."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.text import alignment, word_errors
from ledgerloom.operators import metrics, ranking, records


def plain_alignment(r, h):
    line = [(k, 0, 0, k) for k in range(len(h) + 1)]
    for i, x in enumerate(r, 1):
        new = [(i, 0, i, 0)]
        for k, y in enumerate(h, 1):
            d, up, left = line[k - 1], line[k], new[k - 1]
            same = [d] if x == y else [(d[0] + 1, d[1] + 1, d[2], d[3])]
            new.append(min(*same, (up[0] + 1, up[1], up[2] + 1, up[3]), (left[0] + 1, left[1], left[2], left[3] + 1)))
        line = new
    return line[-1][1:]


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
@settings(max_examples=400, deadline=None)
def test_alignment(r, h):
    assert alignment(r, h) == plain_alignment(r, h)


def test_word_errors(spark):
    rows = spark.createDataFrame([("The cat sat", "the hat sat down"), (None, "a b"), ("a b", None), ("", "")], "r string, h string").select(word_errors("r", "h").alias("e")).collect()
    assert [tuple(r.e) for r in rows] == [(1, 0, 1), (0, 0, 2), (0, 2, 0), (0, 0, 0)]
    long_ = ["w%d" % (k % 50) for k in range(3000)]
    assert alignment(long_, long_[:1000] + ["x"] + long_[1000:2000] + long_[2001:]) == (0, 1, 1)


def test_ranks_of_a_group_over_many_ranges(spark):
    rng = random.Random(14)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(500)) for _ in range(4000)] + [("one", 5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    known = {g: sorted(v for v in vs if v is not None) for g, vs in groups.items()}
    got = {r.g: (r.n, r.p50, r.p95) for r in metrics.by_index(df, "g", "v").collect()}
    assert got == {g: (len(v), *[v[min(int(len(v) * q), len(v) - 1)] for q in (0.5, 0.95)]) for g, v in known.items() if v}
    near = {r.g: (r.n, r.p50, r.p95, r.low, r.high) for r in records.nearest_rank(df, "g", "v").collect()}
    assert near == {g: (len(groups[g]), *[float(v[-(-len(v) * q // 100) - 1]) if v else None for q in (50, 95)], min(v, default=None), max(v, default=None)) for g, v in known.items()}
    total = ranking.running_totals(df.where("v IS NOT NULL"), "g", "v", F.lit(1), "upto")
    assert sorted(r.upto for r in total.where("g = 'hot'").collect()) == list(range(1, len(known["hot"]) + 1))
