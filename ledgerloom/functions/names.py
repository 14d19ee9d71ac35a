"""Column functions that compare party names, narrations and references. Costly ones belong on pairs that a join has left."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from ledgerloom.functions.text import core_tokens, unmarked_upper, words
from ledgerloom.plans.storage import SMALL

# Short names of firms in narrations, and what they stand for.
KNOWN_SHORT = [
    ("HAGL", "HOANG ANH GIA LAI"), ("VCS", "VINACOMIN"), ("VCS", "THAN KHOANG SAN VINACOMIN"), ("MB", "MAY BOM"), ("HD", "HAI DANG"), ("AP", "AN PHAT"), ("TL", "THANG LONG"), ("DV", "DAI VIET"),
    ("HB", "HOA BINH"), ("SH", "SONG HONG"), ("TV", "TRI VIET"), ("TCB", "TECHCOMBANK"), ("VCB", "VIETCOMBANK"), ("BIDV", "DAU TU VA PHAT TRIEN"), ("CTG", "VIETINBANK"),
]
# Words of transfers that say nothing about the parties.
FILLER = ["CK", "TT", "TIEN", "CHUYEN", "KHOAN", "THANH", "TOAN", "NAPAS", "VIETQR", "IBFT", "DA", "TRU", "PHI", "DON", "HANG", "THEO", "XIN", "CAM", "ON", "CONG", "TY", "TNHH", "CP", "CO", "PHAN", "MTV", "TAP", "DOAN", "CTY"]

#: What separates words, as Spark's patterns read white space.
BLANK = r"[ \t\n\x0b\f\r]"


def _matching(a: str, b: str) -> tuple[int, int]:
    """(equal letters within reach, half of those out of order)."""
    reach, taken, mine = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    theirs = [b[j] for j in range(len(b)) if taken[j]]
    return len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2


def _same_start(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))


@lru_cache(maxsize=1 << 16)
def float_winkler(a: str, b: str) -> float:
    """Jaro with a tenth of the rest for each of up to four equal first letters, from 0.7 on."""
    if a == b:
        return 1.0
    m, moved = _matching(a, b)
    j = (m / len(a) + m / len(b) + (m - moved) / m) / 3 if m else 0.0
    return j + 0.1 * _same_start(a, b) * (1 - j) if j >= 0.7 else j


def with_bonus(j: int, same: int) -> int:
    """Jaro in basis points with a tenth of the rest for each of `same` equal first letters, from 7000 on."""
    return min(10_000, j + (same * (10_000 - j) + 5) // 10) if j >= 7_000 else j


def truncated_winkler(a: str, b: str) -> int:
    """The same in basis points, every step cut to whole ones."""
    if a == b:
        return 10_000
    m, moved = _matching(a, b)
    j = (m * 10_000 // len(a) + m * 10_000 // len(b) + (m - moved) * 10_000 // m) // 3 if m else 0
    return with_bonus(j, _same_start(a, b))


@F.pandas_udf(DoubleType())
def winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow form of float_winkler; a null gives 0."""
    return pd.Series([float_winkler(x, y) if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(IntegerType())
def winkler_bps(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow form of truncated_winkler; a null gives 0."""
    return pd.Series([truncated_winkler(x, y) if x is not None and y is not None else 0 for x, y in zip(a, b, strict=True)], dtype="int32")


def party_similarity(a: Column, b: Column) -> Column:
    """How alike two parties are, without the phrases of transfers around them: 1 for equal names or cores, 0.88 and more where the words or the letters of one core lie in the other,
    else Jaro-Winkler of the cores, which counts at most 0.65 if they share no word."""
    a, b = without_boilerplate(a), without_boilerplate(b)
    one, two = core_tokens(a), core_tokens(b)
    x, y = F.array_join(one, " "), F.array_join(two, " ")
    set_x, set_y = F.array_distinct(one), F.array_distinct(two)
    shared, least, most = F.size(F.array_intersect(set_x, set_y)), F.least(F.size(set_x), F.size(set_y)), F.greatest(F.size(set_x), F.size(set_y))
    held = F.when(least > 0, shared / least).otherwise(F.lit(0.0))
    short, long_ = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    letters = winkler(x, y)
    telling = F.exists(one, lambda w: (F.length(w) >= 4) & F.array_contains(set_y, w))
    rest = F.greatest(letters, held * 0.85)
    plain_a, plain_b = F.trim(a), F.trim(b)
    return (
        F.when(plain_a == plain_b, F.lit(1.0))
        .when((plain_a == "") | (plain_b == ""), F.lit(0.0))
        .when(x == y, F.lit(1.0))
        .when((least > 0) & (shared == least), 0.88 + 0.12 * least / most)
        .when((short >= 3) & (F.contains(x, y) | F.contains(y, x)), 0.88 + 0.12 * short / long_)
        .when(held >= 0.8, 0.88 + 0.12 * held)
        .when(shared == 0, F.least(letters, F.lit(0.65)))
        .when(telling & (rest < 0.75), F.greatest(rest, 0.70 + 0.15 * held))
        .otherwise(rest)
    )


def plain_form(name: Column) -> Column:
    """A name as `plain_similarity` takes it."""
    return F.lower(unmarked_upper(F.trim(name)))


def plain_party_similarity(a: Column, b: Column) -> Column:
    """The simpler comparison: 0.95 where one name holds the other, 0.90 where 60 % of the words agree, else Jaro-Winkler."""
    return plain_similarity(plain_form(a), plain_form(b))


def plain_similarity(x: Column, y: Column) -> Column:
    """plain_party_similarity of names in their plain form."""
    one, two = words(x), words(y)
    share = F.size(F.array_intersect(one, two)) / F.greatest(F.least(F.size(F.array_distinct(one)), F.size(F.array_distinct(two))), F.lit(1))
    return F.when((x == "") | (y == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).when(F.contains(x, y) | F.contains(y, x), F.lit(0.95)).when(share >= 0.6, F.lit(0.90)).otherwise(winkler(x, y))


def once_each(rows: DataFrame, one: str, two: str, made: dict[str, Column]) -> DataFrame:
    """rows with the columns `made` from the texts of columns `one` and `two`, worked out once for each distinct pair of texts.

    The pairs are dealt over tasks anew, however few files the rows come from.
    """
    pairs = rows.select(one, two).distinct()
    compared = pairs.select(F.col(one).alias("__one"), F.col(two).alias("__two"), *[c.alias(n) for n, c in made.items()])
    compared = F.broadcast(compared) if pairs.limit(SMALL + 1).count() <= SMALL else compared
    return rows.join(compared, F.col(one).eqNullSafe(F.col("__one")) & F.col(two).eqNullSafe(F.col("__two"))).drop("__one", "__two")


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda w: F.substring(w, 1, 1)), "")


def short_name_bps(party: Column, narration: Column) -> Column:
    """9500 where the party's initials are a word of the narration, 9200 for a known short name, 8500 for the initials of two to four words in a row, else 0."""
    p, n = words(F.upper(party)), words(F.upper(narration))
    whole = initials(p)
    known = F.lit(False)
    for short, full in KNOWN_SHORT:
        known = known | ((F.contains(F.upper(party), F.lit(full)) | F.contains(F.lit(full), F.upper(party))) & F.array_contains(n, short))
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda k: F.when(F.size(p) >= k, F.transform(F.sequence(F.lit(1), F.size(p) - k + 1), lambda i: initials(F.slice(p, i, k)))).otherwise(F.array().cast("array<string>"))))
    return F.when((F.length(whole) >= 2) & F.array_contains(n, whole), 9_500).when(known, 9_200).when(F.arrays_overlap(parts, n), 8_500).otherwise(0)


def core_coverage_bps(party: Column, narration: Column) -> Column:
    """The share of the party's telling words that stand in a telling word of the narration; all of them count 9200 at least."""

    def telling(x: Column) -> Column:
        return F.filter(words(F.upper(x)), lambda w: (F.length(w) > 1) & ~w.isin(FILLER))

    p, n = telling(party), telling(narration)
    covered = F.size(F.filter(p, lambda w: F.exists(n, lambda v: F.contains(v, w))))
    ratio = F.call_function("div", (covered * 10_000).cast("long"), F.greatest(F.size(p), F.lit(1)).cast("long")).cast("int")
    return F.when(F.size(p) == 0, 0).when(covered == F.size(p), F.greatest(ratio, F.lit(9_200))).otherwise(ratio)


def token_cosine(a: str, b: str) -> int:
    """Cosine of two texts over words, each worth 10, and pairs of neighbouring letters, each worth 3, in whole basis points."""
    if not a or not b:
        return 0
    if a == b:
        return 10_000

    def weights(x: str) -> Counter[str]:
        held, bare = Counter(), re.sub(BLANK, "", x)
        for word in re.split(BLANK, x):
            held[word] += 10
        for k in range(len(bare) - 1):
            held[bare[k : k + 2]] += 3
        del held[""]
        return held

    one, two = weights(a), weights(b)
    dot = sum(w * two[t] for t, w in one.items() if t in two)
    product = sum(w * w for w in one.values()) * sum(w * w for w in two.values())
    return min(10_000, dot * 10_000 // max(1, isqrt(product)))


@F.pandas_udf(IntegerType())
def token_cosine_bps(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow form of token_cosine; a null gives 0. As an expression its terms would be made again for each term."""
    return pd.Series([token_cosine(x, y) if x is not None and y is not None else 0 for x, y in zip(a, b, strict=True)], dtype="int32")


def semantic_bps(party: Column, narration: Column) -> Column:
    """The greatest of short name, coverage of telling words and cosine."""
    p, n = F.upper(party), F.upper(narration)
    return F.when((p == "") | (n == ""), 0).when(p == n, 10_000).otherwise(F.greatest(short_name_bps(p, n), core_coverage_bps(p, n), token_cosine_bps(p, n)))


# How references are written in narrations, in the order in which they are looked for.
REFERENCES = [r"\b((?:HD|INV|PC|PT)[-_/ ]?\d{4}[-_/ ]?\d{2,8})\b", r"\b((?:HD|INV|PC|PT|FT|NPS|VN)[-_/ ]?\d{2,12})\b", r"\b([A-Z]{2,3}-\d{3,})\b"]


def narration_refs(narration: Column) -> Column:
    """All references in a narration, by pattern and then by place, without repeats."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.upper(narration), F.lit(p), F.lit(1)) for p in REFERENCES])))


# Phrases of transfers without meaning, longest first.
BOILERPLATE = ["CHUYEN TIEN NHANH", "THANH TOAN TIEN", "CHUYEN KHOAN", "THANH TOAN", "CHUYEN TIEN", "NAPAS247", "VIETQR", "IBFT", "CK", "TT"]


def without_boilerplate(narration: Column) -> Column:
    """Words of a narration that are left without marks and without phrases of transfers."""
    out = F.concat(F.lit(" "), unmarked_upper(narration), F.lit(" "))
    for phrase in BOILERPLATE:
        out = F.regexp_replace(out, f" {phrase}(?= )", "")
    return F.trim(F.regexp_replace(out, " +", " "))
