"""Column functions on references, narrations, party names and personal data."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

def _unmarked() -> dict[str, str]:
    """Every precomposed Latin letter with marks and its plain letter, by the decomposition that Unicode states, and the stroked d."""
    made = {"đ": "d", "Đ": "D"}
    for at in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(at))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(c) for c in base[1:]):
            made[chr(at)] = base[0]
    return made


MARKED, PLAIN = ("".join(x) for x in zip(*_unmarked().items(), strict=True))
# The forms of companies that say nothing about which company it is; phrases first.
LEGAL_PHRASES = ["JOINT STOCK COMPANY", "CONG TY CO PHAN", "CONG TY TNHH MTV", "CONG TY TNHH", "CONG TY", "TAP DOAN", "CO PHAN", "CO LTD"]
LEGAL_TOKENS = ["COMPANY", "GROUP", "BANK", "JSC", "LTD", "CTY", "TNHH", "CP", "MTV", "TM", "DV", "XNK"]


def unmarked_upper(x: Column) -> Column:
    """Letters without marks, precomposed or not, in upper case."""
    return F.upper(F.translate(F.regexp_replace(x, r"\p{M}", ""), MARKED, PLAIN))


def bare_ref(x: Column) -> Column:
    return F.translate(x, "-_/ .", "")


def doc_ref(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(x), "[^A-Z0-9]", ""), "^(HD|INV)0+", "$1")


def refs_in(x: Column, pattern: str = r"([A-Z]{2,3}-?[0-9]{3,})") -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(1))


def core_tokens(x: Column) -> Column:
    """The words of a name without marks and without company forms, which go as whole words only."""
    out = F.concat(F.lit(" "), F.regexp_replace(unmarked_upper(x), "[^A-Z0-9]+", " "), F.lit(" "))
    for form in LEGAL_PHRASES:
        out = F.regexp_replace(out, f" {form}(?= )", "")
    return F.filter(F.split(F.trim(out), " +"), lambda w: (w != "") & ~w.isin(LEGAL_TOKENS))


def core_name(x: Column) -> Column:
    """core_tokens in one string; a name of nothing but forms keeps all its words."""
    kept = F.array_join(core_tokens(x), " ")
    return F.when(kept == "", F.trim(F.regexp_replace(unmarked_upper(x), "[^A-Z0-9]+", " "))).otherwise(kept)


def containment_bps(words: Column, whole: Column) -> Column:
    """Share of the words that stand somewhere in `whole`, in basis points."""
    hit = F.size(F.filter(words, lambda w: F.contains(whole, w)))
    return F.when(F.size(words) > 0, F.call_function("div", (hit * 10_000).cast("long"), F.size(words).cast("long"))).otherwise(F.lit(0).cast("long"))


def words(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda w: w != "")


def thousand_dots(x: Column) -> Column:
    return F.translate(F.format_number(x, 0), ",", ".")


def mask_secrets(x: Column) -> Column:
    """Mail addresses, long digit runs, card-like groups and secret-like assignments replaced in that order."""
    out = F.regexp_replace(x, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    out = F.regexp_replace(out, r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}", "[CARD]")
    out = F.regexp_replace(out, r"(api_key|password|token)=[^ ]+", "$1=[SECRET]")
    return F.regexp_replace(out, r"[0-9]{9,}", "[NUMBER]")


def jaro_micro(a: str, b: str) -> int:
    """Jaro similarity in millionths, in integer arithmetic."""
    if a == b:
        return 1_000_000 if a else 0
    reach, taken, mine = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0
    moved = sum(x != y for x, y in zip(mine, (b[j] for j in range(len(b)) if taken[j]), strict=True)) // 2
    return (m * 1_000_000 // len(a) + m * 1_000_000 // len(b) + (m - moved) * 1_000_000 // m) // 3


def jaro_winkler_bps(a: str, b: str) -> int:
    """Jaro in basis points, rounded half up, with a bonus for up to four equal first letters from 7000 on."""
    j = (jaro_micro(a, b) + 50) // 100
    if j < 7_000:
        return j
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return min(10_000, j + (same * (10_000 - j) + 5) // 10)


@F.pandas_udf(IntegerType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow form of jaro_winkler_bps; a null gives 0. Use it on edges that cheap filters have left."""
    return pd.Series([jaro_winkler_bps(x, y) if x is not None and y is not None else 0 for x, y in zip(a, b, strict=True)], dtype="int32")


def alignment(reference: list[str], spoken: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a shortest alignment of words; of several the one with fewest substitutions, then deletions.

    A row of the table is worked on at once: a cell holds its cost and both counts in one whole number, whose order is theirs, and insertions along a row are a
    running minimum.
    """
    codes: dict[str, int] = {}
    r, h = (np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64) for words in (reference, spoken))
    bits = 20 if max(len(r), len(h)) < 1 << 20 else 40
    kind = np.int64 if bits == 20 else object
    cost, step = 1 << (2 * bits + 2), 1 << (bits + 1)
    along = np.arange(len(h) + 1).astype(kind) * cost
    line = along.copy()
    for x in r.tolist():
        new = line + (cost + 1)
        new[1:] = np.minimum(new[1:], line[:-1] + np.where(h == x, 0, cost + step).astype(kind))
        line = np.minimum.accumulate(new - along) + along
    last = int(line[-1])
    substitutions, deletions = last % cost // step, last % step
    return substitutions, deletions, last // cost - substitutions - deletions


@F.pandas_udf(StructType([StructField(n, IntegerType()) for n in ("substitutions", "deletions", "insertions")]))
def word_errors(reference: pd.Series, spoken: pd.Series) -> pd.DataFrame:
    """Word-level edit operations from reference to what was recognised, in lower case; a null text has no words."""
    rows = [alignment((ref or "").lower().split(), (hyp or "").lower().split()) for ref, hyp in zip(reference, spoken, strict=True)]
    return pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions"])
