"""Operator 12: spelling variants by two-dimensional range reporting in wavelet trees.

Two words are near if one inserted, deleted or replaced sign makes them equal. Let w be the longer one (or either), L its length and p the place of
the edit in it. Then w has the other's first p signs before p and its last L - 1 - p signs after p. In the forward order of all words of
length L the first is an interval, in the order of the reversed words the second is; the words in both, points (forward rank, reverse rank) in
a rectangle, are the near words with an edit at p, and a wavelet tree over the reverse ranks in forward order reports them. Words of
one length are indexed together, so a rectangle holds nothing else; of the places in a run of equal signs only the last counts, so each pair is found once.

For a place in the second half of w the first half is left whole, and the other way round. So a word is dealt by its first half to search the
places of the second, and by its second half to search those of the first: trees are built over buckets of such halves of about
`BLOCK` letters. A half with more letters than that is cut into blocks of words that are indexed and blocks of words that ask, and each two blocks
meet once, so that no task holds more.

Words are runs of letters below U+0100, of one byte each here. A form has at least `ratio` times the count of its word, so a chain of forms ends
after a few steps; roots are found by following two steps at once, again and again.

Defined cases: a null text has no words; a null doc_id counts as an empty one in the hash that chooses which runs lose a sign; repeated rows and texts count
again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored, workspace

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Texts from this length on are read run by run, not as one list of runs.
LONG = 1 << 20
#: Different words that a task counts before it hands them on.
HELD_WORDS = 100_000
#: Letters of the words indexed in one bucket.
BLOCK = 1 << 17
PAIRS = "word string, near string, n long, near_n long"


def word_counts(docs: DataFrame, min_length: int, lose_every: int | None = None) -> DataFrame:
    """Rows (word, n) of docs (doc_id long, text string): runs with A-Z in lower case, at least min_length signs long.

    With lose_every, a run with h = crc32 of `<doc_id>:<run>` divisible by it first loses the sign at h % length.
    """

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                seen = Counter(RUN.findall(text) if len(text) < LONG else (m[0] for m in RUN.finditer(text)))
                salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found, n in seen.items():
                    word = found.encode("latin-1").lower()  # of bytes, this changes A-Z only
                    if lose_every:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), salt)
                        if h % lose_every == 0:
                            gone = h % len(word)
                            word = word[:gone] + word[gone + 1 :]
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield table(held)
                    held = Counter()
        yield table(held)

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """Over a permutation s of 0..n-1: which values of s[a:b] lie in [c, d), for many rectangles (a, b, c, d) at once."""

    def __init__(self, s: np.ndarray) -> None:
        self.levels, self.depth = [], max(1, int(len(s) - 1).bit_length())
        for bit in range(self.depth - 1, -1, -1):
            ones = (s >> bit & 1).astype(bool)
            self.levels.append(np.append(0, np.cumsum(~ones)))
            s = np.concatenate([s[~ones], s[ones]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value), one for each point in a rectangle."""
        which, value = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
        for level, zeros in enumerate(self.levels):
            width = 1 << (self.depth - 1 - level)
            left_a, left_b, total = zeros[a], zeros[b], zeros[-1]
            a, b = np.concatenate([left_a, total + a - left_a]), np.concatenate([left_b, total + b - left_b])
            which, value = np.concatenate([which, which]), np.concatenate([value, value + width])
            there = (a < b) & (value < d[which]) & (value + width > c[which])
            a, b, which, value = a[there], b[there], which[there], value[there]
        return which, value


def narrowed(column: np.ndarray, low: np.ndarray, high: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sorted stretches column[low:high], the parts that hold `sign`."""

    def first_from(least: np.ndarray) -> np.ndarray:
        left, right = low.copy(), high.copy()
        while (open_ := left < right).any():
            middle = (left + right) >> 1
            less = open_ & (column[np.minimum(middle, len(column) - 1)] < least)
            left, right = np.where(less, middle + 1, left), np.where(open_ & ~less, middle, right)
        return left

    return first_from(sign), first_from(sign.astype(np.int32) + 1)


def prefix_intervals(ordered: np.ndarray, asked: np.ndarray, upto: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 0..upto, the interval of rows of the sorted matrix `ordered` with the first k signs of each row of `asked`."""
    at = np.zeros(len(asked), dtype=np.int64), np.full(len(asked), len(ordered), dtype=np.int64)
    out = [at]
    for k in range(upto):
        at = narrowed(ordered[:, k], *at, asked[:, k])
        out.append(at)
    return out


def near_in_bucket(points: list[bytes], asked: list[bytes], length: int, second_half: bool) -> tuple[np.ndarray, np.ndarray]:
    """(asking, point): indices of near words, with edits in one half of the point; all points have `length` signs, the asking all that or all one less."""
    none = np.zeros(0, dtype=np.int64)
    if not points or not asked:
        return none, none
    signs = np.frombuffer(b"".join(points), np.uint8).reshape(-1, length)
    theirs = np.frombuffer(b"".join(asked), np.uint8).reshape(-1, len(asked[0]))
    forward = np.argsort(signs.view(f"S{length}").ravel(), kind="stable")
    backward = np.argsort(np.ascontiguousarray(signs[:, ::-1]).view(f"S{length}").ravel(), kind="stable")
    reverse_rank = np.empty(len(points), dtype=np.int64)
    reverse_rank[backward] = np.arange(len(points))
    tree, half = WaveletTree(reverse_rank[forward]), length // 2
    places = range(half, length) if second_half else range(half)
    if not places:
        return none, none
    heads = prefix_intervals(signs[forward], theirs, places[-1])
    tails = prefix_intervals(signs[backward][:, ::-1], theirs[:, ::-1], length - 1 - places[0])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for p in places:
        (a, b), (c, d) = heads[p], tails[length - 1 - p]
        hit = np.flatnonzero((a < b) & (c < d))
        which, value = tree.report(a[hit], b[hit], c[hit], d[hit])
        which, point = hit[which], backward[value]
        if p < theirs.shape[1]:  # else a sign is put at the end
            other = signs[point, p] != theirs[which, p]
            which, point = which[other], point[other]
        found.append((which, point))
    return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


def dealt(words: DataFrame) -> DataFrame:
    """Rows (bucket, side, len, cell, word, n, is_point, asks): each word under its halves, to be found and to ask; see the module's docstring.

    A cell is two blocks of one large half that meet; all other halves of a bucket are in cell 0.
    """
    own = F.length("word")
    longer = own + 1
    first, rest = F.expr("substring(word, 1, length(word) div 2)"), F.expr("substring(word, length(word) div 2 + 1)")
    to_longer = F.expr("substring(word, 1, (length(word) + 1) div 2)"), F.expr("right(word, length(word) + 1 - (length(word) + 1) div 2)")
    spots = [F.struct(F.lit(side).alias("side"), size.alias("len"), half.alias("half"), F.lit(same).alias("same")) for side, size, half, same in (("P", own, first, True), ("S", own, rest, True), ("P", longer, to_longer[0], False), ("S", longer, to_longer[1], False))]
    rows = words.select("word", "n", F.explode(F.array(*spots)).alias("spot")).select("word", "n", "spot.*")
    blocks = F.ceil(F.sum(F.col("len").cast("long")) / BLOCK)
    large = rows.where("same").groupBy("side", "len", "half").agg(blocks.alias("blocks")).where("blocks > 1")
    letters = words.select(F.sum(F.length("word").cast("long")) * 2).first()[0] or 0
    cut = rows.join(large, ["side", "len", "half"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("word"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)

    def spot(i: Column, j: Column, is_point: bool, asks: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), F.lit(is_point).alias("is_point"), asks.alias("asks"))

    as_point = F.transform(every, lambda j: spot(mine, j, True, j == mine))
    as_asking = F.transform(F.filter(every, lambda i: ~F.col("same") | (i != mine)), lambda i: spot(i, mine, False, F.lit(True)))
    meets = F.when(F.col("same"), F.concat(as_point, as_asking)).otherwise(as_asking)
    placed = cut.select("side", "len", "half", "blocks", "word", "n", F.explode(meets).alias("at")).select("side", "len", "half", "blocks", "word", "n", "at.*")
    bucket = F.pmod(F.xxhash64("side", "len", "half", "i", "j"), F.lit(max(1, -(-letters // BLOCK))))
    cell = F.when(F.col("blocks") > 1, F.xxhash64("half", "i", "j")).otherwise(0)
    return placed.select(bucket.alias("bucket"), "side", "len", cell.alias("cell"), "word", "n", "is_point", "asks")


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (word, near, n, near_n), both ways round, for all near words of `words` (word, n)."""

    def search(table: pa.Table) -> pa.Table:
        side, length, cell = (table.column(c).to_numpy(zero_copy_only=False) for c in ("side", "len", "cell"))
        is_point, asks = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("is_point", "asks"))
        words_, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
        held = [w.encode("latin-1") for w in words_]
        size, found = np.array([len(w) for w in held]), []
        for of, at, block in sorted(set(zip(side.tolist(), length.tolist(), cell.tolist(), strict=True))):
            here = (side == of) & (length == at) & (cell == block)
            points = np.flatnonzero(here & is_point)
            for short in (0, 1):
                asking = np.flatnonzero(here & asks & (size == at - short))
                which, point = near_in_bucket([held[i] for i in points], [held[i] for i in asking], at, of == "P")
                pair = asking[which], points[point]
                found += [pair, pair[::-1]] if short else [pair]
        left, right = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        column = table.column("word").combine_chunks()
        return pa.table({"word": column.take(pa.array(left)), "near": column.take(pa.array(right)), "n": counts[left], "near_n": counts[right]})

    return dealt(words).groupBy("bucket").applyInArrow(search, PAIRS)


def roots(forms: DataFrame, path: str) -> DataFrame:
    """Rows (word, root): the last word that forms (word, form) lead to. Steps double each round, until none goes further."""
    at, turn = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), f"{path}/roots-0"), 0
    while at.where("moved").limit(1).count():
        turn += 1
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = stored(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"{path}/roots-{turn}")
    return at.select("word", "root")


def spelling_forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each row of `words` (word, n), of different words.

    form is the near word of largest n (then the smallest), if that is at least ratio * n; root is where forms lead in the end.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words")
    path = workspace(words.sparkSession)
    words = stored(words, f"{path}/words")
    best = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("k"), F.col("near")))
    stats = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = F.col("best.near_n") >= ratio * F.col("n")
    told = words.join(stats, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("best.near_n")).alias("form_n"))
    told = stored(told, f"{path}/told")
    ends = roots(told.where("form IS NOT NULL").select("word", "form"), path)
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = 6, min_n: int = 5, ratio: int = 5, lose_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """spelling_forms of the words of all texts with at least min_length signs and min_n occurrences."""
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return spelling_forms(word_counts(slim, min_length, lose_every).where(F.col("n") >= min_n), ratio)
