"""Three-tier matching of bank lines (line_id, ref, customer, party, amount, ts) to invoices (invoice_id, doc_ref, ...).

Tiers give candidate edges by joins; the walk in input order that picks one invoice for each line then runs as rounds over those edges
(see `assign`), so it is exact and distributed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.names import narration_refs, party_similarity, plain_form, plain_similarity, without_boilerplate
from ledgerloom.functions.text import doc_ref, unmarked_upper
from ledgerloom.plans.storage import stored, workspace

BUCKET = 11_000
DAY = 86_400


def exact_edges(lines: DataFrame, invoices: DataFrame, seconds: int = DAY) -> DataFrame:
    """Tier 1: equal amount and reference, at most a day apart."""
    left = lines.where("ref <> ''").withColumn("key", doc_ref(F.col("ref")))
    right = invoices.select("invoice_id", F.col("amount").alias("inv_amount"), F.col("ts").alias("inv_ts"), doc_ref(F.col("doc_ref")).alias("key"))
    met = left.join(right, (left["key"] == right["key"]) & (left["amount"] == right["inv_amount"]))
    return met.where(F.abs(F.col("ts") - F.col("inv_ts")) <= seconds).select("line_id", "invoice_id")


def band_edges(lines: DataFrame, invoices: DataFrame, most: int = BUCKET, seconds: int = 3 * DAY, parties: bool = False) -> DataFrame:
    """Tier 2: same party, short by nothing or by a fee of 1100 up to `most`, at most three days apart.

    Amounts are cut into buckets of `most`; a line looks into its own bucket and the two beside it. With `parties` an edge has both names, as paid_by and billed.
    """
    bucket = F.expr(f"amount DIV {most}")
    left = lines.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    billed = [F.col("party").alias("billed")] if parties else []
    right = invoices.select("invoice_id", "customer", F.col("amount").alias("inv_amount"), F.col("ts").alias("inv_ts"), bucket.alias("bucket"), *billed)
    delta = F.col("inv_amount") - F.col("amount")
    met = left.join(right, ["customer", "bucket"]).where(((delta == 0) | ((delta >= 1100) & (delta <= most))) & (F.abs(F.col("ts") - F.col("inv_ts")) <= seconds))
    named = [F.col("party").alias("paid_by"), "billed"] if parties else []
    return met.select("line_id", "invoice_id", delta.alias("fee"), F.abs(F.col("ts") - F.col("inv_ts")).alias("lag"), *named)


def assign(edges: DataFrame, prefer: list[str]) -> DataFrame:
    """One invoice at most for each line and the reverse, as if lines chose in line_id order the free invoice first by `prefer`.

    Rows where both sides have a single edge are final at once. The rest is taken round by round: an edge is
    final when its line is the smallest that still wants its invoice and the invoice is that line's first choice. After
    a few rounds lines with the same candidates in the same order are settled together, see `alike`. The smallest line is
    settled in every round, so the rounds come to an end.
    """
    spark = edges.sparkSession
    path = workspace(spark)
    rest, done, turn = edges.select("line_id", "invoice_id", *prefer), None, 0
    while True:
        choice = F.row_number().over(Window.partitionBy("line_id").orderBy(*prefer, "invoice_id"))
        firsts = rest.withColumn("choice", choice).withColumn("smallest", F.min("line_id").over(Window.partitionBy("invoice_id")))
        final = firsts.where("choice = 1 AND smallest = line_id").select("line_id", "invoice_id")
        if turn >= 3:
            final = final.union(alike(firsts)).distinct()
        taken = stored(final, f"{path}/taken-{turn}")
        if not taken.limit(1).count():
            return done if done is not None else taken
        done = taken if done is None else done.union(taken)
        if turn % 20 == 19:
            done = stored(done, f"{path}/done-{turn}")
        left = rest.join(taken.select("line_id"), "line_id", "left_anti").join(taken.select("invoice_id"), "invoice_id", "left_anti").select("line_id", "invoice_id", *prefer)
        rest = stored(left, f"{path}/rest-{turn}")
        turn += 1


def alike(firsts: DataFrame) -> DataFrame:
    """Edges that the serial walk takes among lines with equal lists of candidates: the n-th line gets the n-th candidate.

    This holds for the lines of such a group that are smaller than any other line that wants one of its candidates.
    """
    lists = firsts.groupBy("line_id").agg(F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("choice", "invoice_id"))), lambda x: x["invoice_id"])), 256).alias("same"))
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("same").orderBy("line_id")))
    held = firsts.select("line_id", "invoice_id", "choice").join(ranked, "line_id")
    order = Window.partitionBy("invoice_id").orderBy("low")
    lows = held.groupBy("invoice_id", "same").agg(F.min("line_id").alias("low"))
    others = lows.withColumn("other", F.when(F.row_number().over(order) == 1, F.lead("low").over(order)).otherwise(F.min("low").over(Window.partitionBy("invoice_id"))))
    bounds = others.groupBy("same").agg(F.min("other").alias("bound"))
    return held.where("rank = choice").join(bounds, "same").where("bound IS NULL OR line_id < bound").select("line_id", "invoice_id")


def residual(rows: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    return rows.join(matched.select(key), key, "left_anti")


def nearest(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """For each line the invoice of the same customer with the nearest amount, ties to the smaller id.

    Lines and the smallest invoice of each amount are sorted together by amount; the nearest are the last before and the first after.
    """
    inv = invoices.groupBy("customer", "amount").agg(F.min("invoice_id").alias("invoice_id"))
    both = lines.select("customer", "amount", "line_id", F.lit(None).cast("struct<amount:bigint,id:bigint>").alias("i")).unionByName(inv.select("customer", "amount", F.lit(None).cast("long").alias("line_id"), F.struct("amount", F.col("invoice_id").alias("id")).alias("i")))
    order = Window.partitionBy("customer").orderBy("amount")
    below = F.last("i", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    # backwards, as a frame that shrinks is read again for each row
    above = F.last("i", ignorenulls=True).over(Window.partitionBy("customer").orderBy(-F.col("amount")).rangeBetween(Window.unboundedPreceding, 0))

    def choice(c: Column) -> Column:
        return F.when(c.isNotNull(), F.struct(F.abs(c["amount"] - F.col("amount")).alias("distance"), c["id"].alias("invoice_id")))

    met = both.withColumn("m", F.least(choice(below), choice(above))).where("line_id IS NOT NULL AND m IS NOT NULL")
    return met.select("line_id", "m.invoice_id", "m.distance")


def octave(amount: Column) -> Column:
    """The place of the highest bit of a positive amount."""
    return (F.length(F.bin(amount)) - 1).cast("int")


def pair_splits(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """Lines that equal the sum of two invoices of their customer; the smallest pair of ids.

    The larger part is at least half of the line, so only invoices of the line's octave and the one below ask for the rest of the amount; of equal
    invoices the two smallest ids suffice.
    """
    equal = F.row_number().over(Window.partitionBy("customer", "amount").orderBy("invoice_id"))
    few = invoices.where("amount > 0").select("customer", "invoice_id", "amount", equal.alias("r")).where("r <= 2")
    a = few.select("customer", F.col("invoice_id").alias("a_id"), F.col("amount").alias("a"), octave(F.col("amount")).alias("octave"))
    b = few.select("customer", F.col("invoice_id").alias("b_id"), F.col("amount").alias("rest"))
    near = lines.where("amount > 0").select("line_id", "customer", "amount", F.explode(F.array(octave(F.col("amount")), octave(F.col("amount")) - 1)).alias("octave"))
    asked = near.join(a, ["customer", "octave"]).where("2 * a >= amount AND a < amount").withColumn("rest", F.col("amount") - F.col("a"))
    met = asked.join(b, ["customer", "rest"]).where("a_id <> b_id")
    pair = F.struct(F.least("a_id", "b_id").alias("first_id"), F.greatest("a_id", "b_id").alias("second_id"))
    return met.groupBy("line_id").agg(F.min(pair).alias("p")).select("line_id", "p.first_id", "p.second_id")


#: Triples that are looked up for a line at most; beyond that the search with its steps goes on, and says so where it ends.
MOST_TRIPLES = 4_000_000
#: Items that a search by steps looks up at once.
STRETCH = 512


class Parts:
    """The (id, amount) items of a customer, by amount and id in arrays that lines after one another take from; of rows with one id the last counts."""

    def __init__(self, items: Iterable[tuple[int, int]] | np.ndarray) -> None:
        ids, amounts = (items if isinstance(items, np.ndarray) else np.array(list(items), dtype=np.int64).reshape(-1, 2)).T
        ids, at = np.unique(ids[::-1], return_index=True)
        amounts = amounts[::-1][at]
        order = np.argsort(amounts, kind="stable")
        order = order[np.searchsorted(amounts[order], 0, side="right") :]
        self.ids, self.amounts = ids[order], amounts[order]
        self.sums = np.append(0, np.cumsum(self.amounts))

    def __len__(self) -> int:
        return len(self.ids)

    def drop(self, gone: list[int]) -> None:
        spots = np.concatenate([np.flatnonzero(self.ids == i) for i in gone])
        self.ids, self.amounts = np.delete(self.ids, spots), np.delete(self.amounts, spots)
        self.sums = np.append(0, np.cumsum(self.amounts))


def few_items(target: int, items: Parts | list[tuple[int, int]]) -> tuple[list[int] | None, bool]:
    """(ids of two or else three of the (id, amount) items that add up to target, whether all triples were looked at), found by looking up the rest.

    Of the triples only those are looked at whose third part lies between the second and the greatest amount.
    """
    held = items if isinstance(items, Parts) else Parts(items)
    below = held.amounts[: np.searchsorted(held.amounts, target)]
    amounts, left = below[np.append(True, below[1:] != below[:-1])] if len(below) else below, MOST_TRIPLES
    if not len(amounts):
        return None, True

    def ids(*parts: int) -> list[int] | None:
        taken: list[int] = []
        for x in set(parts):
            at, n = int(np.searchsorted(below, x)), parts.count(x)
            if at + n > len(below) or below[at + n - 1] != x:
                return None
            taken += held.ids[at : at + n].tolist()
        return sorted(taken)

    def there(rest: np.ndarray) -> np.ndarray:
        return amounts[np.minimum(np.searchsorted(amounts, rest), len(amounts) - 1)] == rest

    small = amounts[: np.searchsorted(amounts, target // 2, side="right")]
    pairs = [found for x in small[there(target - small)].tolist() if (found := ids(x, target - x))]
    if pairs:
        return min(pairs), True
    most = int(amounts[-1])
    for k in range(int(np.searchsorted(amounts, target - 2 * most)), int(np.searchsorted(amounts, target // 3, side="right"))):
        x = int(amounts[k])
        low, high = max(k, int(np.searchsorted(amounts, target - x - most))), int(np.searchsorted(amounts, (target - x) // 2, side="right"))
        seconds = amounts[low : min(high, low + left)]
        for y in seconds[there(target - x - seconds)].tolist():
            if found := ids(x, y, target - x - y):
                return found, True
        left -= max(0, high - low)
        if left < 0:
            return None, False
    return None, True


def search(target: int, items: Parts | list[tuple[int, int]], most: int = 8, steps: int = 100_000) -> tuple[list[int] | None, bool]:
    """(ids of two to `most` of the (id, amount) items that add up to target, whether the depth-first search came to its end)."""
    held = items if isinstance(items, Parts) else Parts(items)
    n, amounts, sums = int(np.searchsorted(held.amounts, target, side="right")), held.amounts, held.sums

    def view(first: int) -> tuple[list[int], list[int], list[int], list[int]]:
        """Amounts, ids, where the next smaller amount begins, and sums from here on, of a stretch in falling order of amount and rising order of id."""
        back = n - 1 - np.arange(first, min(n, first + STRETCH))
        here = amounts[back]
        starts = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
        counts = np.diff(np.append(starts, len(here)))
        high, low = back[starts] + 1, back[starts + counts - 1]
        high[0], low[-1] = np.searchsorted(amounts, here[0], side="right"), np.searchsorted(amounts, here[-1])
        low, high = np.repeat(low, counts), np.repeat(high, counts)
        left = sums[np.maximum(n - np.arange(first, first + len(back) + most + 1), 0)]
        return here.tolist(), held.ids[low + high - 1 - back].tolist(), (n - low).tolist(), left.tolist()

    # only stretches that the search comes to are looked at, as a customer may have millions of items
    seen: dict[int, tuple[list[int], list[int], list[int], list[int]]] = {}
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, target, ())]
    while stack and steps:
        steps -= 1
        k, left, chosen = stack.pop()
        if left == 0:
            if len(chosen) >= 2:
                return sorted(chosen), True
            continue
        if k == n or len(chosen) == most:
            continue
        at, j = divmod(k, STRETCH)
        if at not in seen:
            seen[at] = view(at * STRETCH)
        some, ids, other, tails = seen[at]
        # the most that the places left can hold, from here on
        if tails[j] - tails[j + most - len(chosen)] < left:
            continue
        stack.append((other[j], left, chosen))
        if some[j] <= left:
            stack.append((k + 1, left - some[j], (*chosen, ids[j])))
    return None, not stack


def subset_sum(target: int, items: list[tuple[int, int]], most: int = 8, steps: int = 100_000) -> list[int] | None:
    """Ids of two to `most` of the (id, amount) items that add up to target, by a bounded depth-first search."""
    return search(target, items, most, steps)[0]


#: Lines of a customer that are searched one after another in a task.
LINES_PER_BLOCK = 256


def hopeful(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """The lines whose customer has at least two free invoices, and enough money in those up to the line's octave: no line that could be a sum is left out."""
    sums = invoices.groupBy("customer", octave(F.col("amount")).alias("octave")).agg(F.sum("amount").alias("s"), F.count("*").alias("n"))
    upto = Window.partitionBy("customer").orderBy("octave")  # sixty-three rows a customer at most
    known = sums.select("customer", "octave", F.sum("s").over(upto).alias("all_parts"), F.sum("n").over(upto).alias("n"), (F.lead("octave").over(upto) - 1).alias("last"))
    spans = known.select("customer", F.explode(F.sequence("octave", F.coalesce("last", F.lit(63)))).alias("octave"), "all_parts", "n")
    return lines.withColumn("octave", octave(F.col("amount"))).join(spans, ["customer", "octave"]).where("n >= 2 AND all_parts >= amount").select("line_id", "customer", "amount")


def searched(lines: DataFrame, invoices: DataFrame, most: int, steps: int) -> DataFrame:
    """(line_id, invoice_ids, status) of one search for each line; see `splits`. Lines of one block find different invoices, those of different blocks may not."""
    blocks = lines.groupBy("customer").agg(F.expr(f"(count(*) + {LINES_PER_BLOCK - 1}) DIV {LINES_PER_BLOCK}").alias("blocks"))
    # lines of one amount stand in one block as long as it is not full, as they would find the same invoices in each
    same = F.row_number().over(Window.partitionBy("customer", "amount").orderBy("line_id"))
    mine = F.pmod(F.xxhash64("amount", F.expr(f"(same - 1) DIV {LINES_PER_BLOCK}")), F.col("blocks"))
    wanted = lines.withColumn("same", same).join(blocks, "customer").select("customer", mine.alias("block"), F.col("line_id").alias("id"), "amount", F.lit(True).alias("is_line"))
    held = invoices.join(blocks, "customer").select("customer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("invoice_id").alias("id"), "amount", F.lit(False).alias("is_line"))

    def solve(targets: list[tuple[int, int]], held: list[pa.RecordBatch]) -> Iterator[tuple[int, list[int] | None, str]]:
        if not targets:
            return
        items = Parts(np.concatenate([np.column_stack([b.column(c).to_numpy() for c in ("id", "amount")]) for b in held] or [np.zeros((0, 2), dtype=np.int64)]))
        for line, target in sorted(targets):
            found, over = few_items(target, items)
            if not found and (most > 3 and len(items) > 3 or not over):
                found, over = search(target, items, most, steps)
            if found:
                items.drop(found)
            if found or not over:
                yield line, found, "SPLIT" if found else "EXHAUSTED"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks stand together; one is held at a time, its invoices as arrays."""
        here, targets, free = None, [], []

        def made(out: list[tuple]) -> pa.RecordBatch:
            lists = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(lists, (pa.int64(), pa.list_(pa.int64()), pa.string()), strict=True)], ["line_id", "invoice_ids", "status"])

        for batch in batches:
            out: list[tuple] = []
            who, block, is_line = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("customer", "block", "is_line"))
            edges = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (block[1:] != block[:-1]) | (is_line[1:] != is_line[:-1]))) if len(who) else []
            for start, stop in zip(edges, [*edges[1:], len(who)], strict=True):
                if (who[start], block[start]) != here:
                    out += solve(targets, free)
                    here, targets, free = (who[start], block[start]), [], []
                part = batch.slice(start, stop - start).select(["id", "amount"])
                if is_line[start]:
                    targets += zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                else:
                    free.append(part)
            yield made(out)
        yield made(list(solve(targets, free)))

    # a count of its own, as adaptive execution would put so few bytes into one task, and by the lines, so that large blocks seldom share one
    tasks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1_000, lines.count() // 2_000))
    together = wanted.unionByName(held).select("customer", "block", "id", "amount", "is_line").repartition(tasks, "customer", "block").sortWithinPartitions("customer", "block", "is_line")
    return together.mapInArrow(run, "line_id long, invoice_ids array<long>, status string")


def splits(lines: DataFrame, invoices: DataFrame, most: int = 8, steps: int = 100_000) -> DataFrame:
    """Lines that equal the sum of several invoices of their customer: (line_id, invoice_ids, status).

    A line takes its smallest pair of invoices, found by joins, if no smaller line's is in its way. Only lines left that could be a sum (`hopeful`) reach the search: pairs and triples
    are looked up and more items searched in `steps` steps, in line_id order. A customer with many lines has them dealt into blocks over the tasks, each with all
    the customer's free invoices; where blocks take the same invoice the smallest line keeps it, and the others search again in a further round, until none is left. Status is SPLIT,
    or EXHAUSTED without invoices where the steps ran out before the search was over.
    """
    path = workspace(lines.sparkSession)
    pairs = pair_splits(lines, invoices).select("line_id", F.array("first_id", "second_id").alias("invoice_ids"))

    def kept(found: DataFrame) -> DataFrame:
        """Those whose invoices no smaller line wants too."""
        wants = found.select("line_id", F.explode("invoice_ids").alias("invoice_id"))
        first = wants.groupBy("invoice_id").agg(F.min("line_id").alias("smallest"))
        lost = wants.join(first, "invoice_id").where("smallest < line_id").select("line_id").distinct()
        return found.join(lost, "line_id", "left_anti")

    done = stored(kept(pairs).withColumn("status", F.lit("SPLIT")), f"{path}/pairs")
    rest = residual(lines.where("amount > 0").select("line_id", "customer", "amount"), done, "line_id")
    free, taken, turn = invoices.where("amount > 0").select("invoice_id", "customer", "amount"), done, 0
    while True:
        free = stored(residual(free, taken.where("status = 'SPLIT'").select(F.explode("invoice_ids").alias("invoice_id")), "invoice_id"), f"{path}/free-{turn}")
        rest = stored(hopeful(rest, free), f"{path}/rest-{turn}")
        found = stored(searched(rest, free, most, steps), f"{path}/found-{turn}")
        taken = stored(kept(found.where("status = 'SPLIT'")).unionByName(found.where("status <> 'SPLIT'")), f"{path}/taken-{turn}")
        done, rest = done.unionByName(taken), found.select("line_id").join(taken, "line_id", "left_anti").join(rest, "line_id")
        if not rest.limit(1).count():
            return done
        turn += 1


def composites(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """Tier 3: lines that equal several invoices of their customer, then invoices left that equal several lines left.

    Rows (line_id, invoice_id), one for each part. Where a search ran out of steps the other side is null.
    """
    one = splits(lines, invoices).select("line_id", F.explode_outer("invoice_ids").alias("invoice_id"))
    one = stored(one, f"{workspace(lines.sparkSession)}/composites")
    taken = one.where("invoice_id IS NOT NULL")
    free_lines, free = residual(lines, taken.distinct(), "line_id"), residual(invoices, taken, "invoice_id")
    as_lines = free.select(F.col("invoice_id").alias("line_id"), "customer", "amount")
    as_invoices = free_lines.select(F.col("line_id").alias("invoice_id"), "customer", "amount")
    many = splits(as_lines, as_invoices).select(F.explode_outer("invoice_ids").alias("line_id"), F.col("line_id").alias("invoice_id"))
    return one.unionByName(many)


def scored_edges(lines: DataFrame, invoices: DataFrame, most: int = BUCKET, seconds: int = 3 * DAY, floor: float = 0.85) -> DataFrame:
    """Tier 2 with scores: (line_id, invoice_id, fee, lag, score) of the edges in the band whose party is alike (`floor`) and whose score reaches it.

    Half the score is the amount (1 if equal, 0.95 with a fee), two fifths the party, a tenth the date, which loses a tenth
    over the band. Names are compared once for each distinct pair. Edges are met once, with their names, and stored, as both the pairs and the scores read them.
    """
    met = stored(band_edges(lines, invoices, most, seconds, parties=True), f"{workspace(lines.sparkSession)}/band")
    alike = met.select("paid_by", "billed").distinct().withColumn("likeness", party_similarity(F.col("paid_by"), F.col("billed"))).where(F.col("likeness") >= floor)
    score = 0.5 * F.when(F.col("fee") == 0, 1.0).otherwise(0.95) + 0.4 * F.col("likeness") + 0.1 * (1 - F.col("lag") / seconds * 0.1)
    return met.join(alike, ["paid_by", "billed"]).withColumn("score", score).where(F.col("score") >= floor).select("line_id", "invoice_id", "fee", "lag", "score")


def scored_band(lines: DataFrame, invoices: DataFrame, most: int = BUCKET, seconds: int = 3 * DAY, floor: float = 0.85) -> DataFrame:
    """The best edge of each line by score; ties go to the smaller invoice."""
    scored = scored_edges(lines, invoices, most, seconds, floor)
    best = scored.groupBy("line_id").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "invoice_id", "score")).alias("b"))
    return best.select("line_id", "b.invoice_id", "b.score")


def stepped_edges(lines: DataFrame, entries: DataFrame, most: int = BUCKET, seconds: int = 3 * DAY, floor: float = 0.85) -> DataFrame:
    """(line_id, entry_id, fee, lag, score) by the simpler score: lines (line_id, direction, party, narration, amount, ts) and entries (entry_id, direction, partner, amount, ts).

    Amounts are equal or 1100 to `most` apart either way, whoever the customer; the party is the better of the line's own and of its narration without
    phrases, without a floor of its own, and the date counts 1, 0.95 or 0.88 up to one, two or more days; a common calendar day is near enough. Names are compared where an edge is found,
    and edges are not shuffled: their number may grow with the square of the tables, and only lines and entries lie on disk.
    """
    # lines look into the spans of amount that they reach, and entries stand in those of time; a common calendar day is less than two days long, as days before 1970 are cut towards it.
    # Spans are four times as wide as what is reached on either side, so that a row stands in one and a half of them on average
    width = max(seconds, 2 * DAY)

    def span(x: str, reach: int) -> Column:
        return F.expr(f"({x} - pmod({x}, {4 * reach})) DIV {4 * reach}")

    def spans(x: str, reach: int) -> Column:
        return F.explode(F.sequence(span(f"({x} - {reach})", reach), span(f"({x} + {reach})", reach)))

    said = without_boilerplate(F.coalesce("narration", F.lit("")))
    named = lines.select("line_id", "direction", "amount", "ts", plain_form(F.coalesce("party", F.lit(""))).alias("own"), plain_form(said).alias("said"))
    left = named.withColumn("bucket", spans("amount", most)).withColumn("span", span("ts", width))
    billed = entries.select("entry_id", "direction", plain_form(F.col("partner")).alias("billed"), F.col("amount").alias("e_amount"), F.col("ts").alias("e_ts"))
    right = billed.withColumn("bucket", span("e_amount", most)).withColumn("span", spans("e_ts", width))
    fee, lag = F.abs(F.col("e_amount") - F.col("amount")), F.abs(F.col("ts") - F.col("e_ts"))
    near = (lag <= seconds) | (F.expr(f"ts DIV {DAY}") == F.expr(f"e_ts DIV {DAY}"))
    met = left.join(right, ["direction", "bucket", "span"]).where(((fee == 0) | fee.between(1_100, most)) & near).select("line_id", "entry_id", "own", "said", "billed", fee.alias("fee"), lag.alias("lag"))
    alike = F.coalesce(F.greatest(plain_similarity(F.col("billed"), F.col("own")), plain_similarity(F.col("billed"), F.col("said"))), F.lit(0.0))
    day = F.when(F.col("lag") <= DAY, 1.0).when(F.col("lag") <= 2 * DAY, 0.95).otherwise(0.88)
    score = 0.5 * F.when(F.col("fee") == 0, 1.0).otherwise(0.92) + 0.4 * alike + 0.1 * day
    return met.withColumn("score", score).where(F.col("score") >= floor).select("line_id", "entry_id", "fee", "lag", "score")


def three_tiers(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """(line_id, invoice_id, tier): lines (with narration and direction) matched one to one by a reference of their own or cited in the narration, then by the scored band, best score first, and the
    rest by sums, a row for each part."""
    entries = invoices.select(F.col("invoice_id").alias("entry_id"), F.col("doc_ref").alias("doc_no"), F.lit("CREDIT").alias("direction"), "amount", "ts")
    one = assign(cited_edges(lines, entries).withColumnRenamed("entry_id", "invoice_id"), [])
    left, free = residual(lines, one, "line_id"), residual(invoices, one, "invoice_id")
    ranked = scored_edges(left, free).withColumn("far", -F.round("score", 9))
    two = assign(ranked.select("line_id", "invoice_id", "far", "lag"), ["far", "lag"])
    three = composites(residual(left, two, "line_id"), residual(free, two, "invoice_id"))
    return one.withColumn("tier", F.lit(1)).union(two.withColumn("tier", F.lit(2))).union(three.withColumn("tier", F.lit(3)))


def cited(lines: DataFrame) -> DataFrame:
    """lines with `keys`: the normal forms of their own reference and of all references in their narration."""
    own = F.when(F.coalesce("ref", F.lit("")) != "", F.array(doc_ref(F.col("ref")))).otherwise(F.array().cast("array<string>"))
    return lines.withColumn("keys", F.array_distinct(F.concat(own, F.transform(narration_refs(F.coalesce("narration", F.lit(""))), lambda r: doc_ref(r)))))


def yearless(key: Column) -> Column:
    """A normal reference without a year after its prefix and zeros behind that: HD20260088 is HD88."""
    return F.regexp_replace(key, r"^([A-Z]+)20\d\d0*(\d+)$", "$1$2")


def cited_edges(lines: DataFrame, entries: DataFrame, seconds: int = DAY, without_year: bool = False) -> DataFrame:
    """(line_id, entry_id): equal amount and direction, a reference of the line's or of its narration's, and times at most `seconds` apart.

    Lines have (line_id, ref, narration, direction, amount, ts), entries (entry_id, doc_no, direction, amount, ts). With `without_year`
    references also agree without their year, and a common calendar day is near enough.
    """
    forms = (lambda k: F.array(k, yearless(k))) if without_year else (lambda k: F.array(k))
    left = cited(lines).select("line_id", "direction", "amount", "ts", F.explode(F.array_distinct(F.flatten(F.transform("keys", forms)))).alias("key"))
    right = entries.select("entry_id", "direction", "amount", F.col("ts").alias("e_ts"), F.explode(F.array_distinct(forms(doc_ref(F.col("doc_no"))))).alias("key")).where("key <> ''")
    near = F.abs(F.col("ts") - F.col("e_ts")) <= seconds
    if without_year:
        near = near | (F.expr(f"ts DIV {DAY}") == F.expr(f"e_ts DIV {DAY}"))
    return left.join(right, ["amount", "direction", "key"]).where(near).select("line_id", "entry_id").distinct()


def remark_links(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(line_id, entry_id, score): the entry that a narration most likely speaks of: 0.85 for its document number, 0.40 for the partner's whole name or
    0.25 for two of its words; at most 0.99 and at least 0.50, ties to the smaller entry.

    As the partner alone gives less than 0.50, only entries whose document number is cited are candidates.
    """
    left = cited(lines).select("line_id", F.explode("keys").alias("key"), F.lower(unmarked_upper(F.col("narration"))).alias("said"))
    right = entries.select("entry_id", doc_ref(F.col("doc_no")).alias("key"), F.lower(unmarked_upper(F.col("partner"))).alias("who")).where("key <> ''")
    met = left.join(right, "key").select("line_id", "entry_id", "said", "who").distinct()
    telling = F.filter(F.split("who", r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin("cong", "ty"))
    two = F.size(F.filter(telling, lambda w: F.contains(F.col("said"), w))) >= 2
    score = F.least(F.lit(0.85) + F.when((F.col("who") != "") & F.contains("said", F.col("who")), 0.40).when(two, 0.25).otherwise(0.0), F.lit(0.99))
    return met.withColumn("score", score).groupBy("line_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "entry_id")).alias("b")).select("line_id", "b.entry_id", (-F.col("b.s")).alias("score"))


def settled(rows: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """rows with status MATCHED where a match names their key, else what they had: a join instead of an update in place."""
    taken = matches.select(key).distinct().withColumn("__taken", F.lit(True))
    return rows.join(taken, key, "left").withColumn("status", F.when(F.col("__taken"), "MATCHED").otherwise(F.col("status"))).drop("__taken")
