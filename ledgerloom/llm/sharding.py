"""Operator 4: a reproducible shuffle of all rows into shards, by a Feistel permutation of global row numbers.

Row number r becomes p = permutation(r); the shard is p mod n and the slot p div n, so shards differ by at
most one row and slots have no gaps. Shard and slot of any row number can be computed without the others. The
permutation works on a * b >= N with a, b near the root of N, and walks on while it is outside N.

Defined cases: a null key sorts first; a null text counts as empty; repeated rows are rows of their own, and equal
ones are told apart only by their place among each other; an empty table gives no rows; extra columns are kept, but
for columns named shard or slot, which give way to the new ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_name, numbered

ROUNDS = 6
#: Outside points are at most sqrt(N) of N, so a walk of up to 64 steps ends for all N below 4000 surely, and else but for odds below N**-31.
WALK = 64


def feistel(number: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the permutation of [0, a*b): halves in Z_a and Z_b, added to in turn."""
    whole = F.struct(F.call_function("div", number, F.lit(b).cast("long")).alias("l"), (number % b).alias("r"))
    turns = F.array(*[F.lit(t) for t in range(ROUNDS)])

    def step(acc: Column, turn: Column) -> Column:
        key = (turn * 104729 + (seed * 7919) % 2147483647) % 2147483647

        def scramble(half: Column) -> Column:
            x = ((half % 2147483647) * 48271 + key) % 2147483647
            x = (x.bitwiseXOR(F.shiftright(x, 15)) * 40503) % 2147483647
            return x.bitwiseXOR(F.shiftright(x, 13))

        even = turn % 2 == 0
        return F.struct(
            F.when(even, (acc["l"] + scramble(acc["r"])) % a).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise((acc["r"] + scramble(acc["l"])) % b).alias("r"),
        )

    return F.aggregate(turns, whole, step, lambda acc: acc["l"] * b + acc["r"])


def permuted(number: Column, n: int, seed: int) -> Column:
    """The place of a row number in [0, n) after the shuffle; cycle walking keeps it inside."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(number, a, b, seed), lambda p, _: F.when(p < n, p).otherwise(feistel(p, a, b, seed)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def shard(rows: DataFrame, n_shards: int, key: str, ties: list[Column], seed: int = 0) -> DataFrame:
    """rows with columns shard (int) and slot (long)."""
    n = rows.count()
    number, spot = free_name(rows, "number"), free_name(rows, "spot")
    spots = numbered(rows, key, ties, number).withColumn(spot, permuted(F.col(number), n, seed))
    held = [F.col(c) for c in rows.columns if c.lower() not in ("shard", "slot")]
    return spots.select(*held, (F.col(spot) % n_shards).cast("int").alias("shard"), F.expr(f"`{spot}` DIV {n_shards}").alias("slot"))
