"""A keyed bijection of 0 … n-1 in columns: draws without replacement that need no list and no sort.

A number is written as a pair (high, low) of a grid of a × b cells, a and b next to the root of n. Rounds of a
Feistel network add a keyed hash of one half to the other, modulo its size, which can be undone and so permutes the
cells. Of the cells fewer than a + b are no numbers below n; a number that lands on one is sent through the network
again until it does not (cycle walking), which keeps the map a bijection of 0 … n-1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curate.functions.hashing import draw_int

ROUNDS = 4
WALK = 48
"""Steps of a walk. Up to a few thousand numbers no walk can be longer; beyond, one in 10**70 would be, and fails."""


def grid(n: Column) -> tuple[Column, Column]:
    """(a, b) with a * b >= n, both near the root of n."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    return a, F.floor((n + a - 1) / a).cast("bigint")


def _network(x: Column, a: Column, b: Column, key: tuple[Column | str | int, ...]) -> Column:
    """One pass of a cell x = high * b + low through the network."""
    cell = F.struct(F.floor(x / b).cast("bigint").alias("high"), (x % b).cast("bigint").alias("low"))

    def turn(c: Column, i: Column) -> Column:
        other = F.when(i % 2 == 0, c["low"]).otherwise(c["high"])
        added = draw_int(*key, F.lit(":"), i.cast("string"), F.lit(":"), other.cast("string"))
        high = F.when(i % 2 == 0, (c["high"] + added) % a).otherwise(c["high"])
        low = F.when(i % 2 == 0, c["low"]).otherwise((c["low"] + added) % b)
        return F.struct(high.cast("bigint").alias("high"), low.cast("bigint").alias("low"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), cell, turn, lambda c: c["high"] * b + c["low"])


def permuted(x: Column, n: Column, *key: Column | str | int) -> Column:
    """The image of ``x`` in 0 … n-1 under the permutation that ``key`` names, for 0 <= x < n.

    Different ``x`` have different images. ``n`` = 1 maps 0 to itself.
    """
    a, b = grid(n)

    def step(now: Column, _: Column) -> Column:
        return F.when(now < n, now).otherwise(_network(now, a, b, key))

    def checked(end: Column) -> Column:
        return F.when(end < n, end).otherwise(F.raise_error(F.lit("walk too long")).cast("bigint"))

    def walked(first: Column) -> Column:
        # The further steps are for the few rows that need them.
        return F.when(first < n, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, step, checked))

    return F.element_at(F.transform(F.array(_network(x.cast("bigint"), a, b, key)), walked), 1)
