"""Tail probabilities in columns: the complementary error function and the exact binomial tail."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = 2.0
"""Below, a series; above, a continued fraction."""
TERMS = 48
LEVELS = 96


def _series(x: Column) -> Column:
    """erfc for 0 <= x < SPLIT: one minus the series of erf with positive terms alone, which cancels nothing.

    erf(x) = 2/sqrt(pi) * exp(-x*x) * sum of 2^k x^(2k+1) / (1*3*...*(2k+1)).
    """
    first = F.struct(x.alias("term"), x.alias("total"))

    def add(so_far: Column, k: Column) -> Column:
        term = so_far["term"] * 2.0 * x * x / (2.0 * k + 1.0)
        return F.struct(term.alias("term"), (so_far["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, add, lambda s: s["total"])
    return 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-x * x) * total


def _fraction(x: Column) -> Column:
    """erfc for x >= SPLIT: exp(-x*x)/sqrt(pi) / (x + (1/2)/(x + 1/(x + (3/2)/(x + ...)))), from the inside out."""
    inner = F.aggregate(F.sequence(F.lit(LEVELS), F.lit(1), F.lit(-1)), x, lambda below, k: x + k / 2.0 / below)
    return F.exp(-x * x) / math.sqrt(math.pi) / inner


def erfc(x: Column) -> Column:
    """The complementary error function to some 1e-15 of its value 1 at 0, and of its own size above SPLIT; NULL stays."""
    size = F.abs(x.cast("double"))
    upper = F.when(size < SPLIT, _series(size)).otherwise(_fraction(size))
    return F.when(x < 0, 2.0 - upper).otherwise(upper)


def log_factorial(n: Column) -> Column:
    """log(n!) by Stirling's series, with a table of logarithms below 16."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    m = n.cast("double") + 1.0
    series = (m - 0.5) * F.log(m) - m + 0.5 * math.log(2 * math.pi) + 1 / (12 * m) - 1 / (360 * m**3) + 1 / (1260 * m**5)
    return F.when(n < 16, F.get(table, n.cast("int"))).otherwise(series)


def binomial_two_sided(a: Column, b: Column) -> Column:
    """Exact two-sided p-value of a wins against b under even odds: twice the lower tail, 1 at most.

    The tail is added up from its largest term down, each from the one before, for up to ``min(a, b)`` terms.
    Terms below 2^-60 of the sum change nothing and are not made, so there are some sqrt(n) * 10 of them at most.
    """
    n, k = (a + b).cast("bigint"), F.least(a, b).cast("bigint")
    largest = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2.0))
    count = F.least(k, F.ceil(F.sqrt(n.cast("double")) * 10.0).cast("bigint") + 20)
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(so_far: Column, i: Column) -> Column:
        term = so_far["term"] * (k - i + 1) / (n - k + i)
        return F.struct(term.alias("term"), (so_far["total"] + term).alias("total"))

    steps = F.when(count > 0, F.sequence(F.lit(1).cast("bigint"), count)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, first, add, lambda s: s["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * largest * total))
