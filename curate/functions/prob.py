"""Row-local probability functions over ``ARRAY<DOUBLE>`` columns with a known class count.

The class count is small and known while the plan is built, so each function is unrolled into
plain arithmetic. That stays inside generated code, which higher-order functions do not.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from curate.constants import PRIOR_FLOOR


def softmax(logits: Column, n: int) -> Column:
    """Softmax, shifted by the row maximum."""
    top = F.array_max(logits)
    parts = [F.exp(logits[i] - top) for i in range(n)]
    total = reduce(add, parts)
    return F.array(*[p / total for p in parts])


def log_sum_exp(logits: Column, n: int) -> Column:
    top = F.array_max(logits)
    return top + F.log(reduce(add, [F.exp(logits[i] - top) for i in range(n)]))


def arg_max(values: Column) -> Column:
    """Index of the largest value; ties go to the lowest index."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def one_hot(label: Column, n: int) -> Column:
    return F.array(*[F.when(label == i, F.lit(1.0)).otherwise(F.lit(0.0)) for i in range(n)])


def by_class(values: Column, n: int, name: str = "prob") -> Column:
    """Generator of a row ``(cls, {name})`` for each of the ``n`` classes of an array.

    A generator over a plain column makes the optimizer infer a filter on its size, which is pushed down to
    the scan with the column's whole expression copied in, seeded draws and all. Over a list of structs of
    its elements no filter is inferred.
    """
    return F.inline(F.array(*[F.struct(F.lit(c).alias("cls"), values[c].alias(name)) for c in range(n)]))


def adjust_priors(
    probs: Column,
    n: int,
    target: Sequence[float] | Column,
    train: Sequence[float] | Column | None = None,
) -> Column:
    """Scale by target / train prior and renormalise the row.

    Priors are numbers or an ``ARRAY<DOUBLE>`` column (for instance a scalar subquery over
    :func:`curate.operators.balance.effective_priors`). Without train priors they are uniform.
    """
    train = [1.0 / n] * n if train is None else train

    def at(values, i):
        return values[i] if isinstance(values, Column) else F.lit(float(values[i]))

    scaled = [
        probs[i] * (at(target, i) / F.greatest(at(train, i), F.lit(PRIOR_FLOOR))) for i in range(n)
    ]
    total = reduce(add, scaled)
    return F.array(*[F.try_divide(s, total) for s in scaled])
