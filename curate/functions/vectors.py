"""Dense vector columns (``ARRAY<FLOAT>`` or ``ARRAY<DOUBLE>``), computed in DOUBLE.

An outer value used inside a lambda is evaluated for every element, because the optimizer inlines
it there. Such values are passed as a repeated array instead, which is evaluated once per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curate.constants import NORM_FLOOR


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    """L2 norm, floored so that a zero vector can be divided by it."""
    wide = as_double(vec)
    return F.greatest(F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x)), F.lit(NORM_FLOOR))


def unit(vec: Column) -> Column:
    """L2-normalised vector; a zero vector stays zero."""
    return F.zip_with(as_double(vec), F.array_repeat(norm(vec), F.size(vec)), lambda x, n: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(as_double(a), as_double(b)) / (norm(a) * norm(b))
