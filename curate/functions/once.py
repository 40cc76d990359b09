"""Columns that are evaluated exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters read instead of re-computing.

    A filter on a computed column is pushed below the projection with the expression copied into
    every place that names the column; for a chain of regular expressions that multiplies the
    work. A one-element generator keeps the value as it is.
    """
    kept = [F.col(c) for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))
