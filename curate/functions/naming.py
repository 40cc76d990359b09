"""Names and number formats of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def metric_cell(value: Column, missing: str = "—") -> Column:
    """Four decimals, or a marker for a missing value."""
    return F.when(value.isNull() | F.isnan(value), F.lit(missing)).otherwise(F.format_string("%.4f", value))


def heading(name: Column) -> Column:
    """``a_b-c2d`` as ``A B-C2D``: a capital after everything that is no letter."""
    runs = F.regexp_extract_all(F.replace(name, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def safe_name(name: Column) -> Column:
    """A system name usable as a file stem."""
    return F.replace(name, F.lit("/"), F.lit("_"))


def short_name(name: Column, replacements: Sequence[tuple[str, str]]) -> Column:
    """Apply the replacements in order."""
    for old, new in replacements:
        name = F.replace(name, F.lit(old), F.lit(new))
    return name


def stem_key(stem: Column) -> Column:
    """Registry key of a file stem: no metrics marker, no outer underscores, no trailing role."""
    bare = F.regexp_replace(F.replace(stem, F.lit("_metrics"), F.lit("")), "^_+|_+$", "")
    return F.regexp_replace(bare, "_(predictions|metrics|report)$", "")
