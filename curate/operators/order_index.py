"""Exact ranks in groups of any size, from an order index over a whole tuple of columns.

Rows are dealt to leaves by sampled quantiles of (group, order): a range partitioning over the composite key, so
one round that holds every row, or one number far from all others, is cut like any other stretch. Inside a leaf
rows are sorted and numbered by their place; a table of one row for each leaf and group, the index, gives the place
where a group starts in a leaf and how many of its rows lie in earlier leaves. A rank is a subtraction and a sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.session import stored

LEAF_ROWS = 200_000
MAX_LEAVES = 10_000
"""The quantile sample that Spark takes has 100 rows for each leaf."""
SLACK = 2
"""Leaves are planned at half of ``leaf_rows``, as cuts from a sample are not even."""
PLACE_BITS = 33
"""``monotonically_increasing_id`` counts the rows of a partition in its lower 33 bits."""


def leaves_for(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    return max(1, min(MAX_LEAVES, -(-rows * SLACK // leaf_rows)))


def ordered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The rows sorted into leaves, stored, with ``__leaf`` and ``__at``, the place in the leaf.

    NULL groups are a group, NULLs of the order come first. Rows that the whole order does not tell apart share a
    leaf, so give it a column that does. Pass slim rows: they are shuffled and written once.
    """
    keys = [F.col(g).asc_nulls_first() for g in group] + [o.asc_nulls_first() if isinstance(o, Column) else F.col(o).asc_nulls_first() for o in order]
    cut = df.repartitionByRange(leaves_for(df.count(), leaf_rows), *keys).sortWithinPartitions(*keys)
    numbered = cut.withColumn("__at", F.monotonically_increasing_id())
    placed = numbered.select(
        *df.columns,
        F.shiftright("__at", PLACE_BITS).cast("int").alias("__leaf"),
        F.col("__at").bitwiseAND((1 << PLACE_BITS) - 1).alias("__at"),
    )
    return stored(placed, "ordered")


def index_of(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row for each group and leaf: where the group starts in it, its rows in earlier leaves and in all.

    A group has a row for each leaf it reaches, so the windows run over the index and not over the rows.
    """
    counted = rows.groupBy(*group, "__leaf").agg(F.min("__at").alias("__start"), F.count("*").alias("__n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__leaf").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(
        *group, "__leaf", "__start", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__size")
    )


def rank_by_order(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str = "rank", leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Add ``{out}``, the place from 1 inside the group in the order, and ``{out}_size``, the group's rows.

    Both are BIGINT. Every leaf is sorted by a task of its own, whatever the sizes of the groups are.
    """
    rows = ordered(df, group, order, leaf_rows)
    index = index_of(rows, group).withColumnsRenamed({g: f"__g_{g}" for g in group} | {"__leaf": "__g_leaf"})
    same = F.col("__leaf") == F.col("__g_leaf")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    rank = (F.col("__before") + F.col("__at") - F.col("__start") + 1).cast("bigint")
    return rows.join(index, same).select(*df.columns, rank.alias(out), F.col("__size").cast("bigint").alias(f"{out}_size"))
