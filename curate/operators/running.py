"""Running totals and ranks that never put a whole group into one task.

A plain ``sum() OVER (PARTITION BY group ORDER BY x)`` sorts each group in one task, so a class
that holds a third of the table is one straggler. Here the order is first mapped to a *spread* in
[0, 1) that grows with it, and the spread is cut into buckets. Bucket totals give each bucket its
offset, and rows are sorted only inside their bucket. A bucket with too many rows is cut once
more, so a concentration of values does not make a straggler either. The result is exact and does
not depend on partitioning. A NULL group or order fails the job rather than lose the row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 12
LEAF_ROWS = 200_000


def _running(
    df: DataFrame,
    group: Sequence[str],
    spread: Column,
    order: Sequence[Column],
    values: Mapping[str, Column],
    fold: Callable[[Column], Column],
    combine: Callable[..., Column],
    end: int,
    descending: bool,
    leaf_rows: int,
    few_groups: bool,
) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with the pieces of each running value, and the expressions that combine them."""
    group, names = list(group), list(values)
    node, leaf = [*group, "__d1"], [*group, "__d1", "__d2"]

    def folded(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(*[fold(F.col(f"__v_{n}")).alias(f"__v_{n}") for n in names], F.count("*").alias("__n"))

    def starts(keys: Sequence[str], tag: str) -> list[Column]:
        place = F.desc(keys[-1]) if descending else F.asc(keys[-1])
        before = Window.partitionBy(*keys[:-1]).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return [fold(F.col(f"__v_{n}")).over(before).alias(f"__{tag}_{n}") for n in names]

    scaled = spread * float(BUCKETS)
    high = F.least(F.floor(scaled), F.lit(BUCKETS - 1))
    low = F.greatest(F.least(F.floor((scaled - F.col("__d1")) * float(BUCKETS)), F.lit(BUCKETS - 1)), F.lit(0))
    placed = reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group], spread.isNotNull())
    checked = F.when(placed, high).otherwise(F.raise_error(F.lit("group and order must not be NULL")).cast("bigint"))
    rows = df.withColumns({f"__v_{n}": c for n, c in values.items()} | {"__d1": checked})

    nodes = folded(rows, node).select(
        *node,
        *starts(node, "node"),
        *[fold(F.col(f"__v_{n}")).over(Window.partitionBy(*group)).alias(f"{n}_total") for n in names],
        (F.col("__n") > leaf_rows).alias("__crowded"),
    )
    # A group has at most BUCKETS nodes, whatever its number of rows: with few groups the table has
    # a fixed bound. With many groups the join is left to the optimizer, which knows the size.
    # An outer join, as an inner one would filter NULLs before they are noticed.
    rows = rows.join(F.broadcast(nodes) if few_groups else nodes, node, "left").withColumn(
        "__d2", F.when(F.col("__crowded"), low).otherwise(F.lit(0).cast("bigint"))
    )
    leaves = folded(rows.where("__crowded"), leaf).select(*leaf, *starts(leaf, "leaf"))

    inside = Window.partitionBy(*leaf).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = rows.withColumns({f"__in_{n}": fold(F.col(f"__v_{n}")).over(inside) for n in names})
    pieces = {n: combine(*[F.col(f"__{tag}_{n}") for tag in ("node", "leaf", "in")]) for n in names}
    return local.join(leaves, leaf, "left"), pieces


def running(
    df: DataFrame,
    group: Sequence[str],
    spread: Column,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    descending: bool = False,
    leaf_rows: int = LEAF_ROWS,
    few_groups: bool = True,
) -> DataFrame:
    """Add ``{name}_upto`` (inclusive running sum) and ``{name}_total`` (group sum) columns.

    ``spread`` must not decrease along ``order`` (not increase, if ``descending``); how evenly it
    spreads the rows decides the balance, never the result. ``few_groups`` says that the number of
    groups (classes, systems, clusters) does not grow with the data.
    """

    def add(*parts: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])

    rows, pieces = _running(
        df, group, spread, order, sums, F.sum, add, Window.currentRow, descending, leaf_rows, few_groups
    )
    upto = {f"{n}_upto": c for n, c in pieces.items()}
    return rows.withColumns(upto).select(*df.columns, *upto, *[f"{n}_total" for n in sums])


def running_max_before(
    df: DataFrame,
    group: Sequence[str],
    spread: Column,
    order: Sequence[Column],
    value: Column,
    out: str,
    leaf_rows: int = LEAF_ROWS,
    few_groups: bool = True,
) -> DataFrame:
    """Add the largest value of the rows before each row; NULL on the first."""
    rows, pieces = _running(
        df, group, spread, order, {out: value}, F.max, F.greatest, -1, False, leaf_rows, few_groups
    )
    return rows.withColumn(out, pieces[out]).select(*df.columns, out)


def rank_by_key(
    df: DataFrame, group: Sequence[str], key: str, tie: Sequence[str] = (), out: str = "rank",
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """1-based position inside the group in the order of a hex digest column, and the group size.

    Adds ``{out}`` and ``{out}_size``, both BIGINT.
    """
    spread = F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(1 << 48)
    return _ranked(df, group, spread, [F.col(key), *[F.col(t) for t in tie]], out, leaf_rows)


def rank_by_number(
    df: DataFrame, group: Sequence[str], number: str, tie: Sequence[str] = (), out: str = "rank",
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Like :func:`rank_by_key` for an order that starts with an integer column.

    The spread is the place of the number between the smallest and the largest one.
    """
    ends = df.agg(F.struct(F.min(number).cast("double").alias("lo"), F.max(number).cast("double").alias("hi"))).scalar()
    spread = (F.col(number).cast("double") - ends["lo"]) / (ends["hi"] - ends["lo"] + 1.0)
    return _ranked(df, group, spread, [F.col(number), *[F.col(t) for t in tie]], out, leaf_rows)


def _ranked(df, group, spread, order, out, leaf_rows):
    one = {out: F.lit(1).cast("bigint")}
    ranked = running(df, group, spread, order, one, leaf_rows=leaf_rows)
    return ranked.withColumnsRenamed({f"{out}_upto": out, f"{out}_total": f"{out}_size"})
