"""Contiguous shards of like byte size from global prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.llm.common import cuts, pieces_for, range_of, text_of


def byte_size(text: str | Column) -> Column:
    """UTF-8 bytes of a text plus 1 for its separator; 1 for NULL."""
    return F.octet_length(text_of(text)).cast("bigint") + 1


def shard_by_bytes(
    docs: DataFrame, size: str, shards: int, order: str = "doc_id", ties: tuple[str, ...] = (), pieces: int | None = None
) -> DataFrame:
    """Add ``shard`` INT and ``slot`` BIGINT, the gapless place in the shard.

    Rows are put in the order of an integer column, which is cut into ranges; the totals of the
    ranges give each range its start, and a running sum inside a range gives each row the bytes
    before it. A row goes to the shard in whose equal part of all bytes its middle lies, so shards
    are contiguous and miss the mean by less than one row. NULL keys come first; rows with equal
    keys follow ``ties``, and rows equal in those too can stand for each other. An empty table
    gives no rows. Pass slim rows: everything given here is shuffled once, so leave texts out.
    """
    if size not in docs.columns or order not in docs.columns:
        raise ValueError(f"no column {size} or {order}")
    pieces = pieces or pieces_for(docs)
    rows = docs.withColumn("__piece", range_of(order, cuts(docs, order, pieces))).repartition("__piece")
    # A row per range, so the window below has at most ``pieces`` rows, and the broadcast too.
    earlier = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__piece").agg(F.sum(size).alias("__bytes"), F.count("*").alias("__rows"))
    starts = totals.select(
        F.col("__piece"),
        F.coalesce(F.sum("__bytes").over(earlier), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rows_before"),
        F.sum("__bytes").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"),
    )
    inside = Window.partitionBy("__piece").orderBy(F.col(order).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in ties], size)
    placed = rows.join(F.broadcast(starts), "__piece").withColumns(
        {
            "__end": F.col("__bytes_before") + F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "__place": F.col("__rows_before") + F.row_number().over(inside) - 1,
        }
    )
    shard = F.least(F.lit(shards - 1), F.expr(f"((2 * __end - `{size}`) * {int(shards)}) div (2 * __all)")).cast("int")
    placed = placed.withColumn("shard", shard)
    firsts = placed.groupBy(F.col("shard").alias("__shard")).agg(F.min("__place").alias("__first"))
    return placed.join(F.broadcast(firsts), F.col("shard") == F.col("__shard")).select(
        *docs.columns, "shard", (F.col("__place") - F.col("__first")).alias("slot")
    )
