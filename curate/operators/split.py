"""Stratified train / validation / test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.constants import SEED, TRAIN_PERCENT, VAL_PERCENT
from curate.functions.hashing import draw_key
from curate.operators.running import LEAF_ROWS, rank_by_key


def stratified_split(
    df: DataFrame,
    train_percent: int = TRAIN_PERCENT,
    val_percent: int = VAL_PERCENT,
    seed: int = SEED,
    row_id: str = "row_id",
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Add ``split``: train, val or test, with the shares kept per class to within one row.

    The order inside a class is a seeded hash of the row key, so the same key is always in the
    same split. Ranks are taken over keys alone, to find the last key of each split; rows are then
    compared with these where they are, so texts are never shuffled.
    """
    if not 0 < train_percent + val_percent < 100:
        raise ValueError("train and validation percent must leave room for a test split")
    key = draw_key(seed, F.lit(":"), F.col(row_id))
    ranked = rank_by_key(
        df.where("label IS NOT NULL").select("label", row_id, key.alias("__key")), ["label"], "__key", [row_id], "__rank", leaf_rows
    )
    place, size = F.col("__rank") * 100, F.col("__rank_size")
    position = F.struct("__key", row_id)

    def last_within(percent: int):
        return F.max(F.when(place <= size * percent, position))

    # One row per class.
    cuts = ranked.groupBy("label").agg(
        last_within(train_percent).alias("__train"), last_within(train_percent + val_percent).alias("__val")
    )
    mine = F.struct(key.alias("__key"), F.col(row_id))
    split = (
        F.when(F.col("label").isNull(), F.raise_error(F.lit("label must not be NULL")))
        .when(mine <= F.col("__train"), F.lit("train"))
        .when(mine <= F.col("__val"), F.lit("val"))
        .otherwise(F.lit("test"))
    )
    return df.join(F.broadcast(cuts), "label", "left").withColumn("split", split).select(*df.columns, "split")
