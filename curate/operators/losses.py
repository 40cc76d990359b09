"""Cross-entropy losses over a table of logits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.constants import BATCH_ROWS
from curate.functions.prob import log_sum_exp
from curate.operators.balance import is_synthetic

EPSILON = 1e-8


def _terms(df: DataFrame, weights: Sequence[float] | Column, synthetic_weight: float, label: str) -> DataFrame:
    n = 3 if isinstance(weights, Column) else len(weights)
    listed = weights if isinstance(weights, Column) else F.array(*[F.lit(float(w)) for w in weights])
    y = F.col(label)
    loss = log_sum_exp(F.col("logits"), n) - F.get("logits", y)
    sample = F.when(is_synthetic(df), F.lit(float(synthetic_weight))).otherwise(F.lit(1.0))
    return df.withColumns({"__w": F.get(listed, y) * sample, "__ce": loss})


def weighted_cross_entropy(
    df: DataFrame,
    by: Sequence[str],
    weights: Sequence[float] | Column,
    synthetic_weight: float = 1.0,
    label: str = "true_label",
) -> DataFrame:
    """Class- and sample-weighted mean of the cross entropy per group.

    A synthetic weight other than 1 adds a small constant to the denominator, as training does.
    """
    epsilon = 0.0 if synthetic_weight == 1.0 else EPSILON
    terms = _terms(df, weights, synthetic_weight, label)
    return terms.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("__w") * F.col("__ce")), F.sum("__w") + epsilon).alias("loss")
    )


def validation_loss(
    df: DataFrame,
    by: Sequence[str],
    weights: Sequence[float] | Column,
    position: str = "row_id",
    batch_rows: int = BATCH_ROWS,
    label: str = "true_label",
) -> DataFrame:
    """``batched_loss``, the mean of batch means, and ``loss`` over all rows.

    ``position`` numbers the rows of a group from 0.
    """
    terms = _terms(df.drop("is_synthetic"), weights, 1.0, label).withColumn(
        "__batch", F.floor(F.col(position) / batch_rows)
    )
    batches = terms.groupBy(*by, "__batch").agg(
        F.sum(F.col("__w") * F.col("__ce")).alias("__a"), F.sum("__w").alias("__b")
    )
    return batches.groupBy(*by).agg(
        F.avg(F.try_divide("__a", "__b")).alias("batched_loss"),
        F.try_divide(F.sum("__a"), F.sum("__b")).alias("loss"),
    )
