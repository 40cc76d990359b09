"""Class balance: distribution, weights, rebalance targets, effective priors, audit.

The class list is small and fixed, so every function is one aggregation to a single row of
counts, unrolled per class, and a row-local expansion.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.constants import LABEL_NAMES, MINORITY_LABELS
from curate.functions.text import text_key


def label_name(label: Column, names: Mapping[int, str] = LABEL_NAMES) -> Column:
    """Name of a label; NULL for an unknown one."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, label.cast("int"))


def is_synthetic(df: DataFrame) -> Column:
    """The flag column, or false for every row where there is none or it is NULL."""
    if "is_synthetic" not in df.columns:
        return F.lit(False)
    return F.coalesce(F.col("is_synthetic").cast("boolean"), F.lit(False))


def class_slice(df: DataFrame, label: int) -> DataFrame:
    return df.where(F.col("label") == label)


def class_distribution(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Rows and share per class, the group total and the largest-to-smallest ratio."""
    by = list(by)
    group = Window.partitionBy(*by)
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.select(
        *by,
        label,
        "n",
        (F.col("n") / F.sum("n").over(group)).alias("share"),
        F.sum("n").over(group).alias("total"),
        (F.max("n").over(group) / F.min("n").over(group)).alias("imbalance"),
    )


def _counts(df: DataFrame, n_classes: int, weight: Column | None = None) -> DataFrame:
    """One row with ``counts``, an array with one (weighted) count per class."""
    weight = F.lit(1).cast("bigint") if weight is None else weight
    zero = F.lit(0).cast("bigint")
    per_class = [
        F.coalesce(F.sum(F.when(F.col("label") == c, weight)), zero) for c in range(n_classes)
    ]
    return df.agg(F.array(*per_class).alias("counts"))


def _at(c: int) -> Column:
    return F.col("counts")[c]


def class_weights(df: DataFrame, n_classes: int = 3) -> DataFrame:
    """``N / (C · n)`` per class; NULL for a class without rows."""
    total = reduce(add, [_at(c) for c in range(n_classes)])
    rows = [
        F.struct(
            F.lit(c).alias("label"),
            _at(c).alias("n"),
            F.try_divide(total.cast("double"), _at(c) * n_classes).alias("weight"),
        )
        for c in range(n_classes)
    ]
    return _counts(df, n_classes).select(F.inline(F.array(*rows)))


def rebalance_targets(
    df: DataFrame,
    balance: str | int = "majority",
    labels: Sequence[int] = MINORITY_LABELS,
    n_classes: int = 3,
) -> DataFrame:
    """``(class_pos, label, n_real, target)``: rows to add per class; classes at target are left out.

    ``'majority'`` fills up to the largest class, ``'mean'`` up to the truncated mean of the
    classes present; a number is the count to add itself.
    """
    counts = [_at(c) for c in range(n_classes)]
    present = reduce(add, [(c > 0).cast("int") for c in counts])
    if isinstance(balance, bool) or not (isinstance(balance, int) or balance in ("majority", "mean")):
        raise ValueError(f"balance must be 'majority', 'mean' or an int, got {balance!r}")
    if isinstance(balance, int):
        wanted = lambda n: F.lit(balance).cast("bigint")
    elif balance == "majority":
        wanted = lambda n: F.array_max("counts") - n
    else:
        wanted = lambda n: F.floor(F.try_divide(reduce(add, counts), present)).cast("bigint") - n
    rows = [
        F.struct(
            F.lit(i).alias("class_pos"),
            F.lit(c).alias("label"),
            _at(c).alias("n_real"),
            F.greatest(F.lit(0).cast("bigint"), wanted(_at(c))).alias("target"),
        )
        for i, c in enumerate(labels)
    ]
    return _counts(df, n_classes).select(F.inline(F.array(*rows))).where("target > 0")


def effective_priors(df: DataFrame, synthetic_weight: float = 1.0, n_classes: int = 3) -> DataFrame:
    """One row with ``priors ARRAY<DOUBLE>``: class shares with synthetic rows weighted.

    Use ``effective_priors(...).scalar()`` as the train priors of a prior correction.
    """
    weight = F.when(is_synthetic(df), F.lit(float(synthetic_weight))).otherwise(F.lit(1.0))
    total = reduce(add, [_at(c) for c in range(n_classes)])
    shares = [F.try_divide(_at(c), total) for c in range(n_classes)]
    return _counts(df, n_classes, weight).select(F.array(*shares).alias("priors"))


def augmentation_audit(df: DataFrame, n_classes: int = 3) -> DataFrame:
    """Real and synthetic rows per class and the imbalance before and after."""
    flag = is_synthetic(df)
    label = F.col("label")
    one = df.agg(
        F.array(*[F.count_if((label == c) & ~flag) for c in range(n_classes)]).alias("real"),
        F.array(*[F.count_if((label == c) & flag) for c in range(n_classes)]).alias("made"),
    ).withColumn("both", F.zip_with("real", "made", lambda a, b: a + b))

    def ratio(counts: str) -> Column:
        some = F.filter(counts, lambda n: n > 0)
        return F.array_max(some) / F.greatest(F.array_min(some), F.lit(1))

    rows = [
        F.struct(
            F.lit(c).alias("label"),
            F.col("real")[c].alias("n_real"),
            F.col("made")[c].alias("n_synthetic"),
            F.col("both")[c].alias("n"),
        )
        for c in range(n_classes)
    ]
    return one.select(
        F.inline(F.array(*rows)), ratio("real").alias("imbalance_before"), ratio("both").alias("imbalance_after")
    )


def repeated_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(label, n, n_distinct, n_repeated)``: rows whose text, up to case and outer white space, occurred before.

    The last patch of a rebalanced table may repeat texts. Texts are counted by digests of 256 bits, first
    inside the tasks, so neither a class nor a text is one task.
    """
    digest = F.unhex(F.sha2(text_key(F.col(text), trim=True), 256)).alias("__digest")
    counted = df.groupBy("label", digest).agg(F.count("*").alias("__n"))
    n = F.sum("__n")
    return counted.groupBy("label").agg(n.alias("n"), F.count("*").alias("n_distinct"), (n - F.count("*")).alias("n_repeated"))
