"""Combining several classifiers: alignment check, hard and soft voting, prior correction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.functions.once import with_once
from curate.functions.prob import adjust_priors, arg_max, one_hot


def with_adjusted_priors(
    preds: DataFrame,
    target: Sequence[float] | Column,
    train: Sequence[float] | Column | None = None,
    n_classes: int = 3,
) -> DataFrame:
    """Prior-corrected ``probs`` and the label they imply."""
    adjusted = preds.withColumn("probs", adjust_priors(F.col("probs"), n_classes, target, train))
    return adjusted.withColumn("pred_label", arg_max(F.col("probs")))


def misaligned_rows(preds: DataFrame, n_systems: int) -> DataFrame:
    """Rows on which systems disagree about the truth or which some system lacks."""
    per_row = preds.groupBy("row_id").agg(
        F.min("true_label").alias("lowest_truth"),
        F.max("true_label").alias("highest_truth"),
        F.count("*").alias("n_systems"),
    )
    return per_row.where((F.col("lowest_truth") != F.col("highest_truth")) | (F.col("n_systems") != n_systems))


def systems_of(preds: DataFrame) -> list[str]:
    """The systems that occur, by name: a registry, some dozens, whatever the number of rows."""
    return sorted(r[0] for r in preds.select("system").where("system IS NOT NULL").distinct().collect())


def ensemble(
    preds: DataFrame,
    n_classes: int = 3,
    target: Sequence[float] | Column | None = None,
    train: Sequence[float] | Column | None = None,
    hard_name: str = "hard_voting",
    soft_name: str = "soft_voting",
    min_systems: int = 2,
    n_systems: int | None = None,
    strict: bool = True,
) -> DataFrame:
    """Hard and soft voting as two more systems, from one aggregation per row.

    Hard voting takes the most frequent label (lowest on ties) and gives it probability 1. Soft
    voting averages the probabilities. With ``target`` priors each model is corrected before it
    votes in the hard vote, and the average is corrected after averaging in the soft vote. Every
    system has a fixed slot, and slots are added up in the order of the names, so equal rows get equal
    means whatever order a shuffle brings them in, and no digit is cut.
    A row that some system lacks or predicted twice, or whose systems disagree about the truth, fails the job,
    and so do fewer than ``min_systems`` systems, or another number than ``n_systems``. Without ``strict`` any
    ``min_systems`` votes on a row are enough.
    """
    systems = systems_of(preds)
    complete = len(systems) >= min_systems and n_systems in (None, len(systems))
    label = F.col("pred_label")
    if target is not None:
        label = arg_max(adjust_priors(F.col("probs"), n_classes, target, train))
    labelled = preds.withColumn("vote", label)

    def slot(i: int, c: int) -> str:
        return f"__p{i}_{c}"

    per_row = labelled.groupBy("row_id").agg(
        F.min("true_label").alias("true_label"),
        F.max("true_label").alias("other_truth"),
        F.count("*").alias("n_votes"),
        *[F.count_if(F.col("vote") == c).alias(f"__v{c}") for c in range(n_classes)],
        *[F.count_if(F.col("system") == s).alias(f"__n{i}") for i, s in enumerate(systems)],
        *[F.max(F.when(F.col("system") == s, F.col("probs")[c])).alias(slot(i, c)) for i, s in enumerate(systems) for c in range(n_classes)],
    )

    def mean(c: int) -> Column:
        slots = [F.coalesce(F.col(slot(i, c)), F.lit(0.0)) if not strict else F.col(slot(i, c)) for i in range(len(systems))]
        return reduce(add, slots, F.lit(0.0)) / F.col("n_votes")

    counts = F.array(*[F.col(f"__v{c}") for c in range(n_classes)])
    per_row = with_once(per_row.withColumn("votes", counts), "mean", F.array(*[mean(c) for c in range(n_classes)]))
    each = [F.col(f"__n{i}") for i in range(len(systems))]
    once = reduce(lambda a, b: a & b, [n == 1 if strict else n <= 1 for n in each], F.lit(complete))
    # A vote without a name of a system is in no slot.
    named = F.col("n_votes") == reduce(add, each, F.lit(0))
    aligned = once & named & (F.col("n_votes") >= min_systems) & (F.col("true_label") == F.col("other_truth"))
    checked = per_row.withColumn(
        "true_label",
        F.when(aligned, F.col("true_label")).otherwise(
            F.raise_error(F.concat(F.lit("systems are not aligned on row "), F.coalesce(F.col("row_id").cast("string"), F.lit("NULL"))))
        ),
    ).withColumn("true_label", F.col("true_label").cast("int"))
    soft = F.col("mean")
    if target is not None:
        soft = adjust_priors(soft, n_classes, target, train)

    def system(name, pred, probs):
        return F.struct(F.lit(name).alias("system"), pred.alias("pred_label"), probs.alias("probs"))

    winner = arg_max(F.col("votes"))
    leader = arg_max(soft)
    rows = F.array(system(hard_name, winner, one_hot(winner, n_classes)), system(soft_name, leader, soft))
    return checked.select("row_id", "true_label", F.inline(rows)).select(
        "system", "row_id", "true_label", "pred_label", "probs"
    )
