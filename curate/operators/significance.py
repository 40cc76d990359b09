"""Pairwise signed-rank tests between systems.

Differences of 0/1 correctness are -1, 0 or 1, so the signed-rank statistic has a closed form in
the two win counts. Rows collapse to the distinct patterns of who was right, and only those
patterns are expanded into pairs of systems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.constants import ALPHA, NO_DIFFERENCE, SAME_PREDICTIONS
from curate.functions.tails import binomial_two_sided, erfc


def correctness(preds: DataFrame) -> DataFrame:
    """1 where a system is right, else 0."""
    right = (F.col("pred_label") == F.col("true_label")).cast("int")
    return preds.select("system", "row_id", right.alias("correct"))


def signed_difference(pred_a: Column, pred_b: Column, truth: Column) -> Column:
    """1 if only a is right, -1 if only b is, else 0."""
    return (pred_a == truth).cast("int") - (pred_b == truth).cast("int")


def pair_counts(preds: DataFrame) -> DataFrame:
    """Per pair of systems in name order: rows, wins of each side, ties."""
    pattern = correctness(preds).groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("system", "correct"))).alias("pattern")
    )
    patterns = pattern.groupBy("pattern").agg(F.count("*").alias("n"))
    left = patterns.select("n", "pattern", F.posexplode("pattern").alias("pos", "a"))
    pairs = left.select(
        "n", "a", F.explode(F.slice("pattern", F.col("pos") + 2, F.size("pattern"))).alias("b")
    )
    diff = F.col("a.correct") - F.col("b.correct")
    return pairs.groupBy(F.col("a.system").alias("system_a"), F.col("b.system").alias("system_b")).agg(
        F.sum("n").alias("n_samples"),
        F.sum(F.when(diff > 0, F.col("n")).otherwise(0)).alias("n_a_better"),
        F.sum(F.when(diff < 0, F.col("n")).otherwise(0)).alias("n_b_better"),
        F.sum(F.when(diff == 0, F.col("n")).otherwise(0)).alias("n_ties"),
    )


def two_sided_p(a: Column, b: Column) -> Column:
    """Normal approximation, tie-corrected, of the two-sided signed-rank test of a wins against b."""
    n = (a + b).cast("double")
    return F.when(n == 0, F.lit(1.0)).otherwise(erfc(F.abs(a - b) / F.sqrt(2.0 * n)))


def signed_rank_table(pairs: DataFrame, alpha: float = ALPHA, exact: bool = False) -> DataFrame:
    """Statistic, p-value, decision and winner of each row of :func:`pair_counts`.

    ``exact`` takes the binomial tail of the wins instead of the normal approximation.
    """
    a, b = F.col("n_a_better"), F.col("n_b_better")
    same = a + b == 0
    tested = pairs.withColumn("p_value", binomial_two_sided(a, b) if exact else two_sided_p(a, b))
    significant = F.col("p_value") < alpha
    winner = (
        F.when(same, F.lit(SAME_PREDICTIONS))
        .when(~significant, F.lit(NO_DIFFERENCE))
        .when(a > b, F.col("system_a"))
        .otherwise(F.col("system_b"))
    )
    return tested.select(
        F.concat("system_a", F.lit(" vs "), "system_b").alias("comparison"),
        "n_samples",
        "n_a_better",
        "n_b_better",
        "n_ties",
        F.when(~same, F.least(a, b) * (a + b + 1) / 2.0).alias("statistic"),
        "p_value",
        significant.alias("significant"),
        winner.alias("winner"),
    )


def pairwise_signed_rank(preds: DataFrame, alpha: float = ALPHA, exact: bool = False) -> DataFrame:
    """The signed-rank test of every unordered pair of systems."""
    return signed_rank_table(pair_counts(preds), alpha, exact)
