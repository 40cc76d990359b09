"""ROC and precision-recall curves and areas, one-vs-rest per class.

Scores are grouped first, so a score shared by a third of the rows is one row afterwards, and
running counts come from :func:`curate.operators.running.running`. Everything after that is
row-local: the point before a row is its running count minus its own count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.constants import RECALL_GRID
from curate.operators.running import running, running_max_before
from curate.session import stored

SYSTEM = ("system",)


def class_scores(preds: DataFrame, by: Sequence[str] = SYSTEM, n_classes: int = 3) -> DataFrame:
    """Long form: one row per class with its score and whether it is the true class."""
    rows = [
        F.struct(
            F.lit(c).alias("cls"), F.col("probs")[c].alias("score"), (F.col("true_label") == c).alias("positive")
        )
        for c in range(n_classes)
    ]
    return preds.select(*by, F.inline(F.array(*rows)))


def score_counts(preds: DataFrame, by: Sequence[str] = SYSTEM, n_classes: int = 3) -> DataFrame:
    """Per class and distinct score: rows ``n``, of the class ``p``, of others ``q``.

    With predicted labels also ``predicted`` (rows labelled with the class) and ``hits`` (rightly so).
    Margins, areas, curves and flags all follow from this table, so one that is stored serves them all
    and the predictions, which may be votes still to be counted, are made once.
    """
    labelled = "pred_label" in preds.columns
    rows = []
    for c in range(n_classes):
        fields = [F.lit(c).alias("cls"), F.col("probs")[c].alias("score"), (F.col("true_label") == c).alias("positive")]
        rows.append(F.struct(*fields, *([(F.col("pred_label") == c).alias("named")] if labelled else [])))
    sums = {"n": F.count("*"), "p": F.count_if(F.col("positive")), "q": F.count_if(~F.col("positive"))}
    if labelled:
        sums |= {"predicted": F.count_if(F.col("named")), "hits": F.count_if(F.col("named") & F.col("positive"))}
    long = preds.select(*by, F.inline(F.array(*rows)))
    return long.groupBy(*by, "cls", "score").agg(*[v.alias(k) for k, v in sums.items()])


def _score_spread(score: Column) -> Column:
    """Grows with the score and gives room to both ends, where confident models crowd.

    Scores outside [0, 1] share an end and stay in order.
    """
    s = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))

    def half(x: Column) -> Column:
        return F.sqrt(F.sqrt(2.0 * x)) / 2.0

    return F.when(s < 0.5, half(s)).otherwise(1.0 - half(1.0 - s))


def running_counts(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per distinct score: positives ``p``, negatives ``q``, running ``tp`` / ``fp`` and totals."""
    grouped = scores.groupBy(*keys, "score").agg(
        F.count_if(F.col("positive")).alias("p"), F.count_if(~F.col("positive")).alias("q")
    )
    return _cumulated(grouped, keys)


def _cumulated(grouped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running counts over the scores of a table like that of :func:`score_counts`."""
    counts = running(
        grouped.select(*keys, "score", "p", "q"),
        keys,
        _score_spread(F.col("score")),
        [F.desc("score")],
        {"p": F.col("p"), "q": F.col("q")},
        descending=True,
    )
    return counts.withColumnsRenamed(
        {"p_upto": "tp", "q_upto": "fp", "p_total": "positives", "q_total": "negatives"}
    )


def _counts(preds: DataFrame, by: Sequence[str], n_classes: int = 3) -> DataFrame:
    return running_counts(class_scores(preds, by, n_classes), [*by, "cls"])


def class_areas(preds: DataFrame, by: Sequence[str] = SYSTEM, n_classes: int = 3) -> DataFrame:
    """Per class: ROC area with half credit for ties, and average precision.

    The ROC area is NULL where a class has no positives or no negatives; average precision is 0
    where it has no positives.
    """
    return _areas(_counts(preds, by, n_classes), by)


def areas_of_counts(counts: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """:func:`class_areas` from the table of :func:`score_counts`."""
    return _areas(_cumulated(counts, [*by, "cls"]), by)


def _areas(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    def double(name: str) -> Column:
        return F.col(name).cast("double")

    area = F.sum(double("q") * (double("tp") - double("p") / 2))
    step = F.try_divide(double("p"), double("positives")) * double("tp") / (double("tp") + double("fp"))
    return counts.groupBy(*by, "cls").agg(
        F.try_divide(area, F.first(double("positives") * double("negatives"))).alias("roc_auc"),
        F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision"),
        F.first("positives").alias("positives"),
        F.first("negatives").alias("negatives"),
    )


def _is_first() -> Column:
    return (F.col("tp") == F.col("p")) & (F.col("fp") == F.col("q"))


def _with_anchor(x: str, y: str, point: tuple[Column, Column], anchor: tuple[float, float]):
    """The row's own point, preceded by the threshold-less anchor on the first row of a curve."""

    def pt(threshold, a, b):
        return F.struct(threshold.cast("double").alias("threshold"), a.alias(x), b.alias(y))

    own = pt(F.col("score"), *point)
    start = pt(F.lit(None), F.lit(anchor[0]), F.lit(anchor[1]))
    return F.inline(F.when(_is_first(), F.array(start, own)).otherwise(F.array(own)))


def roc_points(preds: DataFrame, by: Sequence[str] = SYSTEM, collinear: bool = True) -> DataFrame:
    """``(threshold, fpr, tpr)`` per distinct score, starting at (0, 0) with NULL threshold.

    Without ``collinear`` points, a score between the first and the last is left out if the next lower
    one adds as many positives and as many negatives, since the curve runs straight through it.
    """
    counts = _counts(preds, by)
    if not collinear:
        step = F.struct("score", "p", "q")
        counts = running_max_before(
            counts, [*by, "cls"], _score_spread(F.col("score")), [F.asc("score")], step, "lower"
        ).where(_is_first() | F.col("lower").isNull() | (F.col("lower.p") != F.col("p")) | (F.col("lower.q") != F.col("q")))
    fpr = F.try_divide(F.col("fp").cast("double"), F.col("negatives").cast("double"))
    tpr = F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double"))
    return counts.select(*by, "cls", _with_anchor("fpr", "tpr", (fpr, tpr), (0.0, 0.0)))


def pr_points(preds: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """``(threshold, precision, recall)`` per distinct score, plus (1, 0) with NULL threshold."""
    precision = F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double")
    recall = F.coalesce(
        F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double")), F.lit(1.0)
    )
    return _counts(preds, by).select(
        *by, "cls", _with_anchor("precision", "recall", (precision, recall), (1.0, 0.0))
    )


def interpolated_precision(
    preds: DataFrame, by: Sequence[str] = SYSTEM, grid: int = RECALL_GRID
) -> DataFrame:
    """Precision linearly interpolated at ``grid`` evenly spaced recalls, per class.

    A row that adds positives closes the recall segment opened by the row before it, and emits
    the grid recalls inside ``[previous, own)``; the last row emits recall 1. Segment bounds are
    integer arithmetic, so no grid point is lost or doubled.
    """
    last = grid - 1
    tp, fp, pos = F.col("tp"), F.col("fp"), F.col("positives")
    tp0, fp0 = tp - F.col("p"), fp - F.col("q")

    def first_step_at(hits: str) -> Column:
        return F.expr(f"({hits} * {last} + positives - 1) div positives")

    counts = _counts(preds, by).where("positives > 0").withColumns(
        {
            "left_p": F.coalesce(F.try_divide(tp0.cast("double"), (tp0 + fp0).cast("double")), F.lit(1.0)),
            "left_r": tp0.cast("double") / pos.cast("double"),
            "right_p": tp.cast("double") / (tp + fp).cast("double"),
            "right_r": tp.cast("double") / pos.cast("double"),
            "lo": first_step_at("(tp - p)"),
            "hi": first_step_at("tp") - 1,
            "closing": (tp == pos) & (fp == F.col("negatives")),
        }
    )
    inner = F.when((F.col("p") > 0) & (F.col("hi") >= F.col("lo")), F.sequence("lo", "hi")).otherwise(
        F.array().cast("array<bigint>")
    )
    steps = F.when(F.col("closing"), F.concat(inner, F.array(F.lit(last).cast("bigint")))).otherwise(inner)
    at = F.col("step").cast("double") / last
    slope = (F.col("right_p") - F.col("left_p")) / (F.col("right_r") - F.col("left_r"))
    value = F.when(F.col("step") == last, F.col("right_p")).otherwise(
        slope * (at - F.col("left_r")) + F.col("left_p")
    )
    return counts.withColumn("step", F.explode(steps)).select(
        *by, "cls", F.col("step").cast("int").alias("step"), at.alias("recall"), value.alias("precision")
    )


def macro_pr_curve(
    preds: DataFrame, by: Sequence[str] = SYSTEM, grid: int = RECALL_GRID
) -> DataFrame:
    """Mean over classes of the interpolated precision."""
    return interpolated_precision(preds, by, grid).groupBy(*by, "step").agg(
        F.first("recall").alias("recall"), F.avg("precision").alias("precision")
    )


def degenerate_scores(preds: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """Whether all scores of a class are exactly 0 or 1, and whether all classes of a system are."""
    return degenerate_counts(class_scores(preds, by), by)


def degenerate_counts(scores: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """:func:`degenerate_scores` from any table with the scores of each class, repeated or not."""
    per_class = scores.groupBy(*by, "cls").agg(
        F.bool_and(F.col("score").isin(0.0, 1.0)).alias("class_degenerate")
    )
    # A row per system and class by now.
    whole = F.bool_and("class_degenerate").over(Window.partitionBy(*by))
    return per_class.withColumn("system_degenerate", whole)


def operating_point(preds: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """False and true positive rate of 0/1 scores; 0 where the denominator is 0."""
    hit = F.col("score") == 1.0
    rows = class_scores(preds, by).groupBy(*by, "cls").agg(
        F.count_if(F.col("positive") & hit).alias("tp"),
        F.count_if(~F.col("positive") & hit).alias("fp"),
        F.count_if(~F.col("positive") & ~hit).alias("tn"),
        F.count_if(F.col("positive") & ~hit).alias("fn"),
    )

    def rate(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")), F.lit(0.0))

    return rows.select(*by, "cls", "tp", "fp", "tn", "fn", rate("fp", "tn").alias("fpr"), rate("tp", "fn").alias("tpr"))


def curve_order(preds: DataFrame, by: Sequence[str] = SYSTEM, focus: int = 0) -> DataFrame:
    """Systems by average precision of one class and by the mean over classes, both ascending.

    Systems with 0/1 scores only have no curve and are left out.
    """
    by = list(by)
    counts = stored(score_counts(preds, by), "score_counts")
    flags = degenerate_counts(counts, by)
    drawn = flags.where((F.col("cls") == focus) & ~F.col("system_degenerate")).select(*by)
    areas = areas_of_counts(counts, by).join(drawn, by, "left_semi")
    per_system = areas.groupBy(*by).agg(
        F.max(F.when(F.col("cls") == focus, F.col("average_precision"))).alias("focus_ap"),
        F.avg("average_precision").alias("mean_ap"),
    )
    ties = [F.asc(c) for c in by]
    return per_system.withColumns(
        {
            "focus_rank": F.row_number().over(Window.orderBy("focus_ap", *ties)),
            "macro_rank": F.row_number().over(Window.orderBy("mean_ap", *ties)),
        }
    )
