"""Confusion matrices, classification metrics and reports.

Predictions are one row per ``(system, row_id)`` with ``true_label INT``, ``pred_label INT`` and
optionally ``probs ARRAY<DOUBLE>``. All functions take ``by``, the columns that name a result, so
every system (or any finer grouping) is measured in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.constants import CLASS_NAMES
from curate.operators.curves import areas_of_counts, class_areas, score_counts
from curate.session import stored

SYSTEM = ("system",)


def confusion(preds: DataFrame, by: Sequence[str] = SYSTEM, n_classes: int = 3) -> DataFrame:
    """Counts of every true × predicted cell, zero cells included, and the share of the true row.

    Cells are aggregated first; the at most n² counts of a group are then read back by key. A label
    outside the classes, or none, fails the job rather than count in another cell.
    """
    by = list(by)
    cells = preds.groupBy(*by, "true_label", "pred_label").agg(F.count("*").alias("n"))
    known = F.col("true_label").between(0, n_classes - 1) & F.col("pred_label").between(0, n_classes - 1)
    key = F.when(known, F.col("true_label") * n_classes + F.col("pred_label")).otherwise(
        F.raise_error(F.lit("a label is outside the classes")).cast("int")
    )
    table = cells.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(key.cast("int").alias("k"), F.col("n")))).alias("m")
    )
    cell = [
        F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("pred_label"))
        for t in range(n_classes)
        for p in range(n_classes)
    ]

    def count_at(t, p) -> Column:
        return F.coalesce(F.try_element_at("m", (t * n_classes + p).cast("int")), F.lit(0).cast("bigint"))

    wide = table.select(*by, "m", F.inline(F.array(*cell)))
    support = reduce(add, [count_at(F.col("true_label"), F.lit(p)) for p in range(n_classes)])
    return wide.select(
        *by,
        "true_label",
        "pred_label",
        count_at(F.col("true_label"), F.col("pred_label")).alias("n"),
        F.try_divide(count_at(F.col("true_label"), F.col("pred_label")).cast("double"), support).alias("row_share"),
    )


def margins(preds: DataFrame, by: Sequence[str] = SYSTEM, n_classes: int = 3) -> DataFrame:
    """Row total and, per class, hits ``tp``, ``predicted`` and ``support`` as arrays; one pass."""
    hit = F.col("true_label") == F.col("pred_label")

    def per_class(make):
        return F.array(*[F.count_if(make(c)) for c in range(n_classes)])

    return preds.groupBy(*by).agg(
        F.count("*").alias("n"),
        per_class(lambda c: hit & (F.col("true_label") == c)).alias("tp"),
        per_class(lambda c: F.col("pred_label") == c).alias("predicted"),
        per_class(lambda c: F.col("true_label") == c).alias("support"),
    )


def margins_of_counts(counts: DataFrame, by: Sequence[str] = SYSTEM, n_classes: int = 3) -> DataFrame:
    """:func:`margins` from the table of :func:`curate.operators.curves.score_counts`."""

    def per_class(name):
        return F.array(*[F.sum(F.when(F.col("cls") == c, F.col(name))) for c in range(n_classes)])

    return counts.groupBy(*by).agg(
        F.sum(F.when(F.col("cls") == 0, F.col("n"))).alias("n"),
        per_class("hits").alias("tp"),
        per_class("predicted").alias("predicted"),
        per_class("p").alias("support"),
    )


def _ratio(a: Column, b: Column) -> Column:
    """a / b with 0 / 0 = 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _class_columns(c: int) -> dict[str, Column]:
    tp, predicted, support = F.col("tp")[c], F.col("predicted")[c], F.col("support")[c]
    return {
        "precision": _ratio(tp, predicted),
        "recall": _ratio(tp, support),
        "f1": _ratio(2 * tp, predicted + support),
    }


def _averages(n_classes: int, labels: str) -> dict[str, Column]:
    """accuracy and the macro / weighted means over the class columns."""
    support = [F.col("support")[c] for c in range(n_classes)]
    if labels == "present":
        used = reduce(
            add, [(support[c] + F.col("predicted")[c] > 0).cast("int") for c in range(n_classes)]
        )
    elif labels == "all":
        used = F.lit(n_classes)
    else:
        raise ValueError(f"labels must be 'present' or 'all', got {labels!r}")
    out = {"accuracy": _ratio(reduce(add, [F.col("tp")[c] for c in range(n_classes)]), F.col("n"))}
    for kind in ("precision", "recall", "f1"):
        values = [_class_columns(c)[kind] for c in range(n_classes)]
        out[f"{kind}_macro"] = _ratio(reduce(add, values), used)
        out[f"{kind}_weighted"] = _ratio(
            reduce(add, [v * s for v, s in zip(values, support)]), reduce(add, support)
        )
    return out


def core_metrics(
    preds: DataFrame,
    by: Sequence[str] = SYSTEM,
    class_names: Sequence[str] = CLASS_NAMES,
    labels: str = "present",
) -> DataFrame:
    """accuracy; macro, weighted and per-class precision, recall and F1.

    ``labels='present'`` averages over the classes seen in truth or prediction, ``'all'`` over
    the whole class list. A class that is absent has 0 in its own columns.
    """
    return metrics_from_margins(margins(preds, by, len(class_names)), by, class_names, labels)


def metrics_from_margins(
    table: DataFrame,
    by: Sequence[str] = SYSTEM,
    class_names: Sequence[str] = CLASS_NAMES,
    labels: str = "present",
) -> DataFrame:
    """The metric columns of a :func:`margins` table."""
    n = len(class_names)
    columns = _averages(n, labels)
    for c, name in enumerate(class_names):
        for kind, value in _class_columns(c).items():
            columns[f"{kind}_{name}"] = value
    return table.select(*by, *[v.alias(k) for k, v in columns.items()])


def all_metrics(
    preds: DataFrame,
    by: Sequence[str] = SYSTEM,
    class_names: Sequence[str] = CLASS_NAMES,
    labels: str = "present",
) -> DataFrame:
    """:func:`core_metrics` plus the ROC and precision-recall areas.

    ``preds`` is evaluated once, into stored counts by score, from which all metrics follow.
    """
    by, n = list(by), len(class_names)
    counts = stored(score_counts(preds, by, n), "score_counts")
    areas = _area_means(areas_of_counts(counts, by), by, n)
    return metrics_from_margins(margins_of_counts(counts, by, n), by, class_names, labels).join(areas, by, "left")


def area_metrics(preds: DataFrame, by: Sequence[str] = SYSTEM, n_classes: int = 3) -> DataFrame:
    """``roc_auc_macro``, ``roc_auc_weighted`` (NULL if any class has one label only), ``pr_auc_macro``."""
    return _area_means(class_areas(preds, by, n_classes), by, n_classes)


def _area_means(per_class: DataFrame, by: Sequence[str], n_classes: int) -> DataFrame:
    complete = F.count("roc_auc") == n_classes
    return per_class.groupBy(*by).agg(
        F.when(complete, F.avg("roc_auc")).alias("roc_auc_macro"),
        F.when(
            complete, F.try_divide(F.sum(F.col("roc_auc") * F.col("positives")), F.sum("positives"))
        ).alias("roc_auc_weighted"),
        F.avg("average_precision").alias("pr_auc_macro"),
    )


def classification_report(
    preds: DataFrame,
    by: Sequence[str] = SYSTEM,
    class_names: Sequence[str] = CLASS_NAMES,
    labels: str = "present",
) -> DataFrame:
    """One row per class, then ``accuracy``, ``macro avg`` and ``weighted avg``."""
    n = len(class_names)
    avg = _averages(n, labels)
    total = F.col("n")
    rows = []
    for c, name in enumerate(class_names):
        v = _class_columns(c)
        rows.append((name, v["precision"], v["recall"], v["f1"], F.col("support")[c]))
    none = F.lit(None).cast("double")
    rows.append(("accuracy", none, none, avg["accuracy"], total))
    for title, kind in (("macro avg", "macro"), ("weighted avg", "weighted")):
        rows.append((title, *[avg[f"{m}_{kind}"] for m in ("precision", "recall", "f1")], total))
    structs = [
        F.struct(
            F.lit(i).alias("line"),
            F.lit(title).alias("label"),
            p.alias("precision"),
            r.alias("recall"),
            f.alias("f1"),
            s.alias("support"),
        )
        for i, (title, p, r, f, s) in enumerate(rows)
    ]
    return margins(preds, by, n).select(*by, F.inline(F.array(*structs)))


def prevalence(preds: DataFrame, by: Sequence[str] = SYSTEM, n_classes: int = 3) -> DataFrame:
    """Share of each true class, and the uniform 1 / n line."""
    rows = [
        F.struct(
            F.lit(c).alias("cls"),
            _ratio(F.col("support")[c], F.col("n")).alias("prevalence"),
            F.lit(1.0 / n_classes).alias("uniform"),
        )
        for c in range(n_classes)
    ]
    return margins(preds, by, n_classes).select(*by, F.inline(F.array(*rows)))
