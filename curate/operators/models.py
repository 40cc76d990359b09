"""Weighted text classifiers of Spark ML, trained and scored under one protocol."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from curate.constants import CLASS_NAMES, SEED
from curate.functions.prob import arg_max
from curate.functions.text import words
from curate.operators.balance import class_weights, is_synthetic
from curate.operators.metrics import core_metrics

N_FEATURES = 1 << 13
FIT_ROWS = 1 << 12
"""Rows of a task that fits: a forest keeps 4 bytes for each feature of each row, here 134 MB."""
FEW_ROWS = 1 << 14
"""Up to as many rows stay dealt as they come, even if one task gets them all."""
COMMON = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}


def default_registry(seed: int = SEED) -> dict[str, Estimator]:
    return {
        "logistic": LogisticRegression(maxIter=20, regParam=0.01, **COMMON),
        "bayes": NaiveBayes(**COMMON),
        "forest": RandomForestClassifier(numTrees=10, maxDepth=4, seed=seed, **COMMON),
    }


def _tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("__tokens", words(F.lower("text")))


def weighted_rows(
    train: DataFrame, n_classes: int = 3, synthetic_weight: float = 1.0, classes: Sequence[Row] | None = None
) -> DataFrame:
    """Add ``weight``: the class weight, times the synthetic weight on synthetic rows.

    The class weights are one number per class, read once; ``classes`` are those rows, if they are known.
    """
    classes = class_weights(train, n_classes).collect() if classes is None else classes
    by_class = {r["label"]: r["weight"] for r in classes}
    listed = F.array(*[F.lit(by_class[c] or 0.0) for c in range(n_classes)])
    sample = F.when(is_synthetic(train), F.lit(float(synthetic_weight))).otherwise(F.lit(1.0))
    return train.withColumn("weight", F.get(listed, F.col("label")) * sample)


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows over tasks whose number grows with them, so that no task's share does."""
    if n <= FEW_ROWS:
        return rows
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // FIT_ROWS)))


def train_classifiers(
    train: DataFrame,
    registry: Mapping[str, Estimator] | None = None,
    n_classes: int = 3,
    synthetic_weight: float = 1.0,
    n_features: int = N_FEATURES,
) -> dict[str, PipelineModel]:
    """Fit every registered estimator on the same weighted TF-IDF features."""
    registry = default_registry() if registry is None else registry
    counter = HashingTF(numFeatures=n_features, inputCol="__tokens", outputCol="__tf")
    classes = class_weights(train, n_classes).collect()
    rows = _tokens(weighted_rows(train, n_classes, synthetic_weight, classes)).select("__tokens", "label", "weight")
    counted = counter.transform(rows).select("__tf", F.col("label").cast("double").alias("label"), "weight")
    # Words are counted once; what follows reads the kept counts.
    counted = dealt(counted, sum(r["n"] for r in classes)).persist()
    try:
        idf = IDF(inputCol="__tf", outputCol="features").fit(counted)
        ready = idf.transform(counted).select("features", "label", "weight").persist()
        try:
            return {name: PipelineModel(stages=[counter, idf, est.fit(ready)]) for name, est in registry.items()}
        finally:
            ready.unpersist()
    finally:
        counted.unpersist()


def score(models: Mapping[str, PipelineModel], rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(system, row_id, true_label, pred_label, probs)`` of every model on every row.

    Models that share their feature stages, as those of :func:`train_classifiers` do, score in one pass
    over the texts. ``keep`` names columns of ``rows`` to carry along, such as the text.
    """
    tokens = _tokens(rows).select("row_id", F.col("label").cast("int").alias("true_label"), *keep, "__tokens")
    families: dict[tuple, list] = {}
    for name, model in models.items():
        families.setdefault(tuple(s.uid for s in model.stages[:-1]), []).append((name, model.stages))
    return reduce(DataFrame.unionByName, [_scored(tokens, family, keep) for family in families.values()])


def _scored(tokens: DataFrame, family: Sequence[tuple[str, Sequence[Model]]], keep: Sequence[str]) -> DataFrame:
    rows, each = PipelineModel(stages=family[0][1][:-1]).transform(tokens), []
    for i, (name, stages) in enumerate(family):
        judge = stages[-1]
        own = {judge.probabilityCol: f"__p{i}", judge.rawPredictionCol: f"__r{i}", judge.predictionCol: f"__l{i}"}
        rows = judge.copy(own).transform(rows)
        each.append(F.struct(F.lit(name).alias("system"), vector_to_array(F.col(f"__p{i}")).alias("probs")))
    long = rows.select("row_id", "true_label", *keep, F.inline(F.array(*each)))
    return long.select("system", "row_id", "true_label", *keep, arg_max(F.col("probs")).alias("pred_label"), "probs")


def best_model(val_preds: DataFrame, class_names: Sequence[str] = CLASS_NAMES) -> str:
    """Name of the system with the highest macro F1 on validation predictions."""
    table = core_metrics(val_preds, class_names=class_names)
    return table.orderBy(F.desc("f1_macro"), "system").select("system").first()[0]
