"""The three study scenarios as one job: plain, ensemble, and rebalanced training."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.base import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.constants import SEED
from curate.operators.balance import effective_priors
from curate.operators.models import N_FEATURES, score, train_classifiers
from curate.operators.split import stratified_split
from curate.operators.votes import ensemble, with_adjusted_priors
from curate.plans.rebalance import augment
from curate.session import stored
from curate.sources.predictions import consolidated


def run_scenarios(
    real: DataFrame,
    candidates: DataFrame,
    threshold: float,
    registry: Mapping[str, Estimator] | None = None,
    synthetic_weight: float = 0.2,
    adjust: bool = True,
    balance: str | int = "majority",
    seed: int = SEED,
    n_classes: int = 3,
    n_features: int = N_FEATURES,
) -> DataFrame:
    """Test predictions of all systems: ``scenario_A_…``, ``scenario_B_…`` and ``scenario_C_…``.

    A trains on the train split, B votes over A, C trains on the rebalanced train split and votes
    too; with ``adjust`` the C scores are corrected from the priors it was trained with to those
    of the plain train split.
    """
    split = stored(stratified_split(real, seed=seed), "split")
    train, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'")
    plain = stored(score(train_classifiers(train, registry, n_classes, n_features=n_features), test), "plain")

    augmented = stored(augment(train, candidates, threshold, balance, seed=seed, n_classes=n_classes), "augmented")
    models = train_classifiers(augmented, registry, n_classes, synthetic_weight, n_features)
    raw = stored(score(models, test), "rebalanced")
    target = effective_priors(train, n_classes=n_classes).scalar() if adjust else None
    trained = effective_priors(augmented, synthetic_weight, n_classes).scalar() if adjust else None
    single = with_adjusted_priors(raw, target, trained, n_classes) if adjust else raw
    voted = ensemble(raw, n_classes, target, trained, "ensemble_hard", "ensemble_soft")
    return consolidated(
        {
            "scenario_A": plain,
            "scenario_B": ensemble(plain, n_classes, hard_name="ensemble_hard", soft_name="ensemble_soft"),
            "scenario_C": single.unionByName(voted),
        }
    ).withColumn("true_label", F.col("true_label").cast("int"))
