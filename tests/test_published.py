"""Published numbers of the study, copied as literals."""

import math

import pytest
from pyspark.sql import functions as F

from curate.operators import balance, metrics, significance, training
from curate.operators.votes import ensemble
from curate.plans.rebalance import style_column

TRAIN_COUNTS = {0: 1001, 1: 13433, 2: 2914}
SUPPORT = (214, 2879, 625)


@pytest.fixture(scope="module")
def train(spark):
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.lit(n).alias("n")) for c, n in TRAIN_COUNTS.items()])
    return spark.range(1).select(F.inline(rows)).select("label", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))


@pytest.mark.parametrize(
    "how, wanted",
    [
        ("majority", {0: 12432, 2: 10519}),
        ("mean", {0: 4781, 2: 2868}),
        (5000, {0: 5000, 2: 5000}),
    ],
)
def test_rebalance_targets(train, how, wanted):
    got = balance.rebalance_targets(train, how).collect()
    assert {r["label"]: r["target"] for r in got} == wanted


def test_unknown_strategy_is_refused(train):
    with pytest.raises(ValueError):
        balance.rebalance_targets(train, "median")


def test_class_weights(train):
    got = {r["label"]: r["weight"] for r in balance.class_weights(train).collect()}
    assert got == pytest.approx({0: 17348 / 3003, 1: 17348 / 40299, 2: 17348 / 8742}, rel=1e-15)


def test_style_grid(spark):
    styles = [r["s"] for r in spark.range(40).select(style_column(F.col("id")).alias("s")).orderBy("id").collect()]
    assert len(set(styles)) == 20 and styles[:20] == styles[20:]
    assert len({s["syntax"] for s in styles}) == 2


MARGINS = [
    # tp, predicted, accuracy, macro F1, weighted F1, minority precision, minority F1
    ((107, 2693, 573), (227, 2826, 665), 0.9072081764389457, 0.7725723335734953, 0.908310003429622, 0.4713656387665198, 0.4852607709750567),
    ((110, 2689, 592), (238, 2797, 683), 0.9120494889725659, 0.7798075595570455, 0.9138665829143187, 0.46218487394957986, 0.48672566371681414),
]


def _expanded(spark, tp, predicted):
    """Rows with the given margins: hits first, then misses filled class by class."""
    missing = [s - t for s, t in zip(SUPPORT, tp)]
    extra = [p - t for p, t in zip(predicted, tp)]
    cells = [(c, c, t) for c, t in enumerate(tp)]
    # a 3x3 table with a zero diagonal: x = cell (0, 1) is free, take the largest that fits
    for x in range(min(missing[0], extra[1]), -1, -1):
        cell = {(0, 1): x, (0, 2): missing[0] - x}
        cell[(2, 1)] = extra[1] - x
        cell[(2, 0)] = missing[2] - cell[(2, 1)]
        cell[(1, 0)] = extra[0] - cell[(2, 0)]
        cell[(1, 2)] = missing[1] - cell[(1, 0)]
        if min(cell.values()) >= 0 and cell[(0, 2)] + cell[(1, 2)] == extra[2]:
            break
    cells += [(t, p, n) for (t, p), n in cell.items()]
    rows = F.array(*[F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("pred_label"), F.lit(n).alias("n")) for t, p, n in cells if n])
    return spark.range(1).select(F.inline(rows)).select(
        F.lit("s").alias("system"), "true_label", "pred_label", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")
    )


@pytest.mark.parametrize("tp, predicted, accuracy, f1, weighted, precision, minority", MARGINS)
def test_metrics_from_margins(spark, tp, predicted, accuracy, f1, weighted, precision, minority):
    got = metrics.core_metrics(_expanded(spark, tp, predicted)).first()
    assert got["accuracy"] == pytest.approx(accuracy, abs=1e-15)
    assert got["f1_macro"] == pytest.approx(f1, abs=1e-15)
    assert got["f1_weighted"] == pytest.approx(weighted, abs=1e-15)
    assert got["precision_hate_speech"] == pytest.approx(precision, abs=1e-15)
    assert got["f1_hate_speech"] == pytest.approx(minority, abs=1e-15)


def test_areas_of_one_hot_scores(spark):
    from curate.functions.prob import one_hot

    preds = _expanded(spark, *MARGINS[1][:2]).withColumn("probs", one_hot(F.col("pred_label"), 3))
    got = metrics.area_metrics(preds).first()
    assert got["roc_auc_macro"] == pytest.approx(0.8667579879916772, abs=1e-14)
    assert got["roc_auc_weighted"] == pytest.approx(0.9026621867808476, abs=1e-14)
    assert got["pr_auc_macro"] == pytest.approx(0.681487205699128, abs=1e-14)


TESTS = [
    # wins of a, wins of b, statistic, p, significant
    (72, 76, 5364.0, 0.7423083940717163, False),
    (91, 70, 5670.0, 0.09791803677556106, False),
    (24, 46, 852.0, 0.00855097923712533, True),
    (31, 50, 1271.0, 0.034762762622228424, True),
    (112, 72, 6660.0, 0.0031896997062168643, True),
    (140, 98, 11711.0, 0.006479873248596327, True),
    (90, 78, 6591.0, 0.3545394797735013, False),
    (124, 77, 7777.0, 0.0009160235169816295, True),
    (97, 72, 6120.0, 0.054470390027477396, False),
    (137, 93, 10741.5, 0.003716486552095741, True),
]


def test_signed_rank(spark):
    data = [("a", f"b{i}", 3718, a, b, 3718 - a - b) for i, (a, b, *_) in enumerate(TESTS)]
    pairs = spark.createDataFrame(
        data, "system_a string, system_b string, n_samples long, n_a_better long, n_b_better long, n_ties long"
    )
    got = {r["comparison"]: r for r in significance.signed_rank_table(pairs).collect()}
    for i, (a, b, statistic, p, significant) in enumerate(TESTS):
        row = got[f"a vs b{i}"]
        assert row["statistic"] == statistic
        assert row["p_value"] == pytest.approx(p, rel=1e-12)
        assert row["significant"] is significant
        winner = "no significant difference" if not significant else ("a" if a > b else f"b{i}")
        assert row["winner"] == winner


def test_identical_systems_tie(spark):
    preds = spark.createDataFrame(
        [(s, i, i % 3, (i * 2) % 3) for s in "ab" for i in range(30)],
        "system string, row_id long, true_label int, pred_label int",
    )
    row = significance.pairwise_signed_rank(preds).first()
    assert (row["p_value"], row["statistic"], row["significant"]) == (1.0, None, False)
    assert row["winner"] == "tie (identical predictions)"


HISTORIES = {
    "A": (10, 22, [0.384165, 0.592283, 0.722205, 0.756393, 0.773924, 0.770231, 0.775004, 0.77243, 0.77473, 0.789122, 0.781971,
                   0.77799, 0.774639, 0.762667, 0.768334, 0.73928, 0.760137, 0.755395, 0.752616, 0.749814, 0.756884, 0.746285]),
    "C": (12, 24, [0.568877, 0.705607, 0.710651, 0.74542, 0.737934, 0.750094, 0.725948, 0.733243, 0.739266, 0.722814, 0.7512,
                   0.751608, 0.736579, 0.733761, 0.735567, 0.73398, 0.725203, 0.734315, 0.741491, 0.732622, 0.750982, 0.710471,
                   0.718369, 0.729999]),
}


def test_histories(spark):
    rows = [(run, i + 1, s) for run, (_, _, scores) in HISTORIES.items() for i, s in enumerate(scores)]
    history = spark.createDataFrame(rows, "run string, epoch int, score double").repartition(3)
    stops = {r["run"]: r for r in training.early_stop(history).collect()}
    best = {r["run"]: r for r in training.best_epoch(history).collect()}
    for run, (best_at, length, scores) in HISTORIES.items():
        assert stops[run]["stop_epoch"] == length == stops[run]["epochs"]
        assert best[run]["best_epoch"] == best_at
        assert best[run]["best_score"] == max(scores)


def test_hard_vote_tie_takes_lowest_class(spark):
    preds = spark.createDataFrame(
        [("a", 1, 0, 2, [0.1, 0.2, 0.7]), ("b", 1, 0, 1, [0.1, 0.7, 0.2])],
        "system string, row_id long, true_label int, pred_label int, probs array<double>",
    )
    got = {r["system"]: r for r in ensemble(preds).collect()}
    assert got["hard_voting"]["pred_label"] == 1
    assert got["soft_voting"]["pred_label"] == 1
    assert math.isclose(sum(got["soft_voting"]["probs"]), 1.0)
