"""Queries over the predictions of three systems: metrics, votes, curves, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from curate.constants import NO_DIFFERENCE, SAME_PREDICTIONS
from curate.functions.prob import adjust_priors, arg_max, by_class, one_hot, softmax
from curate.operators import curves, metrics, significance, votes
from curate.workload.registry import query, rounded
from curate.workload.views import N_CLASSES, logits, predictions

TARGET = (1001 / 17348, 13433 / 17348, 2914 / 17348)
TRAIN = (0.31, 0.42, 0.27)


def _long(df):
    return df.select("system", "row_id", by_class(F.col("probs"), N_CLASSES))


# ------------------------------------------------------------------- probability functions
@query(
    "softmax_probabilities",
    """
    SELECT system, row_id, cls::INTEGER AS cls, round(prob, 9) AS prob FROM pred_long
    """,
    "pred_long",
)
def softmax_probabilities(spark, sf_dir):
    scored = logits(spark, sf_dir).withColumn("probs", softmax(F.col("logits"), N_CLASSES))
    return rounded(_long(scored))


@query(
    "arg_max_label",
    "SELECT system, row_id, true_label, pred_label::INTEGER AS pred_label FROM pred",
    "pred",
)
def arg_max_label(spark, sf_dir):
    return predictions(spark, sf_dir).select("system", "row_id", "true_label", "pred_label")


@query(
    "one_hot_label",
    """
    SELECT p.system, p.row_id, c.cls, CASE WHEN p.pred_label = c.cls THEN 1.0::DOUBLE ELSE 0.0 END AS prob
    FROM pred p, (VALUES (0), (1), (2)) c(cls)
    """,
    "pred",
)
def one_hot_label(spark, sf_dir):
    preds = predictions(spark, sf_dir)
    return _long(preds.withColumn("probs", one_hot(F.col("pred_label"), N_CLASSES)))


_ADJUSTED = f"""
    priors AS (SELECT * FROM (VALUES (0, {TARGET[0]}::DOUBLE, {TRAIN[0]}::DOUBLE),
                                     (1, {TARGET[1]}::DOUBLE, {TRAIN[1]}::DOUBLE),
                                     (2, {TARGET[2]}::DOUBLE, {TRAIN[2]}::DOUBLE)) p(cls, target, train)),
    scaled AS (SELECT l.system, l.row_id, l.true_label, l.cls,
                      l.prob * (p.target / greatest(p.train, 1e-8)) AS s
               FROM pred_long l JOIN priors p ON l.cls = p.cls),
    adjusted AS (SELECT *, s / sum(s) OVER (PARTITION BY system, row_id) AS prob FROM scaled)
"""


@query(
    "prior_correction",
    f"""WITH {_ADJUSTED}
    SELECT system, row_id, cls::INTEGER AS cls, round(prob, 9) AS prob,
           (first_value(cls) OVER (PARTITION BY system, row_id ORDER BY s DESC, cls))::INTEGER AS pred_label
    FROM adjusted
    """,
    "pred_long",
)
def prior_correction(spark, sf_dir):
    adjusted = predictions(spark, sf_dir).withColumn(
        "probs", adjust_priors(F.col("probs"), N_CLASSES, TARGET, TRAIN)
    )
    labelled = adjusted.withColumn("pred_label", arg_max(F.col("probs")))
    return rounded(
        labelled.select("system", "row_id", "pred_label", by_class(F.col("probs"), N_CLASSES))
    )


@query(
    "prior_correction_uniform",
    """
    WITH scaled AS (SELECT system, row_id, cls,
                           prob * (CASE cls WHEN 0 THEN 1001::DOUBLE WHEN 1 THEN 13433 ELSE 2914 END / 17348 / (1.0::DOUBLE / 3)) AS s
                    FROM pred_long)
    SELECT system, row_id, cls::INTEGER AS cls,
           round(s / sum(s) OVER (PARTITION BY system, row_id), 9) AS prob
    FROM scaled
    """,
    "pred_long",
)
def prior_correction_uniform(spark, sf_dir):
    return rounded(_long(votes.with_adjusted_priors(predictions(spark, sf_dir), TARGET)))


# --------------------------------------------------------------------------------- metrics
_MARGINS = """
    grid AS (SELECT system, cls::INTEGER AS cls FROM (SELECT DISTINCT system FROM pred),
                    (VALUES (0), (1), (2)) c(cls)),
    m AS (SELECT g.system, g.cls,
                 count(*) FILTER (p.true_label = g.cls AND p.pred_label = g.cls)::DOUBLE AS tp,
                 count(*) FILTER (p.pred_label = g.cls)::DOUBLE AS predicted,
                 count(*) FILTER (p.true_label = g.cls)::DOUBLE AS support
          FROM grid g JOIN pred p ON p.system = g.system GROUP BY ALL),
    pc AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS prec,
                  CASE WHEN support = 0 THEN 0 ELSE tp / support END AS rec,
                  CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1
           FROM m),
    core AS (SELECT system, sum(tp) / sum(support) AS accuracy,
                 avg(prec) AS precision_macro, avg(rec) AS recall_macro, avg(f1) AS f1_macro,
                 sum(prec * support) / sum(support) AS precision_weighted,
                 sum(rec * support) / sum(support) AS recall_weighted,
                 sum(f1 * support) / sum(support) AS f1_weighted,
                 max(prec) FILTER (cls = 0) AS precision_hate_speech,
                 max(rec) FILTER (cls = 0) AS recall_hate_speech,
                 max(f1) FILTER (cls = 0) AS f1_hate_speech,
                 max(prec) FILTER (cls = 1) AS precision_offensive_language,
                 max(rec) FILTER (cls = 1) AS recall_offensive_language,
                 max(f1) FILTER (cls = 1) AS f1_offensive_language,
                 max(prec) FILTER (cls = 2) AS precision_neither,
                 max(rec) FILTER (cls = 2) AS recall_neither,
                 max(f1) FILTER (cls = 2) AS f1_neither
             FROM pc GROUP BY system)
"""
_CORE_COLUMNS = (
    "accuracy precision_macro recall_macro f1_macro precision_weighted recall_weighted f1_weighted "
    "precision_hate_speech recall_hate_speech f1_hate_speech precision_offensive_language "
    "recall_offensive_language f1_offensive_language precision_neither recall_neither f1_neither"
).split()
_AREAS = """
    byscore AS (SELECT system, cls, prob, count(*) FILTER (true_label = cls) AS p,
                       count(*) FILTER (true_label <> cls) AS q
                FROM pred_long GROUP BY ALL),
    run AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp,
                   sum(p) OVER (PARTITION BY system, cls) AS pos, sum(q) OVER (PARTITION BY system, cls) AS neg
            FROM byscore WINDOW w AS (PARTITION BY system, cls ORDER BY prob DESC)),
    area AS (SELECT system, cls, max(pos) AS pos, max(neg) AS neg,
                    sum(q::DOUBLE * (tp - p / 2.0::DOUBLE)) / (max(pos)::DOUBLE * max(neg)) AS roc_auc,
                    sum(p::DOUBLE / pos * tp / (tp + fp)) AS ap
             FROM run GROUP BY system, cls)
"""


@query(
    "confusion_matrix",
    """
    WITH cells AS (SELECT s.system, t.c::INTEGER AS true_label, p.c::INTEGER AS pred_label
                   FROM (SELECT DISTINCT system FROM pred) s,
                        (VALUES (0), (1), (2)) t(c), (VALUES (0), (1), (2)) p(c))
    SELECT c.system, c.true_label, c.pred_label, count(p.row_id) AS n,
           round(count(p.row_id)::DOUBLE / sum(count(p.row_id)) OVER (PARTITION BY c.system, c.true_label), 9) AS row_share
    FROM cells c LEFT JOIN pred p
      ON p.system = c.system AND p.true_label = c.true_label AND p.pred_label = c.pred_label
    GROUP BY c.system, c.true_label, c.pred_label
    """,
    "pred",
)
def confusion_matrix(spark, sf_dir):
    return rounded(metrics.confusion(predictions(spark, sf_dir)))


@query(
    "core_metrics",
    f"WITH {_MARGINS} SELECT system, {', '.join(f'round({c}, 9) AS {c}' for c in _CORE_COLUMNS)} FROM core",
    "pred",
)
def core_metrics(spark, sf_dir):
    return rounded(metrics.core_metrics(predictions(spark, sf_dir)))


_REPORT = f"""WITH {_MARGINS},
    rows AS (
      SELECT system, cls AS line, CASE cls WHEN 0 THEN 'hate_speech' WHEN 1 THEN 'offensive_language' ELSE 'neither' END AS label,
             prec AS precision, rec AS recall, f1, support FROM pc
      UNION ALL SELECT c.system, 3, 'accuracy', NULL, NULL, accuracy, n FROM core c JOIN (SELECT system, sum(support) AS n FROM pc GROUP BY 1) USING (system)
      UNION ALL SELECT c.system, 4, 'macro avg', precision_macro, recall_macro, f1_macro, n FROM core c JOIN (SELECT system, sum(support) AS n FROM pc GROUP BY 1) USING (system)
      UNION ALL SELECT c.system, 5, 'weighted avg', precision_weighted, recall_weighted, f1_weighted, n FROM core c JOIN (SELECT system, sum(support) AS n FROM pc GROUP BY 1) USING (system))
    SELECT system, line::INTEGER AS line, label, round(precision, 9) AS precision, round(recall, 9) AS recall,
           round(f1, 9) AS f1, support::BIGINT AS support FROM rows
    """


@query("classification_report", _REPORT, "pred")
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(predictions(spark, sf_dir)))


@query(
    "class_areas",
    f"""WITH {_AREAS}
    SELECT system, cls::INTEGER AS cls, round(roc_auc, 9) AS roc_auc, round(ap, 9) AS average_precision,
           pos::BIGINT AS positives, neg::BIGINT AS negatives FROM area
    """,
    "pred_long",
)
def class_areas(spark, sf_dir):
    return rounded(curves.class_areas(predictions(spark, sf_dir)))


@query(
    "area_metrics",
    f"""WITH {_AREAS}
    SELECT system, round(avg(roc_auc), 9) AS roc_auc_macro,
           round(sum(roc_auc * pos) / sum(pos), 9) AS roc_auc_weighted, round(avg(ap), 9) AS pr_auc_macro
    FROM area GROUP BY system
    """,
    "pred_long",
)
def area_metrics(spark, sf_dir):
    return rounded(metrics.area_metrics(predictions(spark, sf_dir)))


@query(
    "evaluate_systems",
    f"""WITH {_MARGINS}, {_AREAS},
    auc AS (SELECT system, avg(roc_auc) AS roc_auc_macro, sum(roc_auc * pos) / sum(pos) AS roc_auc_weighted,
                   avg(ap) AS pr_auc_macro FROM area GROUP BY system)
    SELECT core.system, {', '.join(f'round({c}, 9) AS {c}' for c in _CORE_COLUMNS)},
           round(roc_auc_macro, 9) AS roc_auc_macro, round(roc_auc_weighted, 9) AS roc_auc_weighted,
           round(pr_auc_macro, 9) AS pr_auc_macro
    FROM core JOIN auc ON core.system = auc.system
    """,
    "pred pred_long",
)
def evaluate_systems(spark, sf_dir):
    return rounded(metrics.all_metrics(predictions(spark, sf_dir)))


@query(
    "class_prevalence",
    """
    SELECT s.system, c.cls::INTEGER AS cls, round(avg((p.true_label = c.cls)::INTEGER::DOUBLE), 9) AS prevalence,
           round(1.0::DOUBLE / 3, 9) AS uniform
    FROM (SELECT DISTINCT system FROM pred) s, (VALUES (0), (1), (2)) c(cls), pred p
    WHERE p.system = s.system GROUP BY s.system, c.cls
    """,
    "pred",
)
def class_prevalence(spark, sf_dir):
    return rounded(metrics.prevalence(predictions(spark, sf_dir)))


# ----------------------------------------------------------------------------------- votes
_HARD = """
    tally AS (SELECT row_id, true_label, pred_label, count(*) AS n FROM {source} GROUP BY ALL),
    hard AS (SELECT row_id, true_label, pred_label,
                    row_number() OVER (PARTITION BY row_id ORDER BY n DESC, pred_label) AS place
             FROM tally QUALIFY place = 1)
"""


@query(
    "hard_voting",
    f"WITH {_HARD.format(source='pred')} SELECT row_id, true_label, pred_label::INTEGER AS pred_label FROM hard",
    "pred",
)
def hard_voting(spark, sf_dir):
    both = votes.ensemble(predictions(spark, sf_dir), n_systems=3)
    return both.where(F.col("system") == "hard_voting").select("row_id", "true_label", "pred_label")


_SOFT = """
    mean AS (SELECT row_id, true_label, cls, sum(prob ORDER BY system) / count(*) AS prob FROM pred_long GROUP BY ALL)
"""


@query(
    "soft_voting",
    f"""WITH {_SOFT}
    SELECT row_id, cls::INTEGER AS cls, round(prob, 9) AS prob,
           (first_value(cls) OVER (PARTITION BY row_id ORDER BY prob DESC, cls))::INTEGER AS pred_label
    FROM mean
    """,
    "pred_long",
)
def soft_voting(spark, sf_dir):
    both = votes.ensemble(predictions(spark, sf_dir), n_systems=3).where(F.col("system") == "soft_voting")
    return rounded(both.select("row_id", "pred_label", F.posexplode("probs").alias("cls", "prob")))


@query(
    "ensemble_with_priors",
    f"""WITH {_ADJUSTED},
    relabelled AS (SELECT system, row_id, true_label, cls AS pred_label,
                          row_number() OVER (PARTITION BY system, row_id ORDER BY prob DESC, cls) AS place
                   FROM adjusted QUALIFY place = 1),
    {_HARD.format(source='relabelled')}, {_SOFT},
    soft_scaled AS (SELECT m.row_id, m.true_label, m.cls, m.prob * (p.target / greatest(p.train, 1e-8)) AS s
                    FROM mean m JOIN priors p ON m.cls = p.cls),
    soft_prob AS (SELECT *, s / sum(s) OVER (PARTITION BY row_id) AS prob FROM soft_scaled),
    soft AS (SELECT *, first_value(cls) OVER (PARTITION BY row_id ORDER BY prob DESC, cls) AS pred_label
             FROM soft_prob)
    SELECT 'hard_voting' AS system, h.row_id, h.true_label, h.pred_label::INTEGER AS pred_label, c.cls::INTEGER AS cls,
           CASE WHEN h.pred_label = c.cls THEN 1.0::DOUBLE ELSE 0.0 END AS prob
    FROM hard h, (VALUES (0), (1), (2)) c(cls)
    UNION ALL
    SELECT 'soft_voting', row_id, true_label, pred_label::INTEGER, cls::INTEGER, round(prob, 9) FROM soft
    """,
    "pred_long",
)
def ensemble_with_priors(spark, sf_dir):
    both = votes.ensemble(predictions(spark, sf_dir), target=TARGET, train=TRAIN, n_systems=3)
    return rounded(
        both.select("system", "row_id", "true_label", "pred_label", F.posexplode("probs").alias("cls", "prob"))
    )


@query(
    "misaligned_rows",
    """
    SELECT row_id, min(truth)::INTEGER AS lowest_truth, max(truth)::INTEGER AS highest_truth, count(*) AS n_systems
    FROM (SELECT row_id, CASE WHEN system = 'B' AND event_type = 'error' THEN 2 - true_label ELSE true_label END AS truth
          FROM pred WHERE NOT (system = 'C' AND event_type = 'signup'))
    GROUP BY row_id HAVING min(truth) <> max(truth) OR count(*) <> 3
    """,
    "pred",
)
def misaligned_rows(spark, sf_dir):
    """One system lacks the rows of one event type, another carries other truths for a second type."""
    preds = predictions(spark, sf_dir, ("event_type",))
    other = (F.col("system") == "B") & (F.col("event_type") == "error")
    damaged = preds.where(~((F.col("system") == "C") & (F.col("event_type") == "signup"))).withColumn(
        "true_label", F.when(other, 2 - F.col("true_label")).otherwise(F.col("true_label"))
    )
    return votes.misaligned_rows(damaged, 3)


# ---------------------------------------------------------------------------------- curves
@query(
    "roc_points",
    f"""WITH {_AREAS}
    SELECT system, cls::INTEGER AS cls, round(prob, 9) AS threshold, round(fp::DOUBLE / neg, 9) AS fpr,
           round(tp::DOUBLE / pos, 9) AS tpr FROM run
    UNION ALL SELECT DISTINCT system, cls::INTEGER, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM run
    """,
    "pred_long",
)
def roc_points(spark, sf_dir):
    return rounded(curves.roc_points(predictions(spark, sf_dir)))


@query(
    "roc_turns",
    f"""WITH {_AREAS},
    turns AS (SELECT *, lag(tp) OVER w IS NULL OR lead(tp) OVER w IS NULL
                        OR lead(p) OVER w <> p OR lead(q) OVER w <> q AS kept
              FROM run WINDOW w AS (PARTITION BY system, cls ORDER BY prob DESC))
    SELECT system, cls::INTEGER AS cls, round(prob, 9) AS threshold, round(fp::DOUBLE / neg, 9) AS fpr,
           round(tp::DOUBLE / pos, 9) AS tpr FROM turns WHERE kept
    UNION ALL SELECT DISTINCT system, cls::INTEGER, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM run
    """,
    "pred_long",
)
def roc_turns(spark, sf_dir):
    return rounded(curves.roc_points(predictions(spark, sf_dir), collinear=False))


_PR = """
    points AS (SELECT system, cls, prob AS threshold, tp::DOUBLE / (tp + fp) AS prec, tp::DOUBLE / pos AS rec FROM run
               UNION ALL SELECT DISTINCT system, cls, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM run)
"""


@query(
    "pr_points",
    f"""WITH {_AREAS}, {_PR}
    SELECT system, cls::INTEGER AS cls, round(threshold, 9) AS threshold, round(prec, 9) AS precision,
           round(rec, 9) AS recall FROM points
    """,
    "pred_long",
)
def pr_points(spark, sf_dir):
    return rounded(curves.pr_points(predictions(spark, sf_dir)))


_GRID = f"""{_AREAS}, {_PR},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY system, cls ORDER BY rec, threshold DESC NULLS FIRST) AS i FROM points),
    steps AS (SELECT system, cls, s AS step, s / 199.0::DOUBLE AS recall
              FROM (SELECT DISTINCT system, cls FROM points), range(200) r(s)),
    lefts AS (SELECT s.*, (SELECT max(i) FROM numbered n WHERE n.system = s.system AND n.cls = s.cls AND n.rec <= s.recall) AS i
              FROM steps s),
    interp AS (SELECT l.system, l.cls, l.step, l.recall,
                      CASE WHEN b.i IS NULL THEN a.prec
                           ELSE (b.prec - a.prec) / (b.rec - a.rec) * (l.recall - a.rec) + a.prec END AS prec
               FROM lefts l JOIN numbered a ON a.system = l.system AND a.cls = l.cls AND a.i = l.i
               LEFT JOIN numbered b ON b.system = l.system AND b.cls = l.cls AND b.i = l.i + 1)
"""


@query(
    "interpolated_precision",
    f"""WITH {_GRID}
    SELECT system, cls::INTEGER AS cls, step::INTEGER AS step, round(recall, 9) AS recall,
           round(prec, 9) AS precision FROM interp
    """,
    "pred_long",
)
def interpolated_precision(spark, sf_dir):
    return rounded(curves.interpolated_precision(predictions(spark, sf_dir)))


@query(
    "macro_pr_curve",
    f"""WITH {_GRID}
    SELECT system, step::INTEGER AS step, round(max(recall), 9) AS recall, round(avg(prec), 9) AS precision
    FROM interp GROUP BY system, step
    """,
    "pred_long",
)
def macro_pr_curve(spark, sf_dir):
    return rounded(curves.macro_pr_curve(predictions(spark, sf_dir)))


def _with_ensembles(spark, sf_dir):
    preds = predictions(spark, sf_dir)
    return preds.unionByName(votes.ensemble(preds, n_systems=3))


_ALL_LONG = f"""{_HARD.format(source='pred')}, {_SOFT},
    all_long AS (SELECT system, row_id, true_label, cls, prob FROM pred_long
                 UNION ALL SELECT 'hard_voting', h.row_id, h.true_label, c.cls,
                                  CASE WHEN h.pred_label = c.cls THEN 1.0::DOUBLE ELSE 0.0 END
                 FROM hard h, (VALUES (0), (1), (2)) c(cls)
                 UNION ALL SELECT 'soft_voting', row_id, true_label, cls, prob FROM mean)
"""
_ALL_AREAS = _AREAS.replace("pred_long", "all_long")


@query(
    "degenerate_scores",
    f"""WITH {_ALL_LONG},
    k AS (SELECT system, cls, bool_and(prob IN (0.0, 1.0)) AS class_degenerate FROM all_long GROUP BY ALL)
    SELECT system, cls::INTEGER AS cls, class_degenerate,
           bool_and(class_degenerate) OVER (PARTITION BY system) AS system_degenerate FROM k
    """,
    "pred pred_long",
)
def degenerate_scores(spark, sf_dir):
    return curves.degenerate_scores(_with_ensembles(spark, sf_dir))


@query(
    "operating_point",
    f"""WITH {_HARD.format(source='pred')},
    k AS (SELECT c.cls, count(*) FILTER (true_label = cls AND pred_label = cls) AS tp,
                 count(*) FILTER (true_label <> cls AND pred_label = cls) AS fp,
                 count(*) FILTER (true_label <> cls AND pred_label <> cls) AS tn,
                 count(*) FILTER (true_label = cls AND pred_label <> cls) AS fn
          FROM hard, (VALUES (0), (1), (2)) c(cls) GROUP BY c.cls)
    SELECT 'hard_voting' AS system, cls::INTEGER AS cls, tp, fp, tn, fn,
           round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp::DOUBLE / (fp + tn) END, 9) AS fpr,
           round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 9) AS tpr FROM k
    """,
    "pred",
)
def operating_point(spark, sf_dir):
    hard = votes.ensemble(predictions(spark, sf_dir), n_systems=3).where(F.col("system") == "hard_voting")
    return rounded(curves.operating_point(hard))


@query(
    "curve_order",
    f"""WITH {_ALL_LONG}, {_ALL_AREAS},
    k AS (SELECT system, max(ap) FILTER (cls = 0) AS focus_ap, avg(ap) AS mean_ap FROM area
          WHERE system <> 'hard_voting' GROUP BY system)
    SELECT system, round(focus_ap, 9) AS focus_ap, round(mean_ap, 9) AS mean_ap,
           (row_number() OVER (ORDER BY focus_ap, system))::INTEGER AS focus_rank,
           (row_number() OVER (ORDER BY mean_ap, system))::INTEGER AS macro_rank FROM k
    """,
    "pred pred_long",
)
def curve_order(spark, sf_dir):
    return rounded(curves.curve_order(_with_ensembles(spark, sf_dir)))


@query(
    "ensemble_evaluation",
    f"""WITH {_ALL_LONG},
    p AS (SELECT system, row_id, true_label, cls AS pred_label,
                 row_number() OVER (PARTITION BY system, row_id ORDER BY prob DESC, cls) AS place
          FROM all_long QUALIFY place = 1),
    {_MARGINS.replace('FROM pred)', 'FROM p)').replace('JOIN pred p', 'JOIN p')}, {_ALL_AREAS},
    auc AS (SELECT system, avg(roc_auc) AS roc_auc_macro, sum(roc_auc * pos) / sum(pos) AS roc_auc_weighted,
                   avg(ap) AS pr_auc_macro FROM area GROUP BY system)
    SELECT core.system, {', '.join(f'round({c}, 9) AS {c}' for c in _CORE_COLUMNS)},
           round(roc_auc_macro, 9) AS roc_auc_macro, round(roc_auc_weighted, 9) AS roc_auc_weighted,
           round(pr_auc_macro, 9) AS pr_auc_macro
    FROM core JOIN auc ON core.system = auc.system
    """,
    "pred pred_long",
)
def ensemble_evaluation(spark, sf_dir):
    return rounded(metrics.all_metrics(_with_ensembles(spark, sf_dir)))


# ---------------------------------------------------------------------------- significance
@query(
    "signed_correctness",
    """
    SELECT a.row_id, (a.pred_label = a.true_label)::INTEGER - (b.pred_label = b.true_label)::INTEGER AS diff
    FROM pred a JOIN pred b ON a.row_id = b.row_id AND a.system = 'A' AND b.system = 'B'
    """,
    "pred",
)
def signed_correctness(spark, sf_dir):
    preds = predictions(spark, sf_dir).where(F.col("system").isin("A", "B"))
    per_row = preds.groupBy("row_id").agg(
        F.max("true_label").alias("y"),
        F.max(F.when(F.col("system") == "A", F.col("pred_label"))).alias("a"),
        F.max(F.when(F.col("system") == "B", F.col("pred_label"))).alias("b"),
    )
    return per_row.select("row_id", significance.signed_difference(F.col("a"), F.col("b"), F.col("y")).alias("diff"))


_PAIRS = """
    ok AS (SELECT system, row_id, (pred_label = true_label)::INTEGER AS ok FROM pred),
    pairs AS (SELECT a.system AS system_a, b.system AS system_b, count(*) AS n_samples,
                     count(*) FILTER (a.ok > b.ok) AS n_a_better, count(*) FILTER (a.ok < b.ok) AS n_b_better,
                     count(*) FILTER (a.ok = b.ok) AS n_ties
              FROM ok a JOIN ok b ON a.row_id = b.row_id AND a.system < b.system GROUP BY ALL)
"""


@query("system_pairs", f"WITH {_PAIRS} SELECT * FROM pairs", "pred")
def system_pairs(spark, sf_dir):
    return significance.pair_counts(predictions(spark, sf_dir))


_SIGNED_RANK = f"""WITH {_PAIRS},
    t AS (SELECT *, n_a_better AS a, n_b_better AS b, n_a_better + n_b_better AS n FROM pairs),
    u AS (SELECT *, n > 0 AND abs(a - b) / sqrt(n) > 1.959963984540054 AS significant FROM t)
    SELECT system_a || ' vs ' || system_b AS comparison, n_samples, n_a_better, n_b_better, n_ties,
           CASE WHEN n > 0 THEN least(a, b) * (n + 1) / 2.0::DOUBLE END AS statistic, significant,
           CASE WHEN n = 0 THEN '{SAME_PREDICTIONS}' WHEN NOT significant THEN '{NO_DIFFERENCE}'
                WHEN a > b THEN system_a ELSE system_b END AS winner
    FROM u
    """


@query("pairwise_signed_rank", _SIGNED_RANK, "pred")
def pairwise_signed_rank(spark, sf_dir):
    """The p-value is left out: the SQL side has no error function. The tests check it."""
    return significance.pairwise_signed_rank(predictions(spark, sf_dir)).drop("p_value")


def _sql_erfc(z: str, levels: int = 60, terms: int = 40) -> str:
    """Taylor series below 2, from there a continued fraction written out."""
    series = f"1 - 2 / sqrt(pi()) * list_sum([(CASE k % 2 WHEN 0 THEN 1 ELSE -1 END) * pow({z}, 2 * k + 1) / gamma(k + 1.0) / (2 * k + 1) for k in range({terms})])"
    inner = z
    for k in range(levels, 0, -1):
        inner = f"({z} + {k / 2.0}::DOUBLE / {inner})"
    return f"CASE WHEN {z} < 2 THEN {series} ELSE exp(-{z} * {z}) / sqrt(pi()) / {inner} END"


@query(
    "pairwise_p_values",
    f"""WITH {_PAIRS}, z AS (SELECT *, abs(n_a_better - n_b_better) / sqrt(2.0::DOUBLE * (n_a_better + n_b_better)) AS z FROM pairs)
    SELECT system_a || ' vs ' || system_b AS comparison,
           CASE WHEN n_a_better + n_b_better = 0 THEN 1.0::DOUBLE ELSE round({_sql_erfc('z')}, 9) END AS p_value FROM z
    """,
    "pred",
)
def pairwise_p_values(spark, sf_dir):
    return rounded(significance.pairwise_signed_rank(predictions(spark, sf_dir)).select("comparison", "p_value"))


@query(
    "pairwise_exact_p_values",
    f"""WITH {_PAIRS}, t AS (SELECT *, least(n_a_better, n_b_better) AS k, n_a_better + n_b_better AS n FROM pairs)
    SELECT system_a || ' vs ' || system_b AS comparison,
           CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * list_sum(
               [exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0::DOUBLE)) for i in range(k + 1)])), 9) END AS p_value FROM t
    """,
    "pred",
)
def pairwise_exact_p_values(spark, sf_dir):
    """The exact binomial tail of the wins."""
    tested = significance.pairwise_signed_rank(predictions(spark, sf_dir), exact=True)
    return rounded(tested.select("comparison", "p_value"))
