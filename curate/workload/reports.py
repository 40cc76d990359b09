"""Queries over result tables, stored results, losses and training histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from curate.constants import CHART_METRICS, CLASS_NAMES, MAIN_METRICS, focus_metrics
from curate.functions.hashing import draw_int
from curate.functions.naming import short_name, stem_key
from curate.operators import losses, metrics, reporting, significance, training
from curate.session import scratch_path, stored
from curate.sources import metric_files, predictions as sets
from curate.workload.registry import query, rounded
from curate.workload.scores import _AREAS, _CORE_COLUMNS, _MARGINS, _REPORT, _SIGNED_RANK
from curate.workload.views import logits, predictions, sql_int, table

FOLDERS = {"click": "scenario_A", "view": "scenario_B", "purchase": "Scenario_C", "error": "results", "signup": "extra"}
STEMS = {"A": "model-a_metrics", "B": "_model-b-large_metrics", "C": "mixed_vote_predictions"}
BY_FOLDER = {
    "scenario_a": {"model-a": ("A1", "Model A", "A — Baseline"), "model-b": ("A2", "Model B", "A — Baseline")},
    "scenario_b": {"vote": ("B1", "Voting", "B — Ensemble")},
}
FLAT = {"model-a": ("A1", "Model A", "A — Baseline"), "model-b": ("A2", "Model B", "A — Baseline")}
FOLDER_GROUPS = {"scenario_a": "A — Baseline", "scenario_b": "B — Ensemble", "scenario_c": "C — Augmented"}
REGISTRY = {"by_folder": BY_FOLDER, "flat": FLAT, "folder_groups": FOLDER_GROUPS}

METRICS = [m for m, _ in MAIN_METRICS] + [m for m, _ in focus_metrics()]
ALL_METRICS = [*_CORE_COLUMNS, "roc_auc_macro", "roc_auc_weighted", "pr_auc_macro"]


def measured(spark, sf_dir, names=METRICS):
    """Metrics of every system on every event type: ``(folder, stem, system, metrics…)``."""
    preds = predictions(spark, sf_dir, ("event_type",))
    table_ = metrics.all_metrics(preds, ["event_type", "system"])

    def mapped(column, names):
        return F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col(column))

    return table_.select(
        mapped("event_type", FOLDERS).alias("folder"),
        mapped("system", STEMS).alias("stem"),
        F.concat_ws("-", "event_type", "system").alias("system"),
        *names,
    )


_MEASURED = f"""
    tp AS (SELECT event_type || '-' || system AS system, row_id, true_label, pred_label FROM pred),
    tl AS (SELECT event_type || '-' || system AS system, row_id, true_label, cls, prob FROM pred_long),
    {_MARGINS.replace('FROM pred)', 'FROM tp)').replace('JOIN pred p', 'JOIN tp p')}, {_AREAS.replace('FROM pred_long', 'FROM tl')},
    auc AS (SELECT system, avg(roc_auc) AS roc_auc_macro, sum(roc_auc * pos) / sum(pos) AS roc_auc_weighted, avg(ap) AS pr_auc_macro FROM area GROUP BY system),
    measured AS (SELECT CASE string_split(core.system, '-')[1] WHEN 'click' THEN 'scenario_A' WHEN 'view' THEN 'scenario_B'
                             WHEN 'purchase' THEN 'Scenario_C' WHEN 'error' THEN 'results' ELSE 'extra' END AS folder,
                        CASE string_split(core.system, '-')[2] WHEN 'A' THEN 'model-a_metrics' WHEN 'B' THEN '_model-b-large_metrics'
                             ELSE 'mixed_vote_predictions' END AS stem,
                        core.*, roc_auc_macro, roc_auc_weighted, pr_auc_macro
                 FROM core JOIN auc ON core.system = auc.system)
"""
_RULES = [
    (i, folder, key, *entry)
    for i, (folder, key, entry) in enumerate((f, k, e) for f, es in BY_FOLDER.items() for k, e in es.items())
]
_FLAT_RULES = [(i, "", key, *entry) for i, (key, entry) in enumerate(FLAT.items())]


def _values(rows):
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)


_KEY = "regexp_replace(trim(replace(stem, '_metrics', ''), '_'), '_(predictions|metrics|report)$', '')"
_TITLE = r"array_to_string(list_transform(regexp_extract_all(replace(key, '_', ' '), '\p{L}+|[^\p{L}]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"
_SCENARIO = f"""{_MEASURED},
    keyed AS (SELECT *, {_KEY} AS key, lower(folder) AS lf FROM measured),
    fr AS (SELECT * FROM (VALUES {_values(_RULES)}) f(pos, folder, name, scenario, method, grp)),
    fl AS (SELECT * FROM (VALUES {_values(_FLAT_RULES)}) f(pos, folder, name, scenario, method, grp)),
    hits AS (SELECT k.system, 1 AS prio, pos, r.scenario, r.method, r.grp, 'folder_exact' AS match_kind FROM keyed k JOIN fr r ON r.folder = lf AND r.name = key
             UNION ALL SELECT k.system, 2, pos, r.scenario, r.method, r.grp, 'folder_part' FROM keyed k JOIN fr r ON r.folder = lf AND contains(key, r.name)
             UNION ALL SELECT k.system, 3, pos, r.scenario, r.method, r.grp, 'flat_exact' FROM keyed k JOIN fl r ON r.name = key
             UNION ALL SELECT k.system, 4, pos, r.scenario, r.method, r.grp, 'flat_part' FROM keyed k JOIN fl r ON contains(key, r.name)
             UNION ALL SELECT k.system, 5, 0, '??', {_TITLE},
                    CASE lf WHEN 'scenario_a' THEN 'A — Baseline' WHEN 'scenario_b' THEN 'B — Ensemble' WHEN 'scenario_c' THEN 'C — Augmented' ELSE 'Unknown' END, 'none'
             FROM keyed k),
    best AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY prio, pos) AS rn FROM hits QUALIFY rn = 1),
    found AS (SELECT k.*, b.scenario, b.method, b.grp AS "group", b.match_kind FROM keyed k JOIN best b ON k.system = b.system)
"""


def found(spark, sf_dir):
    return reporting.with_scenario(measured(spark, sf_dir), **REGISTRY)


@query(
    "scenario_lookup",
    f'WITH {_SCENARIO} SELECT folder, stem, system, scenario, method, "group", match_kind FROM found',
    "pred pred_long",
)
def scenario_lookup(spark, sf_dir):
    return found(spark, sf_dir).select("folder", "stem", "system", "scenario", "method", "group", "match_kind")


_MAIN = ", ".join(f'round({m}, 9) AS "{t}"' for m, t in MAIN_METRICS)
_FOCUS = ", ".join(f'round({m}, 9) AS "{t}"' for m, t in (*MAIN_METRICS[:4], *focus_metrics()))


@query("main_table", f'WITH {_SCENARIO} SELECT scenario, method, "group", {_MAIN} FROM found', "pred pred_long")
def main_table(spark, sf_dir):
    full = reporting.main_table(found(spark, sf_dir))
    titles = [t for _, t in MAIN_METRICS]
    return full.select("scenario", "method", "group", *[F.round(F.col(f"`{t}`"), 9).alias(t) for t in titles])


@query("focus_table", f'WITH {_SCENARIO} SELECT scenario, method, "group", {_FOCUS} FROM found', "pred pred_long")
def focus_table(spark, sf_dir):
    full = reporting.focus_table(found(spark, sf_dir))
    titles = [t for _, t in (*MAIN_METRICS[:4], *focus_metrics())]
    return full.select("scenario", "method", "group", *[F.round(F.col(f"`{t}`"), 9).alias(t) for t in titles])


@query(
    "table_order",
    f"""WITH {_SCENARIO},
    t AS (SELECT system, scenario, method || ' ' || folder AS method, "group" FROM found)
    SELECT *, (row_number() OVER w)::INTEGER AS position, coalesce(lag("group") OVER w <> "group", false) AS new_group
    FROM t WINDOW w AS (ORDER BY "group", scenario, method)
    """,
    "pred pred_long",
)
def table_order(spark, sf_dir):
    rows = found(spark, sf_dir).withColumn("method", F.concat_ws(" ", "method", "folder"))
    return reporting.in_table_order(rows.select("system", "scenario", "method", "group"))


_CHART = ", ".join(CHART_METRICS)


@query(
    "chart_data",
    f"""WITH {_MEASURED}, long AS (UNPIVOT (SELECT system, {_CHART} FROM measured) ON {_CHART} INTO NAME metric VALUE value)
    SELECT system, metric, round(coalesce(value, 0), 9) AS value FROM long
    """,
    "pred pred_long",
)
def chart_data(spark, sf_dir):
    return rounded(reporting.melted(measured(spark, sf_dir), ["system"], CHART_METRICS, 0.0))


@query(
    "best_in_column",
    f"""WITH {_MEASURED}, long AS (UNPIVOT (SELECT system, {_CHART} FROM measured) ON {_CHART} INTO NAME metric VALUE value)
    SELECT system, metric, printf('%.4f', value) AS cell, value = max(value) OVER (PARTITION BY metric) AS is_best FROM long
    """,
    "pred pred_long",
)
def best_in_column(spark, sf_dir):
    flags = reporting.best_flags(measured(spark, sf_dir), ["system"], CHART_METRICS)
    return flags.select("system", "metric", "cell", "is_best")


@query(
    "comparison_table",
    f"""WITH {_MEASURED} SELECT system AS model, {', '.join(f"coalesce(printf('%.4f', {m}), 'N/A') AS {m}" for m in METRICS)} FROM measured""",
    "pred pred_long",
)
def comparison_table(spark, sf_dir):
    return reporting.comparison_table(measured(spark, sf_dir), METRICS)


@query(
    "model_ranking",
    f"""WITH {_MEASURED}
    SELECT system, round(f1_macro, 9) AS f1_macro, round(f1_weighted, 9) AS f1_weighted,
           (row_number() OVER (ORDER BY f1_macro DESC, f1_weighted DESC, system))::INTEGER AS position FROM measured
    """,
    "pred pred_long",
)
def model_ranking(spark, sf_dir):
    ranked = reporting.rank_models(measured(spark, sf_dir))
    return rounded(ranked.select("system", "f1_macro", "f1_weighted", "position"))


@query(
    "stem_keys",
    "SELECT page_id, regexp_replace(trim(replace(stem, '_metrics', ''), '_'), '_(predictions|metrics|report)$', '') AS key "
    "FROM (SELECT page_id, '_' || replace(url, '/', '_') || CASE page_id % 3 WHEN 0 THEN '_metrics' WHEN 1 THEN '_report' ELSE '_' END AS stem FROM pages)",
)
def stem_keys(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    ending = F.when(F.col("page_id") % 3 == 0, "_metrics").when(F.col("page_id") % 3 == 1, "_report").otherwise("_")
    stem = F.concat(F.lit("_"), F.replace("url", F.lit("/"), F.lit("_")), ending)
    return pages.select("page_id", stem_key(stem).alias("key"))


@query(
    "short_names",
    "SELECT page_id, replace(replace(url, 'http://', ''), '.example', '') AS label FROM pages",
)
def short_names(spark, sf_dir):
    rules = (("http://", ""), (".example", ""))
    return table(spark, sf_dir, "pages").select("page_id", short_name(F.col("url"), rules).alias("label"))


# --------------------------------------------------------------------------- stored results
_WIDE = """SELECT system, row_id, true_label, pred_label::INTEGER AS pred_label, {0} FROM
    (SELECT p.system, p.row_id, p.true_label, p.pred_label,
            max(l.prob) FILTER (l.cls = 0) AS p0, max(l.prob) FILTER (l.cls = 1) AS p1, max(l.prob) FILTER (l.cls = 2) AS p2
     FROM pred p JOIN pred_long l ON l.system = p.system AND l.row_id = p.row_id GROUP BY ALL)"""


@query(
    "wide_predictions",
    _WIDE.format(", ".join(f"round(p{i}, 9) AS prob_{n}" for i, n in enumerate(CLASS_NAMES))),
    "pred pred_long",
)
def wide_predictions(spark, sf_dir):
    return rounded(sets.wide(predictions(spark, sf_dir)))


def _read_back(spark, sf_dir, format):
    """Systems A and B in a folder, C in the root, plus a set without predicted labels."""
    root = scratch_path(spark, "sets")
    preds = predictions(spark, sf_dir)
    text = F.format_string('say "%s", then\nleave', F.col("row_id"))
    named = preds.withColumn("text", text).withColumn("system", F.when(F.col("system") == "C", "C").otherwise(F.concat(F.lit("run/"), "system")))
    sets.write_predictions(stored(named, "named"), root, ["run/A", "run/B", "C"], format)
    other = preds.where("system = 'A'").select("row_id", "true_label")
    other.write.option("header", True).format(format).save(f"{root}/truth_predictions.{format}")
    return sets.read_predictions(spark, root)


_NAMED = "CASE system WHEN 'C' THEN 'C' ELSE 'run/' || system END"


@query(
    "prediction_sets_csv",
    f"""SELECT {_NAMED} AS system, row_id, 'say "' || row_id || '", then' || chr(10) || 'leave' AS text, true_label,
               pred_label, prob_{CLASS_NAMES[0]}, prob_{CLASS_NAMES[1]}, prob_{CLASS_NAMES[2]}
        FROM ({_WIDE.format(", ".join(f"round(p{i}, 9) AS prob_{n}" for i, n in enumerate(CLASS_NAMES)))})""",
    "pred pred_long",
)
def prediction_sets_csv(spark, sf_dir):
    return rounded(sets.wide(_read_back(spark, sf_dir, "csv")))


@query(
    "prediction_sets_parquet",
    f"SELECT {_NAMED} AS system, row_id, cls::INTEGER AS cls, round(prob, 9) AS prob FROM pred_long",
    "pred_long",
)
def prediction_sets_parquet(spark, sf_dir):
    back = _read_back(spark, sf_dir, "parquet")
    return rounded(back.select("system", "row_id", F.posexplode("probs").alias("cls", "prob")))


@query("truth_of_first_system", "SELECT row_id, true_label FROM pred WHERE system = 'A'", "pred")
def truth_of_first_system(spark, sf_dir):
    return sets.truth(_read_back(spark, sf_dir, "parquet"))


@query(
    "consolidated_scenarios",
    """
    SELECT 'one_' || system AS system, row_id, true_label, pred_label::INTEGER AS pred_label FROM pred
    UNION ALL SELECT 'two_' || system, row_id, true_label, pred_label::INTEGER FROM pred WHERE system <> 'C'
    """,
    "pred",
)
def consolidated_scenarios(spark, sf_dir):
    preds = predictions(spark, sf_dir).drop("probs")
    return sets.consolidated({"one": preds, "two": preds.where("system <> 'C'")})


_REGISTERED = {"first": "A", "third": "C", "lost": "Z"}


@query(
    "registered_systems",
    "SELECT CASE system WHEN 'A' THEN 'first' ELSE 'third' END AS key, system, row_id, pred_label::INTEGER AS pred_label FROM pred WHERE system IN ('A', 'C')",
    "pred",
)
def registered_systems(spark, sf_dir):
    rows = sets.registered(predictions(spark, sf_dir), _REGISTERED)
    return rows.select("key", "system", "row_id", "pred_label")


@query(
    "registered_under_several_keys",
    """SELECT key, system, row_id, pred_label::INTEGER AS pred_label
       FROM (VALUES ('first', 'A'), ('again', 'A'), ('third', 'C'), ('lost', 'Z')) r(key, system) JOIN pred USING (system)""",
    "pred",
)
def registered_under_several_keys(spark, sf_dir):
    rows = sets.registered(predictions(spark, sf_dir), _REGISTERED | {"again": "A"})
    return rows.select("key", "system", "row_id", "pred_label")


@query(
    "missing_systems",
    "SELECT key, system FROM (VALUES ('first', 'A'), ('third', 'C'), ('lost', 'Z')) r(key, system) WHERE system NOT IN (SELECT system FROM pred)",
    "pred",
)
def missing_systems(spark, sf_dir):
    return sets.missing_systems(predictions(spark, sf_dir), _REGISTERED)


@query(
    "metric_files",
    f"""WITH {_MEASURED} SELECT folder, trim(replace(stem, '_metrics', ''), '_') || '_metrics' AS stem, {', '.join(f'round({m}, 9) AS {m}' for m in ALL_METRICS)} FROM measured""",
    "pred pred_long",
)
def metric_files_back(spark, sf_dir):
    root = scratch_path(spark, "records")
    rows = measured(spark, sf_dir, ALL_METRICS).withColumn("stem", F.btrim(F.replace("stem", F.lit("_metrics"), F.lit("")), F.lit("_")))
    metric_files.write_metrics(rows.drop("system"), root)
    return rounded(metric_files.read_metrics(spark, root, ALL_METRICS))


@query(
    "aggregate_record",
    f"""WITH {_MEASURED} SELECT system, {', '.join(f'round({m}, 9) AS {m}' for m in ALL_METRICS)} FROM measured""",
    "pred pred_long",
)
def aggregate_record(spark, sf_dir):
    path = scratch_path(spark, "aggregate")
    metric_files.write_aggregate(measured(spark, sf_dir, ALL_METRICS).drop("folder", "stem"), path)
    return rounded(metric_files.read_aggregate(spark, path, ALL_METRICS))


@query("stored_report", _REPORT, "pred")
def stored_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    report = metrics.classification_report(predictions(spark, sf_dir))
    metric_files.write_report(report, path)
    schema = "system STRING, line INT, label STRING, precision DOUBLE, recall DOUBLE, f1 DOUBLE, support BIGINT"
    return rounded(spark.read.schema(schema).option("header", True).csv(path))


@query(
    "test_summary",
    f"""SELECT 0.05::DOUBLE AS alpha, 3 AS n_systems, 'A,B,C' AS systems, 3::BIGINT AS n_pairs, t.* FROM ({_SIGNED_RANK}) t""",
    "pred",
)
def test_summary(spark, sf_dir):
    tests = significance.pairwise_signed_rank(predictions(spark, sf_dir))
    text = metric_files.test_summary(tests, ["A", "B", "C"])
    pair = ", ".join(f"{c}: {t}" for c, t in tests.dtypes if c != "p_value")
    shape = f"alpha DOUBLE, n_systems INT, systems ARRAY<STRING>, n_pairs BIGINT, results ARRAY<STRUCT<{pair}>>"
    read = text.select(F.from_json("value", shape).alias("s"))
    whole = ("s.alpha", "s.n_systems", F.array_join("s.systems", ",").alias("systems"), "s.n_pairs")
    return read.select(*whole, F.inline("s.results"))


# ------------------------------------------------------------------------ losses, histories
_LOSS_WEIGHTS = (2.5, 0.4, 1.7)
_LOSS = f"""
    terms AS (SELECT system, row_id, true_label, -ln(max(prob) FILTER (cls = true_label)) AS ce,
                     CASE true_label WHEN 0 THEN 2.5::DOUBLE WHEN 1 THEN 0.4 ELSE 1.7 END AS w,
                     CASE WHEN {sql_int("'s:'", "row_id")} % 4 = 0 THEN 0.2::DOUBLE ELSE 1 END AS s
              FROM pred_long GROUP BY ALL)
"""


def _loss_rows(spark, sf_dir):
    return logits(spark, sf_dir).withColumn("is_synthetic", draw_int(F.lit("s:"), F.col("row_id")) % 4 == 0)


@query(
    "weighted_cross_entropy",
    f"WITH {_LOSS} SELECT system, round(sum(w * s * ce) / (sum(w * s) + 1e-8), 9) AS loss FROM terms GROUP BY system",
    "pred_long",
)
def weighted_cross_entropy(spark, sf_dir):
    return rounded(losses.weighted_cross_entropy(_loss_rows(spark, sf_dir), ["system"], _LOSS_WEIGHTS, 0.2))


@query(
    "class_weighted_cross_entropy",
    f"WITH {_LOSS} SELECT system, round(sum(w * ce) / sum(w), 9) AS loss FROM terms GROUP BY system",
    "pred_long",
)
def class_weighted_cross_entropy(spark, sf_dir):
    return rounded(losses.weighted_cross_entropy(_loss_rows(spark, sf_dir), ["system"], _LOSS_WEIGHTS))


@query(
    "validation_loss",
    f"""WITH {_LOSS}, b AS (SELECT system, row_id // 32 AS batch, sum(w * ce) AS a, sum(w) AS w FROM terms GROUP BY ALL)
    SELECT system, round(avg(a / w), 9) AS batched_loss, round(sum(a) / sum(w), 9) AS loss FROM b GROUP BY system
    """,
    "pred_long",
)
def validation_loss(spark, sf_dir):
    return rounded(losses.validation_loss(_loss_rows(spark, sf_dir), ["system"], _LOSS_WEIGHTS))


RUN_EPOCHS = 60


def histories(spark, sf_dir):
    """Runs of 60 consecutive events, one event per epoch, its value as the score."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(key / RUN_EPOCHS).alias("run"), (key % RUN_EPOCHS + 1).alias("epoch"), F.col("value").alias("score")
    )


_HISTORY = "h AS (SELECT event_id // 60 AS run, event_id % 60 + 1 AS epoch, value AS score FROM events)"


@query(
    "best_epoch",
    f"WITH {_HISTORY} SELECT run, first(epoch ORDER BY score DESC, epoch) AS best_epoch, max(score) AS best_score FROM h GROUP BY run",
)
def best_epoch(spark, sf_dir):
    return training.best_epoch(histories(spark, sf_dir))


@query(
    "early_stop",
    f"""WITH RECURSIVE {_HISTORY},
    st AS (SELECT run, epoch, score AS best, epoch AS last, 0 AS counter, false AS stopped FROM h WHERE epoch = 1
           UNION ALL
           SELECT h.run, h.epoch, CASE WHEN h.score > st.best + 1.5 THEN h.score ELSE st.best END,
                  CASE WHEN h.score > st.best + 1.5 THEN h.epoch ELSE st.last END,
                  CASE WHEN h.score > st.best + 1.5 THEN 0 ELSE st.counter + 1 END,
                  NOT h.score > st.best + 1.5 AND st.counter + 1 >= 12
           FROM st JOIN h ON h.run = st.run AND h.epoch = st.epoch + 1 WHERE NOT st.stopped),
    ends AS (SELECT run, max(epoch) AS epochs FROM h GROUP BY run)
    SELECT st.run, e.epochs, max(st.epoch) FILTER (stopped) AS stop_epoch,
           last(st.last ORDER BY st.epoch) AS last_best_epoch, last(st.best ORDER BY st.epoch) AS last_best_score
    FROM st JOIN ends e ON e.run = st.run GROUP BY st.run, e.epochs
    """,
)
def early_stop(spark, sf_dir):
    return training.early_stop(histories(spark, sf_dir), patience=12, min_delta=1.5)


@query(
    "training_histories",
    f"WITH {_HISTORY} SELECT run, epoch, score AS train_loss, score / 2 AS val_loss, score + 1 AS val_f1_macro FROM h",
)
def training_histories(spark, sf_dir):
    path = scratch_path(spark, "histories")
    full = histories(spark, sf_dir).select(
        "run", "epoch", F.col("score").alias("train_loss"), (F.col("score") / 2).alias("val_loss"), (F.col("score") + 1).alias("val_f1_macro")
    )
    metric_files.write_histories(full, path)
    return metric_files.read_histories(spark, path)
