"""Queries that fit models: clusters and naive Bayes with SQL of the same steps, Spark ML models without."""

from __future__ import annotations

from pyspark.sql import functions as F

from curate.operators import bayes, clustering, lloyd, metrics, models, vectors as vec
from curate.operators.split import stratified_split
from curate.plans.scenarios import run_scenarios
from curate.session import stored
from curate.workload.rebalancing import (
    _ANCHORS, _CENTERS, LOOSE, _category, _centers_and_anchors, _sql_cosine, real_rows, rebalance_candidates,
)
from curate.workload.registry import query, rounded
from curate.workload.texts import SPLIT, sql_strip
from curate.workload.views import corpus, vectors


# ---------------------------------------------------------------------------------- clusters
def _sql_lloyd(low: int, high: int, starts: int = lloyd.STARTS, steps: int = lloyd.STEPS) -> str:
    """``best(k, s)``, ``placed(vec_id, u, k, s, cluster, gap)`` and ``c{steps}(k, s, cluster, c)`` of all runs, step by step.

    Gaps leave out the length of the vector, which is the same for every centre.
    """
    parts = [f"""
    units AS MATERIALIZED (SELECT vec_id, [x / greatest(sqrt(list_dot_product(v, v)), 1e-8) for x in v] AS u FROM vectors),
    firsts AS (SELECT u, row_number() OVER (ORDER BY place) - 1 AS i, count(*) OVER () AS n
               FROM (SELECT u, min({{'key': md5(concat('42', ':', vec_id)), 'id': vec_id}}) AS place FROM units GROUP BY u)
               ORDER BY place LIMIT {starts * high}),
    runs AS (SELECT k, s, cluster FROM range({low}, {high + 1}) a(k), range({starts}) b(s), range({high}) d(cluster) WHERE cluster < k),
    c0 AS MATERIALIZED (SELECT k, s, cluster, u AS c FROM runs JOIN firsts
                        ON i = (cluster + s * {high}) % least(n, {starts * high}))"""]
    for t in range(steps + 1):
        parts.append(f"""
    a{t} AS MATERIALIZED (SELECT vec_id, k, s, arg_min(cluster, (gap, cluster)) AS cluster, min(gap) AS gap
               FROM (SELECT vec_id, k, s, cluster, list_dot_product(c, c) - 2 * list_dot_product(u, c) AS gap FROM units, c{t}) GROUP BY ALL)""")
        if t < steps:
            parts.append(f"""
    m{t} AS (SELECT k, s, cluster, list(x ORDER BY d) AS c
             FROM (SELECT k, s, cluster, d, avg(x) AS x
                   FROM (SELECT k, s, cluster, generate_subscripts(u, 1) AS d, unnest(u) AS x FROM a{t} JOIN units USING (vec_id)) GROUP BY ALL) GROUP BY ALL),
    c{t + 1} AS MATERIALIZED (SELECT k, s, cluster, coalesce(m.c, o.c) AS c FROM c{t} o LEFT JOIN m{t} m USING (k, s, cluster))""")
    parts.append(f"""
    best AS (SELECT k, arg_min(s, (round(cost, 9), s)) AS s
             FROM (SELECT k, s, sum(greatest(gap + list_dot_product(u, u), 0)) AS cost FROM a{steps} JOIN units USING (vec_id) GROUP BY ALL) GROUP BY k),
    placed AS MATERIALIZED (SELECT vec_id, u, k, cluster FROM a{steps} JOIN best USING (k, s) JOIN units USING (vec_id))""")
    return ",".join(parts)


_SILHOUETTE = """
    sums AS MATERIALIZED (SELECT k, cluster, any_value(n) AS n, list(x ORDER BY d) AS y
             FROM (SELECT k, cluster, d, sum(x) AS x, count(*) AS n
                   FROM (SELECT k, cluster, generate_subscripts(u, 1) AS d, unnest(u) AS x FROM placed) GROUP BY ALL) GROUP BY ALL),
    means AS (SELECT p.vec_id, p.k, p.cluster, s.cluster AS other, s.n, 1 - list_dot_product(p.u, s.y) / s.n AS far FROM placed p JOIN sums s USING (k)),
    sides AS (SELECT vec_id, k, max(n) FILTER (other = cluster) AS n, max(far * n / greatest(n - 1, 1)) FILTER (other = cluster) AS a,
                     min(far) FILTER (other <> cluster) AS b FROM means GROUP BY ALL),
    judged AS (SELECT k, avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM sides GROUP BY k)
"""


@query(
    "cluster_silhouettes",
    f"WITH {_sql_lloyd(2, 10)}, {_SILHOUETTE} SELECT k, round(silhouette, 9) AS silhouette FROM judged",
    "vectors",
)
def cluster_silhouettes(spark, sf_dir):
    """The cosine silhouette of every number of clusters, all fitted together."""
    units, fitted = lloyd.fit_all(vectors(spark, sf_dir), range(2, 11), "vec_id")
    return rounded(spark.createDataFrame(sorted(lloyd.silhouettes(units, fitted).items()), "k long, silhouette double"))


@query(
    "chosen_cluster_count",
    f"""WITH {_sql_lloyd(2, 10)}, {_SILHOUETTE}
    SELECT cluster::INTEGER AS cluster, count(*) AS count, k::INTEGER AS k FROM placed
    WHERE k = (SELECT arg_max(k, (round(silhouette, 9), -k)) FROM judged) GROUP BY ALL
    """,
    "vectors",
)
def chosen_cluster_count(spark, sf_dir):
    """Cluster sizes at the number of clusters the silhouette prefers."""
    k, units, centres = clustering.choose_k(vectors(spark, sf_dir), k_range=(2, 10), row_id="vec_id")
    return lloyd.assigned(units, centres).groupBy("cluster").count().withColumn("k", F.lit(k))


def _sql_names(pairs: str) -> str:
    """``named(cluster, cluster_name)`` from ``pairs(cluster, category, category_pos, similarity)``, one pair after another.

    A pair counts if its cluster has no name and its category is free; categories are used up if there are
    enough of them.
    """
    return f"""
    ranked AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, cluster DESC, category_pos DESC) AS i,
                      (SELECT count(DISTINCT cluster) <= count(DISTINCT category) FROM {pairs}) AS once FROM {pairs}),
    walk AS (SELECT 0::BIGINT AS i, []::INTEGER[] AS clusters, []::VARCHAR[] AS categories
             UNION ALL
             SELECT r.i, CASE WHEN taken THEN clusters ELSE list_append(clusters, cluster) END, CASE WHEN taken THEN categories ELSE list_append(categories, category) END
             FROM (SELECT r.i, clusters, categories, r.cluster, r.category,
                          list_contains(clusters, r.cluster) OR (once AND list_contains(categories, r.category)) AS taken
                   FROM walk w JOIN ranked r ON r.i = w.i + 1) r),
    named AS (SELECT unnest(clusters) AS cluster, unnest(categories) AS cluster_name FROM walk WHERE i = (SELECT max(i) FROM ranked))
    """


@query(
    "cluster_texts",
    f"""WITH RECURSIVE {_sql_lloyd(5, 5)}, {_ANCHORS},
    pairs AS (SELECT cluster::INTEGER AS cluster, category, row_number() OVER (PARTITION BY cluster ORDER BY category) AS category_pos, {_sql_cosine('c', 'a')} AS similarity
              FROM c{lloyd.STEPS} JOIN best USING (k, s), anchors),
    {_sql_names('pairs')}
    SELECT vec_id, p.cluster::INTEGER AS cluster, cluster_name FROM placed p LEFT JOIN named n ON n.cluster = p.cluster
    """,
    "vectors",
)
def cluster_texts(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    anchors = vec.centroids(rows.withColumn("category", _category()), ["category"])
    named = clustering.cluster_texts(
        rows.drop("cluster_name"), anchors.withColumnRenamed("centroid", "embedding"), k=5, row_id="vec_id"
    )
    return named.select("vec_id", "cluster", "cluster_name")


@query(
    "cluster_names",
    f"""WITH RECURSIVE {_CENTERS}, {_ANCHORS},
    pairs AS (SELECT substr(cluster_name, 2)::INTEGER AS cluster, category, row_number() OVER (PARTITION BY cluster_name ORDER BY category) AS category_pos,
                     {_sql_cosine('c', 'a')} AS similarity FROM centers, anchors),
    {_sql_names('pairs')}
    SELECT 'all' AS class, cluster, cluster_name FROM named
    """,
    "vectors",
)
def cluster_names(spark, sf_dir):
    """Ten given clusters over five categories, so categories are used more than once."""
    _, centers, anchors = _centers_and_anchors(spark, sf_dir)
    numbered = centers.select(
        F.lit("all").alias("class"), F.substring("cluster", 2, 9).cast("int").alias("cluster"), "centroid"
    )
    return clustering.name_clusters(numbered, anchors)


@query(
    "cluster_names_once",
    f"""WITH RECURSIVE {_CENTERS}, {_ANCHORS},
    pairs AS (SELECT substr(category, 2)::INTEGER AS cluster, cluster_name AS category, row_number() OVER (PARTITION BY category ORDER BY cluster_name) AS category_pos,
                     {_sql_cosine('a', 'c')} AS similarity FROM centers, anchors),
    {_sql_names('pairs')}
    SELECT 'all' AS class, cluster, cluster_name FROM named
    """,
    "vectors",
)
def cluster_names_once(spark, sf_dir):
    """Five clusters over ten categories, each of which is used once at most."""
    _, centers, anchors = _centers_and_anchors(spark, sf_dir)
    clusters = anchors.select(F.lit("all").alias("class"), F.substring("category", 2, 9).cast("int").alias("cluster"), F.col("embedding").alias("centroid"))
    return clustering.name_clusters(clusters, centers.select(F.col("cluster").alias("category"), F.col("centroid").alias("embedding")))


# ------------------------------------------------------------------------------- naive Bayes
_TOKENS = rf"CASE WHEN {sql_strip('lower(text)')} = '' THEN [] ELSE string_split_regex({sql_strip('lower(text)')}, '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+') END"
_BAYES = f"""{SPLIT},
    weights AS (SELECT label, sum(count(*)) OVER () / (3.0::DOUBLE * count(*)) AS w FROM split WHERE split = 'train' GROUP BY label),
    found AS MATERIALIZED (SELECT row_id, label, split, word, count(*) AS n FROM (SELECT row_id, label, split, unnest({_TOKENS}) AS word FROM split) GROUP BY ALL),
    vocab AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS count, row_number() OVER (ORDER BY sum(n) DESC, word) - 1 AS number FROM found WHERE split = 'train' GROUP BY word),
    mass AS MATERIALIZED (SELECT word, label, sum(n * w) AS m FROM found JOIN weights USING (label) WHERE split = 'train' GROUP BY ALL),
    classes AS (SELECT c AS label, coalesce((SELECT sum(m) FROM mass WHERE mass.label = c), 0) + (SELECT count(*) FROM vocab) AS whole FROM range(3) r(c)),
    probs AS MATERIALIZED (SELECT word, c.label, ln((coalesce(m, 0) + 1) / whole) AS p FROM vocab CROSS JOIN classes c LEFT JOIN mass USING (word, label)),
    prior AS (SELECT label, ln(sum(w) / sum(sum(w)) OVER ()) AS p FROM split JOIN weights USING (label) WHERE split = 'train' GROUP BY label)
"""


@query("bayes_vocabulary", f"WITH {_BAYES} SELECT word, count, number FROM vocab", "corpus")
def bayes_vocabulary(spark, sf_dir):
    """The words of the training texts with their counts and numbers."""
    train = stratified_split(corpus(spark, sf_dir)).where("split = 'train'")
    return bayes.vocabulary(bayes.counted_words(train, ["row_id"]))


@query(
    "bayes_scores",
    f"""WITH {_BAYES},
    sums AS (SELECT f.row_id, p.label AS cls, sum(f.n * p.p) AS s FROM found f JOIN probs p USING (word) WHERE split <> 'train' GROUP BY ALL),
    logits AS (SELECT t.row_id, t.label AS true_label, q.label AS cls, coalesce(s.s, 0) + q.p AS l
               FROM (SELECT * FROM split WHERE split <> 'train') t CROSS JOIN prior q LEFT JOIN sums s ON s.row_id = t.row_id AND s.cls = q.label),
    scaled AS (SELECT *, exp(l - max(l) OVER (PARTITION BY row_id)) AS e FROM logits),
    done AS (SELECT *, e / sum(e) OVER (PARTITION BY row_id) AS prob FROM scaled)
    SELECT 'bayes' AS system, row_id, true_label::INTEGER AS true_label,
           (first_value(cls) OVER (PARTITION BY row_id ORDER BY prob DESC, cls))::INTEGER AS pred_label, cls::INTEGER AS cls, round(prob, 9) AS prob
    FROM done
    """,
    "corpus",
)
def bayes_scores(spark, sf_dir):
    """Weighted naive Bayes, learnt from the train split, on all other rows."""
    split = stored(stratified_split(corpus(spark, sf_dir)), "split")
    model = bayes.fit(models.weighted_rows(split.where("split = 'train'")))
    scored = bayes.score(model, split.where("split <> 'train'"))
    return rounded(scored.select("system", "row_id", "true_label", "pred_label", F.posexplode("probs").alias("cls", "prob")))


def _trained(spark, sf_dir):
    split = stored(stratified_split(corpus(spark, sf_dir)), "split")
    fitted = models.train_classifiers(split.where("split = 'train'"))
    return split, fitted


@query("train_classifiers")
def train_classifiers(spark, sf_dir):
    """Validation metrics of every trained model, and which one is chosen."""
    split, fitted = _trained(spark, sf_dir)
    val = stored(models.score(fitted, split.where("split = 'val'")), "val")
    return metrics.core_metrics(val).withColumn("chosen", F.col("system") == models.best_model(val))


@query("score_models")
def score_models(spark, sf_dir):
    split, fitted = _trained(spark, sf_dir)
    return models.score(fitted, split.where("split = 'test'"))


@query("scenario_jobs")
def scenario_jobs(spark, sf_dir):
    preds = stored(
        run_scenarios(real_rows(spark, sf_dir), rebalance_candidates(spark, sf_dir), LOOSE), "scenarios"
    )
    return metrics.all_metrics(preds)
