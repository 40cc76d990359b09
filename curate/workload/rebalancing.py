"""Queries over candidate texts, vectors and the rebalancing plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from curate import constants as C
from curate.functions.hashing import draw_int
from curate.functions.text import clean_line
from curate.functions.vectors import cosine
from curate.operators import balance, candidates as cand, gate, sampling, vectors as vec
from curate.plans import rebalance
from curate.session import stored
from curate.workload.registry import query, rounded
from curate.workload.texts import sql_clean_line, sql_strip
from curate.workload.views import (
    candidate_lines,
    candidates,
    corpus,
    seen_texts,
    sql_int,
    table,
    vectors,
)

THRESHOLD = 0.45
LOOSE = 0.15
STRICT = 0.25

_REJECTED = "".join(
    f" WHEN regexp_matches(lower(text), '{pattern.replace(chr(39), chr(39) * 2)}') THEN '{reason}'" for reason, pattern in C.REJECTED.items()
)
REASON = f"CASE WHEN text = '' THEN 'empty' WHEN length(text) NOT BETWEEN {C.MIN_CHARS} AND {C.MAX_CHARS} THEN 'length'{_REJECTED} END"
CLEANED = f"cleaned AS (SELECT *, {sql_clean_line('raw')} AS text FROM candidates)"


# ------------------------------------------------------------------------- candidate filters
@query("reject_reasons", f"WITH {CLEANED} SELECT doc_id, pos, {REASON} AS reason FROM cleaned", "candidates")
def reject_reasons(spark, sf_dir):
    cleaned = clean_line(F.col("raw"))
    return candidates(spark, sf_dir).select("doc_id", "pos", cand.reject_reason(cleaned).alias("reason"))


@query(
    "filter_candidates",
    f"""WITH {CLEANED}, valid AS (SELECT * FROM cleaned WHERE {REASON} IS NULL),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id, pos) AS rn FROM valid)
    SELECT doc_id, pos, class, cluster_name, text FROM firsts
    WHERE rn = 1 AND lower(text) NOT IN (SELECT lower(text) FROM benchmark)
    """,
    "candidates",
)
def filter_candidates(spark, sf_dir):
    kept = cand.filter_candidates(candidates(spark, sf_dir), ["doc_id", "pos"], seen_texts(spark, sf_dir))
    return kept.select("doc_id", "pos", "class", "cluster_name", "text")


@query(
    "deduplicate_lines",
    f"""WITH {CLEANED},
    firsts AS (SELECT *, row_number() OVER (PARTITION BY lower({sql_strip('raw')}) ORDER BY doc_id, pos) AS rn FROM candidates)
    SELECT doc_id, pos, raw FROM firsts WHERE rn = 1
    """,
    "candidates",
)
def deduplicate_lines(spark, sf_dir):
    rows = candidates(spark, sf_dir).select("doc_id", "pos", "raw")
    return cand.deduplicate(rows, ["doc_id", "pos"], "raw")


@query(
    "exclude_seen",
    f"""WITH {CLEANED} SELECT doc_id, pos, text FROM cleaned
    WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE lower(b.text) = lower(cleaned.text))""",
    "candidates",
)
def exclude_seen(spark, sf_dir):
    cleaned = candidates(spark, sf_dir).select("doc_id", "pos", clean_line(F.col("raw")).alias("text"))
    return cand.without_seen(cleaned, seen_texts(spark, sf_dir))


@query(
    "seen_union",
    f"WITH {CLEANED} SELECT lower(text) AS key FROM cleaned UNION SELECT lower(text) FROM benchmark UNION SELECT lower(text) FROM corpus",
    "candidates corpus",
)
def seen_union(spark, sf_dir):
    cleaned = candidates(spark, sf_dir).select(clean_line(F.col("raw")).alias("text"))
    return cand.union_seen(cleaned, seen_texts(spark, sf_dir), corpus(spark, sf_dir))


# ----------------------------------------------------------------------------------- vectors
_CENTERS = """
    dims AS (SELECT cluster_name, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM vectors),
    means AS (SELECT cluster_name, d, avg(x) AS x FROM dims GROUP BY ALL),
    centers AS (SELECT cluster_name, list(x ORDER BY d) AS c FROM means GROUP BY cluster_name)
"""


def _sql_cosine(a: str, b: str) -> str:
    return (
        f"list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-8)"
        f" * greatest(sqrt(list_dot_product({b}, {b})), 1e-8))"
    )


@query(
    "cosine_to_centroid",
    f"""WITH {_CENTERS}
    SELECT vec_id, v.cluster_name, round({_sql_cosine('v', 'c')}, 9) AS similarity
    FROM vectors v JOIN centers c ON v.cluster_name = c.cluster_name
    """,
    "vectors",
)
def cosine_to_centroid(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    centers = vec.centroids(rows, ["cluster_name"])
    scored = rows.join(F.broadcast(centers), "cluster_name")  # a row for each of the fixed cluster names
    return rounded(scored.select("vec_id", "cluster_name", cosine(F.col("embedding"), F.col("centroid")).alias("similarity")))


_SEEDS = """
    seeds AS (SELECT *, row_number() OVER (PARTITION BY cluster_name ORDER BY md5(concat('42', ':', vec_id)), vec_id) AS rn
              FROM vectors QUALIFY rn <= 20)
"""


@query("stratified_seeds", f"WITH {_SEEDS} SELECT cluster_name, vec_id FROM seeds", "vectors")
def stratified_seeds(spark, sf_dir):
    return sampling.stratified_seeds(vectors(spark, sf_dir), ["cluster_name"], "vec_id").select("cluster_name", "vec_id")


_SCORED = f"""{_SEEDS},
    scored AS (SELECT a.vec_id, a.cluster_name, max({_sql_cosine('a.v', 's.v')}) AS similarity
               FROM vectors a JOIN seeds s ON a.cluster_name = s.cluster_name GROUP BY ALL)
"""


def _scored(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    seeds = sampling.stratified_seeds(rows, ["cluster_name"], "vec_id")
    return rows, seeds, gate.best_similarity(rows, seeds, ["cluster_name"])


@query("best_similarity", f"WITH {_SCORED} SELECT vec_id, cluster_name, round(similarity, 9) AS similarity FROM scored", "vectors")
def best_similarity(spark, sf_dir):
    return rounded(_scored(spark, sf_dir)[2].select("vec_id", "cluster_name", "similarity"))


@query("best_similarity_in_blocks", f"WITH {_SCORED} SELECT vec_id, cluster_name, round(similarity, 9) AS similarity FROM scored", "vectors")
def best_similarity_in_blocks(spark, sf_dir):
    rows, seeds, _ = _scored(spark, sf_dir)
    scored = gate.best_similarity_in_blocks(rows, seeds, ["cluster_name"], "vec_id", "vec_id", blocks=4)
    return rounded(scored.select("vec_id", "cluster_name", "similarity"))


@query(
    "similarity_gate",
    f"WITH {_SCORED} SELECT vec_id, cluster_name, round(similarity, 9) AS similarity FROM scored WHERE similarity >= {THRESHOLD}",
    "vectors",
)
def similarity_gate(spark, sf_dir):
    rows, seeds, _ = _scored(spark, sf_dir)
    kept = gate.similarity_gate(rows, seeds, ["cluster_name"], THRESHOLD, return_scores=True)
    return rounded(kept.select("vec_id", "cluster_name", "similarity"))


@query(
    "gate_acceptance",
    f"""WITH {_SCORED}
    SELECT cluster_name, count(*) AS total, count(*) FILTER (similarity >= {THRESHOLD}) AS kept,
           count(*) FILTER (similarity < {THRESHOLD}) AS dropped,
           round(count(*) FILTER (similarity < {THRESHOLD}) * 100.0::DOUBLE / count(*), 9) AS dropped_percent
    FROM scored GROUP BY cluster_name
    """,
    "vectors",
)
def gate_acceptance(spark, sf_dir):
    return rounded(gate.acceptance_rate(_scored(spark, sf_dir)[2], ["cluster_name"], THRESHOLD))


def _category():
    """Five categories, each the mean of two given labels."""
    return F.concat(F.lit("g"), F.floor(F.substring("cluster_name", 2, 9).cast("int") / 2).cast("string"))


_ANCHORS = """
    adims AS (SELECT 'g' || (substr(cluster_name, 2)::INTEGER // 2) AS category, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM vectors),
    ameans AS (SELECT category, d, avg(x) AS x FROM adims GROUP BY ALL),
    anchors AS (SELECT category, list(x ORDER BY d) AS a FROM ameans GROUP BY category)
"""


def _centers_and_anchors(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    centers = vec.centroids(rows, ["cluster_name"]).withColumnRenamed("cluster_name", "cluster")
    anchors = vec.centroids(rows.withColumn("category", _category()), ["category"])
    return rows, centers, anchors.withColumnRenamed("centroid", "embedding")


@query(
    "category_similarity",
    f"""WITH {_CENTERS}, {_ANCHORS}
    SELECT cluster_name AS cluster, category, round({_sql_cosine('c', 'a')}, 9) AS similarity FROM centers, anchors
    """,
    "vectors",
)
def category_similarity(spark, sf_dir):
    _, centers, anchors = _centers_and_anchors(spark, sf_dir)
    return rounded(vec.category_similarity(centers, anchors))


@query(
    "nearest_centroid",
    f"""WITH {_CENTERS},
    gaps AS (SELECT vec_id, c.cluster_name AS cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS gap
             FROM vectors v, centers c)
    SELECT vec_id, first(cluster ORDER BY gap, cluster) AS cluster FROM gaps GROUP BY vec_id
    """,
    "vectors",
)
def nearest_centroid(spark, sf_dir):
    rows, centers, _ = _centers_and_anchors(spark, sf_dir)
    return vec.nearest_centroid(rows, centers).select("vec_id", "cluster")


@query("cluster_sizes", "SELECT lang AS class, source AS cluster_name, count(*) AS n FROM documents GROUP BY ALL")
def cluster_sizes(spark, sf_dir):
    from curate.operators.clustering import cluster_sizes as sizes

    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("class"), F.col("source").alias("cluster_name"))
    return sizes(docs, ["class"])


# ------------------------------------------------------------------------ rebalancing inputs
def real_rows(spark, sf_dir):
    """The corpus with its source as cluster and a vector drawn from ``embeddings``."""
    rows = corpus(spark, sf_dir).withColumnRenamed("source", "cluster_name")
    return _with_vector(spark, sf_dir, rows, F.lit("v:"), F.col("row_id"))


def rebalance_candidates(spark, sf_dir):
    """Lines of the unlabelled documents as candidates for classes 0 and 2."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    lines = candidate_lines(docs).select(
        (draw_int(F.lit("k:"), F.col("doc_id")) % 2 * 2).cast("int").alias("label"),
        "cluster_name",
        F.col("doc_id").alias("round"),
        F.col("pos").alias("line"),
        "raw",
    )
    return _with_vector(spark, sf_dir, lines, F.lit("v:"), F.col("round"), F.lit(":"), F.col("line"))


def _with_vector(spark, sf_dir, rows, *draw):
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = embeddings.agg(F.count("*")).scalar()
    return rows.withColumn("vec_id", draw_int(*draw) % size).join(embeddings, "vec_id").drop("vec_id")


_PICK = "(SELECT count(*) FROM embeddings)"
_REAL = f"""
    real AS (SELECT c.row_id, c.text, c.label, c.source AS cluster_name, e.embedding::DOUBLE[] AS v
             FROM corpus c JOIN embeddings e ON e.vec_id = {sql_int("'v:'", "c.row_id")} % {_PICK}),
    tcounts AS (SELECT label, count(*) AS n FROM real GROUP BY label)
"""


def _sql_quotas(targets: str) -> str:
    return f"""
    targets AS ({targets}),
    named AS (SELECT DISTINCT label, cluster_name FROM real),
    quotas AS (SELECT t.class_pos, n.label, t.target, n.cluster_name,
                      row_number() OVER (PARTITION BY n.label ORDER BY n.cluster_name) - 1 AS cluster_pos,
                      t.target // count(*) OVER (PARTITION BY n.label)
                        + CASE WHEN row_number() OVER (PARTITION BY n.label ORDER BY n.cluster_name) - 1
                                    < t.target % count(*) OVER (PARTITION BY n.label) THEN 1 ELSE 0 END AS quota
               FROM named n JOIN targets t ON n.label = t.label),
    rseeds AS (SELECT *, row_number() OVER (PARTITION BY label, cluster_name ORDER BY md5(concat('42', ':', row_id)), row_id) AS rn
               FROM real QUALIFY rn <= 20)
"""


MAJORITY = """SELECT CASE label WHEN 0 THEN 0 ELSE 1 END AS class_pos, label, (SELECT max(n) FROM tcounts) - n AS target
              FROM tcounts WHERE label IN (0, 2)"""


@query(
    "cluster_quotas",
    f"""WITH {_REAL}, {_sql_quotas(MAJORITY)}
    SELECT class_pos::INTEGER AS class_pos, label, target::BIGINT AS target, cluster_name,
           cluster_pos::INTEGER AS cluster_pos, quota::BIGINT AS quota FROM quotas
    """,
    "corpus",
)
def cluster_quotas(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumnRenamed("source", "cluster_name")
    return sampling.cluster_quotas(rows, balance.rebalance_targets(rows))


TEMPLATE = "Write {n_variants} lines about {category} ({intent}), tone {tone}, {length}, {formality}:\n{examples}"
INTENTS = {"src1": "news of the first source", "src2": "news of the second source"}


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_DIGITS = """
    styles AS (SELECT i AS style, {tones}[c // 72 % 5 + 1] AS tone, {lengths}[c // 24 % 3 + 1] AS length,
                      {formalities}[c // 8 % 3 + 1] AS formality, {typos}[c // 4 % 2 + 1] AS typos, {syntaxes}[c % 4 + 1] AS syntax
               FROM (SELECT i, i * 18 AS c FROM range(20) r(i)))
""".format(**{n: _sql_list(getattr(C, n.upper())) for n in ("tones", "lengths", "formalities", "typos", "syntaxes")})


@query(
    "style_grid",
    f"WITH {_DIGITS} SELECT e.event_id, tone, length, formality, typos, syntax FROM events e JOIN styles s ON s.style = e.event_id % 20",
)
def style_grid(spark, sf_dir):
    """The style that the running number of an event selects."""
    return table(spark, sf_dir, "events").select("event_id", rebalance.style_column(F.col("event_id")).alias("s")).select("event_id", "s.*")


def _sql_drawn(rounds: str, number: str, few: int = 5) -> str:
    """``examples(label, cluster_name, number, examples)`` of the rows ``(label, cluster_name, number, draw)`` of ``rounds``.

    The numbers drawn are the images of 0, 1, … under a keyed permutation: passes of a network over a grid of a × b
    cells, repeated while the image is no number of an example.
    """
    h = lambda i, half: sql_int("draw", "':'", "label", "':'", "cluster_name", f"':{i}:'", half)
    return f"""
    numbered AS (SELECT label, cluster_name, text, row_number() OVER (PARTITION BY label, cluster_name ORDER BY row_id) - 1 AS pick,
                        count(*) OVER (PARTITION BY label, cluster_name) AS n FROM rseeds),
    grids AS (SELECT DISTINCT label, cluster_name, n, ceil(sqrt(n))::BIGINT AS a, (n + ceil(sqrt(n))::BIGINT - 1) // ceil(sqrt(n))::BIGINT AS b FROM numbered),
    walk AS (
        SELECT r.label, r.cluster_name, {number}, draw, j, n, a, b, j AS x, 0 AS step
        FROM {rounds} r JOIN grids g ON g.label = r.label AND g.cluster_name = r.cluster_name, unnest(range(least({few}, n))) t(j)
        UNION ALL
        SELECT label, cluster_name, {number}, draw, j, n, a, b, h2 * b + (l1 + {h(3, 'h2')}) % b, step + 1
        FROM (SELECT *, (h1 + {h(2, 'l1')}) % a AS h2
              FROM (SELECT *, (l0 + {h(1, 'h1')}) % b AS l1
                    FROM (SELECT *, (x // b + {h(0, 'x % b')}) % a AS h1, x % b AS l0 FROM walk WHERE step = 0 OR x >= n)))),
    examples AS (SELECT w.label, w.cluster_name, {number}, string_agg('- ' || s.text, chr(10) ORDER BY j) AS examples
                 FROM walk w JOIN numbered s ON s.label = w.label AND s.cluster_name = w.cluster_name AND s.pick = w.x
                 WHERE step > 0 AND x < w.n GROUP BY ALL)
    """


@query(
    "prompt_plan",
    f"""WITH RECURSIVE {_REAL}, {_sql_quotas(MAJORITY)},
    {_DIGITS},
    rounds AS (SELECT label, cluster_name, round, round + 43 AS draw
               FROM (SELECT label, cluster_name, unnest(range((quota + 9) // 10)) AS round FROM quotas)),
    {_sql_drawn('rounds', 'round')}
    SELECT e.label, e.cluster_name, e.round::BIGINT AS round, tone, length, formality, typos, syntax,
           'Write 10 lines about ' || replace(e.cluster_name, '_', ' ') || ' (' ||
           CASE e.cluster_name WHEN 'src1' THEN 'news of the first source' WHEN 'src2' THEN 'news of the second source' ELSE 'anything else' END
           || '), tone ' || tone || ', ' || length || ', ' || formality || ':' || chr(10) || examples AS prompt
    FROM examples e JOIN styles s ON s.style = e.round % 20
    """,
    "corpus",
)
def prompt_plan(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumnRenamed("source", "cluster_name")
    targets = balance.rebalance_targets(rows)
    mine = rows.join(F.broadcast(targets.select("label")), "label", "left_semi")
    quotas = sampling.cluster_quotas(mine, targets)
    seeds = sampling.stratified_seeds(mine, ["label", "cluster_name"])
    return rebalance.prompt_plan(quotas, seeds, TEMPLATE, INTENTS, "anything else")


@query(
    "top_up_plan",
    f"""WITH RECURSIVE {_REAL}, {_sql_quotas(MAJORITY)},
    {_DIGITS},
    attempts AS (SELECT label, unnest(range((target + 9) // 10)) AS attempt FROM targets),
    turns AS (SELECT a.label, q.cluster_name, a.attempt + 500 AS turn, a.attempt + 500 + 43 + 9999 AS draw FROM attempts a JOIN quotas q ON q.label = a.label
               AND q.cluster_pos = a.attempt % (SELECT count(*) FROM quotas c WHERE c.label = a.label)),
    {_sql_drawn('turns', 'turn')}
    SELECT e.label, e.cluster_name, e.turn::BIGINT AS turn, tone, length, formality, typos, syntax,
           'Ten more (10), ' || formality || ':' || chr(10) || examples AS prompt
    FROM examples e JOIN styles s ON s.style = e.turn % 20
    """,
    "corpus",
)
def top_up_plan(spark, sf_dir):
    """As many prompts as the whole target of each class needs."""
    rows = corpus(spark, sf_dir).withColumnRenamed("source", "cluster_name")
    targets = balance.rebalance_targets(rows)
    mine = rows.join(F.broadcast(targets.select("label")), "label", "left_semi")
    quotas = sampling.cluster_quotas(mine, targets)
    seeds = sampling.stratified_seeds(mine, ["label", "cluster_name"])
    needs = targets.select("label", F.col("target").alias("n"))
    template = "Ten more ({n_variants}), {formality}:\n{examples}"
    return rebalance.top_up_plan(needs, quotas, seeds, template, INTENTS, "anything else")


def _sql_perturbed(name: str, needs: str, seed: int) -> str:
    """``name(label, i, text)``: the perturbed rows for ``needs(label, n)``."""
    words = rf"string_split_regex({sql_strip('text')}, '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+')"
    draw = lambda what: sql_int(f"'{seed}:'", "label", "':'", "i", f"':{what}'")
    return f"""
    {name}_pool AS (SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY row_id) AS pick,
                           count(*) OVER (PARTITION BY label) AS size FROM real),
    {name}_rows AS (SELECT label, unnest(range(n::BIGINT)) AS i FROM ({needs}) WHERE n > 0),
    {name}_picked AS (SELECT r.label, r.i, p.text, CASE WHEN {sql_strip('p.text')} = '' THEN [] ELSE {words.replace('text', 'p.text')} END AS w
                      FROM {name}_rows r JOIN {name}_pool p ON p.label = r.label
                       AND p.pick = {sql_int(f"'{seed}:pick:'", "r.label", "':'", "r.i", hex_digits=15)} % p.size + 1),
    {name}_drawn AS (SELECT *, len(w) AS n, {draw('action')} % 3 AS action, {draw('index')} AS pick FROM {name}_picked),
    {name} AS (SELECT label, i, array_to_string(
                  CASE WHEN n < 4 THEN w
                       WHEN action = 0 THEN w[:(pick % (n - 2) + 1)] || w[(pick % (n - 2) + 3):]
                       WHEN action = 1 THEN w[:(pick % n + 1)] || w[(pick % n + 1):]
                       ELSE w[:(pick % (n - 1))] || [w[pick % (n - 1) + 2], w[pick % (n - 1) + 1]] || w[(pick % (n - 1) + 3):] END, ' ') AS text
               FROM {name}_drawn)
"""


@query(
    "perturbed_oversample",
    f"""WITH {_REAL}, {_sql_perturbed('made', 'SELECT label, n FROM tcounts', 7)}
    SELECT label, i::BIGINT AS i, text FROM made
    """,
    "corpus",
)
def perturbed_oversample(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    needs = rows.groupBy("label").agg(F.count("*").alias("n"))
    return sampling.perturbed_oversample(sampling.numbered_pool(rows), rows, needs, 7)


_GATED = f"""
    offered AS (SELECT ({sql_int("'k:'", "doc_id")} % 2 * 2)::INTEGER AS label, cluster_name, doc_id AS round, pos AS line,
                       {sql_clean_line('raw')} AS text, {sql_int("'v:'", "doc_id", "':'", "pos")} % {_PICK} AS vec_id
                FROM candidates WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
    arrived AS (SELECT o.*, q.class_pos, q.cluster_pos, q.target, q.quota FROM offered o
                JOIN quotas q ON q.label = o.label AND q.cluster_name = o.cluster_name),
    usable AS (SELECT * FROM arrived WHERE {REASON} IS NULL),
    uniq AS (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY class_pos, cluster_pos, round, line) AS rn
             FROM usable QUALIFY rn = 1),
    unseen AS (SELECT * FROM uniq WHERE lower(text) NOT IN (SELECT lower(text) FROM real)),
    gated AS (SELECT u.label, u.cluster_name, u.class_pos, u.cluster_pos, u.round, u.line, u.target, u.quota, u.text
              FROM unseen u JOIN embeddings e ON e.vec_id = u.vec_id
              WHERE (SELECT max({_sql_cosine('e.embedding::DOUBLE[]', 's.v')}) FROM rseeds s
                     WHERE s.label = u.label AND s.cluster_name = u.cluster_name) >= {{threshold}}),
    placed AS (SELECT *, row_number() OVER (PARTITION BY label, cluster_name ORDER BY round, line) AS place FROM gated)
"""


@query(
    "gated_candidates",
    f"""WITH {_REAL}, {_sql_quotas(MAJORITY)}, {_GATED.replace('{threshold}', str(LOOSE))}
    SELECT label, cluster_name, round, line, text FROM gated
    """,
    "corpus candidates",
)
def gated_candidates(spark, sf_dir):
    return _gated(spark, sf_dir).select("label", "cluster_name", "round", "line", "text")


@query(
    "gated_candidates_all",
    f"""WITH {_REAL}, {_sql_quotas(MAJORITY)}, {_GATED.replace('{threshold}', str(STRICT)).replace('FROM rseeds s', 'FROM real s')}
    SELECT label, cluster_name, round, line, text FROM gated
    """,
    "corpus candidates",
)
def gated_candidates_all(spark, sf_dir):
    """A strict gate against every real row of a cluster."""
    return _gated(spark, sf_dir, STRICT, "all").select("label", "cluster_name", "round", "line", "text")


def _gated(spark, sf_dir, threshold=LOOSE, refs="seeds"):
    real = real_rows(spark, sf_dir)
    targets = balance.rebalance_targets(real)
    mine = real.join(F.broadcast(targets.select("label")), "label", "left_semi")
    quotas = stored(sampling.cluster_quotas(mine, targets), "quotas")
    known = mine if refs == "all" else sampling.stratified_seeds(mine, ["label", "cluster_name"])
    offered = rebalance_candidates(spark, sf_dir)
    return rebalance.gated_candidates(offered, real, quotas, known, threshold)


@query(
    "capped_candidates",
    f"""WITH {_REAL}, {_sql_quotas(MAJORITY)}, {_GATED.replace('{threshold}', str(LOOSE))}
    SELECT label, cluster_name, round, line, place, text FROM placed WHERE place <= quota
    """,
    "corpus candidates",
)
def capped_candidates(spark, sf_dir):
    placed = rebalance.capped(stored(_gated(spark, sf_dir), "gated")).where("place <= quota")
    return placed.select("label", "cluster_name", "round", "line", "place", "text")


def _sql_synthetic(threshold: float, targets: str) -> str:
    return f"""{_REAL}, {_sql_quotas(targets)}, {_GATED.replace('{threshold}', str(threshold))},
    main AS (SELECT * FROM placed WHERE place <= quota),
    short AS (SELECT t.label, t.target - (SELECT count(*) FROM main m WHERE m.label = t.label) AS short FROM targets t),
    turns AS (SELECT p.*, s.short, row_number() OVER (PARTITION BY p.label ORDER BY round, cluster_pos, line) AS turn
              FROM placed p JOIN short s ON s.label = p.label WHERE place > quota),
    accepted AS (SELECT label, 'candidate' AS origin, text FROM main UNION ALL
                 SELECT label, 'top_up', text FROM turns WHERE turn <= short),
    {_sql_perturbed('fill', 'SELECT label, target - (SELECT count(*) FROM accepted a WHERE a.label = t.label) AS n FROM targets t', 42 + 77777)},
    fresh AS (SELECT *, row_number() OVER (PARTITION BY label, lower({sql_strip('text')}) ORDER BY i) AS rn FROM fill QUALIFY rn = 1),
    filled AS (SELECT label, origin, text FROM accepted UNION ALL
               SELECT label, 'fill', text FROM fresh f WHERE NOT EXISTS
                 (SELECT 1 FROM accepted a WHERE a.label = f.label AND lower({sql_strip('a.text')}) = lower({sql_strip('f.text')}))),
    {_sql_perturbed('patch', 'SELECT label, target - (SELECT count(*) FROM filled a WHERE a.label = t.label) AS n FROM targets t', 42 + 99999)},
    made AS (SELECT label, origin, text FROM filled UNION ALL SELECT label, 'patch', text FROM patch)
"""


ONE_CLASS = MAJORITY.replace("label IN (0, 2)", "label = 2").replace("CASE label WHEN 0 THEN 0 ELSE 1 END", "0")


@query(
    "augment_one_class",
    f"WITH {_sql_synthetic(STRICT, ONE_CLASS)} SELECT label, origin, text FROM made",
    "corpus candidates",
)
def augment_one_class(spark, sf_dir):
    """A strict gate, so that top-up, fill and patch all take part."""
    real = real_rows(spark, sf_dir)
    targets = stored(balance.rebalance_targets(real, labels=(2,)), "targets")
    return rebalance.synthetic_rows(real, rebalance_candidates(spark, sf_dir), targets, STRICT)


@query(
    "augment",
    f"""WITH {_sql_synthetic(LOOSE, MAJORITY)},
    rows AS (SELECT row_id, label, 'real' AS origin, text, false AS is_synthetic FROM real
             UNION ALL SELECT NULL, label, origin, text, true FROM made)
    SELECT row_id, text, label, is_synthetic, origin,
           CASE label WHEN 0 THEN 'hate_speech' WHEN 1 THEN 'offensive_language' ELSE 'neither' END AS label_name FROM rows
    """,
    "corpus candidates",
)
def augment(spark, sf_dir):
    return rebalance.augment(real_rows(spark, sf_dir), rebalance_candidates(spark, sf_dir), LOOSE)


@query(
    "augmented_repeats",
    f"""WITH {_sql_synthetic(LOOSE, MAJORITY)},
    rows AS (SELECT label, text FROM real UNION ALL SELECT label, text FROM made),
    keyed AS (SELECT label, lower({sql_strip('text')}) AS key FROM rows)
    SELECT label, count(*) AS n, count(DISTINCT key) AS n_distinct, count(*) - count(DISTINCT key) AS n_repeated FROM keyed GROUP BY label
    """,
    "corpus candidates",
)
def augmented_repeats(spark, sf_dir):
    return balance.repeated_texts(augment(spark, sf_dir))


@query(
    "bag_union",
    f"""WITH {CLEANED} SELECT text, false AS is_synthetic FROM corpus UNION ALL SELECT text, true FROM cleaned""",
    "corpus candidates",
)
def bag_union(spark, sf_dir):
    real = corpus(spark, sf_dir).select("text", F.lit(False).alias("is_synthetic"))
    made = candidates(spark, sf_dir).select(clean_line(F.col("raw")).alias("text"), F.lit(True).alias("is_synthetic"))
    return real.unionByName(made)


