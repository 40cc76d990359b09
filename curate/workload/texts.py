"""Queries over the corpus: reading, cleaning, splitting, class balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from curate.functions.naming import safe_name
from curate.functions.text import clean_line, normalise
from curate.operators import balance
from curate.operators.split import stratified_split
from curate.session import scratch_path
from curate.sources import corpus as store
from curate.workload.registry import query, rounded
from curate.workload.views import candidates, corpus, flagged_corpus, table

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"


def sql_normalise(text: str) -> str:
    text = rf"regexp_replace({text}, 'http{NOT_SPACE}+|www\.{NOT_SPACE}+', '[URL]', 'g')"
    text = rf"regexp_replace({text}, '@[\p{{L}}\p{{N}}_]+', '[USER]', 'g')"
    text = rf"regexp_replace({text}, '#([\p{{L}}\p{{N}}_]+)', '\1', 'g')"
    return rf"trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'))"


def sql_strip(text: str) -> str:
    return rf"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_clean_line(text: str) -> str:
    text = rf"regexp_replace({sql_strip(text)}, '^{SPACE}*\p{{Nd}}+[.)]{SPACE}*', '')"
    text = rf"regexp_replace({text}, '^{SPACE}*[-*]{SPACE}*', '')"
    return sql_strip(rf"regexp_replace({text}, '^[\x22\x27]([^\n]+)[\x22\x27]$', '\1')")


NAMED = "CASE label WHEN 0 THEN 'hate_speech' WHEN 1 THEN 'offensive_language' WHEN 2 THEN 'neither' END"
SPLIT = """
    keyed AS (SELECT *, md5(concat('42', ':', row_id)) AS k FROM corpus),
    placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, row_id) AS rn,
                      count(*) OVER (PARTITION BY label) AS n FROM keyed),
    split AS (SELECT *, CASE WHEN rn * 100 <= 70 * n THEN 'train' WHEN rn * 100 <= 85 * n THEN 'val' ELSE 'test' END AS split
              FROM placed)
"""


@query("read_corpus", f"SELECT row_id, {sql_normalise('text')} AS text, label, {NAMED} AS label_name FROM corpus", "corpus")
def read_corpus(spark, sf_dir):
    return store.clean_corpus(corpus(spark, sf_dir).withColumnRenamed("label", "class"), "row_id")


@query("read_corpus_splits", f"SELECT row_id, {sql_normalise('text')} AS text, label, {NAMED} AS label_name FROM corpus", "corpus")
def read_corpus_splits(spark, sf_dir):
    """The reader over two stored splits that name their columns differently."""
    rows, path = corpus(spark, sf_dir).select("row_id", "text", "label"), scratch_path(spark, "splits")
    odd = F.col("row_id") % 2 == 1
    rows.where(odd).write.parquet(f"{path}/one")
    rows.where(~odd).withColumnsRenamed({"text": "tweet", "label": "class"}).write.parquet(f"{path}/two")
    return store.read_corpus(spark, [f"{path}/one", f"{path}/two"], row_id="row_id")


@query(
    "normalise_text",
    "SELECT doc_id AS row_id, "
    + sql_normalise("concat(text, ' http://x.example/', doc_id, ' @u', doc_id, ' #t', doc_id)")
    + " AS text FROM documents",
)
def normalise_text(spark, sf_dir):
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    dressed = F.concat(
        "text", F.lit(" http://x.example/"), key, F.lit(" @u"), key, F.lit(" #t"), key
    )
    return docs.select(F.col("doc_id").alias("row_id"), normalise(dressed).alias("text"))


@query(
    "cached_corpus",
    f"SELECT row_id, {sql_normalise('text')} AS text, label, {NAMED} AS label_name FROM corpus",
    "corpus",
)
def cached_corpus(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    store.cached(spark, path, lambda: read_corpus(spark, sf_dir))
    return store.cached(spark, path, lambda: read_corpus(spark, sf_dir).limit(0))


@query("label_names", f"SELECT row_id, label, {NAMED} AS label_name FROM (SELECT row_id, label + row_id % 2 AS label FROM corpus)", "corpus")
def label_names(spark, sf_dir):
    """Half of the labels are shifted by one, so some are unknown."""
    shifted = corpus(spark, sf_dir).select("row_id", (F.col("label") + F.col("row_id") % 2).alias("label"))
    return shifted.withColumn("label_name", balance.label_name(F.col("label")))


@query("stratified_split", f"WITH {SPLIT} SELECT row_id, label, split FROM split", "corpus")
def split_corpus(spark, sf_dir):
    return stratified_split(corpus(spark, sf_dir)).select("row_id", "label", "split")


@query("stored_splits", f"WITH {SPLIT} SELECT row_id, label, text, split FROM split", "corpus")
def stored_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    store.write_splits(stratified_split(corpus(spark, sf_dir)), path)
    return spark.read.parquet(path).select("row_id", "label", "text", "split")


_TEST = f"WITH {SPLIT} SELECT row_id, label, text FROM split WHERE split = 'test'"


@query("held_out_stored", _TEST, "corpus")
def held_out_stored(spark, sf_dir):
    path = scratch_path(spark, "splits")
    rows = corpus(spark, sf_dir)
    store.write_splits(stratified_split(rows), path)
    return store.held_out(spark, path, rows.limit(0)).select("row_id", "label", "text")


@query("held_out_recomputed", _TEST, "corpus")
def held_out_recomputed(spark, sf_dir):
    missing = scratch_path(spark, "no-splits")
    return store.held_out(spark, missing, corpus(spark, sf_dir)).select("row_id", "label", "text")


@query("train_set_plain", f"WITH {SPLIT} SELECT row_id, label, text, false AS is_synthetic FROM split WHERE split = 'train'", "corpus")
def train_set_plain(spark, sf_dir):
    missing = scratch_path(spark, "no-augmented")
    return store.train_set(spark, missing, corpus(spark, sf_dir)).select("row_id", "label", "text", "is_synthetic")


@query("train_set_augmented", "SELECT row_id, label, text, is_synthetic FROM flagged", "flagged")
def train_set_augmented(spark, sf_dir):
    path = scratch_path(spark, "augmented")
    rows = flagged_corpus(spark, sf_dir)
    store.write_augmented(rows, path)
    return store.train_set(spark, path, rows.limit(0)).select("row_id", "label", "text", "is_synthetic")


@query(
    "synthetic_flag_default",
    "SELECT row_id, false AS without_column, coalesce(CASE WHEN row_id % 3 > 0 THEN is_synthetic END, false) AS with_nulls FROM flagged",
    "flagged",
)
def synthetic_flag_default(spark, sf_dir):
    flagged = flagged_corpus(spark, sf_dir)
    holes = flagged.withColumn("is_synthetic", F.when(F.col("row_id") % 3 > 0, F.col("is_synthetic")))
    return holes.select(
        "row_id",
        balance.is_synthetic(flagged.drop("is_synthetic")).alias("without_column"),
        balance.is_synthetic(holes).alias("with_nulls"),
    )


@query("safe_system_names", "SELECT page_id, replace(url, '/', '_') AS system FROM pages")
def safe_system_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", safe_name(F.col("url")).alias("system"))


# ---------------------------------------------------------------------------------- balance
@query(
    "class_distribution",
    f"""WITH {SPLIT}, c AS (SELECT split, label, count(*) AS n FROM split GROUP BY ALL)
    SELECT split, label, n, round(n::DOUBLE / sum(n) OVER w, 9) AS share, (sum(n) OVER w)::BIGINT AS total,
           round((max(n) OVER w)::DOUBLE / min(n) OVER w, 9) AS imbalance
    FROM c WINDOW w AS (PARTITION BY split)
    """,
    "corpus",
)
def class_distribution(spark, sf_dir):
    return rounded(balance.class_distribution(stratified_split(corpus(spark, sf_dir)), ["split"]))


@query("class_slice", "SELECT row_id, label, text FROM corpus WHERE label = 0", "corpus")
def class_slice(spark, sf_dir):
    return balance.class_slice(corpus(spark, sf_dir), 0).select("row_id", "label", "text")


@query(
    "class_weights",
    """
    SELECT c.label, count(r.row_id) AS n,
           round((SELECT count(*) FROM corpus)::DOUBLE / nullif(4 * count(r.row_id), 0), 9) AS weight
    FROM (VALUES (0), (1), (2), (3)) c(label) LEFT JOIN corpus r ON r.label = c.label GROUP BY c.label
    """,
    "corpus",
)
def class_weights(spark, sf_dir):
    """Four classes, of which the last has no rows."""
    return rounded(balance.class_weights(corpus(spark, sf_dir), 4))


_COUNTS = "c AS (SELECT label, count(*) AS n FROM corpus GROUP BY label)"


@query(
    "rebalance_targets",
    f"""WITH {_COUNTS},
    t AS (SELECT 'majority' AS balance, label, n AS n_real, (SELECT max(n) FROM c) - n AS target FROM c
          UNION ALL SELECT 'mean', label, n, (SELECT sum(n) // count(*) FROM c)::BIGINT - n FROM c
          UNION ALL SELECT 'fixed', label, n, 500 FROM c)
    SELECT balance, (CASE label WHEN 0 THEN 0 ELSE 1 END)::INTEGER AS class_pos, label, n_real, target::BIGINT AS target
    FROM t WHERE label IN (0, 2) AND target > 0
    """,
    "corpus",
)
def rebalance_targets(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    parts = [
        balance.rebalance_targets(rows, how).withColumn("balance", F.lit(name))
        for name, how in (("majority", "majority"), ("mean", "mean"), ("fixed", 500))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "effective_priors",
    """
    WITH w AS (SELECT label, CASE WHEN is_synthetic THEN 0.2::DOUBLE ELSE 1 END AS w FROM flagged)
    SELECT label AS cls, round(sum(w) / (SELECT sum(w) FROM w), 9) AS prior FROM w GROUP BY label
    """,
    "flagged",
)
def effective_priors(spark, sf_dir):
    one = balance.effective_priors(flagged_corpus(spark, sf_dir), 0.2)
    return rounded(one.select(F.posexplode("priors").alias("cls", "prior")))


@query(
    "augmentation_audit",
    """
    WITH k AS (SELECT label, count(*) FILTER (NOT is_synthetic) AS n_real, count(*) FILTER (is_synthetic) AS n_synthetic,
                      count(*) AS n FROM flagged GROUP BY label)
    SELECT label, n_real, n_synthetic, n,
           round((SELECT max(n_real)::DOUBLE / min(n_real) FROM k WHERE n_real > 0), 9) AS imbalance_before,
           round((SELECT max(n)::DOUBLE / min(n) FROM k), 9) AS imbalance_after FROM k
    """,
    "flagged",
)
def augmentation_audit(spark, sf_dir):
    return rounded(balance.augmentation_audit(flagged_corpus(spark, sf_dir)))


# -------------------------------------------------------------------------- candidate lines
@query("clean_lines", f"SELECT doc_id, pos, {sql_clean_line('raw')} AS text FROM candidates", "candidates")
def clean_lines(spark, sf_dir):
    return candidates(spark, sf_dir).select("doc_id", "pos", clean_line(F.col("raw")).alias("text"))


@query(
    "split_responses",
    f"""SELECT doc_id, pos::INTEGER AS pos, {sql_strip('line')} AS line FROM lines WHERE {sql_strip('line')} <> ''""",
    "lines",
)
def split_responses(spark, sf_dir):
    from curate.operators.candidates import response_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("response"))
    return response_lines(docs, ["doc_id"])
