"""Input views derived from the given tables, in Spark and in SQL.

The given tables hold no predictions, so the scores of three systems are derived from ``events``
with a seeded hash, and the corpus and candidate lines from ``documents`` and ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.functions.hashing import draw_int
from curate.functions.once import with_once
from curate.functions.prob import arg_max

SYSTEM_BOOST = {"A": 20, "B": 35, "C": 50}
N_CLASSES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------------------------- scores
def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system, row_id, event_type, true_label, raw_0, raw_1, raw_2): raw score per class."""
    event = F.col("event_id")
    draw = draw_int(F.lit("y:"), event) % 1000
    truth = F.when(draw < 58, 0).when(draw < 832, 1).otherwise(2)
    base = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), "event_type", truth.alias("true_label"), "event_id"
    )
    systems = F.array(
        *[F.struct(F.lit(s).alias("system"), F.lit(w).alias("boost")) for s, w in SYSTEM_BOOST.items()]
    )
    long = base.select("*", F.inline(systems))
    raws = [
        1
        + draw_int(F.col("system"), F.lit(c), F.lit(":"), F.col("event_id")) % 100
        + F.when(F.col("true_label") == c, F.col("boost")).otherwise(0)
        for c in range(N_CLASSES)
    ]
    return long.select(
        "system", "row_id", "event_type", "true_label", *[r.cast("double").alias(f"raw_{c}") for c, r in enumerate(raws)]
    )


def predictions(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(system, row_id, true_label, pred_label, probs) of three systems."""
    raws = [F.col(f"raw_{c}") for c in range(N_CLASSES)]
    probs = F.array(*[r / sum(raws[1:], raws[0]) for r in raws])
    labelled = raw_scores(spark, sf_dir).select("system", "row_id", "true_label", *extra, probs.alias("probs"))
    return labelled.select(
        "system", "row_id", "true_label", arg_max(F.col("probs")).alias("pred_label"), "probs", *extra
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system, row_id, true_label, logits): logs of the raw scores."""
    logs = F.array(*[F.log(f"raw_{c}") for c in range(N_CLASSES)])
    return raw_scores(spark, sf_dir).select("system", "row_id", "true_label", logs.alias("logits"))


# ------------------------------------------------------------------------------------- corpus
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, label, source): the labelled documents."""
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 1).otherwise(2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    marks = table(spark, sf_dir, "labels")
    return docs.join(marks, "doc_id").select(
        F.col("doc_id").alias("row_id"), "text", label.alias("label"), "source"
    )


def flagged_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with a seeded ``is_synthetic`` flag."""
    return corpus(spark, sf_dir).withColumn(
        "is_synthetic", draw_int(F.lit("s:"), F.col("row_id")) % 4 == 0
    )


# --------------------------------------------------------------------------------- candidates
def candidate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, class, cluster_name, raw): non-blank lines dressed up as model output."""
    lines = docs.select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).where(F.trim("line") != "")
    lines = with_once(lines, "kind", draw_int(F.lit("c:"), F.col("doc_id"), F.lit(":"), F.col("pos")) % 8)
    kind = F.col("kind")
    raw = (
        F.when(kind == 0, F.concat(F.lit("12. "), "line"))
        .when(kind == 1, F.concat(F.lit("- "), "line"))
        .when(kind == 2, F.concat(F.lit('"'), "line", F.lit('"')))
        .when(kind == 3, F.concat(F.lit("I apologize, "), "line"))
        .otherwise(F.col("line"))
    )
    return lines.select(
        "doc_id", "pos", F.col("lang").alias("class"), F.col("source").alias("cluster_name"), raw.alias("raw")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_lines(table(spark, sf_dir, "documents"))


def seen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("text")


# ------------------------------------------------------------------------------------ vectors
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, cluster_name, embedding)."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("cluster_name"), "embedding"
    )


# ---------------------------------------------------------------------------------------- SQL
def sql_int(*parts: str, hex_digits: int = 8) -> str:
    """SQL text of :func:`curate.functions.hashing.draw_int`."""
    return f"('0x'||substr(md5(concat({', '.join(parts)})),1,{hex_digits}))::BIGINT"


_VALUES = ", ".join(f"('{s}', {w})" for s, w in SYSTEM_BOOST.items())

WHITESPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WHITESPACE = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"

SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "pred_raw": (
        [],
        f"""
        SELECT e.event_id AS row_id, e.event_type, s.system, c.cls, e.true_label,
               1 + {sql_int("s.system", "c.cls", "':'", "e.event_id")} % 100
                 + CASE WHEN c.cls = e.true_label THEN s.boost ELSE 0 END AS raw
        FROM (SELECT event_id, event_type,
                     CASE WHEN {sql_int("'y:'", "event_id")} % 1000 < 58 THEN 0
                          WHEN {sql_int("'y:'", "event_id")} % 1000 < 832 THEN 1
                          ELSE 2 END AS true_label
              FROM events) e,
             (VALUES {_VALUES}) s(system, boost), (VALUES (0), (1), (2)) c(cls)
        """,
    ),
    "pred_long": (
        ["pred_raw"],
        """
        SELECT row_id, event_type, system, cls, true_label, raw,
               raw::DOUBLE / (sum(raw) OVER (PARTITION BY row_id, system))::DOUBLE AS prob
        FROM pred_raw
        """,
    ),
    "pred": (
        ["pred_long"],
        """
        SELECT system, row_id, event_type, true_label,
               (row_number() OVER (PARTITION BY system, row_id ORDER BY prob DESC, cls)) AS place,
               cls AS pred_label
        FROM pred_long QUALIFY place = 1
        """,
    ),
    "corpus": (
        [],
        """
        SELECT d.doc_id AS row_id, d.text, d.source,
               CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 1 ELSE 2 END AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id
        """,
    ),
    "flagged": (
        ["corpus"],
        f"SELECT *, {sql_int(chr(39) + 's:' + chr(39), 'row_id')} % 4 = 0 AS is_synthetic FROM corpus",
    ),
    "lines": (
        [],
        """
        SELECT doc_id, lang, source, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS line
        FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents)
        """,
    ),
    "candidates": (
        ["lines"],
        f"""
        SELECT doc_id, pos::INTEGER AS pos, lang AS class, source AS cluster_name,
               CASE {sql_int("'c:'", "doc_id", "':'", "pos")} % 8
                    WHEN 0 THEN '12. ' || line WHEN 1 THEN '- ' || line
                    WHEN 2 THEN '"' || line || '"' WHEN 3 THEN 'I apologize, ' || line
                    ELSE line END AS raw
        FROM lines WHERE trim(line) <> ''
        """,
    ),
    "vectors": (
        [],
        "SELECT vec_id, 'c' || label AS cluster_name, embedding::DOUBLE[] AS v FROM embeddings",
    ),
}


def with_views(sql: str, names: list[str]) -> str:
    """Prefix the SQL with the views it needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        deps, _ = SQL_VIEWS[name]
        for d in deps:
            visit(d)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        visit(n)
    if not ordered:
        return sql.strip()
    views = ",\n".join(f"{n} AS ({SQL_VIEWS[n][1].strip()})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
