"""One query for each operator, over its whole table, and SQL for the rows where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.llm import (
    chat, filter_audit, fingerprints, hard_negatives, katz, metric_join, mixing, ngram_join, packing, private_data, quality, sharding, url_filters,
)
from curate.llm.common import table, text_of
from curate.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def id_remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op1_document_fingerprints")
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents")).drop("anchors", "edited_anchors")


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), id_remainder(5) != 0)
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_mixing_sources")
def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    # Stored as it is read five times below, and so that each row keeps its number.
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "sizes")
    pieces, sources = mixing.mix(docs, key="row")
    taken = pieces.groupBy("row").agg(F.sum("length").alias("n"))
    known = spark.createDataFrame([(s["source"], s["source_size"], s["target"]) for s in sources], "__s string, source_size long, target double")
    return (
        docs.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("__s")))
        .join(taken, "row", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).alias("taken"))
    )


OWN_CONVERSATION = "</s>[INST] ok [/INST]"


@query(
    "op4_chat_formatting",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    sized AS (
        SELECT *, length(text) AS n,
               length(regexp_replace(replace(text, '\', '\\'),
                   '(<\||</?s>|<</?SYS>>|\[/?INST\]|\|>)', '\1_', 'g'))
             + length(regexp_replace(replace(role, '\', '\\'),
                   '(<\||</?s>|<</?SYS>>|\[/?INST\]|\|>)', '\1_', 'g')) + 10 AS written
        FROM turns)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           sum(written)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id
    """,
)
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(OWN_CONVERSATION).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = chat.format_conversations(turns)
    # A conversation without an assistant turn has no example, and an empty loss.
    trained = chat.losses(chat.replies_of(formatted)).withColumnRenamed("conv_id", "__conv")
    back = chat.read_back(formatted).join(trained, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = text_of("loss")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", sharding.byte_size("text").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.shard_by_bytes(rows, "size", 8, ties=("text_crc32",)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query(
    "op10_url_filters",
    """
    WITH cut AS (
        SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    parts AS (
        SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                    ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
    SELECT page_id, host, path, max(h || p) AS rule, coalesce(max(verdict), 'allow') AS verdict
    FROM (SELECT s.*, r.*, row_number() OVER (PARTITION BY s.page_id ORDER BY length(h) + length(p) DESC NULLS LAST) AS place
          FROM parts s LEFT JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p))
    WHERE place = 1 GROUP BY page_id, host, path
    """,
)
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op9_ngram_jaccard_join")
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_embedding_near_dedup")
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.cosine_links(table(spark, sf_dir, "embeddings"))


@query("op6_katz_scores")
def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.katz_scores(table(spark, sf_dir, "documents"), id_remainder(7) != 2)
    return scored.withColumn("held_out", id_remainder(7) == 2).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query(
    "op11_filter_audit",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    m AS (
        SELECT doc_id, part,
               CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    c AS (
        SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
        FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
    x(v) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
    o AS (
        SELECT a.v || b.v || c.v || d.v || e.v AS filter_order FROM x a, x b, x c, x d, x e
        WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
    s AS (
        SELECT filter_order, k::INT AS step, 1 << (ascii(substr(filter_order, k::INT, 1)) - 65) AS bit,
               list_sum([1 << (ascii(substr(filter_order, i::INT, 1)) - 65) for i in range(1, k)]) AS earlier
        FROM o, range(1, 6) r(k)),
    f AS (
        SELECT part, filter_order, step, bit,
               sum(CASE WHEN mask & earlier = 0 AND mask & bit = 0 THEN n ELSE 0 END)::BIGINT AS kept,
               sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
               sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
               sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
               sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
               sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM c, (SELECT filter_order, step, bit, coalesce(earlier, 0)::BIGINT AS earlier FROM s) GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM f
    """,
)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op12_hard_negatives",
    """
    WITH e AS (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [floor(256 * x::DOUBLE) for x in embedding] AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len([x for x in embedding if x IS NOT NULL AND isfinite(x::DOUBLE)]) = len(embedding)),
    s AS (
        SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score
        FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
    p AS (
        SELECT * FROM s WHERE own = label
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id,
           row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
           s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> s.own
                 AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
    QUALIFY rank <= 5
    """,
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op13_private_data")
def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.find_private_data(table(spark, sf_dir, "documents"))

    def written(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, private_data.KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
