"""A training-data pipeline over ``documents``: quality, near-duplicates, source mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the ``docs`` of the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.llm import mixing, ngram_join, packing, quality
from curate.llm.common import SPACE, table, text_of
from curate.llm.queries import id_remainder
from curate.session import stored

THRESHOLD = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts. It learns as ``op2_quality_classifier`` does."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), id_remainder(5) != 0)
    return quality.score(docs, model, docs.columns, "__score").where(F.col("__score") >= THRESHOLD).drop("__score")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number of their own, ``__row``: ids may repeat or be NULL. Stored, so that it stays."""
    return stored(docs.withColumn("__row", F.monotonically_increasing_id()), name)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of near-duplicates.

    Rows are told apart by numbers, so copies with equal ids or none go too; among equal ids the smaller
    hash of the text stays, and a NULL id comes last. Texts without words are alike only if id and text are.
    """
    keyed = numbered(docs, "rows")
    found = ngram_join.near_duplicates(keyed.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    text, no_words = F.col("text"), ~text_of("text").rlike(f"[^{SPACE}]")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(text).alias("hash"), "__row").alias("place")
    empty = F.when(no_words, F.struct("doc_id", text.alias("text"))).alias("empty")
    slim = keyed.select("__row", place, empty).join(found, "__row")
    # Each row without words is a component of its own; its group is its id and text instead.
    slim = slim.withColumn("component_id", F.when(F.col("empty").isNull(), F.col("component_id")))
    first = slim.groupBy("component_id", "empty").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("component_id").alias("c"), F.col("empty").alias("e"), F.col("first.__row").alias("kept"))
    same = F.col("component_id").eqNullSafe(F.col("c")) & F.col("empty").eqNullSafe(F.col("e"))
    copies = slim.join(first, same).where("__row != kept").select("__row")
    return keyed.join(copies, "__row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document: a row for each round through its source.

    Words that a round takes only in part are cut out of the text; whole texts stay as they are, and a
    text without words, which no mix can take, goes.
    """
    keyed = numbered(docs.withColumn("__size", mixing.word_count("text")), "sizes")
    pieces, _ = mixing.mix(keyed.select("doc_id", "__row", "source", F.col("__size").alias("size")), key="__row")
    rounds = pieces.groupBy("__row", "epoch").agg(F.min("start").alias("__first"), F.sum("length").alias("__taken")).drop("epoch")
    text = text_of("text")
    rows = keyed.join(rounds, "__row")
    some = F.slice(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+[{SPACE}]*"), F.lit(0)), F.col("__first").cast("int") + 1, F.col("__taken").cast("int"))
    whole = (F.col("__first") == 0) & (F.col("__taken") == F.col("__size"))
    cut = F.when(whole, F.col("text")).otherwise(F.array_join(some, ""))
    length = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    mixed = rows.withColumn("text", cut).withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(length))
    return mixed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: The classifier's and tokenizer's rows are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
