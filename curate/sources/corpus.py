"""Corpus tables: reading, caching, splits and augmented sets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.constants import LABEL_NAMES, SEED
from curate.functions.text import normalise
from curate.operators.balance import is_synthetic, label_name
from curate.operators.split import stratified_split
from curate.sources.files import QUOTED

TEXT_COLUMNS = ("tweet", "text")
LABEL_COLUMNS = ("class", "label")


def clean_corpus(
    raw: DataFrame,
    row_id: str | None = None,
    text_columns: Sequence[str] = TEXT_COLUMNS,
    label_columns: Sequence[str] = LABEL_COLUMNS,
    names: Mapping[int, str] = LABEL_NAMES,
) -> DataFrame:
    """``(row_id, text, label, label_name)`` from a raw table.

    Text and label come, row by row, from the first of their columns that has a value, as splits read
    together may name them differently; else they are '' and 0.
    Without a key column rows are numbered by file position; write the result once
    (:func:`cached`) before anything depends on those numbers.
    """

    def first_of(columns, default):
        return F.coalesce(*[F.col(c).cast("string") for c in columns if c in raw.columns], F.lit(default).cast("string"))

    key = F.col(row_id) if row_id else F.monotonically_increasing_id()
    label = first_of(label_columns, 0).cast("int")
    return raw.select(
        key.alias("row_id"),
        normalise(first_of(text_columns, "")).alias("text"),
        label.alias("label"),
        label_name(label, names).alias("label_name"),
    )


def read_corpus(spark: SparkSession, paths: str | Sequence[str], format: str = "parquet", **options) -> DataFrame:
    """Read all source splits as one table and clean it; further options go to :func:`clean_corpus`."""
    reader = spark.read.options(header=True, mergeSchema=True, **(QUOTED if format == "csv" else {}))
    return clean_corpus(reader.format(format).load(paths), **options)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table exactly as it is, or else the built one, stored first."""
    found = _stored(spark, path)
    if found is None:
        build().write.mode("ignore").parquet(path)
        found = spark.read.parquet(path)
    return found


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split, so a reader of one split lists only its files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def held_out(spark: SparkSession, path: str, corpus: DataFrame, seed: int = SEED, split: str = "test") -> DataFrame:
    """The stored split, or the same rows split again with the same seed."""
    stored = _stored(spark, path)
    table = stratified_split(corpus, seed=seed) if stored is None else stored
    return table.where(F.col("split") == split).select(*corpus.columns)


def write_augmented(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def train_set(spark: SparkSession, augmented_path: str | None, corpus: DataFrame, seed: int = SEED) -> DataFrame:
    """The augmented table if it is wanted and stored, else the plain train split; always flagged."""
    stored = _stored(spark, augmented_path) if augmented_path else None
    if stored is None:
        stored = stratified_split(corpus, seed=seed).where("split = 'train'").drop("split")
    return stored.withColumn("is_synthetic", is_synthetic(stored))
