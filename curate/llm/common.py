"""Helpers the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a class of a regular expression: what lies between words.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A text, with NULL as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cuts(df: DataFrame, key: str, pieces: int) -> list[int]:
    """At most ``pieces`` - 1 ascending integers that cut the column into ranges of like row counts."""
    shares = [i / pieces for i in range(1, pieces)] or [0.5]
    found = df.agg(F.percentile_approx(F.col(key).cast("bigint"), shares, 10 * pieces)).first()[0]
    return sorted(set(found or []))


def range_of(key: str, at: list[int]) -> Column:
    """Place of the row's range: how many cuts are below its key. NULL comes first, with 0."""
    if not at:
        return F.lit(0)
    place = F.col(key).cast("bigint")

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(place <= F.lit(at[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    if len(at) <= 64:
        return F.when(place.isNull(), 0).otherwise(search(0, len(at)))
    # Two levels of a literal array: a search tree of thousands of branches would outgrow a method.
    step = int(len(at) ** 0.5) + 1
    coarse, fine = F.array(*map(F.lit, at[step - 1 :: step])), F.array(*map(F.lit, at))
    first = F.size(F.filter(coarse, lambda c: c < place)) * step
    within = first + F.size(F.filter(F.slice(fine, first + 1, step), lambda c: c < place))
    return F.when(place.isNull(), 0).otherwise(within)


def pieces_for(df: DataFrame, per_partition: int = 4) -> int:
    """Number of ranges or groups that keeps every task of the session's shuffles busy."""
    return per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------------------------- words in Arrow
def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, ASCII letters in lower case, and the index of each word's text.

    A word is a run of characters other than ASCII white space. NULL has no words.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, owner = parts.flatten(), np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not filled.all():
        flat, owner = flat.filter(pa.array(filled)), owner[filled]
    return flat, owner


def coded(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code of each word, 64-bit hash of each code's word)."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    entries = pc.dictionary_encode(flat)
    distinct = entries.dictionary.to_pylist()
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    return entries.indices.to_numpy(zero_copy_only=False).astype(np.int64), hashed


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
