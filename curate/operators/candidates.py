"""Filtering and de-duplicating candidate texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.constants import MAX_CHARS, MIN_CHARS, REJECTED
from curate.functions.once import with_once
from curate.functions.text import LINE_BREAK, clean_line, strip, text_key


def response_lines(responses: DataFrame, keys: Sequence[str], response: str = "response") -> DataFrame:
    """One row per non-blank line of a model response, with its position."""
    lines = responses.select(*keys, F.posexplode(F.split(response, LINE_BREAK)).alias("pos", "line"))
    return with_once(lines, "line", strip(F.col("line"))).where("line <> ''")


def reject_reason(
    text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, rejected: Mapping[str, str] = REJECTED
) -> Column:
    """Why a cleaned line is not usable, or NULL if it is.

    ``rejected`` maps a reason to a regular expression over the lower-cased line; the first that is found counts.
    """
    reason = F.when(text.isNull() | (text == ""), F.lit("empty")).when(
        ~F.char_length(text).between(min_chars, max_chars), F.lit("length")
    )
    for name, pattern in rejected.items():
        reason = reason.when(F.lower(text).rlike(pattern), F.lit(name))
    return reason


def is_valid(text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, rejected: Mapping[str, str] = REJECTED) -> Column:
    return reject_reason(text, min_chars, max_chars, rejected).isNull()


def first_of_key(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """Keep the first row of every key.

    A digest of 256 bits stands for the key, so a text travels once, as itself. The rank-equals-one filter
    becomes a group limit before the shuffle, so each task sends at most one row of a key however often
    the key occurs.
    """
    first = Window.partitionBy("__key").orderBy(*[F.asc(c) for c in order])
    digest = F.unhex(F.sha2(key.cast("string"), 256))
    ranked = df.withColumn("__key", digest).withColumn("__place", F.row_number().over(first))
    return ranked.where("__place = 1").drop("__key", "__place")


def deduplicate(df: DataFrame, order: Sequence[str], text: str = "text") -> DataFrame:
    """Drop texts that repeat up to case and outer white space; the first in ``order`` stays."""
    return first_of_key(df, text_key(F.col(text), trim=True), order)


def without_seen(df: DataFrame, seen: DataFrame, text: str = "text") -> DataFrame:
    """Drop texts that equal, up to case, any text of ``seen``.

    Digests of 256 bits stand for the texts, so no text of ``seen`` is shuffled, and equal ones are
    reduced to one before the shuffle, so a line that fills the table is no hot key.
    """
    key = F.unhex(F.sha2(text_key(F.col(text)), 256))
    known = seen.select(key.alias("__key")).distinct()
    keyed = df.withColumn("__key", key)
    return keyed.join(known, "__key", "left_anti").drop("__key")


def filter_candidates(
    candidates: DataFrame,
    order: Sequence[str],
    seen: DataFrame | None = None,
    raw: str = "raw",
    min_chars: int = MIN_CHARS,
    max_chars: int = MAX_CHARS,
    rejected: Mapping[str, str] = REJECTED,
) -> DataFrame:
    """Clean, validate, keep the first of equal texts, drop those already seen; adds ``text``.

    Equal texts are reduced to one before the anti-join, on both sides, which gives the same rows and
    leaves no hot key to join on.
    """
    cleaned = with_once(candidates, "text", clean_line(F.col(raw)))
    valid = cleaned.where(is_valid(F.col("text"), min_chars, max_chars, rejected))
    unique = first_of_key(valid, text_key(F.col("text")), order)
    return unique if seen is None else without_seen(unique, seen)


def union_seen(*tables: DataFrame, text: str = "text") -> DataFrame:
    """Distinct keys of several text tables.

    They are grouped by digests of 256 bits, so a key is compared once, where it is made, and each task
    sends one row of a line that fills its table.
    """
    keys = reduce(DataFrame.union, [t.select(text_key(F.col(text)).alias("key")) for t in tables])
    return keys.groupBy(F.unhex(F.sha2("key", 256))).agg(F.any_value("key").alias("key")).select("key")
