"""Text clean-up as built-in expressions.

Character classes are spelled out, because ``\\s``, ``\\w`` and ``\\d`` are ASCII-only in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
LINE_BREAK = "\n"

# --- fixed values: replacement rules of the text normaliser, applied in this order --------------
NORMALISER_RULES = (
    (rf"http{NOT_SPACE}+|www\.{NOT_SPACE}+", "[URL]"),
    (rf"@{WORD}+", "[USER]"),
    (rf"#({WORD}+)", "$1"),
    (rf"{SPACE}+", " "),
)

# --- fixed values: line prefixes a model adds, removed once each in this order -------------------
LINE_PREFIXES = (
    rf"^{SPACE}*\p{{Nd}}+[.)]{SPACE}*",
    rf"^{SPACE}*[-*]{SPACE}*",
)
QUOTED_LINE = r"^[\x22\x27]([^\n]+)[\x22\x27]$"


def strip(text: Column) -> Column:
    """Remove white space (Unicode included) at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def normalise(text: Column) -> Column:
    """Mask links and mentions, unwrap hashtags, collapse white space."""
    for pattern, replacement in NORMALISER_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(text)


def clean_line(line: Column) -> Column:
    """Drop a list number, then a bullet, then one pair of quotes."""
    line = strip(line)
    for prefix in LINE_PREFIXES:
        line = F.regexp_replace(line, prefix, "")
    return strip(F.regexp_replace(line, QUOTED_LINE, "$1"))


def words(text: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.array_remove(F.split(text, rf"{SPACE}+"), "")


def text_key(text: Column, trim: bool = False) -> Column:
    """Key under which two texts count as the same."""
    return F.lower(strip(text) if trim else text)
