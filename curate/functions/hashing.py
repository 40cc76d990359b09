"""Seeded, engine-independent pseudo random numbers from MD5.

``rand()`` depends on partitioning; these depend only on the row, so a lost executor or a
different cluster size gives the same draw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def draw_key(*parts) -> Column:
    """Hex digest of the concatenated parts; sorting by it gives a seeded random order."""
    return F.md5(_joined(parts))


def draw_int(*parts, hex_digits: int = 8) -> Column:
    """Non-negative BIGINT from the first hex digits of the digest (15 digits = 60 bits)."""
    return F.conv(F.substring(draw_key(*parts), 1, hex_digits), 16, 10).cast("bigint")

