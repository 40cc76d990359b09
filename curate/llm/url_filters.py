"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

Every URL is expanded to the expressions that a rule could have: the ends of its host, cut at a dot,
times the beginnings of its path. A rule can only equal an expression of its own lengths, so just
the lengths that rules have are expanded, and a host with thousands of labels stays cheap. The
expressions meet the rules on the first 32 bits of their digests; the whole digests then confirm.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.llm.common import let, text_of

BROADCAST_RULES = 50_000
"""Rules of at most so many rows (some 10 MB) are sent to every executor; more are shuffled."""


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """(host in lower case, path) of a URL; both empty for NULL and for a text without ``://``."""
    whole = text_of(url)
    mark = F.locate("://", whole)
    rest = F.when(mark > 0, F.substr(whole, mark + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _lengths(rules: DataFrame, column: str) -> Column:
    """The distinct lengths of a column of the rules: no more than the longest rule has characters."""
    found = rules.agg(F.array_sort(F.collect_set(F.length(column)))).first()[0]
    return F.array(*[F.lit(x) for x in found]).cast("array<int>")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """(``keep``…, host, path, rule, verdict): a row for each row of ``pages``.

    ``rules`` has (host, path, verdict) with hosts in lower case. A rule fits its host and all its
    subdomains if the path starts with the rule's. The longest rule wins; of equally long ones that
    with the longer host, then the one that blocks. Without a rule: NULL and ``default``. A rule
    with a NULL host, path or verdict is ignored. Repeated pages are judged one by one, an empty
    table of pages or rules is fine, and columns not in ``keep`` are not read.
    """
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    host, path = host_and_path(url)
    rows = pages.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)],
        F.monotonically_increasing_id().alias("__row"),
        host.alias("__host"),
        path.alias("__path"),
    )
    host_col, path_col = F.col("__host"), F.col("__path")
    ends = F.filter(
        _lengths(rules, "host"),
        lambda n: (n == F.length(host_col))
        | ((n < F.length(host_col)) & (F.substr(host_col, F.length(host_col) - n, F.lit(1)) == ".")),
    )
    starts = F.filter(_lengths(rules, "path"), lambda n: n <= F.length(path_col))

    def expression(end: Column, start: Column) -> Column:
        h, p = F.right(host_col, end), F.left(path_col, start)
        return F.struct(h.alias("h"), p.alias("p"), _digest(h, p).alias("digest"))

    expressions = let(starts, lambda some: F.flatten(F.transform(ends, lambda e: F.transform(some, lambda s: expression(e, s)))))
    wide = rows.select("*", F.explode_outer(expressions).alias("__e")).select(
        "*", F.col("__e.digest").alias("__digest"), _short(F.col("__e.digest")).alias("__short")
    ).drop("__e")
    digest = _digest(F.col("host"), F.col("path"))
    known = rules.select(
        _short(digest).alias("__rshort"),
        digest.alias("__rdigest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("length"),
            F.length("host").alias("host_length"),
            (F.col("verdict") == "block").alias("blocks"),
            F.concat("host", "path").alias("rule"),
            F.col("verdict").alias("verdict"),
        ).alias("__rule"),
    )
    few = rules.limit(broadcast_rules + 1).count() <= broadcast_rules
    met = wide.join(
        F.broadcast(known) if few else known,
        (F.col("__short") == F.col("__rshort")) & (F.col("__digest") == F.col("__rdigest")),
        "left",
    )
    keys = [f"__k{i}" for i in range(len(keep))]
    best = met.groupBy("__row", *keys, "__host", "__path").agg(F.max("__rule").alias("__best"))
    return best.select(
        *[F.col(k).alias(c) for k, c in zip(keys, keep)],
        host_col.alias("host"),
        path_col.alias("path"),
        F.col("__best.rule").alias("rule"),
        F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"),
    )
