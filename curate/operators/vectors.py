"""Vector tables: centroids, centroid-to-category similarity, nearest centroid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.functions.vectors import as_double, dot, norm, unit
from curate.session import stored

LIST_ROWS = 1_000
SALT_ROWS = 50_000
"""Rows that meet a set of lists in one place."""
SET_LISTS = 16


def centroids(df: DataFrame, by: Sequence[str], vec: str = "embedding") -> DataFrame:
    """Component-wise mean per group as ``centroid``; each task sends one partial mean per group."""
    mean = Summarizer.mean(array_to_vector(as_double(F.col(vec))))
    return df.groupBy(*by).agg(vector_to_array(mean).alias("centroid"))


def _met(rows: DataFrame, lists: DataFrame, n_rows: int, n_lists: int) -> DataFrame:
    """Every row of a numbered table with each list.

    The rows are dealt over salts of some SALT_ROWS, and the lists over sets of SET_LISTS; a row goes to
    each set once, a list to each salt once, so neither many rows nor many lists are one task.
    """
    salts, sets = max(1, -(-n_rows // SALT_ROWS)), max(1, -(-n_lists // SET_LISTS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(salts)).cast("int")).withColumn("__set", every(sets))
    right = lists.withColumn("__set", F.pmod("__block", F.lit(sets)).cast("int")).withColumn("__salt", every(salts))
    return left.join(right.drop("__block"), ["__salt", "__set"])


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows with a number ``__row``, stored, so that a retry cannot number them anew."""
    return stored(df.withColumn("__row", F.monotonically_increasing_id()), name)


def _list_of(df: DataFrame, *columns: Column) -> Column:
    """The rows of a table of at most LIST_ROWS as one array, computed once."""
    return df.agg(F.array_sort(F.collect_list(F.struct(*columns)))).scalar()


def _lists_of(df: DataFrame, n: int, *columns: Column, spread: str, out: str) -> DataFrame:
    """``n`` rows as lists ``(__block, out)`` of near LIST_ROWS each, one per row."""
    block = F.pmod(F.xxhash64(spread), F.lit(-(-n // LIST_ROWS))).alias("__block")
    return df.select("*", block).groupBy("__block").agg(F.collect_list(F.struct(*columns)).alias(out))


def category_similarity(
    centers: DataFrame, anchors: DataFrame, cluster: Sequence[str] = ("cluster",)
) -> DataFrame:
    """Cosine similarity of every centroid with every category anchor, ``(…, category, similarity)``.

    ``anchors`` is ``(category, embedding)``; a short list becomes one array, a long one several, which
    the centroids meet by a join.
    """
    entry = (F.col("category"), unit(F.col("embedding")).alias("v"))
    n = anchors.count()
    if n <= LIST_ROWS:
        met = centers.select(*cluster, "centroid").withColumn("__all", _list_of(anchors, *entry))
    else:
        numbered = _numbered(centers.select(*cluster, "centroid"), "centers")
        lists = _lists_of(anchors, n, *entry, spread="category", out="__all")
        met = _met(numbered, lists, numbered.count(), -(-n // LIST_ROWS))
    wide = met.select(*cluster, "centroid", F.explode("__all").alias("__a"))
    similarity = dot(F.col("centroid"), F.col("__a.v")) / norm(F.col("centroid"))
    return wide.select(*cluster, F.col("__a.category").alias("category"), similarity.alias("similarity"))


def nearest_centroid(
    df: DataFrame, centers: DataFrame, vec: str = "embedding", name: str = "cluster", normalise: bool = False
) -> DataFrame:
    """Add the name of the closest centroid (smallest Euclidean distance, lowest name on ties).

    ``normalise`` brings the vectors to length 1 first, for centroids of such vectors. Up to LIST_ROWS
    centroids are one array and no row is shuffled; more are lists that the rows meet by a join.
    """

    def entry(c: Column, v: Column) -> Column:
        gap = F.aggregate(
            F.zip_with(v, c["v"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
        )
        return F.struct(gap.alias("gap"), c[name].alias("name"))

    best = F.array_min(F.zip_with("__all", F.array_repeat("__v", F.size("__all")), entry))
    own = (unit(F.col(vec)) if normalise else as_double(F.col(vec))).alias("__v")
    center = (F.col(name), as_double(F.col("centroid")).alias("v"))
    n = centers.count()
    if n <= LIST_ROWS:
        met = df.select("*", own).withColumn("__all", _list_of(centers, *center))
        return met.withColumn(name, best["name"]).drop("__v", "__all")
    numbered = _numbered(df, "rows")
    lists = _lists_of(centers, n, *center, spread=name, out="__all")
    met = _met(numbered.select("__row", own), lists, numbered.count(), -(-n // LIST_ROWS))
    found = met.groupBy("__row").agg(F.min(best).alias("__best"))
    return numbered.join(found, "__row", "left").withColumn(name, F.col("__best.name")).drop("__row", "__best")
