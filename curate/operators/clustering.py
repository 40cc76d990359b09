"""K-means clusters, their number and their names."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.constants import SEED, SILHOUETTE_K
from curate.operators import lloyd
from curate.operators.vectors import category_similarity


def cluster_sizes(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "cluster_name").agg(F.count("*").alias("n"))


def choose_k(
    df: DataFrame, vec: str = "embedding", k_range: tuple[int, int] = SILHOUETTE_K, seed: int = SEED, row_id: str = "row_id"
) -> tuple[int, DataFrame, np.ndarray]:
    """The number of clusters with the largest cosine silhouette, the smallest on ties, with its vectors and centres."""
    units, fitted = lloyd.fit_all(df, range(k_range[0], k_range[1] + 1), row_id, vec, seed)
    scores = lloyd.silhouettes(units, fitted)
    k = max(scores, key=lambda k: (round(scores[k], 9), -k))
    return k, units, fitted[k]


def centre_rows(spark, centres: np.ndarray) -> DataFrame:
    """``(cluster, centroid)``: k rows."""
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cluster int, centroid array<double>")


def name_clusters(centers: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(class, cluster, cluster_name)`` from ``(class, cluster, centroid)`` and category anchors.

    Pairs of cluster and category are taken by falling similarity, of equal ones the higher cluster,
    then the higher ``category_pos``; a pair counts if its cluster has no name yet and its category is
    free. With more clusters than categories every category stays free. ``anchors`` without
    ``category_pos`` are numbered by name. A class has clusters × categories pairs, a few dozen,
    whatever its size; they are one array, folded once.
    """
    if "category_pos" not in anchors.columns:
        anchors = anchors.withColumn("category_pos", F.row_number().over(Window.orderBy("category")))
    order = anchors.select("category", "category_pos")
    pairs = category_similarity(centers, anchors, ["class", "cluster"]).join(F.broadcast(order), "category")
    pair = F.struct("similarity", F.col("cluster").cast("int").alias("cluster"), "category_pos", "category")
    ranked = pairs.groupBy("class").agg(
        F.sort_array(F.collect_list(pair), asc=False).alias("pairs"),
        (F.count_distinct("cluster") <= F.count_distinct("category")).alias("once"),
    )
    kind = dict(pairs.dtypes)["category"]
    none = F.array().cast(f"array<struct<cluster:int,category:{kind}>>")

    def take(named: Column, p: Column) -> Column:
        taken = F.exists(named, lambda n: (n["cluster"] == p["cluster"]) | (F.col("once") & (n["category"] == p["category"])))
        return F.when(taken, named).otherwise(F.concat(named, F.array(F.struct(p["cluster"].alias("cluster"), p["category"].alias("category")))))

    named = ranked.select("class", F.inline(F.aggregate("pairs", none, take)))
    return named.select("class", "cluster", F.col("category").alias("cluster_name"))


def cluster_texts(
    df: DataFrame,
    anchors: DataFrame,
    k: int | None = None,
    auto_k: bool = False,
    vec: str = "embedding",
    seed: int = SEED,
    row_id: str = "row_id",
) -> DataFrame:
    """Add ``cluster`` and ``cluster_name``; a row without a vector has none.

    Without ``k`` there are as many clusters as categories, or with ``auto_k`` as many as the
    silhouette prefers.
    """
    if k is None and auto_k:
        k, units, centres = choose_k(df, vec, seed=seed, row_id=row_id)
    else:
        k = anchors.count() if k is None else k
        units, fitted = lloyd.fit_all(df, [k], row_id, vec, seed)
        centres = fitted[k]
    centers = centre_rows(df.sparkSession, centres).withColumn("class", F.lit(0))
    names = name_clusters(centers, anchors).select("cluster", "cluster_name")
    placed = lloyd.assigned(units, centres).join(F.broadcast(names), "cluster", "left")
    return df.join(placed.withColumnRenamed("id", "__id"), F.col(row_id) == F.col("__id"), "left").drop("__id")
