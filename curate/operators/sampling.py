"""Seeded samples, quotas, caps and perturbed oversampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.constants import MIN_SEEDS, SEED, SEEDS_PER_CLUSTER
from curate.functions.hashing import draw_int, draw_key
from curate.functions.once import with_once
from curate.functions.text import words
from curate.operators.order_index import LEAF_ROWS, rank_by_order

BLOCK = 1 << 16
GROUP_LIMIT = 1000


def stratified_seeds(
    df: DataFrame,
    by: Sequence[str],
    row_id: str = "row_id",
    per_group: int = SEEDS_PER_CLUSTER,
    seed: int = SEED,
) -> DataFrame:
    """A seeded sample without replacement of up to ``per_group`` (at least 5) rows per group.

    A small rank filter is a group limit before the shuffle: a task sends at most that many rows of
    a group on. Larger samples are ranked by an order index. Both give the same rows; NULL is a group.
    """
    if per_group > GROUP_LIMIT:
        keyed = df.withColumn("__key", draw_key(seed, F.lit(":"), F.col(row_id)))
        ranked = rank_by_order(keyed, by, ["__key", row_id], "__place")
        return ranked.where(F.col("__place") <= per_group).select(*df.columns)
    order = Window.partitionBy(*by).orderBy("__key", row_id)
    ranked = df.withColumn("__key", draw_key(seed, F.lit(":"), F.col(row_id))).withColumn(
        "__place", F.row_number().over(order)
    )
    return ranked.where(F.col("__place") <= max(per_group, MIN_SEEDS)).drop("__key", "__place")


def cluster_quotas(clusters: DataFrame, targets: DataFrame, k: int | None = None) -> DataFrame:
    """``(class_pos, label, target, cluster_name, cluster_pos, quota)``.

    A class target is divided over its clusters in name order, the first ones taking the
    remainder. Dividing by the number of cluster names fills the target; ``k`` divides by that
    number instead, which leaves a shortfall if clusters share a name.
    """
    named = clusters.select("label", "cluster_name").distinct()
    group = Window.partitionBy("label")
    placed = named.withColumns(
        {
            "cluster_pos": (F.row_number().over(group.orderBy("cluster_name")) - 1).cast("int"),
            "__k": F.lit(k).cast("bigint") if k else F.count("*").over(group),
        }
    )
    extra = F.when(F.col("cluster_pos") < F.col("target") % F.col("__k"), 1).otherwise(0)
    return placed.join(F.broadcast(targets), "label").select(
        "class_pos",
        "label",
        "target",
        "cluster_name",
        "cluster_pos",
        (F.expr("target div __k") + extra).cast("bigint").alias("quota"),
    )


def numbered_rows(needs: DataFrame, keys: Sequence[str], n: str = "n", out: str = "i") -> DataFrame:
    """``n`` rows numbered from 0 for each row of ``needs``.

    Numbers are made block-wise and the blocks spread over tasks, so a large ``n`` is neither one
    array nor one task.
    """
    blocks = needs.where(F.col(n) > 0).select(
        *keys, n, F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({n} - 1) div {BLOCK}"))).alias("__block")
    )
    spread = blocks.repartition(*keys, "__block")
    first = F.col("__block") * BLOCK
    last = F.least(first + BLOCK, F.col(n)) - 1
    return spread.select(*keys, F.explode(F.sequence(first, last)).alias(out))


def perturb(w: Column, *draw: Column | str | int) -> Column:
    """Drop an inner word, double a word or swap two neighbours; short texts are only rejoined.

    ``w`` holds the words; ``draw`` seeds the choice of action and position.
    """
    n = F.size(w)
    action = draw_int(*draw, F.lit(":action")) % 3
    pick = draw_int(*draw, F.lit(":index"))

    def at(count: Column) -> Column:
        return (pick % count).cast("int")

    drop, dup, swap = at(n - 2) + 1, at(n), at(n - 1)
    dropped = F.concat(F.slice(w, F.lit(1), drop), F.slice(w, drop + 2, n))
    doubled = F.concat(F.slice(w, F.lit(1), dup + 1), F.slice(w, dup + 1, n))
    swapped = F.concat(
        F.slice(w, F.lit(1), swap), F.array(F.get(w, swap + 1), F.get(w, swap)), F.slice(w, swap + 3, n)
    )
    changed = F.when(action == 0, dropped).when(action == 1, doubled).otherwise(swapped)
    return F.array_join(F.when(n >= 4, changed).otherwise(w), " ")


def numbered_pool(pool: DataFrame, row_id: str = "row_id", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(label, pick, row_id)``: the rows of each class numbered from 1 in key order. No text is read."""
    ranked = rank_by_order(pool.select("label", F.col(row_id).alias("row_id")), ["label"], ["row_id"], "pick", leaf_rows)
    return ranked.select("label", "pick", "row_id")


def perturbed_oversample(pool: DataFrame, texts: DataFrame, needs: DataFrame, seed: int, row_id: str = "row_id") -> DataFrame:
    """``(label, i, text)``: exactly ``n`` perturbed texts per row ``(label, n)`` of ``needs``.

    ``pool`` comes from :func:`numbered_pool` and is numbers alone; row ``i`` draws one of them, and the texts
    of ``texts``, whose ``row_id`` no two rows share, are shuffled once, to the draws.
    """
    sizes = pool.groupBy("label").agg(F.max("pick").alias("__size"))
    wanted = needs.select("label", "n").join(sizes, "label")
    rows = numbered_rows(wanted, ["label", "__size"])
    picked = rows.withColumn(
        "pick", draw_int(seed, F.lit(":pick:"), F.col("label"), F.lit(":"), F.col("i"), hex_digits=15) % F.col("__size") + 1
    )
    drawn = picked.join(pool, ["label", "pick"]).select("label", "i", "row_id")
    found = drawn.join(texts.select(F.col(row_id).alias("row_id"), "text"), "row_id")
    split = with_once(found, "__words", words(F.col("text")))
    draw = (seed, F.lit(":"), F.col("label"), F.lit(":"), F.col("i"))
    return split.select("label", "i", perturb(F.col("__words"), *draw).alias("text"))
