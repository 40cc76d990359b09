"""Connected components of a graph kept as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.session import stored


def _roots(step: DataFrame) -> DataFrame:
    """Follow (id, to), where no ``to`` is above its id, to the end; every pass doubles the stride."""
    while True:
        hop = step.select(F.col("id").alias("to"), F.col("to").alias("far"))
        far = F.coalesce("far", "to")
        step = stored(step.join(hop, "to", "left").select("id", far.alias("to"), (far != F.col("to")).alias("moved")), "step")
        if not step.where("moved").take(1):
            return step.drop("moved")


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component): every end of a link (a, b) with the smallest id that links lead to.

    Links are contracted round by round: each name points to the least of itself and its neighbours,
    pointers are followed to their ends, and the links are renamed. Chains of any length collapse in
    one round. Every step is stored, so a lost executor costs one step, and is read from storage, so
    that joins on a name with very many ends can be split. A minimum per end is taken before the
    shuffle, so such an end sends one row per task. Links with a NULL end are ignored.
    """
    links = stored(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct(), "links")
    names = None
    for _ in range(rounds):
        both = links.select(F.col("a").alias("id"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("near")))
        step = both.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("to"))
        step = _roots(stored(step, "step"))
        if names is None:
            names = step.select("id", F.col("to").alias("component"))
        else:
            moved = step.select(F.col("id").alias("component"), "to")
            names = names.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
            names = stored(names, "names")
        left = links.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        links = stored(left.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if links.isEmpty():
            return names
    raise RuntimeError("the components did not settle")
