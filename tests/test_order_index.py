"""Order index, keyed permutation, and the draws and ranks that rest on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curate import session
from curate.functions.permutation import grid, permuted
from curate.operators import sampling
from curate.operators.order_index import index_of, leaves_for, ordered, rank_by_order
from curate.plans import rebalance

LEAF = 20_000


def hot(spark, n=1_000_000):
    """One round that holds all rows of a cluster but a few, and a round far from all others."""
    line = F.col("id") * 7919 % n
    return spark.range(n).select(
        F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("k"),
        F.when(F.col("id") == 5, 10**15).otherwise(3).cast("bigint").alias("round"), line.alias("line"),
    )


def test_one_round_is_many_leaves(spark):
    rows = hot(spark)
    leaves = ordered(rows, ["k"], ["round", "line"], LEAF)
    sizes = [r["count"] for r in leaves.groupBy("__leaf").count().collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) <= LEAF and len(sizes) > 40
    assert index_of(leaves, ["k"]).count() <= len(sizes) + 2


def test_ranks_of_a_hot_group_are_exact(spark):
    ranked = rank_by_order(hot(spark, 300_000), ["k"], ["round", "line"], "place", 10_000).toPandas()
    assert len(ranked) == 300_000
    for _, mine in ranked.sort_values(["round", "line"]).groupby("k"):
        assert (mine["place"].to_numpy() == np.arange(1, len(mine) + 1)).all()
        assert set(mine["place_size"]) == {len(mine)}


def test_null_groups_and_numbers_keep_their_rows(spark):
    rows = [(None, 2, "x"), (None, None, "y"), ("a", None, "z"), ("a", 5, "u"), ("a", 5, "v"), (None, 2, "w")]
    df = spark.createDataFrame(rows, "k string, n long, t string")
    for leaf_rows in (1, 100):
        got = {(r["k"], r["n"], r["t"]): (r["rank"], r["rank_size"]) for r in rank_by_order(df, ["k"], ["n", "t"], leaf_rows=leaf_rows).collect()}
        assert got == {
            (None, None, "y"): (1, 3), (None, 2, "w"): (2, 3), (None, 2, "x"): (3, 3), ("a", None, "z"): (1, 3), ("a", 5, "u"): (2, 3), ("a", 5, "v"): (3, 3),
        }
    assert rank_by_order(df.where("false"), ["k"], ["n"]).count() == 0
    assert leaves_for(0) == 1 and leaves_for(10**12) == 10_000


def test_permutations_are_bijections(spark):
    sizes = [1, 2, 3, 5, 7, 20, 97, 1000, 2500]
    df = spark.createDataFrame([(n, k) for n in sizes for k in range(6)], "n long, k int")
    got = df.select("n", "k", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda x: permuted(x, F.col("n"), F.col("k"), F.lit(":seed"))).alias("p")).collect()
    seen = {}
    for r in got:
        assert sorted(r["p"]) == list(range(r["n"]))
        seen.setdefault(r["n"], set()).add(tuple(r["p"]))
    assert all(len(p) >= 5 for n, p in seen.items() if n >= 7)  # keys give different permutations


def test_images_are_spread_evenly(spark):
    n = 10
    df = spark.range(20_000).select(permuted(F.lit(0), F.lit(n), F.col("id"), F.lit(":x")).alias("p")).groupBy("p").count().collect()
    assert len(df) == n and max(abs(r["count"] - 2000) for r in df) < 300


def test_grids_hold_all_numbers(spark):
    for r in spark.range(1, 5000).select("id", *[c.alias(x) for c, x in zip(grid(F.col("id")), "ab")]).collect():
        assert r["id"] <= r["a"] * r["b"] < r["id"] + r["a"]


@pytest.mark.parametrize("salt_rounds", [50_000, 7])
def test_prompts_draw_without_replacement(spark, salt_rounds):
    quotas = spark.createDataFrame([(0, "c", 400), (0, "d", 35), (2, "c", 0)], "label int, cluster_name string, quota long")
    seeds = spark.createDataFrame(
        [(0, "c", i, f"c{i}") for i in range(12)] + [(0, "d", 50 + i, f"d{i}") for i in range(3)] + [(2, "c", 90, "e")],
        "label int, cluster_name string, row_id long, text string",
    )
    plan = rebalance.prompt_plan(quotas, seeds, "{examples}", {}, "x", salt_rounds=salt_rounds).collect()
    drawn = {(r["cluster_name"], r["round"]): r["prompt"].split("\n") for r in plan}
    assert sorted(drawn) == [("c", i) for i in range(40)] + [("d", i) for i in range(4)]
    for (name, _), texts in drawn.items():
        assert len(set(texts)) == len(texts) == (5 if name == "c" else 3)
    assert len({tuple(t) for (name, _), t in drawn.items() if name == "c"}) > 35
    assert {x for (name, _), t in drawn.items() if name == "c" for x in t} == {f"- c{i}" for i in range(12)}


def test_round_keys_are_spread_over_copies(spark):
    """No join key holds all rounds of a cluster: with many rounds there are many copies of its examples."""
    seeds = spark.createDataFrame([(0, "c", i, f"c{i}") for i in range(6)], "label int, cluster_name string, row_id long, text string")
    rounds = spark.createDataFrame([(0, "c", 1_000)], "label int, cluster_name string, n long")
    row = rebalance._clusters(rounds, seeds, 100).first()
    assert (row["__seeds"], row["__salts"]) == (6, 10)


def test_top_up_turns_go_round_robin(spark):
    quotas = spark.createDataFrame([(0, "a", 0, 5), (0, "b", 1, 5), (0, "c", 2, 5)], "label int, cluster_name string, cluster_pos int, quota long")
    seeds = spark.createDataFrame([(0, c, i, c) for i, c in enumerate("abc")], "label int, cluster_name string, row_id long, text string")
    needs = spark.createDataFrame([(0, 71)], "label int, n long")
    plan = rebalance.top_up_plan(needs, quotas, seeds, "{examples}", {}, "x").collect()
    assert sorted((r["turn"], r["cluster_name"]) for r in plan) == [(500 + i, "abc"[i % 3]) for i in range(8)]


def test_large_samples_equal_small_ones(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, None).otherwise("a").alias("k"))
    large = {r["row_id"] for r in sampling.stratified_seeds(df, ["k"], per_group=1001).collect()}
    small = {r["row_id"] for r in sampling.stratified_seeds(df, ["k"], per_group=1000).collect()}
    assert len(large) == 2002 and len(small) == 2000 and small < large


def test_the_folder_of_a_session_without_one(spark, monkeypatch):
    """The folder is kept outside the session's settings, which cannot be changed once it runs."""
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(session, "_OWN_FOLDERS", {})
    folder = session.shared_folder(spark)
    assert folder == session.shared_folder(spark) and session.scratch_path(spark, "x").startswith(folder)


def test_stored_stages_can_be_cleared(spark, monkeypatch):
    from pathlib import Path

    monkeypatch.setattr(session, "_STORED", {})
    df = session.stored(spark.range(3), "kept")
    place = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert place.exists() and session.clear_stored(spark) == 1 and not place.exists()
    assert session.clear_stored(spark) == 0
