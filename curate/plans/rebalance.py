"""Filling minority classes: prompt plan, candidate intake, top-up and guaranteed fill."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate import constants as C
from curate.functions.permutation import permuted
from curate.functions.text import text_key
from curate.operators.balance import label_name, rebalance_targets
from curate.operators.candidates import filter_candidates, first_of_key
from curate.operators.gate import similarity_gate
from curate.operators.order_index import LEAF_ROWS, rank_by_order
from curate.operators.sampling import (
    cluster_quotas,
    numbered_pool,
    numbered_rows,
    perturbed_oversample,
    stratified_seeds,
)
from curate.session import stored

TOP_UP_FIRST_STYLE = 500
SALT_ROUNDS = 50_000
"""Rounds of a cluster that meet one copy of its examples."""


# ------------------------------------------------------------------------------ prompt plan
STYLE_PARTS = {"tone": C.TONES, "length": C.LENGTHS, "formality": C.FORMALITIES, "typos": C.TYPOS, "syntax": C.SYNTAXES}


def style_column(index: Column, n: int = 20, parts: Mapping[str, Sequence[str]] = STYLE_PARTS) -> Column:
    """The style of a running number, as a struct with a value of every part.

    Numbers stand for combinations like the digits of a number stand for its value, the last part
    being the lowest digit. ``n`` of them, equally far apart, are used in turn.
    """
    lowest, places = 1, {}
    for name in reversed(parts):
        places[name] = lowest
        lowest *= len(parts[name])
    stride, used = max(1, lowest // n), min(n, lowest)
    code = (index % used) * stride
    digit = {name: F.floor(code / places[name]) % len(values) for name, values in parts.items()}
    return F.struct(*[F.get(F.array(*map(F.lit, values)), digit[name].cast("int")).alias(name) for name, values in parts.items()])


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Replace ``{name}`` markers of a caller-supplied template."""
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def _clusters(rounds: DataFrame, seeds: DataFrame, salt_rounds: int) -> DataFrame:
    """One row per cluster: its rounds, with how many examples it has and over how many copies rounds are spread."""
    sizes = seeds.groupBy("label", "cluster_name").agg(F.count("*").alias("__seeds"))
    return rounds.join(sizes, ["label", "cluster_name"]).withColumn("__salts", F.greatest(F.ceil(F.col("n") / salt_rounds), F.lit(1)).cast("int"))


def _prompts(
    rows: DataFrame,
    clusters: DataFrame,
    seeds: DataFrame,
    number: str,
    draw: Column,
    template: str,
    intents: Mapping[str, str],
    default_intent: str,
    row_id: str,
    few_shot: int,
    variants: int,
) -> DataFrame:
    """Style, seeded examples and filled template of each row ``(label, cluster_name, __seeds, __salts, number)``.

    A round draws *numbers* of examples, the images of 0, 1, … under a permutation of its own, so nothing is sorted
    or listed. Texts come last, to a key of cluster, copy and number, which holds a bounded part of the rounds.
    """
    by = ["label", "cluster_name"]
    numbered = rank_by_order(seeds.select(*by, row_id, "text"), by, [row_id], "__pick")
    copies = numbered.join(clusters.select(*by, "__salts"), by).select(
        *by, (F.col("__pick") - 1).alias("__pick"), "text", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt")
    )
    turn = F.explode(F.sequence(F.lit(0), F.least(F.lit(few_shot), F.col("__seeds")).cast("int") - 1)).alias("__turn")
    drawn = rows.select("*", F.pmod(F.col(number), F.col("__salts")).cast("int").alias("__salt"), turn)
    key = (draw, F.lit(":"), F.col("label"), F.lit(":"), F.col("cluster_name"))
    picked = drawn.withColumn("__pick", permuted(F.col("__turn"), F.col("__seeds"), *key))
    found = picked.join(copies, [*by, "__salt", "__pick"]).groupBy(*by, number).agg(
        F.sort_array(F.collect_list(F.struct("__turn", "text"))).alias("drawn")
    )
    known = F.create_map(*[F.lit(x) for pair in intents.items() for x in pair])
    styled = found.withColumn("style", style_column(F.col(number)))
    prompt = fill_template(
        template,
        {
            "n_variants": F.lit(variants),
            "category": F.replace("cluster_name", F.lit("_"), F.lit(" ")),
            "intent": F.coalesce(F.try_element_at(known, F.col("cluster_name")), F.lit(default_intent)),
            "tone": F.col("style.tone"),
            "length": F.col("style.length"),
            "formality": F.col("style.formality"),
            "typos": F.col("style.typos"),
            "syntax": F.col("style.syntax"),
            "examples": F.array_join(F.transform("drawn", lambda d: F.concat(F.lit("- "), d["text"])), "\n"),
        },
    )
    return styled.select("label", "cluster_name", number, "style.*", prompt.alias("prompt"))


def prompt_plan(
    quotas: DataFrame,
    seeds: DataFrame,
    template: str,
    intents: Mapping[str, str],
    default_intent: str,
    row_id: str = "row_id",
    seed: int = C.SEED,
    few_shot: int = C.FEW_SHOT,
    variants: int = C.VARIANTS_PER_ROUND,
    salt_rounds: int = SALT_ROUNDS,
) -> DataFrame:
    """One row per prompt to send: ``(label, cluster_name, round, style…, prompt)``.

    A cluster needs ``ceil(quota / variants)`` rounds. Round r takes style r of the grid and its own
    seeded draw of ``few_shot`` examples without replacement, or all if there are fewer.
    """
    rounds = quotas.select(
        "label", "cluster_name", F.expr(f"(quota + {variants} - 1) div {variants}").alias("n")
    )
    clusters = _clusters(rounds, seeds, salt_rounds)
    rows = numbered_rows(clusters, ["label", "cluster_name", "__seeds", "__salts"], out="round")
    draw = F.col("round") + (seed + 1)
    return _prompts(rows, clusters, seeds, "round", draw, template, intents, default_intent, row_id, few_shot, variants)


def top_up_plan(
    needs: DataFrame,
    quotas: DataFrame,
    seeds: DataFrame,
    template: str,
    intents: Mapping[str, str],
    default_intent: str,
    row_id: str = "row_id",
    seed: int = C.SEED,
    few_shot: int = C.FEW_SHOT,
    variants: int = C.VARIANTS_PER_ROUND,
    salt_rounds: int = SALT_ROUNDS,
) -> DataFrame:
    """Prompts for the rows ``(label, n)`` still missing: ``(label, cluster_name, turn, style…, prompt)``.

    Attempts go round robin over the clusters of a class: the cluster in place p of c has the attempts p, p + c, ….
    Styles start at 500 and the draws have their own seed range.
    """
    attempts = needs.select("label", F.expr(f"(n + {variants} - 1) div {variants}").alias("__attempts"))
    sizes = quotas.groupBy("label").agg(F.count("*").cast("bigint").alias("__clusters"))
    placed = quotas.select("label", "cluster_name", "cluster_pos").join(sizes, "label").join(attempts, "label")
    own = F.expr("(__attempts - cluster_pos + __clusters - 1) div __clusters")
    clusters = _clusters(placed.withColumn("n", F.greatest(own, F.lit(0))), seeds, salt_rounds)
    keys = ["label", "cluster_name", "cluster_pos", "__clusters", "__seeds", "__salts"]
    turn = F.col("cluster_pos") + F.col("i") * F.col("__clusters") + TOP_UP_FIRST_STYLE
    rows = numbered_rows(clusters, keys).withColumn("turn", turn)
    draw = F.col("turn") + (seed + 1 + C.TOP_UP_SEED_SHIFT)
    return _prompts(rows, clusters, seeds, "turn", draw, template, intents, default_intent, row_id, few_shot, variants)


# -------------------------------------------------------------------------- candidate intake
def gated_candidates(
    candidates: DataFrame,
    real: DataFrame,
    quotas: DataFrame,
    refs: DataFrame,
    threshold: float | None,
) -> DataFrame:
    """Clean, validate, de-duplicate, exclude seen texts, then gate on similarity to ``refs``.

    ``candidates`` is ``(label, cluster_name, round, line, raw[, embedding])``. Arrival order is
    (class, cluster, round, line). ``quotas`` should be a stored table, whose size decides how it is
    joined. As in a generation loop, a text the gate drops still counts
    as seen. On a table with more candidates than the quotas need, surplus texts count as seen
    too.
    """
    places = quotas.select("label", "cluster_name", "class_pos", "cluster_pos", "target", "quota")
    arrived = candidates.join(places, ["label", "cluster_name"])
    order = ["class_pos", "cluster_pos", "round", "line"]
    unique = filter_candidates(arrived, order, seen=real)
    if threshold is not None:
        unique = similarity_gate(unique, refs, ["label", "cluster_name"], threshold)
    return unique.select("label", "cluster_name", *order, "target", "quota", "text")


def capped(gated: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Add ``place``, the arrival rank inside the cluster; a row counts if it is within the quota."""
    return rank_by_order(gated, ["label", "cluster_name"], ["round", "line"], "place", leaf_rows).drop("place_size")


def accepted_candidates(gated: DataFrame, targets: DataFrame) -> DataFrame:
    """``(label, origin, text)``: each cluster up to its quota, then leftovers up to the target.

    Leftovers are taken round by round over the clusters, as a top-up loop does.
    """
    placed = capped(gated)
    main = placed.where("place <= quota")
    first = main.select("label", F.lit("candidate").alias("origin"), "text")
    short = _shortfall(targets, main)
    if short is None:
        return first
    short = short.withColumnRenamed("n", "short")
    left = placed.where("place > quota").join(F.broadcast(short), "label")
    topped = rank_by_order(left, ["label"], ["round", "cluster_pos", "line"], "turn").where("turn <= short")
    return first.unionByName(topped.select("label", F.lit("top_up").alias("origin"), "text"))


def _per_class(df: DataFrame) -> DataFrame | None:
    """A table of one row per class as constants, so that later stages do not carry its plan.

    None if it has no rows.
    """
    values = [F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in df.dtypes]) for r in df.collect()]
    return df.sparkSession.range(1).select(F.inline(F.array(*values))) if values else None


def _shortfall(targets: DataFrame, rows: DataFrame) -> DataFrame | None:
    """``(label, n)`` for the classes that have fewer rows than their target, or None."""
    have = rows.groupBy("label").agg(F.count("*").alias("have"))
    short = targets.join(have, "label", "left").select(
        "label", (F.col("target") - F.coalesce("have", F.lit(0))).cast("bigint").alias("n")
    )
    return _per_class(short.where("n > 0"))


def synthetic_rows(
    real: DataFrame,
    candidates: DataFrame,
    targets: DataFrame,
    threshold: float | None,
    k: int | None = None,
    seed: int = C.SEED,
    seeds_per_cluster: int = C.SEEDS_PER_CLUSTER,
    refs: str = "seeds",
) -> DataFrame:
    """``(label, origin, text)`` with exactly ``target`` rows per class of ``targets``.

    ``targets`` should be a small stored or constant table, as it is read by every stage.

    Accepted candidates come first, perturbed real texts fill what is missing; repeats of a class
    are dropped and the gap patched with perturbed texts that may repeat. Each stage is stored,
    and the fill runs only if a class is short. ``refs`` says what candidates are compared with: the
    ``seeds`` of their cluster, or ``all`` real rows of it.
    """
    by = ["label", "cluster_name"]
    mine = real.join(F.broadcast(targets.select("label")), "label", "left_semi")
    quotas = stored(cluster_quotas(mine, targets, k), "quotas")
    if refs not in ("seeds", "all"):
        raise ValueError("refs is 'seeds' or 'all'")
    known = mine if refs == "all" else stratified_seeds(mine, by, per_group=seeds_per_cluster, seed=seed)
    gated = stored(gated_candidates(candidates, real, quotas, known, threshold), "gated")
    accepted = stored(accepted_candidates(gated, targets), "accepted")

    short = _shortfall(targets, accepted)
    if short is None:
        return accepted
    texts = mine.join(F.broadcast(short.select("label")), "label", "left_semi")
    pool = numbered_pool(texts)
    fill = perturbed_oversample(pool, texts, short, seed + C.FILL_SEED_SHIFT)
    key = F.concat_ws(":", F.col("label").cast("string"), text_key(F.col("text"), trim=True))
    taken = accepted.select(key.alias("__taken"))
    fresh = first_of_key(fill, key, ["i"]).withColumn("__taken", key).join(taken, "__taken", "left_anti")
    filled = stored(
        accepted.unionByName(fresh.select("label", F.lit("fill").alias("origin"), "text")), "filled"
    )
    short = _shortfall(targets, filled)
    if short is None:
        return filled
    patch = perturbed_oversample(pool, texts, short, seed + C.PATCH_SEED_SHIFT)
    return filled.unionByName(patch.select("label", F.lit("patch").alias("origin"), "text"))


def augment(
    real: DataFrame,
    candidates: DataFrame,
    threshold: float | None,
    balance: str | int = "majority",
    labels: Sequence[int] = C.MINORITY_LABELS,
    k: int | None = None,
    seed: int = C.SEED,
    n_classes: int = 3,
    refs: str = "seeds",
) -> DataFrame:
    """The real rows plus synthetic rows that bring each minority class to its target.

    ``real`` is ``(row_id, text, label, cluster_name[, embedding])``. Columns out:
    ``row_id`` (NULL for synthetic rows), ``text, label, label_name, is_synthetic, origin``.
    """
    targets = _per_class(rebalance_targets(real, balance, labels, n_classes))
    kept = real.select(
        "row_id", "text", "label", F.lit(False).alias("is_synthetic"), F.lit("real").alias("origin")
    )
    if targets is None:
        return kept.withColumn("label_name", label_name(F.col("label")))
    made = synthetic_rows(real, candidates, targets, threshold, k, seed, refs=refs)
    added = made.select(
        F.lit(None).cast("bigint").alias("row_id"), "text", "label", F.lit(True).alias("is_synthetic"), "origin"
    )
    both = kept.unionByName(added)
    return both.withColumn("label_name", label_name(F.col("label")))
