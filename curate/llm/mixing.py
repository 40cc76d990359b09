"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots. Slot i has the point ``frac(i * golden ratio)``; the cumulative target
shares map it to a source, so every stretch of the mix holds each source in its share. The slots
of a source are ranked, and the r-th takes the r-th block of that source's words: its documents in
a seeded random order, laid end to end, repeated up to the cap, and cut into as many equal blocks
as the source has slots.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.llm.common import SPACE, pieces_for, text_of
from curate.session import stored

GOLDEN = (5**0.5 - 1) / 2
CHUNK = 1 << 16


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(f"[^{SPACE}]+")).cast("bigint")


def share_out(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Targets that share the total by weight; none exceeds ``cap`` times its size."""
    targets = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), [i for i, s in enumerate(sizes) if s > 0]
    while open_ and left > 0:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * level >= cap * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = weights[i] * level
            break
        for i in full:
            targets[i] = float(cap * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def points(start: int, n: int) -> np.ndarray:
    """``frac(i * golden ratio)`` of n numbers i; split in two, so that large ones stay exact."""
    i = np.arange(start, start + n, dtype=np.int64)
    high, low = i >> 20, i & ((1 << 20) - 1)
    return (high * ((GOLDEN * (1 << 20)) % 1.0) + low * GOLDEN) % 1.0


def schedule(spark, n_slots: int, shares: Sequence[float]) -> DataFrame:
    """(slot, source_no, rank): the source of every slot, and which of that source's slots it is."""
    ends = np.cumsum(np.asarray(shares, float))
    ends /= ends[-1]
    last = int(np.flatnonzero(np.asarray(shares) > 0)[-1])

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in batch["id"]:
                n = min(CHUNK, n_slots - first * CHUNK)
                found = np.searchsorted(ends, points(first * CHUNK, n), side="right")
                yield pd.DataFrame({"slot": np.arange(first * CHUNK, first * CHUNK + n), "source_no": np.minimum(found, last).astype("int32"), "chunk": first})

    slots = spark.range(ceil(n_slots / CHUNK)).mapInPandas(pick, "slot long, source_no int, chunk long")
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = slots.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    return slots.withColumn("local", local).join(before, ["source_no", "chunk"]).select(
        "slot", "source_no", (F.col("before") + F.col("local")).alias("rank")
    )


def sources_of(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3) -> list[dict]:
    """A dict for each source: name, size and target. The caller's mix names its sources one by one,
    so this list, one row for each, is what the driver holds; it does not grow with the documents."""
    rows = docs.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    shares = [weights[i % len(weights)] for i in range(len(rows))]
    targets = share_out([r["size"] for r in rows], shares, cap)
    return [{"source_no": i, "source": r["source"], "source_size": r["size"], "target": t} for i, (r, t) in enumerate(zip(rows, targets))]


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, block: int = 1024, least_slots: int = 512, seed: int = 7, key: str | None = None
) -> tuple[DataFrame, list[dict]]:
    """Pieces (slot, source_no, doc_id, epoch, start, length) of the mix, and the list of sources.

    ``docs`` has (doc_id, source, size) with the size in words. A piece is a run of words of one
    document in one slot; ``epoch`` counts the rounds through the source, of which there are at most
    ``cap``, so no document is taken more than ``cap`` times. The words taken from a source are its
    target, rounded. Rows without words are never taken; a NULL source is a source of its own,
    the last; rows with equal ids are told apart only by their size, or by ``key``, a BIGINT column of ``docs``
    that no two rows share, which each piece then has too; an empty table gives no piece.
    """
    spark = docs.sparkSession
    names = ["doc_id"] if key is None else ["doc_id", key]
    docs = docs.select(*names, "source", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    sources = sources_of(docs, weights, cap)
    total = sum(s["source_size"] for s in sources)
    out = f"slot long, source_no int, {', '.join(f'{c} long' for c in names)}, epoch int, start long, length long"
    if not total:
        return spark.createDataFrame([], out), sources
    n_slots = max(ceil(total / block), least_slots)
    # Stored, so that the optimizer knows how large the slots are before it joins them.
    slots = stored(schedule(spark, n_slots, [s["target"] for s in sources]), "slots")
    found = {r["source_no"]: r["n"] for r in slots.groupBy("source_no").agg(F.count("*").alias("n")).collect()}
    missed = [s["source_no"] for s in sources if s["target"] > 0 and s["source_no"] not in found]
    if missed:  # a share below one slot: its one slot is put at the end
        extra = spark.createDataFrame([(n_slots + i, s, 0) for i, s in enumerate(missed)], "slot long, source_no int, rank long")
        slots = slots.unionByName(extra)
    plan = []
    for s in sources:
        take, n = min(round(s["target"]), cap * s["source_size"]), found.get(s["source_no"], 1)
        plan.append((s["source_no"], s["source"], s["source_size"], take, take // n, take % n))
    table = F.broadcast(spark.createDataFrame(plan, "source_no int, source string, all long, take long, each long, more long"))

    mixed_id = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = docs.where("size > 0").join(table.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "source")
    rows = rows.withColumn("h", mixed_id).withColumn("piece", F.pmod("h", F.lit(pieces_for(docs))))
    earlier = Window.partitionBy("source_no").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source_no", "piece").agg(F.sum("size").alias("n"))
    before = totals.select("source_no", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_no", "piece").orderBy("h", *names, "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum("size").over(inside)).join(before, ["source_no", "piece"]).withColumn(
        "first", F.col("before") + F.col("end") - F.col("size")
    )
    rounds = placed.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(cap)]))).withColumns(
        {"lo": F.col("first") + F.col("epoch") * F.col("all")}
    ).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("take"))).where("lo < hi")

    def rank(x: str) -> str:
        # The first ``more`` blocks have one word more than ``each``.
        return f"(CASE WHEN {x} < more * (each + 1) THEN {x} div (each + 1) ELSE more + ({x} - more * (each + 1)) div greatest(each, 1) END)"

    split = rounds.withColumn("rank", F.explode(F.expr(f"sequence({rank('lo')}, {rank('(hi - 1)')})")))
    begin = F.expr("rank * each + least(rank, more)")
    end = F.expr("(rank + 1) * each + least(rank + 1, more)")
    cut = split.select(
        "source_no", "rank", *names, "epoch",
        (F.greatest(begin, "lo") - F.col("lo")).alias("start"),
        (F.least(end, "hi") - F.greatest(begin, "lo")).alias("length"),
    )
    # The slots grow with the words: they are merged, whatever their size is estimated at.
    return cut.join(slots.hint("merge"), ["source_no", "rank"]).select("slot", "source_no", *names, "epoch", "start", "length"), sources
