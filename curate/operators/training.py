"""Early-stopping replay and best epoch over training histories ``(run, epoch, score)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.constants import MIN_DELTA, PATIENCE
from curate.functions.once import with_once
from curate.operators.running import running_max_before

SEGMENT_EPOCHS = 100_000


def best_epoch(history: DataFrame) -> DataFrame:
    """The first epoch with the highest score, whatever the minimum gain."""
    best = F.max(F.struct(F.col("score"), (-F.col("epoch")).alias("negative")))
    top = history.groupBy("run").agg(best.alias("best"))
    return top.select("run", (-F.col("best.negative")).alias("best_epoch"), F.col("best.score").alias("best_score"))


def early_stop(
    history: DataFrame, patience: int = PATIENCE, min_delta: float = MIN_DELTA, segment_epochs: int = SEGMENT_EPOCHS
) -> DataFrame:
    """``(run, epochs, stop_epoch, last_best_epoch, last_best_score)``.

    Epochs of a run are numbered from 1 without gaps, and ``min_delta`` is not negative. ``stop_epoch`` is NULL
    if the run ends before ``patience`` epochs pass without a gain of more than ``min_delta``.

    Only an epoch that beats all before it can count as a gain, so the replay is a fold over these
    records. A run is cut into segments of ``segment_epochs``. A run that has not stopped before a segment had its
    last gain within ``patience`` epochs of it, or none yet, so a segment is folded from each of these few
    states, and then the segments of a run are joined by looking up the state in which one ends. A run of
    any length is many tasks, and what comes together for a run is ``patience`` + 1 states a segment.
    """
    if min_delta < 0:
        raise ValueError("min_delta must not be negative")
    length = max(segment_epochs, patience)
    spread = 1.0 - 1.0 / (F.col("epoch").cast("double") + 1.0)
    marked = running_max_before(history, ["run"], spread, [F.asc("epoch")], F.col("score"), "before", few_groups=False)
    ahead = F.col("score").isNotNull() & (F.col("before").isNull() | (F.col("score") > F.col("before")))
    records = marked.where(ahead).select("run", F.col("epoch").cast("bigint").alias("epoch"), F.col("score").cast("double").alias("score"))

    segment = F.expr(f"(epoch - 1) div {length}")
    near_end = F.col("epoch") > (segment + 1) * length - patience
    places = F.when(near_end, F.array(segment, segment + 1)).otherwise(F.array(segment))
    placed = records.withColumn("segment", F.explode(places))
    record, own = F.struct("epoch", "score"), F.col("segment") == segment
    segments = placed.groupBy("run", "segment").agg(
        F.array_sort(F.collect_list(F.when(own, record))).alias("records"),
        F.collect_list(F.when(~own, record)).alias("before"),
    )

    def state(last: Column, best: Column, stop: Column) -> Column:
        return F.struct(last.cast("bigint").alias("last"), best.cast("double").alias("best"), stop.cast("bigint").alias("stop"))

    def step(now: Column, r: Column) -> Column:
        late = now["best"].isNotNull() & (r["epoch"] - now["last"] > patience)
        stop = F.coalesce(now["stop"], F.when(late, now["last"] + patience))
        gain = stop.isNull() & (now["best"].isNull() | (r["score"] > now["best"] + min_delta))
        return state(F.when(gain, r["epoch"]).otherwise(now["last"]), F.when(gain, r["score"]).otherwise(now["best"]), stop)

    def replayed(first: Column) -> Column:
        end = F.aggregate("records", state(first["epoch"], first["score"], F.lit(None)), step)
        return F.struct(first["epoch"].alias("start"), end.alias("end"))

    nothing = F.struct(F.lit(0).cast("bigint").alias("epoch"), F.lit(None).cast("double").alias("score"))
    ends = segments.select("run", "segment", F.transform(F.array_append("before", nothing), replayed).alias("ends"))
    lists = ends.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("segment", "ends"))).alias("segments"))
    runs = history.groupBy("run").agg(F.max("epoch").cast("bigint").alias("epochs")).join(lists, "run", "left")

    def passed(now: Column, s: Column) -> Column:
        end = F.get(F.filter(s["ends"], lambda e: e["start"] == now["last"]), F.lit(0))["end"]
        over = F.least((s["segment"] + 1) * length, F.col("epochs")) - end["last"] >= patience
        stop = F.coalesce(end["stop"], F.when(end["best"].isNotNull() & over, end["last"] + patience))
        return F.when(now["stop"].isNotNull() | end.isNull(), now).otherwise(state(end["last"], end["best"], stop))

    begin = state(F.lit(0), F.lit(None), F.lit(None))
    joined = with_once(runs, "end", F.coalesce(F.aggregate("segments", begin, passed), begin))
    return joined.select(
        "run",
        "epochs",
        F.col("end.stop").alias("stop_epoch"),
        F.col("end.last").alias("last_best_epoch"),
        F.col("end.best").alias("last_best_score"),
    )
