"""Early stopping over segments of a run against an epoch by epoch loop."""

import random

import pytest
from pyspark.sql import functions as F

from curate.operators.training import early_stop


def _loop(scores, patience, delta):
    best, last, counter = None, 0, 0
    for i, s in enumerate(scores, 1):
        if s is not None and (best is None or s > best + delta):
            best, last, counter = s, i, 0
        elif best is not None:
            counter += 1
            if counter >= patience:
                return len(scores), i, last, best
    return len(scores), None, last, best


def _runs():
    rng = random.Random(11)
    runs = {}
    for i in range(60):
        drift = rng.choice([0.0, 0.01, 0.05])
        runs[f"r{i}"] = [
            None if rng.random() < 0.1 else round(rng.random() * 0.3 + j * drift, 3) for j in range(rng.randint(1, 60))
        ]
    runs["no scores"] = [None] * 30
    runs["late start"] = [None] * 25 + [0.5, 0.6]
    runs["rising"] = [j * 0.04 for j in range(50)]
    runs["flat"] = [0.5] * 40
    runs["one"] = [0.1]
    runs["ends at a border"] = [0.1, 0.2, 0.3, 0.4, 0.5, 0.1, 0.1]
    return runs


@pytest.mark.parametrize("patience, delta", [(1, 0.0), (3, 0.05), (5, 0.0), (9, 0.1)])
def test_segments_give_what_a_loop_gives(spark, patience, delta):
    runs = _runs()
    rows = [(r, j + 1, s) for r, scores in runs.items() for j, s in enumerate(scores)]
    history = spark.createDataFrame(rows, "run string, epoch int, score double").repartition(3)
    want = {r: _loop(scores, patience, delta) for r, scores in runs.items()}
    for length in (1, 7, 1000):
        found = early_stop(history, patience, delta, segment_epochs=length).collect()
        got = {r["run"]: (r["epochs"], r["stop_epoch"], r["last_best_epoch"], r["last_best_score"]) for r in found}
        assert got == want, length


def test_a_long_rising_run_is_many_segments(spark):
    n = 200_000
    long = spark.range(1, n + 1).select(F.lit("long").alias("run"), F.col("id").alias("epoch"), (F.least("id", F.lit(n - 50)) / 1000.0).alias("score"))
    row = early_stop(long, 20, 0.0, segment_epochs=5_000).first()
    assert (row["epochs"], row["stop_epoch"], row["last_best_epoch"]) == (n, n - 30, n - 50)
    assert early_stop(long, 20, 0.0025, segment_epochs=5_000).first()["stop_epoch"] == _loop([min(i, n - 50) / 1000 for i in range(1, n + 1)], 20, 0.0025)[1]


def test_empty_history_and_negative_gain(spark):
    empty = spark.createDataFrame([], "run string, epoch int, score double")
    assert early_stop(empty).count() == 0
    with pytest.raises(ValueError):
        early_stop(empty, min_delta=-0.1)
