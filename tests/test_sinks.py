"""Sinks that write many sets: one job, names kept, old sets replaced, order of rows kept."""

import pytest
from pyspark.errors import PySparkException

from curate.sources import metric_files
from curate.sources.predictions import read_predictions, write_predictions

PREDS = "system string, text string, true_label int, pred_label int, probs array<double>"


def _jobs(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def _preds(spark, systems, n, first=0):
    rows = [(s, f"{s} {i}", i % 3, (i + first) % 3, [0.2, 0.3, 0.5]) for i in range(n) for s in systems]
    return spark.createDataFrame(rows, PREDS)


def _back(spark, root):
    return sorted((r["system"], r["row_id"], r["text"], r["pred_label"]) for r in read_predictions(spark, root).collect())


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_one_job_for_any_number_of_systems(spark, tmp_path, kind):
    systems = ["plain", "folder/in it", "a=b, 50 %", "dots.and-dash", *[f"run/s{i}" for i in range(12)]]
    preds = _preds(spark, systems, 20)
    count = _jobs(spark, f"sink {kind}", lambda: write_predictions(preds, str(tmp_path), systems, kind))
    assert count == 1
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_")]
    names = {f"{s}_predictions.{kind}" for s in systems}
    assert all((tmp_path / n).exists() for n in names)
    back = _back(spark, str(tmp_path))
    assert {s for s, *_ in back} == set(systems) and len(back) == 20 * len(systems)


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_round_trip_keeps_order_and_replaces_old_sets(spark, tmp_path, kind):
    systems = ["one", "run/two"]
    write_predictions(_preds(spark, systems, 50), str(tmp_path), systems, kind)
    second = _preds(spark, [*systems, "unlisted"], 31, 1).repartition(1)
    write_predictions(second.coalesce(1), str(tmp_path), ["one"], kind)
    got = _back(spark, str(tmp_path))
    assert {s for s, *_ in got} == {"one", "run/two"}
    assert len([g for g in got if g[0] == "one"]) == 31 and len([g for g in got if g[0] == "run/two"]) == 50
    assert [(i, t) for s, i, t, _ in got if s == "run/two"] == [(i, f"run/two {i}") for i in range(50)]


def test_listed_system_without_rows_is_an_empty_set(spark, tmp_path):
    write_predictions(_preds(spark, ["one"], 3), str(tmp_path), ["one", "none"])
    assert spark.read.parquet(f"{tmp_path}/none_predictions.parquet").count() == 0
    assert len(_back(spark, str(tmp_path))) == 3


def test_a_failing_write_leaves_the_old_sets(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 0.5), ("a", "y", None)], "folder string, stem string, accuracy double")
    metric_files.write_metrics(rows, str(tmp_path))
    broken = spark.createDataFrame([("a", "x", 0.1), ("a", None, 0.2)], "folder string, stem string, accuracy double")
    with pytest.raises(PySparkException):
        metric_files.write_metrics(broken, str(tmp_path))
    assert [r["accuracy"] for r in metric_files.read_metrics(spark, str(tmp_path), ["accuracy"]).collect()] == [0.5]
    assert [p.name for p in tmp_path.iterdir()] == ["a"]


def test_metric_records_are_one_job(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i % 3}", f"m {i}+%", float(i)) for i in range(20)], "folder string, stem string, accuracy double")
    assert _jobs(spark, "records", lambda: metric_files.write_metrics(rows, str(tmp_path))) == 1
    back = metric_files.read_metrics(spark, str(tmp_path), ["accuracy"]).collect()
    assert sorted((r["folder"], r["stem"], r["accuracy"]) for r in back) == sorted((f"f{i % 3}", f"m {i}+%_metrics", float(i)) for i in range(20))
