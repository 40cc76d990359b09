"""Awkward inputs: splits that name columns differently, quoted text, labels out of range, missing votes."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from curate.functions.naming import heading
from curate.operators import candidates, clustering, metrics
from curate.operators.vectors import nearest_centroid
from curate.operators.votes import ensemble
from curate.sources.corpus import read_corpus
from curate.sources.predictions import read_predictions, write_predictions

PREDS = "system string, row_id long, text string, true_label int, pred_label int, probs array<double>"
ODD = 'she said ""no"", then "left",\nand, wrote \\" twice'


def test_splits_with_other_column_names(spark, tmp_path):
    spark.createDataFrame([("one", 1)], "tweet string, class int").write.parquet(f"{tmp_path}/s/a")
    spark.createDataFrame([("two", 2), (None, None)], "text string, label int").write.parquet(f"{tmp_path}/s/b")
    got = read_corpus(spark, [f"{tmp_path}/s/a", f"{tmp_path}/s/b"], text_columns=("tweet", "text"), label_columns=("class", "label"))
    assert sorted((r["text"], r["label"]) for r in got.collect()) == [("", 0), ("one", 1), ("two", 2)]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_predictions_keep_quotes_commas_and_line_breaks(spark, tmp_path, kind):
    rows = [("m", i, ODD if i % 2 else "plain", 0, 1, [0.25, 0.5, 0.25]) for i in range(8)]
    write_predictions(spark.createDataFrame(rows, PREDS).repartition(3), str(tmp_path), ["m"], kind)
    got = read_predictions(spark, str(tmp_path))
    assert sorted((r["row_id"], r["text"], r["pred_label"], tuple(r["probs"])) for r in got.collect()) == sorted((r[1], r[2], r[4], tuple(r[5])) for r in rows)


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_rows_of_several_files_are_numbered_in_their_order(spark, tmp_path, kind):
    """Files by name, rows by their place: as many numbers as rows, the same for every system written alike."""
    rows = spark.range(0, 200, 1, 5).selectExpr("int(id % 3) AS true_label", "int(id % 2) AS pred_label", "concat('t', id) AS text")
    for name in "mn":
        rows.write.option("header", True).format(kind).save(f"{tmp_path}/{name}_predictions.{kind}")
    got = read_predictions(spark, str(tmp_path)).collect()
    for name in "mn":
        mine = sorted((r["row_id"], r["text"]) for r in got if r["system"] == name)
        assert mine == [(i, f"t{i}") for i in range(200)]


def test_null_candidates_are_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    assert {r[0] for r in df.select(candidates.reject_reason(F.col("t"))).collect()} == {"empty"}


@pytest.mark.parametrize(("truth", "label"), [(0, 3), (1, -1), (None, 0)])
def test_labels_outside_the_classes_fail(spark, truth, label):
    df = spark.createDataFrame([("m", 0, "t", truth, label, [1.0])], PREDS)
    with pytest.raises(PySparkException):
        metrics.confusion(df).collect()


def test_headings_capitalise_after_anything_but_letters(spark):
    names = ["bert-base_v2", "a_b", "ÉTÉ x1y", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(heading(F.col("n"))).collect()
    assert [r[0] for r in got] == [n.replace("_", " ").title() for n in names]


def test_every_system_votes_once_on_every_row(spark):
    vote = lambda s, i: (s, i, "t", 0, 0, [1.0, 0.0, 0.0])
    full = [vote(s, 1) for s in "abc"]
    assert ensemble(spark.createDataFrame(full, PREDS), n_systems=3).count() == 2
    for rows in (full[:2], [*full, vote("a", 1)]):
        with pytest.raises(PySparkException):
            ensemble(spark.createDataFrame(rows, PREDS), n_systems=3).collect()
    with pytest.raises(PySparkException):
        ensemble(spark.createDataFrame([vote("a", 1), vote("a", 1)], PREDS)).collect()


def test_a_missing_vote_fails_unless_votes_may_be_partial(spark):
    vote = lambda s, i: (s, i, "t", 0, 0, [0.5, 0.25, 0.25])
    some = spark.createDataFrame([vote("a", 1), vote("b", 1), vote("c", 1), vote("a", 2), vote("b", 2)], PREDS)
    with pytest.raises(PySparkException):
        ensemble(some).collect()
    partial = ensemble(some, strict=False)
    assert partial.count() == 4 and {tuple(r["probs"]) for r in partial.where("system = 'soft_voting'").collect()} == {(0.5, 0.25, 0.25)}
    with pytest.raises(PySparkException):
        ensemble(some.where("system <> 'c'"), n_systems=3).collect()
    with pytest.raises(PySparkException):
        ensemble(some.where("system = 'a'")).collect()
    with pytest.raises(PySparkException):
        ensemble(some.unionByName(spark.createDataFrame([(None, 1, "t", 0, 0, [1.0, 0.0, 0.0])], PREDS))).collect()
    assert ensemble(some.where("false")).count() == 0


def test_equal_similarities_take_the_later_category(spark):
    centers = spark.createDataFrame([("x", 0, [1.0, 0.0])], "class string, cluster int, centroid array<double>")
    anchors = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [2.0, 0.0])], "category string, embedding array<double>")
    assert clustering.name_clusters(centers, anchors).first()["cluster_name"] == "q"


def test_nearest_centroid_of_unit_vectors(spark):
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], "cluster int, centroid array<double>")
    rows = spark.createDataFrame([(1, [0.1, 0.12])], "vec_id long, embedding array<double>")
    assert nearest_centroid(rows, centers, normalise=True).first()["cluster"] == 1


def test_soft_vote_keeps_small_scores(spark):
    rows = [("m", 1, 1, 1, [2e-13, 1 - 2e-13, 0.0]), ("n", 1, 1, 1, [4e-13, 1 - 4e-13, 0.0])]
    preds = spark.createDataFrame(rows, "system string, row_id long, true_label int, pred_label int, probs array<double>")
    soft = ensemble(preds).where("system = 'soft_voting'").first()
    assert soft["probs"][0] == pytest.approx(3e-13, rel=1e-9) and soft["pred_label"] == 1
