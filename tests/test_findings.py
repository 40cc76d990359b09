"""Faults that only large tables show, told by plans and small tables of the tests' own."""

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from curate.functions.prob import by_class
from curate.functions.text import strip, words
from curate.llm import chat
from curate.llm.queries import QUERIES as OPERATORS
from curate.operators import models
from curate.workload.catalog import QUERIES


@pytest.mark.parametrize("name", ["one_hot_label", "softmax_probabilities", "prior_correction", "prior_correction_uniform"])
def test_draws_are_not_copied_into_a_filter(spark, tmp_path, name):
    spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (7, None)], "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and plan.count("md5") <= 5
    assert out.count() == 4 * 3 * 3


def test_classes_of_an_array_are_rows(spark):
    rows = spark.createDataFrame([(1, [0.5, None, 0.25]), (1, [0.0, 1.0, 2.0])], "id long, probs array<double>")
    got = rows.select("id", by_class(F.col("probs"), 3))
    want = rows.select("id", F.posexplode("probs").alias("cls", "prob"))
    assert got.dtypes == want.dtypes and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_fitting_tasks_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "FIT_ROWS", 10)
    monkeypatch.setattr(models, "FEW_ROWS", 20)
    shares = []

    class Judge(NaiveBayes):
        def _fit(self, rows):
            shares.append([r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()])
            return super()._fit(rows)

    for n in (20, 400):
        train = spark.range(0, n, 1, 1).select((F.col("id") % 3).cast("int").alias("label"), F.concat(F.lit("w"), F.col("id") % 7).alias("text"))
        models.train_classifiers(train, {"bayes": Judge(**models.COMMON)}, n_features=16)
    assert shares[0] == [20] and sum(shares[1]) == 400 and max(shares[1]) <= 12


def test_chat_query_trains_on_written_examples(spark, monkeypatch, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "ab"), (1, 2, "user", "r"), (1, 3, "assistant", "<|c\\"), (2, 0, "user", "only"), (None, 1, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    whole = chat.examples
    masked = lambda f: whole(f).withColumn("text", F.concat(F.left("text", F.col("loss_start")), F.lit("Z"), F.substr("text", F.col("loss_start") + 2)))
    lengths = lambda: {r["conv_id"]: r["loss_sha256"] for r in OPERATORS["op4_chat_formatting"](spark, str(tmp_path)).collect()}
    before = lengths()
    monkeypatch.setattr(chat, "examples", masked)
    after = lengths()
    assert {c for c in before if before[c] != after[c]} == {1, None, -1}


def test_words_are_those_of_the_stripped_text(spark):
    texts = ["", " ", "\n", None, "a", " a  b\n", "\u2028a\x85b\u00a0", "a\r\n\r\n", "\u3000 x y\t", "é\u2029\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    bare = strip(F.col("text"))
    split = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"))
    assert rows.where(~words(F.col("text")).eqNullSafe(split)).count() == 0


def test_texts_are_tokenised_once_in_a_fit(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def marked(text):
        def count(t):
            seen.add(1)
            return t.split()

        return F.udf(count, "array<string>")(text)

    monkeypatch.setattr(models, "words", marked)
    train = spark.range(30).select((F.col("id") % 3).cast("int").alias("label"), F.concat(F.lit("w"), F.col("id") % 7).alias("text"))
    models.train_classifiers(train, {"bayes": NaiveBayes(**models.COMMON)}, n_features=16)
    assert seen.value == 30
