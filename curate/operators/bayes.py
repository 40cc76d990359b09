"""Weighted multinomial naive Bayes in closed form, over an exact vocabulary.

Every word of the training texts has a number of its own, by falling count and then by the word, from global
ranks; nothing is hashed into buckets, so no two words share one. The model is a table: for each word and class the
log-probability log((weight of the word in the class + smoothing) / (weight of all words in it + smoothing × words)).
It is fitted by one aggregation and scores by a join, and neither holds a vocabulary on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.functions.prob import arg_max, softmax
from curate.functions.text import words
from curate.operators.order_index import LEAF_ROWS, rank_by_order
from curate.session import stored

SMOOTHING = 1.0
FREQUENT = 4096
"""The most frequent words, so many rows of the model, go to every executor: theirs are the hot keys."""


def counted_words(rows: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``(keys…, word, n)``: how often each row holds each word, in lower case.

    The words of a row are counted before they are shuffled, so a word in every row is a row each and no more.
    """
    return rows.select(*keys, F.explode(words(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("word")).groupBy(*keys, "word").agg(
        F.count("*").alias("n")
    )


def vocabulary(words_: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(word, count, number)`` of ``(word, n)`` rows: numbers from 0, the most frequent word first, equal ones by word."""
    totals = words_.groupBy("word").agg(F.sum("n").alias("count"))
    ranked = rank_by_order(totals.withColumn("__less", -F.col("count")), [], ["__less", "word"], "number", leaf_rows)
    return ranked.select("word", "count", (F.col("number") - 1).alias("number"))


@dataclass(frozen=True)
class NaiveBayes:
    """``table`` is (word, count, number, log_probs), stored; ``priors`` are the log-probabilities of the classes."""

    table: DataFrame
    priors: tuple[float, ...]

    def log_scores(self, rows: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
        """``(keys…, scores)`` of the rows that hold a known word: the sum of its words' log-probabilities, without priors."""
        found = counted_words(rows, keys, text)
        model = self.table.select("word", "number", "log_probs")
        common = F.broadcast(model.where(F.col("number") < FREQUENT))
        rest = model.where(F.col("number") >= FREQUENT)
        # Frequent words meet the broadcast rows where they are; only the others are shuffled by word.
        tried = found.join(common.withColumnRenamed("number", "__number"), "word", "left")
        near = tried.where("__number IS NOT NULL").drop("__number")
        far = tried.where("__number IS NULL").drop("__number", "log_probs").join(rest.drop("number"), "word")
        sums = [F.sum(F.col("n") * F.col("log_probs")[c]).alias(f"s{c}") for c in range(len(self.priors))]
        both = near.unionByName(far).groupBy(*keys).agg(*sums)
        return both.select(*keys, F.array(*[F.col(f"s{c}") for c in range(len(self.priors))]).alias("scores"))


def fit(
    train: DataFrame, n_classes: int = 3, smoothing: float = SMOOTHING, row_id: str = "row_id", label: str = "label", weight: str = "weight"
) -> NaiveBayes:
    """The model of rows ``(row_id, text, label, weight)``; ``row_id`` tells rows apart.

    A row counts its words ``weight`` times. A class without weight has the log-probability of no evidence, the
    logarithm of the smallest positive double, as its prior. Without any word the model has priors alone.
    """
    rows = train.select(F.col(row_id).alias("__row"), F.col(label).alias("label"), F.col(weight).cast("double").alias("weight"), "text")
    found = stored(counted_words(rows, ["__row", "label", "weight"]), "words")

    def by_class(value: Column) -> list[Column]:
        return [F.sum(F.when(F.col("label") == c, value).otherwise(0.0)).alias(f"w{c}") for c in range(n_classes)]

    weighted = found.groupBy("word").agg(*by_class(F.col("weight") * F.col("n")))
    numbered = vocabulary(found)
    # One row: the weight of each class's words, the number of words.
    whole = found.agg(*by_class(F.col("weight") * F.col("n")), F.count_distinct("word").alias("size")).first()
    logs = [
        F.log((F.col(f"w{c}") + smoothing) / F.lit((whole[f"w{c}"] or 0.0) + smoothing * max(whole["size"], 1))) for c in range(n_classes)
    ]
    table = stored(numbered.join(weighted, "word").select("word", "count", "number", F.array(*logs).alias("log_probs")), "bayes")
    mass = rows.agg(*by_class(F.col("weight"))).first()
    return NaiveBayes(table, log_priors([mass[f"w{c}"] or 0.0 for c in range(n_classes)]))


def log_priors(mass: Sequence[float]) -> tuple[float, ...]:
    import math

    total = sum(mass)
    if total <= 0:
        return tuple(-math.log(len(mass)) for _ in mass)
    return tuple(math.log(max(m / total, 2.2250738585072014e-308)) for m in mass)


def score(model: NaiveBayes, rows: DataFrame, system: str = "bayes", keep: Sequence[str] = (), row_id: str = "row_id", label: str = "label") -> DataFrame:
    """``(system, row_id, true_label, keep…, pred_label, probs)`` of every row; one without a known word gets the priors."""
    sums = model.log_scores(rows.select(row_id, "text"), [row_id])
    slim = rows.select(row_id, F.col(label).cast("int").alias("true_label"), *keep)
    priors = F.array(*[F.lit(p) for p in model.priors])
    logits = F.when(F.col("scores").isNull(), priors).otherwise(F.zip_with("scores", priors, lambda s, p: s + p))
    met = slim.join(sums, row_id, "left").withColumn("probs", softmax(logits, len(model.priors)))
    return met.select(F.lit(system).alias("system"), F.col(row_id).alias("row_id"), "true_label", *keep, arg_max(F.col("probs")).alias("pred_label"), "probs")
