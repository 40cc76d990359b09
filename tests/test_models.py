"""Naive Bayes, k-means for all numbers of clusters, and tail probabilities against plain Python."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from curate.functions.tails import binomial_two_sided, erfc, log_factorial
from curate.operators import bayes, clustering, lloyd


# -------------------------------------------------------------------------------------- tails
def test_erfc_over_its_range(spark):
    points = [0.0, 1e-300, 1e-9, 0.3, 1.0, 1.9999999, 2.0, 2.0000001, 3.5, 6.0, 12.0, 26.0, 40.0, -0.7, -3.0]
    df = spark.createDataFrame([(x,) for x in points], "x double").select("x", erfc(F.col("x")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(math.erfc(r["x"]), rel=1e-12, abs=1e-300)
    assert spark.range(1).select(erfc(F.lit(None).cast("double"))).first()[0] is None


def test_exact_tails(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (3, 3), (2, 9), (40, 61), (500, 430), (3000, 2800), (10, 100_000), (50_200, 49_800)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", binomial_two_sided(F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        n, k = r["a"] + r["b"], min(r["a"], r["b"])
        if n <= 10_000:
            tail = float(Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n))
        else:
            tail = 2 * math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
        assert r["p"] == pytest.approx(min(1.0, tail), rel=1e-8, abs=1e-300)
    for r in spark.range(0, 60).select("id", log_factorial(F.col("id")).alias("f")).collect():
        assert r["f"] == pytest.approx(math.lgamma(r["id"] + 1), rel=1e-9, abs=1e-12)


# ---------------------------------------------------------------------------------------- Bayes
TRAIN = [
    (1, "Good good day", 0, 2.0), (2, "bad bad bad night", 1, 0.5), (3, "good night", 0, 1.0), (4, None, 1, 1.0), (5, "", 2, 3.0),
    (6, "rare words here rare", 1, 1.0), (6, "good day again", 0, 1.0),
]


def brute_bayes(rows, text):
    counts, mass, vocabulary = [Counter() for _ in range(3)], [0.0] * 3, set()
    for _, t, label, w in rows:
        mass[label] += w
        for word in (t or "").lower().split():
            counts[label][word] += w
            vocabulary.add(word)
    logs = [math.log(m / sum(mass)) for m in mass]
    for c in range(3):
        for word in (text or "").lower().split():
            if word in vocabulary:
                logs[c] += math.log((counts[c][word] + 1) / (sum(counts[c].values()) + len(vocabulary)))
    top = max(logs)
    total = sum(math.exp(x - top) for x in logs)
    return [math.exp(x - top) / total for x in logs]


@pytest.mark.parametrize("frequent", [4096, 0, 2])
def test_bayes_against_plain_counts(spark, monkeypatch, frequent):
    monkeypatch.setattr(bayes, "FREQUENT", frequent)
    train = spark.createDataFrame(TRAIN, "row_id long, text string, label int, weight double").selectExpr("*", "1 AS n", "2 AS word")
    model = bayes.fit(train)
    tests = [(10, "good DAY good", 0), (11, "bad unknown night", 1), (12, None, 2), (13, "nothing known", 2), (14, "rare rare rare " * 400, 1)]
    got = bayes.score(model, spark.createDataFrame(tests, "row_id long, text string, label int"), keep=["text"]).collect()
    assert len(got) == len(tests)
    for r in got:
        want = brute_bayes(TRAIN, r["text"])
        assert r["probs"] == pytest.approx(want, rel=1e-9, abs=1e-12) and r["pred_label"] == int(np.argmax(want))


def test_vocabulary_numbers_every_word(spark):
    words = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9), ("d", 1), ("b", 1)], "word string, n long")
    got = {r["word"]: (r["count"], r["number"]) for r in bayes.vocabulary(words, leaf_rows=1).collect()}
    assert got == {"c": (9, 0), "b": (4, 1), "a": (3, 2), "d": (1, 3)}


def test_bayes_without_words_or_rows(spark):
    schema = "row_id long, text string, label int, weight double"
    tests = spark.createDataFrame([(1, "x", 0)], "row_id long, text string, label int")
    blank = bayes.score(bayes.fit(spark.createDataFrame([(1, " ", 0, 3.0), (2, None, 1, 1.0)], schema)), tests).first()
    assert blank["probs"][:2] == pytest.approx([0.75, 0.25]) and blank["pred_label"] == 0
    none = bayes.score(bayes.fit(spark.createDataFrame([], schema)), tests).first()
    assert none["probs"] == pytest.approx([1 / 3] * 3)


# -------------------------------------------------------------------------------------- k-means
def blobs(n=240, groups=4, seed=3):
    rng = np.random.default_rng(seed)
    centres = np.eye(6)[:groups] * 5
    return [(i, (centres[i % groups] + 0.2 * rng.normal(size=6)).tolist()) for i in range(n)]


def test_all_numbers_of_clusters_at_once(spark):
    rows = blobs()
    df = spark.createDataFrame([*rows, (999, None)], "row_id long, embedding array<double>")
    units, fitted = lloyd.fit_all(df, range(2, 7))
    v = np.asarray([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    scores = lloyd.silhouettes(units, fitted)
    for k, centres in fitted.items():
        own, _ = lloyd.nearest(v, centres)
        for c in np.unique(own):  # a fixed point of the step
            assert np.allclose(v[own == c].mean(axis=0), centres[c], atol=1e-6)
        far = 1 - v @ v.T
        want = []
        for i in range(len(v)):
            mine = (own == own[i]) & (np.arange(len(v)) != i)
            if not mine.any():
                want.append(0.0)
                continue
            a, b = far[i][mine].mean(), min(far[i][own == c].mean() for c in np.unique(own) if c != own[i])
            want.append((b - a) / max(a, b))
        assert scores[k] == pytest.approx(np.mean(want), abs=1e-9)
    k, _, centres = clustering.choose_k(df, k_range=(2, 6))
    assert k == 4 and {tuple(np.bincount(lloyd.nearest(v, centres)[0]))} == {(60, 60, 60, 60)}


def test_one_run_does_not_depend_on_the_others(spark):
    df = spark.createDataFrame(blobs(60, 3), "row_id long, embedding array<double>")
    alone, together = lloyd.fit_all(df, [3], starts=1)[1][3], lloyd.fit_all(df.repartition(5), [2, 3], starts=1)[1][3]
    assert np.allclose(alone, together, atol=1e-9)


def test_clusters_of_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "row_id long, embedding array<double>")
    units, fitted = lloyd.fit_all(df, [2, 5])
    assert {k: len(c) for k, c in fitted.items()} == {2: 2, 5: 5}
    got = {r["id"]: r["cluster"] for r in lloyd.assigned(units, fitted[2]).collect()}
    assert got[1] == got[2] != got[3]
    with pytest.raises(ValueError):
        lloyd.fit_all(df.where("row_id > 5"), [2])


def test_rows_without_vectors_have_no_cluster(spark):
    df = spark.createDataFrame([*blobs(40, 2), (999, None)], "row_id long, embedding array<double>")
    anchors = spark.createDataFrame([("p", [1.0] + [0.0] * 5), ("q", [0.0, 1.0] + [0.0] * 4)], "category string, embedding array<double>")
    got = clustering.cluster_texts(df, anchors).collect()
    assert Counter(r["cluster_name"] for r in got) == {"p": 20, "q": 20, None: 1}
