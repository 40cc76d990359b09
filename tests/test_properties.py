"""Edge cases, skew and brute-force checks on small fixtures."""

import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from curate.functions.text import clean_line, normalise
from curate.operators import candidates as cand
from curate.operators import balance, clustering, curves, gate, metrics, sampling, training
from curate.operators import vectors as vec
from curate.operators.curves import class_areas, interpolated_precision
from curate.operators.running import rank_by_number, running
from curate.operators.split import stratified_split
from curate.operators.votes import ensemble
from curate.plans.rebalance import augment
from curate.sources.predictions import read_predictions, registered


def test_running_totals_with_a_hot_bucket(spark):
    """A third of the rows share one bucket; crowded buckets are cut again and stay exact."""
    rng = random.Random(1)
    rows = [("g", rng.random()) for _ in range(400)] + [("g", 0.3 + rng.random() * 1e-5) for _ in range(200)]
    rows += [("h", rng.random()) for _ in range(50)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    for limit in (10_000_000, 7):
        got = running(df, ["k"], F.col("x"), [F.asc("x")], {"n": F.lit(1), "s": F.col("x")}, leaf_rows=limit).collect()
        assert len(got) == len(rows)
        for k in "gh":
            mine = sorted((r for r in got if r["k"] == k), key=lambda r: r["x"])
            assert [r["n_upto"] for r in mine] == list(range(1, len(mine) + 1))
            assert mine[-1]["s_upto"] == pytest.approx(sum(r["x"] for r in mine))
            assert {r["n_total"] for r in mine} == {len(mine)}


def test_null_groups_and_labels_fail_instead_of_vanishing(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 1)], "row_id long, label int")
    with pytest.raises(PySparkException):
        rank_by_number(df, ["label"], "row_id").collect()
    with pytest.raises(PySparkException):
        stratified_split(df).collect()


def test_rank_by_number_is_order_insensitive(spark):
    df = spark.range(0, 3000).select(F.lit("a").alias("k"), (F.col("id") * 7919 % 3001).alias("v"), (F.col("id") % 3).alias("t"))
    one = {(r["v"], r["t"]): r["rank"] for r in rank_by_number(df, ["k"], "v", ["t"], leaf_rows=50).collect()}
    two = {(r["v"], r["t"]): r["rank"] for r in rank_by_number(df.repartition(7), ["k"], "v", ["t"]).collect()}
    assert one == two
    assert [one[k] for k in sorted(one)] == list(range(1, 3001))


def test_split_shares_within_one_row(spark):
    df = spark.range(0, 5003).select(F.col("id").alias("row_id"), F.when(F.col("id") % 50 == 0, 0).otherwise(1).alias("label"))
    got = stratified_split(df, leaf_rows=100).groupBy("label", "split").count().collect()
    sizes = Counter()
    for r in got:
        sizes[r["label"]] += r["count"]
    for r in got:
        share = {"train": 0.70, "val": 0.15, "test": 0.15}[r["split"]]
        assert abs(r["count"] - share * sizes[r["label"]]) <= 1
    assert sum(sizes.values()) == 5003


def _scores(rows):
    """Brute-force areas of ``(score, positive)`` pairs."""
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    ap, seen = 0.0, 0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(s >= t for s in pos)
        ap += (tp - seen) / len(pos) * tp / sum(s >= t for s, _ in rows)
        seen = tp
    return wins / (len(pos) * len(neg)), ap


def test_areas_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        a, b, c = (rng.choice([1, 2, 3, 5, 8, 1e-6]) for _ in range(3))
        y = rng.choices([0, 1, 2], [0.1, 0.6, 0.3])[0]
        rows.append(("s", i, y, [a / (a + b + c), b / (a + b + c), c / (a + b + c)]))
    preds = spark.createDataFrame(rows, "system string, row_id long, true_label int, probs array<double>")
    for r in class_areas(preds).collect():
        auc, ap = _scores([(p[r["cls"]], y == r["cls"]) for _, _, y, p in rows])
        assert r["roc_auc"] == pytest.approx(auc)
        assert r["average_precision"] == pytest.approx(ap)
    steps = interpolated_precision(preds).groupBy("cls").count().collect()
    assert [s["count"] for s in steps] == [200, 200, 200]


def test_all_scores_tied_and_missing_class(spark):
    preds = spark.createDataFrame(
        [("s", i, i % 2, 0, [0.5, 0.5, 0.0]) for i in range(10)],
        "system string, row_id long, true_label int, pred_label int, probs array<double>",
    )
    areas = {r["cls"]: r for r in class_areas(preds).collect()}
    assert areas[0]["roc_auc"] == 0.5
    assert areas[2]["roc_auc"] is None and areas[2]["average_precision"] == 0.0
    row = metrics.all_metrics(preds).first()
    assert row["roc_auc_macro"] is None
    assert row["f1_neither"] == 0.0
    assert row["f1_macro"] == pytest.approx((2 / 3) / 2)
    every = metrics.core_metrics(preds, labels="all").first()
    assert every["f1_macro"] == pytest.approx((2 / 3) / 3)


def test_ensemble_refuses_misaligned_rows(spark):
    rows = [("a", 1, 0, 0, [1.0, 0.0, 0.0]), ("b", 1, 1, 0, [1.0, 0.0, 0.0])]
    schema = "system string, row_id long, true_label int, pred_label int, probs array<double>"
    with pytest.raises(PySparkException):
        ensemble(spark.createDataFrame(rows, schema)).collect()
    with pytest.raises(PySparkException):
        ensemble(spark.createDataFrame(rows[:1], schema)).collect()


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("1) - x", "x"),
        ('"a', '"a'),
        ("'a\"", "a"),
        ('""', '""'),
        ("  12.  hello there ", "hello there"),
        ("* 'quoted text' ", "quoted text"),
        ("3.5 is a number", "5 is a number"),
        ("", ""),
    ],
)
def test_clean_line(spark, raw, clean):
    assert spark.range(1).select(clean_line(F.lit(raw))).first()[0] == clean


def test_normalise(spark):
    text = "RT @Größe: see http://a.b/c?d  www.x.org #Überall &#39; #"
    wanted = "RT [USER]: see [URL] [URL] Überall &39; #"
    assert spark.range(1).select(normalise(F.lit(text))).first()[0] == wanted


def test_length_bounds(spark):
    lengths = [0, 4, 5, 280, 281]
    df = spark.createDataFrame([(n, "x" * n) for n in lengths], "n int, text string")
    got = {r["n"]: r["reason"] for r in df.select("n", cand.reject_reason(F.col("text")).alias("reason")).collect()}
    assert got == {0: "empty", 4: "length", 5: None, 280: None, 281: "length"}


def test_hot_key_first_wins(spark):
    """One line makes up most of the table."""
    rows = [(i, "The same LINE" if i % 3 else f"line number {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "seq int, raw string").repartition(6)
    got = cand.filter_candidates(df, ["seq"], seen=spark.createDataFrame([("LINE NUMBER 3",)], "text string")).collect()
    assert len(got) == 200
    assert min(r["seq"] for r in got if r["text"].lower() == "the same line") == 1
    assert "line number 3" not in {r["text"] for r in got}


def test_similarity_block_join_equals_broadcast(spark):
    rng = random.Random(5)
    rows = [(i, "c" if i % 3 else "d", [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, embedding array<double>")
    refs = df.where("id < 90")
    one = {r["id"]: r["similarity"] for r in gate.best_similarity(df, refs, ["k"]).collect()}
    two = {r["id"]: r["similarity"] for r in gate.best_similarity_in_blocks(df, refs, ["k"], "id", "id", 5).collect()}
    three = {r["id"]: r["similarity"] for r in gate.best_similarity_in_blocks(df, refs, ["k"], "id", "id").collect()}
    assert one.keys() == two.keys() == three.keys()
    for i, value in one.items():
        assert value == pytest.approx(two[i], abs=1e-12)
        assert value == pytest.approx(three[i], abs=1e-12)
    wide = gate.best_similarity(df, refs.union(refs), ["k"], broadcast_bytes=10)
    assert wide.columns == [*df.columns, "similarity"]
    assert {r["id"]: r["similarity"] for r in wide.collect()} == pytest.approx(one, abs=1e-12)


def test_long_lists_and_salts_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, "c", [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)], "id long, k string, embedding array<double>")
    centers = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(25)], "cluster long, centroid array<double>")
    anchors = centers.select(F.col("cluster").alias("category"), F.col("centroid").alias("embedding"))

    def rows(found):
        return sorted(tuple(map(str, r)) for r in found.collect())

    def all_three():
        return [
            rows(vec.nearest_centroid(df, centers, normalise=True).select("id", "cluster")),
            rows(vec.category_similarity(centers, anchors).withColumn("similarity", F.round("similarity", 9))),
            rows(gate.best_similarity(df, df.where("id < 40"), ["k"], broadcast_bytes=0).withColumn("similarity", F.round("similarity", 9))),
        ]

    short = all_three()
    monkeypatch.setattr(vec, "LIST_ROWS", 4)
    monkeypatch.setattr(gate, "BLOCK_ROWS", 4)
    monkeypatch.setattr(gate, "SALT_BLOCKS", 2)
    monkeypatch.setattr(vec, "SALT_ROWS", 20)
    monkeypatch.setattr(vec, "SET_LISTS", 2)
    assert all_three() == short


def test_gate_without_candidates(spark):
    empty = spark.createDataFrame([], "id long, k string, embedding array<double>")
    refs = spark.createDataFrame([(1, "c", [1.0, 0.0])], "id long, k string, embedding array<double>")
    assert gate.similarity_gate(empty, refs, ["k"], 0.5).count() == 0


def _greedy(sim):
    """``sim[(cluster, category)]`` matched pair by pair."""
    clusters, cats = sorted({c for c, _ in sim}), sorted({k for _, k in sim})
    names = {}
    for (c, k), _ in sorted(sim.items(), key=lambda e: (-e[1], -e[0][0])):
        if c not in names and (len(clusters) > len(cats) or k not in names.values()):
            names[c] = k
    return names


@pytest.mark.parametrize("n_clusters", [3, 6])
def test_cluster_names(spark, n_clusters):
    rng = random.Random(n_clusters)
    draw = lambda: [rng.gauss(0, 1) for _ in range(6)]
    centers = [("x", c, draw()) for c in range(n_clusters)]
    anchors = [(k, draw()) for k in "pqrs"]

    def cos(a, b):
        norm = lambda v: sum(x * x for x in v) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b)

    wanted = _greedy({(c, k): cos(v, a) for _, c, v in centers for k, a in anchors})
    got = clustering.name_clusters(
        spark.createDataFrame(centers, "class string, cluster int, centroid array<double>"),
        spark.createDataFrame(anchors, "category string, embedding array<double>"),
    )
    assert {r["cluster"]: r["cluster_name"] for r in got.collect()} == wanted


def test_quota_with_shared_cluster_names(spark):
    clusters = spark.createDataFrame([(0, n) for n in "abb"], "label int, cluster_name string")
    targets = spark.createDataFrame([(0, 0, 11)], "class_pos int, label int, target long")
    by_name = {r["cluster_name"]: r["quota"] for r in sampling.cluster_quotas(clusters, targets).collect()}
    by_k = {r["cluster_name"]: r["quota"] for r in sampling.cluster_quotas(clusters, targets, k=3).collect()}
    assert by_name == {"a": 6, "b": 5}
    assert by_k == {"a": 4, "b": 4}


@pytest.mark.parametrize("balance", ["majority", 40])
@pytest.mark.parametrize("threshold", [None, 0.9])
def test_augmentation_hits_targets(spark, balance, threshold):
    """A pool of one text in a class, few candidates, and a class that is already full."""
    real = [(i, f"real text number {i}", 1, "c", [1.0, 0.0]) for i in range(30)]
    real += [(100, "two words", 0, "a", [1.0, 0.0]), (101, "a b c d e", 2, "b", [0.0, 1.0]), (102, "v w x y z", 2, "c", [1.0, 0.2])]
    offered = [(0, "a", r, 0, f"candidate line {r}", [1.0, r / 10]) for r in range(8)]
    offered += [(2, "b", r, 0, f"- other line {r}", [1.0, 1.0]) for r in range(4)] + [(2, "c", 1, 1, "Two WORDS", [1.0, 0.0])]
    df = spark.createDataFrame(real, "row_id long, text string, label int, cluster_name string, embedding array<double>")
    lines = spark.createDataFrame(offered, "label int, cluster_name string, round long, line int, raw string, embedding array<double>")
    rows = augment(df, lines, threshold, balance).collect()
    got = Counter(r["label"] for r in rows)
    wanted = {0: 30, 1: 30, 2: 30} if balance == "majority" else {0: 41, 1: 30, 2: 42}
    assert got == wanted
    assert sum(not r["is_synthetic"] for r in rows) == len(real)
    assert "Two WORDS" not in {r["text"] for r in rows if r["origin"] == "candidate"}


def test_perturbation_changes_at_most_one_place(spark):
    real = spark.createDataFrame([(0, 7, "a b c d e f")], "label int, row_id long, text string")
    needs = spark.createDataFrame([(0, 200)], "label int, n long")
    words = "a b c d e f".split()
    allowed = {" ".join(words[:i] + words[i + 1 :]) for i in range(1, 5)}
    allowed |= {" ".join(words[: i + 1] + words[i:]) for i in range(6)}
    allowed |= {" ".join([*words[:i], words[i + 1], words[i], *words[i + 2 :]]) for i in range(5)}
    got = {r["text"] for r in sampling.perturbed_oversample(sampling.numbered_pool(real), real, needs, 1).collect()}
    assert got == allowed


def _replay(scores, patience, delta):
    best, counter = None, 0
    for i, s in enumerate(scores, 1):
        if best is None or s > best + delta:
            best, counter = s, 0
        else:
            counter += 1
            if counter >= patience:
                return i
    return None


def test_early_stop_against_replay(spark):
    rng = random.Random(9)
    runs = {f"r{i}": [round(rng.random() * 0.3 + j * rng.choice([0, 0.01]), 3) for j in range(rng.randint(1, 40))] for i in range(40)}
    rows = [(r, j + 1, s) for r, scores in runs.items() for j, s in enumerate(scores)]
    history = spark.createDataFrame(rows, "run string, epoch int, score double").repartition(5)
    for patience, delta in ((3, 0.05), (5, 0.0)):
        got = {r["run"]: r["stop_epoch"] for r in training.early_stop(history, patience, delta).collect()}
        assert got == {r: _replay(scores, patience, delta) for r, scores in runs.items()}


def test_csv_predictions_without_key_align_by_line(spark, tmp_path):
    for name, labels in (("one", [0, 1, 2, 1]), ("two", [2, 1, 0, 0])):
        lines = ["text,true_label,pred_label"] + [f"t{i},{i % 3},{p}" for i, p in enumerate(labels)]
        (tmp_path / f"{name}_predictions.csv").write_text("\n".join(lines) + "\n")
    got = read_predictions(spark, str(tmp_path)).collect()
    assert {(r["system"], r["row_id"]): r["pred_label"] for r in got if r["system"] == "two"} == {
        ("two", i): p for i, p in enumerate([2, 1, 0, 0])
    }
    assert {r["text"] for r in got if r["row_id"] == 3} == {"t3"}


def test_large_samples_equal_the_head_of_a_larger_sample(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("row_id"), F.lit("c").alias("k"))
    big = {r["row_id"] for r in sampling.stratified_seeds(df, ["k"], per_group=1500).collect()}
    small = {r["row_id"] for r in sampling.stratified_seeds(df, ["k"], per_group=900).collect()}
    assert (len(big), len(small)) == (1500, 900)
    assert small < big


def test_roc_turns_leave_out_points_on_a_straight_run(spark):
    scores = [(0.9, 0), (0.8, 0), (0.7, 0), (0.6, 1), (0.5, 1), (0.4, 0), (0.3, 0)]
    rows = [("s", i, label, 0, [s, 1 - s, 0.0]) for i, (s, label) in enumerate(scores)]
    preds = spark.createDataFrame(rows, "system string, row_id long, true_label int, pred_label int, probs array<double>")

    def thresholds(**options):
        found = curves.roc_points(preds, **options).where("cls = 0").collect()
        return sorted((r["threshold"] for r in found if r["threshold"] is not None), reverse=True)

    assert thresholds() == [s for s, _ in scores]
    assert thresholds(collinear=False) == [0.9, 0.7, 0.5, 0.3]


def test_repeated_texts_by_class(spark):
    rows = [(0, "One text"), (0, " one TEXT "), (0, "another"), (1, "one text"), (1, None), (1, None), (None, "x")]
    df = spark.createDataFrame(rows, "label int, text string")
    got = {r["label"]: (r["n"], r["n_distinct"], r["n_repeated"]) for r in balance.repeated_texts(df).collect()}
    assert got == {0: (3, 2, 1), 1: (3, 2, 1), None: (1, 1, 0)}
    assert balance.repeated_texts(df.limit(0)).count() == 0


def test_registry_with_several_keys_or_none(spark):
    preds = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "system string, row_id long")
    got = sorted((r["key"], r["system"], r["row_id"]) for r in registered(preds, {"x": "a", "y": "a", "z": "c"}).collect())
    assert got == [("x", "a", 1), ("y", "a", 1)]
    assert registered(preds, {}).count() == 0
