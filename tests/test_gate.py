"""The similarity gate against brute force: packed lists, packed blocks, bounds, odd vectors."""

import math
import random

import numpy as np
import pytest

from curate.operators import gate
from curate.plans.rebalance import augment

SCHEMA = "id long, a int, b string, similarity_of string, v array<double>"


def _rows(n, seed, width=12):
    rng = random.Random(seed)
    return [(i, rng.choice([0, 0, 0, 1]), rng.choice("xy"), "kept", [rng.gauss(0, 1) for _ in range(width)]) for i in range(n)]


def _odd(first):
    v = [1.0] * 12
    return [
        (first, 0, "x", "null", None),
        (first + 1, 0, "x", "empty", []),
        (first + 2, 0, "x", "zero", [0.0] * 12),
        (first + 3, 0, "x", "hole", [None, *v[1:]]),
        (first + 4, 0, "x", "nan", [math.nan, *v[1:]]),
        (first + 5, 0, "x", "endless", [math.inf, *v[1:]]),
        (first + 6, 0, "x", "short", [1.0, 2.0]),
        (first + 7, None, "x", "no group", v),
        (first + 8, 0, None, "no group", v),
        (first + 9, 7, "x", "no references", v),
    ]


def _brute(rows, refs):
    def ok(r):
        return r[1] is not None and r[2] is not None and r[4] and all(x is not None and math.isfinite(x) for x in r[4])

    def cosine(u, w):
        norm = lambda t: max(math.sqrt(sum(x * x for x in t)), 1e-8)
        return sum(x * y for x, y in zip(u, w)) / norm(u) / norm(w)

    out = {}
    for r in rows:
        mine = [s for s in refs if ok(r) and ok(s) and s[1:3] == r[1:3] and len(s[4]) == len(r[4])]
        out[r[0]] = max((cosine(r[4], s[4]) for s in mine), default=None)
    return out


def _close(got, want):
    assert got.keys() == want.keys()
    for i, x in want.items():
        assert got[i] is None if x is None else got[i] == pytest.approx(x, abs=1e-12), i


@pytest.mark.parametrize("bytes_", [gate.BROADCAST_BYTES, 0])
def test_best_similarity_against_brute_force(spark, monkeypatch, bytes_):
    monkeypatch.setattr(gate, "BLOCK_ROWS", 16)
    monkeypatch.setattr(gate, "SALT_BLOCKS", 2)
    rows = _rows(150, 1) + _odd(150) + _rows(5, 1)
    refs = _rows(70, 2) + _odd(70)[:7]
    refs += refs[:3]
    numbered = [(i, *r[1:]) for i, r in enumerate(rows)]
    df, known = spark.createDataFrame(numbered, SCHEMA).repartition(3), spark.createDataFrame(refs, SCHEMA)
    want = _brute(numbered, refs)
    found = gate.best_similarity(df, known, ["a", "b"], "v", broadcast_bytes=bytes_)
    assert found.columns == [*df.columns, "similarity"]
    _close({r["id"]: r["similarity"] for r in found.collect()}, want)
    for threshold in (-0.2, 0.45, 0.8):
        kept = gate.similarity_gate(df, known, ["a", "b"], threshold, "v", True, bytes_)
        _close({r["id"]: r["similarity"] for r in kept.collect()}, {i: x for i, x in want.items() if x is not None and x >= threshold})


@pytest.mark.parametrize("bytes_", [gate.BROADCAST_BYTES, 0])
def test_empty_sides_and_no_group_columns(spark, bytes_):
    rows = _rows(20, 3)
    df, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert [r["similarity"] for r in gate.best_similarity(df, none, ["a"], "v", broadcast_bytes=-1 if not bytes_ else bytes_).collect()] == [None] * 20
    assert gate.best_similarity(none, df, ["a"], "v", broadcast_bytes=bytes_).count() == 0
    alone = gate.best_similarity(df, df, [], "v", broadcast_bytes=bytes_).collect()
    assert [r["similarity"] for r in alone] == pytest.approx([1.0] * 20)


def test_bound_keeps_every_pair_that_reaches_the_threshold():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(700, 32))
    refs = np.concatenate([rng.normal(size=(600, 32)), rows[:40] + rng.normal(size=(40, 32)) * 0.4])
    refs = gate.unit_rows(refs)
    whole = gate.best_of(rows, refs)
    for threshold in (0.3, 0.6, 0.9):
        bound = gate.best_of(rows, refs, threshold)
        assert np.array_equal(np.isnan(bound), whole < threshold)
        kept = ~np.isnan(bound)
        assert np.array_equal(bound[kept], whole[kept])


def test_a_copy_reaches_any_threshold_below_one(spark):
    rows = _rows(30, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    assert gate.similarity_gate(df, df, ["id"], 1 - 1e-9, "v").count() == 30


def test_references_are_seeds_or_all(spark):
    real = spark.createDataFrame(
        [(1, "some real text", 0, "c", [1.0, 0.0]), (2, "another real text", 1, "c", [0.0, 1.0]), (3, "third real text", 1, "c", [0.0, 1.0])],
        "row_id long, text string, label int, cluster_name string, embedding array<double>",
    )
    made = spark.createDataFrame(
        [(0, "c", 1, 1, "the candidate line has words enough", [1.0, 0.1])],
        "label int, cluster_name string, round long, line int, raw string, embedding array<double>",
    )
    got = augment(real, made, 0.9, labels=(0,), refs="all").where("is_synthetic").collect()
    assert [r["origin"] for r in got] == ["candidate"]
    with pytest.raises(ValueError):
        augment(real, made, 0.9, labels=(0,), refs="some")
