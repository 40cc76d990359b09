"""Filter audit, hard negatives and private data against brute force, with awkward rows."""

import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from compare import mismatch
from helpers import AWKWARD, EMPTY, LONG, documents, prose
from pyspark.sql import functions as F

from curate.llm import filter_audit, hard_negatives, private_data
from curate.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    assert mismatch(spark, name, QUERIES[name], ORACLES[name], SF) is None


# -------------------------------------------------------------------------------- filter audit
def brute_audit(rows, labels):
    """{(part, order, step): counts} of (doc_id, text, part) rows."""
    masks = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        twin = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        failed = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": twin,
        }
        masks.append((part or "", {c for c, f in failed.items() if f}, any(a == i and i is not None and q == 1 for a, q, _ in labels), any(a == i and i is not None and x == 1 for a, _, x in labels)))
    out = {}
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            for k, c in enumerate(order):
                before = set(order[:k])
                gone = [m for m in mine if c in m[1] and not m[1] & before]
                out[part, "".join(order), k + 1] = [
                    sum(not m[1] & (before | {c}) for m in mine), len(gone), sum(c in m[1] and bool(m[1] & before) for m in mine),
                    sum(m[1] == {c} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone),
                ]
                total[c] += len(gone)
        for order in permutations("ABCDE"):
            for k, c in enumerate(order):
                out[part, "".join(order), k + 1].append(total[c])
    return out


@pytest.mark.parametrize("range_bytes", [1 << 24, 4096])
def test_audit_of_awkward_rows(spark, range_bytes):
    base = prose(4, 300)
    rows = [*AWKWARD, (None, prose(1), "a"), (0, prose(1), "a"), (20, prose(9, 200) + " 5 %", "b"), (21, "LOUD " * 120, None), (None, None, None)]
    rows += [(100 + i, base, "a" if i % 3 else "b") for i in range(40)] + [(200 + i, base + f" {i % 7}", None) for i in range(40)] + [(300, LONG, "b"), (12, "é", "ü"), (11, "é", "ü")]
    labels = [(0, 1, 0), (0, None, 1), (21, 1, 1), (None, 1, 1), (101, 1, None), (101, 1, 1), (102, 0, 0)]
    docs = documents(spark, rows, "mask digest part doc lang")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, said, part="source", range_bytes=range_bytes).collect()
    want = brute_audit(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in found} == want


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(documents(spark, EMPTY), none, part="source").count() == 0


def test_tries_hold_every_text_once():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 100, rng.integers(0, 9)).astype(np.uint8)) for _ in range(600)]
    trie = filter_audit.Trie()
    for i, t in enumerate(texts):
        trie.insert(t, 600 - i)
    want = {}
    for i, t in enumerate(texts):
        want[t] = min(600 - i, want.get(t, 10**9))
    found = list(trie.terminals())
    assert len(found) == len(want) and dict(found) == want


def test_ranges_part_the_order_of_texts():
    sample = [(f"{i:04d}-{'x' * 50}".encode(), 3) for i in range(200)] + [(b"0100-" + b"y" * 80, 400)]
    cuts, shares = filter_audit.cut_ranges(sample, 16)
    assert cuts == sorted(set(cuts)) and len(shares) == len(cuts) + 1 and abs(sum(shares) - 1) < 1e-9
    assert max(shares) <= 0.41 and sorted(shares)[-2] <= 2 / 16  # the hot prefix has a range of its own
    assert all(len(c) <= 6 for c in cuts)


# ------------------------------------------------------------------------------- hard negatives
def brute_negatives(rows, k=5):
    kept = sorted({(i, x, tuple(int(np.floor(256 * float(c))) for c in v)) for i, v, x in rows if i is not None and x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)})
    out = []
    for i, x, q in kept:
        if i % 100:
            continue
        score = [(sum(a * b for a, b in zip(q, p)), j, y) for j, y, p in kept if j != i and len(p) == len(q)]
        score.sort(key=lambda s: (-s[0], s[1]))
        for s, j, _ in [s for s in score if s[2] == x][:k]:
            near = [(t, n) for t, n, y in score if y != x and 80 * s <= 100 * t <= 100 * s][:k]
            out += [(i, j, r + 1, n, s, t) for r, (t, n) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("block_rows", "batch_rows"), [(1024, 2048), (16, 3)])
def test_hard_negatives_against_brute_force(spark, block_rows, batch_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.4 * rng.normal(size=8)).round(2).tolist(), int(rng.integers(0, 3))) for i in range(600)]
    rows += [(700, rows[0][1], 0), (701, rows[0][1], 1), (702, rows[0][1], 1), (702, rows[0][1], 1), (702, rows[1][1], 1), (100, rows[4][1], 2)]
    rows += [(800, None, 1), (900, [1.0] * 8, None), (None, [1.0] * 8, 1), (1000, [None] + [1.0] * 7, 1), (1100, [float("nan")] * 8, 1)]
    rows += [(1200, [0.5, 0.25], 1), (1201, [0.5, 0.5], 1), (1202, [0.5, 0.2], 2), (1300, [0.0] * 8, 0), (1400, [], 1), (1401, [], 1), (1402, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS block", "2 AS id", "3 AS data")
    found = hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0, block_rows=block_rows, batch_rows=batch_rows)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows)


def test_hard_negatives_of_nothing_and_of_long_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    for rows in ([], [(1, [1.0, 2.0], 1)], [(100, [1.0, 2.0], 1)]):
        assert hard_negatives.mine_hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(Exception, match="too long"):
        hard_negatives.mine_hard_negatives(spark.createDataFrame([(100, [1e30], 1)], schema), F.col("vec_id") == 100).count()


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (5, 2)])
def test_the_curve_visits_neighbours(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = hard_negatives.hilbert_keys(points, bits)
    assert len(set(keys)) == len(points)
    line = points[np.argsort(np.asarray([int.from_bytes(k, "big") for k in keys]))]
    assert (np.abs(np.diff(line, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_what_zones_hold():
    rng = np.random.default_rng(4)
    q, rows = rng.integers(-90, 90, (20, 7)).astype(float), rng.integers(-90, 90, (50, 7)).astype(float)
    least, most = hard_negatives.bounds(q, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = q @ rows.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most[:, 0]).all()


# --------------------------------------------------------------------------------- private data
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and max(int(p) for p in m[0].split(".")) > 255:
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            if kind == "card":
                twice = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
                if not 14 <= len(d) <= 19 or twice % 10:
                    continue
            out.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


ODD = [
    "a@b.c@d.e x@y z@-. é@é.com .@a.b @a.b", "1.2.3.4.5.6.7.8 999.1.2.3 1.2.3 256.1.1.1.1 01.002.0003.4", "++1 (017) 555-7713. +1 2 +123456789012345678",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112", "é" * 10 + "me.too+x%y@mail.example.org." + "é", "+1 (243) 555-5526 4845168114407329",
]


def found_spans(spark, rows, **options):
    docs = documents(spark, [(i, t, "s") for i, t in rows], "base spans more valid patterns p")
    return {r["doc_id"]: ([tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]) for r in private_data.find_private_data(docs, **options).collect()}


def test_base_spans_are_those_of_the_patterns(spark):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [*given, *enumerate(ODD, 10**6), (-1, None), (-2, ""), (-3, LONG)]
    found = found_spans(spark, rows)
    for i, t in rows:
        base, spans = found[i]
        assert base == brute_base(t), (i, t)
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (s[1], private_data.KINDS.index(s[0])))


def test_the_method_adds_what_the_patterns_swallow(spark):
    shown = [(i, f"text {prose(i, 20)} is 4845168114407329 and {i}.45.67.89 or jo{i}@mail.example.com, +1 (243) 555-{5500 + i} {prose(i)}") for i in range(1, 60)]
    new = [
        (1001, "see 4845168114407329 4845168114407329 there"), (1002, "call +1 (243) 555-5526 4845168114407329 now"),
        (1003, "write jo.doe (at) example (dot) org soon"), (1005, "host 10[.]20[.]30[.]40 here"),
    ]
    clean = [(2001, prose(3)), (2002, "order 4845168114407328 of 2024, 17 pages"), (2003, "version 1.2.3, 300.400.500.600")]
    found = found_spans(spark, shown + new + clean)
    added = {i: [s for s in spans if s not in base] for i, (base, spans) in found.items()}
    assert added[1001] == [("card", 4, 20), ("card", 21, 37)]
    assert added[1002] == [("phone", 5, 22), ("card", 23, 39)]
    assert added[1003] == [("email", 6, 35)]
    assert added[1005] == [("ip", 5, 22)]
    assert all(not added[i] and not found[i][0] for i, _ in clean)
    assert all(not added[i] for i, _ in shown)


def test_private_data_of_odd_tables(spark):
    assert found_spans(spark, []) == {}
    docs = documents(spark, [(None, ODD[0], "s"), (1, ODD[0], "s"), (1, ODD[0], "s")])
    assert [len(r["base"]) for r in private_data.find_private_data(docs).collect()] == [len(brute_base(ODD[0]))] * 3
    long = "1" * 300_000 + " " + "a" * 300_000 + "+" + "2 " * 100_000 + "@" * 1000
    assert found_spans(spark, [(1, long)])[1][0] == []


def test_query_of_private_data(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op13_private_data"](spark, SF).collect():
        base = brute_base(rows[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in private_data.KINDS] == [sum(s[0] == k for s in base) for k in private_data.KINDS]


def test_reliabilities_follow_the_honest_labelers():
    rng = np.random.default_rng(1)
    counts = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.4
        votes = "+" + "".join("+" if (rng.random() < trust) == truth else "-" for trust in (0.9, 0.8, 0.55, 0.7, 0.5))
        role = "base" if truth and rng.random() < 0.5 else "miss" if not truth and rng.random() < 0.5 else "more"
        counts[votes.replace("+", "-", 1) if role == "miss" else votes, role] += 1
    patterns = sorted(counts)
    p = private_data.reliabilities("phone", patterns, np.asarray([counts[x] for x in patterns], float))
    chance = dict(zip(patterns, p))
    assert chance["++++++", "more"] > 0.9 > 0.1 > chance["+-----", "more"]
    assert chance["++---+", "more"] > chance["+--+-+", "more"]
