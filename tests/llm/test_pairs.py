"""Near-duplicates, vectors and components against brute force; hot groups and blocks of several sizes."""

import numpy as np
import pytest
from helpers import AWKWARD, EMPTY, documents, prose

from curate.llm import graph, metric_join, ngram_join
from curate.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def joined(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_documents(rows):
    """{id: (links, component)} with Jaccard on sets of five words."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    near, links = np.zeros(len(rows), int), []
    for x in range(len(order)):
        for y in range(x + 1, len(order)):
            a, b = sets[order[x]], sets[order[y]]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                near[order[x]] += 1
                near[order[y]] += 1
                links.append((x, y))
    root = joined(len(order), links)
    return {rows[i][0]: (near[i], rows[order[root[x]]][0]) for x, i in enumerate(order)}


def same_documents(got, rows):
    want = brute_documents(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_links"], r["component_id"]) == want[r["doc_id"]], r


def test_near_duplicates_of_the_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same_documents(QUERIES["op9_ngram_jaccard_join"](spark, SF).collect(), rows)


@pytest.mark.parametrize("block_docs", [512, 7])
def test_groups_of_near_copies_in_blocks(spark, block_docs):
    base, rng = prose(11, 120).split(), np.random.default_rng(5)
    rows = [(i, t) for i, t, _ in AWKWARD]
    for i in range(100, 160):
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            w[at] = f"edit{rng.integers(0, 50)}"
        rows.append((i, " ".join(w)))
    rows += [(200, "A  b c"), (201, "a b\nC"), (202, "a b c d"), (203, "a b c d")]
    docs = documents(spark, [(i, t, "s") for i, t in rows], "block copies digest bands")
    same_documents(ngram_join.near_duplicates(docs, recall=0.999999, block_docs=block_docs).collect(), rows)


def brute_rows(rows, alike):
    """Sorted (id, links, component): every row is a node of its own, a NULL id is none."""
    known = [k for k, r in enumerate(rows) if r[0] is not None]
    links = [(x, y) for x in known for y in known if x < y and alike(rows[x][1], rows[y][1])]
    root = joined(len(rows), links)
    least = {}
    for k in known:
        least[root[k]] = min(rows[k][0], least.get(root[k], rows[k][0]))
    out = [(rows[k][0], sum(k in pair for pair in links), least[root[k]]) for k in known]
    return sorted(out) + [(None, 0, None)] * (len(rows) - len(known))


def by_row(found, key):
    rows = [(r[key], r["n_links"], r["component_id"]) for r in found.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0))


def alike_texts(a, b):
    one, two = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((a or "").lower().split(), (b or "").lower().split()))
    return bool(one and two) and len(one & two) >= 0.8 * len(one | two)


def test_repeated_rows_are_documents_of_their_own(spark):
    t, u = prose(1, 80), prose(2, 80)
    cases = [
        [(5, t), (5, t), (6, t + " tail")],
        [(5, t), (5, u), (6, t + " tail"), (7, u + " tail"), (7, u + " tail"), (1, u + " other")],
        [(2, t), (2, t + " tail"), (2, u), (3, t), (None, t), (None, t), (2, None), (2, ""), (2, None), (3, u), (0, u + " tail")],
    ]
    for rows in cases:
        docs = documents(spark, [(i, x, "s") for i, x in rows], "key class digest component")
        for block_docs in (512, 2):
            assert by_row(ngram_join.near_duplicates(docs, recall=0.999999, block_docs=block_docs), "doc_id") == brute_rows(rows, alike_texts)


def test_repeated_vectors_are_vectors_of_their_own(spark):
    v, w = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.1, 0.0]
    near = lambda x, e: [c + e for c in x]
    cases = [
        [(1, v), (1, w), (2, near(v, 0.05)), (3, near(w, 0.05))],
        [(1, v), (1, near(v, 0.05)), (2, near(v, 0.02))],
        [(4, v), (4, v), (4, w), (5, near(v, 0.01)), (5, near(w, 0.01)), (None, v), (None, None), (4, None), (4, [0.0] * 4), (0, near(w, 0.02)), (5, near(v, 0.01))],
    ]

    def alike(a, b):
        if not a or not b or not any(a) or not any(b):
            return False
        return np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9

    for rows in cases:
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        for block_rows in (4096, 1):
            assert by_row(metric_join.cosine_links(df, block_rows=block_rows), "vec_id") == brute_rows(rows, alike)


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(documents(spark, EMPTY)).count() == 0
    got = ngram_join.near_duplicates(documents(spark, [(None, prose(1), "a"), (2, prose(1), "a"), (2, prose(1), "a"), (3, None, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_links"]) for r in got) == [(-1, 0), (2, 1), (2, 1), (3, 0)]


def test_banding_reaches_the_recall():
    for threshold, recall, rows in ((0.8, 0.999, 5), (0.5, 0.9, 3), (0.95, 0.99, 8)):
        bands = ngram_join.banding(threshold, recall, rows)
        assert 1 - (1 - threshold**rows) ** bands >= recall > 1 - (1 - threshold**rows) ** (bands - 1)


# ------------------------------------------------------------------------------------ vectors
def brute_vectors(rows):
    ids = sorted({i for i, _ in rows})
    unit = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and any(v):
            unit[i] = np.asarray(v, float) / np.linalg.norm(np.asarray(v, float))
    near, links = dict.fromkeys(ids, 0), []
    for x, a in enumerate(ids):
        for y in range(x + 1, len(ids)):
            b = ids[y]
            if a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                near[a] += 1
                near[b] += 1
                links.append((x, y))
    root = joined(len(ids), links)
    return {i: (near[i], ids[root[x]]) for x, i in enumerate(ids)}


@pytest.mark.parametrize(("block_rows", "pivots"), [(4096, 2048), (16, 2048), (16, 2), (400, 1)])
def test_vectors_against_all_pairs(spark, block_rows, pivots):
    rng = np.random.default_rng(8)
    centres, rows = rng.normal(size=(20, 8)), []
    for i in range(300):
        spread = 0.05 if i < 100 else 0.35
        rows.append((i * 3, (centres[0 if i < 100 else i % 20] + spread * rng.normal(size=8)).astype("f4").tolist()))
    rows += [(2000 + i, rows[5][1]) for i in range(40)] + [(3000, [float(x) * 7 for x in rows[5][1]])]
    rows += [(4000, None), (4001, [0.0] * 8), (4002, [None] + [1.0] * 7), (4003, [float("nan")] * 8), (4004, [float("inf")] + [0.0] * 7), (4005, [1.0, 0.0]), (4006, [1.0, 0.1]), (4007, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS block", "3 AS component")
    want = brute_vectors([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows])
    got = metric_join.cosine_links(df, block_rows=block_rows, max_pivots=pivots).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_links"], r["component_id"]) == want[r["vec_id"]], r
        assert r["kept"] == (r["vec_id"] == r["component_id"])


def test_vectors_of_the_given_table_and_none(spark):
    big = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{big}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    u = np.stack(rows.embedding).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = QUERIES["op5_embedding_near_dedup"](spark, big).toPandas().set_index("vec_id").loc[rows.vec_id]
    assert (got.n_links.to_numpy() == near).all()
    ids = rows.vec_id.to_numpy()
    order = np.argsort(ids)
    root = joined(len(ids), np.argwhere(np.triu(u[order] @ u[order].T >= 0.9, 1)).tolist())
    assert (got.loc[ids[order]].component_id.to_numpy() == ids[order][root]).all()
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert metric_join.cosine_links(empty).count() == 0
    alone = metric_join.cosine_links(spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    assert sorted((r["vec_id"] or -1, r["n_links"], r["kept"]) for r in alone.collect()) == [(-1, 0, False), (3, 0, True)]


# --------------------------------------------------------------------------------- components
def test_components_of_chains_stars_and_noise(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(1500 + i, 1900) for i in range(50)]
    links += [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (250, 2))] + [(5, 5), (7, 8), (8, 7)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")).collect()}
    root = joined(2500, links)
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root[x] for x in ends}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
