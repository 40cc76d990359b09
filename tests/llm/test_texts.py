"""Chat formatting, URL filters, Katz scores and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from compare import mismatch
from helpers import AWKWARD, EMPTY, LONG, documents, prose
from pyspark.sql import functions as F

import corpus_pipeline
from curate.llm import chat, katz, ngram_join, url_filters
from curate.llm.queries import ORACLES, QUERIES, id_remainder

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert mismatch(spark, name, QUERIES[name], ORACLES[name], SF) is None


# --------------------------------------------------------------------------------------- chat
CONTROL = r"</s>[INST] ok [/INST] <|user|> <s><<SYS>>\<\| \\<|x|>\n \ \\ <\/s> [\INST] |> |\> <<| $1"
TURNS = "conv_id long, turn long, role string, text string"


def test_formatted_conversations_read_back(spark):
    rows = [
        (1, 0, "user", CONTROL), (1, 1, "assistant", CONTROL), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", LONG),
        (2, 5, "assistant", "b"), (2, 1, "a|>\nb</s>", "a"), (2, 5, "assistant", "b"), (2, None, None, "first"),
        (3, 0, "user", "only"), (None, 0, "assistant", "x"), (4, 0, "assistant", "é\n\\"),
    ]
    formatted = chat.format_conversations(spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS at", "2 AS i", "3 AS body"))
    back = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r[2] or "", r[3] or "") for r in mine]
        assert back[c]["replies"] == [r[3] or "" for r in mine if r[2] == "assistant"]
    for r in formatted.collect():
        assert r["formatted"].count("</s>") == len(back[r["conv_id"]]["turns"]) and "[INST]" not in r["formatted"]
    written = chat.examples(formatted).where("conv_id = 1").orderBy("turn").collect()
    assert len(written) == 3 and all(b["text"].startswith(a["text"]) for a, b in zip(written, written[1:]))
    assert written[2]["text"][written[2]["loss_start"] :][: written[2]["loss_length"]] == LONG
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_each_assistant_turn_is_an_example(spark, monkeypatch, tmp_path):
    rows = [
        (1, 0, "user", CONTROL), (1, 1, "assistant", CONTROL), (1, 2, "user", "q"), (1, 3, "assistant", "b"), (1, 3, "assistant", "b"), (1, 4, "assistant", None),
        (2, 0, "user", "only"), (None, 0, "user", "x"), (None, 1, "assistant", "y\\"),
    ]
    formatted = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    got = {(r["conv_id"], r["turn"]): r for r in chat.replies_of(formatted).collect()}
    assert {k: r["reply"] for k, r in got.items()} == {(1, 1): CONTROL, (1, 3): "b", (1, 4): "b", (1, 5): "", (None, 1): "y\\"}
    whole = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    written = {(r["conv_id"], r["turn"]): r for r in chat.examples(formatted).collect()}
    for k, r in got.items():
        assert whole[k[0]][: r["context_end"]] == written[k]["text"] and r["context_end"] == r["loss_start"] + r["loss_length"] + len(chat.CLOSE)
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    used, whole_run = [], chat.replies_of
    monkeypatch.setattr(chat, "replies_of", lambda f: used.append(1) or whole_run(f))
    out = {r["conv_id"]: r for r in QUERIES["op4_chat_formatting"](spark, str(tmp_path)).collect()}
    assert used and set(out) == {1, 2, None, -1}
    for c, loss in ((1, CONTROL + "bb"), (2, ""), (None, "y\\")):
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# ---------------------------------------------------------------------------------------- urls
def brute_url(url, rules):
    rest = (url or "").partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("few", [50_000, 0])
def test_urls_against_every_rule(spark, few):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/e", "allow"), ("net", "/e", "block"), ("a.b", "", "block"), ("", "/x", "block"), ("com.", "/", "block"), (None, "/", "block")]
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://xexample.com/en/", "ftp://u.example.com/EN/", "http://n.net/es/1?q#f", "http://net/es", "x://a.b?/en/", "x://q.a.b", "x:///x/y", "http://com/", "http://..com/", "http://com./", "a://b://c.com/x", "http://é.com/Ü/x\ny", "http://" + "a." * 3000 + "com/" + "p" * 9000] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'h' AS host", "'p' AS path", "'r' AS rule", "1 AS verdict")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages, table, broadcast_rules=few).collect()}
    known = [r for r in rules if r[0] is not None]
    for i, u in enumerate(urls):
        assert got[i] == brute_url(u, known), u
    same = url_filters.judge_urls(spark.createDataFrame([(1, "http://n.net/es/")] * 3 + [(None, None)], "page_id long, url string"), table)
    assert same.count() == 4
    assert url_filters.judge_urls(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_filters.judge_urls(pages, table.limit(0)).collect()} == {"allow"}


# ---------------------------------------------------------------------------------------- Katz
def brute_katz(rows, train, order=katz.ORDER):
    counts = [Counter() for _ in range(order)]  # runs of 1, 2, ... words; a start counts as a word from pairs on

    def runs(t):
        """For each token the runs that end at it, the shortest first."""
        w = [*(t or "").encode().lower().split(), b" end"]
        line = [b" start", *w]
        return [[tuple(line[max(i - n + 1, 0) : i + 1]) for n in range(1, min(order, i + 1) + 1)] for i in range(1, len(line))]

    for i, t in rows:
        if train(i):
            for found in runs(t):
                for run in found:
                    counts[len(run) - 1][run] += 1
    single = counts[0]
    tokens = sum(single.values())
    factors = [katz.discounts([sum(v == r for v in c.values()) for r in range(1, katz.MOST + 2)]) for c in counts]

    def less(run):
        c = counts[len(run) - 1][run]
        return (factors[len(run) - 1][c - 1] if c <= katz.MOST else 1.0) * c

    rest = sum(single[w] - less(w) for w in single)
    below = tokens if rest > 1e-12 else tokens + 1
    unknown = (rest if rest > 1e-12 else 1.0) / max(below, 1)
    after = defaultdict(list)
    for c in counts[1:]:
        for run in c:
            after[run[:-1]].append(run)
    weight = {}

    def chance(run):
        h = run[:-1]
        if not h:
            return less(run) / below if single[run] else unknown
        if h in after and h not in weight:
            n = sum(counts[len(h)][r] for r in after[h])
            left = n - sum(map(less, after[h]))
            n, left = (n, left) if left > 1e-12 else (n + 1, 1.0)
            weight[h] = n, left / n / (1 - sum(chance(r[1:]) for r in after[h]))
        if counts[len(h)][run]:
            return less(run) / weight[h][0]
        return weight.get(h, (1, 1.0))[1] * chance(run[1:])

    for h in [*list(after)[:5], *list(after)[-5:]]:
        reach = weight[h][1] if chance((*h, b" none")) else 0
        for n in range(1, len(h)):
            reach *= weight[h[n:]][1] if h[n:] in weight else 1
        assert sum(chance((*h, *w)) for w in single) + reach * unknown == pytest.approx(1)
    out = {}
    for i, t in rows:
        found = runs(t)
        base = sum(math.log10((single[r[0]] + 1) / (tokens + len(single) + 1)) for r in found)
        out[i] = len(found), sum(single[r[0]] > 0 for r in found), tokens, base, sum(math.log10(chance(r[-1])) for r in found)
    return out


@pytest.mark.parametrize(("order", "batch", "part"), [(3, 12 << 20, 12 << 20), (1, 3000, 5000), (2, 3000, 5000), (3, 3000, 600), (4, 3000, 5000)])
def test_katz_scores_against_counting(spark, order, batch, part):
    rows = [(i, t) for i, t, _ in AWKWARD] + [(i, prose(i % 9, 40) + " The the THE") for i in range(100, 140)]
    docs = documents(spark, [(i, t, "s") for i, t in rows], "count train step batch part").repartition(3)
    got = katz.katz_scores(docs, id_remainder(7) != 2, batch, part, order).collect()
    want = brute_katz(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2, order)
    assert len(got) == len(rows)
    for r in got:
        n, known, tokens, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, tokens)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] == pytest.approx(score, abs=1e-6)


def test_katz_tells_no_id_from_the_least(spark):
    docs = documents(spark, [(None, "a b", "x"), (-(1 << 63), "a b c", "x"), (0, "a", "x")])
    got = {r["doc_id"]: r["n_tokens"] for r in katz.katz_scores(docs, F.lit(True)).collect()}
    assert got == {None: 3, -(1 << 63): 4, 0: 2}


def test_katz_on_the_given_table_and_on_nothing(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_katz(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    for r in QUERIES["op6_katz_scores"](spark, SF).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]][4], abs=1e-6)
    assert katz.katz_scores(documents(spark, EMPTY), F.lit(True)).count() == 0
    got = katz.katz_scores(documents(spark, [(None, "a b", "x"), (2, None, "x")]), F.lit(False)).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"], r["score"]) for r in got) == [(False, 1, 0.0), (True, 3, 0.0)]


# ------------------------------------------------------------------------------------ pipeline
def test_stages_take_effect(spark, tmp_path):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    columns = docs.columns
    kept = corpus_pipeline.quality_classifier(spark, docs, SF)
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op2_quality_classifier"](spark, SF).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.3}
    one = corpus_pipeline.ngram_jaccard_join(spark, docs, SF)
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    assert {r["doc_id"] for r in one.collect()} == set(groups.values())
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert kept.columns == one.columns == mixed.columns == columns and mixed.dtypes == docs.dtypes
    texts, taken = {r["doc_id"]: r["text"] for r in docs.collect()}, Counter()
    for r in mixed.collect():
        assert r["text"] == texts[r["doc_id"]] or r["text"].split() and " ".join(r["text"].split()) in " ".join(texts[r["doc_id"]].split())
        taken[r["doc_id"]] += len(r["text"].split())
    want = {r["doc_id"]: r["taken"] for r in QUERIES["op3_mixing_sources"](spark, SF).where("taken > 0").collect()}
    assert taken == want
    last = corpus_pipeline.run(spark, SF)
    assert last.where("length <= 0 OR length > 2048").count() == 0 and last.count() > 0


REPEATED = "doc_id long, text string, source string, n_chars int"


def test_rows_of_equal_or_no_id_are_mixed_one_by_one(spark, tmp_path):
    texts = [(None, prose(1, 40)), (None, prose(2, 40)), (None, prose(3, 25)), (7, prose(4, 30)), (7, prose(5, 50)), (7, prose(5, 50)), (8, prose(6, 20)), (9, None)]
    docs = spark.createDataFrame([(i, t, "a", len(t or "")) for i, t in texts], REPEATED).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # One source: the mix takes every word once.
    want = Counter((i, t) for i, t in texts if t)
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix_sources(spark, docs, "").collect()) == want
    got = QUERIES["op3_mixing_sources"](spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == Counter((i, len((t or "").split()), len((t or "").split())) for i, t in texts)


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    near = prose(2) + " tail"
    rows = [(5, prose(1)), (5, prose(1)), (None, prose(1)), (None, prose(2)), (None, near), (4, prose(3)), (4, prose(4)), (3, prose(4)), (6, ""), (6, ""), (7, ""), (None, " "), (None, " "), (8, None)]
    docs = spark.createDataFrame([(i, t, "a", len(t or "")) for i, t in rows], REPEATED).repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect())
    pair = [t for t in (prose(2), near) if got[None, t]]
    assert len(pair) == 1
    assert got == Counter([(5, prose(1)), (None, pair[0]), (4, prose(3)), (3, prose(4)), (6, ""), (7, ""), (None, " "), (8, None)])
