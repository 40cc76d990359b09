"""Fingerprints, quality, mixing, packing and sharding against brute force on small tables."""

import math
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from helpers import AWKWARD, EMPTY, documents, prose
from pyspark.sql import functions as F

from curate.llm import fingerprints, mixing, packing, quality, sharding
from curate.llm.queries import QUERIES, id_remainder

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------------ fingerprints
def test_edited_texts_follow_the_next_document(spark):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(documents(spark, AWKWARD, "found next_text guest")).collect()}
    texts = [(i, t or "") for i, t, _ in AWKWARD]
    assert len(rows) == len(texts)
    for at, (i, t) in enumerate(texts):
        m, after = len(t) // 2, texts[(at + 1) % len(texts)][1]
        edited = t[: len(t) - m] + after[:m]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i]["n_chars"] == len(t)
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] and rows[0]["near_next"] == 1
    assert rows[2]["fingerprint"] == rows[3]["fingerprint"] == ""
    assert rows[9]["near_next"] < 0.1 < rows[10]["near_edited"]


def test_anchors_are_the_closed_syncmers(spark):
    text = prose(5, 80) + " " + prose(6, 40)
    k, s = fingerprints.K, fingerprints.S
    words = text.split()
    inner = [" ".join(words[i : i + s]) for i in range(len(words) - s + 1)]
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in set(words)], "w string").select("w", F.xxhash64("w")).collect()}
    pairs = spark.createDataFrame([(i, hashes[words[i]], hashes[words[i + 1]]) for i in range(len(inner))], "i int, a long, b long")
    h = {r[0]: r[1] for r in pairs.select("i", F.xxhash64("a", "b")).collect()}
    want = [i for i in range(len(words) - k + 1) if min(h[i + j] for j in range(k - s + 1)) in (h[i], h[i + k - s])]
    got = spark.createDataFrame([(text,)], "t string").select(fingerprints.anchors("t").alias("a")).first()["a"]
    assert [a["pos"] for a in got] == want
    moved = spark.createDataFrame([("new start " + text,)], "t string").select(fingerprints.anchors("t").alias("a")).first()["a"]
    assert {a["hash"] for a in got} <= {a["hash"] for a in moved}


def test_fingerprints_of_one_row_and_none(spark):
    assert fingerprints.fingerprint_edits(documents(spark, EMPTY)).count() == 0
    row = fingerprints.fingerprint_edits(documents(spark, [(7, "a b c d e f", "x")])).first()
    assert row["edited_sha256"] == hashlib.sha256(b"a b c a b c").hexdigest()


def test_long_texts_keep_every_anchor_and_its_place(spark):
    def run(tag: str, n: int) -> str:
        return " ".join(f"{tag}{i}" for i in range(n))

    shared = run("s", 60)
    texts = [run("a", 3000) + " " + shared + " " + run("b", 3000), run("c", 2000) + " " + shared + " " + run("d", 4000)]
    docs = documents(spark, [(i, t, "x") for i, t in enumerate(texts)])
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    whole = [r["a"] for r in docs.orderBy("doc_id").select(fingerprints.anchors("text").alias("a")).collect()]
    one, two = ({a["hash"] for a in w} for w in whole)
    assert len(one) > 3000 and one & two
    for i in (0, 1):
        assert rows[i]["anchors"] == whole[i] and rows[i]["near_next"] == len(one & two) / len(one | two)
        m = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - m] + texts[1 - i][:m]
        want = spark.createDataFrame([(edited,)], "t string").select(fingerprints.anchors("t").alias("a")).first()["a"]
        assert rows[i]["edited_anchors"] == want
        own, new = {a["hash"] for a in whole[i]}, {a["hash"] for a in want}
        assert rows[i]["near_edited"] == len(own & new) / len(own | new)
    places = [{a["hash"]: a["pos"] for a in rows[i]["anchors"]} for i in (0, 1)]
    assert {places[0][h] - places[1][h] for h in one & two} == {1000}


def test_likeness_follows_from_the_fingerprints(spark):
    """The two columns alone give ``near_edited`` and, with the next row's, ``near_next``; places are kept."""
    found = QUERIES["op1_document_fingerprints"](spark, SF)
    assert found.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])

    def hashes(text):
        return {a.split(":")[1] for a in text.split()}

    def share(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for at, r in enumerate(rows):
        own, after = hashes(r["fingerprint"]), hashes(rows[(at + 1) % len(rows)]["fingerprint"])
        assert r["near_edited"] == share(own, hashes(r["edited_fingerprint"])) and r["near_next"] == share(own, after)
        places = [int(a.split(":")[0]) for a in r["fingerprint"].split()]
        assert places == sorted(set(places))


def test_fingerprints_of_null_and_equal_ids(spark):
    docs = documents(spark, [(None, prose(1), "a"), (None, None, "a"), (3, prose(2), "a"), (3, prose(3), "a"), (3, prose(3), "a")])
    rows = fingerprints.fingerprint_edits(docs).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in rows) == sorted(
        [(True, len(prose(1))), (True, 0), (False, len(prose(2))), (False, len(prose(3))), (False, len(prose(3)))]
    )
    assert len({r["fingerprint"] for r in rows if r["n_chars"] == len(prose(3))}) <= 2


# ---------------------------------------------------------------------------------- quality
def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op2_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    area = np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad])
    assert area > 0.995 and (good >= 0.3).mean() > 0.995 and (bad < 0.3).mean() > 0.9
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_quality_of_awkward_rows(spark):
    rows = [(i, "good words of prose " * 20 + prose(i), "a") for i in range(100, 160)] + [(i, "$$$ ### !!! " * 40 + str(i), "a") for i in range(160, 220)]
    docs = documents(spark, AWKWARD + rows, "score h x")
    labels = spark.createDataFrame([(i, int(i < 160), None) for i in range(100, 220)] + [(5, None, None), (3, 1, 0), (10_000, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, id_remainder(5) != 0)
    out = {r["doc_id"]: r["score"] for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert len(out) == len(AWKWARD) + len(rows)
    assert out[2] == out[3] and out[0] == out[1] and all(0 <= s <= 1 for s in out.values())
    assert min(out[i] for i in range(100, 160)) > max(out[i] for i in range(160, 220))
    assert quality.score(documents(spark, EMPTY), model, ["doc_id"]).count() == 0
    nothing = quality.fit(docs, labels.where("false"), id_remainder(5) != 0)
    assert {r["score"] for r in quality.score(docs, nothing, ["doc_id"]).collect()} == {0.5}


# ----------------------------------------------------------------------------------- mixing
def test_targets_stop_at_the_cap():
    targets = mixing.share_out([10, 1000, 500, 0], [5, 2, 1, 5], 3)
    assert targets[0] == 30 and targets[3] == 0 and sum(targets) == pytest.approx(1510)
    assert targets[1] == pytest.approx(2 * targets[2]) and mixing.share_out([], [], 3) == []


def test_mix_takes_each_target_in_gapless_rounds(spark):
    docs = documents(spark, AWKWARD + [(i, prose(i), "z") for i in range(20, 60)]).select("doc_id", "source", mixing.word_count("text").alias("size"))
    pieces, sources = mixing.mix(docs, block=64, least_slots=64)
    rows, sizes = pieces.collect(), {r["doc_id"]: r["size"] for r in docs.collect()}
    assert sizes[5] == 30_000 and sizes[2] == sizes[3] == sizes[4] == 0
    taken = Counter()
    for r in rows:
        taken[r["source_no"]] += r["length"]
        assert r["length"] > 0 and r["start"] + r["length"] <= sizes[r["doc_id"]]
    for s in sources:
        assert abs(taken[s["source_no"]] - s["target"]) <= 1
    spans = defaultdict(list)
    for r in rows:
        spans[r["doc_id"], r["epoch"]].append((r["start"], r["length"]))
    for runs in spans.values():
        runs.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(runs, runs[1:]))
    assert {e for _, e in spans} <= {0, 1, 2}
    again, _ = mixing.mix(docs.repartition(5), block=64, least_slots=64)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_schedule_spreads_every_source(spark):
    slots = sorted((r["slot"], r["source_no"], r["rank"]) for r in mixing.schedule(spark, 3000, [5, 2, 1]).collect())
    seen = Counter()
    for slot, source, rank in slots:
        assert rank == seen[source]
        seen[source] += 1
        if slot > 50:
            assert abs(seen[0] - (slot + 1) * 5 / 8) < 6
    assert mixing.points(1 << 40, 3)[0] != mixing.points((1 << 40) + 1, 3)[0]


def test_mix_of_nothing(spark):
    for rows in (EMPTY, [(1, None, "a"), (2, "", None)]):
        pieces, _ = mixing.mix(documents(spark, rows).select("doc_id", "source", mixing.word_count("text").alias("size")))
        assert pieces.count() == 0
    assert QUERIES["op3_mixing_sources"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# ---------------------------------------------------------------------------------- packing
def test_pieces_have_the_ids_of_the_tokenizers_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [(i, t, s) for i, t, s in AWKWARD] + [(50, "a<|endoftext|> b  \n\n  c\t'll 123 ,,, 🙂é x" * 9, "a"), (51, "x" * 5000, "a")]
    found = defaultdict(list)
    for r in packing.pack_documents(documents(spark, texts, "length start sequence_id")).collect():
        found[r["doc_id"]].append(r)
    for i, t, _ in texts:
        ids = np.asarray([*known.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(found[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)


def test_sequences_are_gapless_and_full(spark):
    rows = QUERIES["op7_packing"](spark, "/root/testdata/sf0.01").collect()
    lines = defaultdict(list)
    for r in rows:
        lines[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in lines.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
        assert sum(n for _, n in pieces) <= packing.CAPACITY
    padded = len(lines) * packing.CAPACITY - sum(r["length"] for r in rows)
    assert padded < 0.01 * len(lines) * packing.CAPACITY
    assert packing.pack_documents(documents(spark, EMPTY)).count() == 0


def test_rows_of_one_id_or_none_and_equal_rows_are_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 16)
    texts = [(None, f"row number {i}", "a") for i in range(60)] + [(7, f"other {i}", "a") for i in range(60)]
    texts += [(None, "the same row", "a")] * 700 + [(None, None, "a")] * 300
    rows = packing.pack_documents(documents(spark, texts), group_rows=32).collect()
    assert len(rows) == len(texts)
    groups = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(groups) > 20 and max(groups.values()) < 160
    assert Counter(r["ids_crc32"] for r in rows).most_common(2)[0][1] == 700
    for kind in (lambda r: r["doc_id"] == 7, lambda r: r["doc_id"] is None and r["length"] > 1):
        assert len({r["sequence_id"] >> 32 for r in rows if kind(r)}) > 10
    lines = defaultdict(list)
    for r in rows:
        lines[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in lines.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
    again = packing.pack_documents(documents(spark, texts).repartition(3), group_rows=32).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_minimum_bin_slack_against_all_subsets():
    from itertools import combinations

    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 40, 9).tolist()
        first, times = packing.fill(Counter(lengths), 64)[0]
        assert times >= 1 and max(lengths) in first
        rest = list(lengths)
        rest.remove(max(lengths))
        best = max(sum(c) for n in range(len(rest) + 1) for c in combinations(rest, n) if sum(c) + max(lengths) <= 64)
        assert sum(first) == best + max(lengths)
        used = Counter()
        for pattern, n in packing.fill(Counter(lengths), 64):
            for x in pattern:
                used[x] += n
        assert used == Counter(lengths)


# --------------------------------------------------------------------------------- sharding
@pytest.mark.parametrize("pieces", [1, 3, 100])
def test_shards_are_contiguous_and_balanced(spark, pieces):
    docs = documents(spark, AWKWARD + [(i, prose(i, i), "z") for i in range(20, 200)] + [(None, "x", "q"), (9, prose(2), "q")], "slot_x shard_x")
    rows = docs.select("doc_id", sharding.byte_size("text").alias("size"))
    got = sharding.shard_by_bytes(rows, "size", 8, pieces=pieces).collect()
    assert len(got) == docs.count()
    order = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"]))
    total, largest, before, last = sum(r["size"] for r in got), max(r["size"] for r in got), 0, 0
    shards = defaultdict(list)
    for r in order:
        assert r["shard"] == min(7, (2 * before + r["size"]) * 8 // (2 * total)) and r["shard"] >= last
        before, last = before + r["size"], r["shard"]
        shards[r["shard"]].append(r)
    for rows_ in shards.values():
        assert sorted(r["slot"] for r in rows_) == list(range(len(rows_)))
    assert all(abs(sum(r["size"] for r in v) - total / 8) <= largest for v in shards.values())


def test_shards_of_nothing_and_of_the_whole_table(spark):
    empty = documents(spark, EMPTY).select("doc_id", sharding.byte_size("text").alias("size"))
    assert sharding.shard_by_bytes(empty, "size", 8).count() == 0
    got = QUERIES["op8_sharding"](spark, SF).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got.itertuples():
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert got["size"].tolist() == [len(texts[i].encode()) + 1 for i in got.doc_id]
    assert len(got) == len(texts) and set(got.law) == {"bytes"}


def test_scores_follow_from_sizes_worked_out_independently(spark):
    """Sizes from the library's one-shot calls, the curve from its weights, for texts of the given table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), id_remainder(5) != 0)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r["q"] for r in quality.score(docs.withColumn("score", F.lit(1)), model, ["doc_id", "score"], "q").collect()}
    assert len(got) == len(texts)
    for i in sorted(texts)[:40]:
        data, chances = texts[i].encode(), []
        for pair in model.dictionaries:
            sizes = []
            for content in pair:
                known = zstandard.ZstdCompressionDict(content)
                made = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
                parts = [made.compress(data[k : k + 512]) for k in range(0, len(data), 512)]
                plain = zstandard.ZstdDecompressor(dict_data=known)
                assert b"".join(plain.decompress(p, max_output_size=512) for p in parts) == data
                sizes.append(sum(map(len, parts)) / max(len(data), 1))
            z = [sizes[0] - sizes[1], sizes[1], math.log(max(len(data), 1))]
            z = [min(max((v - m) / s, -quality.LIMIT), quality.LIMIT) for v, m, s in zip(z, model.mean, model.spread)]
            total = sum(w * v for w, v in zip(model.weights, [1, *z, z[0] * z[2]]))
            chances.append(1 / (1 + math.exp(-total)))
        assert got[i] == pytest.approx(sum(chances) / 2, abs=1e-12)


def test_samples_hold_whole_texts_within_their_bytes(spark):
    rows = [{"size": n, "i": i} for i, n in enumerate([5, 90, 20, 80, 1, 3])]
    assert [r["i"] for r in quality.within(rows, 100, 9)] == [0, 1, 4, 5]
    assert [r["i"] for r in quality.within(rows, 10**9, 2)] == [0, 1]
    # A chosen id with very many rows brings no more than the bound along.
    docs = documents(spark, [(i, "good words of prose " * 9 + prose(i), "a") for i in range(60)] + [(i, "$$$ ### " * 40 + str(i), "a") for i in range(60, 120)])
    more = docs.union(documents(spark, [(1, f"good words {k} " * 9, "a") for k in range(3000)]))
    labels = spark.createDataFrame([(i, int(i < 60), None) for i in range(120)], "doc_id long, quality int, toxic int")
    model = quality.fit(more, labels, F.lit(True), dictionary_rows=30, sample_bytes=20_000, calibration_rows=50)
    out = {r["doc_id"]: r["score"] for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert min(out[i] for i in range(60)) > max(out[i] for i in range(60, 120))
