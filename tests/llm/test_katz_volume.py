"""What the Katz model sends and keeps: runs that one batch holds are not asked, hashes go once the words are counted."""

from __future__ import annotations

import zlib

import pytest

from curate import session
from curate.llm import katz
from curate.llm.queries import id_remainder
from helpers import documents
from test_texts import brute_katz


def scored(spark, rows, batch=1500, part=600):
    """Scores, checked against counting; and how many runs each level's table was asked for."""
    kept, before = session._STORED.setdefault(spark.sparkContext.applicationId, []), 0
    before = len(kept)
    got = {r["doc_id"]: r["score"] for r in katz.katz_scores(documents(spark, [(i, t, "s") for i, t in rows]).repartition(2), id_remainder(7) != 2, batch, part).collect()}
    want = brute_katz(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    assert got == {i: pytest.approx(w[4], abs=1e-6) for i, w in want.items()}
    paths = kept[before:]
    asked = [sum(len(katz.unpacked(katz._two(r["a"])[0])) for r in spark.read.parquet(p).where("kind = 0").collect()) for p in paths if "/runs-" in p]
    return asked, next(p for p in paths if "/batches-" in p)


def test_runs_of_one_batch_are_not_asked(spark):
    # Every text has words of its own: after its first word, no other batch knows of any run.
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(200))) for i in range(20)]
    pairs, triples = scored(spark, rows)[0]
    assert pairs <= 2 * len(rows) and triples <= 2 * len(rows)  # 2,613 pairs before


def test_runs_that_end_in_a_word_of_one_batch_count_for_their_history(spark):
    # Shared words, now and then followed by one that occurs once, in training or not, and seen again in held-out texts.
    rows = [(i, " ".join(f"s{j * i % 7} s{j % 3} t{i}x{j}" if j % 4 else f"s{j % 5} s{j * i % 11}" for j in range(40))) for i in range(60)]
    rows += [(100 + i, f"{rows[i][1]} s1 s2 s0") for i in range(0, 60, 9)]
    scored(spark, rows)
    scored(spark, rows, 1 << 20, 1 << 20)  # one batch knows all


def test_hashes_of_words_are_not_kept(spark):
    path = scored(spark, [(i, f"a b{i % 3} c{i}") for i in range(9)])[1]
    assert spark.read.parquet(path).where("hashes IS NOT NULL").count() == 0
