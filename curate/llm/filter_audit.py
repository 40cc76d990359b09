"""How filters interact: every order of them, from one mask a document, duplicates found in radix tries.

Equal texts are found without hashing them into classes. A sample of the texts gives adaptive
prefixes, each just long enough to tell its neighbours apart, that cut the order of all texts into
ranges of like weight. Every range's whole texts go into a compressed trie, whose terminals hold the
smallest id seen; walking the trie gives one row for each distinct text, and a document that is not
that row is a duplicate. The filters a document fails are then one mask of bits, and what each order
of the filters removes follows from the counts of the masks alone.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import ceil

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.llm.common import SPACE, let, text_of
from curate.session import stored

RANGE_BYTES = 16 << 20
"""Weight of a range's texts, each with ``ROW_BYTES`` for its nodes: what a trie's task holds."""
ROW_BYTES = 512
MAX_RANGES = 4096
PER_RANGE = 16
PREFIX_BYTES = 512
"""The sample has about ``PER_RANGE`` prefixes of so many bytes a range, and there are at most
``MAX_RANGES``, so the driver gets 32 MB at most. Texts are compared whole; heavier ranges are cut again by hash."""
FLUSH_BYTES = 32 << 20


def failures(text: Column) -> dict[str, Column]:
    """The conditions A to D of a text: short, repetitive, loud, odd."""
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    both = let(words, lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))
    return {
        "A": both["all"] < 100,
        "B": both["distinct"] * 100 < both["all"] * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


# -------------------------------------------------------------------------------------- the trie
class Trie:
    """A compressed trie of byte strings. A node is [label, children by first byte or None, least id or None]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def insert(self, text: bytes, number: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(text):
                node[2] = number if node[2] is None else min(node[2], number)
                return
            if node[1] is None:
                node[1] = {}
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], None, number]
                return
            label = child[0]
            if not text.startswith(label, at):
                same = _common(label, text, at)
                upper = [label[:same], {label[same]: child}, None]
                child[0] = label[same:]
                node[1][text[at]] = child = upper
            at += len(child[0])
            node = child

    def terminals(self) -> Iterator[tuple[bytes, int]]:
        """Every distinct text with its smallest id."""
        waiting = [(b"", self.root)]
        while waiting:
            before, (label, children, number) = waiting.pop()
            whole = before + label
            if number is not None:
                yield whole, number
            if children:
                waiting += [(whole, c) for c in children.values()]


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common beginning of ``label`` and ``text[at:]``, which differ somewhere."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


# ------------------------------------------------------------------------------------ the ranges
def separator(left: bytes, right: bytes) -> bytes:
    """The shortest beginning of ``right`` that is greater than ``left``, which is smaller than ``right``."""
    n = next((i for i, (a, b) in enumerate(zip(left, right)) if a != b), min(len(left), len(right)))
    return right[: n + 1]


def cut_ranges(sample: list[tuple[bytes, int]], ranges: int) -> tuple[list[bytes], list[float]]:
    """(prefixes that cut the order of texts, share of the weight in each range) of (prefix, weight) rows.

    A prefix heavier than a range gets one of its own, so that what is beside it stays light.
    """
    weight: dict[bytes, int] = {}
    for prefix, times in sample:
        weight[prefix] = weight.get(prefix, 0) + times
    names = sorted(weight)
    total, done, last, at = sum(weight.values()), 0, 0, [0]
    for i, name in enumerate(names):
        heavy = weight[name] * ranges >= total
        if i and (heavy or (done - last) * ranges >= total) and at[-1] != i:
            at.append(i)
            last = done
        done += weight[name]
        if heavy and i + 1 < len(names):
            at.append(i + 1)
            last = done
    cuts = [separator(names[i - 1], names[i]) for i in at[1:]]
    shares = [sum(weight[n] for n in names[a:b]) / total for a, b in zip(at, [*at[1:], len(names)])]
    return cuts, shares


def distinct_texts(docs: DataFrame, range_bytes: int = RANGE_BYTES, max_ranges: int = MAX_RANGES) -> DataFrame:
    """(digest BINARY, doc_id): the MD5 of every distinct whole text, with its smallest id.

    ``docs`` has (doc_id, text); NULL is the empty text, and rows with a NULL id take no part. Copies
    are merged before the shuffle, so a text that makes up a third of the table is sent once by a task.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(F.col("text").cast("string")).cast("binary").alias("text"))
    rows = rows.where("doc_id IS NOT NULL")
    weight = F.octet_length("text") + ROW_BYTES
    total = rows.agg(F.sum(weight)).first()[0] or 0
    ranges = min(max_ranges, ceil(total / range_bytes))
    cuts, slots, first = [], [1], [0]
    if ranges > 1:
        chance = F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id", "text"), 11) * F.lit(2.0**-53)
        times = F.floor(weight * F.lit(PER_RANGE * ranges / total) + chance)
        sample = rows.select(F.substring("text", 1, PREFIX_BYTES).alias("p"), times.alias("times")).where("times > 0").collect()
        cuts, shares = cut_ranges([(bytes(r["p"]), r["times"]) for r in sample], ranges) if sample else ([], [1.0])
        slots = [ceil(s * total / range_bytes) if s * total > 2 * range_bytes else 1 for s in shares]
        first = [sum(slots[:i]) for i in range(len(slots))]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            texts = sorted(found)
            for at in range(0, len(texts), 1024):
                some = texts[at : at + 1024]
                where = [bisect_right(cuts, t) for t in some]
                place = [first[w] + (xxhash.xxh3_64_intdigest(t) % slots[w] if slots[w] > 1 else 0) for w, t in zip(where, some)]
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(some, pa.binary()), pa.array([found[t] for t in some], pa.int64())], ["place", "text", "doc_id"])

        for batch in batches:
            for number, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                known = found.get(text)
                if known is None:
                    size += len(text) + ROW_BYTES
                    found[text] = number
                elif number < known:
                    found[text] = number
                if size >= FLUSH_BYTES:
                    yield from out()
                    found, size = {}, 0
        yield from out()

    def insert(key: tuple, table: pa.Table) -> pa.Table:
        trie = Trie()
        for part in table.to_batches(max_chunksize=4096):
            for text, number in zip(part["text"].to_pylist(), part["doc_id"].to_pylist()):
                trie.insert(text, number)
        found = [(hashlib.md5(text, usedforsecurity=False).digest(), number) for text, number in trie.terminals()]
        digests, numbers = zip(*found)
        return pa.table({"digest": pa.array(digests, pa.binary()), "doc_id": pa.array(numbers, pa.int64())})

    merged = rows.mapInArrow(merge, "place int, text binary, doc_id long")
    # A partition for each range, so that a task's share does not grow with the table.
    return merged.repartition(sum(slots), "place").groupBy("place").applyInArrow(insert, "digest binary, doc_id long")


# ------------------------------------------------------------------------------------- the audit
def flagged(docs: DataFrame, part: str = "lang", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, part, mask, duplicate): a row for each row of (doc_id, text, ``part``).

    Bit i of ``mask`` is the i-th condition of ``failures``. A row is a duplicate if a smaller id has an
    identical text, NULL as the empty one. A NULL id is neither smaller nor larger than any; rows that
    repeat the smallest id are no duplicates. A NULL part is the empty string.
    """
    text = text_of(F.col("text").cast("string"))
    conditions = failures(F.col("text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(F.col(part).cast("string")).alias("part"), text.alias("text"))
    slim = stored(rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")), "masks")
    firsts = distinct_texts(docs, range_bytes).select(F.col("digest").alias("__digest"), F.col("doc_id").alias("__first"))
    met = slim.join(firsts, (F.col("digest") == F.col("__digest")) & (F.col("doc_id") == F.col("__first")), "left")
    return met.select("doc_id", "part", "mask", (F.col("doc_id").isNotNull() & F.col("__first").isNull()).alias("duplicate"))


def orders(letters: Sequence[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the filters before it) for every order of the filters."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    return [
        ("".join(p), k + 1, bit[c], sum(bit[x] for x in p[:k]))
        for p in permutations(letters)
        for k, c in enumerate(p)
    ]


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    The filters are ``failures`` and E, duplicates; each of the 120 orders is applied from left to right to
    each part. ``labels`` has (doc_id, quality, toxic); a document counts as good or toxic if any label row
    of its id says 1, and a NULL id has no label. Documents are counted as often as their rows occur. An empty table has no part and
    gives no rows; columns other than the named ones are not read.
    """
    rows = flagged(docs, part, range_bytes)
    said = labels.groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    letters = "ABCDE"
    whole = (F.col("mask") + F.when(F.col("duplicate"), 1 << 4).otherwise(0)).alias("mask")
    marked = rows.join(said, F.col("doc_id") == F.col("__id"), "left")
    # At most 32 * 4 rows a part from here on.
    counts = marked.groupBy("part", whole).agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    steps = [dict(zip(("filter_order", "step", "bit", "earlier"), row)) for row in orders(letters)]
    wide = counts.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, earlier int>>")))
    failed, passed = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) == 0
    found = wide.groupBy("part", "filter_order", "step", "bit").agg(
        *[
            F.sum(F.when(condition, F.col(column)).otherwise(0)).cast("bigint").alias(name)
            for name, condition, column in (
                ("kept", passed & ~failed, "n"),
                ("removed", passed & failed, "n"),
                ("redundant", ~passed & failed, "n"),
                ("unique_fails", F.col("mask") == F.col("bit"), "n"),
                ("good_lost", passed & failed, "good"),
                ("toxic_lost", passed & failed, "toxic"),
            )
        ]
    )
    # One row for each part and filter.
    shapley = found.groupBy(F.col("part").alias("__part"), F.col("bit").alias("__bit")).agg(F.sum("removed").alias("shapley"))
    return found.join(shapley, (F.col("part") == F.col("__part")) & (F.col("bit") == F.col("__bit"))).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
