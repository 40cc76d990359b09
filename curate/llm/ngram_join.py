"""Jaccard join on word n-grams by MinHash banding, with exact verification.

Texts with the same words form a class, which one of them stands for. Each stand-in has a MinHash
signature, cut into bands; documents that share the hash of a band are candidates. Links between
candidates are contracted to groups, a group's texts meet in tasks of bounded size (a large group
is cut into blocks, and every two blocks meet in a task of their own), and there each pair that
shares a band is verified on its full n-gram sets. Tasks report a number of links and one link to
a representative for each document, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.common import coded, mixed, text_of, words
from curate.llm.graph import components
from curate.session import stored

N = 5
THRESHOLD = 0.8
RECALL = 0.999
BAND_ROWS = 5
CHUNK_BYTES = 1 << 20
BLOCK_DOCS = 512
BLOCK_BYTES = 8 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float, recall: float, rows: int = BAND_ROWS) -> int:
    """How many bands of so many rows find a pair at the threshold with the wanted probability."""
    return max(1, ceil(log(1 - recall) / log(1 - threshold**rows)))


def shingles(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """(hash of each n-gram, index of its text in ascending order, digest of each text's words).

    A text of fewer than ``n`` words has one n-gram, all of it; one without words has none, and no digest.
    """
    flat, owner = words(texts)
    code, hashed = coded(flat)
    token = mixed(hashed)[code] if len(code) else np.zeros(0, np.uint64)
    count = np.bincount(owner, minlength=len(texts))
    end = np.cumsum(count)
    raw = token.tobytes()
    digests = [xxhash.xxh3_128_digest(raw[8 * (e - c) : 8 * e]) if c else None for e, c in zip(end.tolist(), count.tolist())]
    if len(token) >= n:
        run = token[: len(token) - n + 1].copy()
        for j in range(1, n):
            run = run * STEP + token[j : len(token) - n + 1 + j]
        inside = owner[: len(run)] == owner[n - 1 :]
        value, of = mixed(run[inside]), owner[: len(run)][inside]
    else:
        value, of = np.zeros(0, np.uint64), np.zeros(0, owner.dtype)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.asarray([xxhash.xxh64_intdigest(digests[i]) for i in short], np.uint64)
        value, of = np.concatenate([value, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        value, of = value[order], of[order]
    return value, of, digests


def band_hashes(value: np.ndarray, of: np.ndarray, bands: int, rows: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have n-grams, a row of band hashes for each)."""
    present, start = np.unique(of, return_index=True)
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    out = np.empty((bands, len(present)), np.uint64)
    for b in range(bands):
        key = np.full(len(present), b, np.uint64)
        for f, s in zip(factors[b * rows : (b + 1) * rows], shifts[b * rows : (b + 1) * rows]):
            key = mixed(key * STEP + np.minimum.reduceat(value * f + s, start)) if len(present) else key
        out[b] = key
    return present, out.T


def parts_of(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of some megabytes of text, so that a task's arrays stay small."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes.astype(np.int64))
    edges = np.flatnonzero(np.diff(total // CHUNK_BYTES, prepend=0)).tolist()
    for a, b in zip([0, *edges], [*edges, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, digest, size, bands) of every whole text; ``key`` is a hash of the text as it is."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, "text"):
                value, of, digests = shingles(part["text"], n)
                present, found = band_hashes(value, of, bands, rows)
                lists: list = [None] * part.num_rows
                for i, row in zip(present.tolist(), found.view(np.int64) if len(found) else []):
                    lists[i] = row
                sizes = pc.fill_null(pc.binary_length(part["text"]), 0)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["key"], pa.array(digests, pa.binary()), sizes.cast(pa.int64()), pa.array(lists, schema.field("bands").type)], schema=schema)

    return keyed_texts(docs).mapInArrow(sign, "doc_id long, key long, digest binary, size long, bands array<long>")


def keyed_texts(docs: DataFrame) -> DataFrame:
    text = text_of(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _overlap(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the common part of the sets (each sorted, distinct) of each pair."""
    used = np.unique(np.concatenate([left, right]))
    sizes = np.asarray([len(sets[i]) for i in used])
    value, place = np.concatenate([sets[i] for i in used]), np.repeat(np.arange(len(used)), sizes)
    _, column, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    names, column = np.unique(column[shared], return_inverse=True)
    place = place[shared]
    if len(left) * sizes.mean() < 2e-3 * len(used) ** 2 * max(len(names), 1):
        return np.asarray([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)])
    # Many pairs of few texts: multiply the incidence matrix with itself, some columns at a time.
    product, order = np.zeros((len(used), len(used)), np.float32), np.argsort(column, kind="stable")
    column, place = column[order], place[order]
    for first in range(0, len(names), 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        dense = np.zeros((len(used), 4096), np.float32)
        dense[place[a:b], column[a:b] - first] = 1
        product += dense @ dense.T
    at = {i: k for k, i in enumerate(used.tolist())}
    rows, columns = (np.asarray([at[i] for i in side.tolist()]) for side in (left, right))
    return product[rows, columns].astype(np.int64)


def _verify(n: int, threshold: float):
    def verify(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("class")
        ids, block, copies = (table[c].to_numpy() for c in ("class", "block", "copies"))
        value, of, _ = shingles(table["text"].combine_chunks(), n)
        edges = np.searchsorted(of, np.arange(len(ids) + 1))
        sets = [np.unique(value[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        size = np.asarray([len(s) for s in sets])
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        low, high = int(key[1].as_py()), int(key[2].as_py())
        alone = low == high
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        one, two = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(block == low), np.flatnonzero(block == high))
        pairs = []
        for at in range(0, len(one), 128):
            rows = one[at : at + 128]
            meet = np.zeros((len(rows), len(two)), bool)
            for b in range(bands.shape[1]):
                meet |= bands[rows, b][:, None] == bands[two, b][None, :]
            short, long_ = np.minimum(size[rows][:, None], size[two][None, :]), np.maximum(size[rows][:, None], size[two][None, :])
            meet &= short >= threshold * long_
            if alone:
                meet &= rows[:, None] < two[None, :]
            x, y = np.nonzero(meet)
            pairs.append(np.stack([rows[x], two[y]]))
        left, right = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), int)
        if len(left):
            common = _overlap(sets, left, right)
            linked = common >= threshold * (size[left] + size[right] - common) - 1e-9
            left, right = left[linked], right[linked]
            np.add.at(links, left, copies[right])
            np.add.at(links, right, copies[left])
            root = smallest(root, left, right)
        kept = np.flatnonzero(links)
        return pa.table({"class": ids[kept], "links": links[kept], "root": ids[root[kept]]})

    return verify


def smallest(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index each index is linked with, directly or not."""
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(
    docs: DataFrame,
    n: int = N,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    band_rows: int = BAND_ROWS,
    block_docs: int = BLOCK_DOCS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links, component_id) for each row of (doc_id, text).

    Two texts are linked if the Jaccard similarity of their sets of ``n``-word runs is ``threshold`` or
    more; a pair at the threshold is found with probability ``recall``, a closer one more surely.
    ``class_id`` is the smallest id with the same words, ``n_copies`` how many rows have them, ``n_links``
    counts the other rows linked directly, copies included, and ``component_id`` is the smallest id of
    the rows that links lead to. Letters A-Z count as small ones and any white space as one blank. A text
    without words, NULL too, links with nothing. Every row is a document of its own, repeated ones and
    those with equal ids too; a NULL id gets no links and is none. An empty table gives no rows.
    """
    bands = banding(threshold, recall, band_rows)
    signed = stored(signatures(docs, n, bands, band_rows), "signatures")
    filled = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = filled.groupBy("digest").agg(F.min(F.struct("doc_id", "key", "bands", "size")).alias("m"), F.count("*").alias("copies"))
    # Classes have numbers: ids may repeat, and then two texts may have the same smallest one.
    classes = stored(classes.select(F.monotonically_increasing_id().alias("class"), "digest", "m.*", "copies"), "classes")
    banded = classes.select("class", F.posexplode("bands").alias("band", "hash"))
    full = banded.groupBy("band", "hash").agg(F.min("class").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = banded.join(full, ["band", "hash"]).select(F.col("class").alias("a"), F.col("first").alias("b"))
    groups = components(near)

    members = groups.join(classes, groups["id"] == classes["class"]).select("component", "class", "doc_id", "key", "bands", "copies", "size")
    sizes = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("size") / block_bytes)).alias("blocks")
    )
    members = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    # Repeated rows are reduced to one before the shuffle.
    texts = keyed_texts(docs).dropDuplicates(["doc_id", "key"])
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    sent = members.drop("size").join(texts, ["doc_id", "key"]).withColumn("other", other)
    sent = sent.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "class", "block", "copies", "bands", "text")
    checked = sent.groupBy("component", "low", "high").applyInArrow(_verify(n, threshold), "class long, links long, root long")
    checked = stored(checked, "links")
    linked = checked.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(checked.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "class")
    known = classes.select("class", "digest", F.col("doc_id").alias("class_id"), "copies").join(linked, "class", "left").join(joined, "class", "left")
    known = stored(known.withColumn("component", F.coalesce("component", "class")), "components")
    least = known.groupBy("component").agg(F.min("class_id").alias("component_id"))
    rows = signed.select("doc_id", "digest").join(known.join(least, "component"), "digest", "left")
    alone = F.col("class_id").isNull() | F.col("doc_id").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 1).otherwise(F.col("copies")).cast("bigint").alias("n_copies"),
        F.when(alone, 0).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
