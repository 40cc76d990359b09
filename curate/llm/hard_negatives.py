"""Hard negatives from Hilbert-ordered blocks of vectors with zone maps.

Vectors of integers are sorted along a Hilbert curve and written as Parquet blocks, one row each, next
to the least and greatest value of every dimension. For an anchor, interval arithmetic on a block's
zone map bounds the scores in it: ``a+ . high + a- . low`` from above, ``a+ . low + a- . high`` from below.
Anchors travel in batches; zone maps decide which blocks a batch has to meet, first for its best
positives (a block's bound must reach the anchor's best rows in its own block), then for the windows
below each positive's score (a block's interval must meet a window). All scores are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.llm.common import pieces_for
from curate.session import stored

BLOCK_ROWS = 1024
BATCH_ROWS = 2048
"""Anchors that travel together, and zone maps that are looked at together."""
SLICE_BLOCKS = 32
"""Blocks that a task holds at once."""
HILBERT_BITS = 4
EXACT = 2.0**53
"""Vectors with a sum of squares below this have inner products that double precision adds up exactly."""
CHUNK = 128


# --------------------------------------------------------------------------------- Hilbert order
def hilbert_keys(points: np.ndarray, bits: int) -> list[bytes]:
    """Place of each point (a row of integers below 2**bits) on the Hilbert curve, as a key that sorts by it."""
    x = np.ascontiguousarray(points.T).astype(np.uint32)
    n = len(x)
    if not n:
        return [b""] * points.shape[0]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1)).astype(np.uint32)
            x[0] ^= np.where(up, q - 1, swap).astype(np.uint32)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.uint32), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0).astype(np.uint32)
        q >>= 1
    x ^= turn
    planes = np.concatenate([(x >> k) & 1 for k in range(bits - 1, -1, -1)]).astype(np.uint8)
    return [row.tobytes() for row in np.packbits(planes.T, axis=1)]


# ------------------------------------------------------------------------------------- the blocks
def quantised(vectors: DataFrame, anchor: Column, key: str, label: str, vec: str, scale: int) -> DataFrame:
    """(id, label, anchor, dim, data, low, high) of the rows that take part: floor(scale * x) as packed integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["v"]
            flat = lists.flatten()
            edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            valid = flat.is_valid().to_numpy(zero_copy_only=False)
            x = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~(valid & np.isfinite(x)))])
            kept = np.flatnonzero(bad[edges[1:]] == bad[edges[:-1]])
            data, low, high = [], [], []
            for i in kept:
                q = np.floor(scale * x[edges[i] : edges[i + 1]])
                if q @ q >= EXACT:
                    raise ValueError("a vector is too long for exact integer scores")
                data.append(q.astype("<i4").tobytes())
                low.append(int(q.min()) if len(q) else 0)
                high.append(int(q.max()) if len(q) else 0)
            part = batch.select(["id", "label", "anchor"]).take(pa.array(kept))
            sizes = np.diff(edges)[kept]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(sizes, pa.int32()), pa.array(data, pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                ["id", "label", "anchor", "dim", "data", "low", "high"],
            )

    rows = vectors.select(
        F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vec).cast("array<double>").alias("v"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(pack, "id long, label long, anchor boolean, dim int, data binary, low long, high long").distinct()


BLOCK = "block long, dim int, n int, ids binary, labels binary, anchors binary, data binary, low binary, high binary"


def hilbert_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """The rows in blocks along the curve, each of one dimension, with its zone map. Stored as Parquet."""
    found = rows.agg(F.min("low"), F.max("high"), F.count("*")).first()
    least, span, n = found[0] or 0, (found[1] or 0) - (found[0] or 0) + 1, found[2]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                q = np.frombuffer(b"".join(part["data"].to_pylist()), "<i4").reshape(part.num_rows, dim).astype(np.int64)
                keys = hilbert_keys((q - least) * (1 << HILBERT_BITS) // span, HILBERT_BITS)
                yield pa.RecordBatch.from_arrays([part[c] for c in ("id", "label", "anchor", "dim", "data")] + [pa.array(keys, pa.binary())], ["id", "label", "anchor", "dim", "data", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in BLOCK.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 6
        base, number, waiting, dim = TaskContext.get().partitionId() << 32, 0, [], None

        def out() -> pa.RecordBatch:
            ids, labels, marks, data = zip(*waiting)
            q = np.frombuffer(b"".join(data), "<i4").reshape(len(ids), dim)
            row = (
                base + number, dim, len(ids), np.asarray(ids, "<i8").tobytes(), np.asarray(labels, "<i8").tobytes(), np.asarray(marks, "u1").tobytes(),
                q.tobytes(), q.min(axis=0).tobytes(), q.max(axis=0).tobytes(),
            )
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            for *row, size in zip(*(batch[c].to_pylist() for c in ("id", "label", "anchor", "data", "dim"))):
                if waiting and (size != dim or len(waiting) == block_rows):
                    yield out()
                    waiting, number = [], number + 1
                dim = size
                waiting.append(row)
        if waiting:
            yield out()

    placed = rows.mapInArrow(place, "id long, label long, anchor boolean, dim int, data binary, key binary")
    line = ["dim", "key", "id", "label", "data"]
    sorted_rows = placed.repartitionByRange(max(1, ceil(n / (block_rows * SLICE_BLOCKS))), *line).sortWithinPartitions(*line)
    return stored(sorted_rows.mapInArrow(cut, BLOCK), "blocks")


class Block:
    """A stored block's arrays."""

    def __init__(self, row: dict) -> None:
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.q = np.frombuffer(row["data"], "<i4").reshape(len(self.ids), row["dim"]).astype(float)


# ------------------------------------------------------------------------------------ the anchors
def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of the scores, ties by smaller id, best first."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def anchors_of(blocks: DataFrame, positives: int) -> DataFrame:
    """(block, dim, id, label, data, floor): the anchors, with the score that their last positive has or exceeds.

    That is the score of the ``positives``-th best row of its label in the anchor's own block; NULL if there are fewer.
    """
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    names = ["block", "dim", "id", "label", "data", "floor"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, out = Block(row), []
                marked = np.flatnonzero(np.frombuffer(row["anchors"], "u1"))
                for at in range(0, len(marked), CHUNK):
                    some = marked[at : at + CHUNK]
                    for i, scores in zip(some, own.q[some] @ own.q.T):
                        mine = np.sort(scores[(own.labels == own.labels[i]) & (own.ids != own.ids[i])])
                        floor = int(mine[-positives]) if len(mine) >= positives else None
                        out.append((row["block"], row["dim"], own.ids[i], own.labels[i], own.q[i].astype("<i4").tobytes(), floor))
                columns = list(zip(*out)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return blocks.mapInArrow(probe, "block long, dim int, id long, label long, data binary, floor long")


BATCH = "batch long, dim int, n int, ids binary, labels binary, data binary, low binary, high binary, known binary, tags binary, sums binary"
"""Anchors and, for ``known`` windows of each, the interval that a score has to meet, and the positive's id and score."""


def batches_of(anchors: DataFrame, rows: int, count: int, width: int) -> DataFrame:
    """Anchors (block, dim, id, label, data, windows ARRAY<STRUCT<low, high, tag, score>>) in batches along the curve."""
    names = [f.split()[0] for f in BATCH.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 8

    def gather(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, waiting, dim = TaskContext.get().partitionId() << 32, 0, [], None

        def out() -> pa.RecordBatch:
            ids, labels, data, windows = zip(*waiting)
            low, high = np.full((len(ids), width), np.inf), np.full((len(ids), width), -np.inf)
            tags, sums = np.zeros((len(ids), width), "<i8"), np.zeros((len(ids), width), "<i8")
            for i, some in enumerate(windows):
                for w, x in enumerate(some):
                    low[i, w], high[i, w], tags[i, w], sums[i, w] = x["low"], x["high"], x["tag"], x["score"]
            known = np.asarray([len(some) for some in windows], "u1")
            row = (
                base + number, dim, len(ids), np.asarray(ids, "<i8").tobytes(), np.asarray(labels, "<i8").tobytes(), b"".join(data),
                low.tobytes(), high.tobytes(), known.tobytes(), tags.tobytes(), sums.tobytes(),
            )
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in found:
            for *row, size in zip(*(batch[c].to_pylist() for c in ("id", "label", "data", "windows", "dim"))):
                if waiting and (size != dim or len(waiting) == rows):
                    yield out()
                    waiting, number = [], number + 1
                dim = size
                waiting.append(row)
        if waiting:
            yield out()

    line = ["dim", "block", "id", "label", "data"]
    placed = anchors.repartitionByRange(max(1, ceil(count / rows)), *line).sortWithinPartitions(*line)
    return stored(placed.mapInArrow(gather, BATCH), "anchors")


# -------------------------------------------------------------------------------------- zone maps
def zones_of(blocks: DataFrame, count: int) -> DataFrame:
    """The zone maps alone, some thousands to a row."""
    names, types = ["zone", "dim", "blocks", "low", "high"], [pa.int64(), pa.int32()] + [pa.binary()] * 3

    def gather(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in found:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                for at in range(0, len(mine), BATCH_ROWS):
                    part = batch.take(pa.array(mine[at : at + BATCH_ROWS]))
                    row = (base + number, int(dim), part["block"].to_numpy().astype("<i8").tobytes(), b"".join(part["low"].to_pylist()), b"".join(part["high"].to_pylist()))
                    number += 1
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    line = ["dim", "block"]
    slim = blocks.select("block", "dim", "low", "high").repartitionByRange(max(1, ceil(count / BATCH_ROWS)), *line).sortWithinPartitions(*line)
    return slim.mapInArrow(gather, "zone long, dim int, blocks binary, low binary, high binary")


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that each vector may have with what lies in each zone."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    far = np.maximum(np.abs(low), np.abs(high))
    slack = 1e-12 * np.outer(np.sqrt((q * q).sum(axis=1)), np.sqrt((far * far).sum(axis=1)))  # corners may be too far for exact sums
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def wanted(batches: DataFrame, zones: DataFrame) -> DataFrame:
    """(batch, slice, block, need): the blocks that a batch has to meet, and which of its anchors need them."""

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        dim, n = row["dim"], row["n"]
        q = np.frombuffer(row["data"], "<i4").reshape(n, dim).astype(float)
        names = np.frombuffer(row["blocks"], "<i8")
        low, high = (np.frombuffer(row[c], "<i4").reshape(len(names), dim).astype(float) for c in ("zlow", "zhigh"))
        floors, tops = (np.frombuffer(row[c], "<f8").reshape(n, -1) for c in ("low", "high"))
        need = np.zeros((n, len(names)), bool)
        for at in range(0, n, CHUNK):
            least, most = bounds(q[at : at + CHUNK], low, high)
            for floor, top in zip(floors[at : at + CHUNK].T, tops[at : at + CHUNK].T):
                need[at : at + CHUNK] |= (most >= floor[:, None]) & (least <= top[:, None])
        some = np.flatnonzero(need.any(axis=0))
        return pa.table({
            "batch": pa.array([row["batch"]] * len(some), pa.int64()),
            "slice": pa.array([f"{row['zone']}-{i // SLICE_BLOCKS}" for i in some], pa.string()),
            "block": pa.array(names[some], pa.int64()),
            "need": pa.array([np.packbits(need[:, i]).tobytes() for i in some], pa.binary()),
        })

    # Every batch meets every row of zone maps, on a key that spreads them over the tasks.
    salts = pieces_for(zones, 1)
    batches = batches.select("batch", "dim", "n", "data", "low", "high")
    left = zones.withColumn("salt", F.pmod(F.xxhash64("zone"), F.lit(salts)).cast("int"))
    left = left.withColumnsRenamed({"low": "zlow", "high": "zhigh"})
    right = batches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = left.join(right, ["dim", "salt"])
    return stored(met.groupBy("zone", "batch").applyInArrow(choose, "batch long, slice string, block long, need binary"), "wanted")


def searched(blocks: DataFrame, batches: DataFrame, pairs: DataFrame, choose: Callable) -> DataFrame:
    """(batch, place, block, anchor, label, dim, data, tag, sum, id, score): what ``choose`` finds in the wanted blocks.

    ``choose`` gets the scores, ids and labels' equality of some blocks' rows other than the anchor's own id,
    and the low end and the positive's score of one window; it returns places.
    """
    result = "batch long, place int, window int, anchor long, label long, dim int, data binary, tag long, sum long, id long, score long"
    names = [f.split()[0] for f in result.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()] + [pa.int64()] * 4

    def search(key: tuple, found: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        batch, rows = asked.to_pylist()[0], found.to_pylist()
        n, dim, number = batch["n"], batch["dim"], batch["batch"]
        q = np.frombuffer(batch["data"], "<i4").reshape(n, dim)
        ids, labels = np.frombuffer(batch["ids"], "<i8"), np.frombuffer(batch["labels"], "<i8")
        low = np.frombuffer(batch["low"], "<f8").reshape(n, -1)
        tags, sums = (np.frombuffer(batch[c], "<i8").reshape(n, -1) for c in ("tags", "sums"))
        known = np.frombuffer(batch["known"], "u1")
        need = np.zeros(n, bool)
        for r in rows:
            need |= np.unpackbits(np.frombuffer(r["need"], "u1"), count=n).astype(bool)
        parts = [Block(r) for r in rows]
        there, owners = np.concatenate([p.ids for p in parts]), np.concatenate([p.labels for p in parts])
        matrix, mine = np.concatenate([p.q for p in parts]), np.flatnonzero(need)
        for at in range(0, len(mine), CHUNK):
            some = mine[at : at + CHUNK]
            for i, scores in zip(some, (q[some].astype(float) @ matrix.T).astype(np.int64)):
                same, other = owners == labels[i], there != ids[i]
                for w in range(known[i]):
                    for j in choose(scores, there, same, other, low[i, w], sums[i, w]):
                        out.append((number, i, w, ids[i], labels[i], dim, q[i].tobytes(), tags[i, w], sums[i, w], there[j], scores[j]))
        columns = list(zip(*out)) or [[]] * len(types)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)

    left = pairs.join(blocks.select("block", "dim", "ids", "labels", "data"), "block")
    asking = pairs.select(F.col("batch").alias("__to"), F.col("slice").alias("__slice")).distinct()
    right = asking.join(batches, F.col("__to") == F.col("batch"))
    return left.groupBy("batch", "slice").cogroup(right.groupBy("__to", "__slice")).applyInArrow(search, result)


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vec: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, block_rows: int = BLOCK_ROWS, batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a score is the integer inner product. The ``positives`` best
    other rows of an anchor's label are its positives, ties by smaller id. For each of them come the
    ``negatives`` best rows of other labels with least * p <= 100 * score <= most * p, p the positive's score.

    Rows with a NULL id, label, vector or component, or a component that is not finite, take no part. Rows with
    equal id, label and vector are one row; other rows with equal ids are rows of their own, but no row
    is a positive or negative of its own id. Vectors of different length do not meet. Vectors whose squares
    add up to 2**53 or more fail the job. An empty table, or one without anchors, gives no rows.
    """
    blocks = hilbert_blocks(stored(quantised(vectors, anchor, key, label, vec, scale), "quantised"), block_rows)
    zones = stored(zones_of(blocks, blocks.count()), "zones")
    anchors = stored(anchors_of(blocks, positives), "probed")
    count = anchors.count()

    def nearest(scores, ids, same, other, low, positive):
        rows = np.flatnonzero(same & other & (scores >= low))
        return rows[best(scores[rows], ids[rows], positives)]

    floor = F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf")))
    none = F.lit(0).cast("bigint")
    window = F.struct(floor.alias("low"), F.lit(float("inf")).alias("high"), none.alias("tag"), none.alias("score"))
    asked = batches_of(anchors.withColumn("windows", F.array(window)), batch_rows, count, 1)
    found = searched(blocks, asked, wanted(asked, zones), nearest)
    line = F.col("score").desc(), F.col("id").asc()
    own = F.row_number().over(Window.partitionBy("batch", "place").orderBy(*line))
    top = found.withColumn("rank", own).where(F.col("rank") <= positives)

    # An anchor's windows, ``positives`` at most, travel with it.
    low, high = (F.col("score") * F.lit(share / 100.0) for share in (least, most))
    window = F.struct(F.col("rank"), (low - 0.5).alias("low"), (high + 0.5).alias("high"), F.col("id").alias("tag"), "score")
    again = top.groupBy(F.col("batch"), "place", F.col("anchor").alias("id"), "label", "dim", "data").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    asked = batches_of(again.withColumn("block", F.col("batch")), batch_rows, count, positives)

    def below(scores, ids, same, other, low, positive):
        rows = np.flatnonzero(~same & other & (100 * scores >= least * positive) & (100 * scores <= most * positive))
        return rows[best(scores[rows], ids[rows], negatives)]

    hard = searched(blocks, asked, wanted(asked, zones), below)
    ranked = hard.withColumn("rank", F.row_number().over(Window.partitionBy("batch", "place", "window").orderBy(*line)).cast("int"))
    return ranked.where(F.col("rank") <= negatives).select(
        F.col("anchor").alias("anchor_id"), F.col("tag").alias("positive_id"), "rank",
        F.col("id").alias("negative_id"), F.col("sum").alias("positive_score"), F.col("score").alias("negative_score"),
    )
