"""Exact range join of vectors by cosine, in cells around pivots.

Vectors are compared by the angle between them, which is a metric. A sample of vectors serves as
pivots; a vector belongs to the cell of its nearest pivot, cells are cut into blocks of bounded
size, and blocks meet two by two. By the triangle inequality a vector has partners in a cell only
if its angle to the cell's pivot is at most the cell's radius plus the join's angle, and only if
it is no more than that angle beyond the border between both pivots; it is sent to no other cell.
Tasks report a number of links and one link to a representative for each vector, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.graph import components
from curate.llm.ngram_join import smallest
from curate.session import stored

THRESHOLD = 0.9
BLOCK_ROWS = 4096
MAX_PIVOTS = 2048
"""Pivots are a sample of the vectors: one for each block, at most so many (every vector is indexed)."""
SLACK = 1e-7
"""More than the error of an angle near 0, which is the root of that of its cosine."""


def _units(data: list[bytes]) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first, so that no square overflows."""
    v = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, data): every row, with the components as packed doubles, or NULL without an id or a direction."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["v"].cast(pa.list_(pa.float64()))
            none = (pc.is_null(batch["id"]).to_numpy(zero_copy_only=False)) | (pc.is_null(lists).to_numpy(zero_copy_only=False))
            flat, edges = lists.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            whole = flat.is_valid().to_numpy(zero_copy_only=False)
            values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~(whole & np.isfinite(values)))])
            some = np.concatenate([[0], np.cumsum(values != 0)])
            kept = ~none & (bad[edges[1:]] == bad[edges[:-1]]) & (some[edges[1:]] > some[edges[:-1]])
            data = [(values[a:b] + 0.0).astype("<f8").tobytes() if k else None for a, b, k in zip(edges[:-1], edges[1:], kept)]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(data, pa.binary())], ["id", "data"])

    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    return rows.mapInArrow(pack, "id long, data binary")


class Cells:
    """Pivots of vectors of one dimension; angles and borders."""

    def __init__(self, pivots: list[bytes], angle: float):
        self.pivots = _units(pivots)
        self.angle = angle
        self.apart = np.sqrt(np.maximum(2 - 2 * self.pivots @ self.pivots.T, 0))

    def nearest(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cosine = np.clip(units @ self.pivots.T, -1, 1)
        own = cosine.argmax(axis=1)
        return cosine, own, np.arccos(cosine[np.arange(len(own)), own])

    def reach(self, cosine: np.ndarray, own: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Which cells, by their radius, may hold a partner of which vector."""
        near = np.arccos(cosine) <= radius[None, :] + self.angle + SLACK
        # How far the vector lies on its own side of the plane between both pivots.
        gap = (cosine[np.arange(len(own)), own][:, None] - cosine) / np.maximum(self.apart[own], 1e-12)
        return near & (gap <= 2 * np.sin(self.angle / 2) + SLACK)


def _compare(threshold: float):
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        ids, copies, home = (table[c].to_numpy() for c in ("id", "copies", "block"))
        low, high = int(key[0].as_py()), int(key[1].as_py())
        units = _units(table["data"].to_pylist())
        small = units.astype(np.float32)
        one, two = np.flatnonzero(home == low), np.flatnonzero(home == high)
        found = []
        for at in range(0, len(one), 512):
            rows = one[at : at + 512]
            x, y = np.nonzero(small[rows] @ small[two].T >= threshold - 1e-4)
            left, right = rows[x], two[y]
            if low == high:
                left, right = left[left < right], right[left < right]
            exact = np.einsum("ij,ij->i", units[left], units[right]) >= threshold
            found.append(np.stack([left[exact], right[exact]]))
        left, right = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, left, copies[right])
        np.add.at(links, right, copies[left])
        root = smallest(np.arange(len(ids)), left, right)
        kept = np.flatnonzero(links)
        return pa.table({"id": ids[kept], "links": links[kept], "root": ids[root[kept]]})

    return compare


def cosine_links(
    vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vec: str = "embedding",
    block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of the table.

    Two rows are linked if the cosine of their vectors, in double precision, is ``threshold`` or more.
    Equal vectors are compared once and count as often as they occur. A vector that is NULL, zero or
    holds a NULL or non-finite component links with nothing, nor do vectors of different length with
    each other. Every row is a vector of its own, repeated ones and those with equal ids too: ``n_links``
    counts the other rows linked with it, and ``component_id`` is the smallest id of the rows that links
    lead to. A NULL id has no links, is no link, and is not kept. An empty table gives no rows.
    """
    angle = float(np.arccos(threshold))
    valid = stored(usable(vectors, key, vec), "vectors")
    # A number for each distinct vector: ids may repeat.
    distinct = valid.where("data IS NOT NULL").groupBy("data").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    groups = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
    n = groups.count()
    pivots: dict[int, list[bytes]] = {}
    for row in groups.orderBy(F.xxhash64("id"), "id").limit(min(max_pivots, ceil(n / block_rows))).collect():
        pivots.setdefault(len(row["data"]), []).append(bytes(row["data"]))
    cells = {size: Cells(found, angle) for size, found in pivots.items()}
    first = {size: sum(len(f) for s, f in sorted(pivots.items()) if s < size) for size in pivots}
    rest = sum(map(len, pivots.values()))  # vectors of a length that no pivot has: a cell for each length

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        lengths = pc.binary_length(batch["data"]).to_numpy(zero_copy_only=False)
        for size in np.unique(lengths).tolist():
            part = batch.take(pa.array(np.flatnonzero(lengths == size)))
            yield size, part, _units(part["data"].to_pylist())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part, units in by_length(batch):
                own, far = np.full(part.num_rows, rest + size), np.zeros(part.num_rows)
                if size in cells:
                    _, near, far = cells[size].nearest(units)
                    own = first[size] + near
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(own.astype(np.int64)), pa.array(far)], ["id", "cell", "far"])

    placed = groups.select("id", "data").mapInArrow(assign, "id long, cell long, far double")
    # One row for each cell, of which there are at most ``max_pivots`` and one for each odd length.
    known = {r["cell"]: (r["far"], max(1, ceil(r["n"] / block_rows))) for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    begin = dict(zip(sorted(known), np.cumsum([0] + [known[c][1] for c in sorted(known)]).tolist()))
    radius = {s: np.asarray([known.get(first[s] + i, (-10.0, 0))[0] for i in range(len(f))]) for s, f in pivots.items()}

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part, units in by_length(batch):
                ids = part["id"].to_numpy()
                spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = np.full(len(ids), rest + size)
                meets = np.zeros((len(ids), 0), bool)
                if size in cells:
                    cosine, near, _ = cells[size].nearest(units)
                    own, meets = first[size] + near, cells[size].reach(cosine, near, radius[size])
                block = np.asarray([begin[c] + int(s) % known[c][1] for c, s in zip(own.tolist(), spread.tolist())])
                who, where = [np.arange(len(ids))], [block]
                for cell in sorted({*own.tolist(), *(first.get(size, 0) + np.flatnonzero(meets.any(axis=0))).tolist()}):
                    here = own == cell
                    if size in cells:
                        here = here | meets[:, cell - first[size]]
                    for b in range(begin[cell], begin[cell] + known[cell][1]):
                        rows = np.flatnonzero(here & (block < b))
                        who.append(rows)
                        where.append(np.full(len(rows), b))
                rows, to = pa.array(np.concatenate(who)), np.concatenate(where)
                out = part.take(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[rows.to_numpy()]), pa.array(to), out["id"], out["copies"], out["data"]], ["low", "high", "id", "copies", "data"]
                )

    sent = groups.select("id", "copies", "data").mapInArrow(visit, "low long, high long, id long, copies long, data binary")
    sent = sent.withColumn("block", F.col("low"))
    pairs = sent.where("low < high").select("low", "high").distinct()
    hosts = sent.where("low = high").drop("low").join(pairs, "high").select(*sent.columns)
    both = sent.unionByName(hosts)
    checked = stored(both.groupBy("low", "high").applyInArrow(_compare(threshold), "id long, links long, root long"), "links")

    linked = checked.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(checked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    # One row for each distinct vector: its links to others, and the smallest id of its component.
    known = groups.select("data", "id", "least", "copies").join(linked, "id", "left").join(joined, "id", "left")
    known = stored(known.withColumn("component", F.coalesce("component", "id")), "components")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    ends = known.join(least, "component").select("data", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id")
    rows = valid.join(ends, "data", "left")
    component = F.coalesce("component_id", "id")
    return rows.select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
