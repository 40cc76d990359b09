"""K-means for every number of clusters at once, and their cosine silhouettes.

The centres of all runs (a number of clusters and a start) lie in one list; one pass over the vectors takes a
Lloyd step of every run that still moves, and sends a sum and a count for each centre from each task. Starts are
the unit vectors that come first in a seeded order of their keys, so they depend on the rows alone and a run can be
repeated anywhere. The silhouette needs no pairs: with unit vectors the mean cosine distance to a cluster is one
minus the product with the sum of its vectors over its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.constants import SEED
from curate.functions.hashing import draw_key
from curate.functions.vectors import as_double, unit
from curate.session import stored

STEPS = 20
STARTS = 3
CHUNK = 4096
TASK_ROWS = 50_000

Run = tuple[int, int]
"""Number of clusters, and which start."""


def packed_units(df: DataFrame, row_id: str, vec: str) -> DataFrame:
    """``(id, v)``: unit vectors as doubles, stored in parts of some TASK_ROWS rows, as every step reads them."""
    units = df.select(F.col(row_id).alias("id"), unit(as_double(F.col(vec))).alias("v"))
    return stored(units.repartition(max(1, ceil(df.count() / TASK_ROWS))), "units")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest centre, the lower one on ties; squared distance to it) of each row."""
    gap = (v * v).sum(axis=1)[:, None] - 2 * (v @ centres.T) + (centres * centres).sum(axis=1)
    own = gap.argmin(axis=1)
    return own, np.maximum(gap[np.arange(len(v)), own], 0.0)


Sums = dict[tuple[int, int, int], list]
"""Of each cluster of each run (k, start, cluster): its vectors' count, cost and sum."""


def _partial(add: Callable[[np.ndarray, Sums], None]) -> Callable:
    """A task's sums, to which ``add`` adds the vectors of a batch, as rows (k, start, cluster, place, x): one batch."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Sums = {}
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                add(_matrix(batch["v"].slice(at, CHUNK)), sums)
        if sums:
            values = np.asarray([[n, cost, *total] for n, cost, total in sums.values()])
            names = np.repeat(np.asarray(list(sums)), values.shape[1], axis=0)
            places = np.tile(np.arange(values.shape[1]), len(values))
            yield pa.RecordBatch.from_arrays([*map(pa.array, names.T), pa.array(places), pa.array(values.reshape(-1))], ["k", "start", "cluster", "place", "x"])

    return gather


def _summed(units: DataFrame, add: Callable[[np.ndarray, Sums], None], dim: int) -> Sums:
    """The sums of all tasks: added up in Spark, so the driver gets a row for each component of a centre, not of a task's."""
    parts = units.select("v").mapInArrow(_partial(add), "k long, start long, cluster long, place long, x double")
    found: Sums = {}
    for k, start, cluster, place, x in parts.groupBy("k", "start", "cluster", "place").agg(F.sum("x").alias("x")).collect():
        known = found.setdefault((k, start, cluster), [0, 0.0, np.zeros(dim)])
        if place > 1:
            known[2][place - 2] = x
        else:
            known[place] = x
    return found


def starts_of(units: DataFrame, ks: Sequence[int], starts: int, seed: int) -> dict[Run, np.ndarray]:
    """First centres of every run: the next distinct vectors in the seeded order of the rows' keys.

    The longest run needs most, so ``starts`` times that number of vectors comes to the driver.
    """
    most = max(ks)
    key = draw_key(seed, F.lit(":"), F.col("id"))
    first = units.groupBy("v").agg(F.min(F.struct(key.alias("key"), "id")).alias("place")).orderBy("place").limit(starts * most)
    found = np.asarray([r["v"] for r in first.select("v", "place").orderBy("place").collect()], float)
    if not len(found):
        raise ValueError("no vectors to cluster")
    return {(k, s): found[(np.arange(k) + s * most) % len(found)] for k in ks for s in range(starts)}


def fit_all(
    df: DataFrame, ks: Sequence[int], row_id: str = "row_id", vec: str = "embedding", seed: int = SEED, starts: int = STARTS, steps: int = STEPS
) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(stored unit vectors, best centres of each number of clusters) of all runs, fitted together.

    A run stops when a step moves no centre, or after ``steps``; an empty cluster keeps its centre. Of the starts of a
    number the one with the least squared distances, after its last step, is taken, the first on ties.
    """
    units = packed_units(df.where(F.col(vec).isNotNull()), row_id, vec)
    runs = starts_of(units, ks, starts, seed)
    dim = next(iter(runs.values())).shape[1]
    moving, cost = dict(runs), {}
    for step in range(steps + 1):
        last = step == steps

        def add(v: np.ndarray, sums: Sums, moving: Mapping[Run, np.ndarray] = moving) -> None:
            for (k, start), centres in moving.items():
                own, gap = nearest(v, centres)
                for c in np.unique(own):
                    mine = own == c
                    known = sums.setdefault((k, start, int(c)), [0, 0.0, np.zeros(v.shape[1])])
                    known[0] += int(mine.sum())
                    known[1] += float(gap[mine].sum())
                    known[2] += v[mine].sum(axis=0)

        new = {run: centres.copy() for run, centres in moving.items()}
        total = dict.fromkeys(moving, 0.0)
        for (k, start, cluster), (n, far, whole) in sorted(_summed(units, add, dim).items()):
            total[k, start] += far
            new[k, start][cluster] = whole / n
        cost |= total
        if last:
            break
        settled = [run for run in moving if np.abs(new[run] - moving[run]).max() < 1e-12]
        runs |= {run: centres for run, centres in new.items() if run not in settled}
        moving = {run: new[run] for run in moving if run not in settled}
        if not moving:
            break
    best = {k: min(range(starts), key=lambda s: (round(cost[k, s], 9), s)) for k in ks}
    return units, {k: runs[k, best[k]] for k in ks}


def silhouettes(units: DataFrame, centres: Mapping[int, np.ndarray]) -> dict[int, float]:
    """Mean cosine silhouette of each number of clusters, from two passes over the vectors."""
    dim = next(iter(centres.values())).shape[1]

    def add(v: np.ndarray, sums: Sums) -> None:
        for k, c in centres.items():
            own, _ = nearest(v, c)
            for cluster in np.unique(own):
                known = sums.setdefault((k, 0, int(cluster)), [0, 0.0, np.zeros(v.shape[1])])
                known[0] += int((own == cluster).sum())
                known[2] += v[own == cluster].sum(axis=0)

    size = {k: np.zeros(len(c)) for k, c in centres.items()}
    whole = {k: np.zeros_like(c) for k, c in centres.items()}
    for (k, _, cluster), (n, _, total) in _summed(units, add, dim).items():
        size[k][cluster], whole[k][cluster] = n, total

    def judge(v: np.ndarray, sums: Sums) -> None:
        for k, c in centres.items():
            value = silhouette_of(v, nearest(v, c)[0], size[k], whole[k])
            known = sums.setdefault((k, 0, 0), [0, 0.0, np.zeros(dim)])
            known[0] += len(v)
            known[1] += float(value.sum())

    return {k: total / n for (k, _, _), (n, total, _) in _summed(units, judge, dim).items()}


def silhouette_of(v: np.ndarray, own: np.ndarray, size: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Silhouette of unit vectors, given each cluster's size and sum of vectors; 0 for one alone in its cluster."""
    rows, used = np.arange(len(v)), size > 0
    if used.sum() < 2:
        return np.zeros(len(v))
    mean = np.full((len(v), len(size)), np.inf)
    mean[:, used] = 1 - (v @ whole[used].T) / size[used]
    inside = mean[rows, own] * size[own] / np.maximum(size[own] - 1, 1)  # a vector is no neighbour of itself, at distance 0
    mean[rows, own] = np.inf
    outside = mean.min(axis=1)
    most = np.maximum(inside, outside)
    return np.where((size[own] > 1) & (most > 0), (outside - inside) / np.where(most > 0, most, 1), 0.0)


def assigned(units: DataFrame, centres: np.ndarray) -> DataFrame:
    """``(id, cluster)``: the nearest centre of every vector."""
    kind = dict(units.dtypes)["id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                own, _ = nearest(_matrix(part["v"]), centres)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(own.astype(np.int32))], ["id", "cluster"])

    return units.mapInArrow(place, f"id {kind}, cluster int")
