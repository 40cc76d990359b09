"""Similarity gate: the largest cosine of each vector with the references of its group.

Vectors are packed into blocks, and a block meets a block in one matrix product. With a threshold, the
product over the first dimensions and the lengths of what remains bound every pair (Cauchy-Schwarz), and
only rows and references with a pair that can still reach the threshold go on to the rest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.constants import NORM_FLOOR
from curate.functions.vectors import as_double
from curate.session import stored

BROADCAST_BYTES = 64 << 20
"""References of at most so many bytes, as doubles, go to every executor; more are joined in blocks."""
BLOCK_ROWS = 512
SALT_BLOCKS = 64
"""Blocks of rows that meet the references of their group in one place."""
HEAD = 0.25
"""Part of the dimensions that the bound looks at first."""
SLACK = 1e-9


def _running_sum(products: np.ndarray) -> np.ndarray:
    """Row sums from left to right, as a fold in a column expression adds them."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(_running_sum(rows * rows)), NORM_FLOOR)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / _lengths(rows)[:, None]


def _rest(units: np.ndarray, head: int) -> np.ndarray:
    return np.sqrt((units[:, head:] ** 2).sum(axis=1))


def best_of(rows: np.ndarray, refs: np.ndarray, threshold: float | None = None) -> np.ndarray:
    """Largest cosine of every row with the unit vectors ``refs``; NaN where none reaches ``threshold``.

    The winning pair is computed again in a fixed order of additions, so the result does not depend on
    how rows were packed. Where two pairs differ by rounding only, either may win.
    """
    units = unit_rows(rows)
    value = np.full(len(rows), -np.inf)
    winner = np.zeros(len(rows), dtype=np.int64)
    head = int(rows.shape[1] * HEAD)
    for r in range(0, len(rows), BLOCK_ROWS):
        for s in range(0, len(refs), BLOCK_ROWS):
            left, right = units[r : r + BLOCK_ROWS], refs[s : s + BLOCK_ROWS]
            mine, theirs = np.arange(len(left)), np.arange(len(right))
            if threshold is not None and head:
                reach = left[:, :head] @ right[:, :head].T + np.outer(_rest(left, head), _rest(right, head))
                can = reach >= threshold - SLACK
                mine, theirs = np.flatnonzero(can.any(axis=1)), np.flatnonzero(can.any(axis=0))
                if not len(mine):
                    continue
            found = left[mine] @ right[theirs].T
            top = found.argmax(axis=1)
            best = found[np.arange(len(mine)), top]
            better = best > value[r + mine]
            value[r + mine[better]] = best[better]
            winner[r + mine[better]] = s + theirs[top[better]]
    known = np.isfinite(value)
    out = np.full(len(rows), np.nan)
    out[known] = _running_sum(rows[known] * refs[winner[known]]) / _lengths(rows[known])
    if threshold is not None:
        out[known & (out < threshold)] = np.nan
    return out


def _key(by: Sequence[str]) -> Column:
    """The group as text; NULL if any of its columns is, as such a row equals no other."""
    if not by:
        return F.lit("")
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    return F.when(known, F.to_json(F.struct(*by)))


def _vector(vec: str) -> Column:
    """The vector in DOUBLE, NULL if it is empty or a component is NULL, NaN or infinite."""
    wide = as_double(F.col(vec))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite & (F.size(wide) > 0), wide)


def _groups(keys: pa.Array, vecs: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """``(key, places, matrix)`` of the rows with a key and a vector, by key and number of dimensions."""
    usable = np.asarray(keys.is_valid()) & np.asarray(vecs.is_valid())
    places = np.flatnonzero(usable)
    if not len(places):
        return
    taken = vecs.take(pa.array(places))
    widths = np.asarray(taken.value_lengths()).astype(np.int64)
    starts = np.cumsum(widths) - widths
    flat = np.asarray(taken.flatten(), dtype=np.float64)
    coded = keys.take(pa.array(places)).dictionary_encode()
    codes = np.asarray(coded.indices)
    for code, width in sorted({(int(c), int(w)) for c, w in zip(codes, widths)}):
        own = np.flatnonzero((codes == code) & (widths == width))
        cells = starts[own][:, None] + np.arange(width)
        yield coded.dictionary[code].as_py(), places[own], flat[cells]


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _looked_up(candidates: DataFrame, refs: DataFrame, by: Sequence[str], vec: str, threshold: float | None) -> Column:
    """The best similarity as a column that holds the packed references of bounded size."""
    table = refs.select(_key(by).alias("key"), _vector(vec).alias("vec")).distinct().toArrow()
    lists = {}
    for key, _, matrix in _groups(_whole(table["key"]), _whole(table["vec"])):
        lists[key, matrix.shape[1]] = unit_rows(matrix)
    packed = candidates.sparkSession.sparkContext.broadcast(lists)

    @F.arrow_udf("double")
    def best(key: pa.Array, vecs: pa.Array) -> pa.Array:
        out = np.full(len(key), np.nan)
        for name, places, matrix in _groups(key, vecs):
            found = packed.value.get((name, matrix.shape[1]))
            if found is not None:
                out[places] = best_of(matrix, found, threshold)
        return pa.array(out, mask=np.isnan(out))

    # Not deterministic, so that a filter on the result is not pushed below it with a copy of the call.
    return best.asNondeterministic()(_key(by), _vector(vec))


def best_similarity(
    candidates: DataFrame,
    refs: DataFrame,
    by: Sequence[str],
    vec: str = "embedding",
    out: str = "similarity",
    broadcast_bytes: int = BROADCAST_BYTES,
    threshold: float | None = None,
) -> DataFrame:
    """Add the largest cosine similarity of each row to the references of its group.

    The references may be a capped sample (:func:`curate.operators.sampling.stratified_seeds`) or all
    rows. Their size is looked up first: up to ``broadcast_bytes`` they are packed and broadcast, so
    candidates are neither shuffled nor paired; beyond that the rows go through
    :func:`best_similarity_in_blocks`, with the same result.

    NULL is the result of a row without references, without a group, or with a vector that is NULL, empty
    or not finite; such references count as none, and vectors meet vectors of their own length only. With
    ``threshold``, rows that do not reach it get NULL too, for which less has to be computed.
    """
    size = refs.agg(F.sum(F.size(vec) * F.lit(8) + 64)).first()[0] or 0
    if size > broadcast_bytes:
        numbered = stored(candidates.withColumn("__row", F.monotonically_increasing_id()), "candidates")
        distinct = refs.select(*by, vec).distinct()
        scored = best_similarity_in_blocks(numbered, distinct, by, "__row", vec, vec=vec, out=out, threshold=threshold)
        return scored.select(*candidates.columns, out)
    return candidates.withColumn(out, _looked_up(candidates, refs, by, vec, threshold))


def _blocks(df: DataFrame, by: Sequence[str], number: str, vec: str, blocks: int | None) -> DataFrame:
    """Blocks ``(__key, __width, __block, __blocks, ids, flat)`` of near BLOCK_ROWS vectors of one group and length."""
    slim = df.select(_key(by).alias("__key"), F.col(number).alias("id"), _vector(vec).alias("v"))
    slim = slim.where("__key IS NOT NULL AND v IS NOT NULL").withColumn("__width", F.size("v"))
    group = ["__key", "__width"]
    many = F.lit(blocks) if blocks else F.ceil(F.count("*") / BLOCK_ROWS)
    sizes = slim.groupBy(*group).agg(many.cast("int").alias("__blocks"))
    dealt = slim.join(sizes, group).withColumn("__block", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int"))
    rows = F.collect_list(F.struct("id", "v"))
    packed = dealt.groupBy(*group, "__block", "__blocks").agg(rows.alias("rows"))
    return packed.select(*group, "__block", "__blocks", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat"))


def best_similarity_in_blocks(
    candidates: DataFrame,
    refs: DataFrame,
    by: Sequence[str],
    row_id: str,
    ref_id: str,
    blocks: int | None = None,
    vec: str = "embedding",
    out: str = "similarity",
    threshold: float | None = None,
) -> DataFrame:
    """:func:`best_similarity` for any number of references, by a shuffle join of packed blocks.

    Rows and references of a group are dealt over blocks by hashes of their ids, references over ``blocks``
    if that is given. Every block of rows meets every block of references of its group, and SALT_BLOCKS of
    them do so in one place, so a group of any size is many tasks. ``row_id`` tells candidates apart.
    """
    group = ["__key", "__width"]
    rows = _blocks(candidates, by, row_id, vec, None)
    salts = F.ceil(F.col("__blocks") / SALT_BLOCKS).cast("int")
    left = rows.withColumn("__salt", F.pmod("__block", salts)).select(*group, "__salt", "ids", "flat")
    spread = rows.groupBy(*group).agg(F.max(salts).alias("__salts"))
    lists = _blocks(refs, by, ref_id, vec, blocks).select(*group, F.col("flat").alias("refs"))
    right = lists.join(spread, group).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)))

    @F.arrow_udf("array<double>")
    def met(width: pa.Array, flat: pa.Array, others: pa.Array) -> pa.Array:
        def pair(w: int, a: pa.Scalar, b: pa.Scalar) -> np.ndarray:
            mine, theirs = (np.asarray(x.values, dtype=np.float64).reshape(-1, w) for x in (a, b))
            return best_of(mine, unit_rows(theirs), threshold)

        found = [pair(w.as_py(), a, b) for w, a, b in zip(width, flat, others)]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        values = np.concatenate(found) if found else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, mask=np.isnan(values)))

    pairs = left.join(right.hint("merge"), [*group, "__salt"])
    scored = pairs.select("ids", met.asNondeterministic()("__width", "flat", "refs").alias("found"))
    each = scored.select(F.explode(F.arrays_zip("ids", "found")).alias("e")).where("e.found IS NOT NULL")
    best = each.groupBy(F.col("e.ids").alias(row_id)).agg(F.max("e.found").alias(out))
    return candidates.join(best, row_id, "left")


def similarity_gate(
    candidates: DataFrame,
    refs: DataFrame,
    by: Sequence[str],
    threshold: float,
    vec: str = "embedding",
    return_scores: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Keep rows whose best similarity reaches the threshold."""
    scored = best_similarity(candidates, refs, by, vec, "__similarity", broadcast_bytes, threshold)
    kept = scored.where(F.col("__similarity") >= threshold)
    if return_scores:
        return kept.withColumnRenamed("__similarity", "similarity")
    return kept.drop("__similarity")


def acceptance_rate(scored: DataFrame, by: Sequence[str], threshold: float, score: str = "similarity") -> DataFrame:
    """Kept, dropped and total rows of the gate per group, and the percentage dropped."""
    kept = F.count_if(F.col(score) >= threshold)
    return scored.groupBy(*by).agg(
        F.count("*").alias("total"),
        kept.alias("kept"),
        (F.count("*") - kept).alias("dropped"),
        ((F.count("*") - kept) * 100.0 / F.count("*")).alias("dropped_percent"),
    )
