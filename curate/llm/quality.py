"""Quality scores from compressed sizes under a dictionary of good and one of bad text.

Two zstandard dictionaries are trained, one on texts labelled good and one on texts labelled bad. A
text is compressed with each, block by block, so that what it has said before does not hide what
the dictionaries know. The difference of the two sizes by the text's length is the signal; a logistic
curve, which also knows the size itself and the length, as short texts differ by chance, turns it into
the probability of label 1. Labelled rows are dealt to two halves; each half trains a pair of
dictionaries, and the curve is fitted on the sizes of each half under the other half's pair. A score
is the mean of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.llm.common import text_of

BLOCK = 512
LEVEL = 3
DICTIONARY_BYTES = 110 * 1024
DICTIONARY_ROWS = 2_000
SAMPLE_BYTES = 8 << 20
"""The sample of a dictionary: whole texts, at most so many and of so many bytes in all."""
CALIBRATION_ROWS = 6_000
LIMIT = 4.0
RIDGE = 0.3


@dataclass(frozen=True)
class Classifier:
    """Two pairs of dictionaries, and the curve: without weights every text gets the constant ``base``."""

    dictionaries: tuple[tuple[bytes, bytes], ...]
    mean: np.ndarray | None
    spread: np.ndarray | None
    weights: np.ndarray | None
    base: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        logits = [_design(features(texts, d), self.mean, self.spread) @ self.weights for d in self.dictionaries]
        return np.mean([1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in logits], axis=0)


def _compressors(dictionaries: tuple[bytes, bytes]) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in dictionaries:
        known = zstandard.ZstdCompressionDict(content)
        known.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def features(texts: list[str | None], dictionaries: tuple[bytes, bytes]) -> np.ndarray:
    """Three numbers per text: size difference by length, size under the good dictionary by length, log of the length."""
    compressors, out = _compressors(dictionaries), []
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        n = max(len(data), 1)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        bad, good = (sum(len(c.compress(b)) for b in blocks) / n for c in compressors)
        out.append((bad - good, good, np.log(n)))
    return np.asarray(out, float).reshape(-1, 3)


def _design(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """A constant, the features, and the difference times the log of the length."""
    z = np.clip((x - mean) / spread, -LIMIT, LIMIT)
    return np.column_stack([np.ones(len(z)), z, z[:, 0] * z[:, 2]])


def _logistic(a: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves as the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


def scored_features(docs: DataFrame, dictionaries: tuple[bytes, bytes], keep: list[str]) -> DataFrame:
    """(``keep``…, x ARRAY<DOUBLE>) of every whole text."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    types = ", ".join(f"`{c}` {t}" for c, t in rows.drop("__text").dtypes) + ", x array<double>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = features(part["__text"].to_pylist(), dictionaries)
                kept = part.drop_columns(["__text"])
                yield kept.append_column("x", pa.array(list(x), pa.list_(pa.float64())))

    return rows.mapInArrow(measure, types)


def within(rows: list, bytes_: int, n: int) -> list:
    """The first ``n`` of the rows whose ``size`` still fits into ``bytes_`` in all."""
    kept, total = [], 0
    for r in rows:
        if len(kept) < n and total + r["size"] <= bytes_:
            kept.append(r)
            total += r["size"]
    return kept


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    label: str = "quality",
    dictionary_rows: int = DICTIONARY_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
    calibration_rows: int = CALIBRATION_ROWS,
) -> Classifier:
    """Learn from labelled rows for which ``usable`` (a condition on ``doc_id``) holds.

    The sample is bounded in rows and bytes: in each half, dealt by a hash of the id, whole texts of each
    class train its dictionary, the first ``dictionary_rows`` that fit into ``sample_bytes``, and the first
    ``calibration_rows`` texts are measured, whole too, for the curve. Which rows it holds depends only on ids
    and texts; equal rows count once. Rows with a NULL label or text are passed over. If a half lacks
    a class, there is no curve.
    """
    place = F.xxhash64(F.lit(11), "doc_id")
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(usable & F.col("y").isin(0, 1)).distinct()
    known = known.select("doc_id", "y", F.shiftright(place, 1).alias("h"), F.pmod(place, F.lit(2)).alias("half"))
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").withColumn("key", F.xxhash64("text"))
    line = ["h", "doc_id", "y", "key"]

    def first(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy("h", "doc_id", "y").limit(n)

    parts = [known.where((F.col("half") == half) & (F.col("y") == y)) for half in (0, 1) for y in (0, 1)]
    # At most 4 * dictionary_rows rows of numbers.
    chosen = reduce(DataFrame.unionByName, [first(rows, dictionary_rows) for rows in parts])
    sized = texts.select("doc_id", "key", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id")
    rows = sized.distinct().orderBy(*line).limit(4 * dictionary_rows).collect()
    picked = [
        r for half in (0, 1) for y in (0, 1) for r in within([r for r in rows if (r["half"], r["y"]) == (half, y)], sample_bytes, dictionary_rows)
    ]
    samples: dict[tuple[int, int], list[bytes]] = {(half, y): [] for half in (0, 1) for y in (0, 1)}
    if picked:
        names = docs.sparkSession.createDataFrame([(r["doc_id"], r["key"], r["half"], r["y"], r["h"]) for r in picked], "doc_id long, key long, half int, y int, h long")
        # At most 4 * sample_bytes of text.
        found = texts.join(F.broadcast(names), ["doc_id", "key"]).dropDuplicates(["doc_id", "key", "y"]).collect()
        for r in sorted(found, key=lambda r: tuple(r[c] for c in line)):
            data = r["text"].encode("utf-8", "surrogatepass")
            samples[r["half"], r["y"]] += [data[i : i + 2 * BLOCK] for i in range(0, len(data), 2 * BLOCK)]
    base = known.agg(F.avg("y")).first()[0]
    base = 0.5 if base is None else float(base)
    if not all(samples.values()):
        return Classifier((), None, None, None, base)
    dictionaries = tuple((_dictionary(samples[half, 0]), _dictionary(samples[half, 1])) for half in (0, 1))
    measured = []
    for half in (0, 1):
        some = texts.join(F.broadcast(first(known.where(F.col("half") == half), calibration_rows)), "doc_id").dropDuplicates(["doc_id", "key", "y"])
        measured += scored_features(some, dictionaries[1 - half], line).orderBy(*line).limit(calibration_rows).collect()
    x, y = np.asarray([r["x"] for r in measured]), np.asarray([r["y"] for r in measured], float)
    if len(set(y.tolist())) < 2:
        return Classifier((), None, None, None, base)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Classifier(dictionaries, mean, spread, _logistic(_design(x, mean, spread), y), base)


def score(docs: DataFrame, model: Classifier, keep: list[str], out: str = "score") -> DataFrame:
    """(``keep``…, ``out`` DOUBLE): the probability of label 1 for every whole text, in [0, 1].

    NULL counts as the empty text, which gets the score of a text without content. Equal texts get
    equal scores, repeated rows stay, an empty table gives no rows, and columns not in ``keep`` are
    not read. Scores use the text alone.
    """
    rows = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], text_of("text").alias("text"))
    names = [f"__k{i}" for i in range(len(keep))]
    if model.weights is None:
        scored = rows.select(*names, F.lit(model.base).cast("double").alias("score"))
    else:
        types = ", ".join(f"`{c}` {t}" for c, t in rows.select(names).dtypes) + ", score double"

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    found = model.score(part["text"].to_pylist())
                    yield part.drop_columns(["text"]).append_column("score", pa.array(found))

        scored = rows.mapInArrow(judge, types)
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], F.col("score").alias(out))
