"""Packing token pieces into sequences by minimum bin slack.

A document is cut into whole windows and a rest. The rests of a group form a multiset of lengths.
Again and again the longest rest opens a window, and a bitset over sums (bit s: some of the rests
add up to s) finds the multiset that fills the window closest to its capacity; the recorded bitsets
give back which lengths it has, and it is used as often as the counts allow.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END = 1
COPIES = 256
"""Equal pieces dealt to a group at once."""
GROUP_ROWS = 8192
"""Documents of a group: enough to fill windows well, few enough for one task."""


@lru_cache(maxsize=2)
def encoder(name: str, special: str, special_id: int):
    """The byte-level BPE of a rank file, as a tiktoken encoding.

    It gives the ids that the ``tokenizers`` library gives for the same vocabulary, five times as
    fast (the tests compare both); the special token is recognised inside texts, as there.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: special_id})


def token_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = False,
    vocabulary: tuple[str, str, int] = ("byte_bpe_50k.tiktoken", "<|endoftext|>", 50256),
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the pieces of each document's ids.

    A document's ids are those of its text, NULL as empty, and then ``end``. Its pieces are whole
    windows of ``capacity`` ids and the rest, which is never empty unless the windows take all.
    """
    fields = [pa.field(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    schema = pa.schema(fields + [pa.field("ids", pa.list_(pa.uint32()))] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(*vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    ids = np.asarray([*coder.encode(text or "", allowed_special="all"), end], "<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        row = (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))
                        out.append((*row, piece) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    types = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    if with_ids:
        schema = schema.set(5, pa.field("ids", pa.list_(pa.int64())))
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, types)


def fill(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Minimum bin slack: [(lengths that share a window, how many such windows)]."""
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left, reverse=True)
    patterns = []
    while order:
        longest = order[0]
        room = capacity - longest
        reach, steps = 1, []
        mask = (1 << (room + 1)) - 1
        for n in order:
            if n > room:
                continue
            free, take = left[n] - (n == longest), 1
            while free > 0 and not reach >> room & 1:
                take = min(take, free)
                steps.append((n, take, reach))
                reach |= reach << (n * take) & mask
                free, take = free - take, take * 2
            if reach >> room & 1:
                break
        target = reach.bit_length() - 1
        used = defaultdict(int, {longest: 1})
        for n, take, before in reversed(steps):
            if not before >> target & 1:
                used[n] += take
                target -= n * take
        times = min(left[n] // k for n, k in used.items())
        patterns.append(([n for n, k in used.items() for _ in range(k)], times))
        for n, k in used.items():
            left[n] -= k * times
        order = [n for n in order if left[n]]
    return patterns


def pack(pieces: DataFrame, n_docs: int, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces: where each one lies.

    Pieces are dealt to groups by a hash of id, start, length and checksum, as many groups as ``n_docs``
    needs, and each group is packed by itself. Pieces equal in every column are counted first and dealt
    COPIES at a time, so no task holds more than a few times ``group_rows`` documents, whatever the
    table: one id, no id or one repeated row may be a third of it. The same rows get the same places
    again. Repeated rows are packed one by one.
    """
    groups = max(1, ceil(n_docs / group_rows))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    placed = ", ".join(f"`{c}` {t}" for c, t in pieces.select(names).dtypes) + ", sequence_id bigint, offset bigint"

    def place(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.repeat(np.arange(len(table)), table["__copies"].to_numpy())))
        table = table.drop_columns(["__group", "__copies"]).sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("length", "ascending")])
        lengths = table["length"].to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        whole = np.flatnonzero(lengths >= capacity)
        sequence[whole] = np.arange(len(whole))
        waiting = defaultdict(list)
        for i in np.flatnonzero(lengths < capacity)[::-1]:
            waiting[int(lengths[i])].append(i)
        number = len(whole)
        for pattern, times in fill({n: len(rows) for n, rows in waiting.items()}, capacity):
            for _ in range(times):
                at = 0
                for n in pattern:
                    i = waiting[n].pop()
                    sequence[i], offset[i], at = number, at, at + n
                number += 1
        first = int(key[0].as_py()) << 32
        return table.append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))

    counted = pieces.groupBy(*names).agg(F.count("*").alias("__n"))
    dealt = counted.withColumn("__deal", F.explode(F.expr(f"sequence(0, (__n - 1) div {COPIES})")))
    copies = F.least(F.col("__n") - F.col("__deal") * COPIES, F.lit(COPIES)).alias("__copies")
    group = F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", "__deal"), F.lit(groups)).alias("__group")
    return dealt.select(*names, copies, group).groupBy("__group").applyInArrow(place, placed)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of (doc_id, text).

    Each id of each document lies in one piece and each piece in one sequence of at most
    ``capacity`` ids, gapless from offset 0. A NULL or empty text is its end id alone. An empty
    table gives no rows. Other columns are not read.
    """
    return pack(token_pieces(docs, capacity), docs.count(), capacity, group_rows)
