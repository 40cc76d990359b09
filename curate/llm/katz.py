"""Katz backoff n-gram model of any order with Good-Turing discounts, counted and evaluated where its tables lie.

Texts are tokenised once, into batches of some megabytes: the codes of a batch's words and the
64-bit hashes the codes stand for. Then each batch asks, and tells its own counts of, its distinct
words from the partitions of the word table, next its distinct pairs from the partitions of the pair
table, and so on up to the order of the model. A partition adds up what all batches tell, which makes
its part of the table, and answers each batch with the totals and with numbers for its entries, by which
the next level names its histories. So an entry crosses the network once for each batch, not for
each time it is used, in packed columns, and no table is ever whole in one place.

The answers also say which entries no other batch holds. A longer run with such an entry in it is in no other
batch either, so its batch has its whole count: after such a history nothing is asked at all, and a run that only
ends in such an entry is told without its word, for the sums of its history.

P(w | h) = d(c) c / c(h) for entries seen in training, c = c(h w), with Good-Turing discounts d for small
counts; else backoff(h) P(w | h'), h' being h without its first word, where backoff(h) = (1 - sum of P(v | h)) /
(1 - sum of P(v | h')), both sums over the words v seen after h, so each history's probabilities add up to 1.
P(w) is discounted too, and its rest is the probability of the one unknown word. A history never seen
backs off with weight 1. Histories reach back to the start of the text, which counts as a word, and no further.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.llm.common import coded, words
from curate.session import drop_stored, scratch_path, stored

ORDER = 3
BATCH_BYTES = 4 << 20
PART_BYTES = 12 << 20
WORD_SHARE = 4
"""A batch has far fewer distinct words than longer runs, so their table has this many times fewer partitions."""
TASK_SHARE = 3
"""Batches or partitions that a task handles, one after another: fewer files and blocks of exchanges."""
TOP = 1 << 16
MOST = 5
"""Counts up to this one are discounted."""
HOT_SHARE = 4096
"""A history that makes up more than this part of all tokens is spread over all partitions; a level
can have no more of those than this number, so their sums may go to every task."""
END_HASH = xxhash.xxh64_intdigest(b" end of text ")  # no word holds a blank
START = 0
"""Number of the start of a text; words have larger ones."""


# ------------------------------------------------------------------------------- packed columns
def packed(values: np.ndarray, kind: str | None = None) -> bytes:
    """Numbers with their bytes in planes, compressed. Without a kind they are not negative and take 1, 2, 4 or 8 bytes each."""
    if kind is None:
        most = int(values.max()) if len(values) else 0
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * int(k[2]))
    raw = np.ascontiguousarray(values, kind)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return kind.encode() + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    """The numbers; integers as 64-bit ones."""
    if not data:
        return np.zeros(0, np.int64)
    kind, raw = data[:3].decode(), np.frombuffer(zstandard.decompress(data[3:]), np.uint8)
    found = np.ascontiguousarray(raw.reshape(int(kind[2]), -1).T).view(kind).reshape(-1)
    return found if kind == "<f8" else found.astype(np.int64)


def in_order(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers that are not negative, ascending; their places)."""
    bits = len(values).bit_length()
    if len(values) and int(values.max()).bit_length() + bits > 63:
        order = np.argsort(values)
        return values[order], order
    both = values.astype(np.int64)
    both <<= bits
    both |= np.arange(len(values))
    both.sort()  # sorting places along costs more
    line = both >> bits
    both &= (1 << bits) - 1
    return line, both


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, ascending; a place of each; the distinct value of each place)."""
    line, order = in_order(values)
    new = np.ones(len(line), bool)
    np.not_equal(line[1:], line[:-1], out=new[1:])
    of = np.empty(len(line), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return line[new], order[new], of


def joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Keys that order and tell apart pairs of numbers."""
    bits = int(two.max()).bit_length() if len(two) else 0
    if len(one) and int(one.max()).bit_length() + bits > 63:
        one, (names, _, two) = distinct(one)[2].astype(np.int64), distinct(two)
        bits = len(names).bit_length()
    return one << bits | two


def steps(values: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences."""
    return np.diff(values, prepend=np.zeros(1, values.dtype))


def summed(data: bytes) -> np.ndarray:
    """Ascending numbers from packed differences."""
    return np.cumsum(unpacked(data))


def changes(values: np.ndarray) -> np.ndarray:
    """Any whole numbers as differences, those below zero as odd numbers."""
    diff = steps(values)
    return diff << 1 ^ diff >> 63


def undone(values: np.ndarray) -> np.ndarray:
    """The numbers of which these are the :func:`changes`."""
    return np.cumsum(values >> 1 ^ -(values & 1))


# ---------------------------------------------------------------------------------- discounts
def discounts(times: list[int]) -> np.ndarray:
    """Good-Turing factors of the counts 1 to MOST, from how many entries occur 1 to MOST + 1 times.

    If the numbers do not allow them (some count does not occur, or a factor leaves (0, 1]), the
    factors of absolute discounting.
    """
    n = [0.0, *map(float, times)]
    r = np.arange(1, MOST + 1)
    if all(n[1 : MOST + 2]):
        common = (MOST + 1) * n[MOST + 1] / n[1]
        adjusted = np.asarray([(c + 1) * n[c + 1] / n[c] / c for c in r])
        if common < 1:
            found = (adjusted - common) / (1 - common)
            if (found > 0).all() and (found <= 1).all():
                return found
    less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return (r - less) / r


def discounted(count: np.ndarray, factors: np.ndarray) -> np.ndarray:
    table = np.concatenate([[0.0], factors, [1.0]])
    return table[np.minimum(count, MOST + 1)] * count


@dataclass(frozen=True)
class Model:
    """What every task knows of the tables: a few numbers a level, and the sums of spread histories."""

    parts: int
    word_parts: int
    texts: int
    tokens: int
    distinct: int
    factors: tuple[np.ndarray, ...]
    """Discounts of the levels counted so far, single words first."""
    spread: tuple[dict[int, np.ndarray], ...]
    """Sums of the histories that are spread, for the levels from pairs on."""
    below: float  # what counts of single words are divided by
    rest: float  # probability of the unknown word

    @staticmethod
    def of(parts: int, word_parts: int, texts: int, distinct: int, tokens: int, times: list[int]) -> Model:
        factors = discounts(times)
        r = np.arange(1, MOST + 1)
        rest = float(((1 - factors) * r * np.asarray(times[:MOST])).sum())
        below = max(tokens if rest > 0 else tokens + 1, 1)
        return Model(parts, word_parts, texts, tokens, distinct, (factors,), (), below, (rest or 1.0) / below)

    @property
    def end_part(self) -> int:
        return int(part_of(np.asarray([END_HASH], np.uint64), self.word_parts)[0])


# ------------------------------------------------------------------------------------- batches
BATCH = "batch long, docs binary, blank binary, lengths binary, train binary, codes binary, hashes binary, counts binary, top binary"
NAMES = [f.split()[0] for f in BATCH.split(", ")]
ASKS = ["batch", "train", "hashes", "counts"]
"""What the word table is asked by; a row of its own (kind 1), not kept once that has answered."""


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def encode(table: pa.Table, batch: int, parts: int) -> tuple:
    """One batch. The most frequent words come first, by frequency; the others by their hash."""
    text = table["text"].combine_chunks()
    train = table["train"].combine_chunks().to_numpy(zero_copy_only=False)
    flat, owner = words(text)
    code, hashes = coded(flat)
    used = np.bincount(code, minlength=len(hashes))
    common = np.argsort(-used, kind="stable")
    rare = common[TOP:]
    order = np.concatenate([common[:TOP], rare[np.argsort(hashes[rare])]])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code, hashes = place[code], hashes[order]
    counts = np.bincount(code, weights=train[owner], minlength=len(hashes)).astype(np.int64)
    ids = table["doc_id"].combine_chunks()
    return (
        batch, pc.fill_null(ids, 0).to_numpy().astype("<i8").tobytes(), packed(ids.is_null().to_numpy(zero_copy_only=False), "<u1"),
        packed(np.bincount(owner, minlength=len(text))), packed(train, "<u1"), packed(code),
        hashes.astype("<u8").tobytes(), packed(counts), packed(part_of(hashes[:TOP], parts)),
    )


def batches_of(docs: DataFrame, train: Column, word_parts: int, batch_bytes: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    types = [pa.int64()] + [pa.binary()] * (len(NAMES) - 1)

    def gather(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        waiting, size = [], 0

        def out() -> pa.RecordBatch:
            row = dict(zip(NAMES, encode(pa.Table.from_batches(waiting), base + number, word_parts)))
            own, asks = ({n: row[n] for n in names} for names in ([n for n in NAMES if n not in ASKS[2:]], ASKS))
            columns = [pa.array([own.get(n), asks.get(n)], t) for n, t in zip(NAMES, types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([0, 1], pa.int32())], [*NAMES, "kind"])

        for batch in found:
            at, sizes = 0, pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
            total = np.cumsum(sizes.astype(np.int64))
            while at < batch.num_rows:
                before = total[at - 1] if at else 0
                to = min(batch.num_rows, int(np.searchsorted(total, before + batch_bytes - size)) + 1)
                waiting.append(batch.slice(at, to - at))
                size += int(total[to - 1] - before)
                at = to
                if size >= batch_bytes:
                    yield out()
                    waiting, size, number = [], 0, number + 1
        if waiting:
            yield out()

    return rows.mapInArrow(gather, f"{BATCH}, kind int")


# ---------------------------------------------------------------------------------- word table
ANSWER = "part int, batch long, kind int, a binary, b binary"
"""kind 0: an answer to a batch, in the order of its question; 1: totals of the partition; 2: sums of
histories that are spread over partitions."""


def answers(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) or [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["part", "batch", "kind", "a", "b"])


def ask_words(parts: int) -> Callable:
    names, types = ["part", "batch", "a", "b"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    end_part = int(part_of(np.asarray([END_HASH], np.uint64), parts)[0])

    def ask(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in batch.to_pylist():
                hashes, counts = np.frombuffer(row["hashes"], "<u8"), unpacked(row["counts"])
                texts = int(unpacked(row["train"]).sum())
                part = part_of(hashes, parts)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                out = []
                for p in range(parts):
                    mine = order[cut[p] : cut[p + 1]]
                    h, c = hashes[mine], counts[mine]
                    if p == end_part:
                        h, c = np.append(h, np.uint64(END_HASH)), np.append(c, texts)
                    if len(h):
                        out.append((p, row["batch"], h.tobytes(), packed(c)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return ask


def _histogram(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, MOST + 2), minlength=MOST + 3)[1 : MOST + 2].tolist()


def add_words(parts: int) -> Callable:
    def add(key: tuple, table: pa.Table) -> pa.Table:
        """A partition of the word table: each batch gets the words' total counts, whether it alone has them, and
        their numbers, small ones for frequent words."""
        table = table.sort_by("batch")
        asked = [np.frombuffer(a, "<u8") for a in table["a"].to_pylist()]
        told = [unpacked(b) for b in table["b"].to_pylist()]
        names, which = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate(told), minlength=len(names)).astype(np.int64)
        seen, place = total > 0, np.empty(len(names), np.int64)
        place[np.argsort(-total, kind="stable")] = np.arange(len(names))
        place *= seen
        value = total << 1 | (np.bincount(which, minlength=len(names)) == 1)
        part, out, at = key[0].as_py(), [], 0
        for batch, words_ in zip(table["batch"].to_pylist(), asked):
            mine = which[at : at + len(words_)]
            at += len(words_)
            out.append((part, batch, 0, packed(value[mine]), packed(place[mine])))
        stats = [int(seen.sum()), int(total.sum()), *_histogram(total)]
        out.append((part, -1, 1, np.asarray(stats, "<i8").tobytes(), None))
        return answers(out)

    return add


# --------------------------------------------------------------------------- tables of longer runs
SUMS = MOST + 1
"""Numbers kept of a history: how many words follow it 1 to MOST times, and the sum of the discounted counts that
the words after it have after the shorter history."""
QUESTION = "part int, batch long, own binary, wide binary, two binary, told binary, lower binary, past binary, own_ends binary, wide_ends binary, ends_lower binary, more binary"
"""Runs of histories of the partition (places, as differences) and of spread ones (numbers), with their words, own counts
and counts of the runs without the first word; histories whose sums are wanted; runs told without their words; own
counts of the batch that are told nowhere else, as a histogram."""


@dataclass
class Tokens:
    """A batch by token: a text's words and its end."""

    docs: pa.Array
    lengths: np.ndarray
    place: np.ndarray  # of the token in its text
    train: np.ndarray
    word: np.ndarray  # codes: words, then end, then start
    count: np.ndarray
    number: np.ndarray
    sole: np.ndarray  # whether no other batch has it


@dataclass
class Runs:
    """A level of a batch: its distinct runs, each a history of the level below and a word."""

    at: np.ndarray  # tokens with a run of this level
    of: np.ndarray  # each one's run
    run_at: np.ndarray  # the run of any token, -1 for none
    history: np.ndarray  # code in the level below
    word: np.ndarray
    suffix: np.ndarray  # code in the level below of the run without its first word
    told: np.ndarray
    asked: list[list[np.ndarray]]  # by partition, in the order of the question: runs of its histories, of spread ones,
    # those of both kinds that are told without their words, and histories whose sums are wanted
    more: np.ndarray  # runs in training whose histories no other batch has
    spread: np.ndarray  # of each code below: whether it is a spread history
    sole: np.ndarray  # whether no other batch has it, as far as known,
    count: np.ndarray  # and from here on known by the answers: totals, numbers,
    number: np.ndarray
    below: np.ndarray  # by history, what counts after it are divided by,
    weight: np.ndarray  # and log10 of its backoff weight


def tokens_of(rows: list[dict], model: Model) -> Tokens:
    """A batch from its own row and the answers of the word table."""
    own = next(r for r in rows if r["step"] == 0)
    replies = sorted((r for r in rows if r["step"] == 1), key=lambda r: r["part"])
    code, top = unpacked(own["codes"]), unpacked(own["top"])
    lengths = unpacked(own["lengths"])
    found = []
    for r in replies:
        found.append((r["part"], unpacked(r["a"]), unpacked(r["b"]) * model.word_parts + r["part"] + 1))
    end = sum(len(c) for _, c, _ in found) - 1  # one answer is the end's
    value, number, rare = np.zeros(end + 2, np.int64), np.zeros(end + 2, np.int64), len(top)
    for p, c, k in found:
        here = np.flatnonzero(top == p)
        if p == model.end_part:
            value[end], number[end] = c[-1], k[-1]
            c, k = c[:-1], k[:-1]
        more = len(c) - len(here)
        value[here], number[here] = c[: len(here)], k[: len(here)]
        value[rare : rare + more], number[rare : rare + more] = c[len(here) :], k[len(here) :]
        rare += more
    value[end + 1], number[end + 1] = model.texts << 1, START
    whole = lengths + 1
    first = np.cumsum(whole) - whole
    word = np.insert(code.astype(np.int32), np.cumsum(lengths), end)
    docs = pa.array(np.frombuffer(own["docs"], "<i8"), mask=unpacked(own["blank"]).astype(bool))
    train = np.repeat(unpacked(own["train"]) > 0, whole)
    return Tokens(docs, lengths, np.arange(len(word), dtype=np.int32) - np.repeat(first.astype(np.int32), whole), train, word, value >> 1, number, (value & 1) > 0)


def dealt(rows: np.ndarray, part: np.ndarray, parts: int) -> list[np.ndarray]:
    """The rows by partition; ``part`` ascends."""
    edges = np.searchsorted(part, np.arange(parts + 1))
    return [rows[a:b] for a, b in zip(edges, edges[1:])]


def runs_of(tokens: Tokens, below: Runs | None, level: int, model: Model) -> Runs:
    """The runs of a level, by the counts and numbers of the level below (None: the words)."""
    size, parts = len(tokens.count), model.parts
    if below is None:
        at, shorter, count, number, sole = np.arange(len(tokens.word), dtype=np.int32), tokens.word, tokens.count, tokens.number, tokens.sole
        history = np.where(tokens.place > 0, np.roll(tokens.word, 1), np.int32(size - 1))
    else:
        at, shorter, count, number, sole = np.flatnonzero(tokens.place >= level - 2).astype(np.int32), below.run_at, below.count, below.number, below.sole
        history = shorter[at - 1]
    # Codes in the order of the question, by partition and number, so that runs come out in it.
    part, bits = (number % parts).astype(np.int32), size.bit_length()
    by_part, by_word = in_order(joined(part.astype(np.int64), number // parts))[1], in_order(tokens.number)[1]
    place, place_of_word = np.empty(len(count), np.int64), np.empty(size, np.int64)
    place[by_part], place_of_word[by_word] = np.arange(len(count)) << bits, np.arange(size)
    key = place[history]
    key |= place_of_word[tokens.word[at]]
    key, first, of = distinct(key)
    run_at = np.full(len(tokens.word), -1, np.int32)
    run_at[at] = of
    told = np.bincount(of[tokens.train[at]], minlength=len(key))
    one, two, suffix = (x.astype(np.int32) for x in (by_part[key >> bits], by_word[key & (1 << bits) - 1], shorter[at[first]]))
    del place, place_of_word, first, history
    spread = (count * HOT_SHARE > model.tokens) & ~sole
    if below is None:
        spread[-1] = True  # the start
    alone, ends, wide = sole[one], sole[suffix], spread[one]
    kept = (count[one] > 0) & (count[suffix] > 0) & ~alone

    def split(chosen: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Runs by partition, those of spread histories by the partitions of their words."""
        own, far = np.flatnonzero(chosen & ~wide).astype(np.int32), np.flatnonzero(chosen & wide).astype(np.int32)
        target = tokens.number[two[far]] % parts
        order = np.lexsort((number[one[far]], target))
        return dealt(own, part[one[own]], parts), dealt(far[order], target[order], parts)

    past = np.zeros(len(count), bool)
    past[one[told == 0]] = True
    past = by_part[(past & (count > 0) & ~spread & ~sole)[by_part]]
    asked = list(zip(*split(kept & ~ends), *split(kept & ends & (told > 0)), dealt(past, part[past], parts)))
    more, sole = np.flatnonzero(alone & (told > 0)), alone | ends
    zero = np.zeros(len(key), np.int64)
    return Runs(at, of, run_at, one, two, suffix, told, asked, more, spread, sole, told * sole, zero, np.ones(len(count)), np.zeros(len(count)))


def question(batch: int, tokens: Tokens, below: Runs | None, runs: Runs, parts: int) -> pa.Table:
    count, number = (tokens.count, tokens.number) if below is None else (below.count, below.number)
    out, more = [], np.asarray(_histogram(runs.told[runs.more]))
    for part, (own, wide, own_ends, wide_ends, past) in enumerate(runs.asked):
        here = more if part == batch % parts and more.any() else more[:0]
        if len(own) or len(wide) or len(own_ends) or len(wide_ends) or len(past) or len(here):
            both, ends = np.concatenate([own, wide]), np.concatenate([own_ends, wide_ends])
            two, lower = tokens.number[runs.word[both]], count[runs.suffix[both]]
            if below is None:  # the counts belong to the words: once for each, and frequent ones have small numbers
                lower = changes(lower[distinct(two)[1]])
            columns = (
                steps(number[runs.history[own]] // parts), steps(number[runs.history[wide]]), two, runs.told[np.concatenate([both, ends])], lower,
                steps(number[past] // parts), steps(number[runs.history[own_ends]] // parts), steps(number[runs.history[wide_ends]]), count[runs.suffix[ends]], here,
            )
            out.append((part, batch, *(packed(x) if len(x) else None for x in columns)))
    names = [f.split()[0] for f in QUESTION.split(", ")]
    types = [pa.int32(), pa.int64()] + [pa.binary()] * (len(names) - 2)
    columns = list(zip(*out)) or [[]] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)


def add_runs(factors: np.ndarray, level: int, last: bool) -> Callable:
    """``factors`` are the discounts of the level below; the last level needs no numbers."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        """A partition of a level's table: totals and numbers of the runs, and sums of the histories' words."""
        table, part = table.sort_by("batch"), key[0].as_py()

        def column(name: str) -> Iterator[np.ndarray]:
            return map(unpacked, table[name].to_pylist())

        own, wide, own_ends, wide_ends, past = ([np.cumsum(x) for x in column(c)] for c in ("own", "wide", "own_ends", "wide_ends", "past"))
        # Histories are known here by their places, spread ones by their numbers beyond those.
        base = 1 + max(int(x[-1]) for found in (own, own_ends, past, [np.zeros(1, np.int64)]) for x in found if len(x))
        ones = [np.concatenate([x, y + base]) for x, y in zip(own, wide)]
        ends = [np.concatenate([x, y + base]) for x, y in zip(own_ends, wide_ends)]
        del own, wide, own_ends, wide_ends
        one = np.concatenate(ones)
        first, which = distinct(joined(one, np.concatenate(list(column("two")))))[1:]
        one, told = one[first], list(column("told"))  # columns are unpacked when their turn comes: one at a time
        total = np.bincount(which, weights=np.concatenate([t[: len(x)] for t, x in zip(told, ones)]), minlength=len(first)).astype(np.int64)
        told = np.concatenate([t[len(x):] for t, x in zip(told, ones)])
        lower = column("lower") if level > 2 else (undone(x)[distinct(w)[2]] for x, w in zip(column("lower"), column("two")))
        lower = np.concatenate([np.concatenate(list(lower))[first], *column("ends_lower")])
        place = np.maximum(np.cumsum(total > 0) - 1, 0)
        times = np.concatenate([total, told])
        history, _, of = distinct(np.concatenate([one, *ends]))
        sums = np.zeros((len(history) + 1, SUMS))
        sums[:-1, :MOST] = np.bincount(of * np.int64(SUMS + 1) + np.minimum(times, SUMS), minlength=len(history) * (SUMS + 1)).reshape(-1, SUMS + 1)[:, 1:SUMS]
        sums[:-1, MOST] = np.bincount(of, weights=discounted(lower, factors) * (times > 0), minlength=len(history))
        mask = (sums[:-1, :MOST] > 0) @ (1 << np.arange(MOST))
        value = times << 1
        if not last:
            value[: len(total)] |= np.bincount(which, minlength=len(total)) == 1
        value = value << MOST | mask[of]
        out, at, end = [], 0, len(total)
        for batch, asked, ended, wanted in zip(table["batch"].to_pylist(), ones, ends, past):
            mine = which[at : at + len(asked)]
            mine_ends = np.arange(end, end + len(ended))
            at, end = at + len(asked), end + len(ended)
            row = np.searchsorted(history, wanted)
            row = np.where(np.append(history, -1)[row] == wanted, row, len(history))
            chosen = sums[row]
            columns = packed(value[np.concatenate([mine, mine_ends])]), packed(changes(place[mine][: 0 if last else None])), packed(chosen[:, :MOST].T.reshape(-1)), packed(chosen[:, MOST], "<f8")
            out.append((part, batch, 0, *(len(x).to_bytes(4, "little") + x + y for x, y in (columns[:2], columns[2:]))))
        stats = np.sum([_histogram(times), *(x for x in column("more") if len(x))], axis=0)
        out.append((part, -1, 1, stats.astype("<i8").tobytes(), None))
        hot = np.flatnonzero(history >= base)
        out.append((part, -1, 2, (history[hot] - base).astype("<i8").tobytes(), sums[:-1][hot].astype("<f8").tobytes()))
        return answers(out)

    return add


def _two(data: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(data[:4], "little")
    return data[4 : 4 + n], data[4 + n :]


def learn(runs: Runs, rows: list[dict], tokens: Tokens, below: Runs | None, level: int, model: Model) -> None:
    """Fill in what the answers of a level's table say."""
    factors, hot = model.factors[level - 1], model.spread[level - 2]
    count, number = (tokens.count, tokens.number) if below is None else (below.count, below.number)
    ratio, r = 1 - factors, np.arange(1, MOST + 1)
    # What the counts after each history's shorter history are divided by.
    shorter = np.full(len(count), model.below)
    if below is not None:
        shorter[runs.history] = below.below[below.history[runs.suffix]]

    def backoff(codes: np.ndarray, left: np.ndarray, lower: np.ndarray) -> None:
        runs.below[codes] = np.where(left > 0, count[codes], count[codes] + 1)
        runs.weight[codes] = np.log10(np.where(left > 0, left, 1.0) / runs.below[codes]) - np.log10(1 - lower / shorter[codes])

    some = (np.arange(1 << MOST)[:, None] >> (r - 1) & 1) @ (ratio * r) > 0
    for row in rows:
        own, wide, own_ends, wide_ends, past = runs.asked[row["part"]]
        (value, place), (whole, low) = _two(row["a"]), _two(row["b"])
        mine, value, place = np.concatenate([own, wide, own_ends, wide_ends]), unpacked(value), undone(unpacked(place))
        codes = runs.history[mine]
        runs.below[codes] = count[codes] + ~some[value & (1 << MOST) - 1]
        mine, value = mine[: len(own) + len(wide)], value[: len(own) + len(wide)] >> MOST
        runs.count[mine], runs.sole[mine] = value >> 1, value & 1
        runs.number[mine[: len(place)]] = place * model.parts + row["part"]
        if len(past):
            backoff(past, (ratio * r) @ unpacked(whole).reshape(MOST, -1), unpacked(low))
    if len(runs.more):
        codes, told = runs.history[runs.more], runs.told[runs.more]
        left = np.bincount(codes, np.concatenate([[0.0], ratio * r, [0.0]])[np.minimum(told, MOST + 1)], len(count))
        lower = np.bincount(codes, discounted(count[runs.suffix[runs.more]], model.factors[level - 2]), len(count))
        codes = np.flatnonzero(lower)  # what follows a history has a count after the shorter one
        backoff(codes, left[codes], lower[codes])
    if hot:
        names = np.asarray(sorted(hot), np.int64)
        at = np.minimum(np.searchsorted(names, number), len(names) - 1)
        here = np.flatnonzero((names[at] == number) & runs.spread & (count > 0))
        sums = np.stack([hot[int(k)] for k in names])[at[here]]
        backoff(here, sums[:, :MOST] @ (ratio * r), sums[:, MOST])


def levels_of(table: pa.Table, model: Model, top: int) -> tuple[Tokens, list[Runs]]:
    """A batch with its runs of the levels 2 to ``top``, as far as answers came."""
    rows = table.to_pylist()
    tokens, found = tokens_of(rows, model), []
    for level in range(2, top + 1):
        below = found[-1] if found else None
        runs = runs_of(tokens, below, level, model)
        if len(model.factors) >= level:
            learn(runs, [r for r in rows if r["step"] == level], tokens, below, level, model)
            runs.asked, runs.told, runs.more = [], runs.told[:0], runs.more[:0]  # answered
        found.append(runs)
    return tokens, found


def ask_runs(model: Model, level: int) -> Callable:
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        tokens, found = levels_of(table, model, level)
        return question(key[0].as_py(), tokens, found[-2] if level > 2 else None, found[-1], model.parts)

    return ask


# -------------------------------------------------------------------------------------- scores
def judge(model: Model, order: int) -> Callable:
    def score(key: tuple, table: pa.Table) -> pa.Table:
        tokens, found = levels_of(table, model, order)
        known = tokens.count > 0
        chance = np.log10(np.where(known, discounted(tokens.count, model.factors[0]) / model.below, model.rest))
        flat = np.log10((tokens.count + 1) / (model.tokens + model.distinct + 1))
        of_token = chance[tokens.word]
        for runs, factors in zip(found, model.factors[1:]):
            with np.errstate(divide="ignore"):
                direct = np.log10(discounted(runs.count, factors)) - np.log10(runs.below[runs.history])
            chance = np.where(runs.count > 0, direct, runs.weight[runs.history] + chance[runs.suffix])
            of_token[runs.at] = chance[runs.of]
        doc = np.repeat(np.arange(len(tokens.lengths)), tokens.lengths + 1)

        def add(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, weights=x, minlength=len(tokens.lengths))

        return pa.table({
            "doc_id": tokens.docs, "n_tokens": tokens.lengths + 1, "n_known": add(known[tokens.word]).astype(np.int64),
            "train_tokens": np.full(len(tokens.lengths), model.tokens), "base_score": add(flat[tokens.word]), "score": add(of_token),
        })

    return score


def _numbers(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(a, "<i8").tolist() for a in batch["a"].to_pylist()], pa.list_(pa.int64()))], ["n"])


def totals(found: DataFrame, size: int) -> list[int]:
    """The partitions' totals, added up."""
    rows = found.where("kind = 1").select("a").mapInArrow(_numbers, "n array<bigint>")
    return [int(x or 0) for x in rows.agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(size)]).first()]


def _listed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            sums = np.frombuffer(b, "<f8").reshape(-1, SUMS)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, "<i8")), *map(pa.array, sums.T)], ["name", *[f"s{i}" for i in range(SUMS)]])


def spread_sums(found: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the spread histories: at most HOT_SHARE of them and the start, whatever the input."""
    rows = found.where("kind = 2").select("a", "b").mapInArrow(_listed, "name long, " + ", ".join(f"s{i} double" for i in range(SUMS)))
    return {r[0]: np.asarray(r[1:]) for r in rows.groupBy("name").agg(*[F.sum(f"s{i}") for i in range(SUMS)]).collect()}


def katz_scores(docs: DataFrame, train: Column, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES, order: int = ORDER) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of (doc_id, text).

    The model has runs of up to ``order`` words, learns from the rows for which ``train`` holds and scores all. A
    text is its words, with A-Z in lower case, and one end; NULL is the empty text, just an end. Repeated rows count
    and are scored one by one, with a NULL id too; without any training row all scores are 0; an empty table gives no
    rows. Words are told apart by 64-bit hashes, longer runs by exact numbers.
    """
    size, texts = docs.agg(F.sum(F.octet_length("text")), F.count_if(F.coalesce(train, F.lit(False)))).first()
    parts = max(1, ceil((size or 0) / part_bytes))
    word_parts, part_tasks = ceil(parts / WORD_SHARE), ceil(parts / TASK_SHARE)
    tasks = max(1, ceil((size or 0) / batch_bytes / TASK_SHARE))
    path = scratch_path(docs.sparkSession, "batches")
    batches_of(docs, train, word_parts, batch_bytes).write.partitionBy("kind").parquet(path)
    batches = docs.sparkSession.read.schema(f"{BATCH}, kind int").parquet(path)
    asked = batches.where("kind = 1").select(ASKS).mapInArrow(ask_words(word_parts), "part int, batch long, a binary, b binary")
    found = stored(asked.repartition(ceil(word_parts / TASK_SHARE), "part").groupBy("part").applyInArrow(add_words(word_parts), ANSWER), "words")
    drop_stored(docs.sparkSession, f"{path}/kind=1")
    distinct, tokens, *times = totals(found, MOST + 3)
    model = Model.of(parts, word_parts, int(texts), distinct, tokens, times)

    empty = F.lit(None).cast("binary")
    kept = ["docs", "blank", "lengths", "train", "codes", "top"]
    columns = ["batch", "part", "step", *kept, "a", "b"]
    known = batches.where("kind = 0").withColumns({"part": F.lit(-1), "step": F.lit(0), "a": empty, "b": empty}).select(columns)

    def with_answers(found: DataFrame, step: int) -> DataFrame:
        return known.unionByName(found.where("kind = 0").withColumns({c: empty for c in kept} | {"step": F.lit(step)}).select(columns))

    known = with_answers(found, 1)
    for level in range(2, order + 1):
        questions = known.repartition(tasks, "batch").groupBy("batch").applyInArrow(ask_runs(model, level), QUESTION)
        found = stored(questions.repartition(part_tasks, "part").groupBy("part").applyInArrow(add_runs(model.factors[-1], level, level == order), ANSWER), "runs")
        factors = discounts(totals(found, MOST + 1))
        model = replace(model, factors=(*model.factors, factors), spread=(*model.spread, spread_sums(found)))
        known = with_answers(found, level)
    result = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return known.repartition(tasks, "batch").groupBy("batch").applyInArrow(judge(model, order), result)
