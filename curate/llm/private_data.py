"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Patterns give the base spans, which always stay. Around them lie candidates that the plain patterns
miss or swallow: numbers run together, a phone number followed by another number, addresses with
"at" and "dot" written out. Six labelers (check, shape, gazetteer, cue words, surroundings, company)
vote yes, no or nothing on every candidate, base span and near miss. The votes and traits of all documents
are counted in Spark, a few hundred patterns whatever the input; expectation-maximisation, with base spans
held true and near misses held false, estimates how far each labeler is to be trusted, and a logistic
classifier learns from the resulting probabilities.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.session import stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 60
RIDGE = 1.0
FLOOR = 0.05
"""Least probability of any vote, in either case: a vote not seen so far says nothing."""
PASSES = {"email": 0.5, "ip": 0.2, "card": 0.1, "phone": 0.5}
"""Share of strings of the right form, but not of the kind, that the kind's check lets pass: a tenth have a right check digit."""

# The base patterns, each written so that no text costs more than its length: possessive runs, and
# addresses found by their sign and extended to the left.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Candidates beside them.
WRITTEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?(?:\[at\]|\(at\)|\{at\}|@) ?)[A-Za-z0-9-]{1,63}"
    r"(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\[\.\]) ?|\.)[A-Za-z0-9-]{1,63})++",
    re.IGNORECASE,
)
DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9.])")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)++")
GROUPS = re.compile(r"[0-9]+")
NATIONAL = re.compile(r"(?<![0-9+.()-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[-.])[2-9][0-9]{2}[-.][0-9]{4}(?![0-9.-]?[0-9])")
CARD_LAYOUTS = frozenset({(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (14,), (15,), (16,), (17,), (18,), (19,)})
SPELT = re.compile(r"[\[({](?:at|dot|\.)[\])}]", re.IGNORECASE)
MARKS = re.compile(r"[0-9@]|[\[({]at[\])}]", re.IGNORECASE)

# Gazetteers and cue words.
TOP_LEVEL = frozenset("com org net edu gov info io de fr es it uk eu ch at nl be pl se us ca au jp cn in br ru example test".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|[45])|35")
COUNTRY = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9])")
CUES = {
    "email": re.compile(r"mail|contact|write to|correo|courriel|schreib", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|adresse|direcci|login|from", re.I),
    "card": re.compile(r"card|karte|tarjeta|carte|visa|master|amex|payment|zahl", re.I),
    "phone": re.compile(r"phone|call|\btel|fax|mobil|handy|fono|appel", re.I),
}
AGAINST = re.compile(r"version|\bv$|\bid\b|isbn|order|build|serial|token|sha|hash|invoice|ticket|=\s*[\"']?$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def holds(kind: str, found: str) -> bool:
    """The check that a span of the kind has to pass."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in GROUPS.findall(found))
    digits = digits_of(found)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


Span = tuple[int, int, int]  # place of the kind in KINDS, start, end


def matches(text: str) -> Iterator[Span]:
    """Leftmost matches that do not overlap, for each kind, before any check."""
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield 0, start, m.end()
            done = m.end()
    for kind, pattern in ((1, DOTTED), (2, DIGITS), (3, PHONE)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def candidates(text: str, failed: list[Span]) -> Iterator[Span]:
    """Spans that the base misses: parts of matches that failed, and other ways to write them."""
    if SPELT.search(text):
        for m in WRITTEN.finditer(text):
            yield 0, m.start(), m.end()
        for m in DEFANGED.finditer(text):
            yield 1, m.start(), m.end()
    for m in NATIONAL.finditer(text):
        yield 3, m.start(), m.end()
    chain = -1
    for kind, start, end in failed:
        if kind == 1:
            whole = CHAIN.match(text, start)
            if whole.start() <= chain:
                continue
            chain = whole.end()
            groups = [(m.start(), m.end()) for m in GROUPS.finditer(text, *whole.span())]
            for i in range(1, len(groups) - 3):
                yield 1, groups[i][0], groups[i + 3][1]
        elif kind == 2:
            groups = [(m.start(), m.end()) for m in GROUPS.finditer(text, start, end)]
            for i in range(len(groups)):
                for n in (1, 3, 4, 5):
                    some = groups[i : i + n]
                    if len(some) == n < len(groups) and tuple(b - a for a, b in some) in CARD_LAYOUTS:
                        yield 2, some[0][0], some[-1][1]
        elif kind == 3:
            size = 0
            for m in GROUPS.finditer(text, start, end):
                size += m.end() - m.start()
                if size > 15:
                    break
                if size >= 10:
                    yield 3, start, m.end()


def _vote(yes: bool, no: bool) -> str:
    return "+" if yes else "-" if no else "0"


def votes(text: str, kind: str, start: int, end: int, company: bool) -> str:
    """A character for each labeler: + for yes, - for no, 0 for nothing to say."""
    found, before = text[start:end], text[max(0, start - 40) : start]
    near, after = text[start - 1 : start], text[end : end + 1]
    sizes = tuple(len(g) for g in GROUPS.findall(found))
    if kind == "email":
        shape = _vote(bool(re.fullmatch(r"[\w.%+-]{2,}@(?:[\w-]+\.)+[A-Za-z]{2,}", found)), not re.search(r"[A-Za-z]", found))
        known = _vote(re.split(r"[^A-Za-z0-9]+", found.rstrip("-"))[-1].lower() in TOP_LEVEL, found[-1:].isdigit())
    elif kind == "ip":
        shape = _vote(all(n <= 3 for n in sizes) and not re.search(r"(?:^|\D)0[0-9]", found), True)
        known = _vote(1 <= int((GROUPS.findall(found) or ["0"])[0][-4:]) <= 254, True)
    elif kind == "card":
        shape = _vote(sizes in CARD_LAYOUTS and len(set(re.sub(r"[0-9]", "", found))) <= 1, True)
        known = _vote(bool(ISSUERS.match(found)), False)
    else:
        shape = _vote(len(sizes) >= 3 and max(sizes) <= 5, len(sizes) == 1 or max(sizes) > 11)
        known = _vote(bool(COUNTRY.match(found)) or bool(NATIONAL.fullmatch(found)), True)
    check = _vote(holds(kind, found), True)
    cue = _vote(bool(CUES[kind].search(before)), bool(AGAINST.search(before)))
    around = _vote(not re.match(r"[\w@#/+.=-]", near) and not re.match(r"[\w@#/+=-]", after), bool(re.match(r"\w|[@#/=]", near + after)))
    return check + shape + known + cue + around + _vote(company, False)


def traits(found: str) -> str:
    """Form of a span: how many digits, and what parts them."""
    n = len(digits_of(found))
    parts = {c for c in found if c in " .-()"}
    return f"{min(n // 4, 5)}{'n' if not parts else 'u' if len(parts) == 1 else 'm'}"


def free(taken: list[tuple[int, int]], span: tuple[int, int]) -> bool:
    """Whether a span lies over none of the ones taken, which are in order and apart."""
    at = bisect_left(taken, span)
    return not (at < len(taken) and taken[at][0] < span[1]) and not (at and taken[at - 1][1] > span[0])


def near_miss(kind: str, found: str) -> bool:
    """Whether a match that failed its check looks like the kind all the same; most are just numbers."""
    n = len(digits_of(found))
    return kind == "ip" or kind == "card" and 12 <= n <= 24 or kind == "phone" and 7 <= n <= 24


def inspect(text: str) -> tuple[list[Span], list[Span], list[str]]:
    """(base spans, other candidates, a pattern for each of them and each near miss: kind, votes, traits, role)."""
    if not MARKS.search(text):
        return [], [], []
    base, failed = [], []
    for span in matches(text):
        (base if holds(KINDS[span[0]], text[span[1] : span[2]]) else failed).append(span)
    own = {k: sorted(s[1:] for s in base if s[0] == k) for k in range(len(KINDS))}
    more = [s for s in dict.fromkeys(candidates(text, failed)) if free(own[s[0]], s[1:])]
    company, known = len(base) > 1, set(more)
    misses = [s for s in failed if s not in known and near_miss(KINDS[s[0]], text[s[1] : s[2]])]
    patterns = [
        f"{KINDS[k]}:{votes(text, KINDS[k], a, b, company)}:{traits(text[a:b])}:{role}"
        for role, spans in (("base", base), ("more", more), ("miss", misses))
        for k, a, b in spans
    ]
    return base, more, patterns


# -------------------------------------------------------------------------------------- the models
def reliabilities(kind: str, patterns: list[tuple[str, str]], counts: np.ndarray) -> np.ndarray:
    """Probability that a span with each (votes, role) is personal data, by expectation-maximisation.

    Given the truth, labelers vote independently. Base spans are held true and near misses false; how
    often a labeler says what of either is estimated, but for the check, the first, which parted the two:
    of false strings it passes the share that ``PASSES`` tells.
    """
    seen = np.asarray([["-0+".index(v) for v in said] for said, _ in patterns])
    held = np.asarray([{"base": 1.0, "miss": 0.0}.get(role, np.nan) for _, role in patterns])
    free = np.isnan(held) & (seen[:, 0] == 2)
    p = np.where(free, 1 / (1 + np.exp(-(seen - 1.0).sum(axis=1))), np.nan_to_num(held))
    for _ in range(ROUNDS):
        chance = np.empty((len(patterns), 2))
        for truth, weight in ((0, counts * (1 - p)), (1, counts * p)):
            total = np.log((weight.sum() + 1) / (counts.sum() + 2)) + np.zeros(len(patterns))
            total += np.log(0.99 if truth else PASSES[kind])
            for j in range(1, seen.shape[1]):
                said = np.bincount(seen[:, j], weights=weight, minlength=3) + 1e-9
                total += np.log((1 - 3 * FLOOR) * said / said.sum() + FLOOR)[seen[:, j]]
            chance[:, truth] = total
        new = np.where(free, 1 / (1 + np.exp(np.clip(chance[:, 0] - chance[:, 1], -500, 500))), p)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p


def design(patterns: list[tuple[str, str]], names: dict[str, int]) -> np.ndarray:
    """Indicator columns of the votes and traits of each (votes, traits), and a constant."""
    out = np.zeros((len(patterns), len(names) + 1))
    out[:, -1] = 1
    for i, (said, form) in enumerate(patterns):
        for name in signs(said, form):
            out[i, names[name]] = 1
    return out


def signs(said: str, form: str) -> list[str]:
    return [f"{j}{v}" for j, v in enumerate(said)] + [f"n{form[0]}", f"f{form[1]}"]


def logistic(a: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (weight * (p * (1 - p) + 1e-9))) @ a + ridge * np.eye(len(w)), a.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return w


@dataclass(frozen=True)
class SpanClassifier:
    """Probability of every pattern that the table holds."""

    chance: dict[str, float]

    @staticmethod
    def fit(counted: list[tuple[str, int]]) -> SpanClassifier:
        """From (kind:votes:traits:role, how often) rows."""
        chance: dict[str, float] = {}
        for kind in KINDS:
            mine = sorted((p.split(":")[1:], n) for p, n in counted if p.startswith(kind + ":"))
            if not mine:
                continue
            n = np.asarray([n for _, n in mine], float)
            truth = reliabilities(kind, [(said, role) for (said, _, role), _ in mine], n)
            forms = [(said, form) for (said, form, _), _ in mine]
            names = {k: i for i, k in enumerate(sorted({s for f in forms for s in signs(*f)}))}
            a = design(forms, names)
            p = 1 / (1 + np.exp(-np.clip(a @ logistic(a, truth, n), -30, 30)))
            chance |= {f"{kind}:{':'.join(parts)}": float(x) for (parts, _), x in zip(mine, p)}
        return SpanClassifier(chance)

    def added(self, more: list[Span], patterns: list[str], valid: list[bool], least: float) -> list[Span]:
        """The candidates taken: likeliest first, none over another one."""
        ranked = sorted((-self.chance.get(p, 0.0), s) for s, p, v in zip(more, patterns, valid) if v)
        taken: list[tuple[int, int]] = []
        found: list[Span] = []
        for chance, span in ranked:
            if -chance >= least and free(taken, span[1:]):
                insort(taken, span[1:])
                found.append(span)
        return found


FOUND = "base array<long>, more array<long>, valid array<boolean>, patterns array<string>"


def find_private_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """(``keep``…, base, spans): ARRAY<STRUCT<kind, start, end>> of each row, in the order of start and kind.

    ``start`` and ``end`` count code points, the end excluded. ``base`` are the spans that the patterns find and
    the checks accept; ``spans`` are those and the candidates that pass their kind's check and that the
    classifier gives a probability of ``least`` or more. The classifier learns from all rows of this table.

    A NULL or empty text has no spans; repeated rows are searched and counted one by one; an empty table gives
    no rows; columns not in ``keep`` are not read and may have any name.
    """
    names = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col("text").cast("string").alias("__text"))
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.drop("__text").dtypes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                base, more, valid, patterns = [], [], [], []
                for text in part["__text"].to_pylist():
                    b, m, p = inspect(text or "")
                    base.append([x for s in b for x in s])
                    more.append([x for s in m for x in s])
                    valid.append([holds(KINDS[k], text[x:y]) for k, x, y in m])
                    patterns.append(p)
                found = [pa.array(base, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64())), pa.array(valid, pa.list_(pa.bool_())), pa.array(patterns, pa.list_(pa.string()))]
                own = part.drop_columns(["__text"])
                yield pa.RecordBatch.from_arrays([*own.columns, *found], [*own.schema.names, "base", "more", "valid", "patterns"])

    # Spans without their texts: small beside the table.
    found = stored(rows.mapInArrow(look, f"{kept}, {FOUND}"), "spans")
    # At most 4 kinds * 3^6 votes * 18 forms * 3 roles.
    counted = found.select(F.explode("patterns").alias("p")).groupBy("p").count().collect()
    model = SpanClassifier.fit([(r["p"], r["count"]) for r in counted])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

        def listed(spans: list[Span]) -> list[dict]:
            return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted((a, k, b) for k, a, b in spans)]

        for batch in batches:
            base_, all_ = [], []
            for b, m, v, p in zip(*(batch[c].to_pylist() for c in ("base", "more", "valid", "patterns"))):
                base, more = ([tuple(x[i : i + 3]) for i in range(0, len(x), 3)] for x in (b, m))
                base_.append(listed(base))
                all_.append(listed(base + model.added(more, p[len(base) :], v, least)))
            own = batch.select(names)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(base_, pa.list_(kind)), pa.array(all_, pa.list_(kind))], [*names, "base", "spans"])

    span = "array<struct<kind string, start bigint, end bigint>>"
    decided = found.mapInArrow(decide, f"{kept}, base {span}, spans {span}")
    return decided.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "base", "spans")
