"""Document fingerprints from closed syncmers over words.

A text is a row of words. Of every run of K words (a k-mer), the inner runs of S words are hashed;
the k-mer is a closed syncmer if the least of them is its first or its last. Whether it is one
depends on its own words alone, so an edit elsewhere moves no anchor, and half a text keeps the
anchors of that half. The fingerprint is all anchors with their places, as text; likeness is read from their
whole sets. A sketch of the least hashes goes along as a short form for look-ups, and nothing is derived from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.functions.once import with_once
from curate.llm.common import SPACE, cuts, let, pieces_for, range_of, text_of

K, S = 4, 2
SKETCH = 96


def anchors(text: str | Column, k: int = K, s: int = S) -> Column:
    """ARRAY<STRUCT<pos INT, hash BIGINT>>: the closed syncmers with the place of their first word.

    A text of fewer than ``k`` words is one anchor as a whole; a text without words has none.
    """
    words = F.filter(F.split(text_of(text), f"[{SPACE}]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    width = k - s + 1

    def inner(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[h[i + j] for j in range(s)]))

    def pick(m: Column, i: Column, h: Column) -> Column:
        rest = [m[i + j] for j in range(1, width - 1)]
        edge = F.least(m[i], m[i + width - 1])
        closed = edge <= F.least(*rest) if len(rest) > 1 else edge <= rest[0] if rest else F.lit(True)
        return F.when(closed, F.struct(i.alias("pos"), F.xxhash64(*[h[i + j] for j in range(k)]).alias("hash")))

    def long(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - k)
        return let(inner(h), lambda m: F.array_compact(F.transform(starts, lambda i: pick(m, i, h))))

    def short(h: Column) -> Column:
        one = F.struct(F.lit(0).alias("pos"), F.xxhash64(h).alias("hash"))
        return F.filter(F.array(one), lambda _: F.size(h) > 0)

    return let(hashes, lambda h: F.when(F.size(h) >= k, long(h)).otherwise(short(h)))


def written(found: Column) -> Column:
    """All anchors as text, in their order: ``place:hash`` with the hash in hex digits, parted by blanks."""
    return F.array_join(F.transform(found, lambda a: F.concat(a["pos"].cast("string"), F.lit(":"), F.hex(a["hash"]))), " ")


def sketch(found: Column, size: int = SKETCH) -> Column:
    """The least 32-bit hashes of all distinct anchors as text, ascending, eight hex digits for each."""
    hashes = F.transform(found, lambda a: F.shiftrightunsigned(a["hash"], 32))
    least = F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)
    return F.array_join(F.transform(least, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of common anchors of two texts' distinct anchor hashes, all of them; two without anchors are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def with_next(
    docs: DataFrame, order: str, columns: dict[str, str], ties: tuple[str, ...] = (), pieces: int | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """Add the columns of the next row in the order of an integer column; after the last comes the first.

    The order is cut into ranges, each one's first row is also sent to the range before, and the next
    row is looked up inside the range, so there is one shuffle and no task that holds all rows. ``keys``
    has the same values of ``order`` where those of ``docs`` are dear to reach.
    """
    keys = docs if keys is None else keys
    at = cuts(keys, order, pieces or pieces_for(docs))
    rows = docs.withColumn("__piece", range_of(order, at))
    # One row for each range, of which there are at most ``pieces``.
    firsts = keys.select(range_of(order, at).alias("p"), F.col(order).alias("k")).groupBy("p").agg(F.min("k").alias("k"), F.count_if(F.col("k").isNull()).alias("nulls")).orderBy("p").collect()
    if not firsts:
        return docs.withColumns({new: F.col(old) for new, old in columns.items()})
    before = {r["p"]: firsts[i - 1]["p"] for i, r in enumerate(firsts)}
    heads = F.map_from_arrays(F.array(*[F.lit(r["p"]) for r in firsts]), F.array(*[F.struct(F.lit(None if r["nulls"] else r["k"]).cast("bigint").alias("k"), F.lit(before[r["p"]]).alias("to")) for r in firsts]))
    head = F.element_at(heads, F.col("__piece"))
    guest = F.struct(head["to"].alias("p"), F.lit(True).alias("guest"))
    own = F.struct(F.col("__piece").alias("p"), F.lit(False).alias("guest"))
    sent = F.when(F.col(order).cast("bigint").eqNullSafe(head["k"]), F.array(own, guest)).otherwise(F.array(own))
    wide = rows.withColumn("__to", F.explode(sent))
    names = {f"__n{i}": old for i, old in enumerate(columns.values())}
    wide = wide.select("*", F.col("__to.p").alias("__p"), F.col("__to.guest").alias("__guest")).drop("__to", "__piece")
    line = Window.partitionBy("__p").orderBy("__guest", F.col(order).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in ties])
    found = wide.withColumns({n: F.lead(F.struct(F.col(old).alias("v"))).over(line) for n, old in names.items()})
    return found.where(~F.col("__guest")).select(*docs.columns, *[F.col(f"{n}.v").alias(new) for n, new in zip(names, columns)])


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of (doc_id, text) and of each text with its second half replaced.

    ``fingerprint`` and ``edited_fingerprint`` hold every anchor with the place of its first word, in the order of
    the text, so ``near_edited`` and ``near_next`` follow from them: shares of common distinct hashes. Last come the
    sketches of ``SKETCH`` hashes and the anchors as arrays.

    The edited text has the last half of the code points (rounded down) replaced by as many first ones,
    or all, of the next document by ``doc_id``. NULL is the empty text, equal ids follow their texts'
    hashes, a table of one row is its own next, and an empty table gives no rows.
    """
    rows = docs.select("doc_id", text_of(F.col("text").cast("string")).alias("text"))
    # Texts alone are shuffled: the anchors of a text take more room than the text.
    near = with_next(rows.withColumn("tie", F.xxhash64("text")), "doc_id", {"next_text": "text"}, ("tie",), keys=docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    near = with_once(near.withColumn("n_chars", F.length("text").cast("bigint")), "edited", edited)
    for name, text in (("anchors", "text"), ("edited_anchors", "edited"), ("next_anchors", "next_text")):
        near = with_once(near, name, anchors(text))
    own, changed, after = (F.col(c)["hash"] for c in ("anchors", "edited_anchors", "next_anchors"))
    return near.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("anchors")).alias("fingerprint"),
        written(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"),
        likeness(own, after).alias("near_next"),
        sketch(F.col("anchors")).alias("sketch"),
        sketch(F.col("edited_anchors")).alias("edited_sketch"),
        "anchors",
        "edited_anchors",
    )
