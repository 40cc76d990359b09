"""Chat formatting with prefix-target expansion.

A conversation is formatted once. Its k-th example is the text from its start to the end of its
k-th assistant turn, of which only that reply is trained on. Examples are kept as spans of the one
text: written out, a conversation of n turns would take n*n/4 of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curate.llm.common import text_of

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "</s>\n"
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])|\|(?=>)"
"""First characters of strings that steer a chat model. A backslash behind them breaks the string up."""


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """(conv_id, formatted, replies ARRAY<STRUCT<turn INT, start INT, length INT>>) of (conv_id, turn, role, text).

    ``replies`` are the trained spans, in characters from 0. Turns come in the order of ``turn``, NULL
    first, then role and text; repeated turns stay; a NULL role or text is empty; rows with a NULL
    ``conv_id`` are one conversation; an empty table gives no rows. A conversation is one row of the
    output, so it has to fit into a task's memory; spread over many tasks are the conversations.
    """
    role, text = text_of(F.col("role").cast("string")), text_of(F.col("text").cast("string"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("raw"))
    rows = rows.withColumns({"head": F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE)), "body": escaped(F.col("raw"))})
    earlier = Window.partitionBy("conv_id").orderBy("turn", "role", "raw").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("head") + F.length("body") + len(CLOSE)
    rows = rows.withColumns(
        {"at": F.coalesce(F.sum(length).over(earlier), F.lit(0)).cast("int"), "i": F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "raw"))}
    )
    span = F.struct((F.col("i") - 1).alias("turn"), (F.col("at") + F.length("head")).alias("start"), F.length("body").alias("length"))
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("i", "head", "body"))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("role") == trainable, span))).alias("replies"),
    )
    written = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))
    return grouped.select("conv_id", F.array_join(written, "").alias("formatted"), "replies")


def examples(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, text, loss_start, loss_length): one written-out example for each assistant turn.

    Its text is the prefix of the conversation, which is the context, with the reply as target. Only the
    ``loss_length`` characters from ``loss_start``, the reply, are trained on.
    """
    wide = formatted.select("conv_id", "formatted", F.inline("replies"))
    text = F.left("formatted", F.col("start") + F.col("length") + len(CLOSE))
    return wide.select("conv_id", "turn", text.alias("text"), F.col("start").alias("loss_start"), F.col("length").alias("loss_length"))


def replies_of(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, context_end, loss_start, loss_length, reply) of each of the :func:`examples`.

    The example's text has ``context_end`` characters. ``reply`` is what its loss mask leaves of that text.
    """
    masked = F.substr("text", F.col("loss_start") + 1, F.col("loss_length"))
    return examples(formatted).select("conv_id", "turn", F.length("text").alias("context_end"), "loss_start", "loss_length", unescaped(masked).alias("reply"))


def losses(examples: DataFrame) -> DataFrame:
    """(conv_id, loss): the replies of each conversation's examples from the shortest to the longest context."""
    said = F.sort_array(F.collect_list(F.struct("context_end", "turn", "reply")))
    return examples.groupBy("conv_id").agg(F.array_join(said["reply"], "").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns ARRAY<STRUCT<role, text>>, replies ARRAY<STRING>), parsed from the formatted text."""
    parts = F.filter(F.split("formatted", r"<\|"), lambda p: p != "")

    def turn(part: Column) -> Column:
        role = F.substring_index(part, MIDDLE, 1)
        body = F.substr(part, F.length(role) + len(MIDDLE) + 1, F.length(part) - F.length(role) - len(MIDDLE) - len(CLOSE))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    spans = F.transform("replies", lambda r: unescaped(F.substr("formatted", r["start"] + 1, r["length"])))
    return formatted.select("conv_id", "formatted", F.transform(parts, turn).alias("turns"), spans.alias("replies"))
