"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context, only that
reply is trainable. Turns after the last assistant turn (or a conversation without one) give one
closing example with nothing to train on, so the output still holds the whole conversation.

Template: ``[INST role]text[/INST]`` for every other role, ``<s>text</s>`` for the assistant.
``&``, ``<``, ``[`` and ``]`` inside a text or role are written as entities, so no text can
forge a marker and every text reads back exactly.

Defined cases: null text or role counts as empty; equal turn numbers are ordered by role, then
text, null turns first; repeated rows are turns of their own; rows with a null conv_id form one
conversation; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Written in this order, read back in reverse.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("]", "&rb;"))
TARGET_ROLE = "assistant"
_TURN_END = r"(?<=\[/INST\])|(?<=</s>)"
_OPEN, _CLOSE = "<s>", "</s>"


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_length): one row per example.

    ``example`` numbers a conversation's examples from 0. The loss mask covers the code points
    ``loss_start`` (0-based) to ``loss_start + loss_length`` of ``formatted``; the closing
    example has length 0 and a null start. A prefix is gathered per row by a window over its
    conversation, so one task holds one example at a time.
    """
    clean = turns.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    target = F.col("role") == TARGET_ROLE
    body = escape(F.col("text"))
    clean = clean.withColumn("_body", body).withColumn("_marked", F.when(
        target, F.concat(F.lit(_OPEN), "_body", F.lit(_CLOSE))
    ).otherwise(F.concat(F.lit("[INST "), escape(F.col("role")), F.lit("]"), "_body", F.lit("[/INST]"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = target | F.lead("role").over(order).isNull()
    rows = clean.select(
        "conv_id", target.alias("_target"), wanted.alias("_wanted"), F.length("_body").alias("_length"),
        (F.count(F.when(target, 1)).over(upto) - target.cast("int")).alias("example"),
        F.collect_list("_marked").over(upto).alias("_prefix"))
    made = rows.filter("_wanted").withColumn("formatted", F.concat_ws("", "_prefix"))
    return made.select(
        "conv_id", F.col("example").cast("long").alias("example"), "formatted",
        F.when(F.col("_target"), F.length("formatted") - len(_CLOSE) - F.col("_length")).alias("loss_start"),
        F.when(F.col("_target"), F.col("_length")).otherwise(0).alias("loss_length"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example: array of (role, text)."""

    def read(marked: Column) -> Column:
        spoken = marked.startswith("<s>")
        role = F.when(spoken, F.lit(TARGET_ROLE)).otherwise(
            unescape(F.regexp_extract(marked, r"^\[INST ([^\]]*)\]", 1)))
        text = F.when(spoken, F.regexp_extract(marked, r"^<s>([^<]*)</s>$", 1)).otherwise(
            F.regexp_extract(marked, r"^\[INST [^\]]*\]([^\[]*)\[/INST\]$", 1))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.filter(F.split(formatted, _TURN_END), lambda x: x != ""), read)


def masked_text(formatted: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example, unescaped; empty without a mask."""
    return unescape(F.when(start.isNull(), F.lit("")).otherwise(F.substring(formatted, start + 1, length)))


def digest(examples: DataFrame) -> DataFrame:
    """One row per conversation, computed only from the formatted examples."""
    last = examples.groupBy("conv_id").agg(
        F.max("example").alias("example"), F.sum(F.length("formatted")).alias("formatted_chars"))
    spoken = examples.select(
        "conv_id", "example", masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("_said"))
    said = spoken.groupBy("conv_id").agg(
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("example", "_said"))), lambda x: x["_said"])).alias("_loss"))
    e, m, s = examples.alias("e"), last.alias("m"), said.alias("s")
    whole = e.join(m, F.col("e.conv_id").eqNullSafe(F.col("m.conv_id")) & (F.col("e.example") == F.col("m.example"))).select(
        F.col("e.conv_id").alias("conv_id"), read_turns(F.col("e.formatted")).alias("_turns"), "formatted_chars").alias("w")
    line = F.concat_ws("", F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return whole.join(s, F.col("w.conv_id").eqNullSafe(F.col("s.conv_id"))).select(
        F.col("w.conv_id").alias("conv_id"),
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))
