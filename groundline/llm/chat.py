"""Chat transcripts rebuilt from event logs and rendered with a reversible template, in DataFrame functions only.

A log has a row per event: a message starts, a streamed delta adds text to it, an edit replaces its text,
a regeneration clears it and drops the messages that had followed. Messages are folded each on its own,
so the work on a conversation grows with its events.

Template: `<|turn|>role<|says|>text<|end|>` and a line end per message. In roles and texts every `<`, `[` and
backslash is followed by an added backslash, so no control string, ours or another template's in angle or
square brackets, stands in the output unless the template wrote it; taking the backslashes off gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """events(conv_id, seq, kind, message, role, text) -> (conv_id, message, start, role, text), the messages that remain.

    kind: start (role, maybe text), delta, edit, regenerate; others are ignored. Events stand by seq; ties by kind and
    text. Text is all since the last edit or regeneration, that edit's own included. A regeneration also drops messages
    that started between its own message's start and itself. Messages without a start event are dropped; null texts are
    empty, null roles stay null, null conversations are one conversation.
    """
    is_kind = lambda *k: F.col("kind").isin(*k)
    folded = events.where(is_kind("start", "delta", "edit", "regenerate")).groupBy("conv_id", "message").agg(
        F.min(F.when(is_kind("start"), F.col("seq"))).alias("start"),
        F.min_by("role", F.when(is_kind("start"), F.col("seq"))).alias("role"),
        F.max(F.when(is_kind("edit", "regenerate"), F.col("seq"))).alias("reset"),
        F.max(F.when(is_kind("regenerate"), F.col("seq"))).alias("again"),
        F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))).alias("parts"),
    )
    live = F.filter("parts", lambda p: (p["kind"] != "regenerate") & (F.col("reset").isNull() | (p["seq"] >= F.col("reset"))))
    folded = folded.where("start is not null").withColumn("text", F.array_join(F.transform(live, lambda p: p["text"]), ""))
    before = Window.partitionBy("conv_id").orderBy("start", "message").rowsBetween(Window.unboundedPreceding, -1)
    kept = folded.withColumn("dropped_at", F.max("again").over(before)).where("dropped_at is null or dropped_at < start")
    return kept.select("conv_id", "message", "start", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted): the messages by start, then number."""
    part = F.concat(F.lit(TURN), escaped(F.coalesce("role", F.lit(""))), F.lit(SAYS), escaped(F.coalesce("text", F.lit(""))), F.lit(END))
    listed = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "message", part.alias("part")))).alias("m"))
    return listed.select("conv_id", F.array_join(F.transform("m", lambda x: x["part"]), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted) -> the same with turns array<struct<role, text, loss>>; loss marks assistant texts."""
    turns = F.split("formatted", r"<\|end\|>\n", -1)
    halves = lambda t: F.split(t, r"<\|says\|>", 2)
    role = lambda t: unescaped(F.regexp_replace(F.get(halves(t), F.lit(0)), r"^<\|turn\|>", ""))
    return formatted.withColumn("turns", F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: F.struct(role(t).alias("role"), unescaped(F.get(halves(t), F.lit(1))).alias("text"), (role(t) == "assistant").alias("loss"))))


def turn_events(turns: DataFrame) -> DataFrame:
    """A table of whole turns as an event log: each row starts a message and streams its text in two deltas.

    Rows stand by turn, ties by role and text; repeated rows are turns of their own.
    """
    numbered = turns.select("conv_id", "role", "text", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long").alias("message"))
    half = F.expr("char_length(text) div 2").cast("int")
    kinds = F.array(
        F.struct(F.lit("start").alias("kind"), F.lit(0).alias("at"), F.lit("").alias("part")),
        F.struct(F.lit("delta").alias("kind"), F.lit(1).alias("at"), F.substring("text", F.lit(1), half).alias("part")),
        F.struct(F.lit("delta").alias("kind"), F.lit(2).alias("at"), F.substring("text", half + 1, F.char_length("text")).alias("part")),
    )
    return numbered.withColumn("e", F.explode(kinds)).select("conv_id", (F.col("message") * 3 + F.col("e.at")).alias("seq"), "e.kind", "message", "role", F.col("e.part").alias("text"))


def op5_chat(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(render(fold_events(turn_events(turns))))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
