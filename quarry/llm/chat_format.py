"""Chat formatting by prefix-target expansion, in native expressions.

Each assistant turn becomes one example: all turns before it as context, only its own text under the
loss mask. Turns after a conversation's last assistant turn would be in no example, so they end in
one more example without a target. A turn is

    <|turn|>role<|text|>text</s>

and a control string inside a role or text gets a backslash after its first character (one more than
it has already), so that none is left and the escaping can be undone exactly.

A conversation is one row once (its turns in order, by turn, role and text); examples are prefixes of
that one string, so nothing is collected per example. The text of one conversation is held by one
task: its digest needs it in order.

Cases: null text or role is empty; null turns come first; null conv_ids are one conversation;
repeated rows are turns of their own; a conversation without assistant turns has one example
without target; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of the template: every control string starts with < or [.
TURN, BODY, END = "<|turn|>", "<|text|>", "</s>"
CONTROL_TAIL = r"\||/?s>|/?INST\]|</?SYS>>"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={CONTROL_TAIL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={CONTROL_TAIL})", r"$1$2")


def conversations_as_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: ordered array of role, text)."""
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return rows


def examples(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example_no, formatted, loss_start, loss_length (code points; -1 and 0 without target), is_last."""
    rows = conversations_as_rows(turns)
    piece = lambda t: F.concat(F.lit(TURN), escape(t.role), F.lit(BODY), escape(t.text), F.lit(END))
    rows = rows.withColumn("pieces", F.transform("turns", piece))
    sizes = F.transform(
        F.arrays_zip("turns", "pieces"),
        lambda z: F.struct(F.length(z.pieces).alias("n"), F.length(escape(z.turns.text)).alias("body"), (z.turns.role == TARGET_ROLE).alias("target")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<stop:int,begin:int,length:int,target:boolean>>").alias("marks"))
    walk = F.aggregate(
        sizes,
        start,
        lambda acc, z: F.struct(
            (acc.at + z.n).alias("at"),
            F.concat(acc.marks, F.array(F.struct((acc.at + z.n).alias("stop"), (acc.at + z.n - len(END) - z.body).alias("begin"), z.body.alias("length"), z.target.alias("target")))).alias("marks"),
        ),
        lambda acc: acc.marks,
    )
    rows = rows.select("conv_id", F.array_join("pieces", "").alias("whole"), walk.alias("marks"))
    last = F.element_at("marks", -1)
    chosen = F.concat(
        F.filter("marks", lambda m: m.target),
        F.when(~last.target, F.array(last)).otherwise(F.slice("marks", 1, 0)),
    )
    out = rows.select("conv_id", "whole", F.size("marks").alias("n"), last.stop.alias("full"), F.posexplode(chosen).alias("example_no", "m"))
    return out.select(
        "conv_id", "example_no", F.col("whole").substr(F.lit(1), F.col("m.stop")).alias("formatted"),
        F.when(F.col("m.target"), F.col("m.begin")).otherwise(F.lit(-1)).alias("loss_start"),
        F.when(F.col("m.target"), F.col("m.length")).otherwise(F.lit(0)).alias("loss_length"),
        (F.col("m.stop") == F.col("full")).alias("is_last"),
    )


def parse(formatted: Column) -> Column:
    """Turns of a formatted example, read back: array of (role, text)."""
    pieces = F.filter(F.split(formatted, END, -1), lambda x: x != "")

    def turn(p: Column) -> Column:
        head_and_body = F.split(F.substr(p, F.lit(len(TURN) + 1)), r"<\|text\|>", 2)
        return F.struct(unescape(F.get(head_and_body, 0)).alias("role"), unescape(F.get(head_and_body, 1)).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    return F.when(start >= 0, unescape(F.substr(formatted, start + 1, length))).otherwise(F.lit(""))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Read back from the examples, per conversation: turns, trainable text and size."""
    line = F.transform(parse(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    per = formatted.select(
        "conv_id", "example_no", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
        F.length("formatted").cast("long").alias("size"),
        F.when(F.col("is_last"), F.struct(F.size(line).cast("long").alias("n"), F.sha2(F.array_join(line, ""), 256).alias("sha"))).alias("whole"),
    )
    out = per.groupBy("conv_id").agg(
        F.max("whole").alias("whole"), F.sum("size").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example_no", "loss"))), lambda x: x.loss), "").alias("loss"),
    )
    return out.select(
        "conv_id", F.col("whole.n").alias("n_turns"), F.col("whole.sha").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
