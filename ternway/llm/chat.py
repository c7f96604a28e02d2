"""Chat formatting with Spark expressions only, and the way back.

A conversation's turns are collected as structs and sorted. Messages start at the turns whose role
differs from the one before; the turns up to the next start are merged into one by an array
aggregation. Each turn is looked at a fixed number of times and each text is joined once, so a
conversation of many turns costs no more than its length. The output of a message is

    <|role|>line end, text, <|and|>, text of the next merged turn, ..., <|end|>line end

Inside texts and roles &, < and [ are written as character references, roles also |, so no
control string of this template or of others that start with < or [ survives there, and the
way back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AND, END = "<|and|>", "<|end|>\n"
#: The role whose texts a model is trained on.
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescaped(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&#91;"), F.lit("["))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): one text for each conversation of turns (conv_id, turn, role, text).

    Turns stand in the order of turn, null first, ties by role and text. A null role or text
    counts as empty; rows with a null conv_id are one conversation; repeated rows are repeated
    turns. Other columns don't matter.
    """
    rows = turns.select("conv_id", F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turn = F.struct("turn", "role", "text")
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    role = lambda k: F.get(F.col("turns"), k - 1)["role"]  # noqa: E731  of the k-th turn, from 1; null before the first
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: ~role(k).eqNullSafe(role(k - 1)))
    # the starts are a column of their own, so that they are found once
    rows = sorted_turns.withColumn("starts", starts)

    def message(k: Column, place: Column) -> Column:
        stop = F.coalesce(F.get(F.col("starts"), place + 1), F.size("turns") + 1)
        name = F.replace(escaped(role(k)), F.lit("|"), F.lit("&#124;"))
        texts = F.transform(F.slice("turns", k, stop - k), lambda t: escaped(t.text))
        return F.concat(F.lit("<|"), name, F.lit("|>\n"), F.array_join(texts, AND), F.lit(END))

    return rows.select("conv_id", F.array_join(F.transform("starts", message), "").alias("formatted"))


def messages(text: Column) -> Column:
    """array<struct<role, texts>> of a formatted text: its messages, each with the texts of its turns."""
    parts = F.filter(F.split(text, r"<\|end\|>\n", -1), lambda p: p != "")

    def message(p: Column) -> Column:
        head = F.substring_index(p, "|>", 1)
        role = unescaped(F.replace(F.substring(head, 3, 1 << 30), F.lit("&#124;"), F.lit("|")))
        texts = F.split(F.substr(p, F.char_length(head) + 4), r"<\|and\|>", -1)
        return F.struct(role.alias("role"), F.transform(texts, unescaped).alias("texts"))

    return F.transform(parts, message)


def turns_of(text: Column) -> Column:
    """array<struct<role, text>>: all turns of a formatted text, merged ones apart again."""
    return F.flatten(F.transform(messages(text), lambda m: F.transform(m.texts, lambda t: F.struct(m.role.alias("role"), t.alias("text")))))


def loss_texts(text: Column) -> Column:
    """array<string>: the texts of a formatted text that the loss counts, unescaped."""
    return F.transform(F.filter(turns_of(text), lambda t: t.role == TRAINED), lambda t: t.text)
