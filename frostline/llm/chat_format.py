"""Chat formatting: turns of a conversation as one training text with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.columns import quoted

# The template. After escaping, neither texts nor roles hold "<", ">" or a lone backslash.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), (">", "\\g")]
OPEN, HEAD_END, AND, CLOSE = "<turn ", ">\n", "<and>", "</turn>\n"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """One training text per conversation. The feeds hold no dialogues, so this operator is kept general.

    Turns are collected as structs and sorted by turn, then role and text. Neighbours of one role share a block: a head
    with the role, their escaped texts with ``<and>`` between, and a close. Result: conv_id, ``pieces`` (array of struct
    of piece and loss; joined they are the formatted text, and loss marks the texts of ``loss_role`` without any markup)
    and ``formatted``. Escaping replaces backslash, ``<`` and ``>``, so that no text can hold a control string, and
    ``read_back`` restores every turn, merged ones too. Null texts and roles count as empty; null turns come first; a
    null conv_id is a conversation of its own; repeated rows are turns of their own; other columns are left out; an
    empty table gives an empty result. A conversation is one value, so it is the one thing held together.
    """
    turns = conversations.select(
        F.col(quoted(conv_id)).alias("conv_id"), F.struct(
            F.col(quoted(turn)).alias("turn"), F.coalesce(F.col(quoted(role)), F.lit("")).alias("role"),
            F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")).alias("said"))
    df = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    said = F.col("said")

    def piece(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("piece"), loss.alias("loss"))

    def parts(one: Column, i: Column) -> Column:
        joins = F.coalesce(F.get(said, i - 1)["role"] == one["role"], F.lit(False))
        ends = ~F.coalesce(F.get(said, i + 1)["role"] == one["role"], F.lit(False))
        head = F.when(joins, F.lit(AND)).otherwise(F.concat(F.lit(OPEN), escaped(one["role"]), F.lit(HEAD_END)))
        return F.array(piece(head, F.lit(False)), piece(escaped(one["text"]), one["role"] == loss_role),
                       piece(F.when(ends, F.lit(CLOSE)).otherwise(""), F.lit(False)))

    pieces = F.filter(F.flatten(F.transform(said, parts)), lambda p: F.length(p["piece"]) > 0)
    df = df.select("conv_id", pieces.alias("pieces"))
    return df.withColumn("formatted", F.array_join(F.transform("pieces", lambda p: p["piece"]), ""))


def loss_text(pieces: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescaped(p["piece"])), "")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>, read from the text alone."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, HEAD_END, 1)
        body = F.substring(block, F.length(role) + len(HEAD_END) + 1, F.length(block))
        name = unescaped(F.substring(role, F.lit(len(OPEN) + 1), F.length(role)))
        return F.transform(F.split(body, AND), lambda t: F.struct(name.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))
