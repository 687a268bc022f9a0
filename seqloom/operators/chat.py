"""Conversations to supervised examples: only what the assistant says is a target."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.functions.text import CODEPOINT_VOCAB, IGNORE
from seqloom.operators.numbering import ROWS_PER_CHUNK, running


@dataclass(frozen=True)
class ControlIds:
    user: int = CODEPOINT_VOCAB
    assistant: int = CODEPOINT_VOCAB + 1
    end: int = CODEPOINT_VOCAB + 2


def role_prefix(role: Column, control: ControlIds) -> Column:
    """The assistant has its own token; every other role, system included, gets the user's."""
    return F.when(role == "assistant", F.lit(control.assistant)).otherwise(F.lit(control.user))


def _segment(role: Column, ids: Column, control: ControlIds) -> tuple[Column, Column]:
    """A turn's tokens and, aligned with them, the next-token targets.

    The token after a turn is the next turn's role token, which is never a target. So a turn's
    targets depend on the turn alone: its own tokens shifted by one, then one ignored place.
    """
    end = F.array(F.lit(control.end))
    inputs = F.concat(F.array(role_prefix(role, control)), ids, end)
    targets = F.concat(ids, end, F.array(F.lit(IGNORE)))
    nothing = F.array_repeat(F.lit(IGNORE), F.size(ids) + 2)
    return inputs, F.when(role == "assistant", targets).otherwise(nothing)


def render_messages(
    df: DataFrame, key: str, tokenize, control: ControlIds, messages: str = "messages"
) -> DataFrame:
    """``(key, input_ids, labels)`` from nested conversations, inside the row: no shuffle."""

    def part(index: int):
        def of(m: Column) -> Column:
            role = F.coalesce(m["role"], F.lit("user"))
            return _segment(role, tokenize(F.coalesce(m["content"], F.lit(""))), control)[index]

        return F.flatten(F.transform(messages, of))

    full = df.select(key, part(0).alias("_ids"), part(1).alias("_labels"))
    last = F.greatest(F.size("_ids") - 1, F.lit(0))
    return full.select(
        key,
        F.slice("_ids", 1, last).cast("array<int>").alias("input_ids"),
        F.slice("_labels", 1, last).cast("array<int>").alias("labels"),
    )


def render_turns(
    df: DataFrame,
    conv: str,
    turn: str,
    control: ControlIds,
    ids: Column | str = "turn_ids",
    length: Column | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Rendered turns with their place: ``(conv, turn, start, input_ids, labels)``.

    Laid end to end by ``start`` they are the whole conversation, of any length; a conversation
    is never gathered. The last turn gives up its final token, which has no successor.
    """
    ids = F.col(ids) if isinstance(ids, str) else ids
    n = (F.size(ids) if length is None else length).cast("long") + 2
    sized = df.withColumn("_n", n)
    last = df.groupBy(conv).agg(F.max(turn).alias("_last"))
    placed = running(
        sized, [conv], turn, sums={"_end": F.col("_n")}, rows_per_chunk=rows_per_chunk
    ).join(last, conv)
    built = placed.select(
        conv,
        turn,
        "role",
        (F.col("_end") - F.col("_n")).alias("start"),
        (F.col("_n") - (F.col(turn) == F.col("_last")).cast("int")).cast("int").alias("_keep"),
        ids.alias("_ids"),
    )
    inputs, labels = _segment(F.col("role"), F.col("_ids"), control)
    return built.select(
        conv,
        turn,
        "start",
        F.slice(inputs, 1, F.col("_keep")).cast("array<int>").alias("input_ids"),
        F.slice(labels, 1, F.col("_keep")).cast("array<int>").alias("labels"),
    )


def assemble(rendered: DataFrame, conv: str, seq_len: int) -> DataFrame:
    """One example per conversation: its first ``seq_len`` places.

    Turns that start later, and the part of a turn past the limit, are dropped before the
    shuffle, so a group holds at most ``seq_len`` tokens whatever the conversation's length.
    """
    if seq_len < 1:
        raise ValueError("seq_len must be positive")
    room = (F.lit(seq_len) - F.col("start")).cast("int")
    inside = rendered.where(F.col("start") < seq_len).select(
        conv,
        "start",
        F.slice("input_ids", 1, room).alias("i"),
        F.slice("labels", 1, room).alias("l"),
    )
    turns = F.array_sort(F.collect_list(F.struct("start", "i", "l")))
    grouped = inside.groupBy(conv).agg(turns.alias("_turns"))
    return grouped.select(
        conv,
        F.flatten(F.transform("_turns", lambda t: t["i"])).alias("input_ids"),
        F.flatten(F.transform("_turns", lambda t: t["l"])).alias("labels"),
    )


def collate(
    df: DataFrame, batch: Sequence[str], fill: dict[str, int], into_longest_of: str = "input_ids"
) -> DataFrame:
    """Right-pad array columns to the longest row of their batch, which one window finds: a batch is bounded."""
    longest = F.max(F.size(into_longest_of)).over(Window.partitionBy(*batch))
    joined = df.withColumn("_longest", longest)
    padded = {
        c: F.concat(c, F.array_repeat(F.lit(v), F.col("_longest") - F.size(c)))
        for c, v in fill.items()
    }
    return joined.withColumns(padded).drop("_longest")
