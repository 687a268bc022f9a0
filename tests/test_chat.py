"""Rendering of conversations: golden values, and the flat form against the nested one."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions.text import CODEPOINTS
from seqloom.operators import chat
from seqloom.sources.corpus import fill_turn_defaults, flatten_messages

CONTROL = chat.ControlIds(1, 2, 3)
MESSAGES = "conv_id int, messages array<struct<role:string,content:string>>"


def by_table(text):
    """The tokenizer of the golden case."""
    vocab = F.create_map(
        F.lit("hello"), F.array(F.lit(10), F.lit(11)), F.lit("answer"), F.array(F.lit(20), F.lit(21))
    )
    return vocab[text]


def test_golden_rendering_supervises_the_assistant_only(spark):
    conv = spark.createDataFrame([(0, [("user", "hello"), ("assistant", "answer")])], MESSAGES)
    row = chat.render_messages(conv, "conv_id", by_table, CONTROL).first()
    assert row["input_ids"] == [1, 10, 11, 3, 2, 20, 21]
    assert row["labels"] == [-100, -100, -100, -100, 20, 21, 3]
    turns = flatten_messages(conv).withColumn("turn_ids", by_table(F.col("text")))
    flat = chat.assemble(chat.render_turns(turns, "conv_id", "turn", CONTROL), "conv_id", 100).first()
    assert (flat["input_ids"], flat["labels"]) == (row["input_ids"], row["labels"])


def test_conversation_without_messages_is_empty(spark):
    row = chat.render_messages(spark.createDataFrame([(0, [])], MESSAGES), "conv_id", by_table, CONTROL).first()
    assert row["input_ids"] == [] and row["labels"] == []


@pytest.mark.parametrize("rows_per_chunk", [1_000_000, 4])
@pytest.mark.parametrize("limit", [1, 13, 10_000])
def test_flat_turns_equal_nested_messages(spark, rows_per_chunk, limit):
    rng = random.Random(3)
    convs = [
        (c, [(rng.choice(["user", "assistant", "system", None]), rng.choice(["", "ab", "xyz" * 5, None])) for _ in range(n)])
        for c, n in enumerate([1, 2, 30, 7])
    ]
    nested = spark.createDataFrame(convs, MESSAGES)
    whole = chat.render_messages(nested, "conv_id", lambda t: CODEPOINTS.ids(t, None), CONTROL)
    expected = {r["conv_id"]: (r["input_ids"][:limit], r["labels"][:limit]) for r in whole.collect()}
    turns = fill_turn_defaults(flatten_messages(nested))
    rendered = chat.render_turns(
        turns,
        "conv_id",
        "turn",
        CONTROL,
        ids=CODEPOINTS.ids(F.col("text"), None),
        length=CODEPOINTS.count(F.col("text"), None),
        rows_per_chunk=rows_per_chunk,
    )
    out = chat.assemble(rendered, "conv_id", limit)
    assert {r["conv_id"]: (r["input_ids"], r["labels"]) for r in out.collect()} == expected


def test_golden_collation(spark):
    batch = spark.createDataFrame(
        [(0, 1, [1, 2, 3], [-100, 8, 9]), (0, 2, [1], [-100])],
        "b int, i int, input_ids array<int>, labels array<int>",
    )
    out = chat.collate(batch, ["b"], {"input_ids": 0, "labels": -100}).orderBy("i").collect()
    assert [(r["input_ids"], r["labels"]) for r in out] == [
        ([1, 2, 3], [-100, 8, 9]),
        ([1, 0, 0], [-100, -100, -100]),
    ]
