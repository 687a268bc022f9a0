"""Text to token ids without leaving the row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

# The control tokens of rendered conversations.
USER_TOKEN = "<|user|>"
ASSISTANT_TOKEN = "<|assistant|>"
END_TOKEN = "<|end|>"
CONTROL_TOKENS = (USER_TOKEN, ASSISTANT_TOKEN, END_TOKEN)

# Fixed value: the label that is never a target.
IGNORE = -100

# Code points end at 0x10FFFF; the control ids of the code point tokenizer follow.
CODEPOINT_VOCAB = 0x110000

WORD_PATTERN = r"[^ \n\t\r]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def split_words(texts: pa.Array, max_len: int | None = None) -> pa.ListArray:
    """``words`` of a column of strings, all at once and at most ``max_len`` per row; a null text has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    # In UTF-8 these four bytes are never part of another character.
    inside = (data != 0x20) & (data != 0x0A) & (data != 0x09) & (data != 0x0D)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    rows = ends[(ends > 0) & (ends < len(data))]  # a word does not go on in the next row
    first[rows], last[rows - 1] = inside[rows], inside[rows - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.searchsorted(starts, ends)
    if max_len is not None and len(starts):
        counts = np.diff(offsets)
        taken = np.arange(len(starts)) - np.repeat(offsets[:-1], counts) < max_len
        steps = np.zeros(len(data) + 1, np.int8)
        steps[starts[taken]], offsets = 1, np.concatenate([[0], np.cumsum(np.minimum(counts, max_len))])
        steps[stops[taken]] -= 1
        inside, starts, stops = np.cumsum(steps[:-1], dtype=np.int8).astype(bool), starts[taken], stops[taken]
    places = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[inside]))
    return pa.ListArray.from_arrays(offsets.astype(np.int32), found)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN))


def codepoints(text: Column, max_len: int | None = None) -> Column:
    """One id per code point. With ``max_len`` the rest of the text is never split."""
    if max_len is not None:
        text = F.substring(text, 1, max_len)
    split = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    # An empty string splits into one empty piece.
    return F.when(text == "", F.array().cast("array<int>")).otherwise(split)


@dataclass(frozen=True)
class Tokenizer:
    """``ids(text, max_len)`` gives ARRAY<INT>; ``count`` its length at the lowest known cost.

    ``count`` lets prefix sums over lengths prune the text-to-ids work from their own pass.
    ``clip`` drops text that cannot reach the first ``max_len`` tokens, ahead of a shuffle.
    """

    ids: Callable[[Column, int | None], Column]
    count: Callable[[Column, int | None], Column]
    clip: Callable[[Column, int | None], Column] = lambda text, max_len=None: text


def _cut(n: Column, max_len: int | None) -> Column:
    return n if max_len is None else F.least(n, F.lit(max_len))


CODEPOINTS = Tokenizer(
    ids=codepoints,
    count=lambda text, max_len=None: _cut(F.length(text), max_len),
    clip=lambda text, max_len=None: text if max_len is None else F.substring(text, 1, max_len),
)


def tokenizer(name: str) -> Tokenizer:
    """``codepoints``, the one tokenizer that is a column expression; ``operators.vocabulary.tokenizer`` has the others."""
    if name == "codepoints":
        return CODEPOINTS
    raise ValueError(f"unknown tokenizer {name!r}")
