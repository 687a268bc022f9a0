"""From logits to tokens, row by row; and the shaping of ragged id arrays around it.

A logits row is one array, so its softmax, sort and cumulative sum stay inside the row: one numpy
call per Arrow batch, no exploded vocabulary and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def greedy(logits: Column) -> Column:
    """The index of the largest logit, the first of equals."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def _nucleus(logits: np.ndarray, top_p: float, temperature: float):
    """Token order and renormalised probabilities, zero outside the nucleus."""
    scaled = logits / temperature
    probs = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    probs /= probs.sum(axis=1, keepdims=True)
    order = np.argsort(-probs, axis=1, kind="stable")
    probs = np.take_along_axis(probs, order, axis=1)
    probs[probs.cumsum(axis=1) - probs > top_p] = 0.0
    return order, probs / np.maximum(probs.sum(axis=1, keepdims=True), 1e-12)


def _check(top_p: float, temperature: float) -> None:
    if temperature <= 0:
        raise ValueError("a temperature of zero or less is greedy decoding")
    if top_p < 0:
        raise ValueError("top_p must not be negative")


def nucleus(logits: Column, top_p: float = 0.95, temperature: float = 0.8) -> Column:
    """The kept tokens, most probable first: ``ARRAY<STRUCT<token INT, p DOUBLE>>``.

    The token that crosses ``top_p`` is kept.
    """
    _check(top_p, temperature)

    def kept(rows: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            if batch.empty:
                yield pd.DataFrame({"token": [], "p": []})
                continue
            order, probs = _nucleus(np.stack(batch.to_list()).astype(float), top_p, temperature)
            sizes = (probs > 0).sum(axis=1)
            yield pd.DataFrame(
                {
                    "token": [o[:n].astype(np.int32) for o, n in zip(order, sizes)],
                    "p": [p[:n] for p, n in zip(probs, sizes)],
                }
            )

    # A probability that underflows to zero is not in the nucleus.
    both = F.pandas_udf(kept, "token array<int>, p array<double>")(logits)
    return F.arrays_zip(both["token"].alias("token"), both["p"].alias("p"))


def nucleus_sample(
    logits: Column, uniform: Column, top_p: float = 0.95, temperature: float = 0.8
) -> Column:
    """One token of the nucleus: the first whose cumulative probability exceeds ``uniform``."""
    _check(top_p, temperature)

    def drawn(rows: pd.Series, u: pd.Series) -> pd.Series:
        if rows.empty:
            return pd.Series([], dtype="int32")
        order, probs = _nucleus(np.stack(rows.to_list()).astype(float), top_p, temperature)
        passed = probs.cumsum(axis=1) > u.to_numpy()[:, None]
        last = (probs > 0).sum(axis=1) - 1
        at = np.where(passed.any(axis=1), passed.argmax(axis=1), last)
        return pd.Series(order[np.arange(len(order)), at].astype(np.int32))

    return F.pandas_udf(drawn, "int")(logits, uniform)


def compact(ids: Column, mask: Column) -> Column:
    """The ids whose mask is 1; a row without any is an error."""
    kept = F.filter(ids, lambda x, i: F.get(mask, i) == 1)
    nothing = F.raise_error(F.lit("a prompt needs at least one unmasked token"))
    return F.when(F.exists(mask, lambda m: m == 1), kept).otherwise(nothing.cast("array<int>"))


def strip_prompt(output: Column, mask: Column) -> Column:
    """What follows the prompt, whose length is the number of ones in its mask."""
    length = F.aggregate(mask, F.lit(0), lambda acc, m: acc + m.cast("int"))
    return F.slice(output, length + 1, F.greatest(F.size(output) - length, F.lit(0)))


def every_channel(df: DataFrame, keys: list[str], vector: str, name: str = "value") -> DataFrame:
    """One row per vector element: ``(keys, i, name)``."""
    return df.select(*keys, F.posexplode(vector).alias("i", name))
