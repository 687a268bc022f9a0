"""Causal attention over long sequences, tile by tile.

Rows are packed into tiles of a fixed number of positions. A query tile meets each key tile at or
before it once, as two matrix products, and keeps a running softmax; scores are never rows of a
table. The work of one sequence spreads over its query tiles, each of which is its own group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from seqloom.operators.ordered import _array, _last_key, _segments

TILE_ROWS = 256


def causal_attention(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    q: Column,
    k: Column,
    v: Column,
    rho: Column | None = None,
    beta: float | Column = 0.1,
    max_seq_len: int | None = None,
    tile_rows: int = TILE_ROWS,
    name: str = "attended",
) -> DataFrame:
    """``(keys, pos, name)`` with ``softmax(q·k/sqrt(d) + beta*ln(max(rho, 1e-6)))`` over the past.

    ``pos`` is unique per key and counts from 0; gaps are allowed. A missing ``rho`` means 1, which adds nothing.
    With a head among ``keys``, ``beta`` may be a column that holds the head's own.
    With ``max_seq_len`` a longer sequence is an error, raised while the query runs.
    """
    keys = list(keys)
    importance = F.lit(1.0) if rho is None else F.coalesce(rho.cast("double"), F.lit(1.0))
    strength = beta if isinstance(beta, Column) else F.lit(float(beta))
    rows = df.select(
        *keys,
        F.col(pos).cast("long").alias("_pos"),
        q.alias("q"),
        k.alias("k"),
        v.alias("v"),
        (strength * F.ln(F.greatest(importance, F.lit(1e-6)))).alias("bias"),
    ).withColumn("_tile", F.expr(f"_pos div {int(tile_rows)}"))
    last = F.max("_pos")
    if max_seq_len is not None:
        too_long = F.concat(F.lit("a sequence is longer than "), F.lit(str(max_seq_len)))
        last = F.when(F.max("_pos") >= max_seq_len, F.raise_error(too_long)).otherwise(last)
    # The tiles a sequence has: positions may leave gaps, and a tile without rows asks for nothing.
    ends = rows.groupBy(*keys).agg(last.alias("_last"), F.sort_array(F.collect_set("_tile")).alias("_tiles"))
    # The length is used, so that its check is not pruned away.
    ends = ends.select(*keys, F.filter("_tiles", lambda t: t * F.lit(int(tile_rows)) <= F.col("_last")).alias("_tiles"))

    # A tile has at most tile_rows rows, whatever the sequence's length.
    in_order = F.array_sort(F.collect_list(F.struct("_pos", "q", "k", "v", "bias")))
    tiles = rows.groupBy(*keys, "_tile").agg(in_order.alias("r"))

    def flat(field: str) -> Column:
        return F.flatten(F.transform("r", lambda x: x[field]))

    packed = tiles.select(
        *keys,
        "_tile",
        F.transform("r", lambda x: x["_pos"]).alias("pos"),
        flat("q").alias("q"),
        flat("k").alias("k"),
        flat("v").alias("v"),
        F.transform("r", lambda x: x["bias"]).alias("bias"),
    ).join(ends, keys)
    # Each tile goes to every query tile at or after it. A query tile's own copy comes first in
    # its group: it brings the queries and is the only one that needs the causal mask.
    sent = packed.withColumn("_to", F.explode(F.filter("_tiles", lambda t: t >= F.col("_tile"))))
    own = F.col("_to") == F.col("_tile")
    queries = F.when(own, F.size("pos")).otherwise(0)
    sent = sent.select(
        *keys,
        "_to",
        own.alias("_own"),
        "_tile",
        F.slice("pos", 1, queries).alias("pos"),
        F.slice("q", 1, F.when(own, F.size("q")).otherwise(0)).alias("q"),
        "k",
        "v",
        "bias",
    )
    part = [*keys, "_to"]
    # Work per row outweighs its bytes: AQE should not merge these partitions by size.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sent.repartition(tasks, *part).sortWithinPartitions(*part, F.col("_own").desc(), "_tile")
    schema = T.StructType(
        [df.schema[c] for c in keys]
        + [T.StructField(pos, T.LongType()), T.StructField(name, T.ArrayType(T.DoubleType()))]
    )
    return ordered.mapInArrow(_attend(keys, part, pos, name), schema)


def _attend(keys, part, pos, name):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, tile = None, None

        for batch in batches:
            if not batch.num_rows:
                continue
            segments, goes_on = _segments(batch, part, previous)
            previous = _last_key(batch, part)
            for i, (s, e) in enumerate(segments):
                for row in range(s, e):
                    new = row == s and (i or not goes_on)
                    if new:
                        if tile is not None:
                            yield tile.result(pos, name, keys)
                        tile = _QueryTile(batch, row, keys)
                    tile.meet(batch, row, causal=new)
        if tile is not None:
            yield tile.result(pos, name, keys)

    return run


def _values(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    # Vectors travel at their own width; all arithmetic is in doubles.
    found = batch.column(column)[row].values.to_numpy(zero_copy_only=False)
    return found if column == "pos" else found.astype(np.float64, copy=False)


class _QueryTile:
    """The queries of one tile and their running maximum, weight sum and weighted values."""

    def __init__(self, batch: pa.RecordBatch, row: int, keys: Sequence[str]) -> None:
        self.key_row = [batch.column(k).slice(row, 1) for k in keys]
        self.pos = _values(batch, "pos", row)
        n = len(self.pos)
        self.q = _values(batch, "q", row).reshape(n, -1)
        width = len(_values(batch, "v", row)) // n
        self.top = np.full(n, -np.inf)
        self.weight = np.zeros(n)
        self.total = np.zeros((n, width))

    def meet(self, batch: pa.RecordBatch, row: int, causal: bool) -> None:
        bias = _values(batch, "bias", row)
        k = _values(batch, "k", row).reshape(len(bias), -1)
        v = _values(batch, "v", row).reshape(len(bias), -1)
        scores = self.q @ k.T / np.sqrt(self.q.shape[1]) + bias
        if causal:
            scores[np.triu_indices(len(bias), 1)] = -np.inf
        top = np.maximum(self.top, scores.max(axis=1))
        shrink = np.exp(self.top - top)
        probs = np.exp(scores - top[:, None])
        self.weight = self.weight * shrink + probs.sum(axis=1)
        self.total = self.total * shrink[:, None] + probs @ v
        self.top = top

    def result(self, pos: str, name: str, keys: Sequence[str]) -> pa.RecordBatch:
        n = len(self.pos)
        same = pa.array(np.zeros(n, dtype=np.int64))
        fields = [k.take(same) for k in self.key_row]
        fields += [pa.array(self.pos), _array(self.total / self.weight[:, None])]
        return pa.RecordBatch.from_arrays(fields, names=[*keys, pos, name])
