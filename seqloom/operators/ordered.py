"""Ordered analytics per key: cumulative memory, causal filters, associative memory.

Scalars use Spark windows. Vectors use ``scan``: rows are clustered and sorted by Spark, and a
kernel walks each task's Arrow batches with a state of fixed size, so no key is ever gathered.
Keys that are too heavy for one task are cut into ordered chunks (see ``numbering``).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from seqloom.functions.kernels import advance_segments
from seqloom.functions.vectors import elu1
from seqloom.operators.numbering import (
    CARRIED,
    CHUNK,
    ROWS_PER_CHUNK,
    heavy_keys,
    running,
    with_chunks,
)

STATE = "_state"


def slow_memory(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    q: Column,
    v: Column,
    name: str = "memory",
    eps: float = 1e-6,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Scalar normalised cumulative memory, as two running sums in one window."""
    phi = elu1(q.cast("double"))
    sums = {"_num": phi * v.cast("double"), "_den": phi}
    out = running(df, keys, order, sums=sums, rows_per_chunk=rows_per_chunk)
    memory = F.col("_num") / F.greatest(F.col("_den"), F.lit(eps))
    return out.withColumn(name, memory).drop("_num", "_den")


def causal_fir(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    x: Column,
    weights: Sequence[float],
    bias: float = 0.0,
    name: str = "fir",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Scalar causal filter by lags over one sort; places before a key's start count as zero.

    A null input is an error, as it is for vectors.
    """
    kernel = len(weights)
    if kernel < 1:
        raise ValueError("the filter needs at least one weight")
    given = F.when(x.isNull(), F.raise_error(F.lit("ordered inputs must not be null")).cast("double"))
    rows = df.withColumn("_x", given.otherwise(x.cast("double")))
    heavy = heavy_keys(df, keys, order, rows_per_chunk) if kernel > 1 else []
    part = list(keys)
    if heavy:
        rows = with_chunks(rows, keys, order, heavy).withColumn(CARRIED, F.lit(False))
        halo = _halo(rows.where(F.col(CHUNK).isNotNull()), keys, order, kernel - 1)
        rows = rows.unionByName(halo, allowMissingColumns=True)
        part.append(CHUNK)
    w = Window.partitionBy(*part).orderBy(order)
    y = F.lit(float(bias))
    for j, weight in enumerate(weights):
        past = F.lag("_x", kernel - 1 - j).over(w) if j < kernel - 1 else F.col("_x")
        y = y + F.coalesce(past, F.lit(0.0)) * F.lit(float(weight))
    out = rows.withColumn(name, y)
    if heavy:
        out = out.where(~F.col(CARRIED)).drop(CHUNK, CARRIED)
    return out.drop("_x")


def _halo(rows: DataFrame, keys: Sequence[str], order: str, depth: int) -> DataFrame:
    """For each chunk, copies of the ``depth`` rows before it.

    Every chunk keeps its own last rows; since no chunk is empty, the tails of ``depth`` earlier
    chunks are always enough.
    """
    latest = Window.partitionBy(*keys, CHUNK).orderBy(F.col(order).desc())
    tails = (
        rows.withColumn("_rank", F.row_number().over(latest))
        .where(F.col("_rank") <= depth)
        .groupBy(*keys, CHUNK)
        .agg(F.array_sort(F.collect_list(F.struct(order, "_x"))).alias("_tail"))
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-depth, -1)
    joined = tails.select(*keys, CHUNK, F.flatten(F.collect_list("_tail").over(before)).alias("_t"))
    first = F.greatest(F.size("_t") - depth, F.lit(0)) + 1
    return joined.select(
        *keys, CHUNK, F.inline(F.slice("_t", first, F.lit(depth))), F.lit(True).alias(CARRIED)
    )


def eos_fill(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    token: str,
    eos: Column,
    name: str = "filled",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """After a key's first end token every later token, null or not, is the end token."""
    ended = F.coalesce(F.col(token) == eos, F.lit(False)).cast("int")
    out = running(df, keys, order, sums={"_ends": ended}, rows_per_chunk=rows_per_chunk)
    finished = F.col("_ends") - ended > 0
    return out.withColumn(name, F.when(finished, eos).otherwise(F.col(token))).drop("_ends")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    kernel,
    inputs: Mapping[str, str],
    name: str = "out",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add ``name``, the kernel's ARRAY<DOUBLE> output, walking each key in unique ``order``.

    ``inputs`` maps the kernel's inputs to columns (arrays of doubles, or doubles).
    """
    keys = list(keys)
    columns = [inputs[n] for n in kernel.widths]
    widths = list(kernel.widths.values())
    heavy = heavy_keys(df, keys, order, rows_per_chunk)
    # The work per row outweighs its bytes, so AQE should not merge these partitions by size.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    result = T.StructType(df.schema.fields + [T.StructField(name, T.ArrayType(T.DoubleType()))])
    if not heavy:
        rows = df.repartition(tasks, *keys).sortWithinPartitions(*keys, order)
        return rows.mapInArrow(_walk(kernel, keys, columns, widths, name, df.columns), result)

    part = [*keys, CHUNK]
    key_fields = [df.schema[k] for k in keys] + [
        T.StructField(CHUNK, T.LongType()),
        T.StructField(STATE, T.ArrayType(T.DoubleType())),
    ]
    chunked = with_chunks(df, keys, order, heavy)
    pieces = chunked.where(F.col(CHUNK).isNotNull()).repartition(tasks, *part)
    summaries = pieces.sortWithinPartitions(*part, order).mapInArrow(
        _summarise(kernel, part, columns, widths), T.StructType(key_fields)
    )
    # One row per chunk: short even for a key with a third of all rows.
    carried = summaries.repartition(*keys).sortWithinPartitions(*part).mapInArrow(
        _carry(kernel, keys, part), T.StructType(key_fields)
    )
    # Rows without a state hold an empty array: long runs of null arrays make the conversion to
    # Arrow quadratic in the batch.
    plain = chunked.withColumns({CARRIED: F.lit(False), STATE: F.array().cast("array<double>")})
    stacked = plain.unionByName(carried.withColumn(CARRIED, F.lit(True)), allowMissingColumns=True)
    rows = stacked.repartition(tasks, *part).sortWithinPartitions(*part, F.col(CARRIED).desc(), F.col(order))
    return rows.mapInArrow(_walk(kernel, part, columns, widths, name, df.columns), result)


def _segments(batch: pa.RecordBatch, keys: Sequence[str], previous: tuple | None):
    """Runs of equal keys ``[(start, end)]`` and whether the first one goes on from before."""
    n = batch.num_rows
    changed = np.zeros(n, dtype=bool)
    for k in keys:
        col = batch.column(k)
        a, b = col.slice(0, n - 1), col.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        differ = pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b)))
        changed[1:] |= differ.to_numpy(zero_copy_only=False)
    starts = [0, *np.flatnonzero(changed).tolist()]
    first = tuple(batch.column(k)[0].as_py() for k in keys)
    return list(zip(starts, [*starts[1:], n])), previous is not None and first == previous


def _last_key(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple:
    return tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column as ``[rows, width]`` doubles, or ``[rows]`` for width 0; gaps are an error."""
    if column.null_count:
        raise ValueError("ordered inputs must not be null")
    if width == 0:
        return column.cast(pa.float64()).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width:
        raise ValueError(f"expected vectors of {width} values")
    return flat.reshape(len(column), width)


def _array(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))


def _walk(kernel, part, columns, widths, name, keep):
    own = getattr(kernel, "advance_segments", None)
    advance = own or partial(advance_segments, kernel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            segments, goes_on = _segments(batch, part, previous)
            previous = _last_key(batch, part)
            start_rows = np.zeros(batch.num_rows, dtype=bool)
            states = None
            if CARRIED in batch.schema.names:
                states = batch.column(STATE)
                start_rows = batch.column(CARRIED).to_numpy(zero_copy_only=False)
            data = batch.filter(pa.array(~start_rows)) if start_rows.any() else batch
            at = np.concatenate([[0], np.cumsum(~start_rows)])
            inputs = [_matrix(data.column(c), w) for c, w in zip(columns, widths)]
            out = np.empty((data.num_rows, kernel.out_size))
            held = np.zeros((len(segments), kernel.state_size))
            if goes_on:
                held[0] = state
            for i in np.flatnonzero(start_rows[[s for s, _ in segments]]):
                held[i] = states[segments[i][0]].as_py()
            advance(held, [(at[s], at[e]) for s, e in segments], inputs, out)
            state = held[-1]
            if data.num_rows:
                fields = [data.column(c) for c in keep] + [_array(out)]
                yield pa.RecordBatch.from_arrays(fields, names=[*keep, name])

    return run


def _summarise(kernel, part, columns, widths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, summary, row = None, None, None

        def closed():
            state = pa.array([summary.tolist()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*row, state], names=[*part, STATE])

        for batch in batches:
            if not batch.num_rows:
                continue
            segments, goes_on = _segments(batch, part, previous)
            previous = _last_key(batch, part)
            inputs = [_matrix(batch.column(c), w) for c, w in zip(columns, widths)]
            for i, (s, e) in enumerate(segments):
                if i or not goes_on:
                    if row is not None:
                        yield closed()
                    summary, row = None, [batch.column(k).slice(s, 1) for k in part]
                summary = kernel.summarise(summary, *[x[s:e] for x in inputs])
        if row is not None:
            yield closed()

    return run


def _carry(kernel, keys, part):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            segments, goes_on = _segments(batch, keys, previous)
            previous = _last_key(batch, keys)
            summaries = batch.column(STATE).to_pylist()
            before = []
            for i, (s, e) in enumerate(segments):
                if i or not goes_on:
                    state = np.zeros(kernel.state_size)
                for summary in summaries[s:e]:
                    before.append(state.tolist())
                    state = kernel.compose(state, np.asarray(summary, dtype=np.float64))
            states = pa.array(before, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in part], states], names=[*part, STATE]
            )

    return run
