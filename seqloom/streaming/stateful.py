"""The ordered kernels over streams: a key's state is carried from one micro-batch to the next.

Kernels whose state has a fixed size replace it. Attention's state is all rows so far: these are kept as a list
in RocksDB, to which a micro-batch appends its own rows, so what is written does not grow with what is held.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

LATE = "_late"
PACKED = "packed_inputs"  # no underscore first: rows of a stateful processor are named tuples

# Settings of the state store for lists: appends are written as changes, not as snapshots.
LIST_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

STATE_SCHEMA = T.StructType(
    [
        T.StructField("state", T.ArrayType(T.DoubleType())),
        T.StructField("last", T.LongType()),
        T.StructField("rows", T.LongType()),
    ]
)


def stream_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    kernel,
    inputs: Mapping[str, str],
    name: str = "out",
    max_rows: int | None = None,
) -> DataFrame:
    """``(keys, order, name, _late)`` with the same values as the batch ``scan``.

    ``order`` is a unique integer per key that grows from one micro-batch to the next. A row at or
    before the last one seen cannot be placed any more: it comes back marked ``_late`` with a null
    result and leaves the state alone. ``max_rows`` is for kernels whose state grows by the row: a key whose
    first micro-batch brings more is an error, one that goes on is not.

    The rows of such kernels need RocksDB, which the session is set to for queries started later; a query that is
    restarted keeps what its checkpoint was written with.
    """
    keys = list(keys)
    columns = {n: inputs[n] for n in kernel.widths}
    if "rho" in columns:  # a row without an importance counts in full, as in a table
        df = df.withColumn(columns["rho"], F.coalesce(columns["rho"], F.lit(1.0)))
    packed, spans = _packed(columns, kernel.widths)
    needed = [*keys, order, packed.alias(PACKED)]
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField(order, T.LongType()),
            T.StructField(name, T.ArrayType(T.DoubleType())),
            T.StructField(LATE, T.BooleanType()),
        ]
    )

    grouped = df.select(*needed).groupBy(*keys)
    plan = _Plan(keys, order, kernel, spans, name, max_rows)
    if hasattr(kernel, "row_size"):
        for setting, value in LIST_STATE.items():
            df.sparkSession.conf.set(setting, value)
        return grouped.transformWithStateInPandas(_Appending(plan), schema, "Append", "None")

    def step(key: tuple, frames: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        state, last, seen = np.zeros(kernel.state_size), None, 0
        if group.exists:
            held, last, seen = group.get
            state = np.asarray(held, dtype=np.float64)
        at, late, values = plan.arrange(frames, last)
        result = None
        if not late.all():
            state, result = kernel.advance(state, *values)
            group.update((state.tolist(), int(at[-1]), seen + int((~late).sum())))
        yield plan.frame(key, at, late, result)

    return grouped.applyInPandasWithState(step, schema, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def _packed(columns: Mapping[str, str], widths: Mapping[str, int]) -> tuple[Column, list]:
    """All inputs of a row as one array, and where each is in it: ``(from, to)``, or a place for width 0.

    A group passes to Python column by column, so its fixed cost is that of one column and not of six.
    """
    pieces, at, size = [], {}, 0
    for n, c in columns.items():
        if c in at:
            continue
        width, value = widths[n], F.col(c)
        wrong = F.raise_error(F.lit(f"{c}: expected vectors of {width} values")).cast("array<double>")
        pieces.append(F.when(F.size(value) == width, value.cast("array<double>")).otherwise(wrong) if width else F.array(value.cast("double")))
        at[c] = (size, size + width) if width else size
        size += max(width, 1)
    return F.concat(*pieces), [at[c] for c in columns.values()]


class _Plan:
    """What both kinds of state share: a key's rows of one micro-batch as arrays in order, and its results as a frame."""

    def __init__(self, keys, order, kernel, spans, name, max_rows):
        self.keys, self.order, self.kernel, self.spans = keys, order, kernel, spans
        self.name, self.max_rows = name, max_rows

    def arrange(self, frames: Iterator[pd.DataFrame], last: int | None):
        """``(order values, late?, inputs of the rows that are not late)``, all in order.

        Frames come in no order; each becomes plain arrays as it arrives and is let go.
        """
        places, pieces = [], []
        for frame in frames:
            places.append(frame[self.order].to_numpy(np.int64))
            pieces.append(np.stack(frame[PACKED].to_list()).astype(np.float64, copy=False))
        at = np.concatenate(places)
        order = np.argsort(at, kind="stable")
        at = at[order]
        late = np.zeros(len(at), dtype=bool) if last is None else at <= last
        rows = np.concatenate(pieces)[order][~late]
        return at, late, [rows[:, s] if isinstance(s, int) else rows[:, s[0] : s[1]] for s in self.spans]

    def frame(self, key: tuple, at: np.ndarray, late: np.ndarray, result: np.ndarray | None) -> pd.DataFrame:
        out: list = [None] * int(late.sum()) + ([] if result is None else result.tolist())
        keys = {k: [v] * len(at) for k, v in zip(self.keys, key)}
        return pd.DataFrame({**keys, self.order: at, self.name: pd.Series(out, dtype=object), LATE: late})


class _Appending(StatefulProcessor):
    """A key's rows so far, one list element per micro-batch, and where it stands."""

    def __init__(self, plan: _Plan):
        self.plan = plan

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "state array<double>")
        self.place = handle.getValueState("place", "last long, rows long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        plan, kernel = self.plan, self.plan.kernel
        last, seen = self.place.get() if self.place.exists() else (None, 0)
        at, late, values = plan.arrange(rows, last)
        fresh, result = int((~late).sum()), None
        if last is None and plan.max_rows is not None and fresh > plan.max_rows:
            raise ValueError(f"key {key} begins with more than {plan.max_rows} rows")
        if fresh:
            held = [np.asarray(r[0], dtype=np.float64) for r in self.rows.get()]
            state, result = kernel.advance(np.concatenate([np.zeros(0), *held]), *values)
            self.rows.appendValue((state[len(state) - fresh * kernel.row_size :].tolist(),))
            self.place.update((int(at[-1]), seen + fresh))
        yield plan.frame(key, at, late, result)

    def close(self) -> None:
        pass


def held_elements(spark: SparkSession, checkpoint: str, keys: Sequence[str], appended: bool = False) -> DataFrame:
    """``(keys, rows, elements)``: the numbers each key's carried state holds, read from the checkpoint of a stream.

    ``appended`` is for kernels whose state grows by the row.
    """
    names = [F.col(f"key.{k}").alias(k) for k in keys]
    if not appended:
        held = spark.read.format("statestore").load(checkpoint)
        size = F.size("value.groupState.state").cast("long")
        return held.select(*names, F.col("value.groupState.rows").alias("rows"), size.alias("elements"))
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    lists = read("rows").select(*names, F.size("list_element.state").cast("long").alias("n"))
    places = read("place").select(*names, F.col("value.rows").alias("rows"))
    return places.join(lists.groupBy(*keys).agg(F.sum("n").alias("elements")), list(keys))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(~F.col(LATE)).drop(LATE)


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col(LATE))
