"""Order at scale: heavy keys, global positions and running totals without one-task windows.

Two shapes occur. A *global* order has no key: rows fall into ordered buckets, each bucket is
numbered on its own, and the table of bucket totals gives each bucket its start. There are as many
buckets as the rows need, so their totals are themselves summed as a tree, a few thousand at a time. A *keyed*
order uses one window per key, unless a key is heavy: its rows are cut into ordered chunks that
are summed separately, and each chunk receives the total of the chunks before it as one extra row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.session import stored

# Rows one task should sort for one key or bucket; documents are larger than other rows.
ROWS_PER_CHUNK = 1_000_000
TEXTS_PER_CHUNK = 50_000
# Totals that one task sums and that are sent to every task; longer tables of totals are summed as a tree.
FAN_OUT = 8192
# Values of the order column that are looked at per bucket to place the cuts.
SAMPLES_PER_BUCKET = 100
# A table too short for several buckets is still cut for all cores, down to this many rows each.
MIN_ROWS_PER_BUCKET = 200

CHUNK = "_chunk"
CARRIED = "_carried"
MARK = "_heavy"


@dataclass(frozen=True)
class Heavy:
    """Keys (as hashes of their columns) to be cut into chunks, and where their order is cut."""

    hashes: list[int]
    cuts: list[float]

    def __bool__(self) -> bool:
        return bool(self.hashes)


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def heavy_keys(
    df: DataFrame, keys: Sequence[str], order: str, rows_per_chunk: int = ROWS_PER_CHUNK
) -> Heavy:
    """All keys of more than ``rows_per_chunk`` rows.

    Rows are counted per key, in each task before the counts are shuffled, and only the heavy keys'
    hashes come to the driver: at most one per ``rows_per_chunk`` rows of the table. Only when there
    are any does a second pass take the quantiles of the order column over those keys' rows. The cut points are common to all heavy keys: a chunk of any one
    key is part of a slice of equal size, however its own rows are spread. Keys that share a hash
    with a heavy one are cut as well, which is harmless.
    """
    counts = df.groupBy(key_hash(keys).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.where(F.col("_n") > rows_per_chunk).collect()
    if not found:
        return Heavy([], [])
    hashes = [r["_h"] for r in found]
    rows = _marked(df.select(order, *keys), keys, hashes).where(F.col(MARK))
    n = sum(r["_n"] for r in found)
    return Heavy(hashes, cut_points(rows, order, math.ceil(n / rows_per_chunk), n))


def _marked(df: DataFrame, keys: Sequence[str], hashes: Sequence[int]) -> DataFrame:
    """Add ``_heavy``: is the row's key one of these? A join, so the list may be long."""
    listed = df.sparkSession.createDataFrame([(h,) for h in hashes], "_h long").withColumn(MARK, F.lit(True))
    marked = df.withColumn("_h", key_hash(keys)).join(listed, "_h", "left").drop("_h")
    return marked.withColumn(MARK, F.coalesce(MARK, F.lit(False)))


def with_chunks(df: DataFrame, keys: Sequence[str], order: str, heavy: Heavy) -> DataFrame:
    """Add ``_chunk``: null for ordinary keys, the ordered slice of the row for heavy ones."""
    if not heavy:
        return df.withColumn(CHUNK, F.lit(None).cast("long"))
    sliced = _marked(_bucketed(df, order, heavy.cuts), keys, heavy.hashes)
    return sliced.withColumn(CHUNK, F.when(F.col(MARK), F.col(CHUNK))).drop(MARK)


def _bucketed(df: DataFrame, order: str, cuts: Sequence[float]) -> DataFrame:
    """Add ``_chunk``, the number of cut points at or below the order value, by binary search.

    Rows without an order value sort first, so they are in the first chunk.
    """
    if not cuts:
        return df.withColumn(CHUNK, F.lit(0).cast("long"))
    splits = [-math.inf, *cuts, math.inf]
    keyed = df.withColumn("_order", F.col(order).cast("double"))
    bucketed = Bucketizer(splits=splits, inputCol="_order", outputCol="_bucket").transform(keyed)
    return bucketed.withColumn(CHUNK, F.coalesce(F.col("_bucket").cast("long"), F.lit(0))).drop("_order", "_bucket")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Running sums and maxima per key up to and including each row, in unique ``order``."""
    exprs = {**(sums or {}), **(maxima or {})}
    combine = {n: F.sum for n in sums or {}} | {n: F.max for n in maxima or {}}
    values = df.select("*", *[e.alias(f"_in_{n}") for n, e in exprs.items()])
    heavy = heavy_keys(df, keys, order, rows_per_chunk)
    if not heavy:
        within = Window.partitionBy(*keys).orderBy(order)
        within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = values.select("*", *[combine[n](f"_in_{n}").over(within).alias(n) for n in exprs])
        return out.drop(*[f"_in_{n}" for n in exprs])

    rows = with_chunks(values, keys, order, heavy)
    totals = (
        rows.where(F.col(CHUNK).isNotNull())
        .groupBy(*keys, CHUNK)
        .agg(*[combine[n](f"_in_{n}").alias(f"_in_{n}") for n in exprs])
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, CHUNK, *[combine[n](f"_in_{n}").over(before).alias(f"_in_{n}") for n in exprs]
    ).withColumn(CARRIED, F.lit(True))
    # The carried row has no order value and so sorts first in its chunk.
    stacked = rows.withColumn(CARRIED, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    first = Window.partitionBy(*keys, CHUNK).orderBy(F.col(CARRIED).desc(), F.col(order))
    first = first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = stacked.select("*", *[combine[n](f"_in_{n}").over(first).alias(n) for n in exprs])
    return out.where(~F.col(CARRIED)).drop(CARRIED, CHUNK, *[f"_in_{n}" for n in exprs])


def cut_points(df: DataFrame, order: str, buckets: int, rows: int | None = None) -> list[float]:
    """Quantiles of the order column that split the rows into about equal buckets.

    Only some values are looked at, chosen by a hash of the value, about ``SAMPLES_PER_BUCKET`` for each bucket: they place the cuts
    and have no part in any result. Up to ``FAN_OUT`` buckets their quantiles meet in one aggregate of bounded size.
    For more, the chosen values are numbered by this very module, with fewer buckets by a factor of ``SAMPLES_PER_BUCKET``
    rows each, and every so-manieth is a cut. One number per bucket reaches the driver.
    """
    if buckets <= 1:
        return []
    if rows is None:
        rows = df.count()
    every = max(1, rows // (buckets * SAMPLES_PER_BUCKET))
    values = df.select(F.col(order).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if every > 1:
        values = values.where(F.pmod(F.xxhash64("_v"), F.lit(every)) == 0)
    if buckets <= FAN_OUT:
        probabilities = [i / buckets for i in range(1, buckets)]
        found = values.agg(F.percentile_approx("_v", probabilities, max(10_000, 20 * buckets)).alias("q")).first()["q"]
        return sorted({float(x) for x in found or []})
    # Equal values may be chosen together; the row's place among them does not matter to a cut.
    chosen = stored(values, "order_values")
    n = chosen.count()
    step = max(1, n // buckets)
    coarse = _bucketed(chosen, "_v", cut_points(chosen, "_v", math.ceil(buckets / SAMPLES_PER_BUCKET), n))
    places = running_in_buckets(coarse, CHUNK, "_v", {"_i": F.lit(1)}, buckets=math.ceil(buckets / SAMPLES_PER_BUCKET))
    cuts = places.where(F.col("_i") % step == 0).select("_v").distinct()
    return sorted(r["_v"] for r in cuts.collect())


def with_buckets(
    df: DataFrame,
    order: str,
    rows_per_bucket: int = ROWS_PER_CHUNK,
    profile: DataFrame | None = None,
) -> tuple[DataFrame, int]:
    """Add ``_chunk``, an ordered bucket of the numeric ``order`` column; also returns their number.

    The cut points are plain numbers in the plan, so a task that is run again, or a second
    branch of the same plan, puts every row in the same bucket. They come from ``profile``, a
    table with the same order column that is cheaper to read when ``df`` is computed.
    """
    source = df if profile is None else profile
    rows = source.count()
    for_cores = min(4 * df.sparkSession.sparkContext.defaultParallelism, rows // MIN_ROWS_PER_BUCKET)
    cuts = cut_points(source, order, max(math.ceil(rows / rows_per_bucket), for_cores), rows)
    return _bucketed(df, order, cuts), len(cuts) + 1


def bucket_starts(
    totals: DataFrame, keys: Sequence[str], bucket: str, names: Sequence[str], buckets: int
) -> DataFrame:
    """``(keys, bucket, _start_…)``: the sum of all earlier buckets' totals, as a tree.

    Up to ``FAN_OUT`` buckets are one window. More are summed in groups of ``FAN_OUT``; the groups' own totals are the next
    level, and each group's start is added to its buckets.
    """
    starts = lambda w: [F.coalesce(F.sum(f"_in_{n}").over(w), F.lit(0)).alias(f"_start_{n}") for n in names]
    if buckets <= FAN_OUT:
        w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*keys, bucket, *starts(w))
    up = f"{bucket}_up"
    grouped = totals.withColumn(up, F.floor(F.col(bucket) / F.lit(FAN_OUT)))
    w = Window.partitionBy(*keys, up).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    inner = grouped.select(*keys, bucket, up, *starts(w))
    above = grouped.groupBy(*keys, up).agg(*[F.sum(f"_in_{n}").alias(f"_in_{n}") for n in names])
    outer = bucket_starts(above, keys, up, names, math.ceil(buckets / FAN_OUT) + 1)
    outer = outer.withColumnsRenamed({f"_start_{n}": f"_above_{n}" for n in names})
    joined = inner.join(outer, [*keys, up])
    return joined.select(*keys, bucket, *[(F.col(f"_start_{n}") + F.col(f"_above_{n}")).alias(f"_start_{n}") for n in names])


def running_in_buckets(
    df: DataFrame,
    bucket: str,
    order: str | Sequence[str],
    sums: Mapping[str, Column],
    keys: Sequence[str] = (),
    buckets: int = FAN_OUT,
) -> DataFrame:
    """Running sums over ``(bucket, order)`` where the buckets themselves are ordered.

    ``buckets`` is about their number (per ``keys``, which must be few: say, epochs). Each bucket is sorted by one
    task. The starts of up to ``FAN_OUT`` buckets are sent to all tasks; more are joined on the partitioning that
    the buckets already have.
    """
    order = [order] if isinstance(order, str) else list(order)
    # The join below would add a null test on a nullable bucket to one of its two branches. Pushed
    # down, the test computes the bucket for every input row and makes the branches differ, so
    # that Spark could no longer run their common part once.
    solid = df.withColumn(bucket, F.coalesce(F.col(bucket), F.lit(-1)))
    values = solid.select("*", *[e.alias(f"_in_{n}") for n, e in sums.items()])
    totals = values.groupBy(*keys, bucket).agg(*[F.sum(f"_in_{n}").alias(f"_in_{n}") for n in sums])
    starts = bucket_starts(totals, keys, bucket, list(sums), buckets)
    within = (
        Window.partitionBy(*keys, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = values.select("*", *[F.sum(f"_in_{n}").over(within).alias(f"_run_{n}") for n in sums])
    out = local.join(F.broadcast(starts) if buckets <= FAN_OUT else starts, [*keys, bucket])
    return out.select(
        *[c for c in df.columns],
        *[(F.col(f"_run_{n}") + F.col(f"_start_{n}")).alias(n) for n in sums],
    )


def dense_index(
    df: DataFrame,
    order: str,
    name: str = "idx",
    rows_per_bucket: int = ROWS_PER_CHUNK,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Number all rows 0, 1, 2, … by a unique numeric column."""
    bucketed, buckets = with_buckets(df, order, rows_per_bucket, profile)
    numbered = running_in_buckets(bucketed, CHUNK, order, {name: F.lit(1)}, buckets=buckets)
    return numbered.withColumn(name, F.col(name) - 1).drop(CHUNK)


def running_total(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column],
    rows_per_bucket: int = ROWS_PER_CHUNK,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Running sums over the whole table by a unique numeric column."""
    bucketed, buckets = with_buckets(df, order, rows_per_bucket, profile)
    return running_in_buckets(bucketed, CHUNK, order, sums, buckets=buckets).drop(CHUNK)
