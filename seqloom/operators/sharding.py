"""Which rank and batch a row belongs to: strides, seeded permutations, micro-batches, steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from seqloom.functions.seeded import Feistel, digest, prefix_bucket
from seqloom.operators.numbering import ROWS_PER_CHUNK, dense_index, running_in_buckets


def shard(df: DataFrame, order: str, world: int, rank: int | None = None) -> DataFrame:
    """Rows dealt out in turn: row ``i`` of the order goes to rank ``i % world``.

    With one rank the table passes through unnumbered. ``rank`` keeps only that share.
    """
    _positive(world=world)
    if world == 1:
        return df.withColumn("rank", F.lit(0))
    dealt = dense_index(df, order, "idx")
    dealt = dealt.withColumn("rank", (F.col("idx") % world).cast("int")).drop("idx")
    return dealt if rank is None else dealt.where(F.col("rank") == rank)


def permutation(
    df: DataFrame, key: str, seed: int, epochs: int = 1, count: int | None = None
) -> DataFrame:
    """Each epoch's own repeatable order of the rows: ``epoch`` and ``position`` are added.

    The order is that of ``md5(seed:epoch:key)``, whose leading digits, as many as the number of rows needs, also cut it into
    equal buckets; a row is copied once per epoch inside its own task, and all copies are sorted.
    ``seeded_order`` sorts nothing.
    """
    _positive(epochs=epochs)
    rows, digits = df.count() if count is None else count, 3
    while rows > 16**digits * ROWS_PER_CHUNK:
        digits += 1
    copies = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    hashed = copies.withColumn("_md5", digest(seed, F.col("epoch"), F.col(key)))
    bucketed = hashed.withColumn("_slice", prefix_bucket(F.col("_md5"), digits))
    numbered = running_in_buckets(
        bucketed, "_slice", ["_md5", key], {"position": F.lit(1)}, keys=["epoch"], buckets=16**digits
    )
    return numbered.withColumn("position", F.col("position") - 1).drop("_md5", "_slice")


def seeded_order(
    df: DataFrame, key: str, seed: int, epochs: int = 1, count: int | None = None
) -> DataFrame:
    """Each epoch's own repeatable order of the rows, without sorting any: ``epoch`` and ``position`` are added.

    Rows are numbered once by their unique numeric ``key``. The position in an epoch is that number's place in a seeded permutation,
    an expression of the row alone, so more epochs add no shuffle.
    """
    _positive(epochs=epochs)
    n = df.count() if count is None else count
    numbered = dense_index(df, key, "_at")
    if n == 0:
        return numbered.select("*", F.lit(0).alias("epoch"), F.col("_at").alias("position")).drop("_at")
    shuffle = Feistel(n)
    each = [F.struct(F.lit(e).alias("epoch"), F.array(*map(_long, shuffle.keys(seed, e))).alias("keys")) for e in range(epochs)]
    copies = numbered.withColumn("_e", F.explode(F.array(*each)))
    position = shuffle.place(F.col("_at"), F.col("_e.keys"))
    return copies.withColumns({"epoch": F.col("_e.epoch"), "position": position}).drop("_at", "_e")


def _long(value: int):
    return F.lit(value).cast("long")


def distributed_sample(
    df: DataFrame, key: str, world: int, seed: int, epochs: int = 1, count: int | None = None
) -> DataFrame:
    """The permutation dealt to ``world`` equal ranks (``epoch, position, rank`` are added); see ``_dealt``."""
    _positive(world=world)
    n = df.count() if count is None else count
    return _dealt(permutation(df, key, seed, epochs, n), n, world)


def seeded_sample(
    df: DataFrame, key: str, world: int, seed: int, epochs: int = 1, count: int | None = None
) -> DataFrame:
    """The order of ``seeded_order`` dealt to ``world`` equal ranks: one shuffle for any number of epochs."""
    _positive(world=world)
    n = df.count() if count is None else count
    return _dealt(seeded_order(df, key, seed, epochs, n), n, world)


def _dealt(order: DataFrame, n: int, world: int) -> DataFrame:
    """Deal positions to ranks in turn.

    Where the rows do not divide evenly the first ones are dealt again at the end, by emitting
    them twice from the row they sit in.
    """
    if n == 0:
        return order.withColumn("rank", F.lit(0))
    total = math.ceil(n / world) * world
    # A table smaller than the padding wraps around more than once.
    places = F.sequence(F.col("position"), F.lit(total - 1).cast("long"), F.lit(n).cast("long"))
    dealt = order.withColumn("position", F.explode(places))
    return dealt.withColumn("rank", (F.col("position") % world).cast("int"))


def assign_batches(
    df: DataFrame,
    order: str,
    micro: int,
    rows_per_bucket: int = ROWS_PER_CHUNK,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Consecutive rows form micro-batches; the last may be short (``idx, batch_id`` are added)."""
    _positive(micro=micro)
    numbered = dense_index(df, order, "idx", rows_per_bucket, profile)
    return numbered.withColumn("batch_id", F.expr(f"idx div {micro}"))


def assign_steps(df: DataFrame, order: str, micro: int, accum: int, world: int = 1) -> DataFrame:
    """Rank, per-rank micro-batch and optimisation step of every row.

    Rows are dealt to the ranks in turn; each rank batches its own share, and step ``s`` covers
    the ``accum`` batches of that step on every rank. Steps count from 1.
    """
    _positive(micro=micro, accum=accum, world=world)
    numbered = dense_index(df, order, "idx")
    return (
        numbered.withColumn("rank", (F.col("idx") % world).cast("int"))
        .withColumn("batch_id", F.expr(f"(idx div {world}) div {micro}"))
        .withColumn("step", F.expr(f"(batch_id div {accum}) + 1"))
    )


def shard_report(df: DataFrame, sharded: DataFrame, key: str) -> DataFrame:
    """One row: source rows, dealt rows, keys in several shards, keys lost, keys invented.

    One aggregation by key over both tables; duplicates are combined before the shuffle.
    """
    both = df.select(key, F.lit(1).alias("src"), F.lit(None).cast("int").alias("rank")).unionByName(
        sharded.select(key, F.lit(0).alias("src"), "rank")
    )
    per_key = both.groupBy(key).agg(
        F.sum("src").alias("src"),
        F.count("rank").alias("dealt"),
        (F.min("rank") != F.max("rank")).alias("several"),
    )
    return per_key.agg(
        F.sum("src").alias("source_rows"),
        F.sum("dealt").alias("dealt_rows"),
        F.count_if("several").alias("keys_in_several_shards"),
        F.count_if((F.col("src") > 0) & (F.col("dealt") == 0)).alias("keys_lost"),
        F.count_if(F.col("src") == 0).alias("keys_invented"),
    )


def _positive(**options: int) -> None:
    for name, value in options.items():
        if value < 1:
            raise ValueError(f"{name} must be positive")


def every_n(i, n: int):
    """True for every ``n``-th of the places counted from 0; never when ``n`` is not positive."""
    return F.lit(False) if n <= 0 else (i + 1) % n == 0
