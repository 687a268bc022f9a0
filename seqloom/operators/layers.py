"""Aggregates over a schedule of layers: recurrent ones, and attention at every n-th place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions.vectors import norm
from seqloom.operators.sharding import every_n


def importance_mean(
    df: DataFrame, keys: Sequence[str], layer: str, importance: Column, attention_every: int
) -> DataFrame:
    """What each attention layer sees: the mean importance of the recurrent layers since the last.

    Layers after the last attention layer have no reader and give no row.
    """
    if attention_every <= 0:
        raise ValueError("without attention layers nothing reads the importance")
    rows = df.select(
        *keys,
        F.col(layer).alias("_layer"),
        F.expr(f"`{layer}` div {attention_every}").alias("_group"),
        importance.alias("_rho"),
        every_n(F.col(layer), attention_every).alias("_attends"),
    )
    grouped = rows.groupBy(*keys, "_group").agg(
        F.max(F.when(F.col("_attends"), F.col("_layer"))).alias("attention_layer"),
        F.avg(F.when(~F.col("_attends"), F.col("_rho"))).alias("importance"),
        F.count_if(~F.col("_attends")).alias("layers"),
    )
    return grouped.where(F.col("attention_layer").isNotNull() & (F.col("layers") > 0)).drop("_group")


def delta_ratio(df: DataFrame, by: Sequence[str], delta: str, out: str) -> DataFrame:
    """Mean size of the change against the mean size of what came out."""
    sizes = df.select(*by, norm(F.col(delta)).alias("_d"), norm(F.col(out)).alias("_q"))
    return sizes.groupBy(*by).agg(
        (F.avg("_d") / F.greatest(F.avg("_q"), F.lit(1e-8))).alias("delta_ratio")
    )
