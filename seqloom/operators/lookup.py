"""Ids to rows of a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def lookup(
    df: DataFrame, key: str, dimension: DataFrame, dimension_key: str, missing: str = "error"
) -> DataFrame:
    """Add the dimension's columns to every row. No row is lost: an id that the dimension lacks is an
    error, or with ``missing="null"`` a row of nulls.

    No broadcast hint: Spark broadcasts a dimension whose measured size is below
    ``spark.sql.autoBroadcastJoinThreshold``. Beyond it both sides shuffle on the id, and AQE
    splits the partitions of ids that are too frequent.
    """
    if missing not in ("error", "null"):
        raise ValueError(f"missing is 'error' or 'null', not {missing!r}")
    known = dimension.withColumnRenamed(dimension_key, key).withColumn("_found", F.lit(True))
    out = df.join(known, key, "left")
    if missing == "error":
        unknown = F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
        out = out.where(F.coalesce("_found", F.raise_error(unknown).cast("boolean")))
    return out.drop("_found")
