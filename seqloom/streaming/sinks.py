"""Micro-batch sinks: packed blocks and a token budget, both safe to replay.

Spark may run a micro-batch again after a failure. Each one overwrites its own folder, so the
result does not depend on how often it ran.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.blocks import pack_global
from seqloom.operators.ledger import token_counts

BATCH = "trigger"
SPENT = "the token budget is spent; this micro-batch stays uncounted"


def stream_to_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to parquet; a restart from the same checkpoint goes on where it was."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def stream_pack(
    documents: DataFrame,
    order: str,
    ids: Column | str,
    seq_len: int,
    pad: int,
    path: str,
    checkpoint: str,
    length: Column | None = None,
) -> StreamingQuery:
    """Pack every micro-batch as one stream of its own, as a loader packs the batch it was given."""

    def pack(batch: DataFrame, number: int) -> None:
        blocks = pack_global(batch, order, seq_len, pad, ids=ids, length=length)
        blocks.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return (
        documents.writeStream.foreachBatch(pack)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("tokens", T.LongType()),
        T.StructField("examples", T.LongType()),
        T.StructField("cum_tokens", T.LongType()),
        T.StructField(BATCH, T.LongType()),
    ]
)


def stream_budget(
    blocks: DataFrame, target_tokens: int, path: str, checkpoint: str, labels: str = "labels"
) -> StreamingQuery:
    """Count targets per micro-batch until ``target_tokens`` are reached.

    The test comes before each micro-batch, so the one that crosses the target is counted and
    none after it. A micro-batch that comes too late is refused: the query ends with an error before Spark
    commits the batch's offsets, and a run resumed with a larger target counts it first.
    ``run_until_spent`` takes that error for the end it is.
    """

    def account(batch: DataFrame, number: int) -> None:
        before = tokens_spent(batch.sparkSession, path, number)
        if before >= target_tokens:
            raise RuntimeError(SPENT)
        counts = token_counts(batch, [], labels)
        row = counts.select(
            F.coalesce("supervised_tokens", F.lit(0)).cast("long").alias("tokens"),
            F.col("examples").cast("long").alias("examples"),
        ).withColumn("cum_tokens", F.col("tokens") + F.lit(before))
        row.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    query = (
        blocks.writeStream.foreachBatch(account)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.spent = lambda: tokens_spent(blocks.sparkSession, path) >= target_tokens
    return query


def tokens_spent(spark: SparkSession, path: str, before: int | None = None) -> int:
    """Tokens counted so far, or by the micro-batches before one. Each entry holds the total up to it."""
    if before is not None:
        # Spark counts micro-batches from 0 without gaps: the one before has the total, if there is one.
        ledger = _read(spark, f"{path}/{BATCH}={before - 1}") if before else None
    else:
        ledger = read_ledger(spark, path)
    if ledger is None:
        return 0
    return ledger.agg(F.coalesce(F.max("cum_tokens"), F.lit(0))).first()[0]


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger, or nothing when no micro-batch has written to it yet."""
    return _read(spark, path)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def run_until_spent(query: StreamingQuery) -> None:
    """Wait until a query of ``stream_budget`` has read everything or has used up its budget, by its own ledger."""
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not query.spent():
            raise
