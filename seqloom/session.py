"""Session set-up and the one place that decides where durable scratch data goes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("seqloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: The temporary folder of each local application whose session names no shared one.
_FALLBACK: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, the folder every executor can reach.

    Only a local master may fall back to a machine-local folder, which is kept here: the setting
    itself cannot be changed while a session runs.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _FALLBACK.get(context.applicationId) or tempfile.mkdtemp(prefix="seqloom-")
        _FALLBACK[context.applicationId] = base
    return f"{base.rstrip('/')}/seqloom/{name}-{uuid.uuid4().hex}"


#: Small rows that are worth a task and a file of their own, and how many tasks are never too many.
TASK_ROWS, LEAST_TASKS = 50_000, 16


def tasks_for(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df`` of at most ``rows`` rows in tasks of about ``each``: a shuffle's partitions join up, whole and without a further shuffle."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // each)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    For results that several queries read: they are computed once, their size is known from then
    on, and the loss of an executor costs a re-read instead of the whole lineage.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **totals: Column) -> tuple[DataFrame, dict]:
    """The same rows stored, and totals over them that are observed while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, *(total.alias(k) for k, total in totals.items())), name)
    return out, seen.get
