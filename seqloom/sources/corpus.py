"""Batch and streaming readers for documents and conversations, and the durable sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from seqloom.operators.numbering import running_in_buckets
from seqloom.session import stored

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def scan_files(
    spark: SparkSession,
    files: str | list[str] | Mapping[str, str | list[str]],
    split: str = "train",
    name_glob: str | None = None,
) -> DataFrame:
    """Parquet files as one table.

    ``files`` is a path, a list of paths or a mapping from split name to either; ``name_glob``
    keeps only the files of a snapshot whose names match.
    """
    if isinstance(files, Mapping):
        if split not in files:
            raise ValueError(f"split {split!r} is not one of {sorted(files)}")
        files = files[split]
    reader = spark.read
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob).option("recursiveFileLookup", "true")
    return reader.parquet(*([files] if isinstance(files, str) else files))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows to all cores if the files give less tasks than that, else leave them alone.

    For work that stays inside the rows of a few small files; a large table never qualifies, and no result depends on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def register_dataset(
    spark: SparkSession, name: str, splits: Mapping[str, str | list[str]], config: str | None = None
) -> None:
    """Name a dataset: every split becomes a view of the session's catalog, ``name[__config]__split``."""
    for split in splits:
        scan_files(spark, splits, split).createOrReplaceTempView(_view(name, config, split))


def scan_named(spark: SparkSession, name: str, config: str | None = None, split: str = "train") -> DataFrame:
    """A named dataset's split, or a table or view that the session itself knows by that name."""
    if spark.catalog.tableExists(_view(name, config, split)):
        return spark.table(_view(name, config, split))
    if config is None and spark.catalog.tableExists(name):
        return spark.table(name)
    raise KeyError(f"no dataset {name!r} with config {config!r} and split {split!r}")


def _view(name: str, config: str | None, split: str) -> str:
    return "__".join(p for p in (name, config, split) if p)


def scan_turns(spark: SparkSession, files, split: str = "train") -> DataFrame:
    """Conversations as flat turns ``(conv_id, turn, role, text)``.

    Nested input ``(conv_id, messages)`` is flattened; missing roles and contents get their
    defaults either way.
    """
    table = scan_files(spark, files, split)
    if "messages" in table.columns:
        table = flatten_messages(table)
    return fill_turn_defaults(table)


def flatten_messages(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    turns = conversations.select(key, F.posexplode("messages").alias("turn", "m"))
    return turns.select(
        key,
        F.col("turn").cast("long").alias("turn"),
        F.col("m.role").alias("role"),
        F.col("m.content").alias("text"),
    )


def fill_turn_defaults(turns: DataFrame) -> DataFrame:
    return turns.withColumn("role", F.coalesce("role", F.lit("user"))).withColumn(
        "text", F.coalesce("text", F.lit(""))
    )


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    name_glob: str = "*.parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The parquet files below a path, and those still to come, as an unbounded table.

    A stream cannot infer its schema, so it must be given.
    """
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", name_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_blocks(blocks: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "error") -> None:
    """Blocks to parquet, one folder per value of ``by`` (say split and rank).

    A task may hold many folders' rows, so the rows are not gathered by folder: one folder
    may well be a third of the table. Spark sorts within each task before writing.
    """
    writer = blocks.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


#: Bytes of one file of sized output, by the measure below.
FILE_BYTES = 128 << 20


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes: the bytes of its strings, eight for every number, those of arrays included."""

    def of(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.octet_length(value)
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StringType | T.ArrayType | T.StructType):
                return F.aggregate(value, F.lit(0), lambda acc, x: acc + F.coalesce(of(x, kind.elementType), F.lit(8)))
            return F.size(value) * 8
        if isinstance(kind, T.StructType):
            return sum((F.coalesce(of(value[f.name], f.dataType), F.lit(8)) for f in kind.fields), F.lit(0))
        return F.lit(8)

    return sum((F.greatest(F.coalesce(of(F.col(f.name), f.dataType), F.lit(8)), F.lit(1)) for f in df.schema.fields), F.lit(0))


def plan_files(df: DataFrame, by: Sequence[str], target: int = FILE_BYTES) -> tuple[DataFrame, int]:
    """``(by, _bytes, _files, _first)`` per folder, and the number of tasks that write them.

    A folder of ``target`` bytes or more gets as many tasks as its bytes ask for, one file each; smaller ones are one file
    and share tasks of about ``target`` bytes in all. Folders are summed up in slices of a hash, never in one task.
    """
    sized = df.groupBy(*by).agg(F.sum(row_bytes(df)).cast("long").alias("_bytes"))
    big = F.col("_bytes") >= target
    files = F.when(big, F.greatest(F.round(F.col("_bytes") / target).cast("long"), F.lit(1).cast("long"))).otherwise(0)
    sliced = sized.withColumn("_files", files).withColumn("_slice", F.pmod(F.xxhash64(*by), F.lit(1024)).cast("long"))
    sums = {"_until": F.col("_files"), "_small": F.when(big, 0).otherwise(F.col("_bytes"))}
    placed = stored(running_in_buckets(sliced, "_slice", list(by), sums, buckets=1024), "folders")
    total = placed.agg(F.coalesce(F.sum("_files"), F.lit(0)), F.coalesce(F.max("_small"), F.lit(0))).first()
    shared = F.lit(total[0]) + F.floor((F.col("_small") - F.col("_bytes")) / target)
    first = F.when(F.col("_files") > 0, F.col("_until") - F.col("_files")).otherwise(shared)
    return placed.select(*by, "_bytes", "_files", first.cast("int").alias("_first")), total[0] + total[1] // target + 1


def write_sized(df: DataFrame, path: str, by: Sequence[str], target: int = FILE_BYTES, mode: str = "error") -> None:
    """Parquet, one folder per value of ``by``, in files of about ``target`` bytes (as ``row_bytes`` measures, before compression).

    Which file of a large folder takes a row is decided by the row's own contents, so a task that runs again writes the same
    rows; rows that are equal in all columns are in one file.
    """
    folders, tasks = plan_files(df, by, target)
    named = folders.withColumnsRenamed({c: f"_by_{i}" for i, c in enumerate(by)})
    match = F.lit(True)
    for i, c in enumerate(by):
        match &= F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    joined = df.withColumn("_hash", F.xxhash64(*df.columns)).join(named, match)
    task = F.col("_first") + F.pmod(F.col("_hash"), F.greatest("_files", F.lit(1).cast("long"))).cast("int")
    dealt = joined.withColumn("_task", task.cast("int")).repartitionById(tasks, F.col("_task"))
    dealt.select(*df.columns).write.mode(mode).partitionBy(*by).parquet(path)


def progress_rows(ledger: DataFrame, log_every: int, step: str = "step") -> DataFrame:
    """The ledger rows a run reports: every ``log_every``-th step, none when it is not positive."""
    if log_every <= 0:
        return ledger.where(F.lit(False))
    return ledger.where(F.col(step) % log_every == 0)


def append_progress(ledger: DataFrame, path: str, log_every: int, step: str = "step") -> None:
    progress_rows(ledger, log_every, step).write.mode("append").parquet(path)
