"""Whole runs: a corpus or conversations in, placed training rows and their ledger out.

Rows are dealt to ranks, cut into micro-batches, and the micro-batches of all epochs are numbered
through per rank, so that a step may straddle the end of an epoch. A run without shuffling repeats
the same batches, which are therefore built once and copied; a shuffled run deals every epoch anew.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.functions.text import IGNORE, Tokenizer
from seqloom.operators import blocks, chat, ledger, sharding
from seqloom.operators.ledger import RunOptions
from seqloom.operators.numbering import dense_index


@dataclass(frozen=True)
class JobOptions:
    """``shuffle`` deals a seeded permutation per epoch; a single rank is never shuffled."""

    seq_len: int
    pad: int
    run: RunOptions
    pack: bool = True
    shuffle: bool = False
    seed: int = 42

    @property
    def shuffled(self) -> bool:
        return self.shuffle and self.run.world > 1

    @property
    def batch_key(self) -> list[str]:
        return ["epoch", "rank", "batch"] if self.shuffled else ["rank", "batch"]


def deal(
    df: DataFrame,
    key: str,
    options: JobOptions,
    rows: int,
    epochs: int,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Add the batch key of every row: rank and micro-batch, and the epoch when shuffled."""
    world, micro = options.run.world, options.run.micro_batch
    if options.shuffled:
        placed = sharding.distributed_sample(df, key, world, options.seed, epochs, count=rows)
    else:
        placed = dense_index(df, key, "position", profile=profile)
        placed = placed.withColumn("rank", (F.col("position") % world).cast("int"))
    return placed.withColumn("batch", F.expr(f"(position div {world}) div {micro}")).drop("position")


def place(batches: DataFrame, options: JobOptions, rows: int, epochs: int) -> DataFrame:
    """Add epoch, ``batch_id`` (numbered through all epochs of the rank) and ``step``."""
    run = options.run
    if options.shuffled:
        share = F.lit(math.ceil(rows / run.world)).cast("long")
    else:
        batches = batches.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        share = F.expr(f"({rows} - rank + {run.world - 1}) div {run.world}")
    per_epoch = F.ceil(share / F.lit(run.micro_batch))
    numbered = batches.withColumn("batch_id", (F.col("epoch") * per_epoch + F.col("batch")).cast("long"))
    return numbered.withColumn("step", F.expr(f"batch_id div {run.grad_accum} + 1")).drop("batch")


def epochs_needed(options: JobOptions, rows: int, tokens: int, examples: int) -> int:
    """How often the rows have to be read at most, from the totals of one epoch."""
    run, wanted = options.run, []
    if run.target_tokens is not None:
        if tokens == 0:
            raise ValueError("no targets at all: a token budget cannot be met")
        wanted.append(run.target_tokens / tokens)
    if run.epochs is not None:
        wanted.append(run.epochs * rows / max(examples, 1))
    if run.max_steps is not None:
        smallest_share = max(rows // run.world, 1)
        wanted.append(run.max_steps * run.grad_accum * run.micro_batch / smallest_share)
    if not wanted:
        raise ValueError("give target_tokens, epochs or max_steps")
    # One more than the estimate: the batches of a reshuffled epoch pack a little differently.
    return math.ceil(min(wanted)) + 1


def run_ledger(
    counts: DataFrame, options: JobOptions, rows: int, epochs: int
) -> DataFrame:
    """The steps the run takes, with their counts, running totals and learning rates."""
    run = options.run
    placed = place(counts, options, rows, epochs)
    steps = math.ceil(epochs * rows / (run.world * run.grad_accum)) + epochs
    entries = ledger.budget_cut(ledger.step_ledger(placed, steps), run, rows)
    horizon = ledger.estimate_steps(replace(run, seq_len=options.seq_len), rows)
    return entries.withColumn("lr", ledger.learning_rate(F.col("step"), horizon, run))


def pretrain(
    docs: DataFrame, key: str, text: str, tokenizer: Tokenizer, options: JobOptions
) -> tuple[DataFrame, DataFrame]:
    """``(blocks, ledger)`` of a run over documents.

    The ledger, and with it the last step, comes from document lengths; text is moved only for
    the blocks themselves. Long documents are cut to four times ``seq_len`` tokens.
    """
    limit = 4 * options.seq_len
    rows = docs.count()
    length = tokenizer.count(F.col(text), limit)
    lengths = docs.select(key, length.alias("_len"))

    def counted(epochs: int) -> DataFrame:
        dealt = deal(lengths, key, options, rows, epochs, profile=docs)
        return ledger.packed_counts(
            dealt, options.batch_key, F.col("_len"), options.seq_len, options.pack, keep_empty=True
        )

    first = counted(1).agg(F.sum("supervised_tokens"), F.sum("examples")).first()
    epochs = epochs_needed(options, rows, first[0] or 0, first[1] or 0)
    entries = run_ledger(counted(epochs), options, rows, epochs)
    last = entries.agg(F.max("step")).first()[0] or 0

    clipped = docs.select(key, tokenizer.clip(F.col(text), limit).alias("_text"))
    dealt = deal(clipped, key, options, rows, epochs, profile=docs)
    if options.pack:
        built = blocks.pack_batches(
            dealt,
            options.batch_key,
            key,
            options.seq_len,
            options.pad,
            payload="_text",
            tokens=lambda t: tokenizer.ids(t, limit),
        )
    else:
        ids = dealt.withColumn("input_ids", tokenizer.ids(F.col("_text"), limit))
        built = blocks.unpacked_blocks(ids, [*options.batch_key, key], options.seq_len, options.pad)
        built = built.withColumnRenamed(key, "block")
    filled = blocks.with_empty_groups(built, dealt, options.batch_key, options.seq_len, options.pad)
    return place(filled, options, rows, epochs).where(F.col("step") <= last), entries


def supervise(
    examples: DataFrame, key: str, options: JobOptions, profile: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(rows, ledger)`` of a run over rendered conversations, padded batch by batch."""
    rows = examples.count()

    def dealt(epochs: int) -> DataFrame:
        return deal(examples, key, options, rows, epochs, profile)

    first = ledger.token_counts(examples, []).first()
    epochs = epochs_needed(options, rows, first["supervised_tokens"] or 0, first["examples"])
    counts = ledger.token_counts(dealt(epochs), options.batch_key)
    entries = run_ledger(counts, options, rows, epochs)
    last = entries.agg(F.max("step")).first()[0] or 0
    padded = chat.collate(
        dealt(epochs), options.batch_key, {"input_ids": options.pad, "labels": IGNORE}
    )
    return place(padded, options, rows, epochs).where(F.col("step") <= last), entries


# ------------------------------------------------------------------------- runs that stop and go on

COMMITS = "first_step long, last_step long, tokens long, examples long, cum_tokens long, cum_examples long"


@dataclass(frozen=True)
class Progress:
    """The counters a stopped run goes on from."""

    step: int = 0
    tokens: int = 0
    examples: int = 0


def progress(spark: SparkSession, path: str) -> Progress:
    """Where the run below ``path`` stands: the last entry of its commit log, or its start."""
    log = _commits(spark, path)
    last = log.agg(F.max(F.struct("last_step", "cum_tokens", "cum_examples")).alias("c")).first()["c"] if log else None
    return Progress(*last) if last else Progress()


def advance(blocks: DataFrame, path: str, last_step: int) -> Progress:
    """Write the steps of a run that are not committed yet, up to ``last_step``, and commit them.

    ``blocks`` are the run's placed rows (``step`` and ``labels`` among their columns), the same in every call. The rows of the steps go into a folder
    named by the first of them, and one row of the log, written when they are complete, says that they count. A run that
    dies in between leaves no such row: the next call overwrites that folder, whatever its last step was.
    Nothing of a committed step is computed again but the filter on ``step``.
    """
    spark = blocks.sparkSession
    done = progress(spark, path)
    if last_step <= done.step:
        return done
    folder = f"{path}/blocks/first_step={done.step + 1}"
    blocks.where(F.col("step").between(done.step + 1, last_step)).write.mode("overwrite").parquet(folder)
    counts = ledger.token_counts(spark.read.parquet(folder), []).first()
    new = Progress(last_step, done.tokens + (counts["supervised_tokens"] or 0), done.examples + counts["examples"])
    row = (done.step + 1, last_step, new.tokens - done.tokens, new.examples - done.examples, new.tokens, new.examples)
    commit = spark.createDataFrame([row], COMMITS).coalesce(1)
    commit.write.mode("overwrite").parquet(f"{path}/commits/number={done.step + 1}")
    return new


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all committed steps; folders without a commit are not read. Nothing before the first commit."""
    log = _commits(spark, path)
    folders = [r["first_step"] for r in log.select("first_step").collect()] if log else []  # one per call of ``advance``
    return spark.read.parquet(*[f"{path}/blocks/first_step={n}" for n in folders]) if folders else None


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(COMMITS).parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
