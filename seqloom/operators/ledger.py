"""Accounting for a run: token and example counts, budgets, step estimates, learning rates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions.text import IGNORE
from seqloom.operators.numbering import CHUNK, running_in_buckets

STEPS_PER_BUCKET = 65_536


@dataclass(frozen=True)
class RunOptions:
    """What decides how long a run is; the first criterion given sets the horizon."""

    micro_batch: int = 1
    grad_accum: int = 1
    world: int = 1
    seq_len: int | None = None
    target_tokens: int | None = None
    epochs: float | None = None
    max_steps: int | None = None
    warmup_steps: int = 0
    lr: float = 1e-3
    min_lr: float | None = None

    def __post_init__(self) -> None:
        if min(self.micro_batch, self.grad_accum, self.world) < 1:
            raise ValueError("micro_batch, grad_accum and world must be positive")


def supervised(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda y: y != IGNORE))


def token_counts(blocks: DataFrame, by: list[str], labels: str = "labels") -> DataFrame:
    """Targets and blocks per group: a hash aggregate whose partial sums run before the shuffle."""
    return (
        blocks.select(*by, supervised(F.col(labels)).alias("_t"))
        .groupBy(*by)
        .agg(F.sum("_t").alias("supervised_tokens"), F.count("*").alias("examples"))
    )


def packed_counts(
    df: DataFrame, by: list[str], length: Column, seq_len: int, pack: bool = True, keep_empty: bool = False
) -> DataFrame:
    """What ``token_counts`` gives for the blocks of each group, from document lengths alone.

    Packed, a stream of ``n`` tokens holds ``n div T`` full blocks and a rest that is a block of
    its own from two tokens on; unpacked, a document of two or more tokens is one block. A block
    of ``m`` tokens has ``m - 1`` targets. No text is moved. With ``keep_empty`` a group without
    blocks counts as one example, the block of padding it is given.
    """
    size = seq_len + 1
    sized = df.select(*by, length.cast("long").alias("_n"))
    cut = F.least(F.col("_n"), F.lit(size).cast("long"))
    sums = sized.groupBy(*by).agg(
        F.sum(F.when(F.col("_n") > 0, F.col("_n") + 1).otherwise(0)).alias("_total"),
        F.sum(F.when(cut >= 2, cut - 1).otherwise(0)).alias("_targets"),
        F.count_if(cut >= 2).alias("_blocks"),
    )
    if pack:
        full, rest = F.expr(f"_total div {size}"), F.col("_total") % size
        tail = (rest >= 2).cast("long")
        targets, blocks = full * seq_len + tail * (rest - 1), full + tail
    else:
        targets, blocks = F.col("_targets"), F.col("_blocks")
    counts = sums.select(*by, targets.alias("supervised_tokens"), blocks.alias("examples"))
    if keep_empty:
        return counts.withColumn("examples", F.greatest("examples", F.lit(1).cast("long")))
    return counts.where(F.col("examples") > 0)


def step_ledger(counts: DataFrame, steps: int, step: str = "step") -> DataFrame:
    """Counts of all ranks summed per step, with running totals over the steps.

    ``steps`` is an upper bound of their number, from which that of the buckets follows.
    """
    per_step = counts.groupBy(step).agg(
        F.sum("supervised_tokens").alias("tokens"), F.sum("examples").alias("examples")
    )
    bucketed = per_step.withColumn(CHUNK, F.expr(f"`{step}` div {STEPS_PER_BUCKET}"))
    totals = {"cum_tokens": F.col("tokens"), "cum_examples": F.col("examples")}
    buckets = math.ceil(steps / STEPS_PER_BUCKET) + 1
    return running_in_buckets(bucketed, CHUNK, step, totals, buckets=buckets).drop(CHUNK)


def budget_cut(
    ledger: DataFrame, options: RunOptions, dataset_len: int | None = None, step: str = "step"
) -> DataFrame:
    """The steps a run takes: each starts only if no limit was reached before it.

    The step that crosses a limit is therefore the last one kept.
    """
    go_on = F.lit(True)
    if options.target_tokens is not None:
        go_on &= F.col("cum_tokens") - F.col("tokens") < options.target_tokens
    if options.epochs is not None:
        if dataset_len is None:
            raise ValueError("epochs needs the number of rows")
        wanted = math.ceil(options.epochs * dataset_len)
        go_on &= F.col("cum_examples") - F.col("examples") < wanted
    if options.max_steps is not None:
        go_on &= F.col(step) - 1 < options.max_steps
    return ledger.where(go_on)


def estimate_steps(options: RunOptions, dataset_len: Column | int | None = None) -> Column:
    """The nominal number of steps as an expression, so the row count may be an aggregate."""
    per_step = options.micro_batch * options.grad_accum * options.world
    if options.target_tokens is not None:
        if options.seq_len is None:
            raise ValueError("target_tokens needs seq_len")
        steps = F.lit(-(-options.target_tokens // (per_step * options.seq_len)))
    elif options.epochs is not None:
        if dataset_len is None:
            raise ValueError("epochs needs a table of known length")
        rows = dataset_len if isinstance(dataset_len, Column) else F.lit(dataset_len)
        steps = F.ceil(rows * F.lit(float(options.epochs)) / F.lit(float(per_step)))
    elif options.max_steps is not None:
        steps = F.lit(options.max_steps)
    else:
        raise ValueError("give target_tokens, epochs or max_steps")
    return F.greatest(steps.cast("long"), F.lit(1).cast("long"))


def learning_rate(step: Column, total: Column, options: RunOptions) -> Column:
    """Linear warm-up, then half a cosine from ``lr`` down to ``min_lr`` (a tenth by default)."""
    floor = (0.1 * options.lr if options.min_lr is None else options.min_lr) / options.lr
    warmup = options.warmup_steps
    rising = F.greatest(step / F.lit(float(max(warmup, 1))), F.lit(1e-8))
    done = F.least(
        F.lit(1.0), (step - warmup) / F.greatest((total - warmup).cast("double"), F.lit(1.0))
    )
    falling = F.lit(floor) + F.lit((1.0 - floor) * 0.5) * (1.0 + F.cos(F.lit(math.pi) * done))
    return F.lit(options.lr) * F.when(step < warmup, rising).otherwise(falling)


def unsupervised(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Rows in which nothing is a target."""
    return df.where(~F.exists(labels, lambda y: y != IGNORE))


def size_inventory(parameters: DataFrame, by: str = "layer") -> DataFrame:
    """Sizes per layer from ``(name, layer, shape)``, split by whether weight decay applies.

    Decay applies to arrays of two or more dimensions whose name does not mention ``embed``.
    """
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda acc, x: acc * x)
    decays = (F.size("shape") >= 2) & ~F.contains(F.col("name"), F.lit("embed"))
    return (
        parameters.select(by, size.alias("n"), decays.alias("decays"))
        .groupBy(by)
        .agg(
            F.sum("n").alias("size"),
            F.sum(F.when(F.col("decays"), F.col("n")).otherwise(0)).alias("decayed"),
            F.sum(F.when(F.col("decays"), 0).otherwise(F.col("n"))).alias("not_decayed"),
        )
    )
