"""Queries about how a run deals out its rows and what it adds up to."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from seqloom.functions.seeded import PRIME, Feistel
from seqloom.functions.text import CODEPOINTS
from seqloom.operators import ledger, sharding
from seqloom.operators.ledger import RunOptions
from seqloom.plans.corpus import CUT_IDS_SQL, MAX_TOKENS, SEQ_LEN, blocks_sql
from seqloom.plans.registry import query, r6, sql_r6, table
from seqloom.session import stored
from seqloom.sources.corpus import progress_rows

SEED = 42
WORLD = 2
OPTIONS = RunOptions(micro_batch=4, grad_accum=2, world=WORLD, warmup_steps=10, lr=1e-3)
LOG_EVERY = 5
SAVE_EVERY = 8


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id")


@query(
    "shard_mod",
    "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 4 AS INTEGER) AS rank "
    "FROM documents",
)
def shard_mod(spark, sf_dir):
    return sharding.shard(documents(spark, sf_dir), "doc_id", 4)


@query(
    "shard_invariants",
    """WITH dealt AS (
        SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS rank FROM documents),
    per_key AS (
        SELECT d.doc_id, s.doc_id IS NULL AS invented, count(DISTINCT d.rank) AS ranks
        FROM dealt d LEFT JOIN documents s USING (doc_id) GROUP BY d.doc_id, s.doc_id)
    SELECT (SELECT count(*) FROM documents) AS source_rows, (SELECT count(*) FROM dealt) AS dealt_rows,
        CAST(count(*) FILTER (ranks > 1) AS BIGINT) AS keys_in_several_shards,
        (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dealt)) AS keys_lost,
        CAST(count(*) FILTER (invented) AS BIGINT) AS keys_invented FROM per_key""",
)
def shard_invariants(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return sharding.shard_report(docs, sharding.shard(docs, "doc_id", 4), "doc_id")


@query(
    "distributed_sample",
    f"""WITH n AS (SELECT count(*) AS n, CAST(ceil(count(*) / 7.0) * 7 AS BIGINT) AS total FROM documents),
    perm AS (
        SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:0:' || doc_id), doc_id) - 1 AS position
        FROM documents),
    dealt AS (
        SELECT doc_id, position FROM perm UNION ALL
        SELECT doc_id, position + n FROM perm, n WHERE position + n < total)
    SELECT doc_id, position, CAST(position % 7 AS INTEGER) AS rank FROM dealt""",
)
def distributed_sample(spark, sf_dir):
    dealt = sharding.distributed_sample(documents(spark, sf_dir), "doc_id", 7, SEED)
    return dealt.select("doc_id", "position", "rank")


@query(
    "epoch_cycle",
    f"""SELECT doc_id, CAST(e AS INTEGER) AS epoch, row_number() OVER (
            PARTITION BY e ORDER BY md5('{SEED}:' || e || ':' || doc_id), doc_id) - 1 AS position
    FROM documents, range(3) AS r(e)""",
)
def epoch_cycle(spark, sf_dir):
    order = sharding.permutation(documents(spark, sf_dir), "doc_id", SEED, epochs=3)
    return order.select("doc_id", "epoch", "position")


def _seeded_sql(world: int, epochs: int) -> str:
    """The same rounds and walks over lists; the number of rows is the table's."""
    turn = (
        "(x % side) * side + ((x // side) + ((x % side + k) % {p}) * ((x % side + k) % {p}) % {p}) % side".format(p=PRIME)
    )
    once = f"list_reduce(list_prepend({{}}, keys), lambda x, k: {turn})".format
    keys = ", ".join(f"({e}, {Feistel(1).keys(SEED, e)}::BIGINT[])" for e in range(epochs))
    return f"""WITH n AS (
        SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS side, ceil(count(*) / {world})::BIGINT * {world} AS total FROM documents),
    numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
    placed AS (
        SELECT doc_id, epoch, list_reduce(list_prepend({once('i')}, range(least(side * side - n, 40))),
            lambda y, _: CASE WHEN y < n THEN y ELSE {once('y')} END) AS position, n, total
        FROM numbered, n, (VALUES {keys}) AS e(epoch, keys)),
    dealt AS (
        SELECT doc_id, epoch, position FROM placed UNION ALL
        SELECT doc_id, epoch, position + n FROM placed WHERE position + n < total)
    SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, position, CAST(position % {world} AS INTEGER) AS rank FROM dealt"""


@query("seeded_sample", _seeded_sql(7, 3))
def seeded_sample(spark, sf_dir):
    """Three epochs' permutations as expressions of one numbering."""
    dealt = sharding.seeded_sample(documents(spark, sf_dir), "doc_id", 7, SEED, epochs=3)
    return dealt.select("doc_id", "epoch", "position", "rank")


@query(
    "assign_batches",
    "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, "
    "(row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id FROM documents",
)
def assign_batches(spark, sf_dir):
    return sharding.assign_batches(documents(spark, sf_dir), "doc_id", 8)


STEPS_SQL = f"""numbered AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, * FROM documents),
    dealt AS (
        SELECT idx % {WORLD} AS rank, (idx // {WORLD}) // {OPTIONS.micro_batch} AS batch_id,
            doc_id, text FROM numbered),
    {blocks_sql(f'SELECT rank, batch_id, doc_id AS o, {CUT_IDS_SQL} AS ids FROM dealt', 'rank, batch_id')},
    per_step AS (
        SELECT batch_id // {OPTIONS.grad_accum} + 1 AS step,
            CAST(sum(n_valid - 1) AS BIGINT) AS tokens, count(*) AS examples
        FROM blocks GROUP BY batch_id // {OPTIONS.grad_accum} + 1),
    ledger AS (
        SELECT step, tokens, examples,
            CAST(sum(tokens) OVER (ORDER BY step) AS BIGINT) AS cum_tokens,
            CAST(sum(examples) OVER (ORDER BY step) AS BIGINT) AS cum_examples FROM per_step)"""


def run_ledger(spark, sf_dir):
    """From text lengths only: the blocks of a batch are counted without being built."""
    docs = table(spark, sf_dir, "documents")
    lengths = docs.select("doc_id", CODEPOINTS.count(F.col("text"), MAX_TOKENS).alias("n"))
    rows = sharding.assign_steps(
        lengths, "doc_id", OPTIONS.micro_batch, OPTIONS.grad_accum, OPTIONS.world
    )
    counts = ledger.packed_counts(rows, ["step", "rank", "batch_id"], F.col("n"), SEQ_LEN)
    per_step = OPTIONS.micro_batch * OPTIONS.grad_accum * OPTIONS.world
    return ledger.step_ledger(counts, math.ceil(docs.count() / per_step))


@query("step_ledger", f"WITH {STEPS_SQL} SELECT * FROM ledger")
def step_ledger(spark, sf_dir):
    return run_ledger(spark, sf_dir)


BUDGET_STEPS = 9


# Each limit by itself (a third of the tokens, half an epoch of examples, a number of steps), then all together: the first one reached ends the run.
def _budget_sql() -> str:
    tokens = "cum_tokens - tokens < (SELECT max(cum_tokens) // 3 FROM ledger)"
    examples = "cum_examples - examples < (SELECT ceil(count(*) * 0.5) FROM documents)"
    steps = f"step - 1 < {BUDGET_STEPS}"
    each = {"tokens": tokens, "epochs": examples, "steps": steps, "first": f"{tokens} AND {examples} AND {steps}"}
    return " UNION ALL ".join(f"SELECT '{name}' AS criterion, * FROM ledger WHERE {limit}" for name, limit in each.items())


@query("budget_cut", f"WITH {STEPS_SQL} {_budget_sql()}")
def budget_cut(spark, sf_dir):
    """The steps of a run under each of its limits and under all of them."""
    entries = stored(run_ledger(spark, sf_dir), "ledger")
    last = entries.agg(F.max("cum_tokens")).first()[0] or 0
    limits = {"tokens": {"target_tokens": last // 3}, "epochs": {"epochs": 0.5}, "steps": {"max_steps": BUDGET_STEPS}}
    limits["first"] = limits["tokens"] | limits["epochs"] | limits["steps"]
    rows = table(spark, sf_dir, "documents").count()
    cuts = [
        ledger.budget_cut(entries, RunOptions(**limit), rows).select(F.lit(name).alias("criterion"), "*")
        for name, limit in limits.items()
    ]
    return reduce(DataFrame.unionByName, cuts)


@query(
    "estimate_steps",
    """SELECT CAST(ceil(count(*) * 3.0 / 16) AS BIGINT) AS by_epochs,
        CAST(greatest(ceil(sum(length(text)) / (16 * 512.0)), 1) AS BIGINT) AS by_tokens
    FROM documents""",
)
def estimate_steps(spark, sf_dir):
    """Steps for three epochs, and for as many tokens as the corpus has characters."""
    docs = table(spark, sf_dir, "documents")
    by_epochs = RunOptions(micro_batch=4, grad_accum=2, world=2, epochs=3.0)
    totals = docs.agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("tokens")).first()
    by_tokens = RunOptions(
        micro_batch=4, grad_accum=2, world=2, seq_len=512, target_tokens=totals["tokens"]
    )
    return docs.agg(
        ledger.estimate_steps(by_epochs, F.count("*")).alias("by_epochs"),
        ledger.estimate_steps(by_tokens).alias("by_tokens"),
    )


LR_SQL = f"""rates AS (
        SELECT *, {OPTIONS.lr!r}::DOUBLE * CASE WHEN step < {OPTIONS.warmup_steps}
            THEN greatest(step / {float(OPTIONS.warmup_steps)}::DOUBLE, 1e-8)
            ELSE 0.1 + 0.45 * (1 + cos(pi() * least(1.0::DOUBLE, (step - {OPTIONS.warmup_steps})
                / greatest(total - {OPTIONS.warmup_steps}, 1)::DOUBLE))) END AS lr
        FROM ledger, (SELECT greatest(CAST(ceil(count(*) / 16.0) AS BIGINT), 1) AS total FROM documents))"""


def rates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").count()
    options = RunOptions(
        micro_batch=OPTIONS.micro_batch,
        grad_accum=OPTIONS.grad_accum,
        world=OPTIONS.world,
        epochs=1.0,
        warmup_steps=OPTIONS.warmup_steps,
        lr=OPTIONS.lr,
    )
    total = ledger.estimate_steps(options, rows)
    lr = ledger.learning_rate(F.col("step"), total, options)
    return run_ledger(spark, sf_dir).withColumn("lr", lr)


@query(
    "lr_schedule",
    f"WITH {STEPS_SQL}, {LR_SQL} SELECT step, {sql_r6('lr * 1000')} AS lr_milli FROM rates",
)
def lr_schedule(spark, sf_dir):
    return rates(spark, sf_dir).select("step", r6(F.col("lr") * 1000.0).alias("lr_milli"))


@query(
    "progress_log",
    f"""WITH {STEPS_SQL}, {LR_SQL}
    SELECT step, {sql_r6('lr * 1000')} AS lr_milli, cum_tokens AS tokens, cum_examples AS examples,
        step % {SAVE_EVERY} = 0 AS saves
    FROM rates WHERE step % {LOG_EVERY} = 0""",
)
def progress_log(spark, sf_dir):
    logged = progress_rows(rates(spark, sf_dir), LOG_EVERY)
    return logged.select(
        "step",
        r6(F.col("lr") * 1000.0).alias("lr_milli"),
        F.col("cum_tokens").alias("tokens"),
        F.col("cum_examples").alias("examples"),
        sharding.every_n(F.col("step") - 1, SAVE_EVERY).alias("saves"),
    )


@query(
    "param_inventory",
    """WITH p AS (
        SELECT lang AS layer, CASE WHEN doc_id % 5 = 0 THEN 'embed.' ELSE 'block.' END || doc_id AS name,
            CASE WHEN doc_id % 2 = 0 THEN [length(text), 1 + doc_id % 7] ELSE [length(text)] END AS shape FROM documents),
    sized AS (SELECT *, list_product(shape)::BIGINT AS n, len(shape) >= 2 AND NOT contains(name, 'embed') AS decays FROM p)
    SELECT layer, sum(n)::BIGINT AS size, coalesce(sum(n) FILTER (decays), 0)::BIGINT AS decayed,
        coalesce(sum(n) FILTER (NOT decays), 0)::BIGINT AS not_decayed FROM sized GROUP BY layer""",
)
def param_inventory(spark, sf_dir):
    """Every document stands for a parameter: its language is the layer, its length and id give a shape."""
    n, i = F.length("text").cast("long"), F.col("doc_id")
    shape = F.when(i % 2 == 0, F.array(n, 1 + i % 7)).otherwise(F.array(n))
    name = F.concat(F.when(i % 5 == 0, "embed.").otherwise("block."), i.cast("string"))
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("layer"), name.alias("name"), shape.alias("shape"))
    return ledger.size_inventory(rows)
