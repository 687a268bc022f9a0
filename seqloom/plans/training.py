"""Whole runs over the tables: what every step holds, over several epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.text import CODEPOINTS
from seqloom.jobs import JobOptions, advance, pretrain, supervise, written
from seqloom.operators.ledger import RunOptions, token_counts
from seqloom.plans import chat
from seqloom.plans.corpus import CUT_IDS_SQL, PAD, SEQ_LEN, blocks_sql
from seqloom.plans.registry import query, r6, sql_r6, table
from seqloom.session import scratch_path, stored

PRETRAIN = RunOptions(micro_batch=4, grad_accum=3, world=2, epochs=3.0, warmup_steps=5)
SFT = RunOptions(micro_batch=4, grad_accum=2, world=3, epochs=2.5, warmup_steps=2)
SEED = 42


def rate_sql(run: RunOptions, total: str) -> str:
    w = run.warmup_steps
    return f"""{run.lr!r}::DOUBLE * CASE WHEN step < {w} THEN greatest(step / {float(w)}::DOUBLE, 1e-8)
        ELSE 0.1 + 0.45 * (1 + cos(pi() * least(1.0::DOUBLE, (step - {w}) / greatest({total} - {w}, 1)::DOUBLE))) END"""


def ledger_sql(run: RunOptions, rows: str) -> str:
    """From ``per_step(step, tokens, examples)`` to the steps the run takes."""
    per_step = run.micro_batch * run.grad_accum * run.world
    total = f"(SELECT greatest(ceil(count(*) * {run.epochs} / {float(per_step)}), 1) FROM {rows})"
    return f"""summed AS (
        SELECT *, CAST(sum(tokens) OVER (ORDER BY step) AS BIGINT) AS cum_tokens,
            CAST(sum(examples) OVER (ORDER BY step) AS BIGINT) AS cum_examples FROM per_step),
    ledger AS (
        SELECT step, tokens, examples, cum_tokens, cum_examples,
            {sql_r6(f"({rate_sql(run, total)}) * 1000")} AS lr_milli FROM summed
        WHERE cum_examples - examples < (SELECT ceil(count(*) * {run.epochs}) FROM {rows}))"""


BOTH_SQL = "SELECT *, tokens AS placed_tokens, examples AS placed_examples FROM ledger"


def both_counts(placed, entries):
    """Every step of the ledger or of the placed rows, with the counts of both."""
    built = token_counts(placed, ["step"]).select(
        "step", F.col("supervised_tokens").alias("placed_tokens"), F.col("examples").alias("placed_examples")
    )
    rate = r6(F.col("lr") * 1000.0).alias("lr_milli")
    columns = ["step", "tokens", "examples", "cum_tokens", "cum_examples", "placed_tokens", "placed_examples"]
    return entries.join(built, "step", "full").select(*columns, rate)


# Blocks outnumber documents, so the wanted number of examples comes before the third epoch ends;
# three copies of the batches are always enough.
PRETRAIN_SQL = f"""WITH numbered AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, * FROM documents),
    dealt AS (
        SELECT idx % {PRETRAIN.world} AS rank, (idx // {PRETRAIN.world}) // {PRETRAIN.micro_batch} AS batch,
            doc_id, text FROM numbered),
    {blocks_sql(f'SELECT rank, batch, doc_id AS o, {CUT_IDS_SQL} AS ids FROM dealt', 'rank, batch')},
    counts AS (
        SELECT rank, batch, sum(n_valid - 1) AS tokens, count(*) AS examples FROM blocks GROUP BY rank, batch),
    per_rank AS (SELECT rank, max(batch) + 1 AS per_epoch FROM dealt GROUP BY rank),
    per_step AS (
        SELECT (e * per_epoch + batch) // {PRETRAIN.grad_accum} + 1 AS step, CAST(sum(tokens) AS BIGINT) AS tokens,
            CAST(sum(examples) AS BIGINT) AS examples
        FROM counts JOIN per_rank USING (rank), range(3) AS r(e)
        GROUP BY (e * per_epoch + batch) // {PRETRAIN.grad_accum} + 1),
    {ledger_sql(PRETRAIN, 'documents')}
    {BOTH_SQL}"""


def pretraining(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    options = JobOptions(seq_len=SEQ_LEN, pad=PAD, run=PRETRAIN)
    return pretrain(docs, "doc_id", "text", CODEPOINTS, options)


@query("pretrain_run", PRETRAIN_SQL)
def pretrain_run(spark, sf_dir):
    """The ledger of a run beside what the blocks it places count."""
    return both_counts(*pretraining(spark, sf_dir))


@query("resume_run", PRETRAIN_SQL)
def resume_run(spark, sf_dir):
    """The same run, stopped twice: once between two commits, once while it wrote. No step is lost or counted twice."""
    path = scratch_path(spark, "run")
    placed, entries = pretraining(spark, sf_dir)
    last = entries.agg(F.max("step")).first()[0]
    done = advance(placed, path, last // 3)
    # Rows of steps that were never committed, as a lost run leaves them.
    placed.where(F.col("step") == done.step + 1).write.parquet(f"{path}/blocks/first_step={done.step + 1}")
    for stop in (2 * last // 3, last):
        done = advance(placed, path, stop)
    return both_counts(written(spark, path), entries)


SFT_SQL = f"""WITH {chat.CUT_SQL},
    size AS (SELECT count(*) AS n, CAST(ceil(count(*) / {float(SFT.world)}) AS BIGINT) AS share FROM cut),
    perm AS (
        SELECT e, conv_id, row_number() OVER (
            PARTITION BY e ORDER BY md5('{SEED}:' || e || ':' || conv_id), conv_id) - 1 AS position
        FROM cut, range(4) AS r(e)),
    dealt AS (
        SELECT e, conv_id, position FROM perm UNION ALL
        SELECT e, conv_id, position + n FROM perm, size WHERE position + n < share * {SFT.world}),
    batches AS (
        SELECT (e * CAST(ceil(share / {float(SFT.micro_batch)}) AS BIGINT)
            + (position // {SFT.world}) // {SFT.micro_batch}) // {SFT.grad_accum} + 1 AS step, conv_id
        FROM dealt, size),
    per_step AS (
        SELECT step, CAST(sum(len(list_filter(labels, lambda y: y <> -100))) AS BIGINT) AS tokens, count(*) AS examples
        FROM batches JOIN cut USING (conv_id) GROUP BY step),
    {ledger_sql(SFT, 'cut')}
    {BOTH_SQL}"""


@query("sft_run", SFT_SQL)
def sft_run(spark, sf_dir):
    """Shuffled anew each epoch and dealt to three ranks; the rendered rows are stored once.

    The ledger stands beside what the placed rows count.
    """
    examples = stored(chat.examples(spark, sf_dir), "examples")
    options = JobOptions(seq_len=chat.SEQ_LEN, pad=chat.PAD, run=SFT, shuffle=True, seed=SEED)
    return both_counts(*supervise(examples, "conv_id", options))
