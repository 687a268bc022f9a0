"""Streaming queries: the tables read as file streams, the results compared with the batch SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seqloom.functions.kernels import CausalAttention, CausalFir, FastMemory, SlowMemory
from seqloom.functions.text import CODEPOINTS
from seqloom.functions import vectors as vx
from seqloom.operators.ledger import token_counts
from seqloom.operators.numbering import cut_points
from seqloom.plans import corpus, ordered
from seqloom.plans.registry import ORACLES, query, r6, table
from seqloom.session import scratch_path, stored
from seqloom.sources.corpus import row_bytes, stream_files
from seqloom.streaming import sinks
from seqloom.streaming.stateful import accepted, held_elements, stream_scan


#: Micro-batches of a registered stream; every one after the first goes on from carried state.
TRIGGERS = 4
#: Rows and bytes (as ``row_bytes`` measures) that one task writes to a file of a delivery.
ROWS_PER_FILE, BYTES_PER_FILE = 250_000, 16 << 20


def deliveries(spark, rows, name, part, parts, made=lambda share: share):
    """``(path, files)``: a table as ``parts`` deliveries of a feed, by ``part`` (0, 1, …), in as many files each as the largest needs.

    A micro-batch of ``files`` files is one delivery: they are written one after the other, and the source takes the oldest first.
    Rows are dealt to the files by their first column, and ``made`` may turn what a task holds into the rows of the feed.
    A part too short to fill its files gets empty ones.
    """
    path = scratch_path(spark, f"{name}-feed")
    dealt = rows.where(part.between(0, parts - 1)).groupBy(part.alias("_part"))
    sizes = dealt.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(rows)).alias("bytes")).collect()
    files = max([math.ceil(max(r["n"] / ROWS_PER_FILE, r["bytes"] / BYTES_PER_FILE)) for r in sizes], default=1)
    for i in range(parts):
        share = made(rows.where(part == i).repartition(files, rows.columns[0]))
        share.write.mode("append").parquet(path)
        written = len(spark.read.schema(share.schema).parquet(path).inputFiles())
        for _ in range((i + 1) * files - written):
            spark.createDataFrame([], share.schema).coalesce(1).write.mode("append").parquet(path)
    return path, files


def stream_table(spark, sf_dir, name, order):
    """A table as a stream of ``TRIGGERS`` parts that arrive in order."""
    rows = table(spark, sf_dir, name)
    cuts = cut_points(rows, order, TRIGGERS)
    part = F.lit(0)
    for cut in cuts:
        part = part + (F.col(order) >= cut).cast("int")
    path, files = deliveries(spark, rows, name, part, len(cuts) + 1)
    return stream_files(spark, path, rows.schema, files_per_trigger=files)


def drained(spark, df, name):
    """Run a stream over everything there is and read what it wrote."""
    path = scratch_path(spark, name)
    sinks.stream_to_files(df, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def event_stream(spark, sf_dir):
    value = F.col("value")
    return stream_table(spark, sf_dir, "events", "event_id").select(
        "event_id",
        "user_id",
        F.array(value).alias("raw"),
        F.array(value - 100.0).alias("q"),
        F.array(F.when(value >= 100.0, 1.0).otherwise(-1.0)).alias("k"),
        F.array(F.lit(1.0)).alias("one"),
        F.array(value / 100.0).alias("v"),
        vx.bounded_gate(value / 100.0 - 1.0, 0.9, 0.9999).alias("decay"),
        vx.sigmoid(value / 200.0).alias("erase"),
        vx.sigmoid(-value / 300.0).alias("write"),
    )


def event_result(spark, sf_dir, name, kernel, inputs, column):
    out = stream_scan(event_stream(spark, sf_dir), ["user_id"], "event_id", kernel, inputs)
    found = drained(spark, accepted(out), name)
    return found.select("user_id", "event_id", r6(F.col("out")[0]).alias(column))


@query("stream_slow_memory", ORACLES["slow_memory_events"])
def stream_slow_memory(spark, sf_dir):
    kernel = SlowMemory(1, ordered.EPS)
    return event_result(spark, sf_dir, "slow", kernel, {"q": "q", "v": "raw"}, "memory")


@query("stream_fir", ORACLES["causal_fir"])
def stream_fir(spark, sf_dir):
    kernel = CausalFir([[w] for w in ordered.FIR], [ordered.FIR_BIAS])
    return event_result(spark, sf_dir, "fir", kernel, {"x": "raw"}, "fir")


@query("stream_fast_memory", ORACLES["fast_memory_r1"])
def stream_fast_memory(spark, sf_dir):
    kernel = FastMemory(1, 1)
    return event_result(spark, sf_dir, "fast", kernel, ordered.FAST_R1_INPUTS, "memory")


def sequence_stream(spark, sf_dir):
    x = vx.doubles(F.col("embedding"))
    return stream_table(spark, sf_dir, "embeddings", "vec_id").select(
        F.expr(f"vec_id div {ordered.SEQ}").alias("seq_id"),
        (F.col("vec_id") % ordered.SEQ).alias("pos"),
        x.alias("x"),
        vx.sigmoid(x[0]).alias("rho"),
    )


@query("stream_attention", ORACLES["causal_attention"])
def stream_attention(spark, sf_dir):
    rows = sequence_stream(spark, sf_dir)
    kernel = CausalAttention(ordered.DIM, ordered.DIM, ordered.BETA)
    inputs = {"q": "x", "k": "x", "v": "x", "rho": "rho"}
    out = stream_scan(rows, ["seq_id"], "pos", kernel, inputs, max_rows=4096)
    return ordered.channels(drained(spark, accepted(out), "attention"), "out")


@query(
    "state_size",
    f"""SELECT vec_id // {ordered.SEQ} AS seq_id, count(*) AS rows, CAST({2 * ordered.DIM} AS BIGINT) AS recurrent,
        CAST(count(*) * {2 * ordered.DIM + 1} AS BIGINT) AS attention FROM embeddings GROUP BY vec_id // {ordered.SEQ}""",
)
def state_size(spark, sf_dir):
    """What two streams hold per sequence after their last trigger, measured in their checkpoints."""
    found = {}
    for name, kernel in (
        ("recurrent", SlowMemory(ordered.DIM, ordered.EPS)),
        ("attention", CausalAttention(ordered.DIM, ordered.DIM, ordered.BETA)),
    ):
        path = scratch_path(spark, name)
        inputs = {n: "rho" if n == "rho" else "x" for n in kernel.widths}
        out = stream_scan(sequence_stream(spark, sf_dir), ["seq_id"], "pos", kernel, inputs)
        sinks.stream_to_files(out, f"{path}/out", f"{path}/state").awaitTermination()
        held = held_elements(spark, f"{path}/state", ["seq_id"], appended=name == "attention")
        found[name] = held.select("seq_id", "rows", F.col("elements").alias(name))
    return found["recurrent"].join(found["attention"].drop("rows"), "seq_id")


@query(
    "stream_pack",
    f"""WITH parted AS (SELECT *, doc_id * {TRIGGERS} // (SELECT max(doc_id) + 1 FROM documents) AS part FROM documents),
    {corpus.blocks_sql(f'SELECT part, doc_id AS o, {corpus.IDS_SQL} AS ids FROM parted', 'part')}
    SELECT {corpus.SHOW_SQL} FROM blocks""",
)
def stream_pack(spark, sf_dir):
    """Each trigger is packed by itself: the documents arrive in ``TRIGGERS`` deliveries, whatever their number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    path, files = deliveries(spark, docs, "pack", F.expr(f"doc_id * {TRIGGERS} div {last + 1}"), TRIGGERS)
    out = scratch_path(spark, "pack")
    sinks.stream_pack(
        stream_files(spark, path, docs.schema, files_per_trigger=files),
        "doc_id",
        CODEPOINTS.ids(F.col("text"), None),
        corpus.SEQ_LEN,
        corpus.PAD,
        f"{out}/blocks",
        f"{out}/state",
        length=CODEPOINTS.count(F.col("text"), None),
    ).awaitTermination()
    return corpus.show(spark.read.parquet(f"{out}/blocks").drop(sinks.BATCH))


BUDGET_SQL = f"""WITH numbered AS ({corpus.BATCHES_SQL}),
    {corpus.blocks_sql(f'SELECT batch_id, doc_id AS o, {corpus.CUT_IDS_SQL} AS ids FROM numbered', 'batch_id')},
    fed AS (SELECT batch_id % 5 AS trigger, CAST(sum(n_valid - 1) AS BIGINT) AS tokens, count(*) AS examples
        FROM blocks GROUP BY batch_id % 5),
    counted AS (
        SELECT CAST(trigger AS BIGINT) AS trigger, tokens, examples,
            CAST(sum(tokens) OVER (ORDER BY trigger) AS BIGINT) AS cum_tokens FROM fed)"""


def budgeted(spark, sf_dir, targets):
    """Blocks arrive in five files and are counted against each target in turn, always from the same checkpoint."""
    path = scratch_path(spark, "budget")
    dealt = stored(corpus.batches(spark, sf_dir).select("batch_id", "doc_id", "text"), "budget-batches")
    packed = lambda share: corpus.pack(share).select("batch_id", "block", "labels")
    arrived, files = deliveries(spark, dealt, "budget", F.col("batch_id") % 5, 5, packed)
    packed = spark.read.schema(packed(dealt).schema).parquet(arrived)
    total = token_counts(packed, []).first()["supervised_tokens"]
    for share in targets:
        feed = stream_files(spark, arrived, packed.schema, files_per_trigger=files)
        target = int(total * share)
        sinks.run_until_spent(sinks.stream_budget(feed, target, f"{path}/ledger", f"{path}/state"))
    ledger = sinks.read_ledger(spark, f"{path}/ledger")
    return ledger.select("trigger", "tokens", "examples", "cum_tokens")


@query(
    "stream_token_budget",
    f"""{BUDGET_SQL} SELECT * FROM counted
    WHERE cum_tokens - tokens < floor((SELECT sum(tokens) FROM counted) * 0.5)""",
)
def stream_token_budget(spark, sf_dir):
    """The budget is half of what arrives: the trigger that crosses it is counted, the rest is not."""
    return budgeted(spark, sf_dir, [0.5])


@query("stream_resume", f"{BUDGET_SQL} SELECT * FROM counted")
def stream_resume(spark, sf_dir):
    """Stopped by two budgets and resumed with larger ones; no trigger is lost or counted twice."""
    return budgeted(spark, sf_dir, [0.3, 0.7, 2.0])
