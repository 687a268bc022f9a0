"""Whole runs against a loop that draws batches one after the other."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions.text import CODEPOINTS
from seqloom.jobs import JobOptions, pretrain, supervise
from seqloom.operators.ledger import RunOptions

PAD = 0


def blocks_of(texts, seq_len, pack):
    """Blocks of one micro-batch as (targets, block inputs)."""
    size, out = seq_len + 1, []
    ids = [[ord(c) for c in t][: 4 * seq_len] for t in texts]
    if pack:
        stream = [i for d in ids if d for i in [*d, PAD]]
        chunks = [stream[a : a + size] for a in range(0, len(stream), size)]
    else:
        chunks = [d[:size] for d in ids]
    for c in chunks:
        if len(c) >= 2:
            out.append((len(c) - 1, (c + [PAD] * size)[:seq_len]))
    return out or [(0, [PAD] * seq_len)]


def loop(texts, seq_len, pack, run):
    """Each rank reads its share in order, again and again; all ranks step together."""
    shares = [texts[r :: run.world] for r in range(run.world)]
    batches = [
        [blocks_of(s[a : a + run.micro_batch], seq_len, pack) for a in range(0, len(s), run.micro_batch)]
        for s in shares
    ]
    step = tokens = examples = 0
    log, seen = [], []

    def stop():
        if run.target_tokens is not None and tokens >= run.target_tokens:
            return True
        if run.epochs is not None and examples >= math.ceil(run.epochs * len(texts)):
            return True
        return run.max_steps is not None and step >= run.max_steps

    while not stop():
        t = x = 0
        for r in range(run.world):
            for a in range(run.grad_accum):
                drawn = batches[r][(step * run.grad_accum + a) % len(batches[r])]
                t, x = t + sum(n for n, _ in drawn), x + len(drawn)
                seen += [(step + 1, r, ids) for _, ids in drawn]
        step, tokens, examples = step + 1, tokens + t, examples + x
        log.append((step, t, x, tokens, examples))
    return log, sorted(seen)


@pytest.mark.parametrize(
    "run, pack",
    [
        (RunOptions(micro_batch=3, grad_accum=2, world=2, target_tokens=900), True),
        (RunOptions(micro_batch=2, grad_accum=3, world=1, epochs=4.0), True),
        (RunOptions(micro_batch=4, grad_accum=1, world=3, max_steps=11), True),
        (RunOptions(micro_batch=3, grad_accum=2, world=2, epochs=2.5, max_steps=100), False),
    ],
)
def test_pretraining_equals_the_loop(spark, run, pack):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdef") for _ in range(rng.choice([0, 0, 1, 4, 40]))) for _ in range(23)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    options = JobOptions(seq_len=6, pad=PAD, run=run, pack=pack)
    placed, entries = pretrain(docs, "doc_id", "text", CODEPOINTS, options)
    log, seen = loop(texts, 6, pack, run)
    columns = ["step", "tokens", "examples", "cum_tokens", "cum_examples"]
    assert [tuple(r) for r in entries.select(columns).orderBy("step").collect()] == log
    assert sorted((r["step"], r["rank"], r["input_ids"]) for r in placed.collect()) == seen
    assert entries.where("lr <= 0").count() == 0


def test_supervised_run_deals_every_row_each_epoch(spark):
    rows = spark.createDataFrame(
        [(i, list(range(i % 5 + 1)), [-100] * (i % 5) + [7]) for i in range(20)], "conv_id long, input_ids array<int>, labels array<int>"
    )
    run = RunOptions(micro_batch=2, grad_accum=1, world=2, epochs=3.0)
    placed, entries = supervise(rows, "conv_id", JobOptions(seq_len=5, pad=0, run=run, shuffle=True))
    assert entries.agg(F.max("cum_examples")).first()[0] == 60
    assert placed.groupBy("epoch", "conv_id").count().where("count <> 1").count() == 0
    lengths = placed.groupBy("epoch", "rank", "batch_id").agg(
        F.min(F.size("input_ids")).alias("a"), F.max(F.size("labels")).alias("b"), F.count("*").alias("n")
    )
    assert lengths.where("a <> b or n > 2").count() == 0
    orders = placed.groupBy("epoch").agg(F.collect_list(F.struct("rank", "batch_id", "conv_id")).alias("o"))
    found = {r["epoch"]: sorted((x["rank"], x["batch_id"] % 5, x["conv_id"]) for x in r["o"]) for r in orders.collect()}
    assert found[0] != found[1] != found[2]


def test_runs_need_a_criterion(spark):
    docs = spark.createDataFrame([(0, "abc")], "doc_id long, text string")
    with pytest.raises(ValueError):
        pretrain(docs, "doc_id", "text", CODEPOINTS, JobOptions(seq_len=4, pad=0, run=RunOptions()))
