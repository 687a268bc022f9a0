"""Numbering, sharding, sampling, budgets and schedules."""

import math

import pytest
from pyspark.sql import functions as F

from seqloom import jobs
from seqloom.operators import ledger, numbering, sharding
from seqloom.operators.ledger import RunOptions


@pytest.fixture(scope="module")
def ids(spark):
    # Far from dense: an outlier and a crowded end must not upset the numbering.
    values = [i * i for i in range(300)] + [10**15]
    return spark.createDataFrame([(v,) for v in values], "id long").repartition(7)


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 10])
def test_dense_index_and_running_total(ids, rows_per_bucket):
    out = numbering.dense_index(ids, "id", "n", rows_per_bucket).orderBy("id").collect()
    assert [r["n"] for r in out] == list(range(301))
    sums = numbering.running_total(ids, "id", {"s": F.col("id")}, rows_per_bucket)
    total = 0
    for r in sums.orderBy("id").collect():
        total += r["id"]
        assert r["s"] == total


def test_heavy_keys_are_found_and_cut_evenly(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 97).alias("k"), F.col("id").alias("o")
    )
    assert not numbering.heavy_keys(rows, ["k"], "o", 2000)
    heavy = numbering.heavy_keys(rows, ["k"], "o", 100)
    assert len(heavy.hashes) == 1
    chunks = numbering.with_chunks(rows, ["k"], "o", heavy).groupBy("k", numbering.CHUNK).count()
    sizes = {(r["k"], r[numbering.CHUNK]): r["count"] for r in chunks.collect()}
    assert all(c is None for k, c in sizes if k != -1)
    assert max(n for (k, _), n in sizes.items() if k == -1) <= 150


def test_running_maximum_with_chunks_and_null_keys(spark):
    rows = spark.range(200).select(
        F.when(F.col("id") % 4 > 0, F.col("id") % 2).alias("k"), F.col("id").alias("o"), ((F.col("id") * 37) % 101).alias("v")
    )
    plain = numbering.running(rows, ["k"], "o", sums={"s": F.col("v")}, maxima={"m": F.col("v")})
    cut = numbering.running(rows, ["k"], "o", sums={"s": F.col("v")}, maxima={"m": F.col("v")}, rows_per_chunk=9)
    assert sorted(map(tuple, plain.select("o", "s", "m").collect())) == sorted(map(tuple, cut.select("o", "s", "m").collect()))


@pytest.mark.parametrize("world", [1, 2, 7])
def test_shards_are_disjoint_and_complete(spark, world):
    rows = spark.range(20)
    shares = [{r["id"] for r in sharding.shard(rows, "id", world, k).collect()} for k in range(world)] if world > 1 else [
        {r["id"] for r in sharding.shard(rows, "id", 1).collect()}
    ]
    assert sum(map(len, shares)) == 20 and set().union(*shares) == set(range(20))
    report = sharding.shard_report(rows, sharding.shard(rows, "id", world), "id").first()
    assert tuple(report) == (20, 20, 0, 0, 0)


def test_shard_report_counts_faults(spark):
    dealt = spark.createDataFrame([(0, 0), (0, 1), (2, 0), (9, 1)], "id long, rank int")
    assert tuple(sharding.shard_report(spark.range(4), dealt, "id").first()) == (4, 4, 1, 2, 1)


@pytest.mark.parametrize("n, world", [(20, 2), (20, 7), (3, 8), (1, 5)])
def test_sampler_gives_equal_ranks_and_every_row(spark, n, world):
    rows = sharding.distributed_sample(spark.range(n), "id", world, seed=42).collect()
    per_rank = math.ceil(n / world)
    assert len(rows) == per_rank * world
    assert {r["id"] for r in rows} == set(range(n))
    assert {k: sum(r["rank"] == k for r in rows) for k in range(world)} == {k: per_rank for k in range(world)}
    assert sorted(r["position"] for r in rows) == list(range(per_rank * world))


def test_epochs_differ_and_repeat(spark):
    def run():
        rows = sharding.permutation(spark.range(50), "id", 1, epochs=2).collect()
        return [[r["id"] for r in sorted(rows, key=lambda r: r["position"]) if r["epoch"] == e] for e in (0, 1)]

    first, second = run(), run()
    assert first == second and first[0] != first[1]
    assert sorted(first[0]) == sorted(first[1]) == list(range(50))


def scalar(spark, column):
    return spark.range(1).select(column).first()[0]


def test_golden_step_estimates(spark):
    for world, steps in ((1, 152_588), (2, 76_294)):
        options = RunOptions(micro_batch=8, grad_accum=16, world=world, seq_len=512, target_tokens=10**10)
        assert scalar(spark, ledger.estimate_steps(options)) == steps
    assert scalar(spark, ledger.estimate_steps(RunOptions(micro_batch=4, epochs=2.5), 10)) == 7
    assert scalar(spark, ledger.estimate_steps(RunOptions(max_steps=9))) == 9
    with pytest.raises(ValueError):
        ledger.estimate_steps(RunOptions(epochs=1.0))
    with pytest.raises(ValueError):
        ledger.estimate_steps(RunOptions())


def test_golden_stop_conditions(spark):
    entries = spark.createDataFrame(
        [(1, 99, 19, 99, 19), (2, 1, 1, 100, 20), (3, 50, 5, 150, 25)],
        "step int, tokens long, examples long, cum_tokens long, cum_examples long",
    )

    def kept(options, n=None):
        return [r["step"] for r in ledger.budget_cut(entries, options, n).orderBy("step").collect()]

    # 99 tokens do not stop a run with a budget of 100; 100 do.
    assert kept(RunOptions(target_tokens=100)) == [1, 2]
    # 19 examples do not end two epochs of ten rows; 20 do.
    assert kept(RunOptions(epochs=2), 10) == [1, 2]
    assert kept(RunOptions(max_steps=1)) == [1]
    assert kept(RunOptions(target_tokens=99, epochs=2), 10) == [1]
    assert kept(RunOptions()) == [1, 2, 3]
    with pytest.raises(ValueError):
        kept(RunOptions(epochs=1.0))


def test_learning_rate_shape(spark):
    options = RunOptions(warmup_steps=4, lr=2.0, min_lr=0.5)
    rates = [r[0] for r in spark.range(12).select(ledger.learning_rate(F.col("id"), F.lit(10), options)).orderBy("id").collect()]
    assert rates[0] == pytest.approx(2e-8) and rates[2] == pytest.approx(1.0)
    assert rates[4] == pytest.approx(2.0) and rates[7] == pytest.approx(1.25)
    assert rates[10] == pytest.approx(0.5) and rates[11] == pytest.approx(0.5)
    assert scalar(spark, ledger.learning_rate(F.lit(0), F.lit(5), RunOptions(lr=3.0))) == pytest.approx(3.0)


def test_every_n(spark):
    hits = [r[0] for r in spark.range(8).select(sharding.every_n(F.col("id"), 4)).collect()]
    assert hits == [False, False, False, True] * 2
    assert not any(r[0] for r in spark.range(8).select(sharding.every_n(F.col("id"), 0)).collect())


def test_size_inventory(spark):
    parameters = spark.createDataFrame(
        [("embed.weight", 0, [10, 4]), ("proj.weight", 1, [4, 4]), ("proj.bias", 1, [4])],
        "name string, layer int, shape array<int>",
    )
    rows = {r["layer"]: (r["size"], r["decayed"], r["not_decayed"]) for r in ledger.size_inventory(parameters).collect()}
    assert rows == {0: (40, 0, 40), 1: (20, 16, 4)}


def test_a_run_that_stops_and_goes_on(spark, tmp_path):
    rows = spark.range(60).select((F.expr("id div 3") + 1).alias("step"), F.array(F.lit(5), F.lit(-100), F.col("id").cast("int")).alias("labels"))
    path = str(tmp_path / "run")
    assert jobs.progress(spark, path) == jobs.Progress() and jobs.written(spark, path) is None
    assert jobs.advance(rows, path, 4) == jobs.Progress(4, 24, 12)
    # A lost attempt at the next steps leaves rows that do not count and are replaced.
    rows.where("step between 5 and 9").write.parquet(f"{path}/blocks/first_step=5")
    assert jobs.progress(spark, path).step == 4 and jobs.written(spark, path).count() == 12
    assert jobs.advance(rows, path, 4) == jobs.Progress(4, 24, 12)
    assert jobs.advance(rows, path, 6) == jobs.Progress(6, 36, 18)
    assert jobs.advance(rows, path, 20) == jobs.Progress(20, 120, 60)
    assert jobs.written(spark, path).exceptAll(rows).isEmpty() and jobs.written(spark, path).count() == 60
    assert jobs.advance(rows, path, 30) == jobs.Progress(30, 120, 60)
