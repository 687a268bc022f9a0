"""Positions without caps: trees of totals, cuts of cuts, permutations by arithmetic."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions.seeded import Feistel
from seqloom.operators import numbering as nb, sharding


@pytest.fixture
def rows(spark):
    rng = random.Random(8)
    ids = rng.sample(range(-(10**6), 10**6), 3000) + [10**12 + i for i in range(500)]
    return spark.createDataFrame([(i, rng.randrange(9)) for i in ids], "o long, v long").repartition(5)


def test_a_tree_of_five_levels(spark, rows, monkeypatch):
    monkeypatch.setattr(nb, "FAN_OUT", 4)
    monkeypatch.setattr(nb, "SAMPLES_PER_BUCKET", 3)
    bucketed, buckets = nb.with_buckets(rows, "o", rows_per_bucket=4)
    assert buckets > 4**4
    sizes = [r["count"] for r in bucketed.groupBy(nb.CHUNK).count().collect()]
    assert len(sizes) > 4**4 and max(sizes) < 40
    got = sorted(map(tuple, nb.dense_index(rows, "o", "i", rows_per_bucket=4).select("o", "i").collect()))
    assert [i for _, i in got] == list(range(3500))
    total, found = 0, nb.running_total(rows, "o", {"s": F.col("v")}, rows_per_bucket=4).orderBy("o").collect()
    for r in found:
        total += r["v"]
        assert r["s"] == total


def test_heavy_keys_are_cut_into_as_many_chunks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(nb, "FAN_OUT", 8)
    rows = spark.range(2000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    heavy = nb.heavy_keys(rows, ["k"], "o", 5)
    assert len(heavy.cuts) > 300
    out = nb.running(rows, ["k"], "o", sums={"n": F.lit(1)}, rows_per_chunk=5)
    assert out.where("n <> o div 2 + 1").count() == 0 and out.count() == 2000


def test_totals_by_key_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(nb, "FAN_OUT", 3)
    rows = spark.range(200).select((F.col("id") % 100).alias("b"), F.expr("id div 100").alias("e"), F.col("id").alias("o"))
    out = nb.running_in_buckets(rows, "b", "o", {"n": F.lit(1)}, keys=["e"], buckets=100)
    assert out.where("n <> b + 1").count() == 0 and out.count() == 200


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 1025, 4097])
def test_feistel_is_a_permutation(spark, n):
    f = Feistel(n)
    keys = F.array(*[F.lit(k).cast("long") for k in f.keys(3, 1)])
    got = [r["p"] for r in spark.range(n).select(f.place(F.col("id"), keys).alias("p")).orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    if n >= 1000:
        # Neither the identity nor a shift, and neighbours do not stay together.
        assert sum(abs(a - b) < 3 for a, b in zip(got, got[1:])) < n // 20
        assert abs(sum(got[: n // 2]) / (n // 2) - n / 2) < 4 * n / math.sqrt(6 * n)


def test_seeded_order_and_sample(spark):
    rows = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    got = sharding.seeded_order(rows, "k", 5, epochs=3)
    for e in range(3):
        assert sorted(r["position"] for r in got.where(F.col("epoch") == e).collect()) == list(range(1000))
    again = sharding.seeded_order(rows.repartition(7), "k", 5, epochs=3)
    assert got.exceptAll(again.select(got.columns)).isEmpty()
    assert got.where("epoch = 0").join(got.where("epoch = 1").select("k", F.col("position").alias("p")), "k").where("position = p").count() < 20
    dealt = sharding.seeded_sample(rows, "k", 7, 5, epochs=2).groupBy("epoch", "rank").count().collect()
    assert {r["count"] for r in dealt} == {143}
    small = sharding.seeded_sample(rows.limit(2), "k", 5, 1).collect()
    assert sorted(r["position"] for r in small) == list(range(5))
    assert sharding.seeded_sample(rows.where("k < 0"), "k", 5, 1).count() == 0


def test_epochs_add_no_exchange(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    exchanges = [sharding.seeded_order(rows, "k", 5, e, 1000)._jdf.queryExecution().executedPlan().toString().count("Exchange") for e in (1, 6)]
    assert exchanges[0] == exchanges[1]
