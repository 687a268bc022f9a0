"""Steps whose cost must not grow with a whole table, a full Arrow batch or the number of inputs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.functions import kernels
from seqloom.operators import vocabulary as vb
from seqloom.plans import streams
from seqloom.sources.corpus import stream_files
from seqloom.streaming.stateful import stream_scan


def test_deliveries_are_as_many_files_as_their_bytes_need(spark, monkeypatch):
    monkeypatch.setattr(streams, "BYTES_PER_FILE", 1000, raising=False)
    rows = spark.range(300).select("id", F.lit("x" * 20).alias("text"))
    path, files = streams.deliveries(spark, rows, "sized", F.when(F.col("id") < 1, 0).otherwise(2), 3)
    # Part 2 has 299 rows of 28 bytes; part 0 has one row and part 1 none, and all have as many files.
    assert files == 9
    found = spark.read.parquet(path)
    assert len(found.inputFiles()) == 3 * files and found.count() == 300
    feed = stream_files(spark, path, rows.schema, files_per_trigger=files)
    seen = []
    feed.writeStream.foreachBatch(lambda batch, i: seen.append(batch.count())).option(
        "checkpointLocation", f"{path}-state"
    ).trigger(availableNow=True).start().awaitTermination()
    assert seen == [1, 0, 299]


def test_deliveries_make_their_rows_where_they_are_dealt(spark):
    rows = spark.range(40).select((F.col("id") % 10).alias("k"), "id")
    made = lambda share: share.groupBy("k").count()
    path, files = streams.deliveries(spark, rows, "made", F.col("k") % 2, 2, made)
    assert files == 1 and {(r["k"], r["count"]) for r in spark.read.parquet(path).collect()} == {(k, 4) for k in range(10)}
    plan = made(rows.repartition(3, "k"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_inputs_of_a_stream_reach_python_as_one_column(spark, tmp_path):
    schema = "key string, t long, k array<double>, v array<double>, g double"
    feed = stream_files(spark, str(tmp_path), spark.createDataFrame([], schema).schema)
    inputs = {"k": "k", "q": "k", "v": "v", "decay": "g", "erase": "g", "write": "g"}
    out = stream_scan(feed, ["key"], "t", kernels.FastMemory(2, 3), inputs)
    child = out._jdf.queryExecution().analyzed().children().apply(0)
    names = [child.output().apply(i).name() for i in range(child.output().size())]
    assert sorted(set(names)) == ["key", "packed_inputs", "t"]


def test_few_rows_are_worked_on_in_short_blocks(monkeypatch):
    kernel, rng, sizes = kernels.FastMemory(2, 3), np.random.default_rng(2), []
    inputs = [rng.normal(size=(64, s)) for s in (2, 2, 3)] + [rng.uniform(0.1, 1, 64) for _ in range(3)]
    state = rng.normal(size=6)
    expected = kernel._one_by_one(state, *inputs)
    blocks = kernel._in_blocks
    monkeypatch.setattr(kernel, "_in_blocks", lambda at, *x: sizes.append(at.shape) or blocks(at, *x))
    found = kernel.advance(state, *inputs)
    assert sizes == [(8, 8)]
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(found, expected))


def test_distinct_words_are_found_chunk_by_chunk():
    lists = pa.array([["a", "b", "a"], None, ["b", None], [], ["c", "a"]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 2, 3], pa.int64()), lists], names=["_chunk", "w"])
    found = list(vb._distinct_elements([batch, batch.slice(0, 0)]))
    assert all(len(set(b.column(0).to_pylist())) <= 1 for b in found)
    pairs = [(c, w) for b in found for c, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sorted(pairs) == [(1, "a"), (1, "b"), (3, "a"), (3, "c")]
