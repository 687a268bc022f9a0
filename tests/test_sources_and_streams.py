"""Readers, sinks, and streams that must end where the batch operators do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import kernels
from seqloom.functions.text import CODEPOINTS
from seqloom.operators import attention, blocks, ordered
from seqloom.operators.ledger import token_counts
from seqloom.session import scratch_path
from seqloom.sources.corpus import (
    append_progress,
    register_dataset,
    scan_files,
    scan_named,
    scan_turns,
    stream_files,
    write_blocks,
    write_sized,
)
from seqloom.streaming import sinks
from seqloom.streaming.stateful import accepted, held_elements, rejected, stream_scan

GATES = {"decay": "decay", "erase": "erase", "write": "write"}
SCHEMA = "key string, t long, x array<double>, k array<double>, q array<double>, rho double, decay double, erase double, write double"


def sequence_rows(spark, n=60):
    rng = np.random.default_rng(9)
    data = [
        (key, t, *(rng.normal(size=s).tolist() for s in (3, 2, 2)), *rng.uniform(0.1, 1, size=4).tolist())
        for t in range(n)
        for key in ("a", "b", "c")
        if (t + ord(key)) % 3 or key == "a"
    ]
    return spark.createDataFrame(data, SCHEMA)


KERNELS = {
    "slow": (kernels.SlowMemory(3), {"q": "x", "v": "x"}),
    "fir": (kernels.CausalFir(np.arange(15).reshape(5, 3) / 10, [1, 2, 3]), {"x": "x"}),
    "fast": (kernels.FastMemory(2, 3), {"k": "k", "q": "q", "v": "x", **GATES}),
}


def collected(df, name="out"):
    return {(r["key"], r["t"]): np.array(r[name]) for r in df.collect()}


def write_parts(rows, path, cuts=(0, 20, 41, 1000)):
    """One file per range of t, as three deliveries of a feed."""
    for lo, hi in zip(cuts, cuts[1:]):
        rows.where((F.col("t") >= lo) & (F.col("t") < hi)).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("name", KERNELS)
def test_stream_equals_batch(spark, tmp_path, name):
    rows = sequence_rows(spark)
    write_parts(rows, str(tmp_path / "in"))
    kernel, inputs = KERNELS[name]
    feed = stream_files(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    out = accepted(stream_scan(feed, ["key"], "t", kernel, inputs))
    sinks.stream_to_files(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    streamed = collected(spark.read.parquet(str(tmp_path / "out")))
    batch = collected(ordered.scan(rows, ["key"], "t", kernel, inputs))
    assert streamed.keys() == batch.keys()
    # Carried sums are the same additions in the same order.
    assert all(np.allclose(streamed[k], batch[k], rtol=0, atol=1e-12) for k in batch)


def test_stream_attention_equals_tiles_and_is_bounded(spark, tmp_path):
    rows = sequence_rows(spark, 30).where("key = 'a'")
    write_parts(rows, str(tmp_path / "in"))
    feed = stream_files(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    kernel = kernels.CausalAttention(3, 3, beta=0.3)
    inputs = {"q": "x", "k": "x", "v": "x", "rho": "rho"}
    # The first delivery brings 20 rows, and the second goes on: a bound on new keys only.
    out = accepted(stream_scan(feed, ["key"], "t", kernel, inputs, max_rows=20))
    sinks.stream_to_files(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    x = F.col("x")
    batch = attention.causal_attention(rows, ["key"], "t", x, x, x, F.col("rho"), beta=0.3, tile_rows=8)
    streamed, tiled = collected(spark.read.parquet(str(tmp_path / "out"))), collected(batch, "attended")
    assert streamed.keys() == tiled.keys()
    assert all(np.allclose(streamed[k], tiled[k], atol=1e-12) for k in tiled)
    short = stream_scan(feed, ["key"], "t", kernel, inputs, max_rows=19)
    with pytest.raises(Exception, match="more than 19"):
        sinks.stream_to_files(short, str(tmp_path / "out2"), str(tmp_path / "state2")).awaitTermination()


def test_attention_writes_what_is_new_not_what_it_holds(spark, tmp_path):
    """Six triggers of equal size: the last writes about as much state as the second, and all rows are held."""
    rows = sequence_rows(spark, 600).where("key = 'a'")
    write_parts(rows, str(tmp_path / "in"), range(0, 601, 100))
    feed = stream_files(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    kernel = kernels.CausalAttention(3, 3, beta=0.3)
    out = accepted(stream_scan(feed, ["key"], "t", kernel, {"q": "x", "k": "x", "v": "x", "rho": "rho"}))
    sinks.stream_to_files(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    written = {}
    for f in (tmp_path / "state" / "state").rglob("*.changelog"):
        written[int(f.name.split("_")[0].split(".")[0])] = written.get(int(f.name.split("_")[0].split(".")[0]), 0) + f.stat().st_size
    sizes = [written[v] for v in sorted(written)]
    assert len(sizes) == 6 and sizes[-1] < 1.3 * sizes[1]
    held = held_elements(spark, str(tmp_path / "state"), ["key"], appended=True).collect()
    assert [tuple(r) for r in held] == [("a", 600, 600 * kernel.row_size)]
    x = F.col("x")
    whole = collected(attention.causal_attention(rows, ["key"], "t", x, x, x, F.col("rho"), beta=0.3), "attended")
    streamed = collected(spark.read.parquet(str(tmp_path / "out")))
    assert streamed.keys() == whole.keys() and all(np.allclose(streamed[k], whole[k], atol=1e-12) for k in whole)


def test_restart_goes_on_from_the_checkpoint_and_rejects_late_rows(spark, tmp_path):
    rows = sequence_rows(spark)
    kernel, inputs = KERNELS["fast"]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        feed = stream_files(spark, source, rows.schema, files_per_trigger=1)
        sinks.stream_to_files(stream_scan(feed, ["key"], "t", kernel, inputs), out, state).awaitTermination()

    write_parts(rows, source, (0, 25))
    run()
    write_parts(rows, source, (25, 50, 1000))
    rows.where("key = 'a' and t in (3, 4)").coalesce(1).write.mode("append").parquet(source)
    run()
    results = spark.read.parquet(out)
    streamed = collected(accepted(results))
    batch = collected(ordered.scan(rows, ["key"], "t", kernel, inputs))
    assert all(np.allclose(streamed[k], batch[k], atol=1e-12) for k in batch)
    assert sorted((r["key"], r["t"], r["out"]) for r in rejected(results).collect()) == [("a", 3, None), ("a", 4, None)]


def test_stream_pack_packs_each_trigger_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, "abcdefghij"[: i % 11]) for i in range(30)], "doc_id long, text string")
    for part in range(3):
        docs.where(F.expr(f"doc_id div 10 = {part}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = stream_files(spark, str(tmp_path / "in"), docs.schema, files_per_trigger=1)
    ids = CODEPOINTS.ids(F.col("text"), None)
    sinks.stream_pack(feed, "doc_id", ids, 6, 0, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    grouped = docs.withColumn("g", F.expr("doc_id div 10"))
    expected = blocks.pack_blocks(grouped, ["g"], "doc_id", 6, 0, ids=ids)
    found = spark.read.parquet(str(tmp_path / "out"))
    columns = ["block", "n_valid", "input_ids", "labels"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))
    assert found.select(sinks.BATCH).distinct().count() == 3


def test_budget_counts_the_crossing_batch_and_none_after(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1, 2, -100]) for i in range(40)], "b int, labels array<int>")
    for part in range(4):
        rows.where(F.expr(f"b div 10 = {part}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = stream_files(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    ledger = str(tmp_path / "ledger")
    assert sinks.tokens_spent(spark, ledger) == 0
    query = sinks.stream_budget(feed, 21, ledger, str(tmp_path / "state"))
    sinks.run_until_spent(query)
    entries = sinks.read_ledger(spark, ledger).orderBy(sinks.BATCH).collect()
    assert [(r["tokens"], r["examples"], r["cum_tokens"]) for r in entries] == [(20, 10, 20), (20, 10, 40)]
    # A larger budget goes on with the batch that was refused.
    feed = stream_files(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    sinks.run_until_spent(sinks.stream_budget(feed, 1000, ledger, str(tmp_path / "state")))
    entries = sinks.read_ledger(spark, ledger).orderBy(sinks.BATCH).collect()
    assert [r["cum_tokens"] for r in entries] == [20, 40, 60, 80]


def test_other_errors_of_a_budgeted_stream_are_errors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 2])], "b int, labels array<int>")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    feed = stream_files(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    broken = feed.withColumn("labels", F.raise_error(F.lit("broken rows")).cast("array<int>"))
    with pytest.raises(Exception, match="broken rows"):
        sinks.run_until_spent(sinks.stream_budget(broken, 1, str(tmp_path / "ledger"), str(tmp_path / "state")))


def test_scans_and_catalog(spark, tmp_path):
    a, b = str(tmp_path / "s" / "a.parquet"), str(tmp_path / "s" / "b.parquet")
    spark.range(3).coalesce(1).write.parquet(a)
    spark.range(3, 5).coalesce(1).write.parquet(b)
    assert scan_files(spark, [a, b]).count() == 5
    assert scan_files(spark, {"train": a, "test": [b]}, "test").count() == 2
    with pytest.raises(ValueError):
        scan_files(spark, {"train": a}, "test")
    names = sorted(p.name for p in (tmp_path / "s" / "a.parquet").glob("*.parquet"))
    assert scan_files(spark, str(tmp_path / "s"), name_glob=names[0]).count() == 3
    register_dataset(spark, "corpus", {"train": a, "test": b}, config="small")
    assert scan_named(spark, "corpus", "small").count() == 3 and scan_named(spark, "corpus", "small", "test").count() == 2
    spark.range(7).createOrReplaceTempView("numbers")
    assert scan_named(spark, "numbers").count() == 7
    with pytest.raises(KeyError):
        scan_named(spark, "corpus")


def test_files_of_a_size(spark, tmp_path):
    """A thousand folders, one of them with a third of all rows."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("folder"),
        F.array_repeat(F.col("id"), 20).alias("ids"),
        F.when(F.col("id") % 1000 > 990, None).otherwise(F.lit("x")).alias("kind"),
    )
    target = 400_000
    write_sized(rows, str(tmp_path / "out"), ["folder"], target)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60_000 and back.select("folder").distinct().count() == rows.select("folder").distinct().count()
    sizes = back.groupBy("folder", F.input_file_name().alias("file")).agg(F.sum(F.lit(20 * 8 + 8 + 1)).alias("n")).collect()
    large = [r["n"] for r in sizes if r["folder"] == 0]
    assert len(large) > 5 and all(target / 2 < n < target * 2 for n in large)
    assert len(sizes) - len(large) == len({r["folder"] for r in sizes}) - 1  # one file for each of the others
    tasks = {r["file"].split("part-")[1][:5] for r in sizes}
    assert len(tasks) < 45
    write_sized(rows.limit(0), str(tmp_path / "none"), ["folder"])


def test_turns_get_their_defaults_in_both_layouts(spark, tmp_path):
    nested = spark.createDataFrame([(1, [("assistant", "x"), (None, None)])], "conv_id long, messages array<struct<role:string,content:string>>")
    flat = spark.createDataFrame([(1, 0, "assistant", "x"), (1, 1, None, None)], "conv_id long, turn long, role string, text string")
    nested.write.parquet(str(tmp_path / "nested"))
    flat.write.parquet(str(tmp_path / "flat"))
    expected = [(1, 0, "assistant", "x"), (1, 1, "user", "")]
    for layout in ("nested", "flat"):
        turns = scan_turns(spark, str(tmp_path / layout)).orderBy("turn")
        assert [tuple(r) for r in turns.collect()] == expected


def test_block_and_progress_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, "train", [1]), (1, "test", [2]), (0, "test", [-100])], "rank int, split string, labels array<int>")
    write_blocks(rows, str(tmp_path / "blocks"), by=("split", "rank"))
    back = spark.read.parquet(str(tmp_path / "blocks"))
    assert back.where("split = 'test' and rank = 1").first()["labels"] == [2]
    assert token_counts(back, ["split"]).orderBy("split").collect()[0]["supervised_tokens"] == 1
    ledger = spark.range(1, 11).withColumnRenamed("id", "step")
    append_progress(ledger, str(tmp_path / "log"), 4)
    append_progress(ledger, str(tmp_path / "log"), 0)
    assert sorted(r["step"] for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [4, 8]


def test_scratch_paths_follow_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(base)
