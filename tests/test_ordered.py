"""Recurrences: chunked equals whole, batch equals a loop, and nothing looks ahead."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import kernels
from seqloom.operators import attention, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = []
    for key, n in (("a", 120), ("b", 3), ("c", 1), (None, 40)):
        for t in range(n):
            x = rng.normal(size=4)
            data.append((key, t * t, x.tolist(), x[:2].tolist(), x[2:].tolist(), float(rng.uniform(0.9, 1)), *rng.uniform(size=2).tolist()))
    schema = "key string, t long, x array<double>, k array<double>, q array<double>, decay double, erase double, write double"
    return spark.createDataFrame(data, schema).repartition(6)


KERNELS = {
    "slow": (kernels.SlowMemory(4), {"q": "x", "v": "x"}),
    "fir": (kernels.CausalFir(np.arange(20).reshape(5, 4) / 10, [1, 2, 3, 4]), {"x": "x"}),
    "fir1": (kernels.CausalFir([[1.0, 2.0, 3.0, 4.0]], [0, 0, 0, 0]), {"x": "x"}),
    "fast": (kernels.FastMemory(2, 4), {"k": "k", "q": "q", "v": "x", "decay": "decay", "erase": "erase", "write": "write"}),
}


def vectors(df, name="out"):
    return {(r["key"], r["t"]): np.array(r[name]) for r in df.select("key", "t", name).collect()}


def assert_close(a, b, tolerance=1e-9):
    assert a.keys() == b.keys()
    assert max(np.abs(a[k] - b[k]).max() for k in a) < tolerance


def reference(rows, name):
    """The definitions, one row at a time."""
    frame, out = rows.toPandas(), {}
    for key, g in frame.groupby("key", dropna=False):
        num = den = np.zeros(4)
        memory, history = np.zeros((2, 4)), [np.zeros(4)] * 4
        weights = KERNELS["fir"][0].weights
        for r in g.sort_values("t").itertuples():
            x = np.array(r.x)
            if name == "slow":
                phi = np.where(x > 0, x + 1, np.exp(x))
                num, den = num + phi * x, den + phi
                y = num / np.maximum(den, 1e-6)
            elif name == "fir":
                history = [*history, x][-5:]
                y = np.array([1, 2, 3, 4]) + sum(w * h for w, h in zip(weights, history))
            elif name == "fir1":
                y = np.array([1.0, 2.0, 3.0, 4.0]) * x
            else:
                k, q = (np.array(v) / max(np.linalg.norm(v), 1e-12) for v in (r.k, r.q))
                memory = r.decay * memory - r.erase * np.outer(k, k @ memory) + r.write * np.outer(k, x)
                y = q @ memory
            out[(key if isinstance(key, str) else None, r.t)] = y
    return out


@pytest.mark.parametrize("name", KERNELS)
@pytest.mark.parametrize("rows_per_chunk", [1_000_000, 10, 2])
def test_scan_equals_the_definition(rows, name, rows_per_chunk):
    kernel, inputs = KERNELS[name]
    out = ordered.scan(rows, ["key"], "t", kernel, inputs, rows_per_chunk=rows_per_chunk)
    assert_close(vectors(out), reference(rows, name))


def test_scan_across_arrow_batches(spark, rows):
    kernel, inputs = KERNELS["fast"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for limit in (1_000_000, 10):
            out = ordered.scan(rows, ["key"], "t", kernel, inputs, rows_per_chunk=limit)
            assert_close(vectors(out), reference(rows, "fast"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["slow", "fir", "fast"])
def test_scan_does_not_look_ahead(rows, name):
    kernel, inputs = KERNELS[name]
    changed = rows.withColumn("x", F.when(F.col("t") <= 400, F.col("x")).otherwise(F.transform("x", lambda v: v + 9)))
    before = vectors(ordered.scan(rows, ["key"], "t", kernel, inputs).where("t <= 400"))
    after = vectors(ordered.scan(changed, ["key"], "t", kernel, inputs).where("t <= 400"))
    assert before.keys() == after.keys()
    assert all(np.array_equal(before[k], after[k]) for k in before)


@pytest.mark.parametrize("rows_per_chunk", [1_000_000, 2, 11])
@pytest.mark.parametrize("kernel", [1, 2, 5])
def test_scalar_filter(rows, rows_per_chunk, kernel):
    weights = [0.5, -1.0, 2.0, 0.25, 3.0][:kernel]
    out = ordered.causal_fir(rows, ["key"], "t", F.col("x")[0], weights, 0.1, rows_per_chunk=rows_per_chunk)
    found = {(r["key"], r["t"]): r["fir"] for r in out.collect()}
    for key, g in rows.toPandas().groupby("key", dropna=False):
        g = g.sort_values("t")
        x = np.concatenate([np.zeros(kernel - 1), [v[0] for v in g.x]])
        for i, t in enumerate(g.t):
            assert found[(key if isinstance(key, str) else None, t)] == pytest.approx(0.1 + np.dot(weights, x[i : i + kernel]))


def test_denominator_counts_exactly(spark):
    """phi(0) is one, so 300 rows sum to 300 without error."""
    kernel = kernels.SlowMemory(1)
    state, _ = kernel.advance(np.zeros(2), np.zeros((300, 1)), np.ones((300, 1)))
    assert state[1] == 300.0


def test_eos_fill(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate([3, 9, 4, 9, 5])] + [("b", 0, 1)], "k string, o int, tok int")
    for limit in (100, 1):
        out = ordered.eos_fill(rows, ["k"], "o", "tok", F.lit(9), rows_per_chunk=limit).orderBy("k", "o").collect()
        assert [r["filled"] for r in out] == [3, 9, 9, 9, 9, 1]


@pytest.mark.parametrize("tile_rows", [256, 16, 5, 1])
@pytest.mark.parametrize("weighted", [True, False])
def test_attention_equals_the_dense_form(spark, tile_rows, weighted):
    rng = np.random.default_rng(1)
    data = [(s, t, rng.normal(size=3).tolist(), rng.normal(size=2).tolist(), float(rng.uniform())) for s, n in ((0, 33), (1, 1), (2, 16)) for t in range(n)]
    df = spark.createDataFrame(data, "s int, t long, x array<double>, v array<double>, rho double").repartition(3)
    out = attention.causal_attention(
        df, ["s"], "t", F.col("x"), F.reverse("x"), F.col("v"), rho=F.col("rho") if weighted else None, beta=0.7, tile_rows=tile_rows
    )
    found = {(r["s"], r["t"]): np.array(r["attended"]) for r in out.collect()}
    assert len(found) == len(data)
    for s, t, x, _, _ in data:
        past = [r for r in data if r[0] == s and r[1] <= t]
        scores = np.array([np.dot(x, r[2][::-1]) / np.sqrt(3) + (0.7 * np.log(max(r[4], 1e-6)) if weighted else 0) for r in past])
        w = np.exp(scores - scores.max())
        assert np.allclose(found[(s, t)], w @ np.array([r[3] for r in past]) / w.sum(), atol=1e-12)


def test_attention_refuses_overlong_sequences(spark):
    df = spark.range(10).select(F.lit(0).alias("s"), F.col("id").alias("t"), F.array(F.lit(1.0)).alias("x"))
    x = F.col("x")
    assert attention.causal_attention(df, ["s"], "t", x, x, x, max_seq_len=10).count() == 10
    with pytest.raises(Exception, match="longer than 9"):
        attention.causal_attention(df, ["s"], "t", x, x, x, max_seq_len=9).collect()


def test_option_checks():
    with pytest.raises(ValueError):
        kernels.CausalFir([], [])
    with pytest.raises(ValueError):
        kernels.FastMemory(0, 4)


def test_fast_memory_in_step_equals_one_by_one():
    rng = np.random.default_rng(8)
    kernel = kernels.FastMemory(3, 4)
    lengths = [0, 5, 1, 7, 7, 2, 0, 6, 4, 3]
    n = sum(lengths)
    inputs = [rng.normal(size=(n, w)) for w in (3, 3, 4)] + [rng.uniform(size=n) for _ in range(3)]
    ends = np.cumsum(lengths)
    bounds = list(zip(ends - lengths, ends))
    start = rng.normal(size=(len(lengths), kernel.state_size))
    found = []
    for way in (kernel.advance_segments, lambda *a: kernels.advance_segments(kernel, *a)):
        states, out = start.copy(), np.empty((n, 4))
        way(states, bounds, inputs, out)
        found.append((states, out))
    assert np.allclose(found[0][0], found[1][0], atol=1e-12)
    assert np.allclose(found[0][1], found[1][1], atol=1e-12)


@pytest.mark.parametrize("rank, dim", [(1, 1), (3, 4), (16, 8)])
def test_fast_memory_in_blocks_equals_the_definition(rank, dim):
    rng = np.random.default_rng(9)
    kernel = kernels.FastMemory(rank, dim)
    lengths = [1000, 0, 31, 32, 33, 1, 0, 257]
    n = sum(lengths)
    inputs = [rng.normal(size=(n, w)) for w in (rank, rank, dim)] + [rng.uniform(size=n) for _ in range(3)]
    inputs[0][100:300] = inputs[0][100]  # one key over and over
    inputs[3][::50] = 0.0  # and memories that are emptied
    ends = np.cumsum(lengths)
    bounds = list(zip(ends - lengths, ends))
    states, out = rng.normal(size=(len(lengths), kernel.state_size)), np.empty((n, dim))
    start = states.copy()
    kernel.advance_segments(states, bounds, inputs, out)
    for i, (low, high) in enumerate(bounds):
        state, rows = kernel._one_by_one(start[i], *[x[low:high] for x in inputs])
        assert np.allclose(states[i], state, atol=1e-9) and np.allclose(out[low:high], rows, atol=1e-9)
        if high > low:
            summary = None
            for a, b in ((low, (low + high) // 2), ((low + high) // 2, high)):
                if a < b:
                    summary = kernel.summarise(summary, *[x[a:b] for x in inputs])
            assert np.allclose(kernel.compose(start[i], summary), state, atol=1e-9)


def test_fast_memory_is_not_reached_by_later_gaps():
    rng = np.random.default_rng(10)
    kernel = kernels.FastMemory(2, 2)
    inputs = [rng.normal(size=(40, 2)) for _ in range(3)] + [rng.uniform(size=40) for _ in range(3)]
    _, before = kernel.advance(np.zeros(4), *inputs)
    inputs[2][30] = np.inf
    _, after = kernel.advance(np.zeros(4), *inputs)
    assert np.allclose(before[:30], after[:30]) and not np.isfinite(after[30:]).all()
