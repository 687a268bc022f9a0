"""Vector expressions, decoding steps and scores against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.functions import vectors as vx
from seqloom.functions.text import CODEPOINTS, tokenizer, word_count, words
from seqloom.operators import decoding, evaluation, layers, vocabulary


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=6).tolist(), rng.normal(size=6).tolist()) for i in range(40)] + [(40, [0.0] * 6, [0.0] * 6)]
    return spark.createDataFrame(data, "i int, x array<double>, y array<double>").repartition(4)


def column(table, expr):
    rows = table.select("i", "x", "y", expr.alias("out")).orderBy("i").toPandas()
    return np.stack(rows.x), np.stack(rows.y), rows.out


def test_norms_softmax_and_rotation(table):
    x, _, out = column(table, vx.rms_norm(F.col("x"), vx.literal([1, 2, 3, 4, 5, 6]), 1e-6))
    assert np.allclose(np.stack(out), x / np.sqrt((x**2).mean(1, keepdims=True) + 1e-6) * np.arange(1, 7))
    x, _, out = column(table, vx.l2_normalize(F.col("x")))
    assert np.allclose(np.stack(out), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
    x, _, out = column(table, vx.softmax(F.col("x")))
    assert np.allclose(np.stack(out).sum(1), 1.0, atol=1e-12)
    x, _, out = column(table, vx.rotary(F.col("x"), F.col("i"), 6, 100.0))
    turned = np.stack(out)
    # A rotation keeps lengths, leaves position 0 alone and turns the first pair by the position.
    assert np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(turned[0], x[0])
    assert np.allclose(turned[3][0], x[3][0] * math.cos(3) - x[3][1] * math.sin(3))
    with pytest.raises(ValueError):
        vx.rotary(F.col("x"), F.col("i"), 5)
    with pytest.raises(ValueError):
        vx.bounded_gate(F.col("i"), 0.9, 0.5)


def test_resonance_gates_form_a_simplex(table):
    rng = np.random.default_rng(3)
    u, v, g = rng.normal(size=(3, 6, 4)), rng.normal(size=(3, 6, 4)), rng.normal(size=(3, 6))
    x, y, out = column(table, vx.resonance(F.col("x"), F.col("y"), u.tolist(), v.tolist(), g.tolist()))
    gates = np.stack([r["gates"] for r in out])
    assert gates.shape == (41, 3) and np.allclose(gates.sum(1), 1.0, atol=1e-12)
    delta = sum(gates[:, o : o + 1] * (x @ v[o] @ u[o].T) for o in range(3)) / 2.0
    assert np.allclose(np.stack([r["delta"] for r in out]), delta)
    assert np.allclose(np.stack([r["out"] for r in out]), x + delta)


def test_linear_and_fusion(table):
    w = np.arange(12).reshape(2, 6)
    x, _, out = column(table, vx.linear(F.col("x"), w.tolist(), [1, 2]))
    assert np.allclose(np.stack(out), x @ w.T + [1, 2])
    x, y, out = column(table, vx.fuse_scales(F.col("x"), F.col("y"), F.reverse("x"), F.slice("y", 1, 3), F.col("y")))
    mix = np.exp(y[:, :3]) / np.exp(y[:, :3]).sum(1, keepdims=True)
    fused = mix[:, :1] * x + mix[:, 1:2] * y + mix[:, 2:] * x[:, ::-1]
    assert np.allclose(np.stack(out), fused / (1 + np.exp(-y)))


def nucleus_by_loop(logits, top_p, temperature):
    p = np.exp(np.array(logits) / temperature)
    p /= p.sum()
    kept, c = [], 0.0
    for t in sorted(range(len(p)), key=lambda t: (-p[t], t)):
        if c > top_p:
            break
        kept.append(t)
        c += p[t]
    return kept, p[kept] / p[kept].sum()


@pytest.mark.parametrize("top_p", [0.0, 0.5, 0.95, 1.0])
def test_nucleus(table, top_p):
    x, _, out = column(table, decoding.nucleus(F.col("x"), top_p, 0.8))
    for logits, got in zip(x, out):
        tokens, probs = nucleus_by_loop(logits, top_p, 0.8)
        assert [r["token"] for r in got] == tokens
        assert np.allclose([r["p"] for r in got], probs)
    with pytest.raises(ValueError):
        decoding.nucleus(F.col("x"), 0.9, 0.0)


def test_sampling_follows_the_distribution(spark):
    logits = [0.0, math.log(2.0), math.log(5.0)]
    rows = spark.range(1000).select(F.array(*map(F.lit, logits)).alias("l"), (F.col("id") / 1000).alias("u"))
    drawn = rows.select(decoding.nucleus_sample(F.col("l"), F.col("u"), 1.0, 1.0).alias("t")).groupBy("t").count()
    assert {r["t"]: r["count"] for r in drawn.collect()} == {2: 625, 1: 250, 0: 125}


def test_greedy_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([([1.0, 3.0, 3.0],)], "l array<double>")
    assert rows.select(decoding.greedy(F.col("l"))).first()[0] == 1


def test_compact_and_strip(spark):
    rows = spark.createDataFrame([(0, [11, 12, 13, 14], [1, 1, 1, 1]), (1, [21, 22, 0, 0], [1, 1, 0, 0])], "i int, ids array<int>, mask array<int>")
    out = rows.select(decoding.compact(F.col("ids"), F.col("mask")).alias("c"), decoding.strip_prompt(F.col("ids"), F.col("mask")).alias("s"))
    assert [(r["c"], r["s"]) for r in out.collect()] == [([11, 12, 13, 14], []), ([21, 22], [0, 0])]
    with pytest.raises(Exception, match="unmasked"):
        rows.select(decoding.compact(F.col("ids"), F.transform("mask", lambda m: m * 0))).collect()


def test_cross_entropy_masks_and_gives_nan_without_targets(spark):
    rows = spark.createDataFrame(
        [(0, [1.0, 2.0], 1), (0, [5.0, 1.0], -100), (1, [1.0, 1.0], -100)], "g int, l array<double>, y int"
    )
    out = {r["g"]: r for r in evaluation.cross_entropy(rows, ["g"], "l", "y").collect()}
    assert out[0]["loss"] == pytest.approx(math.log(1 + math.exp(-1))) and out[0]["targets"] == 1
    assert out[0]["perplexity"] == pytest.approx(1 + math.exp(-1))
    assert math.isnan(out[1]["loss"]) and out[1]["targets"] == 0


def test_recall_prompts_score_and_lookup(spark):
    prompts = evaluation.recall_prompts(spark.range(50), "id", pairs=5, distractors=3, seed=1)
    rows = prompts.withColumn("found", evaluation.lookup_values(F.col("prompt"))).collect()
    assert rows == prompts.withColumn("found", evaluation.lookup_values(F.col("prompt"))).collect()
    for r in rows:
        assert r["prompt"].count(";") == 5 and r["prompt"].count(" filler") == 3
        assert r["prompt"].endswith("=") and r["answer"] in r["found"]
    assert len({r["prompt"] for r in rows}) == 50
    said = spark.createDataFrame([("so V12.", "V12"), ("V1", "V12"), ("", "V3")], "p string, a string")
    assert evaluation.recall_score(said, "p", "a").first()["score"] == pytest.approx(1 / 3)


def test_parity_counts_missing_rows(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 5.0)], "k int, v double")
    b = spark.createDataFrame([(2, 2.5), (3, 5.0), (4, 0.0)], "k int, v double")
    assert tuple(evaluation.parity(a, b, ["k"], "v").first()) == (2, 1, 1, 0.5, 0.25)


def test_parity_joins_only_ranges_that_differ(spark):
    a = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 0.5).alias("v"))
    same = evaluation.parity_by_ranges(a, a.orderBy(F.desc("k")), ["k"], "v", 64).first()
    assert tuple(same) == (5000, 0, 0, 0.0, 0.0, 0)
    b = a.where("k <> 17").withColumn("v", F.when(F.col("k") == 99, F.col("v") + 3).otherwise(F.col("v")))
    b = b.union(spark.createDataFrame([(-1, 0.0)], b.schema))
    got = evaluation.parity_by_ranges(a, b, ["k"], "v", 64).first()
    assert tuple(got)[:4] == (4999, 1, 1, 3.0) and got["mean_abs_diff"] == pytest.approx(3 / 4999) and got["ranges_compared"] <= 3
    # Nulls: a key matches nothing, a value has no difference.
    left = spark.createDataFrame([(None, 1.0), (1, None), (2, 2.0)], "k long, v double")
    plain = tuple(evaluation.parity(left, left, ["k"], "v").first())
    assert tuple(evaluation.parity_by_ranges(left, left, ["k"], "v").first())[:3] == plain[:3] == (2, 1, 1)
    empty = a.limit(0)
    assert tuple(evaluation.parity_by_ranges(empty, empty, ["k"], "v").first()) == (0, 0, 0, None, None, 0)


def test_importance_reaches_the_next_attention_layer_only(spark):
    rows = spark.createDataFrame([(0, i, float(i)) for i in range(10)], "s int, layer int, rho double")
    out = layers.importance_mean(rows, ["s"], "layer", F.col("rho"), 4).orderBy("attention_layer").collect()
    assert [(r["attention_layer"], r["importance"], r["layers"]) for r in out] == [(3, 1.0, 3), (7, 5.0, 3)]
    assert layers.importance_mean(rows, ["s"], "layer", F.col("rho"), 1).count() == 0


def test_codepoints_and_words(spark):
    texts = ["", "a", "añ€𝄞 \n b", " x\ty "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    out = rows.select(CODEPOINTS.ids(t, None), CODEPOINTS.ids(t, 2), CODEPOINTS.count(t, 2), words(t), word_count(t)).collect()
    for text, r in zip(texts, out):
        assert r[0] == [ord(c) for c in text] and r[1] == r[0][:2] and r[2] == len(r[1])
        assert r[3] == text.split() and r[4] == len(text.split())
    with pytest.raises(ValueError):
        tokenizer("nothing")


def test_vocabulary_round_trip(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, "c  a"), (3, " ")], "d int, text string")
    vocab = vocabulary.extend_vocab(vocabulary.build_vocab(docs), ["<x>", "<y>"])
    entries = {r["token"]: (r["id"], r["is_special"]) for r in vocab.collect()}
    assert sorted(i for i, _ in entries.values()) == [0, 1, 2, 3, 4]
    assert entries["<x>"] == (3, True) and entries["<y>"] == (4, True)
    other = spark.createDataFrame([(1, "b new <x>")], "d int, text string")
    # Looked up inside the rows, then by joins.
    for small in (100, 0):
        ids = vocabulary.encode(docs, vocab, "d", small_vocab=small)
        back = {r["d"]: r["text"] for r in vocabulary.decode(ids, vocab, "d", small_vocab=small).collect()}
        assert back == {1: "b a b", 2: "c a", 3: ""}
        known = vocabulary.encode(other, vocab, "d", unknown=99, small_vocab=small)
        assert known.first()["input_ids"] == [entries["b"][0], 99, 3]
        assert vocabulary.encode(other, vocab, "d", small_vocab=small).first()["input_ids"] == [entries["b"][0], None, 3]
        assert vocabulary.decode(known, vocab, "d", small_vocab=small).first()["text"] == "b"
        whole = vocabulary.decode(known, vocab, "d", skip_special=False, small_vocab=small)
        assert whole.first()["text"] == "b <x>"
    assert [vocabulary.pad_id(*a) for a in ((5, 6), (None, 6), (None, None))] == [5, 6, 0]
