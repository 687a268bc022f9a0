"""Nothing is lost and no size changes a result: cases of nulls, misses and many heavy keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import attention, evaluation, numbering, ordered, vocabulary
from seqloom.operators.lookup import lookup


def test_six_hundred_heavy_keys_are_all_cut(spark):
    rows = spark.range(600 * 20).select((F.col("id") % 600).alias("k"), F.col("id").alias("o"))
    heavy = numbering.heavy_keys(rows, ["k"], "o", 10)
    assert len(heavy.hashes) == 600
    cut = numbering.running(rows, ["k"], "o", sums={"n": F.lit(1)}, rows_per_chunk=10)
    assert cut.where("n <> o div 600 + 1").count() == 0 and cut.count() == 12_000


@pytest.mark.parametrize("rows_per_chunk", [5, 1000])
def test_null_order_values_sort_first_whatever_the_size(spark, rows_per_chunk):
    rows = [("a", None, 100.0)] + [("a", i, 1.0) for i in range(1, 30)] + [("b", 1, 1.0), ("b", None, 5.0)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    out = numbering.running(df, ["k"], "o", sums={"s": F.col("v")}, rows_per_chunk=rows_per_chunk).collect()
    assert {(r["k"], r["o"]): r["s"] for r in out} == {
        **{("a", i): 100.0 + i for i in range(1, 30)}, ("a", None): 100.0, ("b", None): 5.0, ("b", 1): 6.0
    }
    fir = ordered.causal_fir(df, ["k"], "o", F.col("v"), [0.5, 1.0], rows_per_chunk=rows_per_chunk).collect()
    assert {(r["k"], r["o"]): r["fir"] for r in fir}[("a", 1)] == 51.0


@pytest.mark.parametrize("small", [100, 0])
def test_encoding_keeps_every_row(spark, small):
    docs = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, ""), (3, None), (None, "a")], "d int, text string")
    vocab = vocabulary.build_vocab(docs)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    found = vocabulary.encode(docs, vocab, "d", small_vocab=small)
    got = sorted(map(str, ((r["d"], r["input_ids"]) for r in found.collect())))
    a, b, c = ids["a"], ids["b"], ids["c"]
    assert got == sorted(map(str, [(1, [a, b]), (1, [b, c]), (2, []), (3, []), (None, [a])]))
    back = vocabulary.decode(found, vocab, "d", small_vocab=small)
    assert sorted(r["text"] for r in back.collect()) == ["", "", "a", "a b", "b c"]


def test_lookup_loses_no_row(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    dim = spark.createDataFrame([(1, "x")], "id long, name string")
    got = {r["k"]: r["name"] for r in lookup(df, "k", dim, "id", missing="null").collect()}
    assert got == {1: "x", 2: None, None: None}
    with pytest.raises(Exception, match="no row for k"):
        lookup(df, "k", dim, "id").collect()
    assert lookup(df.where("k = 1"), "k", dim, "id").count() == 1


def test_labels_outside_the_logits_are_errors(spark):
    df = spark.createDataFrame([([0.0, 1.0], 5)], "logits array<double>, label int")
    with pytest.raises(Exception, match="no logit for label 5"):
        evaluation.cross_entropy(df, [], "logits", "label").collect()


def test_nulls_after_the_end_are_filled(spark):
    df = spark.createDataFrame([("s", 1, 9), ("s", 2, None), ("s", 3, 3), ("t", 1, None), ("t", 2, 4)], "k string, o long, t int")
    got = {(r["k"], r["o"]): r["filled"] for r in ordered.eos_fill(df, ["k"], "o", "t", F.lit(9)).collect()}
    assert got == {("s", 1): 9, ("s", 2): 9, ("s", 3): 9, ("t", 1): None, ("t", 2): 4}


def test_filters_refuse_null_inputs(spark):
    df = spark.createDataFrame([("s", 1, None)], "k string, o long, x double")
    with pytest.raises(Exception, match="must not be null"):
        ordered.causal_fir(df, ["k"], "o", F.col("x"), [1.0, 2.0]).collect()


def test_attention_over_gaps(spark):
    rows = [("s", p, [float(p), 1.0]) for p in (0, 1, 2, 6, 7, 20)]
    df = spark.createDataFrame(rows, "seq string, pos long, x array<double>")
    x = F.col("x")
    found = attention.causal_attention(df, ["seq"], "pos", x, x, x, tile_rows=2)
    got = {r["pos"]: r["attended"] for r in found.collect()}
    for i, (_, p, q) in enumerate(rows):
        keys = np.array([r[2] for r in rows[: i + 1]])
        w = np.exp(keys @ np.array(q) / 2**0.5 - (keys @ np.array(q)).max() / 2**0.5)
        assert np.allclose(got[p], w @ keys / w.sum())
