"""Logits as rows against the same logits as arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import decoding, evaluation, long_logits as ll


def as_rows(spark, logits, labels=None):
    rows = [(i, labels[i] if labels else 0, [float(x) for x in v]) for i, v in enumerate(logits)]
    arrays = spark.createDataFrame(rows, "k int, label int, logits array<double>")
    return arrays, arrays.select("k", "label", F.posexplode("logits").alias("token", "logit")).repartition(5)


@pytest.fixture(scope="module")
def logits():
    rng = np.random.default_rng(12)
    out = [rng.normal(scale=s, size=n) for s in (0.0, 0.01, 1.0, 5.0) for n in (1, 7, 300, 2500)]
    out += [np.round(rng.normal(size=900)), np.where(rng.random(800) < 0.5, 3.0, -3.0)]
    return [*out, np.array([1000.0, -1000.0, 999.0]), np.array([-5000.0, -5001.0])]


@pytest.mark.parametrize("leaf, top_p, temperature", [(512, 0.9, 0.8), (512, 0.0, 1.0), (512, 0.995, 0.7), (3, 0.35, 2.0)])
def test_nuclei(spark, logits, monkeypatch, leaf, top_p, temperature):
    monkeypatch.setattr(ll, "LEAF", leaf)
    _, rows = as_rows(spark, logits)
    got = {}
    for r in ll.nucleus(rows, ["k"], "token", "logit", top_p, temperature).collect():
        got.setdefault(r["k"], {})[r["token"]] = r["p"]
    for k, v in enumerate(logits):
        order, probs = decoding._nucleus(v[None, :].astype(float), top_p, temperature)
        expected = {t: p for t, p in zip(order[0].tolist(), probs[0].tolist()) if p > 0}
        # A sum may pass the threshold by its rounding alone: at most the last token then differs.
        extra = got[k].keys() ^ expected.keys()
        assert len(extra) <= (1 if len(expected) > 100 else 0)
        assert all(abs(got[k][t] - expected[t]) < 1e-6 for t in got[k].keys() & expected.keys())


def test_losses(spark, logits):
    labels = [(-100 if i % 5 == 4 else len(v) - 1) for i, v in enumerate(logits)]
    arrays, rows = as_rows(spark, logits, labels)
    expected = dict(arrays.select("k", evaluation.token_nll(F.col("logits"), F.col("label"))).collect())
    got = dict(ll.token_losses(rows, ["k"], "token", "logit", "label").collect())
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert (v is None and got[k] is None) or got[k] == pytest.approx(v, abs=1e-9)
    whole = ll.cross_entropy(rows, ["k"], [], "token", "logit", "label").first()
    assert whole["targets"] == sum(x != -100 for x in labels)
    nothing = ll.cross_entropy(rows.withColumn("label", F.lit(-100)), ["k"], [], "token", "logit", "label").first()
    assert nothing["targets"] == 0 and np.isnan(nothing["loss"])


def test_sums_are_combined_before_the_shuffle_and_no_key_is_windowed(spark, logits):
    _, rows = as_rows(spark, logits[:4])
    plan = ll.token_losses(rows, ["k"], "token", "logit", "label")._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Window" not in plan
    plan = ll.nucleus(rows, ["k"], "token", "logit")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_impossible_tokens_and_gaps(spark):
    rows = spark.createDataFrame([(0, 0, float("-inf"), 1), (0, 1, 2.0, 1), (1, 0, float("-inf"), -100)], "k int, token int, logit double, label int")
    found = dict(ll.token_losses(rows, ["k"], "token", "logit", "label").collect())
    assert found == {0: 0.0, 1: None}
    assert [tuple(r) for r in ll.nucleus(rows.where("k = 0"), ["k"], "token", "logit").collect()] == [(0, 1, 1.0)]
    with pytest.raises(Exception, match="no logit for label 9"):
        ll.token_losses(rows.withColumn("label", F.lit(9)), ["k"], "token", "logit", "label").collect()
    with pytest.raises(Exception, match="missing"):
        ll.token_losses(rows.withColumn("logit", F.lit(None).cast("double")), ["k"], "token", "logit", "label").collect()
    with pytest.raises(ValueError):
        ll.nucleus(rows, ["k"], "token", "logit", temperature=0)
    assert ll.nucleus(rows.where("k > 5"), ["k"], "token", "logit").count() == 0
