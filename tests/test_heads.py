"""Parameters per head against the functions of one head."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import vectors as vx


def test_each_head_has_its_own_maps(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, i % 3, rng.normal(size=4).tolist()) for i in range(60)], "i int, head int, x array<double>")
    p = {h: {"u": rng.normal(size=(2, 4, 2)), "v": rng.normal(size=(2, 4, 2)), "gate": rng.normal(size=(2, 4))} for h in range(3)}
    x = F.col("x")
    got = dict(rows.select("i", vx.resonance_heads(F.col("head"), x, x, p)["out"]).collect())
    for h in range(3):
        one = rows.where(F.col("head") == h).select("i", vx.resonance(x, x, p[h]["u"], p[h]["v"], p[h]["gate"])["out"])
        assert all(np.allclose(got[i], out, atol=1e-12) for i, out in one.collect())


def test_parameter_tables_are_bounded_and_complete(spark, monkeypatch):
    table = spark.createDataFrame([(0, [[1.0, 2.0]], [0.5]), (1, [[0.0, 1.0]], [0.0])], "head int, weight array<array<double>>, bias array<double>")
    own = vx.head_parameters(table, "head")
    rows = spark.createDataFrame([(0, [1.0, 1.0]), (1, [5.0, 2.0])], "head int, x array<double>")
    assert [r[0] for r in rows.select(vx.linear_heads(F.col("head"), F.col("x"), own)).collect()] == [[3.5], [2.0]]
    assert rows.limit(0).select(vx.linear_heads(F.col("head"), F.col("x"), own)).count() == 0
    with pytest.raises(Exception, match="no parameters for head 7"):
        rows.withColumn("head", F.lit(7)).select(vx.linear_heads(F.col("head"), F.col("x"), own)).collect()
    monkeypatch.setattr(vx, "HEAD_VALUES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        vx.head_parameters(table, "head")
