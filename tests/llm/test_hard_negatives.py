import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row string, length double, block int"


def brute(rows):
    """The contract over plain lists; ``rows`` are ``(id, vector, label)``."""
    ok = [
        (k, [math.floor(256 * float(np.float32(x))) for x in v], y)
        for k, v, y in rows
        if k is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (k, v, y) in enumerate(ok):
        if k % 100:
            continue
        scored = sorted((-dot(v, w), other, j, z) for j, (other, w, z) in enumerate(ok) if j != i)
        for s, positive, _, _ in [r for r in scored if r[3] == y][:5]:
            fit = [r for r in scored if r[3] != y and -30 * s <= -100 * r[0] <= -90 * s][:10]
            out += [(k, positive, n + 1, r[1], -s, -r[0]) for n, r in enumerate(fit)]
    return sorted(out)


def mined(spark, rows):
    floats = lambda v: v if v is None else [x if x is None else float(x) for x in v]
    df = spark.createDataFrame([(k, floats(v), y, "x", 0.0, 1) for k, v, y in rows], SCHEMA)
    got = hn.mine(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.fixture
def rows():
    rng = random.Random(3)
    out = []
    for i in range(700):
        # Few large coordinates and lengths that differ: there is something to prune.
        v = [rng.gauss(0, 0.02) for _ in range(6)]
        for _ in range(2):
            v[rng.randrange(6)] += rng.choice([-1, 1]) * rng.uniform(0.2, 2)
        out.append((i, v, rng.randrange(3)))
    for i in range(700, 900):
        out.append((i, [0.5, 0.5, 0, 0, 0, 0], i % 3))  # ties, a very common vector
    out += [(1000, [0.5, 0.5], 1), (1001, [], 1), (1100, [], 0), (200, out[200][1], out[200][2]), out[300], out[3]]
    out += [(None, [1.0], 1), (1200, None, 1), (1300, [1.0, None], 1), (1400, [math.nan], 1), (1500, [math.inf], 2), (1600, [1.0], None)]
    out += [(1700, [-1.0, 0, 0, 0, 0, 0], 9), (1800, [3.0] * 6, 77)]
    return out


@pytest.mark.parametrize("block_cells", [hn.BLOCK_CELLS, 60])
def test_against_all_pairs(spark, rows, monkeypatch, block_cells):
    monkeypatch.setattr(hn, "BLOCK_CELLS", block_cells)
    monkeypatch.setattr(hn, "LEAST_ROWS", 100)
    expected = brute(rows)
    assert len(expected) > 100
    assert mined(spark, rows) == expected


def test_empty_tables_and_anchors_alone(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 0)]) == []


def test_candidates_lose_nothing_and_leave_most_out():
    rng = np.random.default_rng(7)
    parts = np.floor(256 * rng.normal(size=(2000, 8)) * (rng.random((2000, 8)) < 0.5)).astype(np.int64)
    batch = pa.RecordBatch.from_pydict(
        {"row": np.arange(2000), "vec_id": np.arange(2000), "label": np.zeros(2000, np.int64), "parts": parts.tolist()}
    )
    vectors = hn.Vectors(batch)
    at = np.arange(0, 2000, 50)
    scores = parts[at] @ parts.T
    least = np.sort(scores, axis=1)[:, -20].astype(float)
    assert (least > 0).all()
    seen, looked = [set() for _ in at], 0
    longest_first = np.argsort(-vectors.length)
    for rows in np.split(longest_first, 8):
        for some, found in hn.Bucket(vectors, rows).candidates(vectors, at, least):
            looked += len(some) * len(found)
            for i in some.tolist():
                seen[i // 50] |= set(rows[found].tolist())
    for i in range(len(at)):
        assert set(np.flatnonzero(scores[i] >= least[i]).tolist()) <= seen[i]
    assert looked < 0.5 * scores.size


def test_scores_are_exact_or_an_error(spark):
    big = float(2**22)  # products beyond 2**53
    assert mined(spark, [(100, [big, 1.0], 0), (1, [big, 0.5], 0), (2, [big, -1e5], 1), (3, [big / 2, 1.0], 1)]) == brute(
        [(100, [big, 1.0], 0), (1, [big, 0.5], 0), (2, [big, -1e5], 1), (3, [big / 2, 1.0], 1)]
    )
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(100, [1e30], 0), (1, [1e30], 0)])
