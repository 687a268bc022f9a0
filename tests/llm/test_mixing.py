import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import mixing
from seqloom.llm.queries import cyclic_weights
from seqloom.llm.text import word_count


def _documents(prose):
    rng = random.Random(14)
    rows = [(i, prose(rng.randint(1, 400)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(300)]
    return [*rows, (300, None, "a"), (301, "", "b"), (302, " \n", "e"), (None, prose(30), "c"), rows[0], rows[0], (303, prose(9000), "d")]


def _mixed(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    numbered = mixing.numbered(df, F.col("doc_id").alias("key"), F.col("source"), word_count(F.col("text")).alias("size"))
    draws, sources = mixing.mix(numbered, cyclic_weights, **how)
    return numbered.collect(), draws.collect(), {r["source"]: r for r in sources.collect()}


def test_targets():
    assert mixing.targets({"a": 100, "b": 100}, {"a": 1.0, "b": 1.0}) == {"a": 100.0, "b": 100.0}
    got = mixing.targets({"a": 1000, "b": 10, "c": 0}, {"a": 1.0, "b": 2.0, "c": 3.0})
    assert got == {"a": 980.0, "b": 30.0, "c": 0.0}
    assert mixing.targets({}, {}) == {}
    assert mixing.targets({"a": 0}, {"a": 1.0}) == {"a": 0.0}


@pytest.mark.parametrize("block", [16, 128])
def test_quotas(spark, prose, block):
    docs, draws, sources = _mixed(spark, _documents(prose), block_words=block, shards=5)
    by_row = {r["row"]: r for r in docs}
    assert len(by_row) == len(docs) == len(_documents(prose))
    seen = Counter((d["row"], d["part"], d["pass"]) for d in draws)
    assert max(seen.values()) == 1
    words, per_doc = defaultdict(int), defaultdict(int)
    for d in draws:
        r = by_row[d["row"]]
        assert d["first_word"] == d["part"] * block and 0 < d["n_words"] <= block and d["first_word"] + d["n_words"] <= r["size"]
        words[r["source"]] += d["n_words"]
        per_doc[d["row"]] += d["n_words"]
    for s, r in sources.items():
        assert r["source_size"] == sum(x["size"] for x in docs if x["source"] == s)
        assert abs(words[s] - r["target"]) <= block / 2 + 1
    assert all(n <= 3 * by_row[i]["size"] for i, n in per_doc.items())
    shards = Counter(d["shard"] for d in draws)
    assert set(shards) == set(range(5)) and max(shards.values()) - min(shards.values()) <= 4


def test_reruns_agree(spark, prose):
    rows = [r for r in _documents(prose) if r[0] is not None and r[0] != 0]
    key = lambda docs, draws: sorted((next(r["key"] for r in docs if r["row"] == d["row"]), *d[1:]) for d in draws)
    one = key(*_mixed(spark, rows, block_words=64)[:2])
    random.Random(0).shuffle(rows)
    assert one == key(*_mixed(spark, rows, block_words=64)[:2])


def test_splitting_tree():
    quotas = [1000, 10, 0, 333]
    got = mixing.split_quotas(quotas, 7, seed=3)
    assert got.sum(axis=1).tolist() == quotas and (got >= 0).all()
    assert got.sum(axis=0).max() - got.sum(axis=0).min() <= 3
    assert (got == mixing.split_quotas(quotas, 7, seed=3)).all()
    # The distribution: source 0 holds 1000 of 1343 draws, so a shard gets about that share of it.
    first = np.array([mixing.split_quotas(quotas, 7, seed=s)[0, 0] for s in range(300)])
    n, total = 1343 // 7, 1343
    spread = (n * 1000 / total * 343 / total * (total - n) / (total - 1)) ** 0.5
    assert abs(first.mean() - n * 1000 / total) < 1 and 0.8 < first.std() / spread < 1.2
    assert mixing._hypergeometric(np.random.default_rng(0), 5, 10**10, 10**10 + 5) == 5


def test_whole_documents(spark, prose):
    rows = _documents(prose)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string")
    got = mixing.mixed_documents(df, "doc_id", "source", word_count(F.col("text")), cyclic_weights, seed=1)
    assert got.columns == df.columns
    taken = Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect())
    given = Counter(rows)
    assert all(n <= 3 * given[k] for k, n in taken.items())
    blank = [r for r in rows if not (r[1] or "").split()]
    assert all(taken[r] == given[r] for r in blank)
    _, _, sources = _mixed(spark, rows)
    for s, r in sources.items():
        words = sum(n * len(t.split()) for (_, t, x), n in taken.items() if x == s and t)
        longest = max((len((t or "").split()) for _, t, x in rows if x == s), default=0)
        assert abs(words - r["target"]) <= longest / 2 + 1


def test_empty_and_bound(spark, monkeypatch):
    docs, draws, sources = _mixed(spark, [])
    assert docs == draws == [] and sources == {}
    _, draws, sources = _mixed(spark, [(1, None, "a"), (2, "", None)])
    assert draws == [] and all(r["target"] == 0 for r in sources.values())
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    with pytest.raises(ValueError):
        _mixed(spark, [(1, "x", "a"), (2, "y", "b")])


def test_the_query_deals_its_draws_by_the_tree(spark, sf_dir):
    from seqloom.llm import queries

    rows = queries.op10(spark, sf_dir).collect()
    drawn = [r for r in rows if r["taken"]]
    assert all((r["first_shard"] is None) == (r["taken"] == 0) for r in rows)
    assert all(0 <= r["first_shard"] <= r["last_shard"] < queries.SHARDS for r in drawn)
    assert {r["first_shard"] for r in drawn} == set(range(queries.SHARDS))
