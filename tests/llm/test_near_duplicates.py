import glob
import os
import random

import numpy as np
import pytest

from seqloom.llm import near_duplicates as nd
from seqloom.llm.components import components
from seqloom.session import LEAST_TASKS, scratch_path


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    """Component ids by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [k for (k, _), g in zip(rows, group) if g == group[i] and k is not None]
        least = (min(ids) if ids else None) if sets[i] else key
        out.append((key, len(sets[i]), least, key is not None and key == least))
    return out


def edited(rng, text, share):
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = "changed%d" % rng.randrange(10**6)
    return " ".join(words)


@pytest.fixture
def corpus(prose):
    rng = random.Random(1)
    rows, passage = [], prose(40)
    for _ in range(12):
        base = prose(rng.choice([30, 80, 300]))
        rows.append(base)
        rows += [edited(rng, base, rng.choice([0.005, 0.02, 0.04, 0.06])) for _ in range(rng.randint(0, 12))]
    rows += [prose(40) + " " + passage + " " + prose(rng.randint(5, 60)) for _ in range(30)]
    rows += [None, "", " \t\n", "a", "A", "a b c", "a  b\nc", "a b c d", rows[0], rows[0].upper(), rows[0]]
    rows.append(prose(30_000))
    rng.shuffle(rows)
    out = [(i, t) for i, t in enumerate(rows)]
    return [*out, out[0], (None, rows[1]), (None, None), (None, "alone in the whole wide world"), (7, rows[7])]


def test_against_all_pairs(spark, corpus):
    df = spark.createDataFrame([(k, t, 1) for k, t in corpus], "doc_id long, text string, row int")
    got = nd.near_duplicates(df, "doc_id", "text").select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(corpus)))


def test_blocks_of_large_groups(spark, prose, monkeypatch):
    rng = random.Random(2)
    base = prose(100)
    rows = [(i, edited(rng, base, 0.02)) for i in range(90)]
    monkeypatch.setattr(nd, "CHUNK", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(df, "doc_id", "text").select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_keep_one(spark, corpus):
    df = spark.createDataFrame([(k, t, k) for k, t in corpus], "doc_id long, text string, component long")
    kept = nd.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    blank = [r for r in corpus if not shingle_set(r[1])]
    assert sum(not shingle_set(t) for _, t in rows) == len(blank)
    worded = [(k, t) for k, t in rows if shingle_set(t)]
    groups = {(c if c is not None else t) for (k, t), (_, n, c, _) in zip(corpus, brute(corpus)) if n}
    assert len(worded) == len(groups)
    assert not any(c is not None and k != c for (k, _, c, _) in brute(worded))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(empty, "doc_id", "text").count() == 0
    assert nd.keep_one(empty, "doc_id", "text").count() == 0


def test_sketch_agreement_follows_similarity():
    rng = np.random.default_rng(0)
    share = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 700).astype(np.uint64)
        a, b = nd.sketch(x[:600]), nd.sketch(x[100:])
        share.append((a == b).mean())
    assert abs(np.mean(share) - 500 / 700) < 0.02
    for n in (1, 2, 3, 7, 50):
        assert (nd.sketch(rng.integers(0, 2**63, n).astype(np.uint64)) < 2**64 - 1).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 300), (5, 4), (4, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_tables_are_few_files_however_many_partitions_a_shuffle_has(spark, corpus):
    folder = os.path.dirname(scratch_path(spark, "any")).removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    there = set(os.listdir(folder))
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = nd.near_duplicates(df, "doc_id", "text").select("doc_id", "n_shingles", "component_id", "kept").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(corpus)))
    made = [d for d in set(os.listdir(folder)) - there if not d.startswith("sketches-")]
    assert {d.split("-")[0] for d in made} == {"classes", "buckets", "links", "clustered"}
    assert max(len(glob.glob(f"{folder}/{d}/part-*")) for d in made) <= LEAST_TASKS
