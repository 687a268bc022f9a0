"""Packing against golden values and against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import blocks
from seqloom.operators.ledger import packed_counts, token_counts


def brute(docs, seq_len, pad):
    stream = [t for ids in docs if ids for t in [*ids, pad]]
    out, size = [], seq_len + 1
    for at in range(0, len(stream), size):
        c = stream[at : at + size]
        if len(c) >= 2:
            full = c + [pad] * (size - len(c))
            labels = [full[i + 1] if i + 1 < len(c) else -100 for i in range(seq_len)]
            out.append((at // size, len(c), full[:seq_len], labels))
    return out


def rows_of(df, *group):
    found = {}
    for r in df.collect():
        found.setdefault(tuple(r[g] for g in group), []).append(
            (r["block"], r["n_valid"], r["input_ids"], r["labels"])
        )
    return {k: sorted(v) for k, v in found.items()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    return [
        (g, o, [rng.randrange(1, 50) for _ in range(rng.choice([0, 1, 2, 3, 9, 30]))])
        for g, n in ((0, 40), (1, 5), (2, 1), (3, 17))
        for o in range(n)
    ]


@pytest.fixture(scope="module")
def table(spark, corpus):
    return spark.createDataFrame(corpus, "g int, o long, input_ids array<int>").repartition(5)


def expected(corpus, seq_len, pad):
    groups = {}
    for g, _, ids in corpus:
        groups.setdefault((g,), []).append(ids)
    found = {k: brute(v, seq_len, pad) for k, v in groups.items()}
    return {k: v for k, v in found.items() if v}


def test_golden_packing_keeps_boundaries_and_masks_the_tail(spark):
    docs = spark.createDataFrame([(0, 1, [1, 2, 3]), (0, 2, [4, 5, 6])], "g int, o int, input_ids array<int>")
    for packed in (
        blocks.pack_blocks(docs, ["g"], "o", 4, 9),
        blocks.pack_batches(docs, ["g"], "o", 4, 9),
        blocks.pack_global(docs, "o", 4, 9).withColumn("g", F.lit(0)),
    ):
        assert rows_of(packed, "g")[(0,)] == [
            (0, 5, [1, 2, 3, 9], [2, 3, 9, 4]),
            (1, 3, [5, 6, 9, 9], [6, 9, -100, -100]),
        ]


def test_golden_unpacked_block(spark):
    docs = spark.createDataFrame([(1, [1, 2, 3]), (2, [7]), (3, [])], "d int, input_ids array<int>")
    out = blocks.unpacked_blocks(docs, ["d"], 4, 0).collect()
    assert [(r["d"], r["input_ids"], r["labels"]) for r in out] == [(1, [1, 2, 3, 0], [2, 3, -100, -100])]


@pytest.mark.parametrize("seq_len", [1, 4, 7])
@pytest.mark.parametrize("rows_per_chunk", [1_000_000, 3])
def test_groups_of_any_size(table, corpus, seq_len, rows_per_chunk):
    packed = blocks.pack_blocks(table, ["g"], "o", seq_len, 0, rows_per_chunk=rows_per_chunk)
    assert rows_of(packed, "g") == expected(corpus, seq_len, 0)


def test_micro_batches_agree(table, corpus):
    assert rows_of(blocks.pack_batches(table, ["g"], "o", 5, 0), "g") == expected(corpus, 5, 0)


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 4])
def test_global_stream(table, corpus, rows_per_bucket):
    one = table.withColumn("o", F.col("g") * 1000 + F.col("o"))
    packed = blocks.pack_global(one, "o", 6, 0, rows_per_bucket=rows_per_bucket)
    docs = [ids for _, _, ids in sorted(corpus, key=lambda r: r[0] * 1000 + r[1])]
    assert rows_of(packed)[()] == brute(docs, 6, 0)


def test_counts_from_lengths_equal_counts_from_labels(table):
    built = token_counts(blocks.pack_blocks(table, ["g"], "o", 6, 0), ["g"])
    counted = packed_counts(table, ["g"], F.size("input_ids"), 6)
    assert sorted(map(tuple, built.collect())) == sorted(map(tuple, counted.collect()))


def test_group_without_tokens_gets_one_block_of_padding(spark):
    docs = spark.createDataFrame([(0, 1, [5, 6]), (1, 1, [])], "g int, o int, input_ids array<int>")
    packed = blocks.pack_batches(docs, ["g"], "o", 3, 9)
    found = rows_of(blocks.with_empty_groups(packed, docs, ["g"], 3, 9), "g")
    assert found == {(0,): [(0, 3, [5, 6, 9], [6, 9, -100])], (1,): [(0, 1, [9, 9, 9], [-100, -100, -100])]}


def test_bad_length_is_refused(table):
    with pytest.raises(ValueError):
        blocks.pack_global(table, "o", 0, 0)
