import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import repeats


def brute(rows):
    length, seen = repeats.LENGTH, Counter()
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        seen.update(d[i : i + length] for i in range(len(d) - length + 1))
    out = []
    for (key, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((key, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture
def corpus(prose):
    rng = random.Random(3)
    passages = [prose(60), prose(45), "é" * 150 + prose(40), "ab" * 150]
    rows = [prose(rng.randint(1, 60)) + " " + rng.choice(passages) + " " + prose(rng.randint(1, 60)) for _ in range(40)]
    # Overlapping pieces of one passage, so that a window's partners differ along a run.
    rows += [prose(5) + passages[0][rng.randint(0, 60) : rng.randint(250, 330)] + prose(5) for _ in range(40)]
    rows += [prose(300), rows[0], rows[1], None, "", "x", "y" * 199, "z" * 200, "w" * 201, "v" * 900, "u" * 200, "u" * 200]
    rows += [prose(30) * 3, passages[1] + passages[1], prose(2000)]
    return [(i, t) for i, t in enumerate(rows)]


def test_against_counting_every_window(spark, corpus):
    rows = [*corpus, (None, "n" + corpus[5][1])]
    df = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id long, text string, n_bytes int").repartition(3)
    got = repeats.remove_repeats(df, "text").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_small_pieces_and_bitmaps_change_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    monkeypatch.setattr(repeats, "PIECE", 1000)
    monkeypatch.setattr(repeats, "BITS", 1 << 15)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = repeats.remove_repeats(df, "text", keep_text=True)
    assert sorted(map(tuple, got.drop("kept_text").collect())) == sorted(brute(corpus))
    for r in got.collect():
        assert hashlib.sha256(r["kept_text"]).hexdigest() == r["kept_sha256"]


def test_repeated_rows_and_empty_table(spark, prose):
    text = prose(80)
    df = spark.createDataFrame([(1, text), (1, text), (2, "short"), (2, "short")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(df, "text").collect()}
    assert got == {(1, len(text)), (2, 0)}
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), "text").count() == 0


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_only_texts_with_repeats_are_moved(spark, prose, monkeypatch, bits):
    monkeypatch.setattr(repeats, "BITS", bits)
    told, bitmap = [], repeats._bitmap
    monkeypatch.setattr(repeats, "_bitmap", lambda values: told.append(values) or bitmap(values))
    passage = prose(60)
    rows = [(i, prose(80)) for i in range(30)] + [(90, prose(9) + passage), (91, passage + prose(9)), (92, passage + "!"), (93, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = repeats.remove_repeats(df, "text")
    assert told[-1].count() == 3
    # The texts named last meet the spans of theirs; the others go past the join.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and "Union" in plan
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
