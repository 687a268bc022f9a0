import random
import re

import numpy as np

from seqloom.llm import decontamination as dc


def words_of(text):
    return [w for w in re.sub("[A-Z]+", lambda m: m[0].lower(), re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", text or "")).split() if w]


def brute(text, items):
    """Items that some window of their own number of words resembles, cut off at the ends too."""
    words, out = words_of(text), {}
    for i, item in items:
        w = words_of(item)
        for start in range(-(len(w) // 3), len(words)) if w else ():
            s = dc.similarity(words[max(start, 0) : start + len(w)], w)
            if s >= dc.SIMILARITY:
                out[i] = max(out.get(i, 0), s)
    return out


def test_against_every_window(spark, prose, monkeypatch):
    rng = random.Random(13)
    items = [(i, prose(n)) for i, n in enumerate([3, 5, 9, 14, 20, 33, 47, 60, 60, 25])]
    items += [(20, items[5][1]), (21, items[6][1].upper().replace(" ", ", "))]  # equal in words
    texts = [None, "", " ,.", items[0][1], items[3][1]]
    for _ in range(60):
        item = rng.choice(items)[1].split()
        kind = rng.random()
        if kind < 0.3:
            item[rng.randrange(len(item))] = "edited"
        elif kind < 0.4:
            item.insert(rng.randrange(len(item)), "more")
        elif kind < 0.5:
            item = item[: int(len(item) * 0.85)]
        elif kind < 0.7:
            item = item[: len(item) // 2]
        texts.append(" ".join([*prose(rng.randint(0, 50)).split(), *item, *prose(rng.randint(0, 50)).split()]))
    texts += [" ".join(items[8][1].split()[8:]) + " " + prose(30), prose(30) + " " + " ".join(items[8][1].split()[:-8]), prose(20_000) + " " + items[7][1]]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_ids int")
    rows = [*items, (None, texts[10]), (99, None), (98, "")]
    b = spark.createDataFrame(rows, "item_id long, text string")
    for block in (dc.BLOCK_BYTES, 300):
        monkeypatch.setattr(dc, "BLOCK_BYTES", block)
        got = {r["doc_id"]: r for r in dc.contaminated(d, "text", b, "item_id", "text").collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts[:-1]):
            expected = brute(t, items)
            assert got[i]["item_ids"] == sorted(expected), (i, expected)
            assert got[i]["contaminated"] == bool(expected)
            assert abs(got[i]["similarity"] - max(expected.values(), default=0)) < 1e-9
        assert got[len(texts) - 1]["item_ids"] == [7]


def test_lookup_misses_nothing_within_the_radius():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 400).astype(np.uint64)
    texts = [" ".join(f"w{x}" for x in words[i : i + 10]).encode() for i in range(0, 400, 10)]
    index = dc.Index(list(range(40)), texts)
    (length,) = index.classes
    members, prints, _ = index.classes[length]
    probes = np.concatenate([prints ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, r, replace=False))) for r in range(14)])
    probes = np.concatenate([probes, rng.integers(0, 2**63, 3000).astype(np.uint64)])
    starts, items = index.candidates(length, probes)
    near = np.bitwise_count(probes[:, None] ^ prints[None, :]) <= dc.RADIUS
    assert set(zip(starts.tolist(), items.tolist())) == {(i, int(members[j])) for i, j in np.argwhere(near)}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert dc.contaminated(d.limit(0), "text", b, "item_id", "text").count() == 0
    row = dc.contaminated(d, "text", b.limit(0), "item_id", "text").first()
    assert (row["contaminated"], row["item_ids"], row["similarity"]) == (False, [], 0.0)
    assert dc.contaminated(d, "text", b, "item_id", "text").first()["item_ids"] == [1]
