import math
import random
import re

import pytest

from seqloom.llm import licenses as lc


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows):
    """Every template at every place of every text."""
    texts = [words_of(t) for _, t in rows]
    having = {w: sum(w in set(ws) for ws in texts) for t in lc.TEMPLATES for w in t.words}
    weigh = {w: 1 + round(1000 * math.log((len(rows) + 1) / (n + 1))) for w, n in having.items()}
    out = []
    for (key, _), ws in zip(rows, texts):
        finds = []
        for t in lc.TEMPLATES:
            total = sum(weigh[w] for w in t.words)
            for at in range(-len(t.words), len(ws)):
                same = [0 <= at + p < len(ws) and ws[at + p] == w for p, w in enumerate(t.words)]
                share = sum(weigh[w] for w, s in zip(t.words, same) if s)
                if 100 * share >= t.share * total and all(s for s, k in zip(same, t.key) if k):
                    finds.append((t, at, share / total))
        base = [at for t, at, _ in finds if t.base]
        out.append(
            (
                key,
                len(ws),
                len(base),
                min(base, default=None),
                max(base, default=None),
                ",".join(sorted({t.label for t, _, _ in finds if t.base})),
                ",".join(sorted({t.label for t, _, _ in finds})),
                round(max((s for _, _, s in finds), default=0.0), 6),
            )
        )
    return out


@pytest.fixture
def rows(prose):
    rng = random.Random(6)
    out = []
    for i in range(300):
        parts = [prose(rng.randint(1, 60))]
        for _ in range(rng.choice([0, 1, 1, 3])):
            words = list(rng.choice(lc.TEMPLATES).words)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(["the", "license", "changed", "gnu"])
            words = words[rng.choice([0, 0, 2]) :]
            parts += [rng.choice([" ", ", ", "-", "\n# "]).join(rng.choice([w, w.upper()]) for w in words), prose(rng.randint(0, 9))]
        out.append((i, " ".join(parts)))
    out += [(900, None), (901, ""), (902, " \n-- "), (903, "GNU-General_public+License"), (904, "MIT license MIT license mit"), (905, "cc by")]
    out += [(906, "the license by the gnu " * 20_000), (907, "é gnu general public licenseé"), (907, "cc by cc by"), (None, "apache license")]
    return out + [out[3]]


def test_against_every_place(spark, rows):
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, score int, doc int")
    got = lc.scan(df, "text")
    assert got.columns[:3] == ["doc_id", "text", "doc"]
    got = [
        (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 6)) for r in got.collect()
    ]
    expected = brute(rows)
    assert len({r[6] for r in expected}) > 10 and any(0 < r[7] < 1 for r in expected)
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_empty_table(spark):
    assert lc.scan(spark.createDataFrame([], "doc_id long, text string"), "text").collect() == []


def test_only_words_that_outweigh_the_rest_are_filed():
    weights = {w: 10 * len(w) for w in lc.vocabulary(lc.TEMPLATES)}
    for t in lc.TEMPLATES:
        rare = lc.Index.rarest(t, weights)
        total = sum(weights[w] for w in t.words)
        rest = sum(weights[w] for w in t.words if w not in rare)
        assert 100 * rest < t.share * total
        assert len(rare) == 1 or t.share < 100
    assert any(set(t.words) - lc.Index.rarest(t, weights) for t in lc.TEMPLATES)
