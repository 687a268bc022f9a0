import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import spelling as sp


def one_apart(a, b):
    """Exactly one edit, spelled out."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def edited(rng, word):
    i, letter = rng.randrange(len(word)), rng.choice("abcéßÿ×z")
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + letter + word[i:], word[:i] + letter + word[i + 1 :]])


@pytest.fixture
def rows():
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(7, 14))) for _ in range(60)]
    stems += ["prefixes" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(40)]
    stems += ["aaaaaaa", "aaaaaaaa", "abababab", "bababab", "x" * 5000, "x" * 4999 + "y", "É" * 8, "é" * 8]
    out = []
    for i in range(400):
        words = []
        for _ in range(60):
            w = stems[min(int(rng.expovariate(0.08)), len(stems) - 1)]
            for _ in range(rng.choice([0] * 12 + [1, 1, 2])):
                w = edited(rng, w)
            words.append(rng.choice([w, w, w.upper(), w.capitalize()]))
        out.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    out += [(1000 + i, "tremendous " * 100 + "tremendouz " * 6) for i in range(9)] + [(1500 + i, "tremandouz") for i in range(4)]
    return [*out, out[0], (None, out[1][1]), (7, None), (8, ""), (9, "short 123 ---"), (10, " ".join(["hapaxes"]))]


@pytest.mark.parametrize("list_cells, cells, queries", [(sp.LIST_CELLS, sp.CELLS, sp.QUERIES), (200, 500, 7)])
def test_against_all_pairs(spark, rows, monkeypatch, list_cells, cells, queries):
    monkeypatch.setattr(sp, "LIST_CELLS", list_cells)
    monkeypatch.setattr(sp, "CELLS", cells)
    monkeypatch.setattr(sp, "QUERIES", queries)
    df = spark.createDataFrame([(k, t, 1, "y") for k, t in rows], "doc_id long, text string, n int, word string")
    got = sorted(map(tuple, sp.variants(df, "doc_id", "text").collect()))
    expected = brute(rows)
    assert sum(r[1] is not None for r in expected) > 20 and any(r[1] != r[2] for r in expected if r[1])
    assert got == expected


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sp.variants(empty, "doc_id", "text").collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")
    assert sp.variants(nothing, "doc_id", "text").collect() == []


def test_scan_of_sorted_lists():
    rng = random.Random(2)
    lists = [sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(40)}) for _ in range(5)]
    words = [w for ws in lists for w in ws]
    number = np.repeat(np.arange(5), [len(ws) for ws in lists])
    codes, size = sp.code_points(pa.array(words))
    got = sorted((int(a), int(b)) for x, y in sp.one_edit(codes, size, number) for a, b in zip(x, y))
    every = range(len(words))
    expected = [(a, b) for a in every for b in every if a < b and number[a] == number[b] and one_apart(words[a], words[b])]
    assert got == expected
