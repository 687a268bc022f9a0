"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact verification.

**Similarity.** The five-word shingles of an item and of a run of as many words of a text (a window) are compared as
multisets weighted by the bytes of their words: contaminated from ``SIMILARITY`` on. Windows may overlap the ends
of a text, so an item cut off there is still met.

**Fingerprints.** Every bit of a window's 64-bit SimHash is the majority of that bit over its words' hashes. It comes from running
sums, for windows of the items' lengths (rounded down to a geometric grid) that begin every eighth of their length.

**Lookup.** Windows within ``RADIUS`` bits of an item agree with it in one of four 16-bit blocks up to ``RADIUS // 4`` bits.
Each item is filed under all such variants of its blocks, so a window's four blocks, looked up as they are, lead to all items within
the radius. What is found there is compared in full.

**Verification.** A candidate goes on if the item's shingles around it weigh enough for any similar window. Then all windows around it
are compared at once: an occurrence of a shingle counts for the windows that begin behind the occurrence ``n``
before it, ``n`` being its count in the item.

A similar window whose fingerprint is farther than the radius is not found; the README has the measured share. The items travel to the
tasks in blocks of checked size, and each Python worker builds the index of a block once; a larger benchmark is several lookups
over the same text in one pass over the documents. Nothing else is moved: no join, no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.rolling import IS_PUNCTUATION, mix, pieces, shingles, stretch, texts_as_bytes, word_spans

WORDS, SIMILARITY = 5, 0.75
RATIO = 1.25
BLOCKS, RADIUS = 4, 17
#: Windows of ``n`` words begin every ``n // STEPS`` words.
STEPS = 8
#: Windows looked up at once.
LOOKUPS = 1 << 15
#: Text of one block of items; a task holds the index of one block per lookup.
BLOCK_BYTES = 4 << 20


def words_of(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and bytes of all words (letters and digits, A-Z lower-cased), and where each text's words begin."""
    sums, starts, ends, first = word_spans(data, separators=IS_PUNCTUATION)
    return mix(stretch(sums, starts, ends)), ends - starts, first


def length_class(n: int) -> int:
    """The longest length of the geometric grid that is no longer than ``n``."""
    at = 1
    while (longer := max(at + 1, int(at * RATIO))) <= n:
        at = longer
    return at


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.intp)


def step(length: int) -> int:
    return max(1, length // STEPS)


def _weights(lengths: np.ndarray) -> np.ndarray:
    return np.clip((lengths + 1) // 3, 1, 3).astype(np.int16)


def fingerprints(hashes: np.ndarray, lengths: np.ndarray, windows: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each window length the SimHashes at every ``step(length)``-th start. Words of length 0 weigh nothing."""
    n = len(hashes)
    weights = np.where(lengths > 0, _weights(lengths), 0).astype(np.int16)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    # Differences of 16-bit sums are right modulo 2**16, and a window's own sum is far smaller.
    sums = np.zeros((n + 1, 64), np.int16)
    np.cumsum(bits * weights[:, None], axis=0, dtype=np.int16, out=sums[1:])
    total = np.concatenate(([0], np.cumsum(weights, dtype=np.int64)))
    for length in windows:
        if length > n:
            continue
        at = np.arange(0, n - length + 1, step(length))
        half = ((total[at + length] - total[at]) // 2).astype(np.int16)
        major = (sums[length :: step(length)][: len(at)] - sums[:: step(length)][: len(at)]) > half[:, None]
        yield length, np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()


class Index:
    """Items by length class, and for each class the variants of the fingerprint blocks of its items."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        hashes, lengths, first = words_of(texts)
        self.ids, self.items = [], []
        by_class: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for i, item in enumerate(ids):
            h, b = hashes[first[i] : first[i + 1]], lengths[first[i] : first[i + 1]]
            if len(h):
                by_class.setdefault(length_class(len(h)), []).append((len(self.ids), h, b))
                self.ids.append(item)
                self.items.append((len(h), *self._weighted(h, b)))
        self.longest = max((i[0] for i in self.items), default=0)
        masks = [sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), r)]
        masks = np.array(masks, np.uint16)
        #: length -> (items, fingerprints, for each block: where a key's entries begin, entries)
        self.classes = {}
        for length, members in by_class.items():
            prints = np.array([next(fingerprints(h, b, [length]))[1][0] for _, h, b in members], np.uint64)
            tables = []
            for block in range(BLOCKS):
                keys = (_block(prints, block).astype(np.uint16)[:, None] ^ masks[None, :]).ravel()
                order = np.argsort(keys, kind="stable")
                starts = np.zeros((1 << 16) + 1, np.int32)
                np.cumsum(np.bincount(keys, minlength=1 << 16), out=starts[1:])
                tables.append((starts, (order // len(masks)).astype(np.int32)))
            self.classes[length] = (np.array([m for m, _, _ in members]), prints, tables)

    @staticmethod
    def _weighted(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The distinct shingles in order, how often each occurs, what each weighs, and the weight of all."""
        s, k = shingles(hashes, WORDS), min(WORDS, len(hashes))
        weight = np.convolve(lengths, np.ones(k, np.int64), "valid")
        known, at, counts = np.unique(s, return_index=True, return_counts=True)
        return known, counts, weight[at], int(weight.sum())

    def candidates(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a window (its number) and an item of this class within ``RADIUS``."""
        members, own, tables = self.classes[length]
        found = []
        # Some windows at a time: what the blocks lead to is many times their number.
        for low in range(0, len(prints), LOOKUPS):
            some = prints[low : low + LOOKUPS]
            for b, (starts, entries) in enumerate(tables):
                block = _block(some, b)
                begin = starts[block]
                n = starts[block + 1] - begin
                at = np.repeat(np.arange(len(some)), n)
                entry = entries[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(len(at))]
                near = np.bitwise_count(some[at] ^ own[entry]) <= RADIUS
                found.append((low + at[near]) * len(own) + entry[near])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // len(own), members[pairs % len(own)]

    def search(self, data: list[bytes]) -> list[dict[int, float]]:
        """For each text the items it contains, with the best similarity of a window."""
        hashes, lengths, first = words_of(data)
        out: list[dict[int, float]] = [{} for _ in data]
        # Texts lie apart, so that windows over their ends hold nothing of their neighbours.
        gap = self.longest + WORDS
        n = np.diff(first)
        begin = gap + np.cumsum(n + gap) - (n + gap)
        size = int((n + gap).sum()) + gap
        h, b = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        at = np.repeat(begin - first[:-1], n) + np.arange(len(hashes))
        h[at], b[at] = hashes, lengths
        before, shingle = {}, {}
        bytes_before = np.concatenate(([0], np.cumsum(b)))
        for width in {min(i[0], WORDS) for i in self.items}:
            shingle[width] = shingles(h, width)
            before[width] = np.concatenate(([0], np.cumsum(bytes_before[width:] - bytes_before[:-width])))
        for length, prints in fingerprints(h, b, sorted(self.classes)):
            starts, items = self.candidates(length, prints)
            starts = starts * step(length)
            for item in np.unique(items).tolist():
                words, known, _, heavy, weight = self.items[item]
                width = min(words, WORDS)
                mine = starts[items == item]
                owner = np.searchsorted(begin - gap // 2, mine + words // 2, side="right") - 1
                mine, owner = mine[owner >= 0], owner[owner >= 0]
                # No window up to one step off can be similar whose shingles, each counted, weigh less than this.
                reach = np.arange(-step(length), words - width + step(length) + 1)
                places = np.clip(mine[:, None] + reach, 0, len(shingle[width]) - 1)
                kind = np.minimum(np.searchsorted(known, shingle[width][places]), len(known) - 1)
                bound = np.where(known[kind] == shingle[width][places], heavy[kind], 0).sum(axis=1)
                mine, owner = mine[bound >= SIMILARITY * weight], owner[bound >= SIMILARITY * weight]
                for text in np.unique(owner).tolist():
                    near = mine[owner == text]
                    low, high = int(begin[text]), int(begin[text] + n[text])
                    if words < WORDS:
                        inside = shingle[width][low : high - width + 1]
                        best = float((inside == known[0]).any())
                    else:
                        best = self._best(item, shingle[width], before[width], low, high, int(near.min()), int(near.max()))
                    if best >= SIMILARITY:
                        out[text][item] = max(best, out[text].get(item, 0.0))
        return out

    def _best(self, item: int, shingle, before, begin: int, end: int, head: int, tail: int) -> float:
        """The best similarity of a window of the text ``[begin, end)`` that begins within the item's length of ``[head, tail]``."""
        words, known, counts, heavy, weight = self.items[item]
        inner, last = words - WORDS, end - WORDS + 1
        start, tail = max(head - words, begin - words // 3), min(tail + words, last - 1)
        low, high = max(start, begin), min(tail + inner + 1, last)
        if low >= high or start > tail:
            return 0.0
        kind = np.minimum(np.searchsorted(known, shingle[low:high]), len(known) - 1)
        at = np.flatnonzero(known[kind] == shingle[low:high])
        at = at[np.argsort(kind[at], kind="stable")]
        kind, at = kind[at], at + low
        earlier = np.arange(len(at)) - counts[kind]
        same = (earlier >= 0) & (kind[earlier] == kind)
        since = np.maximum(np.where(same, at[earlier] + 1, start), np.maximum(at - inner, start))
        until = np.minimum(at, tail) + 1
        some = since < until
        steps = np.zeros(tail - start + 2, np.int64)
        np.add.at(steps, since[some] - start, heavy[kind[some]])
        np.subtract.at(steps, until[some] - start, heavy[kind[some]])
        both = np.cumsum(steps)[:-1]
        window = np.arange(start, tail + 1)
        total = before[np.clip(window + inner + 1, begin, last)] - before[np.clip(window, begin, last)]
        return float((both / (total + weight - both)).max())


class Items:
    """A block of items, from which each Python worker builds its index once: Spark keeps a broadcast between tasks."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, self.texts = ids, texts

    @cached_property
    def index(self) -> Index:
        return Index(self.ids, self.texts)


def similarity(window: list[str], item: list[str]) -> float:
    """The weighted similarity of two word lists, spelled out; what ``Index`` computes from hashes."""

    def multiset(words: list[str]) -> Counter:
        k = min(WORDS, len(words))
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()

    weigh = lambda c: sum(n * sum(len(w.encode()) for w in s) for s, n in c.items())
    a, b = multiset(window), multiset(item)
    return weigh(a & b) / weigh(a | b) if a and b else 0.0


def _item_blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[tuple[list[int], list[bytes]]]:
    """The benchmark in the order of its keys, at most ``BLOCK_BYTES`` of text (or one item) at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).orderBy(key, text)
    for item, t in rows.toLocalIterator():
        data = t.encode()
        if ids and size + len(data) > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(data)
        size += len(data)
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, text: str, benchmark: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """All columns of ``docs`` with ``contaminated, item_ids, similarity``; such columns are replaced.

    ``item_ids`` are the items found, ascending (none: empty), ``similarity`` the best of them (none: 0).
    Null, empty and blank texts contain nothing; so do items without words or with a null key.
    Items of equal text are all reported. Repeated rows are judged alike; an empty table gives an empty
    result, an empty benchmark clean documents.
    """
    context = docs.sparkSession.sparkContext
    found = []
    for ids, texts in _item_blocks(benchmark, item_key, item_text):
        found.append(_lookup(context.broadcast(Items(ids, texts)))(F.col(text)))
    added = ("contaminated", "item_ids", "similarity")
    rest = [c for c in docs.columns if c not in added]
    df = docs.select(F.struct(*rest).alias("doc"), *(f.alias(f"found{i}") for i, f in enumerate(found)))
    none = F.array().cast("array<bigint>")
    ids = F.array_distinct(F.sort_array(F.concat(none, *(F.col(f"found{i}.ids") for i in range(len(found))))))
    best = F.greatest(F.lit(0.0), F.lit(0.0), *(F.col(f"found{i}.best") for i in range(len(found))))
    return df.select("doc.*", (F.size(ids) > 0).alias("contaminated"), ids.alias("item_ids"), best.alias("similarity"))


def _lookup(shared):
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = shared.value.index
        for batch in batches:
            data, rows = texts_as_bytes(batch), []
            for low, high in pieces(data, 1 << 17):
                for hits in index.search(data[low:high]):
                    rows.append((sorted(index.ids[i] for i in hits), max(hits.values(), default=0.0)))
            yield pd.DataFrame(rows, columns=["ids", "best"])

    return F.pandas_udf(look, "ids array<bigint>, best double")
