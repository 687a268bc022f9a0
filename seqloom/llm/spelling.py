"""Spelling variants: words one edit apart, by dynamic programming over sorted lists.

**Lists.** A single edit falls into one half of a word, so the other half is the same in both words. Every word is
therefore put into two kinds of lists: words with an equal first half, and words with an equal second half. Of each word
only its *free* part, the other half, has to be compared. Halves are cut by the length of the shorter word of a pair,
so a word is in the lists of its own length and of one less. A list that outgrows ``LIST_CELLS`` characters is cut
again in the same way, at the middle of its free part, until it fits. At a free part of one character no list can
be larger than the square of the alphabet.

**Scan.** A list is sorted, so words with a common prefix are neighbours. The edit matrix of a query against a
word has one row per character of the word, and within one edit only three cells of a row matter (the band). The
row at depth ``d`` depends on the word's first ``d`` characters only: it is kept for the whole range of words that share
them and is continued once per next character, the ranges being known from the common prefixes (LCP) of
adjacent words. A range whose row has no cell of at most one edit is skipped with all its words. The rows of
many queries are continued together as arrays.

The vocabulary never leaves the cluster: tasks hold one list (or many small ones) at a time and report each near pair once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.session import stored

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs this many times as often as the word it stands for.
RATIO = 10
#: Characters in one list; those of one task's arrays; queries whose rows are continued at once.
LIST_CELLS, CELLS, QUERIES = 1 << 20, 1 << 21, 1 << 14
ROWS_PER_TASK = 40_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LIST = ["slot", "low", "high", "head", "tail"]


def runs(text: Column) -> Column:
    """Maximal runs of at least ``LEAST_LENGTH`` letters with A-Z lower-cased; shorter ones can make no word."""
    pattern = f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"
    return F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(pattern), F.lit(0)))


def misspelt(key: Column, run: Column) -> Column:
    """The run without one of its code points where its checksum with the key says so."""
    h = F.crc32(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + F.lit(2)))
    return F.when(h % 31 == 0, cut).otherwise(run)


def words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``word, n``: the distinct words of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences."""
    each = docs.select(F.col(key).alias("key"), runs(F.col(text)).alias("run"))
    each = each.select(misspelt(F.col("key"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _parts(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows with the list they are in: the word outside of ``[low, high)`` (of a word of ``slot`` characters) is fixed."""
    rows = rows.withColumn("low", low.cast("int")).withColumn("high", high.cast("int"))
    after = F.col("slot") - F.col("high")
    inner = F.length("word") - F.col("low") - after
    return rows.select(
        "word",
        "n",
        "slot",
        "low",
        "high",
        F.substr("word", F.lit(1), F.col("low")).alias("head"),
        F.substr("word", F.col("low") + 1, inner).alias("free"),
        F.substr("word", F.col("low") + inner + 1, after).alias("tail"),
    )


def _halved(rows: DataFrame) -> DataFrame:
    """Each row in the lists of the left and of the right half of its free part."""
    middle = F.expr("(low + high) div 2")
    ends = F.explode(F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("high").alias("b"))))
    split = rows.select("word", "n", "slot", ends.alias("at")).select("word", "n", "slot", "at.a", "at.b")
    return _parts(split, F.col("a"), F.col("b"))


def lists(vocabulary: DataFrame) -> DataFrame:
    """Every word in all its lists: ``word, n, slot, low, high, head, free, tail, list``, none larger than ``LIST_CELLS``."""
    length = F.length("word")
    slots = F.explode(F.filter(F.array(length, length - 1), lambda s: s >= LEAST_LENGTH))
    whole = vocabulary.select("word", "n", slots.alias("slot")).withColumn("low", F.lit(0)).withColumn("high", F.col("slot"))
    number = F.xxhash64(*LIST)
    level, done = _halved(whole).withColumn("list", number), None
    while True:
        size = F.sum(F.length("free") + 1)
        crowded = level.where("high - low > 1").groupBy("list").agg(size.alias("size"))
        crowded = stored(crowded.where(F.col("size") > LIST_CELLS).select("list"), "crowded")
        if crowded.isEmpty():
            return level if done is None else done.unionByName(level)
        fit = level.join(crowded, "list", "left_anti")
        done = fit if done is None else done.unionByName(fit)
        level = _halved(level.join(crowded, "list", "left_semi").where("high - low > 1")).withColumn("list", number)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``word, near, near_n``: both directions of every pair of words one edit apart, each once."""
    placed = lists(vocabulary)
    tasks = max(1, math.ceil(4 * vocabulary.count() / ROWS_PER_TASK))
    dealt = placed.repartition(tasks, "list").sortWithinPartitions(*LIST, "free")
    dealt = dealt.select("word", "n", (F.col("high") - F.col("low")).alias("width"), (F.col("high") < F.col("slot")).alias("inner"), *LIST, "free")
    return dealt.mapInArrow(_scan, "word string, near string, near_n long")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole lists, some at a time: rows come sorted, and a list may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    cells = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        cells += (pc.max(pc.utf8_length(batch.column("free"))).as_py() + 1) * batch.num_rows
        if cells >= CELLS:
            table = pa.Table.from_batches(held).combine_chunks()
            first = _list_numbers(table)
            last = int(np.searchsorted(first, first[-1]))
            if last:
                yield from _pairs(table.slice(0, last), first[:last])
            held = table.slice(last).to_batches()
            cells = sum((pc.max(pc.utf8_length(b.column("free"))).as_py() + 1) * b.num_rows for b in held)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from _pairs(table, _list_numbers(table))


def _list_numbers(table: pa.Table) -> np.ndarray:
    """The number of the list of each row, in order."""
    other = np.zeros(max(table.num_rows - 1, 0), np.bool_)
    for name in LIST:
        column = table.column(name)
        other |= pc.not_equal(column.slice(1), column.slice(0, max(table.num_rows - 1, 0))).to_numpy()
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(other)])


def code_points(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row per text, filled up with zeros (with one more column before and two behind), and the lengths."""
    size = pc.utf8_length(texts).to_numpy().astype(np.int64)
    flat = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    width = int(size.max(initial=0))
    out = np.zeros((len(size), width + 3), np.uint32)
    out[:, 1 : width + 1][np.arange(width) < size[:, None]] = flat
    return out, size


def _pairs(table: pa.Table, lists_: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The near pairs of some lists. Pairs that another list reports as well are left to it."""
    codes, size = code_points(table.column("free"))
    width, inner = (table.column(c).to_numpy() for c in ("width", "inner"))
    for a, b in one_edit(codes, size, lists_):
        longer = (size[a] > width[a]) & (size[b] > width[b])  # these meet in the next slot
        # An edit between two halves would be seen from both; the list with the first half fixed has it.
        limit = width[a]
        same = np.ones(len(a), np.bool_)
        for d in range(int(limit.max(initial=0))):
            same &= (d >= limit) | (codes[a, d + 1] == codes[b, d + 1])
        own = ~longer & ~(inner[a] & same)
        a, b = a[own], b[own]
        at, of = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
        word = table.column("word").combine_chunks()
        n = table.column("n").combine_chunks()
        yield pa.RecordBatch.from_pydict({"word": word.take(at), "near": word.take(of), "near_n": n.take(of)})


def one_edit(codes: np.ndarray, size: np.ndarray, list_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs ``a < b`` of rows of one list at an edit distance of one; lists are runs of rows, sorted and distinct."""
    n, width = len(size), codes.shape[1] - 3
    differ = codes[1:, 1:] != codes[:-1, 1:]
    lcp = np.full(n, -1, np.int64)
    lcp[1:] = np.where(list_[1:] == list_[:-1], differ.argmax(axis=1), -1)
    # Ranges of words with d common characters begin where the LCP with the word before is below d.
    begins = [np.flatnonzero(lcp < d) for d in range(width + 1)]
    for q0 in range(0, n, QUERIES):
        q = np.arange(q0, min(q0 + QUERIES, n))
        at = np.searchsorted(begins[0], q, "right") - 1
        low, high = begins[0][at], np.append(begins[0], n)[at + 1]
        band = np.repeat(np.array([[2, 0, 1]], np.int16), len(q), axis=0)
        found = []
        for d in range(width + 1):
            # A word of d characters is the first of its range; its distance is the cell of the query's last character.
            ended = np.flatnonzero((size[low] == d) & (low > q) & (np.abs(size[q] - d) <= 1))
            if len(ended):
                hit = ended[band[ended, size[q[ended]] - d + 1] == 1]
                found.append((q[hit], low[hit]))
            if d == width or not len(q):
                break
            begin = begins[d + 1]
            end = np.append(begin[1:], n)
            going = size[begin] > d
            begin, end = begin[going], end[going]
            a, b = np.searchsorted(begin, low), np.searchsorted(begin, high)
            many = b - a
            child = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
            parent = np.repeat(np.arange(len(q)), many)
            later = end[child] - 1 > q[parent]  # pairs are found from their first word
            child, parent = child[later], parent[later]
            q, low, high, old = q[parent], begin[child], end[child], band[parent]
            char = codes[low, d + 1]
            band = np.empty_like(old)
            band[:, 0] = np.minimum(old[:, 0] + (codes[q, d] != char), old[:, 1] + 1)
            band[:, 1] = np.minimum(np.minimum(old[:, 1] + (codes[q, d + 1] != char), old[:, 2] + 1), band[:, 0] + 1)
            band[:, 2] = np.minimum(old[:, 2] + (codes[q, d + 2] != char), band[:, 1] + 1)
            alive = band.min(axis=1) <= 1
            q, low, high, band = q[alive], low[alive], high[alive], band[alive]
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))


def variants(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``words``.

    ``n_near`` counts the words one inserted, deleted or replaced code point away. ``form`` is the most frequent
    of these (ties: the smallest), if it occurs at least ``RATIO`` times as often as the word, else null, and
    ``form_n`` its count; ``root`` is where the forms lead, the word itself if it has none.

    Null and empty texts hold no words; a null key counts as the text ``null``. Repeated rows count again.
    Words of any length are compared in full. Other columns are not read; an empty table gives an empty result.
    """
    vocabulary = stored(words(docs, key, text), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_pairs(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    formed = F.col("near_n") >= RATIO * F.col("n")
    judged = vocabulary.join(near, "word", "left").select(
        "word",
        F.when(formed, F.col("near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("near_n")).alias("form_n"),
    )
    judged = stored(judged, "judged")
    return judged.join(roots(judged), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def roots(judged: DataFrame) -> DataFrame:
    """``word, root`` of the words with a form. Each step of a chain multiplies the count, so chains are short.

    All words look one, two, four, … steps ahead until the longest possible chain is covered.
    """
    hops = judged.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most = judged.agg(F.max("n")).first()[0] or 0
    steps, ahead = 0, LEAST_COUNT
    while (ahead := ahead * RATIO) <= most:
        steps += 1
    reach = 1
    while reach < steps:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hops = stored(hops.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    return hops
