"""Hard negatives: for each anchor and positive, the best rows of other labels within a range of scores.

Scores are inner products of integer vectors, so they are exact. Rows are stored once in order of their
length, longest first, and every batch of that table is a *length bucket*.

**Bucket.** With the bucket's largest length ``L``, a row whose score with anchor ``q`` reaches ``t > 0`` has a cosine
of at least ``t / (|q| L)``. If that exceeds 1 the bucket holds nothing for the anchor.

**Coordinates.** Each bucket holds one sorted list per coordinate of its unit vectors. Where unit vectors have angles
``a`` and ``b`` to an axis, the angle between them is at least ``|a - b|``. So on an anchor's focus coordinates (its
``FOCUS`` largest) the values of a candidate lie in a range, which is cut out of the sorted list by binary
search. The shortest range is taken and the others are intersected with it.

**Verification.** What is left is scored exactly. Anchors whose ranges leave most of a bucket are scored
together, as one matrix product. The threshold of an anchor is the lowest score that could still enter one of its
lists, and rises as a task goes on.

Anchors are a stated query set against all rows: they travel in blocks of ``BLOCK_CELLS`` values, each of which is two
passes over the rows (positives, then negatives). A task reports a few rows per anchor; windows over anchors take
the best of these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.llm.text import with_row
from seqloom.session import scratch_path, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these shares (in percent) of the positive's.
LOW, HIGH = 30, 90
FOCUS = 3
#: Values in the anchors of one block, and in the rows and score matrices handled at once.
BLOCK_CELLS, CELLS = 1 << 20, 1 << 21
ROWS_PER_TASK, LEAST_ROWS = 1 << 20, 1 << 11

HITS = (
    "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, "
    "row long, vec_id long, score long"
)


def integer_vectors(vector: Column) -> Column:
    """``floor(256 * x)`` of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def whole(vector: Column) -> Column:
    """Is there a vector, with nothing null or not finite in it?"""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def index(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """The rows that take part as a table in order of length: ``row, vec_id, label, length, parts``."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole(F.col("v")))
    rows = rows.select("vec_id", "label", integer_vectors(F.col("v")).alias("parts"))
    square = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("length", F.sqrt(square))
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(n / ROWS_PER_TASK), min(math.ceil(n / LEAST_ROWS), 4 * cores))
    # Very many rows may be of one length; the hash spreads these over several partitions.
    salted = rows.withColumn("salt", F.xxhash64("vec_id", "parts"))
    ordered = salted.repartitionByRange(parts, F.desc("length"), "salt")
    return stored(with_row(ordered.sortWithinPartitions(F.desc("length"), "salt").drop("salt"), "row"), "vectors")


def mine(df: DataFrame, key: str, vector: str, label: Column, is_anchor: Column) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are the ``POSITIVES`` other rows of its label with the highest scores; per positive the first
    ``NEGATIVES`` rows of other labels with ``LOW * positive <= 100 * score <= HIGH * positive`` are
    ranked from 1. Ties go to the smaller id. ``is_anchor`` is a condition on ``vec_id``.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part. Repeated rows are
    rows of their own (anchors, positives and negatives). A shorter vector is continued by zeros; empty
    vectors score 0. An anchor without positives, or a positive without such negatives, has no row; an empty
    table gives an empty result. Other columns are not read. A score outside of 64 bits is an error.
    """
    spark = df.sparkSession
    rows = index(df, key, vector, label)
    anchors = rows.where(is_anchor)
    cells = anchors.agg(F.sum(F.size("parts") + 8)).first()[0] or 0
    blocks = math.ceil(cells / BLOCK_CELLS)
    path = scratch_path(spark, "anchors")
    anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1)))).write.partitionBy("block").parquet(path)
    found = [spark.createDataFrame([], HITS)]
    for b in range(blocks):
        block = spark.read.schema(f"{_ddl(rows)}, block long").parquet(path).where(F.col("block") == b)
        found.append(_mine_block(rows, block.drop("block").toArrow()))
    hits = found[0] if len(found) == 1 else found[1]
    for more in found[2:]:
        hits = hits.union(more)
    best = _best(hits, ["anchor_row", "positive_row"], NEGATIVES)
    return best.select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)


def _mine_block(rows: DataFrame, anchors: pa.Table) -> DataFrame:
    """The tasks' best negatives for one block of anchors, as a table."""
    context = rows.sparkSession.sparkContext
    if not anchors.num_rows:
        return rows.sparkSession.createDataFrame([], HITS)
    sent = context.broadcast(anchors.combine_chunks().to_batches()[0])
    scored = rows.mapInArrow(lambda batches: _positives(sent.value, batches), HITS)
    positives = stored(_best(scored, ["anchor_row"], POSITIVES), "positives").toArrow()
    known = context.broadcast(positives.combine_chunks())
    hits = stored(rows.mapInArrow(lambda batches: _negatives(sent.value, known.value, batches), HITS), "negatives")
    sent.destroy()
    known.destroy()
    return hits


def _best(hits: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Vectors:
    """Rows of a batch as arrays; shorter vectors are continued by zeros."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        self.row, self.id, self.label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label"))
        parts = batch.column("parts")
        values = parts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(parts.offsets.to_numpy()).astype(np.intp)
        self.width = int(sizes.max(initial=0))
        self.parts = np.zeros((len(sizes), self.width), np.int64)
        self.parts[np.arange(self.width) < sizes[:, None]] = values
        self.length = np.sqrt((self.parts.astype(np.float64) ** 2).sum(axis=1))
        self.most = int(np.abs(self.parts).max(initial=0))
        unit = self.parts / np.where(self.length > 0, self.length, 1)[:, None]
        self.unit = np.clip(unit, -1, 1)

    def __len__(self) -> int:
        return len(self.row)


class Bucket:
    """Rows of about one length, with a sorted list for each coordinate that is asked for."""

    def __init__(self, vectors: Vectors, at: np.ndarray):
        self.id, self.row, self.label = vectors.id[at], vectors.row[at], vectors.label[at]
        self.parts, self.unit, self.most = vectors.parts[at], vectors.unit[at], vectors.most
        self.longest = float(vectors.length[at].max(initial=0))
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def column(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._sorted:
            values = self.unit[:, f] if f < self.unit.shape[1] else np.zeros(len(self.row))
            order = np.argsort(values, kind="stable")
            self._sorted[f] = values[order], order
        return self._sorted[f]

    def candidates(self, anchors: Vectors, at: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(anchors, rows)`` to score so that no score of ``least`` or more is missed."""
        reach = anchors.length[at] * self.longest
        cosine = np.where(least > 0, least / np.where(reach > 0, reach, 1), -1)
        at, cosine = at[cosine <= 1 + 1e-9], cosine[cosine <= 1 + 1e-9]
        n, width = len(self.row), min(FOCUS, anchors.width)
        if not width:
            yield at, np.arange(n)
            return
        focus = np.argsort(-np.abs(anchors.unit[at]), axis=1, kind="stable")[:, :width]
        angle = np.arccos(np.take_along_axis(anchors.unit[at], focus, axis=1))
        spread = np.arccos(np.clip(cosine, -1, 1))[:, None]
        low = np.cos(np.minimum(angle + spread, np.pi)) - 1e-9
        high = np.cos(np.maximum(angle - spread, 0)) + 1e-9
        begin, end = np.zeros(focus.shape, np.intp), np.full(focus.shape, n)
        for f in np.unique(focus).tolist():
            values, _ = self.column(f)
            asks = focus == f
            begin[asks] = np.searchsorted(values, low[asks], "left")
            end[asks] = np.searchsorted(values, high[asks], "right")
        size = end - begin
        few = size.min(axis=1, initial=n) < n // 2
        if not few.all():
            yield at[~few], np.arange(n)
        for i in np.flatnonzero(few).tolist():
            first = int(size[i].argmin())
            rows = self.column(int(focus[i, first]))[1][begin[i, first] : end[i, first]]
            for k in range(width):
                if k != first and len(rows):
                    values = self.unit[rows, focus[i, k]] if focus[i, k] < self.unit.shape[1] else np.zeros(len(rows))
                    rows = rows[(values >= low[i, k]) & (values <= high[i, k])]
            if len(rows):
                yield at[i : i + 1], rows

    def scores(self, anchors: Vectors, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The exact scores: doubles hold integers below 2**53."""
        width = min(anchors.width, self.parts.shape[1])
        largest = anchors.most * self.most * max(width, 1)
        if largest >= 2**63:
            raise ValueError("a score may not fit 64 bits")
        kind = np.float64 if largest < 2**53 else np.int64
        left, right = anchors.parts[at, :width].astype(kind), self.parts[rows, :width].astype(kind)
        return (left @ right.T).astype(np.int64)


class Best:
    """For each list the ``k`` highest scores met, and the lowest that could still enter."""

    def __init__(self, lists: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.list, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))
        self.lists = lists

    def add(self, to: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(to):
            return
        to, score = np.concatenate([self.list, to]), np.concatenate([self.score, scores])
        key, row = np.concatenate([self.id, ids]), np.concatenate([self.row, rows])
        order = np.lexsort((row, key, -score, to))
        place = np.arange(len(order)) - np.searchsorted(to[order], to[order])
        order = order[place < self.k]
        self.list, self.score, self.id, self.row = to[order], score[order], key[order], row[order]
        full = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[self.list[full]] = np.maximum(self.least[self.list[full]], self.score[full])

    def offer(self, to: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """A matrix of scores, one line per list in ``to``; only the best of each line are looked at."""
        ok = allowed & (scores >= self.least[to][:, None])
        if scores.shape[1] > 4 * self.k and (ok.sum(axis=1) > 4 * self.k).any():
            lowest = np.iinfo(np.int64).min
            kth = np.partition(np.where(ok, scores, lowest), -self.k, axis=1)[:, -self.k]
            ok &= scores >= kth[:, None]
        at, place = np.nonzero(ok)
        self.add(to[at], scores[at, place], ids[place], rows[place])


def _buckets(batches: Iterator[pa.RecordBatch], by_label: bool) -> Iterator[tuple[int | None, Bucket]]:
    for batch in batches:
        step = batch.num_rows
        if step:
            width = max(1, len(batch.column("parts").flatten()) // step)
            step = min(step, max(64, CELLS // width))
        for low in range(0, batch.num_rows, max(step, 1)):
            vectors = Vectors(batch.slice(low, step))
            if not by_label:
                yield None, Bucket(vectors, np.arange(len(vectors)))
                continue
            for label in np.unique(vectors.label).tolist():
                yield label, Bucket(vectors, np.flatnonzero(vectors.label == label))


def _pieces(at: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    step = max(1, CELLS // max(len(rows), 1))
    for low in range(0, len(at), step):
        yield at[low : low + step]


def _positives(sent: pa.RecordBatch, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each anchor the task's best other rows of its label."""
    anchors = Vectors(sent)
    lowest = np.iinfo(np.int64).min
    best = Best(len(anchors), POSITIVES, np.full(len(anchors), lowest))
    for label, bucket in _buckets(batches, by_label=True):
        same = np.flatnonzero(anchors.label == label)
        for at, rows in bucket.candidates(anchors, same, best.least[same].astype(np.float64)):
            for some in _pieces(at, rows):
                other = anchors.row[some][:, None] != bucket.row[rows][None, :]
                best.offer(some, bucket.scores(anchors, some, rows), other, bucket.id[rows], bucket.row[rows])
    none = np.full(len(best.list), -1)
    yield _hits(anchors, best, best.list, none, none, none)


def _negatives(sent: pa.RecordBatch, known: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each anchor and positive the task's best rows of other labels within the range."""
    anchors = Vectors(sent)
    of, key, row, score = (known.column(c).to_numpy() for c in ("anchor_row", "vec_id", "row", "score"))
    place = {r: i for i, r in enumerate(anchors.row.tolist())}
    owner = np.array([place[r] for r in of.tolist()], np.int64)
    order = np.lexsort((row, key, -score, owner))
    owner, key, row, score = owner[order], key[order], row[order], score[order]
    # The least and the greatest score of a negative, without products that overflow.
    hundreds, rest = score // 100, score % 100
    low, high = LOW * hundreds - (-LOW * rest) // 100, HIGH * hundreds + (HIGH * rest) // 100
    best = Best(len(owner), NEGATIVES, low)
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    of_anchor = np.full((len(anchors), POSITIVES), -1)
    of_anchor[owner, nth] = np.arange(len(owner))
    for _, bucket in _buckets(batches, by_label=False):
        least = np.full(len(anchors), np.inf)
        open_ = best.least <= high
        np.minimum.at(least, owner[open_], best.least[open_].astype(np.float64))
        asking = np.flatnonzero(least < np.inf)
        for at, rows in bucket.candidates(anchors, asking, least[asking]):
            for some in _pieces(at, rows):
                scores = bucket.scores(anchors, some, rows)
                other = anchors.label[some][:, None] != bucket.label[rows][None, :]
                for k in range(POSITIVES):
                    lists = of_anchor[some, k]
                    has = np.flatnonzero(lists >= 0)
                    if len(has):
                        allowed = other[has] & (scores[has] <= high[lists[has]][:, None])
                        best.offer(lists[has], scores[has], allowed, bucket.id[rows], bucket.row[rows])
    at = best.list
    yield _hits(anchors, best, owner[at], row[at], key[at], score[at])


def _hits(anchors: Vectors, best: Best, owner, positive_row, positive_id, positive_score) -> pa.RecordBatch:
    columns = {
        "anchor_row": anchors.row[owner],
        "anchor_id": anchors.id[owner],
        "positive_row": positive_row,
        "positive_id": positive_id,
        "positive_score": positive_score,
        "row": best.row,
        "vec_id": best.id,
        "score": best.score,
    }
    return pa.RecordBatch.from_pydict({k: pa.array(np.asarray(v, np.int64)) for k, v in columns.items()})
