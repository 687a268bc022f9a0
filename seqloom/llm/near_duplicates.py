"""Near duplicates: fast similarity sketches, banding, and exact verification.

**Sketch.** Each document's set of distinct word shingles fills ``COORDINATES`` bins in rounds: in
round ``i`` every element is thrown into one bin with a random value, and a bin keeps its earliest,
smallest entry. After ``COORDINATES`` rounds, round ``COORDINATES + j`` throws all elements into bin
``j``, so every bin fills whatever the size of the set, and two sets agree in a bin with
probability equal to their Jaccard similarity, concentrated as if the bins were independent. Rounds
stop when all bins are full: a few for usual documents, instead of one hash function per bin.

**Bands.** ``BANDS`` bands of ``ROWS`` bins are the buckets. Two sets of similarity 0.75 miss all of
them with probability ``(1 - 0.75**5)**50 = 1.3e-6``.

**Clusters.** Buckets of two are links at once. In larger ones the members' signatures (one byte for
each of ``SIGNATURE`` bins) are compared in blocks of bounded size; pairs agreeing in fewer than
``AGREE`` bytes are apart (a pair of similarity 0.75 fails this with probability below 1e-9), and of
the others each block reports a spanning forest, never all pairs. The components of these links are
clusters: documents of different clusters cannot be linked.

**Verification.** Within a cluster all pairs are decided on the full sets, in blocks of at most two
chunks of ``CHUNK`` documents, and each block reports a spanning forest of the true links. The components
of those are the answer.

Documents with equal sets are one class throughout and never paired. Texts are fetched by their hash
and only those in clusters go on. Nothing about documents reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.llm.components import components
from seqloom.llm.rolling import mix, pieces, shingles, texts_as_bytes, word_hashes
from seqloom.llm.text import SPACES, with_row
from seqloom.session import counted, stored, tasks_for

WORDS = 5
PERCENT = 75
BANDS, ROWS = 50, 5
COORDINATES = BANDS * ROWS
SIGNATURE, AGREE = 128, 63
CHUNK = 256
#: Members of blocks that are worth a Python task.
SIGNATURES_A_TASK, TEXTS_A_TASK = 20_000, 500


def sketch(elements: np.ndarray) -> np.ndarray:
    """``COORDINATES`` values of a set of 64-bit hashes; the set must not be empty."""
    full = np.uint64(2**64 - 1)
    bins = np.full(COORDINATES, full, np.uint64)
    step = max(1, min(COORDINATES, COORDINATES // len(elements)))
    for first in range(0, COORDINATES, step):
        rounds = np.arange(first, min(first + step, COORDINATES), dtype=np.uint64)
        h = mix(elements[None, :] ^ mix(rounds + np.uint64(1))[:, None])
        place = ((h >> np.uint64(32)) * np.uint64(COORDINATES)) >> np.uint64(32)
        value = (rounds[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(bins, place.ravel().astype(np.intp), value.ravel())
        if (bins != full).all():
            return bins
    for j in np.flatnonzero(bins == full).tolist():
        i = COORDINATES + j
        h = mix(elements ^ mix(np.array([i + 1], np.uint64)))
        bins[j] = (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)).min()
    return bins


_MIXERS = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_BAND = mix(np.arange(101, 101 + BANDS, dtype=np.uint64))


def band_keys(bins: np.ndarray) -> np.ndarray:
    return mix((mix(bins).reshape(BANDS, ROWS) * _MIXERS).sum(axis=1, dtype=np.uint64) ^ _BAND)


def set_key(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a = mix(elements).sum(dtype=np.uint64)
    b = mix(elements ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def document_sets(texts) -> Iterator[np.ndarray]:
    """The distinct shingles of every text, as sorted hashes."""
    data = texts_as_bytes(texts)
    for low, high in pieces(data):
        hashes, first = word_hashes(data[low:high])
        for i in range(high - low):
            yield np.unique(shingles(hashes[first[i] : first[i + 1]], WORDS))


SKETCH_SCHEMA = (
    "doc_id long, text_a long, text_b long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary"
)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = {"n_shingles": [], "set_a": [], "set_b": [], "bands": [], "signature": []}
        for elements in document_sets(batch["text"]):
            out["n_shingles"].append(len(elements))
            a, b = set_key(elements)
            out["set_a"].append(a)
            out["set_b"].append(b)
            if len(elements):
                bins = sketch(elements)
                out["bands"].append(band_keys(bins).view(np.int64))
                out["signature"].append((mix(bins[:SIGNATURE]) >> np.uint64(56)).astype(np.uint8).tobytes())
            else:
                out["bands"].append(None)
                out["signature"].append(None)
        yield batch.drop(columns="text").assign(**out)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that first connect what was apart."""
    parent, kept = list(range(n)), []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = a, b
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def _alike(signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signatures that agree in at least ``AGREE`` bytes."""
    s = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), SIGNATURE)
    left, right = [], []
    for i in range(len(s) - 1):
        same = np.flatnonzero((s[i + 1 :] == s[i]).sum(axis=1) >= AGREE)
        left.append(np.full(len(same), i))
        right.append(same + i + 1)
    return np.concatenate(left), np.concatenate(right)


def linked(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs with ``100 * intersection >= PERCENT * union``, from exact intersection counts."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, codes, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = seen[codes] > 1
    codes, owner = codes[shared], owner[shared]
    _, codes = np.unique(codes, return_inverse=True)
    common = np.zeros((n, n), np.float32)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    width = 4096
    for low in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        i, j = np.searchsorted(codes, [low, low + width])
        x = np.zeros((n, width), np.float32)
        x[owner[i:j], codes[i:j] - low] = 1
        common += x @ x.T
    both = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    return np.nonzero(np.triu(100 * both >= PERCENT * union, 1))


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys, across batches; the caller sees to it that runs are bounded."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        k = batch[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), len(batch)]
        if held and (held[-1][keys].iloc[-1].to_numpy() != k[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            held.append(batch.iloc[low:high])
            if high < len(batch):
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _link_frames(edges: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def _similar_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for run in _runs(batches, ["bucket", "i", "j"]):
        rows = run["row"].to_numpy()
        if len(rows) > 1:
            edges = _forest(len(rows), *_alike(run["signature"].tolist()))
            yield _link_frames([(rows[a], rows[b]) for a, b in edges])


def _exact_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for run in _runs(batches, ["cluster", "i", "j"]):
        rows = run["row"].to_numpy()
        if len(rows) > 1:
            edges = _forest(len(rows), *linked(list(document_sets(run["text"]))))
            yield _link_frames([(rows[a], rows[b]) for a, b in edges])


def _blocks(members: DataFrame, group: str, size: str) -> DataFrame:
    """Every member once for each pair of chunks its own chunk is in; one block has at most about two chunks."""
    chunks = _block_rows(F.col(size)).cast("int")
    mine = F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return (
        members.withColumn("chunks", chunks)
        .withColumn("mine", mine)
        .withColumn("other", other)
        .withColumn("i", F.least("mine", "other"))
        .withColumn("j", F.greatest("mine", "other"))
        .drop("chunks", "mine", "other", size)
    )


def _block_rows(size: Column) -> Column:
    """Rows that ``_blocks`` makes of a member of a group of this size."""
    return F.ceil(size / F.lit(CHUNK))


def _by_block(blocks: DataFrame, group: str, rows: int, each: int) -> DataFrame:
    """Rows of a block one after the other, in tasks of about ``each`` rows: a Python task costs more than a few small blocks."""
    dealt = blocks.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "row")
    return tasks_for(dealt, rows, each)


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit("b"), text, F.length(text)).alias("text_b")]


def near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, group, text_a, text_b``, one row per row of ``docs``.

    ``group`` numbers the components, ``text_a, text_b`` are the hash of the text.

    ``component_id`` is the smallest key reachable by links, ``kept`` says that it is the row's own.
    A text without words (null, empty, blank) has no shingles and is linked with nothing: its
    component is itself. A null key counts only if the whole component has no other, then
    ``component_id`` is null and ``kept`` false. Repeated rows are equal texts: one component. An
    empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = source.select("doc_id", *text_key(F.col("text")), "text").mapInPandas(_sketches, SKETCH_SCHEMA)
    sketched, size = counted(with_row(sketched, "row"), "sketches", n=F.count(F.lit(1)))

    # One representative per set; the smallest key of each set.
    classes = (
        sketched.where("n_shingles > 0")
        .groupBy("set_a", "set_b")
        .agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"))
    )
    classes = stored(tasks_for(classes, size["n"]), "classes")
    alone = sketched.select("row", "text_a", "text_b", "bands", "signature").join(classes.select("row"), "row")

    banded = alone.select("row", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("b"), F.max("row").alias("a"))
    buckets, size = counted(
        tasks_for(buckets.where("n > 1"), BANDS * size["n"]),
        "buckets",
        pairs=F.count_if(F.col("n") == 2),
        rows=F.coalesce(F.sum(F.when(F.col("n") > 2, F.col("n") * _block_rows(F.col("n")))), F.lit(0)),
    )
    pairs = buckets.where("n = 2").select("a", "b").distinct()
    members = banded.join(buckets.where("n > 2").select("bucket", "n"), "bucket").join(
        alone.select("row", "signature"), "row"
    )
    similar = _by_block(_blocks(members, "bucket", "n"), "bucket", size["rows"], SIGNATURES_A_TASK)
    similar = similar.mapInPandas(_similar_blocks, "a long, b long")
    about = 2 * size["pairs"] + size["rows"]
    clusters = components(pairs.union(similar), about).withColumnRenamed("component", "cluster").withColumnRenamed("node", "row")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    clustered, size = counted(
        tasks_for(clusters.join(sizes, "cluster").join(sketched.select("row", "text_a", "text_b"), "row"), about),
        "clustered",
        rows=F.coalesce(F.sum(_block_rows(F.col("n"))), F.lit(0)),
    )

    # Equal texts meet before they are shuffled; the join needs no further shuffle of texts.
    texts = source.where("text is not null").select(*text_key(F.col("text")), "text")
    texts = texts.groupBy("text_a", "text_b").agg(F.max("text").alias("text"))
    exact = texts.join(clustered, ["text_a", "text_b"]).drop("text_a", "text_b")
    links = _by_block(_blocks(exact, "cluster", "n"), "cluster", size["rows"], TEXTS_A_TASK)
    links = links.mapInPandas(_exact_blocks, "a long, b long")
    groups = components(links, size["rows"]).withColumnRenamed("node", "row")

    labelled = classes.join(groups, "row", "left").withColumn("component", F.coalesce("component", "row"))
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labelled = labelled.join(least, "component").select("set_a", "set_b", "component_id", F.col("component").alias("group"))
    return (
        sketched.drop("bands", "signature")
        .join(labelled, ["set_a", "set_b"], "left")
        .withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
        .withColumn("group", F.coalesce("group", "row"))
        .select("doc_id", "n_shingles", "component_id", "kept", "group", "text_a", "text_b")
    )


def keep_one(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the one with the smallest key (null keys last).

    Of rows equal in key and text one stays. Texts without words are duplicates of nothing and all stay.
    """
    labelled = near_duplicates(docs, key, text).where("n_shingles > 0")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_a", "text_b")
    chosen = labelled.groupBy("group").agg(F.min(rank).alias("k")).select("k.*")
    chosen = chosen.select("none", F.coalesce("doc_id", F.lit(0)).alias("id"), "text_a", "text_b")

    blank = F.length(F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")) == 0
    keyed = docs.where(~blank).select(
        F.struct(*docs.columns).alias("doc"),
        F.col(key).isNull().alias("none"),
        F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"),
        *text_key(F.col(text)),
    )
    keys = ["none", "id", "text_a", "text_b"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("none"))
    keyed = keyed.withColumn("place", first).where("place = 1").drop("place")
    return keyed.join(chosen, keys, "left_semi").select("doc.*").union(docs.where(blank))
