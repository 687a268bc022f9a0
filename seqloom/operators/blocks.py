"""Fixed-length next-token blocks from token sequences.

A block covers ``T = seq_len + 1`` consecutive tokens of its group's stream; its inputs are the
first ``seq_len`` of them and its labels the last. Documents are cut into *pieces* (one per block
they touch), so the shuffle moves about one row per document and block, never one per token.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions.text import IGNORE
from seqloom.functions.vectors import let
from seqloom.operators.numbering import TEXTS_PER_CHUNK, running, running_total


def _labelled(full: Column, valid: Column, seq_len: int, pad: int) -> list[Column]:
    """Inputs and labels of one block from its ``valid`` real tokens."""
    tail = F.array_repeat(F.lit(pad), (F.lit(seq_len + 1) - valid).cast("int"))
    inputs = F.slice(F.concat(full, tail), 1, seq_len)
    # A target exists wherever a real token follows; what lies past the last one is ignored.
    unused = F.array_repeat(F.lit(IGNORE), (F.lit(seq_len + 1) - valid).cast("int"))
    labels = F.concat(F.slice(full, 2, seq_len), unused)
    return [
        valid.cast("int").alias("n_valid"),
        inputs.cast("array<int>").alias("input_ids"),
        labels.cast("array<int>").alias("labels"),
    ]


def _cut(offsets: DataFrame, group: Sequence[str], ids: Column, seq_len: int, pad: int) -> DataFrame:
    """Blocks from documents whose place ``[_end - _n, _end)`` in the group's stream is known."""
    size = seq_len + 1
    placed = offsets.select(
        *group,
        "_n",
        (F.col("_end") - F.col("_n")).alias("_start"),
        F.expr(f"sequence((_end - _n) div {size}, (_end - 1) div {size})").alias("_touched"),
        ids.alias("_ids"),
    )

    def pieces(doc: Column) -> Column:
        def one(block: Column) -> Column:
            low = F.greatest(block * size - F.col("_start"), F.lit(0).cast("long"))
            high = F.least((block + 1) * size - F.col("_start"), F.col("_n"))
            piece = F.slice(doc, (low + 1).cast("int"), (high - low).cast("int"))
            return F.struct(
                block.alias("block"), (F.col("_start") + low).alias("at"), piece.alias("piece")
            )

        return F.transform("_touched", one)

    # Bound to a lambda variable, a document is built once and not once per piece.
    cut = let(F.concat(F.col("_ids"), F.array(F.lit(pad))), pieces)
    placed = placed.select(*group, F.inline(cut))
    # At most seq_len + 1 pieces meet in a block, however large its group is.
    blocks = placed.groupBy(*group, "block").agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda s: s["piece"]
            )
        ).alias("_full")
    )
    kept = blocks.where(F.size("_full") >= 2)
    return kept.select(
        *group, "block", *_labelled(F.col("_full"), F.size("_full"), seq_len, pad)
    )


def _documents(df: DataFrame, ids: Column, length: Column | None) -> DataFrame:
    """Non-empty documents with ``_n``, their length and that of the separator after them."""
    n = F.size(ids) if length is None else length
    return df.withColumn("_n", n.cast("long") + 1).where(F.col("_n") > 1)


def pack_batches(
    df: DataFrame,
    batch: Sequence[str],
    order: str,
    seq_len: int,
    pad: int,
    payload: str = "input_ids",
    tokens: Callable[[Column], Column] = lambda ids: ids,
) -> DataFrame:
    """Blocks of each micro-batch's stream: its documents in order, ``pad`` after each of them.

    For groups of a fixed number of rows only. Such a batch fits one row, so a single shuffle of
    ``payload`` brings it together and it is cut into blocks in place. ``tokens`` turns the
    payload (say, text) into ids after that shuffle.
    """
    _check(seq_len)
    size = seq_len + 1
    rows = df.select(*batch, F.struct(order, payload).alias("_row"))
    gathered = rows.groupBy(*batch).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    ids = F.transform("_rows", lambda r: tokens(r[payload]))
    filled = F.filter(ids, lambda i: F.size(i) > 0)
    stream = F.flatten(F.transform(filled, lambda i: F.concat(i, F.array(F.lit(pad)))))

    def cut(s: Column) -> Column:
        # Two tokens at least: a rest of one has no target and makes no block.
        starts = F.sequence(F.lit(1), F.size(s) - 1, F.lit(size))
        blocks = F.transform(starts, lambda at: F.slice(s, at, size))
        return F.when(F.size(s) >= 2, blocks).otherwise(F.array().cast("array<array<int>>"))

    blocks = gathered.select(*batch, F.posexplode(let(stream, cut)).alias("block", "_full"))
    return blocks.select(
        *batch,
        F.col("block").cast("long").alias("block"),
        *_labelled(F.col("_full"), F.size("_full"), seq_len, pad),
    )


def pack_blocks(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    seq_len: int,
    pad: int,
    ids: Column | str = "input_ids",
    length: Column | None = None,
    rows_per_chunk: int = TEXTS_PER_CHUNK,
) -> DataFrame:
    """Blocks of each group's stream, for groups of any size.

    Heavy groups are summed in chunks; no group is gathered. ``ids`` is evaluated after the
    offsets are known, so ``ids=tokenizer.ids(text)`` sorts and shuffles the text rather than its
    tokens. ``length`` may give the number of tokens by a cheaper expression than building them.
    """
    _check(seq_len)
    ids = F.col(ids) if isinstance(ids, str) else ids
    docs = _documents(df, ids, length)
    offsets = running(docs, group, order, sums={"_end": F.col("_n")}, rows_per_chunk=rows_per_chunk)
    return _cut(offsets, group, ids, seq_len, pad)


def pack_global(
    df: DataFrame,
    order: str,
    seq_len: int,
    pad: int,
    ids: Column | str = "input_ids",
    length: Column | None = None,
    rows_per_bucket: int = TEXTS_PER_CHUNK,
) -> DataFrame:
    """Blocks of the whole table as one stream, by a two-level prefix sum."""
    _check(seq_len)
    ids = F.col(ids) if isinstance(ids, str) else ids
    docs = _documents(df, ids, length)
    offsets = running_total(docs, order, {"_end": F.col("_n")}, rows_per_bucket, profile=df)
    return _cut(offsets, [], ids, seq_len, pad)


def unpacked_blocks(
    df: DataFrame, key: Sequence[str], seq_len: int, pad: int, ids: str = "input_ids"
) -> DataFrame:
    """One block per document: its first ``seq_len + 1`` tokens, no separator, padded."""
    _check(seq_len)
    cut = df.select(*key, F.slice(ids, 1, seq_len + 1).alias("_full"))
    kept = cut.where(F.size("_full") >= 2)
    return kept.select(*key, *_labelled(F.col("_full"), F.size("_full"), seq_len, pad))


def with_empty_groups(
    blocks: DataFrame, groups: DataFrame, group: Sequence[str], seq_len: int, pad: int
) -> DataFrame:
    """Give every group without a block one block of padding in which nothing is a target."""
    joined = groups.select(*group).distinct().join(blocks, list(group), "left")
    return joined.select(
        *group,
        F.coalesce("block", F.lit(0)).alias("block"),
        F.coalesce("n_valid", F.lit(1)).alias("n_valid"),
        F.coalesce("input_ids", F.array_repeat(F.lit(pad), seq_len)).alias("input_ids"),
        F.coalesce("labels", F.array_repeat(F.lit(IGNORE), seq_len)).alias("labels"),
    )


def _check(seq_len: int) -> None:
    if seq_len < 1:
        raise ValueError("seq_len must be positive")
