"""A vocabulary as a table, and text to ids and back through it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from seqloom.functions.seeded import digest, prefix_bucket
from seqloom.functions.text import codepoints, split_words
from seqloom.operators.numbering import running_in_buckets
from seqloom.session import stored


# What a vocabulary may hold to be sent to every task: the size of the usual tokenizers.
SMALL_VOCAB, SMALL_BYTES = 262_144, 16 << 20
# Words (or ids) whose rows are translated together, through one dictionary.
CHUNK_ELEMENTS = 1 << 20
CHUNK = "_chunk"
# Texts that are cut into words together, in bytes.
PIECE_BYTES = 4 << 20
ELEMENTS, ELEMENT, CODE, CODES = "_elements", "_element", "_code", "_codes"


def build_vocab(df: DataFrame, text: str = "text") -> DataFrame:
    """Every distinct word with a dense id: ``(token, id, is_special)``.

    Ids follow the md5 of the word. That spreads the words evenly over 4096 buckets whatever
    their spelling or frequency, so the numbering never passes through one task. Only words that are distinct within
    some megabytes of text are rows; the distinct words of all are stored, as the numbering reads them twice.
    """
    distinct = df.select(_text(text).alias(ELEMENTS)).mapInArrow(_distinct_words, "token string").distinct()
    hashed = distinct.withColumn("_md5", digest(F.col("token")))
    bucketed = stored(hashed.withColumn("_slice", prefix_bucket(F.col("_md5"))), "words")
    numbered = running_in_buckets(bucketed, "_slice", ["_md5", "token"], {"id": F.lit(1)})
    return numbered.select(
        "token", (F.col("id") - 1).cast("long").alias("id"), F.lit(False).alias("is_special")
    )


def extend_vocab(vocab: DataFrame, specials: Sequence[str]) -> DataFrame:
    """Append control tokens after the highest id, in the order given.

    One row per token comes out of the maximum itself, so no second copy of it is needed.
    """
    top = vocab.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    added = top.select("top", F.posexplode(F.array(*[F.lit(s) for s in specials])))
    return vocab.unionByName(
        added.select(
            F.col("col").alias("token"),
            (F.col("top") + F.col("pos") + 1).cast("long").alias("id"),
            F.lit(True).alias("is_special"),
        )
    )


def pad_id(pad: int | None, eos: int | None) -> int:
    """The padding id: its own, else the end token's, else 0."""
    return pad if pad is not None else (eos if eos is not None else 0)


def special_ids(vocab: DataFrame) -> dict[str, int]:
    """The ids of the control tokens, a handful."""
    return {r["token"]: r["id"] for r in vocab.where("is_special").select("token", "id").collect()}


def encode_rows(
    df: DataFrame,
    vocab: DataFrame,
    text: str = "text",
    unknown: int | None = None,
    max_len: int | None = None,
    name: str = "input_ids",
    small_vocab: int = SMALL_VOCAB,
) -> DataFrame:
    """All rows and columns of ``df`` and ``name``, the ids of the words of ``text``.

    A word missing from the vocabulary becomes ``unknown`` (or null). ``max_len`` cuts a text to its first words before
    they are looked up. Rows without words, or without a text, have no ids; rows may be equal. ``vocab`` is
    read more than once, so it should be a stored table.

    A vocabulary of at most ``small_vocab`` entries and ``SMALL_BYTES`` goes to every task. A larger one is met in
    the cluster (``_through_dictionaries``), with the same result; a word is never a row of its own.
    """
    rows = df.withColumn(ELEMENTS, _text(text))
    return _translated(rows, vocab.select("token", "id"), "token", "id", name, unknown, small_vocab, max_len)


def _text(text: str) -> Column:
    """The text as Java's patterns would read it: bytes that are no UTF-8 are replaced."""
    return F.make_valid_utf8(F.col(text).cast("string"))


def encode(
    df: DataFrame,
    vocab: DataFrame,
    key: str,
    text: str = "text",
    unknown: int | None = None,
    small_vocab: int = SMALL_VOCAB,
    max_len: int | None = None,
) -> DataFrame:
    """``(key, input_ids)`` of every row; see ``encode_rows``. The texts themselves are not carried along."""
    rows = df.select(key, _text(text).alias(ELEMENTS))
    return _translated(rows, vocab.select("token", "id"), "token", "id", "input_ids", unknown, small_vocab, max_len)


def decode(
    df: DataFrame,
    vocab: DataFrame,
    key: str,
    ids: str = "input_ids",
    skip_special: bool = True,
    small_vocab: int = SMALL_VOCAB,
) -> DataFrame:
    """``(key, text)`` of every row: its tokens joined by spaces, control tokens left out if asked.

    Ids outside the vocabulary have no text. The two ways are those of ``encode``, with the same result.
    """
    entries = vocab.where(~F.col("is_special")) if skip_special else vocab
    rows = df.select(key, F.col(ids).cast("array<bigint>").alias(ELEMENTS))
    return _translated(rows, entries.select("id", "token"), "id", "token", "text", None, small_vocab, finish=_spaced)


def _spaced(tokens: pa.ListArray) -> pa.Array:
    """The tokens of each list that are not null, joined by spaces."""
    flat = tokens.values
    ends = np.concatenate([[0], np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False))])[tokens.offsets.to_numpy()]
    return pc.binary_join(pa.ListArray.from_arrays(ends.astype(np.int32), flat.drop_null()), " ")


def _translated(
    df: DataFrame,
    entries: DataFrame,
    source: str,
    target: str,
    name: str,
    missing,
    small_vocab: int,
    max_len: int | None = None,
    finish: Callable[[pa.ListArray], pa.Array] | None = None,
) -> DataFrame:
    """``df`` with ``name``, the values of its ``ELEMENTS``: an array column, or texts whose (first ``max_len``) words are meant.

    ``finish`` turns the lists of values into one string per row where they are made.
    """
    kind = T.ArrayType(entries.schema[target].dataType) if finish is None else T.StringType()
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token")).alias("bytes")).first()
    if size["n"] <= small_vocab and (size["bytes"] or 0) <= SMALL_BYTES:
        pair = entries.toArrow()  # within both bounds
        shared = df.sparkSession.sparkContext.broadcast(tuple(pair.column(c).combine_chunks() for c in (source, target)))

        def of_batch(column: pa.Array) -> pa.Array:
            found = [translate(lists, *shared.value, missing) for lists in _lists(column, max_len)]
            return pa.concat_arrays(found if finish is None else [finish(lists) for lists in found])

        return df.select("*", F.arrow_udf(of_batch, kind)(ELEMENTS).alias(name)).drop(ELEMENTS)
    return _through_dictionaries(df, entries, source, target, T.StructField(name, kind), missing, max_len, finish)


def _lists(column: pa.Array, max_len: int | None = None) -> Iterator[pa.ListArray]:
    """The elements of all rows in order, a piece at a time: the lists themselves, or the words of some megabytes of text."""
    if pa.types.is_list(column.type):
        yield column
        return
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))])
    low = 0
    while not low or low < len(column):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + PIECE_BYTES, "right")) - 1)
        yield split_words(column.slice(low, high - low), max_len)
        low = high


def translate(rows: pa.Array, keys: pa.Array, values: pa.Array, missing=None) -> pa.Array:
    """Every element of an array column replaced by its value, or ``missing``: one hash lookup of all of them."""
    return _relisted(rows, values.take(pc.index_in(rows.flatten().cast(keys.type), value_set=keys)), missing)


def _relisted(rows: pa.Array, found: pa.Array, missing) -> pa.ListArray:
    if missing is not None:
        found = pc.fill_null(found, missing)
    return pa.ListArray.from_arrays(_offsets(rows), found)


def _offsets(rows: pa.Array) -> np.ndarray:
    """Where each list begins in ``rows.flatten()``."""
    lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)


def _through_dictionaries(
    df: DataFrame, entries: DataFrame, source: str, target: str, value: T.StructField, missing, max_len, finish
) -> DataFrame:
    """Translate ``ELEMENTS`` by dictionaries that hold what a chunk of rows needs, joined once per chunk.

    Tasks cut chunks of rows of at most ``CHUNK_ELEMENTS`` elements (or one row), and write them: a task that runs
    again later must not cut them differently. A row is written as the numbers of its elements, as one value, and each
    distinct element of a chunk as one more row, with its number. These meet the entries in a join, and
    each chunk is translated in place by its own part of that, by number. A frequent word is one row per chunk, which AQE
    may split further; the rows themselves are moved once, to their dictionary.
    """
    kind = entries.schema[source].dataType
    kept = [f for f in df.schema.fields if f.name != ELEMENTS]
    if isinstance(df.schema[ELEMENTS].dataType, T.ArrayType):
        df = df.withColumn(ELEMENTS, F.col(ELEMENTS).cast(T.ArrayType(kind)))
    added = {CHUNK: T.LongType(), CODES: T.BinaryType(), CODE: T.IntegerType(), ELEMENT: kind}
    schema = T.StructType([T.StructField(c, t) for c, t in ({f.name: f.dataType for f in kept} | added).items()])
    chunked = stored(df.mapInArrow(lambda batches: _cut_chunks(batches, max_len), schema), "chunks")
    rows = chunked.where(F.col(CODES).isNotNull()).drop(CODE, ELEMENT)
    needed = chunked.where(F.col(ELEMENT).isNotNull()).select(F.col(CHUNK).alias("_of"), CODE, F.col(ELEMENT).alias(source))
    dictionaries = needed.join(entries, source).select("_of", CODE, target)

    def apply(rows: pa.Table, dictionary: pa.Table) -> pa.Table:
        lists = _decoded(rows.column(CODES).combine_chunks().cast(pa.binary()))
        codes, known = lists.flatten().to_numpy(), dictionary.column(CODE).to_numpy()
        places = np.full(max(codes.max(initial=-1), known.max(initial=-1)) + 2, -1, np.int32)  # the last is that of null, -1
        places[known[::-1]] = np.arange(len(known), dtype=np.int32)[::-1]
        found = places[codes]
        found = dictionary.column(target).combine_chunks().take(pa.array(found, mask=found < 0))
        lists = _relisted(lists, found, missing)
        return rows.select([f.name for f in kept]).append_column(value.name, lists if finish is None else finish(lists))

    pairs = rows.groupBy(CHUNK).cogroup(dictionaries.groupBy("_of"))
    return pairs.applyInArrow(apply, T.StructType([*kept, value]))


def _cut_chunks(batches: Iterator[pa.RecordBatch], max_len: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a task as numbered chunks (``_coded``). Chunks may cross batches; the elements are the last column."""
    chunk, held, rows, lists = TaskContext.get().partitionId() << 33, 0, [], []
    for batch in batches:
        others, start = batch.select(batch.schema.names[:-1]), 0
        for piece in _lists(batch.column(batch.num_columns - 1), max_len):
            low = 0
            for i, n in enumerate(np.diff(_offsets(piece)).tolist()):
                if held and held + n > CHUNK_ELEMENTS:
                    rows.append(others.slice(start + low, i - low))
                    lists.append(piece.slice(low, i - low))
                    yield from _coded(rows, lists, chunk)
                    chunk, held, rows, lists, low = chunk + 1, 0, [], [], i
                held += n + 1  # rows without elements count too, so that a chunk has a bounded number of rows
            rows.append(others.slice(start + low, len(piece) - low))
            lists.append(piece.slice(low, len(piece) - low))
            start += len(piece)
    if held:
        yield from _coded(rows, lists, chunk)


def _coded(rows: list[pa.RecordBatch], lists: list[pa.ListArray], chunk: int) -> Iterator[pa.RecordBatch]:
    """A chunk's rows with the numbers of their elements as bytes, -1 for null; then its distinct elements with their numbers."""
    distinct = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    codes = pc.fill_null(distinct.indices, -1).to_numpy().astype("<i4", copy=False)
    ends = 4 * np.concatenate([[0], np.cumsum(np.concatenate([np.diff(_offsets(x)) for x in lists]))])
    n, m, elements = len(ends) - 1, len(distinct.dictionary), distinct.dictionary
    own = [pa.concat_arrays([r.column(i) for r in rows]) for i in range(rows[0].num_columns)]
    binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(codes)])
    number = lambda size: pa.array(np.full(size, chunk, np.int64))
    names = [*rows[0].schema.names, CHUNK, CODES, CODE, ELEMENT]
    yield pa.RecordBatch.from_arrays([*own, number(n), binary, pa.nulls(n, pa.int32()), pa.nulls(n, elements.type)], names=names)
    own = [pa.nulls(m, c.type) for c in own]
    yield pa.RecordBatch.from_arrays([*own, number(m), pa.nulls(m, pa.binary()), pa.array(np.arange(m, dtype=np.int32)), elements], names=names)


def _decoded(binary: pa.BinaryArray) -> pa.ListArray:
    """The numbers that ``_coded`` wrote."""
    ends = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1]
    codes = np.frombuffer(binary.buffers()[2] or b"", "<i4", (ends[-1] - ends[0]) // 4, ends[0]) if ends[-1] > ends[0] else np.empty(0, "<i4")
    return pa.ListArray.from_arrays((ends - ends[0]) // 4, codes)


def _distinct_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(chunk, element)`` once per run of a chunk's rows in a batch; no more than one chunk's elements are looked at together."""
    for batch in batches:
        numbers, lists = batch.column(0).to_numpy(), batch.column(1)
        starts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist()] if len(numbers) else []
        for low, high in zip(starts, [*starts[1:], len(numbers)]):
            found = pc.unique(lists.slice(low, high - low).flatten()).drop_null()
            chunk = pa.array(np.full(len(found), numbers[low], np.int64))
            yield pa.RecordBatch.from_arrays([chunk, found], names=batch.schema.names)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of texts: distinct within a piece of text, and within several pieces that have ``CHUNK_ELEMENTS`` together."""
    lists = (piece for batch in batches for piece in _lists(batch.column(0)))
    pieces = (pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int64)), x], names=[CHUNK, ELEMENTS]) for x in lists)
    held, n = [], 0
    for found in _distinct_elements(pieces):
        held.append(found.column(1))
        n += len(held[-1])
        if n > CHUNK_ELEMENTS:
            yield pa.RecordBatch.from_arrays([pc.unique(pa.concat_arrays(held))], names=["token"])
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pc.unique(pa.concat_arrays(held))], names=["token"])


def tokenizer(name: str, vocab: DataFrame | None = None, unknown: int | None = None):
    """A function ``(df, text, max_len, name)`` that adds token ids to a table, by the tokenizer's name.

    ``codepoints`` needs no vocabulary. ``vocab`` encodes words by a given vocabulary table, ``words`` by one built of
    the words of the very table it is given. ``hf:<file>`` is a tokenizer file of the ``tokenizers`` library,
    without special tokens; its text is read once, on the driver, and each Python worker builds it once.
    """
    if name == "codepoints":
        return lambda df, text, max_len=None, name="input_ids": df.withColumn(name, codepoints(F.col(text), max_len))
    if name == "vocab":
        if vocab is None:
            raise ValueError("the tokenizer 'vocab' needs a vocabulary table")
        return lambda df, text, max_len=None, name="input_ids": encode_rows(df, vocab, text, unknown, max_len, name)
    if name == "words":
        return lambda df, text, max_len=None, name="input_ids": encode_rows(
            df, stored(build_vocab(df, text), "vocab"), text, unknown, max_len, name
        )
    if name.startswith("hf:"):
        with open(name[3:], encoding="utf-8") as f:
            return _from_file(f.read())
    raise ValueError(f"unknown tokenizer {name!r}")


def _from_file(definition: str):
    held: dict[str, object] = {}

    def add(df: DataFrame, text: str, max_len: int | None = None, name: str = "input_ids") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(definition)

        def ids(texts: pa.Array) -> pa.Array:
            if "tokenizer" not in held:
                from tokenizers import Tokenizer

                held["tokenizer"] = Tokenizer.from_str(shared.value)
            lists = []
            for low in range(0, len(texts), 256):
                some = ["" if t is None else t for t in texts.slice(low, 256).to_pylist()]
                lists += [e.ids[:max_len] for e in held["tokenizer"].encode_batch(some, add_special_tokens=False)]
            return pa.array(lists, pa.list_(pa.int32()))

        return df.withColumn(name, F.arrow_udf(ids, "array<int>")(F.col(text)))

    return add
