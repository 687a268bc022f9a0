"""Token ids in Arrow files of fixed-size-list batches.

A part is two Arrow IPC files. ``….ids.arrow`` holds record batches of ``ids`` and ``mask``, both
fixed-size lists of ``seq_len``: the documents of a range of keys, in order, as one stream cut into
equal sequences, the last one filled up with the end id and masked out. Buffers are neither compressed
nor nested in anything of variable size, so sequence ``i`` of a memory-mapped file is a slice at a known
offset and is never copied. ``….docs.arrow`` says where each document starts.

Spark ranges the documents by key, sorts each range, and a task writes its part under a fresh name;
the manifest, a Parquet table of one row per part, names the parts of the tasks that succeeded. A task
that runs again leaves an unnamed file behind and nothing else. Files are written through
``pyarrow.fs``, so the folder may be in any store that it opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import re
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, Window, functions as F

from seqloom.llm.rolling import pieces
from seqloom.session import scratch_path, stored

SEQ_LEN = 2048
BATCH_SEQUENCES = 64
CACHED_PIECES = 800_000
#: Texts encoded together: their repeated pieces are looked up once.
BATCH_CHARACTERS = 1 << 22
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST_SCHEMA = "part int, folder string, name string, n_docs long, n_tokens long"


class Encoder:
    """Ids of whole texts. A text is encoded in pieces that its tokenizer would never join.

    A byte-level pre-tokenizer starts a new token at a space unless white space stands on both sides of
    it; texts with such a space, or with the text of an added token, are encoded whole, and so is
    every text if the tokenizer is of another kind. All other pieces recur, so each worker process keeps
    the ids of those it has met, in two generations: of ``CACHED_PIECES`` the older is forgotten when the younger is
    full, except for pieces met again meanwhile. New ones are encoded as one string and told apart by their bytes.
    Of texts only the distinct pieces become Python objects.
    """

    JOINED = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        before = json.loads(self.tokenizer.to_str())
        split = before["pre_tokenizer"] or {}
        self.in_pieces = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and not before["normalizer"]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if max(vocabulary.values(), default=0) < 1 << 16 else np.dtype("<u4")
        # In a byte-level vocabulary each character is one byte.
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.widths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of_process(cls, path: str) -> Encoder:
        """One encoder per worker process. Code that travels by value has no module to keep it in between tasks."""
        kept = sys.modules.setdefault("seqloom_encoders", types.ModuleType("seqloom_encoders")).__dict__
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _learn(self, new: list[str]) -> None:
        """Add the ids of pieces, each with the space before it."""
        odd = [p for p in new if not p or p.strip() != p]
        self.pieces.update(zip(odd, self._whole([" " + p for p in odd]), strict=True))
        plain = [p for p in new if p not in self.pieces] if odd else new
        if plain:
            joined = " " + " ".join(plain)
            (found,) = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)
            ids = np.array(found.ids, self.dtype)
            sizes = map(len, plain if joined.isascii() else (p.encode("utf-8") for p in plain))
            ends = np.cumsum(np.fromiter(sizes, np.int64, len(plain)) + 1)
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends, side="right").tolist()
            data, size, at = ids.tobytes(), self.dtype.itemsize, 0
            for p, cut in zip(plain, cuts, strict=True):
                self.pieces[p] = data[at * size : cut * size]
                at = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.in_pieces:
            return self._whole(texts)
        whole = [self.JOINED.search(t) is not None or (self.added and self.added.search(t) is not None) for t in texts]
        lists = pc.split_pattern(pa.array(["" if w else t for w, t in zip(whole, texts, strict=True)], pa.large_string()), " ")
        starts = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        # The piece at a text's start has no space before it.
        heads = coded.dictionary.take(pa.array(codes[starts[:-1]])).to_pylist()
        first = self._whole([t if w else h for t, w, h in zip(texts, whole, heads, strict=True)])
        codes = np.delete(codes, starts[:-1])
        starts = starts - np.arange(len(starts))
        seen = np.bincount(codes, minlength=len(coded.dictionary)) > 0
        codes = (np.cumsum(seen) - 1)[codes]
        found = self._ids(coded.dictionary.filter(pa.array(seen)).to_pylist())

        # The ids of every place, gathered from those of the distinct pieces.
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        at = np.cumsum(lengths) - lengths
        n = lengths[codes]
        ends = np.concatenate(([0], np.cumsum(n)))
        places = np.repeat(at[codes] - ends[:-1], n) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), self.dtype)[places]
        bounds = ends[starts].tolist()
        return [f + ids[low:high].tobytes() for f, low, high in zip(first, bounds[:-1], bounds[1:], strict=True)]

    def _ids(self, distinct: list[str]) -> list[bytes]:
        """The ids of distinct pieces, each with the space before it."""
        if len(self.pieces) > CACHED_PIECES // 2:
            self.older, self.pieces = self.pieces, {}
        found = list(map(self.pieces.get, distinct))
        missing = [i for i, ids in enumerate(found) if ids is None]
        absent = [distinct[i] for i in missing]
        self.pieces.update((p, self.older[p]) for p in absent if p in self.older)
        self._learn([p for p in absent if p not in self.older])
        for i, p in zip(missing, absent, strict=True):
            found[i] = self.pieces[p]
        return found


class _Part:
    """One part while it is written."""

    def __init__(self, folder: str, seq_len: int, dtype: np.dtype, end_id: int):
        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path)
        self.folder, self.name = folder, uuid.uuid4().hex
        self.seq_len, self.dtype, self.end_id = seq_len, dtype, end_id
        value = pa.from_numpy_dtype(dtype)
        schema = pa.schema([("ids", pa.list_(value, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.files = [self.store.open_output_stream(f"{path}/{self.name}.{x}.arrow") for x in ("ids", "docs")]
        self.ids = ipc.new_file(self.files[0], schema)
        self.docs = ipc.new_file(self.files[1], INDEX)
        self.held: list[bytes] = []
        self.n_held = self.n_tokens = self.n_docs = 0

    def add(self, keys: list, encoded: list[bytes]) -> None:
        size = self.dtype.itemsize
        lengths = np.array([len(e) // size + 1 for e in encoded], np.int64)
        starts = self.n_tokens + np.cumsum(lengths) - lengths
        self.docs.write_batch(
            pa.record_batch([pa.array(keys, pa.int64()), pa.array(starts), pa.array(lengths)], schema=INDEX)
        )
        end = np.array([self.end_id], self.dtype).tobytes()
        for e in encoded:
            self.held += [e, end]
        self.n_held += int(lengths.sum())
        self.n_tokens += int(lengths.sum())
        self.n_docs += len(keys)
        if self.n_held >= self.seq_len * BATCH_SEQUENCES:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        whole = len(flat) if last else len(flat) // self.seq_len * self.seq_len
        rest = flat[whole:]
        fill = -whole % self.seq_len
        flat = np.concatenate([flat[:whole], np.full(fill, self.end_id, self.dtype)])
        mask = np.arange(len(flat)) < whole
        step = self.seq_len * BATCH_SEQUENCES
        for low in range(0, len(flat), step):
            arrays = [
                pa.FixedSizeListArray.from_arrays(pa.array(x[low : low + step]), self.seq_len) for x in (flat, mask)
            ]
            self.ids.write_batch(pa.record_batch(arrays, names=["ids", "mask"]))
        self.held, self.n_held = [rest.tobytes()], len(rest)

    def close(self) -> tuple:
        self._flush(last=True)
        for x in (self.ids, self.docs, *self.files):
            x.close()
        return self.folder, self.name, self.n_docs, self.n_tokens


def write_tokens(
    docs: DataFrame, key: str, text: str, tokenizer: str, *, seq_len: int = SEQ_LEN, end_id: int = 0, folder: str | None = None
) -> DataFrame:
    """Encode every text, append ``end_id``, write all in ascending key order; returns the manifest.

    A null text is empty (its end id only). Null keys come first. Ties are ordered by a hash of the text; repeated
    rows follow each other. An empty table writes nothing and has an empty manifest. Other columns are
    not read. ``tokenizer`` is the path of a ``tokenizer.json`` that every executor can read.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    ranged = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "row")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder = part = None
        for batch in batches:
            if batch.empty:
                continue
            if part is None:
                encoder = Encoder.of_process(tokenizer)
                part = _Part(folder, seq_len, encoder.dtype, end_id)
            texts = batch["text"].tolist()
            keys = [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
            for low, high in pieces(texts, BATCH_CHARACTERS):
                part.add(keys[low:high], encoder.encode(texts[low:high]))
        if part is not None:
            row = (TaskContext.get().partitionId(), *part.close())
            yield pd.DataFrame([row], columns=["part", "folder", "name", "n_docs", "n_tokens"])

    return stored(ranged.mapInPandas(write, MANIFEST_SCHEMA), "manifest")


def open_part(folder: str, name: str) -> tuple[ipc.RecordBatchFileReader, ipc.RecordBatchFileReader]:
    """The sequences and the documents of a part; memory-mapped where the folder is a local one."""
    store, path = fs.FileSystem.from_uri(folder)
    local = isinstance(store, fs.LocalFileSystem)
    opened = [
        pa.memory_map(f"{path}/{name}.{x}.arrow") if local else store.open_input_file(f"{path}/{name}.{x}.arrow")
        for x in ("ids", "docs")
    ]
    return ipc.open_file(opened[0]), ipc.open_file(opened[1])


def sequence(ids: ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, pa.Array]:
    """Ids and mask of the sequence ``i`` of a part, as views of the file.

    All batches but the last of a flush are full, so the batch is found by walking the batch sizes.
    """
    for b in range(ids.num_record_batches):
        batch = ids.get_batch(b)
        if i < batch.num_rows:
            n = batch.column(0).type.list_size
            flat = batch.column(0).values.to_numpy(zero_copy_only=True)
            return flat[i * n : (i + 1) * n], batch.column(1).values.slice(i * n, n)
        i -= batch.num_rows
    raise IndexError(i)


def _read_documents(folder: str, name: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of the index with the ids of their documents, front to back."""
    ids, docs = open_part(folder, name)
    flats = (
        ids.get_batch(b).column(0).values.to_numpy(zero_copy_only=True) for b in range(ids.num_record_batches)
    )
    held = np.zeros(0, np.uint16)
    for b in range(docs.num_record_batches):
        index = docs.get_batch(b)
        out = []
        for n in index.column("n_tokens").to_pylist():
            taken = []
            while n > len(held):
                taken.append(held)
                n -= len(held)
                held = next(flats)
            taken.append(held[:n])
            held = held[n:]
            out.append(np.concatenate(taken) if len(taken) > 1 else taken[0])
        yield index, out


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files of the manifest."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part in one task: the manifest, not the documents.
    parts = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples():
                for index, ids in _read_documents(p.folder, p.name):
                    yield pd.DataFrame(
                        {
                            "doc_id": index.column("doc_id").to_pandas(integer_object_nulls=True),
                            "start": index.column("start").to_numpy() + p.base,
                            "n_tokens": index.column("n_tokens").to_numpy(),
                            "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                        }
                    )

    # A number of its own, or adaptive execution would merge these few rows into one task.
    return parts.repartition(max(1, manifest.count()), "name").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

