"""Exact repeats: every byte covered by a ``LENGTH``-byte string that starts somewhere else too.

A depth-limited radix sort of suffixes, most significant digit first: suffixes are ordered only through
``LENGTH`` bytes, a group is dropped as soon as it has one member, and the groups left after the last digit are
exactly the repeated strings. Two things keep it near the size of the input instead of many times it:

* **First digit.** A window of ``LENGTH`` bytes holds the ``GRAM``-byte strings at its first ``REACH`` places; the one
  with the smallest hash is its anchor. Equal windows have equal anchors at equal places, so the anchor's
  string is the first digit. Neighbouring windows share anchors: one row stands for a *run* of them.
* **Second digit.** The run's whole stretch of bytes. Runs with equal stretches are one class, and a class of
  several runs is repeated throughout; nothing in it need be ordered further. That also folds copies of
  any number into one row.
* **Third digit.** Only where an anchor's string has several classes (the edges of repeated passages) runs are
  cut into groups of ``STEP`` neighbouring places. The bytes common to all windows of a group are its core, those
  of all together its stretch. A group whose core no other class has holds nothing repeated, one whose
  stretch another class has is repeated throughout.
* **Last digit.** Where the stretches of a core differ, each window is a row, and windows in two classes are repeated.

Digits travel as 64-bit hashes. Which strings still have several members is told to the next reading of
the texts by a bitmap of fixed size (``BITS``): bits set by chance cost rows, never results. Texts are named by a
128-bit hash, so copies are one text. Texts are read six times, and only those that may have repeats are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.near_duplicates import text_key
from seqloom.llm.rolling import BYTE_VALUES, mix, running, stretch, texts_as_bytes
from seqloom.session import stored

LENGTH, GRAM = 200, 64
REACH = LENGTH - GRAM + 1
STEP = 12
#: Bits of a bitmap (16 MB), whatever the size of the input.
BITS = 1 << 27
#: Bytes handled at a time; longer texts go in overlapping segments of so many window starts.
PIECE, SEGMENT = 1 << 17, 1 << 22
#: Classes a task remembers to have told about.
SEEN_CLASSES = 200_000
_PLACE = np.uint64((1 << 24) - 1)


def segments(data: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of consecutive texts: the bytes, and for each stretch ``(text, offset in it, start in the piece, end)``."""
    held, size, table = [], 0, []
    for i, d in enumerate(data):
        for base in range(0, max(len(d) - LENGTH + 1, 0), SEGMENT):
            part = d[base : base + SEGMENT + LENGTH - 1]
            if held and size + len(part) > PIECE:
                yield np.frombuffer(b"".join(held), np.uint8), np.array(table, np.int64)
                held, size, table = [], 0, []
            table.append((i, base, size, size + len(part)))
            held.append(part)
            size += len(part)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(table, np.int64)


def runs(piece: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The runs of windows with one anchor: text, first and last window, anchor (places in the text), and digits."""
    sums = running(BYTE_VALUES[piece])
    at = np.arange(len(piece) - GRAM + 1)
    grams = mix(stretch(sums, at, at + GRAM))
    # The smallest hash in each REACH places, the leftmost of equal ones: by blocks, from both sides.
    keys = (grams & ~_PLACE) | at.astype(np.uint64)
    blocks = -(-len(keys) // REACH)
    padded = np.full(blocks * REACH, np.uint64(2**64 - 1), np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, REACH)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    starts = np.arange(len(piece) - LENGTH + 1)
    anchor = (np.minimum(ahead[starts], behind[starts + REACH - 1]) & _PLACE).astype(np.int64)
    # Windows inside one stretch.
    n = table[:, 3] - table[:, 2] - LENGTH + 1
    windows = np.repeat(table[:, 2] - np.cumsum(n) + n, n) + np.arange(n.sum())
    owner = np.repeat(np.arange(len(table)), n)
    anchor = anchor[windows]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(new)])) - 1
    low, high, q, own = windows[first], windows[last], anchor[first], owner[first]
    gram = grams[q]
    span = stretch(sums, low, high + LENGTH) + mix(((q - low).astype(np.uint64) << np.uint64(32)) | (q - high).astype(np.uint64))
    shift = table[own, 1] - table[own, 2]
    return sums, {
        "text": table[own, 0],
        "low": low + shift,
        "high": high + shift,
        "anchor": q + shift,
        "gram": gram.view(np.int64),
        "class": mix(mix(span) ^ gram).view(np.int64),
        "piece_low": low,
        "piece_high": high,
    }


def _groups(sums: np.ndarray, r: dict[str, np.ndarray], use: np.ndarray) -> dict[str, np.ndarray]:
    """The chosen runs cut by how far their windows lie before the anchor: ``STEP`` distances a group."""
    q = (r["anchor"] - r["low"] + r["piece_low"])[use]
    near, far = q - r["piece_high"][use], q - r["piece_low"][use]
    first = near // STEP
    n = far // STEP - first + 1
    run = np.repeat(np.arange(len(q)), n)
    group = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    low, high = np.maximum(group * STEP, near[run]), np.minimum(group * STEP + STEP - 1, far[run])
    gram = r["gram"][use][run].view(np.uint64)
    q = q[run]
    # The core lies in every window of the group, also in those of a run that has only some of them.
    core = stretch(sums, q - group * STEP, q - group * STEP - STEP + 1 + LENGTH)
    whole = stretch(sums, q - high, q - low + LENGTH)
    place = ((low.astype(np.uint64) << np.uint64(32)) | high.astype(np.uint64)) + np.uint64(1)
    return {
        "core": mix(mix(core ^ gram) + group.astype(np.uint64)).view(np.int64),
        "stretch": mix(mix(whole ^ gram) + mix(place)).view(np.int64),
        "class": r["class"][use][run],
        "back_low": low.astype(np.int16),
        "back_high": high.astype(np.int16),
        "piece_anchor": q,
    }


def _new_classes(classes: np.ndarray, use: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which of the used runs are the first of their class in this task. All runs of a class have the same windows.

    A full memory is emptied: a class may then be told again, which changes no result.
    """
    at = np.flatnonzero(use)
    values, first = np.unique(classes[at], return_index=True)
    fresh = [i for v, i in zip(values.tolist(), first.tolist(), strict=True) if v not in seen]
    if len(seen) > SEEN_CLASSES:
        seen.clear()
    out = np.zeros_like(use)
    out[at[fresh]] = True
    seen.update(classes[at[fresh]].tolist())
    return out


def _bitmap(values: DataFrame) -> np.ndarray:
    """The bits of the ``gram`` values; the driver gets ``BITS`` bits at most."""
    place = F.col("gram").bitwiseAND(F.lit(BITS - 1)) + 1  # these functions count from 1
    rows = (
        values.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .toLocalIterator()
    )
    out = np.zeros(BITS // 8, np.uint8)
    for bucket, bits in rows:
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return out


def _in(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    place = gram & np.int64(BITS - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _mapped(docs: DataFrame, schema: str, rows: Callable) -> DataFrame:
    """``rows(sums, found, batch, seen)`` for the runs of every text, as a table; ``seen`` lives as long as the task."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.iloc[low : low + 500]
                for piece, table in segments(texts_as_bytes(part["text"])):
                    yield rows(*runs(piece, table), part, seen)

    return docs.mapInPandas(each, schema)


def repeated_spans(docs: DataFrame, text: str) -> DataFrame:
    """``text_a, text_b, spans``: for each distinct text with repeats the covered byte ranges ``(start, end)``, which may overlap."""
    context = docs.sparkSession.sparkContext
    texts = docs.where(F.octet_length(text) >= LENGTH).select(*text_key(F.col(text)), F.col(text).alias("text"))

    grams = _mapped(texts.select("text"), "gram long", lambda sums, r, batch, seen: pd.DataFrame({"gram": r["gram"]}))
    several = context.broadcast(_bitmap(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")))

    def kept(sums, r, batch, seen):
        use = _in(several.value, r["gram"])
        names = batch[["text_a", "text_b"]].to_numpy()[r["text"][use]].reshape(-1, 2)
        columns = {k: r[k][use] for k in ("gram", "class")}
        columns |= {k: r[k][use].astype(np.int32) for k in ("low", "high", "anchor")}  # a text is below 2 GB
        return pd.DataFrame({"text_a": names[:, 0], "text_b": names[:, 1], **columns})

    members = stored(
        _mapped(texts, "text_a long, text_b long, low int, high int, anchor int, gram long, class long", kept), "runs"
    )
    classes = stored(members.groupBy("gram", "class").agg(F.count(F.lit(1)).alias("n")), "classes")
    mixed_grams = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("gram")
    mixed = context.broadcast(_bitmap(mixed_grams))

    def groups(sums, r, batch, seen):
        g = _groups(sums, r, _new_classes(r["class"], _in(mixed.value, r["gram"]), seen))
        return pd.DataFrame({k: g[k] for k in ("core", "stretch", "class", "back_low", "back_high")})

    third = stored(
        _mapped(texts.select("text"), "core long, stretch long, class long, back_low short, back_high short", groups), "groups"
    )
    several_stretches = third.groupBy("core").agg(F.min("stretch").alias("a"), F.max("stretch").alias("b")).where("a <> b")
    open_cores = context.broadcast(_bitmap(several_stretches.select(F.col("core").alias("gram"))))

    def windows(sums, r, batch, seen):
        g = _groups(sums, r, _new_classes(r["class"], _in(mixed.value, r["gram"]), seen))
        use = _in(open_cores.value, g["core"])
        anchor, low, high = g["piece_anchor"][use], g["back_low"][use], g["back_high"][use]
        n = high - low + 1
        back = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(anchor, n) - back
        return pd.DataFrame(
            {
                "window": mix(stretch(sums, at, at + LENGTH)).view(np.int64),
                "class": np.repeat(g["class"][use], n),
                "back": back.astype(np.int16),
            }
        )

    last = stored(_mapped(texts.select("text"), "window long, class long, back short", windows), "windows")

    def in_two_classes(rows: DataFrame, digit: str) -> DataFrame:
        several = rows.groupBy(digit).agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b")
        return rows.join(several.select(digit), digit)

    # Between the outermost repeated windows of a run every byte is covered: they are nearer than LENGTH.
    edges = (
        in_two_classes(third, "stretch")
        .select("class", "back_low", "back_high")
        .union(in_two_classes(last, "window").select("class", "back", "back"))
        .groupBy("class")
        .agg(F.max("back_high").alias("first"), F.min("back_low").alias("final"))
    )
    # What is known of a class goes to its runs in one join.
    known = classes.select("class", "n").join(edges, "class", "left").where("n > 1 OR first IS NOT NULL")
    spans = members.drop("gram").join(known, "class").select(
        "text_a",
        "text_b",
        F.when(F.col("n") > 1, F.col("low")).otherwise(F.col("anchor") - F.col("first")).alias("start"),
        (F.when(F.col("n") > 1, F.col("high")).otherwise(F.col("anchor") - F.col("final")) + LENGTH).alias("end"),
    )
    return spans.groupBy("text_a", "text_b").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # of one text


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


CUT_SCHEMA = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


def remove_repeats(docs: DataFrame, text: str, keep_text: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, with ``n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_text``, the
    remaining bytes); columns of these names are replaced.

    Null and empty texts have no bytes; texts shorter than ``LENGTH`` keep all. Repeated rows are repeats of
    each other and lose all bytes if long enough. An empty table gives an empty result.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * keep_text
    rest = [c for c in docs.columns if c not in added and c != text]

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            rows = []
            for data, found in zip(texts_as_bytes(texts), spans, strict=True):
                gone, kept, at = _merged(found if found is not None else []), [], 0
                for start, end in gone:
                    kept.append(data[at:start])
                    at = end
                left = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left if keep_text else None))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    named = docs.select(F.struct(*rest).alias("doc") if rest else F.lit(None).alias("doc"), F.col(text).alias("text"), *text_key(F.col(text)))
    spans = stored(repeated_spans(docs, text), "spans")
    found = docs.sparkSession.sparkContext.broadcast(_bitmap(spans.select(F.col("text_a").alias("gram"))))
    # Only texts that may have spans are moved to them; bits set by chance move a few more.
    named = named.withColumn("moved", F.pandas_udf(lambda a: pd.Series(_in(found.value, a.to_numpy())), "boolean")("text_a"))
    joined = named.where("moved").join(spans, ["text_a", "text_b"], "left").select("doc", "text", "spans")
    left = named.where("NOT moved").select("doc", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    df = joined.union(left).select("doc", F.pandas_udf(cut, CUT_SCHEMA)("text", "spans").alias("cut"))
    return df.select(*(["doc.*"] if rest else []), *(F.col(f"cut.{c}").alias(c) for c in added))
