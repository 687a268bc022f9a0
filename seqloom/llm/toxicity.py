"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

A word's embedding is the sum of three hashed embeddings (the word, its first four and its first five
bytes), so inflected forms share one. Filters of several widths run over the whole text, each keeps its
maximum, and a logistic unit scores the maxima. Training is stochastic gradient descent (Adagrad) on a bounded,
balanced sample of labelled rows; the model has a fixed size and travels to the tasks, which score
every text in full. Language is used only to choose a threshold for a score that is already given; thresholds
come from all clean rows that may be learned from, each scored by a model that was not fitted on it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.llm.rolling import IS_PUNCTUATION, mix, pieces, stretch, texts_as_bytes, word_spans
from seqloom.session import stored

BUCKETS, DIMENSIONS, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
PREFIXES = (4, 5)
#: Labelled rows of each class to fit on; longer texts are not fitted on.
FIT_ROWS, FIT_BYTES = 2000, 20_000
EPOCHS, BATCH, RATE = 6, 16, 0.1
THRESHOLD = 0.7
#: Share of clean calibration rows of a language that its threshold may reject, and the rows it needs.
FALSE_REJECTIONS, LEAST_ROWS = 0.005, 100


def word_ids(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Three buckets for each word of all texts, and where each text's words begin."""
    sums, starts, ends, first = word_spans(data, separators=IS_PUNCTUATION)
    columns = [stretch(sums, starts, ends)] + [stretch(sums, starts, np.minimum(starts + p, ends)) for p in PREFIXES]
    ids = [(mix(h + np.uint64(i)) % np.uint64(BUCKETS)).astype(np.uint16) for i, h in enumerate(columns)]
    return np.stack(ids, axis=1), first


@dataclass
class Model:
    embeddings: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, DIMENSIONS, FILTERS)
    biases: dict[int, np.ndarray]
    output: np.ndarray
    bias: float
    squares: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        return cls(
            (rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.05).astype(np.float32),
            {k: (rng.standard_normal((k, DIMENSIONS, FILTERS)) / np.sqrt(k * DIMENSIONS)).astype(np.float32) for k in WIDTHS},
            {k: np.zeros(FILTERS, np.float32) for k in WIDTHS},
            (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32),
            0.0,
        )

    def _padded(self, ids: np.ndarray) -> np.ndarray:
        x = np.zeros((max(len(ids), 1) + max(WIDTHS) - 1, DIMENSIONS), np.float32)
        if len(ids):
            x[: len(ids)] = self.embeddings[ids].sum(axis=1)
        return x

    def _pool(self, x: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The maxima of all filters over the starts ``0 … n - 1``, and where they are."""
        values, places = [], []
        for k in WIDTHS:
            a = sum(x[j : j + n] @ self.filters[k][j] for j in range(k)) + self.biases[k]
            at = a.argmax(axis=0)
            places.append(at)
            values.append(np.maximum(a[at, np.arange(FILTERS)], 0))
        return np.concatenate(values), places

    def gradient(self, ids: np.ndarray, label: int, into: dict) -> None:
        x, n = self._padded(ids), max(len(ids), 1)
        pooled, places = self._pool(x, n)
        error = 1 / (1 + np.exp(-(pooled @ self.output + self.bias))) - label
        into["output"] = into.get("output", 0) + error * pooled
        into["bias"] = into.get("bias", 0) + error
        back = error * self.output * (pooled > 0)
        for i, k in enumerate(WIDTHS):
            g, at = back[i * FILTERS : (i + 1) * FILTERS].astype(np.float32), places[i]
            into["b", k] = into.get(("b", k), 0) + g
            w = into.setdefault(("w", k), np.zeros_like(self.filters[k]))
            for j in range(k):
                w[j] += (x[at + j] * g[:, None]).T
                inside = at + j < len(ids)
                rows = ids[(at + j)[inside]]
                into.setdefault("rows", []).append(rows.ravel())
                into.setdefault("row_gradients", []).append(
                    np.repeat((self.filters[k][j].T * g[:, None])[inside], rows.shape[1], axis=0)
                )

    def step(self, g: dict) -> None:
        """Adagrad."""

        def scaled(name, value: np.ndarray) -> np.ndarray:
            self.squares[name] = self.squares.get(name, 1e-6) + value * value
            return RATE * value / np.sqrt(self.squares[name])

        self.output -= scaled("output", g["output"]).astype(np.float32)
        self.bias -= float(scaled("bias", np.asarray(g["bias"])))
        for k in WIDTHS:
            self.filters[k] -= scaled(("w", k), g["w", k]).astype(np.float32)
            self.biases[k] -= scaled(("b", k), g["b", k]).astype(np.float32)
        rows, back = np.unique(np.concatenate(g["rows"]), return_inverse=True)
        total = np.zeros((len(rows), DIMENSIONS), np.float32)
        np.add.at(total, back, np.concatenate(g["row_gradients"]))
        seen = self.squares.setdefault("embeddings", np.full((BUCKETS, 1), 1e-4, np.float32))
        seen[rows] += (total * total).mean(axis=1, keepdims=True)
        self.embeddings[rows] -= RATE * total / np.sqrt(seen[rows])

    def scores(self, data: list[bytes]) -> np.ndarray:
        """The scores of whole texts; all texts of a piece at once, with gaps between them."""
        out, gap = [], max(WIDTHS) - 1
        for low, high in pieces(data, 1 << 18):
            ids, first = word_ids(data[low:high])
            n = np.diff(first)
            # A text has at least one start; behind its words the input is zero.
            room = np.maximum(n, 1) + gap
            begin = np.cumsum(room) - room
            x = np.zeros((int(room.sum()), DIMENSIONS), np.float32)
            if len(ids):
                at = np.repeat(begin - first[:-1], n) + np.arange(len(ids))
                x[at] = self.embeddings[ids[:, 0]] + self.embeddings[ids[:, 1]] + self.embeddings[ids[:, 2]]
            pooled = []
            inside = np.zeros(len(x), np.bool_)
            inside[np.repeat(begin - np.cumsum(np.maximum(n, 1)) + np.maximum(n, 1), np.maximum(n, 1)) + np.arange(np.maximum(n, 1).sum())] = True
            padded = np.concatenate([x, np.zeros((gap, DIMENSIONS), np.float32)])
            for k in WIDTHS:
                a = sum(padded[j : j + len(x)] @ self.filters[k][j] for j in range(k)) + self.biases[k]
                a[~inside] = 0
                pooled.append(np.maximum(np.maximum.reduceat(a, begin, axis=0), 0))
            z = np.concatenate(pooled, axis=1) @ self.output + self.bias
            # Sums of equal texts may differ in their last bits.
            out.append(np.round(1 / (1 + np.exp(-z.astype(np.float64))), 5))
        return np.concatenate(out) if out else np.zeros(0)


def train(texts: list[bytes], labels: list[int], seed: int = 0) -> Model:
    model, rng = Model.fresh(seed), np.random.default_rng(seed)
    ids, first = [], []
    for low, high in pieces(texts, 1 << 17):
        found, first = word_ids(texts[low:high])
        ids += [found[first[i] : first[i + 1]] for i in range(high - low)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for start in range(0, len(order), BATCH):
            g: dict = {}
            for i in order[start : start + BATCH].tolist():
                model.gradient(ids[i], labels[i], g)
            model.step(g)
    return model


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _marked(labels: DataFrame, key: str, label: str) -> DataFrame:
    """Each key whose label may be learned from, once, with its half of the sample: narrow rows only."""
    return (
        labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("label IN (0, 1) AND doc_id IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("hash", F.xxhash64(F.lit("fit"), "doc_id"))
        .withColumn("half", F.pmod("hash", F.lit(2)).cast("int"))
    )


def _sample(docs: DataFrame, marked: DataFrame, key: str, text: str, language: str, half: int) -> DataFrame | None:
    """At most ``FIT_ROWS`` rows of each class of one half, as a table ``doc_id, text, lang, label, hash``.

    The chosen keys go to the documents and only their rows go on; no text reaches the driver.
    """
    chosen = pd.concat(
        [
            marked.where((F.col("half") == half) & (F.col("label") == value)).orderBy("hash", "doc_id").limit(FIT_ROWS).toPandas()
            for value in (1, 0)
        ],
        ignore_index=True,
    )
    if chosen["label"].nunique() < 2:
        return None
    narrow = docs.where(F.octet_length(text) <= FIT_BYTES).select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(language).alias("_lang")
    )
    keys = _keys(docs, key, chosen["doc_id"]).join(marked.where(F.col("half") == half), F.col("k") == F.col("doc_id"))
    rows = narrow.join(F.broadcast(keys), F.col("_key") == F.col("k"))
    row = F.max(F.struct(F.col("_text").alias("text"), F.col("_lang").alias("lang"))).alias("row")
    return stored(rows.groupBy("doc_id", "label", "hash").agg(row).select("doc_id", "row.*", "label", "hash"), "sample")


def _keys(docs: DataFrame, key: str, values: pd.Series) -> DataFrame:
    return docs.sparkSession.createDataFrame([(k,) for k in values.tolist()], docs.select(F.col(key).alias("k")).schema)


def _fitted(sample: DataFrame | None) -> Model | None:
    """The model of a sample, fitted by one task: its rows are bounded in number and size. Only weights come back."""
    if sample is None:
        return None

    def fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if not rows or (found := pd.concat(rows))["label"].nunique() < 2:
            return
        found = found.sort_values(["hash", "doc_id"], kind="stable")
        model = train(texts_as_bytes(found["text"]), found["label"].tolist())
        yield pd.DataFrame({"weights": [pickle.dumps(vars(model) | {"squares": {}})]})

    weights = sample.coalesce(1).mapInPandas(fit_rows, "weights binary").collect()
    return Model(**pickle.loads(weights[0]["weights"])) if weights else None


def _scorer(docs: DataFrame, model: Model | None):
    """A function from text to score, and the broadcast it reads."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            model = shared.value
            yield pd.Series(model.scores(texts_as_bytes(texts)) if model else np.zeros(len(texts)))

    return F.pandas_udf(scored, "double"), shared


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, language: str, label: str) -> tuple[Model | None, dict]:
    """The model, from at most ``FIT_ROWS`` rows of each class, and the thresholds, from all clean rows.

    Rows are taken in the order of a hash of their key; those with an even hash fit. Clean rows that are not fitted on
    are scored by the model in Spark, whole texts of any length; the fitted ones, bounded in number, by
    a second model that is fitted on the others (without labels of both classes among these they are left out).
    A language's threshold is the lowest that rejects no more than ``FALSE_REJECTIONS`` of its clean rows,
    kept between 0.5 and 0.9; languages with fewer than ``LEAST_ROWS`` such rows have ``THRESHOLD``.
    A key counts once in each language it has. Without labels of both classes the model stays untrained and every score is 0.
    """
    marked = _marked(labels, key, label)
    sample = _sample(docs, marked, key, text, language, 0)
    model = _fitted(sample)
    if model is None:
        return None, {}
    other = _fitted(_sample(docs, marked, key, text, language, 1))
    return model, _thresholds(docs, marked, model, other, sample.where("label = 0"), key, text, language)


def _thresholds(
    docs: DataFrame, marked: DataFrame, model: Model, other: Model | None, seen: DataFrame, key: str, text: str, language: str
) -> dict[str, float]:
    """Each language's exact cutoff, from counts of its scores (at most 100,001 kinds); one row a language comes back.

    Texts are scored where they lie and only keys, languages and scores meet the labels.
    """
    unseen = marked.where("label = 0").select("doc_id").join(F.broadcast(seen.select("doc_id")), "doc_id", "left_anti")
    rows = docs.where(F.col(key).isNotNull() & F.col(language).isNotNull() & ~held_out(F.col(key)))
    score_of, shared = _scorer(docs, model)
    scored = rows.select(F.col(key).alias("k"), F.col(language).alias("lang"), score_of(F.col(text)).alias("score"))
    each = scored.join(unseen, F.col("k") == F.col("doc_id")).groupBy("k", "lang").agg(F.max("score").alias("score"))
    both, sent = each.select("lang", "score"), [shared]
    if other is not None:
        score_of, shared = _scorer(docs, other)
        sent.append(shared)
        both = both.unionAll(seen.where("lang IS NOT NULL").select("lang", score_of(F.col("text")).alias("score")))
    counts = both.groupBy("lang", "score").agg(F.count("*").alias("n"))
    of, down = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(F.desc("score"))
    above = counts.withColumn("all", F.sum("n").over(of)).withColumn("reached", F.sum("n").over(down))
    # The highest score that more rows reach than may be rejected.
    held = above.where((F.col("all") >= LEAST_ROWS) & (F.col("reached") > F.floor(F.lit(FALSE_REJECTIONS) * F.col("all"))))
    cutoffs = held.groupBy("lang").agg(F.max("score").alias("score")).collect()
    for model_sent in sent:
        model_sent.destroy()
    return {r["lang"]: float(np.clip(r["score"] + 1e-3, 0.5, 0.9)) for r in cutoffs}


def score(docs: DataFrame, labels: DataFrame, key: str, text: str, language: str, label: str) -> DataFrame:
    """All columns of ``docs`` with ``held_out, score, predicted, threshold, toxic``; such columns are replaced.

    ``predicted`` is 1 from ``THRESHOLD`` on; ``toxic`` compares with the language's own threshold (a null or rare language
    has ``THRESHOLD``). Null and empty texts are scored as texts without words. Repeated rows have equal
    scores (to five decimals), a null key is not held out, an empty table gives an empty result.
    """
    model, thresholds = fit(docs, labels, key, text, language, label)
    added = ("held_out", "score", "predicted", "threshold", "toxic")
    rest = [c for c in docs.columns if c not in added]
    # Thresholds are of the languages with ``LEAST_ROWS`` clean labels.
    pairs = [F.lit(x) for item in thresholds.items() for x in item]
    threshold = F.lit(THRESHOLD)
    if pairs:
        threshold = F.coalesce(F.create_map(*pairs)[F.coalesce(F.col(f"doc.{language}"), F.lit(""))], threshold)
    df = docs.select(F.struct(*rest).alias("doc"), _scorer(docs, model)[0](F.col(text)).alias("score"))
    return df.select(
        "doc.*",
        held_out(F.col(f"doc.{key}")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        threshold.alias("threshold"),
        (F.col("score") >= threshold).alias("toxic"),
    )
