import random
import zlib

import numpy as np

from seqloom.llm import toxicity

MEAN = ["grumblefest", "snarlwort", "vilepatch"]


def test_gradients_match_differences():
    model = toxicity.Model.fresh(1)
    ids, _ = toxicity.word_ids([b"one two three four two"])
    for k in toxicity.WIDTHS:
        model.filters[k] = model.filters[k].astype(np.float64)
    model.embeddings = model.embeddings.astype(np.float64) * 20
    model.output = model.output.astype(np.float64)

    def loss():
        pooled, _ = model._pool(model._padded(ids).astype(np.float64), len(ids))
        return -np.log(1 / (1 + np.exp(-(pooled @ model.output + model.bias))))

    g = {}
    model.gradient(ids, 1, g)
    rows, grads = np.concatenate(g["rows"]), np.concatenate(g["row_gradients"])
    row = rows[np.abs(grads).sum(axis=1).argmax()]
    for array, at, expected in (
        (model.output, (3,), g["output"][3]),
        (model.filters[2], (1, 2, 4), g["w", 2][1, 2, 4]),
        (model.filters[3], (2, 0, 1), g["w", 3][2, 0, 1]),
        (model.embeddings, (row, 5), grads[rows == row][:, 5].sum()),
    ):
        before = array[at]
        array[at] = before + 1e-3
        up = loss()
        array[at] = before - 1e-3
        slope = (up - loss()) / 2e-3
        array[at] = before
        assert abs(slope - expected) < 2e-3 + 0.05 * abs(expected)


def test_scores_of_a_piece_are_those_of_its_texts(prose):
    model = toxicity.Model.fresh(2)
    texts = [b"", b"a", b"a b", b"...", prose(50).encode(), prose(9000).encode(), b"", b"x y z"]
    one = np.concatenate([model.scores([t]) for t in texts])
    assert np.allclose(model.scores(texts), one, atol=2e-5)
    for t, s in zip(texts, one, strict=True):
        ids, _ = toxicity.word_ids([t])
        pooled, _ = model._pool(model._padded(ids), max(len(ids), 1))
        if len(ids):
            assert abs(1 / (1 + np.exp(-(pooled @ model.output + model.bias))) - s) < 2e-5
    assert len(model.scores([])) == 0


def _corpus(prose, n):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(n):
        words = prose(rng.randint(20, 120)).split()
        toxic = int(rng.random() < 0.25)
        for _ in range(toxic * rng.randint(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(MEAN) + rng.choice(["", "s", "ing"]))
        docs.append((i, " ".join(words), rng.choice(["en", "fr"])))
        labels.append((i, toxic))
    return docs, labels


def test_learns_without_held_out_labels(spark, prose):
    docs, labels = _corpus(prose, 1500)
    # Labels that must not be learned from are all wrong.
    out = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    given = [(i, 1 - y if i in out else y) for i, y in labels]
    extra = [(None, docs[0][1], "en"), (9001, None, None), (9002, "", "xx"), (9003, prose(30_000), "en"), docs[5], docs[5]]
    d = spark.createDataFrame([(*r, "s") for r in docs + extra], "doc_id long, text string, lang string, score string")
    lab = spark.createDataFrame([*given, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(d, lab, "doc_id", "text", "lang", "toxic").collect()
    assert len(got) == len(docs) + len(extra)
    truth = dict(labels)
    wrong = 0
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 3 == 1)
        if r["doc_id"] in out:
            wrong += r["predicted"] != truth[r["doc_id"]]
    assert wrong / len(out) < 0.03
    again = {(r["doc_id"], r["text"]): r["score"] for r in toxicity.score(d, lab, "doc_id", "text", "lang", "toxic").collect()}
    assert max(abs(again[r["doc_id"], r["text"]] - r["score"]) for r in got) < 1e-3


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "text", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(d, none, "doc_id", "text", "lang", "toxic").first()["score"] == 0
    lab = spark.createDataFrame([(1, 1), (2, 0)], none.schema)
    assert toxicity.score(d.limit(0), lab, "doc_id", "text", "lang", "toxic").count() == 0


def test_clashing_columns(spark, prose):
    docs, labels = _corpus(prose, 300)
    names = ["k", "hash", "half", "_key", "row", "doc", "weights"]
    d = spark.createDataFrame([(*r, *names) for r in docs], "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    lab = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, toxic int, lang string")
    got = toxicity.score(d, lab, "doc_id", "text", "lang", "toxic")
    assert got.columns[: 3 + len(names)] == d.columns
    assert got.count() == len(docs) and got.where("score > 0").count() > 0
