"""Rows that bounded candidates or samples left out."""

import random
import zlib

import numpy as np
from test_decontamination import brute

from seqloom.llm import decontamination as dc, toxicity


def test_every_similar_window_is_found_wherever_it_was_edited(prose):
    rng = random.Random(29)
    items = [(i, prose(n)) for i, n in enumerate([6, 39, 39, 62, 62, 62, 77])]
    texts, expected = [], []
    for item in items:
        words = item[1].split()
        for _ in range(15):
            edited, n = list(words), rng.randint(2, 5)
            at = rng.choice([0, len(words) - n, rng.randrange(len(words) - n)])
            edited[at : at + n] = prose(n).split()
            edited = edited[rng.choice([0, len(words) // 10]) :]
            texts.append(" ".join([prose(rng.randint(1, 20)), *edited, prose(rng.randint(1, 20))]))
            expected.append(brute(texts[-1], [item]))
    assert sum(map(bool, expected)) > 50
    got = dc.Index([i for i, _ in items], [t.encode() for _, t in items]).search([t.encode() for t in texts])
    assert got == expected


def test_thresholds_are_of_all_clean_rows_of_a_language(spark, prose, monkeypatch):
    # Its maxima grow with the text.
    model = toxicity.Model.fresh(1)
    model.output = np.abs(model.output)
    model.bias = -float(np.log(9))
    model.output *= 3 / np.float32(_logit(model, prose(500)) - model.bias)
    rng = random.Random(31)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 40)
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 40, raising=False)
    monkeypatch.setattr(toxicity, "FIT_BYTES", 2000)
    docs, labels = [], []
    for i in range(1400):
        # Few rows are of one language, and many texts are longer than the ones to fit on.
        toxic = int(i % 5 == 0)
        words = prose(rng.choice([30, 60, 500])).split()
        words[:toxic] = ["grumblefest"] * toxic
        docs.append((i, " ".join(words), "xx" if i % 4 == 1 and i < 900 else "en"))
        labels.append((i, toxic))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, seed=0: model)
    _, thresholds = toxicity.fit(d, lab, "doc_id", "text", "lang", "toxic")
    expected = {}
    for lang in ("en", "xx"):
        clean = [
            model.scores([t.encode()])[0]
            for i, t, of in docs
            if of == lang and i % 5 and zlib.crc32(str(i).encode()) % 3 != 1
        ]
        assert len(clean) >= toxicity.LEAST_ROWS
        score = sorted(clean, reverse=True)[int(toxicity.FALSE_REJECTIONS * len(clean))]
        expected[lang] = min(max(score + 1e-3, 0.5), 0.9)
    assert 0.5 < expected["en"] < 0.9
    assert thresholds.keys() == expected.keys()
    assert all(abs(thresholds[k] - v) < 5e-5 for k, v in expected.items())


def _logit(model, text):
    score = model.scores([text.encode()])[0]
    return np.log(score / (1 - score))
