"""License scans: a positional index of rare words finds places of license phrases and notices.

**Templates.** A template is a phrase or a notice, as words. It is found at a place of a text if the words that agree
with it, position by position, weigh at least ``share`` percent of it, and all words of its *key phrases* agree. Words
weigh by their inverse document frequency over all documents of the table. The ``PHRASES`` must agree in full.

**Index.** A place that agrees with ``share`` percent of a template's weight has one of its rarest words, namely of
those that outweigh the other ``100 - share`` percent. Only these are filed, each with its template and
position. A text's words are looked up there, so only its rarest license words have postings at all; a posting and
the word's place give the place of the whole template.

**Verification.** At every such place the other words of the template are compared by position, then its key
phrases, then (since words are compared by 64-bit hashes) the bytes of the words that agreed.

Templates are a fixed list, so the index that travels to the tasks and the table of frequencies are of fixed size. Texts
never leave their rows; nothing but partial counts of template words is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.rolling import IS_PUNCTUATION, mix, pieces, stretch, texts_as_bytes, word_spans

# The phrases, and short public license notices with the phrases they must contain.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at",
        ["apache license version 2 0", "in compliance with the license"],
    ),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ["free software", "gnu general public license"],
    ),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ["source and binary forms", "conditions are met"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ["with or without fee"],
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ["mozilla public license"],
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    (
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights",
        ["waived all copyright"],
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
]
#: The share of its weight, in percent, that a notice must find.
SHARE = 70


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    share: int
    #: For each word, must it agree?
    key: tuple[bool, ...]
    base: bool = False


def template(label: str, text: str, phrases: Sequence[str], share: int = SHARE, base: bool = False) -> Template:
    words, key = tuple(text.split()), [False] * len(text.split())
    for phrase in phrases:
        own = tuple(phrase.split())
        at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
        key[at : at + len(own)] = [True] * len(own)
    return Template(label, words, share, tuple(key), base)


TEMPLATES = [
    *(template(label, phrase, [phrase], 100, True) for phrase, label in PHRASES.items()),
    *(template(*notice) for notice in NOTICES),
]


def weight(documents: int, having: int) -> int:
    """What a word weighs: a thousand times its inverse document frequency, and 1 at least."""
    return 1 + round(1000 * math.log((documents + 1) / (having + 1)))


def _words_of(data: list[bytes]):
    """Hashes of the words of all texts, their bytes, and where each text's words begin."""
    sums, starts, ends, first = word_spans(data, separators=IS_PUNCTUATION)
    return mix(stretch(sums, starts, ends)), starts, ends, first


def _hashes(words: Sequence[str]) -> np.ndarray:
    return _words_of([" ".join(words).encode()])[0]


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def frequencies(docs: DataFrame, text: str, templates: Sequence[Template]) -> dict[str, int]:
    """In how many rows each word of the templates occurs; counted in the tasks, one row per word and task."""
    words = vocabulary(templates)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _hashes(words)
        order = np.argsort(known)
        known, total = known[order], np.zeros(len(words), np.int64)
        for batch in batches:
            data = texts_as_bytes(batch["text"])
            for low, high in pieces(data):
                hashes, _, _, first = _words_of(data[low:high])
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[place] == hashes)
                owner = np.searchsorted(first, hit, side="right") - 1
                total += np.bincount(np.unique(owner * len(known) + place[hit]) % len(known), minlength=len(known))
        yield pd.DataFrame({"word": [words[i] for i in order], "n": total})

    counted = docs.select(F.col(text).alias("text")).mapInPandas(count, "word string, n long")
    found = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row per word of the templates
    return {w: 0 for w in words} | {r["word"]: r["n"] for r in found}


class Index:
    """Postings of the templates' rarest words: ``(template, position)`` by the word's hash."""

    def __init__(self, templates: Sequence[Template], weights: dict[str, int]):
        self.templates = list(templates)
        self.hashes = [_hashes(t.words) for t in templates]
        self.weights = [np.array([weights[w] for w in t.words], np.int64) for t in templates]
        self.key = [np.array(t.key) for t in templates]
        keys, of, position = [], [], []
        for n, t in enumerate(templates):
            rare = self.rarest(t, weights)
            for p, w in enumerate(t.words):
                if w in rare:
                    keys.append(self.hashes[n][p])
                    of.append(n)
                    position.append(p)
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys, starts = np.unique(np.array(keys, np.uint64)[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.of, self.position = np.array(of, np.intp)[order], np.array(position, np.intp)[order]

    @staticmethod
    def rarest(t: Template, weights: dict[str, int]) -> set[str]:
        """The heaviest words of a template, as many as it takes for the rest to weigh less than its share."""
        rest = total = sum(weights[w] for w in t.words)
        rare: set[str] = set()
        for w in sorted(set(t.words), key=lambda w: (-weights[w], w)):
            if 100 * rest < t.share * total:
                break
            rare.add(w)
            rest -= weights[w] * t.words.count(w)
        return rare

    def search(self, data: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """The number of words of each text, and its finds: ``(template, first word, share)``, in order."""
        hashes, starts, ends, first = _words_of(data)
        found: list[list[tuple[int, int, float]]] = [[] for _ in data]
        joined = b"\n".join(data) + b"\n"
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[place] == hashes)
        low, n = self.starts[place[at]], np.diff(self.starts)[place[at]]
        posting = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(at, n)
        owner = np.searchsorted(first, at, side="right") - 1
        for t in np.unique(self.of[posting]).tolist():
            mine = self.of[posting] == t
            begin = at[mine] - self.position[posting[mine]]
            # A notice may overlap the ends of its text: places of two texts are told apart by their owner.
            begin, own = np.unique(np.stack([begin, owner[mine]]), axis=1)
            places = begin[:, None] + np.arange(len(self.hashes[t]))
            inside = (places >= first[own][:, None]) & (places < first[own + 1][:, None])
            same = inside & (hashes[np.clip(places, 0, len(hashes) - 1)] == self.hashes[t])
            share = same @ self.weights[t]
            total = int(self.weights[t].sum())
            good = (100 * share >= self.templates[t].share * total) & same[:, self.key[t]].all(axis=1)
            words = [w.encode() for w in self.templates[t].words]
            for i in np.flatnonzero(good).tolist():
                agreed = np.flatnonzero(same[i])
                real = ((joined[starts[j] : ends[j]].lower(), words[k]) for j, k in zip(places[i, agreed], agreed))
                if all(a == b for a, b in real):
                    found[own[i]].append((t, int(begin[i] - first[own[i]]), float(share[i] / total)))
        return np.diff(first), [sorted(f) for f in found]


FOUND = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "places array<struct<label: string, word: long, share: double>>"
)


def scan(docs: DataFrame, text: str, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """All columns of ``docs`` with ``n_words, n_base, first_word, last_word, base_labels, labels, score, places``.

    ``n_base`` counts the places of base templates, ``first_word`` and ``last_word`` are their smallest and largest
    start (words from 0; null without any). ``base_labels`` are the labels of these, ``labels`` those of all
    templates found, distinct, in code point order, joined by commas; ``score`` is the best share of a template found (0
    without any) and ``places`` lists all finds. Columns of these names are replaced.

    Null, empty and wordless texts have no words and no labels. Repeated rows are judged alike, and count as
    documents of their own. An empty table gives an empty result.
    """
    counts = frequencies(docs, text, templates)
    n = docs.count()
    weights = {w: weight(n, k) for w, k in counts.items()}
    added = [c.split()[0] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")]
    rest = [c for c in docs.columns if c not in added]

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(templates, weights)
        for batch in batches:
            data, rows = texts_as_bytes(batch), []
            for low, high in pieces(data):
                for n_words, finds in zip(*index.search(data[low:high])):
                    rows.append(_row(index.templates, int(n_words), finds))
            yield pd.DataFrame(rows, columns=added).astype({"first_word": "Int64", "last_word": "Int64"})

    found = F.pandas_udf(look, FOUND)(F.col(text))
    df = docs.select(F.struct(*rest).alias("doc"), found.alias("found"))
    return df.select("doc.*", "found.*")


def _row(templates: Sequence[Template], n_words: int, finds: list[tuple[int, int, float]]) -> tuple:
    base = [at for t, at, _ in finds if templates[t].base]
    of = lambda keep: ",".join(sorted({templates[t].label for t, _, _ in finds if keep(templates[t])}))
    return (
        n_words,
        len(base),
        min(base, default=None),
        max(base, default=None),
        of(lambda t: t.base),
        of(lambda t: True),
        max((share for _, _, share in finds), default=0.0),
        [{"label": templates[t].label, "word": at, "share": share} for t, at, share in finds],
    )
