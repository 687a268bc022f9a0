"""Hashes of words, shingles and byte windows over whole arrays, for use inside tasks.

A hash of a stretch is a difference of two running sums: with ``S[j] = sum(v[t] * B**t for t < j)``,
modulo 2**64, the stretch ``[i, j)`` has ``(S[j] - S[i]) * B**-i``, which depends on its content
only. All steps are array operations; nothing runs per word or per byte.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``B**t`` and ``B**-t`` for ``t < n``."""
    if len(_POWERS.get("up", ())) < n:
        n = 1 << max(n - 1, 1 << 16).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One random value per byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
FOLDED_VALUES = BYTE_VALUES[_FOLD]
IS_SPACE = np.zeros(256, np.bool_)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def running(values: np.ndarray) -> np.ndarray:
    """``S``, one longer than ``values``."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def stretch(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of ``[starts, ends)``."""
    _, down = powers(len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


def texts_as_bytes(texts) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


#: Anything of ASCII but letters and digits.
IS_PUNCTUATION = np.array([not chr(i).isalnum() and i < 128 for i in range(256)])


def word_spans(
    data: list[bytes], fold: bool = True, separators: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Running sums over all texts, starts and ends of the words, and where each text's words begin (one more at the end)."""
    joined = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    between = separators[joined]
    change = np.flatnonzero(between[1:] != between[:-1]) + 1
    if not between[0]:
        change = np.concatenate(([0], change))
    starts, ends = change[0::2], change[1::2]
    sums = running((FOLDED_VALUES if fold else BYTE_VALUES)[joined])
    lengths = np.array([len(d) + 1 for d in data], np.int64)
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return sums, starts, ends, first


def word_hashes(data: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and where each text's words begin.

    ``fold`` lower-cases A-Z.
    """
    sums, starts, ends, first = word_spans(data, fold)
    return mix(stretch(sums, starts, ends)), first


_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += words[i : n - width + 1 + i] * _PLACES[i]
    return mix(total + np.uint64(width))


def pieces(data: list[bytes], limit: int = 1 << 20):
    """Ranges of consecutive texts of about ``limit`` bytes in all, so that arrays stay small."""
    start, size = 0, 0
    for i, d in enumerate(data):
        if i > start and size + len(d) > limit:
            yield start, i
            start, size = i, 0
        size += len(d) + 1
    if start < len(data):
        yield start, len(data)
