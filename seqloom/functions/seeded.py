"""Repeatable randomness: md5 of a seed and the row's own key.

The value depends on the row alone, so a lost task that is run again draws the same numbers.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


def digest(*parts: Column | str | int) -> Column:
    """md5 hex of the parts joined by colons; plain strings and ints are literals."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def draw_int(hex_digest: Column, bound: int) -> Column:
    """An integer in ``[0, bound)`` from the first 32 bits."""
    word = F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")
    return word % F.lit(bound)


def draw_unit(hex_digest: Column) -> Column:
    """A double in ``[0, 1)`` from the first 32 bits."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def prefix_bucket(hex_digest: Column, digits: int = 3) -> Column:
    """One of ``16**digits`` equal slices of the digest range, in digest order."""
    return F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("int")


# A prime below 2**31, so that a residue can be squared in 64 bits.
PRIME = 2_147_483_647


@dataclass(frozen=True)
class Feistel:
    """A permutation of ``0 … n - 1`` as an expression: where an index goes is known without any other row.

    An index is a pair ``(left, right)`` of digits to the base ``side``, and each round turns it into ``(right, left + f(right))``,
    which can be undone whatever ``f`` is. The pairs number ``side ** 2``, a little more than ``n``: a result that is
    too large is permuted again (the walk along its cycle ends at a valid one, at the latest when all
    ``spare`` invalid ones are passed).
    """

    n: int
    rounds: int = 6
    #: Steps of a walk that a plan has room for; each is too large with a chance of ``2 / sqrt(n)``.
    most_steps: int = 40

    def __post_init__(self) -> None:
        if not 1 <= self.n <= 2**61:
            raise ValueError("a permutation has between 1 and 2**61 places")

    @property
    def side(self) -> int:
        return math.isqrt(self.n - 1) + 1

    @property
    def steps(self) -> int:
        return min(self.side**2 - self.n, self.most_steps)

    def keys(self, seed: int, epoch: int) -> list[int]:
        """The constants of the rounds."""
        return [int(hashlib.md5(f"{seed}:{epoch}:{r}".encode()).hexdigest()[:7], 16) for r in range(self.rounds)]

    def _once(self, index: Column, keys: Column) -> Column:
        def turn(x: Column, key: Column) -> Column:
            right, left = x % self.side, F.call_function("div", x, F.lit(self.side))
            residue = (right + key) % PRIME
            return right * self.side + (left + residue * residue % PRIME) % self.side

        return F.aggregate(keys, index, turn)

    def place(self, index: Column, keys: Column) -> Column:
        """Where ``index`` goes by ``keys`` (an array of long)."""
        first = self._once(index.cast("long"), keys)
        if not self.steps:
            return first
        again = lambda x, _: F.when(x < self.n, x).otherwise(self._once(x, keys))
        place = F.aggregate(F.sequence(F.lit(1), F.lit(self.steps)), first, again)
        if self.steps == self.side**2 - self.n:
            return place
        lost = F.raise_error(F.lit("a walk was too long: take another seed")).cast("long")
        return F.when(place < self.n, place).otherwise(lost)
