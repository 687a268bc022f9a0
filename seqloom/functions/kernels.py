"""Step functions of the recurrences, shared by the batch scan and the streaming queries.

A kernel has a flat state of fixed size. ``advance`` moves it over consecutive rows of one key.
``summarise`` describes a run of rows without knowing the state before it, and ``compose`` applies
such a description to a state; that is what lets a heavy key be worked on in parallel chunks.
All sums are doubles, whatever the width of the input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def advance_segments(kernel, states, bounds, inputs, out) -> None:
    """Advance one state per segment ``[low, high)`` of the rows, in place."""
    for i, (low, high) in enumerate(bounds):
        if low < high:
            states[i], out[low:high] = kernel.advance(states[i], *[x[low:high] for x in inputs])


class SlowMemory:
    """Normalised cumulative memory: ``sum(phi*v) / max(sum(phi), eps)`` with ``phi = elu(q)+1``."""

    def __init__(self, dim: int, eps: float = 1e-6) -> None:
        self.dim, self.eps = dim, eps
        self.widths = {"q": dim, "v": dim}
        self.state_size = 2 * dim
        self.out_size = dim

    def advance(self, state, q, v):
        phi = np.where(q > 0, q + 1.0, np.exp(np.minimum(q, 0.0)))
        sums = np.vstack([state[None, :], np.hstack([phi * v, phi])]).cumsum(axis=0)[1:]
        return sums[-1], sums[:, : self.dim] / np.maximum(sums[:, self.dim :], self.eps)

    def summarise(self, summary, q, v):
        before = np.zeros(self.state_size) if summary is None else summary
        return self.advance(before, q, v)[0]

    def compose(self, state, summary):
        return state + summary


class CausalFir:
    """Per-channel causal filter ``bias + sum_j w_j x[t-K+1+j]``; the state is the last K-1 rows."""

    def __init__(self, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> None:
        self.weights = np.asarray(weights, dtype=np.float64)
        self.bias = np.asarray(bias, dtype=np.float64)
        if self.weights.ndim != 2 or not len(self.weights):
            raise ValueError("weights must be [kernel][channel] with a positive kernel")
        if self.bias.shape != self.weights.shape[1:]:
            raise ValueError("bias must have one value per channel")
        self.kernel, self.dim = self.weights.shape
        self.widths = {"x": self.dim}
        self.state_size = (self.kernel - 1) * self.dim
        self.out_size = self.dim

    def advance(self, state, x):
        n = len(x)
        history = np.vstack([state.reshape(-1, self.dim), x])
        out = np.broadcast_to(self.bias, (n, self.dim)).copy()
        for j in range(self.kernel):
            out += self.weights[j] * history[j : j + n]
        return history[n:].ravel(), out

    def summarise(self, summary, x):
        seen = x if summary is None else np.vstack([summary.reshape(-1, self.dim), x])
        return seen[max(len(seen) - self.kernel + 1, 0) :].ravel()

    def compose(self, state, summary):
        joined = np.concatenate([state, summary])
        return joined[len(joined) - self.state_size :]


class FastMemory:
    """Decayed associative memory ``S <- g S - e k (k'S) + w k v'``, read as ``q'S`` after it.

    Keys and queries are scaled to unit length. Rows are worked on in blocks of ``BLOCK``. Within a block a row writes
    ``k u'`` with ``u = w v - e S'k``, and ``S`` before it is the decayed sum of the writes so far. So the
    ``u`` of a block solve a unit lower triangular system whose entries are decayed products of keys, and
    its outputs and its last state are matrix products of them. All of that is affine in the state before the
    block and is found for all blocks at once; only one small product per block is done in turn.
    """

    BLOCK = 32

    def __init__(self, rank: int, dim: int) -> None:
        if rank < 1:
            raise ValueError("rank must be positive")
        self.rank, self.dim = rank, dim
        self.widths = {"k": rank, "q": rank, "v": dim, "decay": 0, "erase": 0, "write": 0}
        self.state_size = rank * dim
        self.out_size = dim

    @staticmethod
    def _unit(rows):
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    def _one_by_one(self, state, k, q, v, decay, erase, write):
        """The definition; also for rows that are not finite, which products would spread to the rows before."""
        memory = state.reshape(self.rank, self.dim)
        k, q = self._unit(k), self._unit(q)
        out = np.empty((len(v), self.dim))
        for t in range(len(v)):
            change = write[t] * v[t] - erase[t] * (k[t] @ memory)
            memory = decay[t] * memory + k[t][:, None] * change
            out[t] = q[t] @ memory
        return memory.ravel(), out

    def _in_blocks(self, at, k, q, v, decay, erase, write):
        """For blocks of rows ``at [blocks, BLOCK]`` (-1: none), what they do to any state ``S`` before them.

        The last state is ``A S + B`` and the outputs are ``C S + D``; returns ``A, B, C, D``.
        """
        at = at.T  # rows of a block first, blocks last: every step is an operation on long arrays
        none = at < 0
        k, q, v = (np.where(none[..., None], 0.0, x[at]).transpose(0, 2, 1) for x in (self._unit(k), self._unit(q), v))
        k, q = np.ascontiguousarray(k), np.ascontiguousarray(q)
        decay, erase, write = (np.where(none, rest, x[at]) for x, rest in ((decay, 1.0), (erase, 0.0), (write, 0.0)))
        size, blocks = at.shape
        # Of a row's u, the part that is free of S and the part that multiplies it; likewise of its output.
        u = np.concatenate([write[:, None] * v, erase[:, None] * k], axis=1)
        out = np.zeros_like(u)
        # kept[s]: what is left of the write at row s; since: of the state before the block.
        kept, since = np.zeros((size, blocks)), np.ones(blocks)
        for t in range(size):
            u[t, self.dim :] *= since
            if t:
                lower = kept[:t] * np.einsum("srn,rn->sn", k[:t], k[t]) * erase[t]
                u[t] -= np.einsum("sn,scn->cn", lower, u[:t])
            kept[:t] *= decay[t]
            kept[t] = 1.0
            since = since * decay[t]
            reads = kept[: t + 1] * np.einsum("srn,rn->sn", k[: t + 1], q[t])
            out[t] = np.einsum("sn,scn->cn", reads, u[: t + 1])
            out[t, self.dim :] -= since * q[t]
        last = np.einsum("srn,scn->nrc", kept[:, None] * k, u)
        a = since[:, None, None] * np.eye(self.rank) - last[..., self.dim :]
        out = out.transpose(2, 0, 1)
        return a, last[..., : self.dim], -out[..., self.dim :], np.ascontiguousarray(out[..., : self.dim])

    def _blocks_of(self, low: int, high: int, size: int | None = None):
        size = size or self.BLOCK
        at = np.arange(low, low + -(-(high - low) // size) * size)
        return np.where(at < high, at, -1).reshape(-1, size)

    def advance(self, state, *inputs):
        states, out = state[None, :].copy(), np.empty((len(inputs[2]), self.dim))
        self.advance_segments(states, [(0, len(out))], inputs, out)
        return states[0], out

    def advance_segments(self, states, bounds, inputs, out) -> None:
        """All blocks of all segments at once, then the states from block to block, longest segments first."""
        if not all(np.isfinite(x).all() for x in inputs):
            for i, (low, high) in enumerate(bounds):
                if low < high:
                    states[i], out[low:high] = self._one_by_one(states[i], *[x[low:high] for x in inputs])
            return
        order = sorted((i for i, (low, high) in enumerate(bounds) if low < high), key=lambda i: bounds[i][0] - bounds[i][1])
        if not order:
            return
        # The steps within a block and those from block to block cost alike: few rows, say of a key in a micro-batch, take short blocks.
        size = min(self.BLOCK, math.isqrt(max(high - low for low, high in bounds)))
        pieces = [self._blocks_of(*bounds[i], size) for i in order]
        counts = np.array([len(p) for p in pieces])
        first = np.cumsum(counts) - counts
        at = np.concatenate(pieces)
        a, b, c, d = self._in_blocks(at, *inputs)
        memory = states[order].reshape(len(order), self.rank, self.dim)
        before = np.empty_like(b)
        for j in range(counts[0]):
            n = int(np.searchsorted(-counts, -j, side="left"))
            if n == 1:  # what is left of the longest segment
                one = memory[0]
                for i in range(j, counts[0]):
                    before[i] = one
                    one = a[i] @ one + b[i]
                memory[0] = one
                break
            block = first[:n] + j
            before[block] = memory[:n]
            memory[:n] = a[block] @ memory[:n] + b[block]
        d += c @ before
        states[order] = memory.reshape(len(order), -1)
        out[at[at >= 0]] = d[at >= 0]

    def summarise(self, summary, k, q, v, decay, erase, write):
        r = self.rank
        both = np.hstack([np.eye(r), np.zeros((r, self.dim))])
        if summary is not None:
            both = summary.reshape(r, r + self.dim)
        # Queries play no part in the states.
        a, b, _, _ = self._in_blocks(self._blocks_of(0, len(v)), k, np.zeros_like(k), v, decay, erase, write)
        for i in range(len(a)):
            both = a[i] @ both
            both[:, r:] += b[i]
        return both.ravel()

    def compose(self, state, summary):
        both = summary.reshape(self.rank, self.rank + self.dim)
        moved = both[:, : self.rank] @ state.reshape(self.rank, self.dim) + both[:, self.rank :]
        return moved.ravel()


class CausalAttention:
    """Softmax attention over all rows so far. The state is the rows themselves.

    ``rho`` is a row's importance (1 has no effect). For streams; tables use the tiled operator.
    """

    TILE = 256

    def __init__(self, dim: int, value_dim: int, beta: float = 0.1) -> None:
        self.dim, self.value_dim, self.beta = dim, value_dim, beta
        self.widths = {"q": dim, "k": dim, "v": value_dim, "rho": 0}
        self.state_size = 0
        self.row_size = dim + value_dim + 1
        self.out_size = value_dim

    def advance(self, state, q, k, v, rho):
        cached = state.reshape(-1, self.row_size)
        rows = np.vstack([cached, np.hstack([k, v, rho[:, None]])])
        out = np.empty((len(q), self.value_dim))
        for low in range(0, len(q), self.TILE):
            # A tile of queries and the rows up to its end: the scores held at once are bounded.
            some = q[low : low + self.TILE]
            seen = rows[: len(cached) + low + len(some)]
            keys, values, weight = seen[:, : self.dim], seen[:, self.dim : -1], seen[:, -1]
            scores = some @ keys.T / np.sqrt(self.dim) + self.beta * np.log(np.maximum(weight, 1e-6))
            later = np.arange(len(seen))[None, :] > len(cached) + low + np.arange(len(some))[:, None]
            scores[later] = -np.inf
            probs = np.exp(scores - scores.max(axis=1, keepdims=True))
            out[low : low + self.TILE] = probs @ values / probs.sum(axis=1, keepdims=True)
        return rows.ravel(), out
