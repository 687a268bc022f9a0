"""Expressions over ARRAY<DOUBLE> columns, evaluated inside the row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda re-evaluates whatever it refers to for every element, so a norm or a maximum used
    inside ``transform`` has to be bound to a lambda variable first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def array_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def scale(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x * factor)


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def rms_norm(v: Column, weight: Column | None = None, eps: float = 1e-6) -> Column:
    mean_square = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x) / F.size(v)
    out = let(1.0 / F.sqrt(mean_square + F.lit(eps)), lambda f: scale(v, f))
    return out if weight is None else F.zip_with(out, weight, lambda x, w: x * w)


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    return let(1.0 / F.greatest(norm(v), F.lit(eps)), lambda f: scale(v, f))


def rotary(v: Column, pos: Column, dim: int, theta: float = 10000.0) -> Column:
    """Turn the pairs (0,1), (2,3), … of ``v`` by ``pos * theta**(-2i/dim)``."""
    if dim % 2:
        raise ValueError("rotary needs an even dimension")
    pairs = F.sequence(F.lit(0), F.lit(dim // 2 - 1))

    def turn(i: Column) -> Column:
        angle = pos.cast("double") * F.pow(F.lit(float(theta)), i.cast("double") * F.lit(-2.0 / dim))
        a, b = F.get(v, 2 * i), F.get(v, 2 * i + 1)
        c, s = F.cos(angle), F.sin(angle)
        return F.array(a * c - b * s, a * s + b * c)

    return F.flatten(F.transform(pairs, turn))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def bounded_gate(x: Column, low: float, high: float) -> Column:
    if not 0.0 <= low <= high <= 1.0:
        raise ValueError("gate bounds must satisfy 0 <= low <= high <= 1")
    return F.lit(low) + F.lit(high - low) * sigmoid(x)


def elu1(x: Column) -> Column:
    """``x + 1`` above zero and ``exp(x)`` elsewhere: positive, and 1 at 0."""
    return F.when(x > 0, x + 1.0).otherwise(F.exp(x))


def softmax(scores: Column) -> Column:
    exps = let(F.array_max(scores), lambda top: F.transform(scores, lambda s: F.exp(s - top)))
    return let(exps, lambda es: let(array_sum(es), lambda total: F.transform(es, lambda e: e / total)))


def logsumexp(scores: Column) -> Column:
    return let(
        F.array_max(scores),
        lambda top: top
        + F.ln(F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))),
    )


def importance_bias(rho: Column, beta: float) -> Column:
    return F.lit(beta) * F.ln(F.greatest(rho, F.lit(1e-6)))


def fuse_scales(slow: Column, fast: Column, local: Column, scores: Column, gate: Column) -> Column:
    """Softmax-weighted mean of three equally long vectors, then an elementwise sigmoid gate."""

    def mixed(mix: Column) -> Column:
        a, b, c = F.get(mix, F.lit(0)), F.get(mix, F.lit(1)), F.get(mix, F.lit(2))
        two = F.zip_with(slow, fast, lambda x, y: a * x + b * y)
        return F.zip_with(two, local, lambda x, y: x + c * y)

    return F.zip_with(let(softmax(scores), mixed), gate, lambda x, g: x * sigmoid(g))


def linear(v: Column, weight: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """``weight @ v + bias`` for every row: one matrix product per Arrow batch."""
    matrix = np.asarray(weight, dtype=np.float64)
    shift = np.zeros(matrix.shape[0]) if bias is None else np.asarray(bias, dtype=np.float64)
    if shift.shape != (matrix.shape[0],):
        raise ValueError("bias must have one value per output")

    def apply(rows: pd.Series) -> pd.Series:
        if rows.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(rows.to_list()) @ matrix.T + shift))

    return F.pandas_udf(apply, "array<double>")(v)


def resonance(
    x: Column,
    control: Column,
    u: Sequence[Sequence[Sequence[float]]],
    v: Sequence[Sequence[Sequence[float]]],
    gate: Sequence[Sequence[float]],
) -> Column:
    """Add a gated mixture of low-rank maps to ``x``.

    ``u`` and ``v`` are ``[operators][dim][rank]`` and ``gate`` is ``[operators][control dim]``.
    Gives ``STRUCT<out, gates, delta>``. The weights travel in the task closure, and each
    Arrow batch is three matrix products.
    """
    up, down, g = (np.asarray(w, dtype=np.float64) for w in (u, v, gate))
    n_ops, _, rank = up.shape
    if down.shape != up.shape or g.shape[0] != n_ops:
        raise ValueError("u, v and gate disagree on operators, dimension or rank")

    def apply(xs: pd.Series, controls: pd.Series) -> pd.DataFrame:
        if xs.empty:
            return pd.DataFrame({"out": [], "gates": [], "delta": []})
        rows, ctrl = np.stack(xs.to_list()), np.stack(controls.to_list())
        scores = ctrl @ g.T
        weights = np.exp(scores - scores.max(axis=1, keepdims=True))
        weights /= weights.sum(axis=1, keepdims=True)
        low = np.einsum("nd,odr->nor", rows, down) * weights[:, :, None]
        delta = np.einsum("nor,odr->nd", low, up) / np.sqrt(rank)
        return pd.DataFrame(
            {"out": list(rows + delta), "gates": list(weights), "delta": list(delta)}
        )

    schema = "out array<double>, gates array<double>, delta array<double>"
    return F.pandas_udf(apply, schema)(x, control)


# ------------------------------------------------------------------------- parameters of their own per head

#: What the parameters of all heads may take to be sent to every task.
HEAD_VALUES = 8_000_000


def head_parameters(table: DataFrame, head: str) -> dict[int, dict[str, np.ndarray]]:
    """A table of parameters, one row per head and one column (a number or nested arrays) per parameter, as arrays by head.

    Heads are few; a table of more than ``HEAD_VALUES`` values is an error.
    """
    names = [c for c in table.columns if c != head]
    out, values = {}, 0
    for row in table.toLocalIterator():
        out[row[head]] = {n: np.asarray(row[n], dtype=np.float64) for n in names}
        values += sum(a.size for a in out[row[head]].values())
        if values > HEAD_VALUES:
            raise ValueError(f"the parameters of the heads have more than {HEAD_VALUES} values")
    return out


def per_head(parameters: dict[int, dict[str, np.ndarray]], apply, schema: str):
    """A function of ``(head, vectors…)`` columns: ``apply(parameters, *matrices)`` once per head and Arrow batch.

    ``apply`` gets the rows of one head as matrices and gives one matrix, or a dict of them for a struct. A head
    without parameters is an error.
    """

    def results(heads: pd.Series, columns: tuple) -> dict[str, list]:
        found: dict[str, list] = {}
        for head in heads.unique().tolist():
            if head not in parameters:
                raise ValueError(f"no parameters for head {head}")
            at = np.flatnonzero(heads.to_numpy() == head)
            result = apply(parameters[head], *(np.stack(c.iloc[at].to_list()).astype(np.float64) for c in columns))
            for name, matrix in (result if isinstance(result, dict) else {"": result}).items():
                column = found.setdefault(name, [None] * len(heads))
                for i, row in zip(at.tolist(), matrix):
                    column[i] = row
        return found

    def vector(heads: pd.Series, *columns: pd.Series) -> pd.Series:
        return pd.Series(results(heads, columns).get("", []), dtype=object)

    def struct(heads: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(results(heads, columns) or {f.split()[0]: [] for f in schema.split(", ")})

    return F.pandas_udf(vector if schema.startswith("array<") else struct, schema)


def _softmax_rows(scores: np.ndarray) -> np.ndarray:
    weights = np.exp(scores - scores.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def linear_heads(head: Column, x: Column, parameters) -> Column:
    """``weight @ x + bias`` with the head's own ``weight`` and ``bias``."""
    return per_head(parameters, lambda p, v: v @ p["weight"].T + p["bias"], "array<double>")(head, x)


def resonance_heads(head: Column, x: Column, control: Column, parameters) -> Column:
    """``resonance`` with the head's own ``u``, ``v`` (``[operators][dim][rank]``) and ``gate``."""

    def apply(p, rows, controls):
        weights = _softmax_rows(controls @ p["gate"].T)
        low = np.einsum("nd,odr->nor", rows, p["v"]) * weights[:, :, None]
        delta = np.einsum("nor,odr->nd", low, p["u"]) / np.sqrt(p["u"].shape[2])
        return {"out": rows + delta, "gates": weights, "delta": delta}

    return per_head(parameters, apply, "out array<double>, gates array<double>, delta array<double>")(head, x, control)


def fuse_heads(head: Column, slow: Column, fast: Column, local: Column, x: Column, parameters) -> Column:
    """``fuse_scales`` with scores ``mix @ x`` and gates ``gate @ x`` by the head's own ``mix`` (``[3][dim]``) and ``gate``."""

    def apply(p, a, b, c, v):
        m = _softmax_rows(v @ p["mix"].T)
        mixed = m[:, :1] * a + m[:, 1:2] * b + m[:, 2:] * c
        return mixed / (1.0 + np.exp(-(v @ p["gate"].T)))

    return per_head(parameters, apply, "array<double>")(head, slow, fast, local, x)
