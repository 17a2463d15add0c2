"""Recursive series: y = a * y_before + b for each row of a key, in time order.

Exponential averages and Wilder's averages are of this form, with a and b as columns; a
`Mixed` step takes its b from earlier steps' values of the same row, as an average of the
difference of two averages does. Rows are steps of an affine map; maps compose, so that a
chunk's rows are folded in a logarithmic number of passes over arrays, each joining every
row's map with that of 1, 2, 4, ... rows before it. A key's chunks are first reduced, in
parallel, to one map each; the few maps of a key are composed in the same way, and each chunk is then
folded from what comes before it. Keys of one chunk skip the first two steps.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

CHUNK = 8192


@dataclass
class Mixed:
    """y = a * y_before + c * sum(weight * value of that step in this row)."""

    a: Column
    c: Column
    weights: Mapping[str, float]


Step = tuple[Column, Column] | Mixed


def fold(a: np.ndarray, b: np.ndarray, y: float = 0.0) -> np.ndarray:
    """All values of y = a * y + b. NaN in b gives NaN, and the series starts anew after it.

    The series is taken relative to the first value that it starts with, so that one which
    stays there is exact, whatever the order of the sums.
    """
    known = ~np.isnan(b)
    a, b = np.where(known, a, 0.0), np.where(known, b, 0.0)
    if len(a) > 1:
        a[1:][~known[:-1]] = 0.0
    if len(a):
        b[0] += a[0] * (0.0 if y != y else y)
        a[0] = 0.0
    starts = np.flatnonzero(known & (a == 0.0))
    base = b[starts[0]] if len(starts) else 0.0
    b -= (1 - a) * base
    s = 1
    while s < len(a):
        b[s:] += a[s:] * b[:-s]
        a[s:] *= a[:-s]
        s *= 2
    return np.where(known, b + base, np.nan)


def _compose(m: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The state ahead of each map x -> m x + k, from 0: maps [n, d, d] and [n, d]."""
    m, k, s = m.copy(), k.copy(), 1
    while s < len(m):
        k[s:] += np.einsum("nij,nj->ni", m[s:], k[:-s])
        m[s:] = m[s:] @ m[:-s]
        s *= 2
    return np.concatenate([np.zeros((1, k.shape[1])), k[:-1]])


class _Steps:
    """The steps as arrays of a chunk: values from a state, and the chunk's map of states."""

    def __init__(self, steps: Mapping[str, Step]):
        self.outs = list(steps)
        self.weights = [{self.outs.index(n): w for n, w in s.weights.items()} if isinstance(s, Mixed) else None for s in steps.values()]

    def values(self, t: pa.Table, state: np.ndarray, *, linear: bool = False) -> list[np.ndarray]:
        """Values of each step from the state before the chunk; with `linear`, what the state adds
        to them, which is theirs without their own b."""
        out: list[np.ndarray] = []
        for i, weights in enumerate(self.weights):
            a, b = _column(t, f"_a{i}"), _column(t, f"_b{i}")
            if weights is not None:
                b = b * sum(w * out[j] for j, w in weights.items())
            elif linear:
                b = b * 0.0  # unknown ones stay unknown
            out.append(fold(a, b, state[i]))
        return out

    def reduced(self, t: pa.Table) -> tuple[list[float], list[float]]:
        """The map of the state ahead to the state behind, by rows; unknown values count as 0, as
        the series starts anew after them."""
        d = len(self.outs)
        end = lambda state, linear: [0.0 if v[-1] != v[-1] else float(v[-1]) for v in self.values(t, state, linear=linear)]
        columns = [end(np.eye(d)[j], True) for j in range(d)]
        return [columns[j][i] for i in range(d) for j in range(d)], end(np.zeros(d), False)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(t.column(name).cast(pa.float64()), float("nan")).to_numpy()


def affine_scan(df: DataFrame, steps: Mapping[str, Step], *, key: str = "ticker", ts: str = "date", chunk: int = CHUNK) -> DataFrame:
    """df with a column for each step, (a, b) or Mixed. A null b (or c, or value that is mixed)
    gives null, and the series starts anew after it. Rows of one key need different times.
    All steps are folded in one pass over the rows."""
    plan, given = _Steps(steps), df.columns
    order = Window.partitionBy(key).orderBy(ts)
    rows = df
    for i, s in enumerate(steps.values()):
        rows = rows.withColumns({f"_a{i}": s.a if isinstance(s, Mixed) else s[0], f"_b{i}": s.c if isinstance(s, Mixed) else s[1]})
    rows = rows.withColumns({"_chunk": F.floor((F.row_number().over(order) - 1) / chunk).cast("int"), "_long": F.count(F.lit(1)).over(Window.partitionBy(key)) > chunk})
    kind, numbers = df.schema[key].dataType, ArrayType(DoubleType())

    def sorted_by(t: pa.Table, name: str) -> pa.Table:
        return t.take(pc.sort_indices(t, [(name, "ascending")]))

    def reduce(t: pa.Table) -> pa.Table:
        t = sorted_by(t, ts)
        m, k = plan.reduced(t)
        return pa.table({key: t.column(key)[:1], "_chunk": t.column("_chunk")[:1], "_m": pa.array([m], pa.list_(pa.float64())), "_k": pa.array([k], pa.list_(pa.float64()))})

    def carry(t: pa.Table) -> pa.Table:
        t, d = sorted_by(t, "_chunk"), len(plan.outs)
        ahead = _compose(np.array(t.column("_m").to_pylist()).reshape(-1, d, d), np.array(t.column("_k").to_pylist()))
        return pa.table({key: t.column(key), "_chunk": t.column("_chunk"), "_state": pa.array(ahead.tolist(), pa.list_(pa.float64()))})

    def refold(t: pa.Table) -> pa.Table:
        t = sorted_by(t, ts)
        state = t.column("_state")[0].as_py()
        got = t.select(given)
        for name, y in zip(plan.outs, plan.values(t, np.array(state) if state else np.zeros(len(plan.outs)))):
            got = got.append_column(name, pa.array(y, from_pandas=True))
        return got

    place = [StructField(key, kind), rows.schema["_chunk"]]
    maps = rows.where("_long").groupBy(key, "_chunk").applyInArrow(reduce, StructType(place + [StructField("_m", numbers), StructField("_k", numbers)]))
    states = maps.groupBy(key).applyInArrow(carry, StructType(place + [StructField("_state", numbers)]))
    held = rows.join(states, [key, "_chunk"], "left")
    return held.groupBy(key, "_chunk").applyInArrow(refold, StructType(df.schema.fields + [StructField(o, DoubleType()) for o in plan.outs]))


def ema_step(value: Column, n: int, rank: Column, first: int = 1) -> tuple[Column, Column]:
    """Exponential average of span n that starts with the value of row `first`."""
    alpha = 2.0 / (n + 1)
    return F.when(rank == first, 0.0).otherwise(1 - alpha), F.when(rank == first, value).when(rank > first, alpha * value)


def mixed_ema_step(weights: Mapping[str, float], n: int, rank: Column, first: int = 1) -> Mixed:
    """Exponential average of span n over a mix of earlier steps, from row `first` on."""
    alpha = 2.0 / (n + 1)
    return Mixed(F.when(rank == first, 0.0).otherwise(1 - alpha), F.when(rank == first, 1.0).when(rank > first, alpha), weights)


def wilder_step(value: Column, seed: Column, n: int, rank: Column, first: int) -> tuple[Column, Column]:
    """Wilder's average that starts with `seed` on row `first`."""
    return F.when(rank == first, 0.0).otherwise((n - 1) / n), F.when(rank == first, seed).when(rank > first, value / n)
