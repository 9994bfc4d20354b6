"""Hidden-Markov recursions over long series, as associative scans over stretches of rows.

A step of the forward recursion multiplies by a k x k matrix, and a step of the
best path does so with maxima for sums. Both products are associative: a
stretch of rows has one matrix, from which the state before each stretch is
carried, and the rows of a stretch are then settled by themselves. The same is
done once more inside a stretch, whose pieces numpy takes side by side. So no
task holds more of a series than one stretch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.win import KEY

#: Matrices of stretches that one task chains; longer chains are chained in parts.
FAN = 512

_NEVER = -1e300


def _pieces(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows cut into pieces of about the square root of their number, and which places of these are rows."""
    n, k = values.shape
    size = max(1, int(np.sqrt(n)))
    count = -(-n // size)
    padded = np.zeros((count * size, k))
    padded[:n] = values
    return padded.reshape(count, size, k), (np.arange(count * size) < n).reshape(count, size)


def _products(move: np.ndarray, b: np.ndarray, on: np.ndarray, head: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scaled product of the steps of each piece, and the logarithm of its scale."""
    count, size, k = b.shape
    out, log = np.broadcast_to(np.eye(k), (count, k, k)).copy(), np.zeros(count)
    for s in range(size):
        step = out @ move
        if head and s == 0:
            step[0] = out[0]
        step *= b[:, s, None, :]
        top = step.max(axis=(1, 2))
        live = on[:, s]
        out = np.where(live[:, None, None], step / np.where(live, top, 1)[:, None, None], out)
        log += np.log(np.where(live, top, 1))
    return out, log


def transfer(move: np.ndarray, b: np.ndarray, head: bool) -> np.ndarray:
    """Scaled product of all steps with emissions ``b``; at the head of a series the first step has no move."""
    parts, _ = _products(move, *_pieces(b), head)
    out = parts[0]
    for p in parts[1:]:
        out = out @ p
        out /= out.max()
    return out


def smoothed(move: np.ndarray, b: np.ndarray, head: bool, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``(filtered, posterior, summed moves, log likelihood)`` of rows with emissions ``b``.

    ``before`` holds the probabilities of states ahead of the first row, and
    ``after`` how well each state of the last row goes on.
    """
    n, k = b.shape
    b, on = _pieces(b)
    count, size, _ = b.shape
    parts, _ = _products(move, b, on, head)
    a, ins = before / before.sum(), []
    for p in parts:
        ins.append(a)
        a = a @ p
        a = a / a.sum()
    z, outs = after / after.sum(), []
    for p in parts[::-1]:
        outs.append(z)
        z = p @ z
        z = z / z.sum()
    ins, z = np.array(ins), np.array(outs[::-1])
    alpha, scale, a = np.empty((count, size, k)), np.ones((count, size)), ins
    for s in range(size):
        step = a @ move
        if head and s == 0:
            step[0] = a[0]
        step = step * b[:, s]
        live = on[:, s]
        scale[live, s] = step[live].sum(axis=1)
        a = np.where(live[:, None], step / scale[:, s, None], a)
        alpha[:, s] = a
    gamma, moves = np.empty((count, size, k)), np.zeros((k, k))
    for s in range(size - 1, -1, -1):
        live = on[:, s]
        gamma[:, s] = alpha[:, s] * z
        ahead = np.where(live[:, None], b[:, s] * z, 0.0)
        back = alpha[:, s - 1] if s else ins
        total = np.einsum("ci,ij,cj->c", back, move, ahead)
        if head and s == 0:
            total[0] = 0.0
        share = np.divide(1.0, total, out=np.zeros(count), where=total > 0)
        moves += (back * share[:, None]).T @ ahead * move
        step = ahead @ move.T
        z = np.where(live[:, None], step / np.maximum(step.sum(axis=1, keepdims=True), 1e-300), z)
    gamma = gamma.reshape(-1, k)[:n]
    return alpha.reshape(-1, k)[:n], gamma / gamma.sum(axis=1, keepdims=True), moves, float(np.log(scale).sum())


def _best_products(move: np.ndarray, b: np.ndarray, on: np.ndarray, head: bool) -> np.ndarray:
    count, size, k = b.shape
    out = np.broadcast_to(np.where(np.eye(k) > 0, 0.0, _NEVER), (count, k, k)).copy()
    for s in range(size):
        step = (out[:, :, :, None] + move).max(axis=2)
        if head and s == 0:
            step[0] = out[0]
        out = np.where(on[:, s, None, None], step + b[:, s, None, :], out)
    return out


def best_transfer(move: np.ndarray, b: np.ndarray, head: bool) -> np.ndarray:
    """Score of the best path from each state before the rows to each state of the last; ``move`` and ``b`` are logarithms."""
    parts = _best_products(move, *_pieces(b), head)
    out = parts[0]
    for p in parts[1:]:
        out = (out[:, :, None] + p).max(axis=1)
    return out


def best_path(move: np.ndarray, b: np.ndarray, head: bool, before: np.ndarray, last: int | None) -> np.ndarray:
    """The best path with scores ``before`` ahead of the first row, which ends in ``last``, or in its best state."""
    n, k = b.shape
    b, on = _pieces(b)
    count, size, _ = b.shape
    parts = _best_products(move, b, on, head)
    a, ins = before, []
    for p in parts:
        ins.append(a)
        a = (a[:, None] + p).max(axis=0)
    end = int(a.argmax()) if last is None or last < 0 else last
    ends = np.empty(count, dtype=np.int64)
    for c in range(count - 1, -1, -1):
        ends[c] = end
        end = int((ins[c] + parts[c][:, end]).argmax())
    a, back = np.array(ins), np.tile(np.arange(k), (size, count, 1))
    for s in range(size):
        step = a[:, :, None] + move
        came, step = step.argmax(axis=1), step.max(axis=1)
        if head and s == 0:
            came[0], step[0] = np.arange(k), a[0]
        live = on[:, s, None]
        back[s] = np.where(live, came, back[s])
        a = np.where(live, step + b[:, s], a)
    path, at = np.empty((count, size), dtype=np.int64), ends
    for s in range(size - 1, -1, -1):
        path[:, s] = at
        at = back[s][np.arange(count), at]
    return path.reshape(-1)[:n]


def _walk(pdf: pd.DataFrame, k: int, best: bool) -> tuple[list, list]:
    """What is known before and after each unit of a chain, from what is known before and after all of it."""
    mats = [np.array(m).reshape(k, k) for m in pdf["matrix"]]
    before, after = np.array(pdf["before"].iloc[0]), np.array(pdf["after"].iloc[0])
    ins, outs, a = [], [], before
    for m in mats:
        ins.append(a)
        a = (a[:, None] + m).max(axis=0) if best else a @ m
        a = a if best else a / a.sum()
    if best:  # after: the state the chain ends in, below 0 for its best
        end = int(a.argmax()) if after[0] < 0 else int(after[0])
        for m, i in zip(mats[::-1], ins[::-1], strict=True):
            outs.append(np.array([float(end)]))
            end = int((i + m[:, end]).argmax())
    else:
        z = after
        for m in mats[::-1]:
            outs.append(z)
            z = m @ z
            z = z / z.sum()
    return ins, outs[::-1]


def carries(units: DataFrame, ends: DataFrame, k: int, best: bool = False) -> DataFrame:
    """``(model, symbol, unit, before, after)`` of each unit of ``units(model, symbol, unit, matrix)``.

    ``ends(model, symbol, before, after)`` holds what is known ahead of the
    first unit and behind the last of a series. A series of more than ``FAN``
    units is cut into chains of that many, whose products are chained first.
    """
    keys = ["model", KEY]
    schema = f"model string, {KEY} string, unit long, before array<double>, after array<double>"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        ins, outs = _walk(pdf, k, best)
        return pd.DataFrame({"model": pdf["model"], KEY: pdf[KEY], "unit": pdf["unit"], "before": ins, "after": outs})

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for m in pdf.sort_values("unit")["matrix"]:
            m = np.array(m).reshape(k, k)
            out = m if out is None else (out[:, :, None] + m).max(axis=1) if best else out @ m
            out = out if best else out / out.max()
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], KEY: [pdf[KEY].iloc[0]], "unit": [pdf["chain"].iloc[0]], "matrix": [out.ravel()]})

    if (units.agg(F.max("unit")).first()[0] or 0) < FAN:
        return units.join(ends, keys).groupBy(*keys).applyInPandas(walk, schema)
    cut = units.withColumn("chain", F.floor(F.col("unit") / FAN))
    upper = cut.groupBy(*keys, "chain").applyInPandas(product, f"model string, {KEY} string, unit long, matrix array<double>")
    known = carries(upper, ends, k, best).withColumnRenamed("unit", "chain")
    return cut.join(known, [*keys, "chain"]).groupBy(*keys, "chain").applyInPandas(walk, schema)
