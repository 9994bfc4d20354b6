"""Features that need a whole window of values at once: dominant frequency and rescaled-range Hurst."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from ..functions.stretches import over_windows


def dominant_frequency(df: DataFrame, n: int = 50) -> DataFrame:
    """``fft_dominant_freq``: the strongest bin of 1 to ``n / 2 - 1`` over the last ``n`` closes, divided by ``n``."""

    def strongest(m: np.ndarray) -> np.ndarray:
        size = np.abs(np.fft.rfft(m - m.mean(axis=1, keepdims=True), axis=1))
        return (size[:, 1 : n // 2].argmax(axis=1) + 1) / n

    return over_windows(df, "close", n, strongest, "fft_dominant_freq")


def chunk_sizes(n: int, least: int = 5) -> list[int]:
    """``floor(10 ** x)`` from ``log10(least)`` in steps of a quarter below ``log10(n - 1)``, and ``n``."""
    out, x = [], math.log10(least)
    while x < math.log10(n - 1):
        out.append(int(10**x + 1e-9))
        x += 0.25
    return sorted(set(out) | {n})


def rescaled_range(series: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Hurst exponents of the rows of a matrix by the log-log slope of mean R/S on chunk size."""
    xs, ys = [], []
    for size in sizes:
        k = series.shape[1] // size
        chunks = series[:, : k * size].reshape(len(series), k, size)
        steps = np.diff(chunks, axis=2)
        spread = steps.std(axis=2, ddof=1) if size > 2 else np.zeros(chunks.shape[:2])
        reach = chunks.max(axis=2) - chunks.min(axis=2)
        ok = (spread > 0) & (reach > 0)
        rs = np.where(ok, reach / np.where(ok, spread, 1), 0).sum(axis=1) / np.maximum(ok.sum(axis=1), 1)
        xs.append(np.full(len(series), math.log10(size)))
        ys.append(np.log10(np.where(rs > 0, rs, np.nan)))
    x, y = np.stack(xs, axis=1), np.stack(ys, axis=1)
    known = ~np.isnan(y)
    count = np.maximum(known.sum(axis=1), 1)
    mx, my = np.where(known, x, 0).sum(axis=1) / count, np.where(known, y, 0).sum(axis=1) / count
    dx = np.where(known, x - mx[:, None], 0)
    top, base = (dx * np.where(known, y - my[:, None], 0)).sum(axis=1), (dx**2).sum(axis=1)
    return np.clip(np.where(base > 0, top / np.where(base > 0, base, 1), np.nan), 0, 1)


def hurst_rs(df: DataFrame, n: int = 100) -> DataFrame:
    """``hurst_rs`` from the ``n`` closes before each row; NULL where one is missing."""
    sizes = chunk_sizes(n)
    return over_windows(df, "close", n, lambda m: rescaled_range(m, sizes), "hurst_rs", before=1)
