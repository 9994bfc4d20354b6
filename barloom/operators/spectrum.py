"""The discrete Fourier transform of series of any length, in groups of about the square root of their rows.

A length that is no power of two is made one by a chirp: the transform becomes a
convolution of twice the length. That length is split in two factors, so that it
is taken as transforms of columns, turned by twiddle factors, and transforms of
rows. The rows of the product are at once the columns of the way back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.win import KEY

#: Values that a task takes in hand at least: short columns go together.
TILE = 4096


def _factors(n: int) -> tuple[int, int]:
    """Powers of two whose product is at least ``2 n``: the length of columns and their number."""
    bits = max(1, (2 * n - 1).bit_length())
    rows = 1 << (bits + 1) // 2
    return rows, (1 << bits) // rows


def _turn(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """``exp(-2 pi i a b / n)``, with the product taken modulo ``n`` first."""
    return np.exp(-2j * np.pi * (a * b % n) / n)


def _chirp(t: np.ndarray, n: int) -> np.ndarray:
    return np.exp(-1j * np.pi * (t * t % (2 * n)) / n)


def _matrix(pdf: pd.DataFrame, first: int, parts: int, size: int, name: str = "") -> np.ndarray:
    """Values of a tile by part and place; what is missing is 0."""
    out = np.zeros((parts, size), dtype=complex)
    out[pdf["part"].to_numpy(np.int64) - first, pdf["at"].to_numpy(np.int64)] = pdf[f"{name}re"].to_numpy() + 1j * pdf[f"{name}im"].to_numpy()
    return out


def _turned(pdf: pd.DataFrame, part: np.ndarray, size: int, **values: np.ndarray) -> pd.DataFrame:
    """Values of a tile as rows, parts and places changed over for the next step."""
    out = {KEY: pdf[KEY].iloc[0], "n": pdf["n"].iloc[0], "part": np.tile(np.arange(size), len(part)), "at": np.repeat(part, size)}
    for name, v in values.items():
        out |= {f"{name.strip('_')}re": v.real.ravel(), f"{name.strip('_')}im": v.imag.ravel()}
    return pd.DataFrame(out)


def spectrum(df: DataFrame) -> DataFrame:
    """``(symbol, n, bin, size)``: absolute values of the transform of ``df(symbol, n, at, x)``, of bins 0 to ``n / 2``.

    ``at`` counts the ``n`` rows of a symbol from 0 without gaps; NULL counts as 0.
    """
    tile = TILE
    schema = f"{KEY} string, n long, part long, at long, re double, im double"

    def parts_of(pdf: pd.DataFrame, size: int, many: int) -> np.ndarray:
        step = max(1, tile // size)
        first = int(pdf["tile"].iloc[0]) * step
        return np.arange(first, min(first + step, many), dtype=np.int64)

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        rows, width = _factors(n)
        part = parts_of(pdf, rows, width)
        known = pdf[pdf["at"] >= 0]
        at = known["at"].to_numpy(np.int64)
        a = np.zeros((len(part), rows), dtype=complex)
        a[at % width - part[0], at // width] = np.nan_to_num(known["x"].to_numpy(float)) * _chirp(at, n)
        k = np.arange(rows, dtype=np.int64)
        place = k * width + part[:, None]
        far = np.minimum(place, rows * width - place)  # the other side of the convolution goes both ways
        b = np.where(far < n, np.conj(_chirp(far, n)), 0)
        turn = _turn(k, part[:, None], rows * width)
        return _turned(pdf, part, rows, _=np.fft.fft(a) * turn, b=np.fft.fft(b) * turn)

    def rows_and_back(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, width = _factors(int(pdf["n"].iloc[0]))
        part = parts_of(pdf, width, rows)
        a, b = (_matrix(pdf, part[0], len(part), width, name) for name in ("", "b"))
        turn = np.conj(_turn(np.arange(width, dtype=np.int64), part[:, None], rows * width))
        return _turned(pdf, part, width, _=np.fft.ifft(np.fft.fft(a) * np.fft.fft(b)) * turn)

    def bins(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        rows, width = _factors(n)
        part = parts_of(pdf, rows, width)
        size = np.abs(np.fft.ifft(_matrix(pdf, part[0], len(part), rows)))  # the last chirp turns, and does not stretch
        at = part[:, None] + width * np.arange(rows, dtype=np.int64)
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], "n": n, "bin": at[at <= n // 2], "size": size[at <= n // 2]})

    bits = F.length(F.bin(2 * F.col("n") - 1))  # as in _factors
    shift = lambda c: F.pow(F.lit(2.0), c).cast("long")
    sizes = df.select(KEY, "n").distinct().withColumns({"_rows": shift(F.floor((bits + 1) / 2)), "_width": shift(bits - F.floor((bits + 1) / 2))})
    in_tile = lambda size: F.floor(F.col("part") / F.greatest(F.floor(F.lit(tile) / F.col(size)), F.lit(1)))
    keys = [KEY, "n", "tile"]
    # every tile is there, also those without a row of the series
    every = sizes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_width") - 1))).select(KEY, "n", in_tile("_rows").alias("tile"), F.lit(-1).cast("long").alias("at"), F.lit(0.0).alias("x")).distinct()
    data = df.join(sizes, [KEY, "n"]).withColumn("part", F.col("at") % F.col("_width")).select(KEY, "n", in_tile("_rows").alias("tile"), F.col("at").cast("long").alias("at"), "x")
    forth = data.unionByName(every).groupBy(*keys).applyInPandas(columns, schema + ", bre double, bim double")
    back = forth.join(sizes, [KEY, "n"]).withColumn("tile", in_tile("_width")).drop("_rows", "_width").groupBy(*keys).applyInPandas(rows_and_back, schema)
    last = back.join(sizes, [KEY, "n"]).withColumn("tile", in_tile("_rows")).drop("_rows", "_width")
    return last.groupBy(*keys).applyInPandas(bins, f"{KEY} string, n long, bin long, size double")
