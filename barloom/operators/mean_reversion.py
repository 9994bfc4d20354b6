"""Ornstein-Uhlenbeck fit and signals on a rolling window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.win import div, flag, lag, last_rows


def ou_fit(df: DataFrame, x: str = "close_pos", n: int = 20) -> DataFrame:
    """``mu``, ``theta``, ``sigma`` from the ``n - 1`` pairs (value before, value) of the last ``n`` rows.

    The maximum-likelihood closed form over sums of products. NULL where a window
    is short, the fit has no mean reversion, or the residual variance is nil.
    """
    if n < 4:
        raise ValueError("two parameters need at least four rows")
    df = df.withColumn("_x", lag(x))
    pair = F.col("_x").isNotNull() & F.col(x).isNotNull()
    a, b = F.when(pair, F.col("_x")), F.when(pair, F.col(x))
    w = last_rows(n - 1)
    sums = {"_sx": a, "_sy": b, "_sxx": a * a, "_syy": b * b, "_sxy": a * b}
    df = df.withColumns({k: F.sum(v).over(w) for k, v in sums.items()} | {"_n": F.count(a).over(w)})
    full = F.col("_n") == n - 1
    big = F.col("_n").cast("double")
    sx, sy, sxx, syy, sxy = (F.col(k) for k in sums)
    mu = F.when(full, div(sy * sxx - sx * sxy, big * (sxx - sxy) - (sx * sx - sx * sy)))
    df = df.withColumn("mu", mu)
    m = F.col("mu")
    ratio = div(sxy - m * sx - m * sy + big * m * m, sxx - 2 * m * sx + big * m * m)
    df = df.withColumn("_q", F.when(ratio > 0, ratio)).withColumn("theta", -F.ln("_q"))
    q = F.col("_q")
    v = (syy - 2 * q * sxy + q * q * sxx - 2 * m * (1 - q) * (sy - q * sx) + big * m * m * (1 - q) * (1 - q)) / big
    inner = div(v * 2 * F.col("theta"), 1 - q * q)
    df = df.withColumn("_v", v).withColumn("_s", F.when((F.col("_v") > 1e-10) & (F.abs(q - 1) > 1e-9), inner))
    return df.withColumn("sigma", F.when(F.col("_s") > 1e-10, F.sqrt("_s"))).drop("_x", *sums, "_n", "_q", "_v", "_s")


def ou_signal(df: DataFrame, x: str = "close_pos", threshold: float = 1.5) -> DataFrame:
    """``z``, ``signal`` (-1 above, +1 below the band, else 0, also where z is unknown) and ``trade``, its change."""
    df = df.withColumn("z", div(F.col(x) - F.col("mu"), F.col("sigma")))
    df = df.withColumn("signal", flag(F.col("z") < -threshold) - flag(F.col("z") > threshold))
    return df.withColumn("trade", F.col("signal") - lag("signal"))


def signal_flips(df: DataFrame) -> DataFrame:
    """Rows where the position turns over from one side to the other."""
    return df.where(F.abs("trade") == 2)
