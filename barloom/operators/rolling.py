"""Rolling features over rows of a symbol."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.win import col, correlation, div, full, lag, last_rows

EPS = 1e-9


def returns(df: DataFrame) -> DataFrame:
    """``ret`` (NULL beside a gap), ``log_return`` (0 where unknown) and ``delta``."""
    c, p = F.col("close"), F.col("_prev")
    df = df.withColumn("_prev", lag("close"))
    log = F.when((c > 0) & (p > 0), F.ln(div(c, p)))
    return df.withColumns({"ret": div(c, p) - 1, "log_return": F.coalesce(log, F.lit(0.0)), "delta": c - p}).drop("_prev")


def true_range(df: DataFrame) -> DataFrame:
    """``tr``; the first row has no close before it and takes high - low."""
    df = df.withColumn("_prev", lag("close"))
    return df.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")), F.abs(F.col("low") - F.col("_prev")))).drop("_prev")


def zscore(x: str | Column, n: int = 20, eps: float = EPS) -> Column:
    return (col(x) - full(F.avg, x, n)) / (full(F.stddev_samp, x, n) + eps)


def bollinger_z(n: int = 20, eps: float | None = 1e-6) -> Column:
    """Distance from the mean in standard deviations; without ``eps`` a flat window gives NULL."""
    gap, sd = F.col("close") - full(F.avg, "close", n), full(F.stddev_samp, "close", n)
    return gap / (sd + eps) if eps is not None else div(gap, F.when(sd > 1e-12, sd))


def basic(df: DataFrame, n: int = 6) -> DataFrame:
    """Mean range, close deviation, mean body and momentum over ``n`` rows; needs ``body_size``."""
    return df.withColumns(
        {
            "roll_range_60": full(F.avg, F.col("high") - F.col("low"), n),
            "roll_vol_60": full(F.stddev_samp, "close", n),
            "roll_body_60": full(F.avg, "body_size", n),
            "roll_momentum_60": F.col("close") - lag("close", n - 1),
        }
    )


BASIC = ["roll_range_60", "roll_vol_60", "roll_body_60", "roll_momentum_60"]


def technicals(df: DataFrame) -> DataFrame:
    """z-scores, true range means, RSI by plain means and place in the range; needs ``roll_vol_60``, ``tr``, ``delta``."""
    up = F.when(F.col("delta").isNotNull(), F.greatest("delta", F.lit(0.0)))
    down = F.when(F.col("delta").isNotNull(), F.greatest(-F.col("delta"), F.lit(0.0)))
    df = df.withColumns({"_up": up, "_down": down})
    lo, hi = full(F.min, "close", 20), full(F.max, "close", 20)
    df = df.withColumns(
        {
            "z_close_20": zscore("close"),
            "z_vol_20": zscore("roll_vol_60"),
            "atr_14": full(F.avg, "tr", 14),
            "rsi_14": 100 - 100 / (1 + full(F.avg, "_up", 14) / (full(F.avg, "_down", 14) + EPS)),
            "roll_min_20": lo,
            "roll_max_20": hi,
            "boll_z": bollinger_z(),
        }
    )
    return df.withColumns(
        {"rel_atr": F.col("atr_14") / (F.col("open") + EPS), "pos_in_roll": (F.col("close") - F.col("roll_min_20")) / (F.col("roll_max_20") - F.col("roll_min_20") + EPS)}
    ).drop("_up", "_down")


TECHNICALS = ["z_close_20", "z_vol_20", "atr_14", "rsi_14", "roll_min_20", "roll_max_20", "boll_z", "rel_atr", "pos_in_roll"]


def momentum(df: DataFrame, k: int = 5, fill: bool = True) -> DataFrame:
    x = F.col("close") - lag("close", k)
    return df.withColumn(f"momentum_{k}", F.coalesce(x, F.lit(0.0)) if fill else x)


def trend_strength(df: DataFrame, n: int = 10) -> DataFrame:
    sd = full(F.stddev_samp, "ret", n)
    return df.withColumn(f"trend_strength_{n}", div(full(F.avg, "ret", n), F.when(sd > 1e-12, sd)))


def vortex(df: DataFrame, n: int = 14) -> DataFrame:
    """``vi_plus``, ``vi_minus`` and ``vi_diff``; needs ``tr``."""
    df = df.withColumns({"_plus": F.abs(F.col("high") - lag("low")), "_minus": F.abs(F.col("low") - lag("high"))})
    total = full(F.sum, "tr", n)
    df = df.withColumns({"vi_plus": div(full(F.sum, "_plus", n), total), "vi_minus": div(full(F.sum, "_minus", n), total)})
    return df.withColumn("vi_diff", F.col("vi_plus") - F.col("vi_minus")).drop("_plus", "_minus")


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    """Typical price against its mean in units of 0.015 standard deviations."""
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    sd = full(F.stddev_samp, "_tp", n)
    return df.withColumn(f"cci_{n}", div(F.col("_tp") - full(F.avg, "_tp", n), 0.015 * F.when(sd > 1e-12, sd))).drop("_tp")


def efficiency(df: DataFrame, n: int) -> DataFrame:
    """Net move over path length; needs ``delta``."""
    return df.withColumn(f"kaufman_er_{n}", F.abs(F.col("close") - lag("close", n)) / (full(F.sum, F.abs(F.col("delta")), n) + EPS))


def risk(df: DataFrame, n: int = 20) -> DataFrame:
    """Sharpe, Sortino, bias-corrected skew and kurtosis, and instability; needs ``ret``."""
    df = df.withColumns({"_loss": F.when(F.col("ret") < 0, F.col("ret")).otherwise(0.0), "_before": lag("ret")})
    mean, sd = full(F.avg, "ret", n), full(F.stddev_samp, "ret", n)
    moves = full(F.stddev_pop, "ret", n) > 1e-12
    skew = F.when(moves, full(F.skewness, "ret", n)) * (math.sqrt(n * (n - 1)) / (n - 2))
    kurt = (F.when(moves, full(F.kurtosis, "ret", n)) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3)))
    w = last_rows(10)
    both = F.count(F.when(F.col("_before").isNotNull(), F.col("ret"))).over(w) == 10
    return df.withColumns(
        {
            "rolling_sharpe": mean / (sd + EPS) * math.sqrt(252),
            "rolling_sortino": mean / (full(F.stddev_samp, "_loss", n) + EPS) * math.sqrt(252),
            "rolling_skew": skew,
            "rolling_kurtosis": kurt,
            "regime_instability": 1 - F.abs(F.when(both, correlation(F.col("ret"), F.col("_before"), w))),
        }
    ).drop("_loss", "_before")


RISK = ["rolling_sharpe", "rolling_sortino", "rolling_skew", "rolling_kurtosis", "regime_instability"]


def energies(df: DataFrame, n: int = 50) -> DataFrame:
    """Mean squared one-step change inside ``n`` rows, and spectral energy, by Parseval ``n`` times the variance."""
    return df.withColumns({"wavelet_energy": full(F.avg, F.col("delta") * F.col("delta"), n - 1), "fft_energy": n * full(F.var_pop, "close", n)})


def hurst_slopes(lags: range) -> list[float]:
    """Coefficients of ``ln s_k`` in the least-squares slope on ``ln k``."""
    x = np.log(np.array(lags, dtype=float))
    x -= x.mean()
    return (x / (x**2).sum()).tolist()


def hurst_lagstd(df: DataFrame, n: int = 20) -> DataFrame:
    """Hurst exponent from the spread of lagged differences at lags 2 to 9 inside ``n`` rows.

    ``s_k`` is the population deviation of ``close - close[k rows before]``; the
    exponent is twice the slope of ``ln sqrt(s_k)``, a fixed combination of ``ln s_k``.
    """
    lags = range(2, 10)
    df = df.withColumns({f"_d{k}": F.col("close") - lag("close", k) for k in lags})
    df = df.withColumns({f"_s{k}": full(F.stddev_pop, f"_d{k}", n - k) for k in lags})
    parts = [F.when(F.col(f"_s{k}") > 1e-12, F.ln(f"_s{k}")) * a for k, a in zip(lags, hurst_slopes(lags), strict=True)]
    return df.withColumn(f"hurst_{n}", sum(parts[1:], parts[0])).drop(*[f"_d{k}" for k in lags], *[f"_s{k}" for k in lags])


def price_position(df: DataFrame, n: int = 20) -> DataFrame:
    """Close in the range of the last ``n`` bars, rounded half-even to four places."""
    lo, hi = full(F.min, "low", n), full(F.max, "high", n)
    return df.withColumn("close_pos", F.bround((F.col("close") - lo) / (hi - lo + EPS), 4))
