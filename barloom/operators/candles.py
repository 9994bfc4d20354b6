"""Row-local candle features and patterns. Divisors are the bar's range plus 1e-9; a bar without range gives NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.win import div, flag, lag

EPS = 1e-9


def _range():
    return F.when(F.col("high") != F.col("low"), F.col("high") - F.col("low"))


def candle_shape(df: DataFrame, k: int = 3) -> DataFrame:
    """Body, close position, momentum over ``k`` bars, breakouts, wicks and range features."""
    rng = F.col("_rng") + EPS
    df = df.withColumn("_rng", _range())
    df = df.withColumns(
        {
            "body_size": (F.col("close") - F.col("open")) / rng,
            "close_position": (F.col("close") - F.col("low")) / rng,
            "trend_momentum": (F.col("close") - lag("close", k)) / rng,
            "breakout_high": (F.col("high") - lag("high")) / rng,
            "breakout_low_inv": -(F.col("low") - lag("low")) / rng,
            "upper_wick": (F.col("high") - F.greatest("open", "close")) / rng,
            "lower_wick": (F.least("open", "close") - F.col("low")) / rng,
            "range_percent": F.col("_rng") / (F.col("open") + EPS),
        }
    )
    tilt = F.col("lower_wick") - F.col("upper_wick")
    ratio = tilt / (F.col("lower_wick") + F.col("upper_wick") + EPS)
    return df.withColumns(
        {
            "wick_polarity": F.tanh(tilt),
            "wick_ratio": F.when(ratio.isNotNull(), F.greatest(F.least(ratio, F.lit(10.0)), F.lit(-10.0))),
            "body_vs_range": F.col("body_size") * F.col("range_percent"),
        }
    ).drop("_rng")


SHAPE = ["body_size", "close_position", "trend_momentum", "breakout_high", "breakout_low_inv", "upper_wick", "lower_wick", "wick_polarity", "wick_ratio", "range_percent", "body_vs_range"]


def price_action(df: DataFrame) -> DataFrame:
    """Body and wicks as shares of the range; 0 for a bar without range."""
    rng = F.col("high") - F.col("low")
    zero = lambda x: F.coalesce(div(x, rng), F.lit(0.0))
    return df.withColumns(
        {
            "pa_body": zero(F.col("close") - F.col("open")),
            "pa_upper_wick": zero(F.col("high") - F.greatest("open", "close")),
            "pa_lower_wick": zero(F.least("open", "close") - F.col("low")),
        }
    )


def candle_patterns(df: DataFrame) -> DataFrame:
    """0/1 flags: doji, hammer, shooting star, bullish and bearish engulfing."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    df = df.withColumns({"_body": F.abs(c - o), "_po": lag("open"), "_pc": lag("close")})
    body, po, pc = F.col("_body"), F.col("_po"), F.col("_pc")
    up, down = h - F.greatest(o, c), F.least(o, c) - low
    larger = body > F.abs(pc - po)
    return df.withColumns(
        {
            "doji": flag(body < 0.1 * (h - low)),
            "hammer": flag((down > 2 * body) & (up < 0.5 * body)),
            "shooting_star": flag((up > 2 * body) & (down < 0.5 * body)),
            "bullish_engulfing": flag((c > o) & (pc < po) & larger & (o < pc) & (c > po)),
            "bearish_engulfing": flag((c < o) & (pc > po) & larger & (o > pc) & (c < po)),
        }
    ).drop("_body", "_po", "_pc")


PATTERNS = ["doji", "hammer", "shooting_star", "bullish_engulfing", "bearish_engulfing"]


def finite_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows where every named column is a finite number."""
    for n in names:
        df = df.withColumn(n, F.when(~F.isnan(n) & (F.abs(F.col(n)) != float("inf")), F.col(n)))
    return df.dropna(subset=names)


def hurst_class(h: str = "hurst"):
    """``(code, label, strategy)`` of a Hurst value as a struct; NULL stays NULL."""
    bands = [(0.65, 3, "strong trend", "follow the trend"), (0.55, 2, "mild trend", "follow the trend with care"), (0.45, 1, "random", "stand aside")]
    out = F.struct(F.lit(0).alias("code"), F.lit("mean-reverting").alias("label"), F.lit("fade extremes").alias("strategy"))
    for least, code, label, strategy in reversed(bands):
        out = F.when(F.col(h) > least, F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"), F.lit(strategy).alias("strategy"))).otherwise(out)
    return F.when(F.col(h).isNotNull(), out)


def hurst_band(h: str = "hurst"):
    """Three bands: below 0.45, up to 0.55, above."""
    return F.when(F.col(h) < 0.45, "mean-reverting").when(F.col(h) <= 0.55, "random").when(F.col(h) > 0.55, "trending")
