"""Calendar windows, sessions and clock features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.win import KEY, TIME, flag, lag

TINY = 1e-12


def bucket_of(minutes: int) -> Column:
    return F.floor(F.unix_seconds(TIME) / (minutes * 60))


def window_features(df: DataFrame, minutes: int, causal: bool = False) -> DataFrame:
    """Per calendar bucket of ``minutes``: normalised prices, range, position, distances and return.

    Suffix ``_{minutes}``. By default a bucket's extremes include its later rows;
    with ``causal`` only rows up to the current one count.
    """
    m = f"_{minutes}"
    df = df.withColumn("_b", bucket_of(minutes))
    by = Window.partitionBy(KEY, "_b")
    rows = by.orderBy(TIME)
    span = rows.rowsBetween(Window.unboundedPreceding, 0) if causal else by
    new = {}
    for x in ("open", "high", "low", "close"):
        lo, hi = F.min(x).over(span), F.max(x).over(span)
        new[f"{x}_norm{m}"] = (F.col(x) - lo) / (hi - lo + TINY)
    high, low = F.max("high").over(span), F.min("low").over(span)
    new[f"range{m}"] = high - low
    new[f"pos_in{m}"] = (F.row_number().over(rows) - 1) / F.greatest(F.count(F.lit(1)).over(by) - 1, F.lit(1))
    new[f"dist_to_high{m}"] = (high - F.col("close")) / (high - low + TINY)
    new[f"dist_to_low{m}"] = (F.col("close") - low) / (high - low + TINY)
    new[f"is_new_high{m}"] = flag(F.col("close") >= high)
    new[f"is_new_low{m}"] = flag(F.col("close") <= low)
    new[f"return{m}"] = F.try_divide(F.col("close"), F.first("open", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0))) - 1
    return df.withColumns(new).drop("_b")


def window_columns(minutes: int) -> list[str]:
    m = f"_{minutes}"
    return [f"{x}_norm{m}" for x in ("open", "high", "low", "close")] + [x + m for x in ("range", "pos_in", "dist_to_high", "dist_to_low", "is_new_high", "is_new_low", "return")]


def session_stats(df: DataFrame, hours: int = 24, causal: bool = False) -> DataFrame:
    """High, low, open, range of each session, the close's place in it, and breakouts of the row before's session.

    A breakout compares with the previous row's session value, so over whole
    sessions it can only fire on a session's first row.
    """
    df = df.withColumn("_s", F.floor(F.unix_seconds(TIME) / (hours * 3600)))
    by = Window.partitionBy(KEY, "_s")
    rows = by.orderBy(TIME)
    span = rows.rowsBetween(Window.unboundedPreceding, 0) if causal else by
    df = df.withColumns(
        {
            "session_high": F.max("high").over(span),
            "session_low": F.min("low").over(span),
            "session_open": F.first("open", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    df = df.withColumn("session_range", F.col("session_high") - F.col("session_low"))
    return df.withColumns(
        {
            "session_pos": (F.col("close") - F.col("session_low")) / (F.col("session_range") + 1e-9),
            "session_high_break": flag(F.col("close") > lag("session_high")),
            "session_low_break": flag(F.col("close") < lag("session_low")),
        }
    ).drop("_s")


SESSION = ["session_high", "session_low", "session_open", "session_range", "session_pos", "session_high_break", "session_low_break"]


def time_features(df: DataFrame) -> DataFrame:
    """Minute, hour, ten-minute slot of an eight-hour shift, clock angles and ISO week."""
    turn = lambda f, x, n: f(x * (2 * 3.141592653589793 / n))
    df = df.withColumns({"minute": F.minute(TIME), "hour": F.hour(TIME), "iso_week": F.weekofyear(TIME)})
    return df.withColumns(
        {
            "slot": F.floor(((F.col("hour") % 8) * 60 + F.col("minute")) / 10).cast("int"),
            "hour_sin": turn(F.sin, F.col("hour"), 24),
            "hour_cos": turn(F.cos, F.col("hour"), 24),
            "minute_sin": turn(F.sin, F.col("minute"), 60),
            "minute_cos": turn(F.cos, F.col("minute"), 60),
        }
    )


CLOCK = ["minute", "hour", "iso_week", "slot", "hour_sin", "hour_cos", "minute_sin", "minute_cos"]
