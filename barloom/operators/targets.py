"""Targets, fill rules, splits and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.win import KEY, TIME, div, lag, lead, ordered, whole


def next_close(df: DataFrame) -> DataFrame:
    """``close_next``; each symbol's last row is dropped."""
    return df.withColumn("close_next", lead("close")).where("close_next is not null")


def forward_return(df: DataFrame, h: int, mode: str = "bar_at_h") -> DataFrame:
    """Return ahead: of the one bar ``h`` rows later, or ``cumulative`` over the ``h`` rows."""
    base = lead("close", h - 1) if mode == "bar_at_h" else F.col("close")
    return df.withColumn("fwd", div(lead("close", h), base) - 1)


def direction_label(x: str = "fwd") -> Column:
    """1 above zero, else 0; NULL stays NULL."""
    return F.when(F.col(x) > 0, 1).when(F.col(x).isNotNull(), 0)


def band_label(x: str = "fwd", band: float = 0.002) -> Column:
    return F.when(F.col(x) > band, 1).when(F.col(x) < -band, -1).when(F.col(x).isNotNull(), 0)


# The first rule whose part occurs in a column's name gives its fill value.
FILL_RULES = (
    (("norm", "pos_in", "dist_to"), 0.5),
    (("return", "momentum", "sharpe", "sortino"), 0.0),
    (("rsi",), 50.0),
    (("hurst",), 0.5),
    (("doji", "hammer", "shooting_star", "engulfing", "breakout", "break", "new_high", "new_low"), 0.0),
)


def fill_value(name: str) -> float | None:
    return next((v for parts, v in FILL_RULES if any(p in name for p in parts)), None)


def fill_policy(df: DataFrame, names: list[str]) -> DataFrame:
    """NULLs filled by name; other columns take the last value, else the symbol's first one, else 0.

    The first value comes from a running minimum of (time, value) over the whole
    symbol, not from a frame that looks ahead.
    """
    run = ordered().rowsBetween(Window.unboundedPreceding, 0)
    new = {}
    for n in names:
        value = fill_value(n)
        if value is not None:
            new[n] = F.coalesce(n, F.lit(value).cast(dict(df.dtypes)[n]))
        else:
            first = F.min(F.when(F.col(n).isNotNull(), F.struct(TIME, n))).over(whole())[n]
            new[n] = F.coalesce(n, F.last(n, ignorenulls=True).over(run), first, F.lit(0).cast(dict(df.dtypes)[n]))
    return df.withColumns(new)


def null_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """``(feature, nulls)``: one aggregation, then one row for each column."""
    one = df.agg(*[F.sum(F.col(n).isNull().cast("long")).alias(n) for n in names])
    return one.unpivot([], names, "feature", "nulls")


def chrono_split(df: DataFrame, frac: float = 0.8) -> DataFrame:
    """``is_train``: the first ``floor(n * frac)`` rows of each symbol."""
    at = F.row_number().over(ordered())
    return df.withColumn("is_train", (at <= F.floor(F.count(F.lit(1)).over(whole()) * frac)).cast("int"))


def random_split(df: DataFrame, frac: float = 0.8, seed: int = 42) -> DataFrame:
    """``is_train`` by a hash of the row's key: the same rows on every run and layout."""
    u = F.pmod(F.xxhash64(F.lit(seed), KEY, F.unix_micros(TIME)), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("is_train", (u < frac).cast("int"))


def to_sequences(df: DataFrame, features: list[str], label: str, length: int, stride: int = 1) -> DataFrame:
    """``seq``: the features of the ``length`` rows before each row, oldest first; rows without enough history go."""
    w = ordered().rowsBetween(-length, -1)
    rows = df.withColumns({"seq": F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(w), "_n": F.row_number().over(ordered())})
    return rows.where((F.col("_n") > length) & ((F.col("_n") - 1) % stride == 0)).select(KEY, TIME, "seq", F.col(label).alias("label"))


def require_min_rows(df: DataFrame, n: int) -> DataFrame:
    """Rows of the symbols that have at least ``n``; the counts are joined, not windowed."""
    enough = df.groupBy(KEY).count().where(F.col("count") >= n).select(KEY)
    return df.join(enough, KEY, "left_semi")


def align(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Columns of ``right`` at the rows of ``left`` by (symbol, ts); NULL where it has none."""
    return left.join(right.select(KEY, TIME, *names), [KEY, TIME], "left")


def lagged(df: DataFrame, name: str, k: int = 1) -> DataFrame:
    return df.withColumn(f"{name}_lag{k}", lag(name, k))
