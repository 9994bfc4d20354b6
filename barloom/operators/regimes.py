"""Regime summaries: profiles, runs, transitions, returns by state, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.selection import quantiles
from ..functions.stretches import SECONDS, stretch, with_previous
from ..functions.win import KEY, TIME, flag, ordered


def islands(df: DataFrame, label: str, seconds: int = SECONDS) -> DataFrame:
    """``(symbol, label, start, stop, n)``: runs of equal label.

    Runs are found inside stretches of time. Only the first and the last run of
    a stretch can go on in a neighbour, so these alone are merged along a symbol.
    """
    inside = Window.partitionBy(KEY, "_stretch").orderBy(TIME)
    cut = df.select(KEY, TIME, label, stretch(seconds).alias("_stretch"))
    change = flag(~F.col(label).eqNullSafe(F.lag(label).over(inside)) | F.lag(F.lit(1)).over(inside).isNull())
    runs = cut.withColumn("_c", change).withColumn("_run", F.sum("_c").over(inside))
    runs = runs.groupBy(KEY, "_stretch", "_run", label).agg(F.min(TIME).alias("start"), F.max(TIME).alias("stop"), F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("_runs", F.max("_run").over(Window.partitionBy(KEY, "_stretch")))
    edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_runs"))
    along = Window.partitionBy(KEY).orderBy("start")  # two rows of a stretch at most
    goes_on = F.col(label).eqNullSafe(F.lag(label).over(along)) & (F.col("_stretch") != F.lag("_stretch").over(along))
    joined = runs.where(edge).withColumn("_new", 1 - flag(goes_on)).withColumn("_group", F.sum("_new").over(along))
    merged = joined.groupBy(KEY, "_group", label).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"))
    names = [KEY, label, "start", "stop", "n"]
    return runs.where(~edge).select(names).unionByName(merged.select(names))


def transition_counts(df: DataFrame, x: str, by: str = KEY, seconds: int = SECONDS) -> DataFrame:
    """``(by, before, after, n, share)``: how often each value follows each other in a symbol, also as a share of its row."""
    pairs = with_previous(df, {"before": x}, seconds).where("before is not null").select(by, "before", F.col(x).alias("after"))
    counts = pairs.groupBy(by, "before", "after").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by, "before")))


def state_returns(df: DataFrame, state: str, x: str = "fwd") -> DataFrame:
    return df.groupBy(KEY, state).agg(F.avg(x).alias("mean_return"), F.count(x).alias("n"))


def best_worst(means: DataFrame, state: str) -> DataFrame:
    """``(symbol, buy, sell)``: states of highest and lowest mean; ties to the smaller state."""
    known = means.where("mean_return is not null")
    return known.groupBy(KEY).agg(F.max_by(state, F.struct("mean_return", -F.col(state))).alias("buy"), F.min_by(state, F.struct("mean_return", state)).alias("sell"))


def map_states(df: DataFrame, sides: DataFrame, state: str) -> DataFrame:
    """``position`` +1 in the buy state, -1 in the sell state, else 0."""
    joined = df.join(sides, KEY)
    return joined.withColumn("position", flag(F.col(state) == F.col("buy")) - flag((F.col(state) == F.col("sell")) & (F.col("buy") != F.col("sell")))).drop("buy", "sell")


def strategy_return(df: DataFrame, x: str = "fwd") -> DataFrame:
    return df.groupBy(KEY).agg(F.sum(F.col("position") * F.col(x)).alias("total"))


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    known = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    return known.groupBy(KEY).agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, label: str, prediction: str, values: list) -> DataFrame:
    """Counts of label by prediction, one column for each predicted value."""
    wide = df.groupBy(KEY, label).pivot(prediction, values).agg(F.count(F.lit(1)))
    return wide.select(KEY, F.col(label).alias("label"), *[F.coalesce(F.col(str(v)), F.lit(0)).cast("long").alias(f"predicted_{'m' if v < 0 else ''}{abs(v)}") for v in values])


def distribution(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, share)`` over all rows."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("share"))


def latest(df: DataFrame, names: list[str]) -> DataFrame:
    """The last row of each symbol."""
    return df.groupBy(KEY).agg(F.max_by(F.struct(TIME, *names), TIME).alias("r")).select(KEY, "r.*")


def top_rows(df: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` rows of each symbol with the largest value; ties to the earlier row."""
    order = ordered().orderBy(F.desc(by), TIME)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def interpretation() -> Column:
    """First match of five readings of a regime's means against the population's volatility."""
    # fixed values: the limits of the readings
    ret, rsi = F.col("mean_return_60"), F.col("mean_rsi_14")
    return (
        F.when((ret > 0.001) & (rsi < 70), "BUY")
        .when((ret < -0.001) & (rsi > 30), "SELL")
        .when(F.col("mean_roll_vol_60") > F.col("vol_q70"), "high volatility")
        .when(F.abs(ret) < 0.0005, "sideways")
        .otherwise("mixed")
    )


# The features whose means a profile reports.
PROFILE = ("return_60", "return_480", "roll_vol_60", "rsi_14", "rolling_sharpe", "body_vs_range", "wick_polarity")


def profile(df: DataFrame, regime: str, approx: bool = False) -> DataFrame:
    """Per regime: count, means, direction, volatility level and interpretation.

    The population's median and 0.7-quantile of volatility are one row, joined to
    a few groups. They are found by counting, so no task holds all values;
    ``approx`` takes sketches instead.
    """
    shares = {"vol_median": 0.5, "vol_q70": 0.7}
    if approx:
        population = df.agg(*[F.percentile_approx("roll_vol_60", q, 10_000).alias(n) for n, q in shares.items()])
    else:
        population = quantiles(df, [], "roll_vol_60", shares).agg(*[F.max(n).alias(n) for n in shares])  # a row of NULLs without values
    groups = df.groupBy(regime).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in PROFILE])
    out = groups.crossJoin(F.broadcast(population))
    out = out.withColumns(
        {
            "direction": F.when(F.col("mean_return_60") > 0, "up").when(F.col("mean_return_60") < 0, "down").otherwise("flat"),
            "vol_level": F.when(F.col("mean_roll_vol_60") > F.col("vol_median"), "High").otherwise("Low"),
            "reading": interpretation(),
        }
    )
    return out.drop("vol_median", "vol_q70")
