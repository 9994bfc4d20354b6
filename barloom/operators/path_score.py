"""Path-of-least-resistance scores: momentum, efficiency and resistance over short windows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stretches import with_previous
from ..functions.win import KEY, TIME, div, full, lag, ordered

# Fixed values: (alpha, beta, gamma, threshold) of each regime.
REGIME_PARAMS = {"trending": (0.5, 0.4, 0.1, 1.2), "reversal": (0.3, 0.3, 0.4, 1.8), "neutral": (0.4, 0.4, 0.2, 1.5)}


def components(df: DataFrame, length: int = 3) -> DataFrame:
    """``momentum``, ``efficiency``, ``net``, ``resistance`` and ``volatility`` of the last ``length + 1`` closes."""
    raw = [1 + (k / (length - 1) if length > 1 else 0) for k in range(length)]
    weights = [w / sum(raw) for w in raw]
    df = df.withColumns({"_d": F.col("close") - lag("close"), "_r": div(F.col("close"), lag("close")) - 1})
    steps = [lag("_d", length - 1 - k) for k in range(length)]
    path = full(F.sum, F.abs(F.col("_d")), length)
    net = F.col("close") - lag("close", length)
    rng = F.col("high") - F.col("low")
    flat = F.when(full(F.count, "_d", length).isNotNull(), F.lit(1.0))
    return df.withColumns(
        {
            "momentum": sum((w * s for w, s in zip(weights[1:], steps[1:], strict=True)), weights[0] * steps[0]),
            "net": net,
            "efficiency": F.when(path > 0, F.abs(net) / path).otherwise(flat),
            "resistance": F.coalesce(div(rng - F.abs(F.col("close") - F.col("open")), rng), F.lit(0.0)),
            "volatility": F.greatest(full(F.stddev_pop, "_r", length), F.lit(0.001)),
        }
    ).drop("_d", "_r").withColumn("volatility", F.when(F.col("net").isNotNull(), F.col("volatility")))


def score(alpha: Column, beta: Column, gamma: Column) -> Column:
    """Weighted components over volatility."""
    plr = alpha * F.col("momentum") + beta * F.signum("net") * F.col("efficiency") - gamma * F.col("resistance")
    return plr / F.col("volatility")


def regimes(df: DataFrame, length: int = 3) -> DataFrame:
    """``(symbol, regime)`` from each symbol's last rows: trending, reversal or neutral."""
    last = df.withColumn("_n", F.row_number().over(ordered().orderBy(F.desc(TIME)))).where(F.col("_n") <= length + 2)
    rows = last.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(TIME, "close"))).alias("r"))
    closes = F.transform("r", lambda r: r["close"])
    df = rows.select(KEY, closes.alias("c")).withColumn("n", F.size("c"))
    df = df.withColumn("w", F.least(F.col("n") - 1, F.lit(length))).withColumn("s", F.greatest(F.lit(2), F.floor(F.col("w") / 2).cast("int")))
    df = df.where("w >= s")
    diffs = F.zip_with(F.slice("c", F.lit(2), F.col("n") - 1), F.slice("c", F.lit(1), F.col("n") - 1), lambda b, a: b - a)
    df = df.withColumn("d", diffs).withColumns({"dw": F.slice("d", -F.col("w"), F.col("w")), "ds": F.slice("d", -F.col("s"), F.col("s")), "d3": F.slice("d", F.greatest(-F.lit(3), -F.size("d")), F.lit(3))})
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    path = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + F.abs(y))
    df = df.withColumns({"m_s": total("ds"), "m_w": total("dw"), "p_s": path("ds"), "p_w": path("dw")})
    df = df.withColumn("mean", F.col("m_w") / F.col("w"))
    df = df.withColumn("sd", F.sqrt(F.aggregate("dw", F.lit(0.0), lambda x, y: x + (y - F.col("mean")) * (y - F.col("mean"))) / F.col("w")))
    z = lambda m, k: F.coalesce(div(F.col(m), F.col("sd") * F.sqrt(k)), F.lit(0.0))
    e = lambda m, p: F.coalesce(div(F.abs(m), F.col(p)), F.lit(1.0))
    df = df.withColumns({"z_s": z("m_s", "s"), "z_w": z("m_w", "w"), "e_s": e("m_s", "p_s"), "e_w": e("m_w", "p_w")})
    steady = F.size(F.array_distinct(F.transform("d3", F.signum))) == 1
    same = F.signum("m_s") == F.signum("m_w")
    trend = same & (F.abs("z_w") > 1) & (((F.col("e_s") > 0.7) & (F.col("e_w") > 0.6)) | steady)
    turn = ~same & (F.abs("z_s") > 1.2) & (F.col("e_s") < 0.5)
    return df.select(KEY, F.when(trend, "trending").when(turn, "reversal").otherwise("neutral").alias("regime"))


def regime_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in REGIME_PARAMS.items()], "regime string, alpha double, beta double, gamma double, threshold double")


def grid(spark: SparkSession) -> DataFrame:
    """Weights in tenths that are positive and sum to one: 36 points."""
    points = [(i, j, 10 - i - j) for i in range(1, 9) for j in range(1, 10 - i)]
    return spark.createDataFrame([(n, i / 10, j / 10, k / 10) for n, (i, j, k) in enumerate(points)], "grid_id int, alpha double, beta double, gamma double")


def optimise(df: DataFrame, regime: DataFrame, min_rows: int) -> DataFrame:
    """``(symbol, alpha, beta, gamma, accuracy)``: the grid point whose score's sign most often equals the next return's.

    Components are computed once; the grid is a constant of 36 rows, and its sums
    combine before the shuffle. Ties: nearest to the regime's own weights, then
    lexicographic. Symbols with fewer than ``min_rows`` rows are left out.
    """
    spark = df.sparkSession
    rows = df.withColumn("_next", F.signum(div(F.lead("close").over(ordered()), F.col("close")) - 1)).where("_next is not null and momentum is not null")
    tried = rows.crossJoin(F.broadcast(grid(spark)))
    hit = (F.signum(score(F.col("alpha"), F.col("beta"), F.col("gamma"))) == F.col("_next")).cast("int")
    scored = tried.groupBy(KEY, "alpha", "beta", "gamma").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    own = regime.join(regime_params(spark), "regime").select(KEY, F.col("alpha").alias("a0"), F.col("beta").alias("b0"), F.col("gamma").alias("g0"))
    far = F.round(F.pow(F.col("alpha") - F.col("a0"), 2) + F.pow(F.col("beta") - F.col("b0"), 2) + F.pow(F.col("gamma") - F.col("g0"), 2), 9)
    order = F.struct(-F.col("hits"), far, "alpha", "beta", "gamma")
    counts = df.groupBy(KEY).count().where(F.col("count") >= min_rows).select(KEY)
    best = scored.join(own, KEY).join(counts, KEY, "left_semi").groupBy(KEY).agg(F.min_by(F.struct("alpha", "beta", "gamma", "hits", "n"), order).alias("b"))
    return best.select(KEY, "b.alpha", "b.beta", "b.gamma", (F.col("b.hits") / F.col("b.n")).alias("accuracy"))


def signals(df: DataFrame, x: str = "plr", threshold: str | float = 1.5) -> DataFrame:
    """``z`` over the whole series, ``signal`` and ``strength`` (0 to 100).

    Mean and deviation come from an aggregation joined back, so no task holds a
    whole symbol.
    """
    stats = df.groupBy(KEY).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    edge = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    df = df.join(stats, KEY).withColumn("z", (F.col(x) - F.col("_m")) / F.when(F.col("_s") > 1e-12, F.col("_s")).otherwise(1.0))
    side = F.when(F.col("z") > edge, "LONG").when(F.col("z") < -edge, "SHORT").otherwise("NEUTRAL")
    return df.withColumns({"signal": side, "strength": F.when(F.col("z").isNotNull(), F.least(F.abs("z") / 3 * 100, F.lit(100.0)))}).drop("_m", "_s")


def t_tail(t: float, df: int) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x in (0.0, 1.0):
        return x

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def confidence(df: DataFrame, regime: DataFrame, x: str = "plr") -> DataFrame:
    """``df`` with ``confidence``, 0 to 100, from significance, strength, regime and consistency of each row's score.

    ``df`` has ``plr``, ``z``, ``signal`` and ``strength``. Significance is a one-sample
    t-test of a symbol's scores against zero, on one aggregated row for each
    symbol. A regime adds trust to a trade along a trend, or against the score
    in a reversal; a score is consistent when its sign is that of the row before.
    Rows without a score have none.
    """

    @F.pandas_udf("double")
    def p_value(n: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([0.5 if k < 5 or not sd or sd != sd else t_tail(mean / (sd / math.sqrt(k)), k - 1) for k, mean, sd in zip(n, m, s, strict=True)], dtype=float)

    stats = df.groupBy(KEY).agg(F.count(x).alias("_n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    stats = stats.join(regime.select(KEY, F.col("regime").alias("_regime")), KEY).select(KEY, "_regime", p_value("_n", "_m", "_s").alias("_p"))
    rows = df.withColumn("_before", F.signum(lag(x))).join(stats, KEY)
    along = ((F.col("signal") == "LONG") & (F.col("z") > 0)) | ((F.col("signal") == "SHORT") & (F.col("z") < 0))
    against = ((F.col("signal") == "LONG") & (F.col("z") < 0)) | ((F.col("signal") == "SHORT") & (F.col("z") > 0))
    trust = F.when(((F.col("_regime") == "trending") & along) | ((F.col("_regime") == "reversal") & against), 0.8).otherwise(0.5)
    steady = F.when(F.col("_before").isNull(), 0.5).when(F.col("_before") == F.signum(x), 0.7).otherwise(0.3)
    points = 100 * (0.3 * (1 - F.col("_p")) + 0.4 * F.col("strength") / 100 + 0.2 * trust + 0.1 * steady)
    return rows.withColumn("confidence", F.when(F.col(x).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), points)))).drop("_before", "_regime", "_p")


def signal_entries(df: DataFrame, signal: str = "signal") -> DataFrame:
    """Rows where a LONG or SHORT begins."""
    rows = with_previous(df, {"_prior": signal})
    return rows.where(F.col(signal).isin("LONG", "SHORT") & (F.col("_prior").isNull() | (F.col("_prior") != F.col(signal)))).drop("_prior", "_first")
