"""Adaptive observation weights per series: time, magnitude and local-change components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import in_blocks, number_rows
from ..functions.selection import quantiles
from ..functions.stretches import with_previous
from ..functions.tables import written
from ..functions.win import KEY, TIME, correlation, lag, last_rows
from .scan import varying_scan
from .spectrum import spectrum

TINY = 1e-10


def with_returns(df: DataFrame) -> DataFrame:
    """``w_ret``: change over the close before plus 1e-10, 0 on the first row; ``idx`` and ``n`` of the series."""
    df = number_rows(df) if "idx" not in df.columns else df
    counts = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    rows = with_previous(df.join(counts, KEY), {"_was": "close"})
    return rows.withColumn("w_ret", F.coalesce((F.col("close") - F.col("_was")) / (F.col("_was") + TINY), F.lit(0.0))).drop("_was", "_first")


def return_weights(df: DataFrame, power: float = 1.5) -> DataFrame:
    """``return_weight``: powers of absolute returns, normalised; uniform when all are zero."""
    raw = df.withColumn("_w", F.pow(F.abs("w_ret"), F.lit(power)))
    total = raw.groupBy(KEY).agg(F.sum("_w").alias("_t"))
    out = F.when((F.col("_t") > 0) & (F.col("n") > 1), F.col("_w") / F.col("_t")).otherwise(F.lit(1.0) / F.col("n"))
    return raw.join(total, KEY).withColumn("return_weight", out).drop("_w", "_t")


def series_stats(df: DataFrame) -> DataFrame:
    """One row for each symbol: autocorrelation, volatility clustering, robust deviation, outliers, Hurst exponent.

    ``df`` comes from :func:`with_returns`. The deviation is MAD / 0.6745, of
    medians found by counting. Degenerate series: correlations 0, no outliers,
    Hurst 0.5.
    """
    known = df.where("idx > 0")
    pair = with_previous(df, {"_prev": "close", "_pr": "w_ret"}).withColumn("_pa", F.when(F.col("idx") > 1, F.abs("_pr")))
    base = pair.groupBy(KEY).agg(
        F.max("n").alias("n"),
        F.coalesce(correlation(F.col("close"), F.col("_prev")), F.lit(0.0)).alias("autocorr"),
        F.coalesce(correlation(F.abs("w_ret"), F.col("_pa")), F.lit(0.0)).alias("vol_cluster"),
    )
    median = quantiles(known, [KEY], "w_ret", {"_med": 0.5})
    mad = quantiles(known.join(median, KEY), [KEY], F.abs(F.col("w_ret") - F.col("_med")), {"robust": 0.5}).withColumn("robust", F.col("robust") / 0.6745)
    outliers = known.join(mad, KEY).groupBy(KEY).agg(F.sum(((F.col("robust") > 0) & (F.abs("w_ret") > 3 * F.col("robust"))).cast("long")).alias("outliers"))
    return base.join(mad, KEY, "left").join(outliers, KEY, "left").join(series_hurst(df), KEY, "left")


def series_hurst(df: DataFrame, scale: float = 0.5) -> DataFrame:
    """``(symbol, hurst)``: slope of ``ln sqrt(s_k)`` on ``ln k`` over lags 2 to ``min(11, n / 2) - 1``, times ``scale``; 0.5 where undefined."""
    lags = range(2, 11)
    gaps = lambda d: d.withColumns({f"_d{k}": F.col("close") - lag("close", k) for k in lags})
    wide = in_blocks(df.select(KEY, TIME, "close", "n"), gaps, look_back=max(lags))
    s = wide.groupBy(KEY).agg(F.max("n").alias("n"), *[F.stddev_pop(f"_d{k}").alias(f"_s{k}") for k in lags])
    points = F.array(*[F.struct(F.lit(float(np.log(k))).alias("x"), F.when(F.col(f"_s{k}") > 1e-12, F.ln(f"_s{k}") / 2).alias("y")) for k in lags])
    used = F.slice(points, F.lit(1), F.greatest(F.least(F.lit(11), F.floor(F.col("n") / 2).cast("int")) - 2, F.lit(0)))
    s = s.select(KEY, "n", used.alias("p")).withColumn("m", F.size("p").cast("double"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda acc, q: acc + f(q))
    s = s.withColumns({"sx": total(lambda q: q["x"]), "sy": total(lambda q: q["y"]), "sxx": total(lambda q: q["x"] * q["x"]), "sxy": total(lambda q: q["x"] * q["y"])})
    slope = F.try_divide(F.col("m") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("m") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return s.select(KEY, F.coalesce(F.when((F.col("n") >= 10) & (F.col("m") >= 2), slope * scale), F.lit(0.5)).alias("hurst"))


def dominant_cycle(df: DataFrame) -> DataFrame:
    """``(symbol, cycle, cyclicality)`` from the spectrum of returns: the strongest bin past 0, and the largest share.

    The transform is taken in groups of a part of a series (:mod:`.spectrum`).
    Series under 8 rows have cycle 1 and cyclicality 0.
    """
    every = df.select(KEY).distinct()
    known = df.where("idx > 0 and n >= 8").select(KEY, (F.col("n") - 1).alias("n"), (F.col("idx") - 1).alias("at"), F.col("w_ret").alias("x"))
    size = F.col("size")
    best = F.max_by("bin", F.when(F.col("bin") > 0, F.struct("size", -F.col("bin"))))
    found = spectrum(known).groupBy(KEY).agg(best.alias("cycle"), (F.max(size) / (F.sum(size) + TINY)).alias("cyclicality"))
    return every.join(found, KEY, "left").select(KEY, F.coalesce("cycle", F.lit(1)).cast("int").alias("cycle"), F.coalesce("cyclicality", F.lit(0.0)).alias("cyclicality"))


def clip(x, lo: float, hi: float):
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def local_deviation(df: DataFrame) -> DataFrame:
    """``_sd``: population deviation of the returns there are among the last ``min(5, n / 4) + 1`` rows, the first row of a series left out; 0 where there is none."""
    w = F.least(F.lit(5), F.floor(F.col("n") / 4).cast("int"))
    recent = F.collect_list(F.when(F.col("at") > 0, F.struct("at", "w_ret"))).over(last_rows(6))
    total = lambda f: F.aggregate("_near", F.lit(0.0), lambda a, r: a + f(r))
    df = df.withColumn("_near", F.filter(recent, lambda r: r["at"] >= F.col("at") - w)).withColumn("_count", F.size("_near").cast("double"))
    df = df.withColumn("_mean", F.try_divide(total(lambda r: r["w_ret"]), F.col("_count")))
    var = F.try_divide(total(lambda r: F.pow(r["w_ret"] - F.col("_mean"), F.lit(2.0))), F.col("_count"))
    return df.withColumn("_sd", F.sqrt(F.coalesce(var, F.lit(0.0))))


def adaptive_weights(df: DataFrame, power: float = 1.5) -> DataFrame:
    """``adaptive_weight`` of every row of ``df(symbol, ts, close)``; positive, sums to 1 per symbol.

    Time and magnitude components are balanced by the series' memory, cycles and
    volatility clustering, times a local-change component. Deviations of returns
    use the rows there are (0 where there is none); a series without spread, or
    of three rows and fewer, is weighted evenly.
    """
    rows = written(with_returns(df), "returns")
    stats = written(series_stats(rows).drop("n").join(dominant_cycle(rows), KEY), "stats")
    rows = rows.join(stats, KEY)
    memory = 2 * (F.col("hurst") - 0.5)
    decay = clip(0.95 + 0.1 * memory, 0.8, 0.99)
    phase = (F.col("idx") % F.col("cycle")) / F.col("cycle")
    wave = clip(decay + 0.05 * F.sin(phase * (2 * np.pi)), 0.8, 0.99)
    cyclic = (F.col("cyclicality") > 0.3) & (F.col("cycle") > 1)
    # the running product runs from the newest row, whose own factor counts; a plain decay starts at 1
    age = F.col("n") - 1 - F.col("idx")
    rows = rows.withColumns({"_age": age, "_wave": wave, "_start": F.when(age == 0, wave).otherwise(0.0)})
    rows = varying_scan(rows, "_start", "_wave", "_product", most=0.99, least=0.8, index="_age")
    time = F.when(cyclic, F.col("_product")).otherwise(F.pow(decay, age))
    size = F.abs("w_ret")
    u = size / (4.685 * F.col("robust"))
    biweight = F.when(size <= 4.685 * F.col("robust"), F.pow(1 - u * u, F.lit(2.0))).otherwise(0.0)
    magnitude = F.pow(size, F.lit(power)) * F.when((F.col("outliers") > 0) & (F.col("robust") > 0), biweight).otherwise(1.0)
    rows = rows.withColumns({"_time": time, "_mag": magnitude}).drop("_age", "_wave", "_start", "_product")
    near = in_blocks(rows.select(KEY, TIME, F.col("idx").alias("at"), "n", "w_ret"), local_deviation, look_back=5).select(KEY, TIME, "_sd")
    near = with_previous(with_previous(near, {"_sd_before": "_sd"}).drop("_first"), {"_sd_after": "_sd"}, after=True).drop("_first")
    rows = rows.join(near, [KEY, TIME])
    before, after = F.col("_sd_before"), F.col("_sd_after")
    slope = F.when(before.isNull(), after - F.col("_sd")).when(after.isNull(), F.col("_sd") - before).otherwise((after - before) / 2)
    rows = written(rows.withColumn("_g", F.abs(slope)), "parts")
    flat = rows.groupBy(KEY).agg(F.avg("_g").alias("_gm"), F.max(F.abs("w_ret")).alias("_most"))
    rows = rows.join(flat, KEY)
    change = F.when(F.col("n") >= 10, 1 + F.tanh(F.col("_g") / (F.col("_gm") + TINY))).otherwise(1.0)
    share = clip(0.5 + 0.2 * memory + F.when(F.col("cyclicality") > 0.3, 0.1 * F.col("cyclicality")).otherwise(0.0) + 0.1 * F.col("vol_cluster"), 0.3, 0.7)
    raw = F.greatest(((1 - share) * F.col("_mag") + share * F.col("_time")) * change, F.lit(TINY))
    rows = rows.withColumn("_raw", F.when((F.col("n") <= 3) | (F.col("_most") == 0), F.lit(1.0)).otherwise(raw))
    total = rows.groupBy(KEY).agg(F.sum("_raw").alias("_total"))
    out = rows.join(total, KEY).withColumn("adaptive_weight", F.col("_raw") / F.col("_total"))
    return out.drop("_time", "_mag", "_sd", "_sd_before", "_sd_after", "_g", "_gm", "_most", "_raw", "_total")


def weight_summary(df: DataFrame, schemes: list[str]) -> DataFrame:
    """``(symbol, scheme, effective_n, last10, largest, mean)`` of weight columns."""
    long = df.select(KEY, TIME, "idx", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(s).alias("w")) for s in schemes])).alias("x")).select(KEY, "idx", "n", "x.*")
    return long.groupBy(KEY, "scheme").agg(
        (1 / F.sum(F.col("w") * F.col("w"))).alias("effective_n"), F.sum(F.when(F.col("idx") >= F.col("n") - 10, F.col("w")).otherwise(0.0)).alias("last10"), F.max("w").alias("largest"), F.avg("w").alias("mean")
    )
