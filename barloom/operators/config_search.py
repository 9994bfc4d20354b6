"""Search over feature configurations: one hidden-state model for each symbol and configuration.

The features of all configurations are columns that are computed once for each
value of a parameter; a configuration is a list of places among them. Fitting,
decoding and scoring are the operators that single models use, with the symbol
and the configuration as the name of the series and of its model.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from ..functions.win import KEY, TIME, lead
from . import hmm, regimes, rolling, scan

#: The parameters of a configuration with their least value, bound and step; the bound is also kept below a third of the rows.
RANGES = {
    "macd_fast": (5, 12, 2), "macd_slow": (26, 50, 5), "macd_signal": (8, 12, 2), "momentum": (3, 20, 2), "trend": (5, 20, 5),
    "vortex": (10, 18, 3), "cci": (10, 20, 5), "boll": (10, 20, 5), "atr": (5, 35, 5),
}
FEATURES = 8


def parameter_grid(rows: int, star: bool = False) -> list[dict[str, int]]:
    """All configurations of ``RANGES`` for a series of that many rows; ``star`` varies one parameter at a time from the first values."""
    values = {k: list(range(lo, min(hi, rows // 3), step)) for k, (lo, hi, step) in RANGES.items()}
    if not all(values.values()):
        return []
    if not star:
        return [dict(zip(values, one, strict=True)) for one in itertools.product(*values.values())]
    base = {k: v[0] for k, v in values.items()}
    return [base] + [base | {k: x} for k, v in values.items() for x in v[1:]]


def feature_names(c: dict[str, int]) -> list[str]:
    """The columns of a configuration among those of :func:`shared_features`."""
    macd = "_".join(str(c[f"macd_{p}"]) for p in ("fast", "slow", "signal"))
    return [f"macd_{macd}", f"momentum_{c['momentum']}", "log_return", f"trend_strength_{c['trend']}", f"vi_diff_{c['vortex']}", f"cci_{c['cci']}", f"boll_z_{c['boll']}", f"atr_ewm_{c['atr']}"]


def shared_features(df: DataFrame, configs: list[dict[str, int]]) -> DataFrame:
    """``df(symbol, ts, open, high, low, close)`` with the features of all configurations, each computed once; all means in two scans."""
    values = {p: sorted({c[p] for c in configs}) for p in RANGES}
    pairs = sorted({(c["macd_fast"], c["macd_slow"], c["macd_signal"]) for c in configs})
    df = rolling.true_range(rolling.returns(df))
    for n in values["momentum"]:
        df = rolling.momentum(df, n, fill=False)
    for n in values["trend"]:
        df = rolling.trend_strength(df, n)
    for n in values["vortex"]:
        df = rolling.vortex(df, n).withColumnRenamed("vi_diff", f"vi_diff_{n}").drop("vi_plus", "vi_minus")
    for n in values["cci"]:
        df = rolling.cci(df, n)
    df = df.withColumns({f"boll_z_{n}": rolling.bollinger_z(n, eps=None) for n in values["boll"]})
    spans = sorted({*values["macd_fast"], *values["macd_slow"]})
    df = scan.ewm_means(df, {f"_e{n}": {"x": "close", "span": n} for n in spans} | {f"atr_ewm_{n}": {"x": "tr", "alpha": 1 / n} for n in values["atr"]})
    df = df.withColumns({f"_m{a}_{b}": F.col(f"_e{a}") - F.col(f"_e{b}") for a, b, _ in pairs})
    df = scan.ewm_means(df, {f"_g{a}_{b}_{s}": {"x": f"_m{a}_{b}", "span": s} for a, b, s in pairs})
    return df.withColumns({f"macd_{a}_{b}_{s}": F.col(f"_m{a}_{b}") - F.col(f"_g{a}_{b}_{s}") for a, b, s in pairs})


def configured(df: DataFrame, configs: list[dict[str, int]], min_rows: int = 30, ahead: int = 4) -> DataFrame:
    """``(symbol, ts, owner, config, later, z0 .. z7)``: the features of each configuration, standardised over its rows.

    ``symbol`` names the series of one symbol under one configuration, ``owner``
    the symbol. Rows with a missing feature are left out, and series of fewer
    than ``min_rows`` rows. ``later`` is the return ``ahead`` rows on.
    """
    names = sorted({n for c in configs for n in feature_names(c)})
    places = {n: i for i, n in enumerate(names)}
    wide = shared_features(df, configs).withColumn("later", lead("ret", ahead))
    wide = written(wide.select(KEY, TIME, "later", F.array(*names).alias("all")), "features")
    table = df.sparkSession.createDataFrame([(i, [places[n] for n in feature_names(c)]) for i, c in enumerate(configs)], "config int, places array<int>")
    each = wide.withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(len(configs) - 1)))).join(F.broadcast(table), "config")  # one row for each configuration asked for
    x = F.transform("places", lambda i: F.get("all", i))
    rows = each.select(F.concat_ws("\x1f", KEY, "config").alias("_series"), F.col(KEY).alias("owner"), "config", TIME, "later", x.alias("x"))
    rows = rows.where(F.forall("x", lambda v: v.isNotNull())).withColumnRenamed("_series", KEY)
    at = [F.get("x", F.lit(i)) for i in range(FEATURES)]
    stats = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(a) for a in at]).alias("_mean"), F.array(*[F.stddev_pop(a) for a in at]).alias("_sd"))
    scaled = [((at[i] - F.get("_mean", F.lit(i))) / F.greatest(F.get("_sd", F.lit(i)), F.lit(1e-9))).alias(f"z{i}") for i in range(FEATURES)]
    return rows.join(stats.where(F.col("_n") >= min_rows), KEY).select(KEY, TIME, "owner", "config", "later", *scaled)


def config_scores(df: DataFrame, configs: list[dict[str, int]], k: int = 3, min_rows: int = 30, ahead: int = 4, iterations: int = 1000, tolerance: float = 1e-3) -> DataFrame:
    """``(symbol, config, score)``: the summed return of the sides of a full-covariance model's states, ``ahead`` rows later."""
    names = [f"z{i}" for i in range(FEATURES)]
    shape = hmm.Shape(k, FEATURES, "full")
    rows = written(configured(df, configs, min_rows, ahead), "configured")
    starts = hmm.start_models(rows, names, shape, model=F.col(KEY), least=1)
    blocks, units = hmm.series_blocks(rows, names, model=F.col(KEY))
    fitted = hmm.em(blocks, units, starts, shape, iterations, tolerance)
    states = hmm.states_of(blocks, units, fitted, shape).select(KEY, TIME, "state").join(rows.select(KEY, TIME, "later"), [KEY, TIME])
    sides = regimes.best_worst(regimes.state_returns(states, "state", "later"), "state")
    total = regimes.strategy_return(regimes.map_states(states, sides, "state"), "later")
    known = rows.select(KEY, "owner", "config").distinct()
    return total.join(known, KEY).select(F.col("owner").alias(KEY), "config", F.coalesce("total", F.lit(0.0)).alias("score"))


def config_search(df: DataFrame, configs: list[dict[str, int]], **options) -> DataFrame:
    """``(symbol, config, score, tried, failed)``: the best configuration of each symbol, as JSON, by :func:`config_scores`.

    A symbol with too few rows for any has the first one and a score of minus
    infinity. ``failed`` counts configurations without a model, be it for too
    few rows or a degenerate one; ties go to the earlier configuration.
    """
    spark = df.sparkSession
    texts = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(configs)], "config int, params string")
    scores = config_scores(df, configs, **options)
    best = scores.groupBy(KEY).agg(F.max_by(F.struct("config", "score"), F.struct("score", -F.col("config"))).alias("b"), F.count(F.lit(1)).alias("fitted"))
    every = df.select(KEY).distinct().join(best, KEY, "left")
    out = every.select(KEY, F.coalesce("b.config", F.lit(0)).alias("_c"), F.coalesce("b.score", F.lit(float("-inf"))).alias("score"), F.coalesce("fitted", F.lit(0)).alias("fitted"))
    joined = out.join(F.broadcast(texts), F.col("_c") == F.col("config")).drop("config")
    return joined.select(KEY, F.col("params").alias("config"), "score", F.lit(len(configs)).cast("long").alias("tried"), (F.lit(len(configs)) - F.col("fitted")).cast("long").alias("failed"))
