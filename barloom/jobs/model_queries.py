"""Queries that fit models or need whole windows; checked by properties, as SQL has no form for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import number_rows
from ..functions.stretches import window_vectors
from ..functions.tables import written
from ..functions.win import KEY, TIME, col, lead, presented
from ..operators import config_search, draws, hmm, models, regimes, rolling, slopes, spectral, targets
from ..operators.calendar import CLOCK, SESSION, session_stats, time_features, window_columns, window_features
from ..operators.candles import PATTERNS, SHAPE, candle_patterns, candle_shape
from ..operators.walk_forward import walk_forward as walked
from ..sources.bars import event_bars
from .feature_queries import hourly, with_technicals
from .registry import query

_HMM = ["log_return", "vi_diff", "z_close_20"]
# The features of the regime mixture.
_MIXED = ["return_60", "return_480", "roll_vol_60", "body_vs_range", "wick_polarity", "z_close_20", "rsi_14", "pos_in_roll"]


#: Rows that a sequence looks back, and that its direction looks ahead.
_WINDOW, _AHEAD = 96, 24


@query()
def dominant_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(spectral.dominant_frequency(hourly(spark, sf_dir)), ["fft_dominant_freq"])


@query()
def hurst_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(spectral.hurst_rs(hourly(spark, sf_dir)), ["hurst_rs"])


_THEIL = """WITH bars AS (SELECT event_type AS symbol, (epoch_us(ts) // 3600000000) * 3600 AS ts, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL),
p AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM bars)
SELECT a.symbol, round(median((b.close - a.close) / (a.n - b.n)), 6) + 0.0 AS slope FROM p a JOIN p b ON a.symbol = b.symbol AND a.n > b.n GROUP BY a.symbol"""


@query(_THEIL)
def robust_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slopes.theil_sen(event_bars(spark, sf_dir)).select(KEY, (F.round("slope", 6) + F.lit(0.0)).alias("slope"))


def all_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Calendar, candle, technical, clock and advanced features; every one comes with its name."""
    df = window_features(window_features(with_technicals(df), 60), 480)
    df = rolling.hurst_lagstd(rolling.energies(rolling.risk(rolling.efficiency(rolling.efficiency(df, 10), 20))))
    df = time_features(session_stats(candle_patterns(df)))
    names = [*window_columns(60), *window_columns(480), *SHAPE, *rolling.BASIC, *rolling.TECHNICALS, *CLOCK, "kaufman_er_10", "kaufman_er_20", *rolling.RISK, "wavelet_energy", "fft_energy", "hurst_20", *SESSION, *PATTERNS]
    return df, names


@query()
def forecast_and_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, a forest's forecast of the next close, mixture regimes, their readings, and signals.

    The features are some eighty window columns; they are written once, and both
    models read that table.
    """
    df, names = all_features(hourly(spark, sf_dir))
    df = targets.fill_policy(targets.next_close(targets.require_min_rows(targets.chrono_split(df), 100)), names)
    df = written(df.select(KEY, TIME, "close", "close_next", "is_train", *names), "features")
    forecast, _ = models.rf_forecast(df, names, "close_next")
    mixed = written(models.gmm_regimes(df.select(KEY, TIME, *dict.fromkeys([*_MIXED, *regimes.PROFILE])), _MIXED, "return_60"), "regimes")
    readings = regimes.profile(mixed, "regime")
    signals = models.regime_signal(mixed, readings).select(KEY, TIME, "regime", "regime_signal", "signal_confidence", "simple_signal")
    return presented(forecast.select(KEY, TIME, "close", "close_next", "forecast").join(signals, [KEY, TIME]), ["close", "close_next", "forecast", "regime", "regime_signal", "signal_confidence", "simple_signal"])


@query()
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = window_features(window_features(with_technicals(hourly(spark, sf_dir)), 60), 480)
    return presented(models.pca_project(df, _MIXED), ["pc1", "pc2"], 4)


def _hmm_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rolling.vortex(rolling.true_range(rolling.returns(hourly(spark, sf_dir)))).withColumn("z_close_20", rolling.zscore("close"))
    return models.standardise(targets.forward_return(df, 3), _HMM)


@query()
def hmm_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model over all series; each symbol's sides by mean forward return, and its latest signal."""
    df = written(_hmm_input(spark, sf_dir).select(KEY, TIME, "fwd", *_HMM), "features")
    decoded = hmm.decode(df, hmm.fit(df, _HMM), _HMM)
    joined = targets.align(decoded, df, ["fwd"])
    sides = regimes.best_worst(regimes.state_returns(joined, "state"), "state")
    return hmm.posterior_signal(decoded, sides)


@query()
def best_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine parameters searched one at a time from their first values; the full product is :func:`config_search.parameter_grid` without ``star``."""
    df = event_bars(spark, sf_dir)
    rows = df.groupBy(KEY).count().agg(F.min("count")).first()[0] or 0  # one number: ranges fit the shortest series
    return config_search.config_search(df, config_search.parameter_grid(rows, star=True)).withColumn("score", F.round("score", 6))


@query()
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = number_rows(_hmm_input(spark, sf_dir))
    counts = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    return presented(walked(written(df.join(counts, KEY), "numbered"), _HMM), ["prediction", "label"])


@query()
def direction_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of the close 24 rows on, from eleven candle features of the 96 rows before."""
    df = candle_shape(hourly(spark, sf_dir), _WINDOW)
    ahead = lead("close", _AHEAD) / col("close") - 1
    df = targets.random_split(df.withColumn("direction", F.when(ahead.isNotNull(), F.when(ahead > 0, 1).otherwise(0)))).dropna(subset=SHAPE)
    scaled = models.standardise(df, SHAPE, "is_train")
    seq = written(targets.random_split(window_vectors(scaled, SHAPE, "direction", _WINDOW)), "sequences")
    return presented(models.direction_classifier(seq), ["label", "prediction", "p_up"])


@query()
def draw_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emission probabilities of a hidden model with ten states over all drawn numbers in flattened order.

    A supplier's draws are one series, however long.
    """
    numbers = F.array(*[F.col(f"n{i}") - 1 for i in (1, 2, 3)])
    rows = draws.line_draws(spark, sf_dir).select(F.col("series").cast("string").alias(KEY), F.col("order").alias(TIME), numbers.alias("x"))
    model = hmm.fit_categorical(rows, "x", 59, stretch=F.floor(F.col(f"{TIME}.l_orderkey") / 20_000))
    return spark.createDataFrame([(k, s + 1, round(float(p), 9)) for k, row in enumerate(model.emit) for s, p in enumerate(row)], "state int, number int, p double")
