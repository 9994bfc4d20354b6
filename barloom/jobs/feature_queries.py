"""Feature queries over bars, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.numbering import in_blocks
from ..functions.tables import written
from ..functions.win import presented, spread_rows
from ..operators import calendar, candles, mean_reversion, path_score, rolling
from ..sources.bars import event_bars, line_bars
from . import sql
from .registry import query

Operator = Callable[[DataFrame], DataFrame]


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_rows(event_bars(spark, sf_dir))


def blocked(bars: DataFrame, operator: Operator) -> DataFrame:
    """An operator with a fixed look-back over bars in blocks of rows, so that a long series is many tasks."""
    return in_blocks(written(bars, "bars"), operator, LOOK_BACKS[operator])


@query(sql.staged() + sql.show(["open", "high", "low", "close"]))
def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(event_bars(spark, sf_dir), ["open", "high", "low", "close"])


_LINE = """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, (epoch_us(l_shipdate) // 86400000000) * 86400 AS ts,
  arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS close FROM lineitem GROUP BY ALL"""


@query(sql.staged(base=_LINE) + " SELECT symbol, ts, " + ", ".join(f"{sql.rounded(c, 9)} AS {c}" for c in ("open", "high", "low", "close")) + " FROM final")
def bars_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(line_bars(spark, sf_dir), ["open", "high", "low", "close"], 9)


@query(sql.staged(sql.SHAPE, sql.SHAPE2) + sql.show(candles.SHAPE))
def candle_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(blocked(event_bars(spark, sf_dir), candles.candle_shape), candles.SHAPE)


def flagged(df: DataFrame) -> DataFrame:
    return candles.price_action(candles.candle_patterns(df))


@query(sql.staged(sql.PATTERNS, sql.PRICE_ACTION) + sql.show(list(sql.PRICE_ACTION), candles.PATTERNS))
def candle_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(blocked(event_bars(spark, sf_dir), flagged), [*sql.PRICE_ACTION, *candles.PATTERNS])


def _split(names: list[str], ints: tuple = ("is_new", "break", "minute", "hour", "iso_week", "slot")) -> tuple[list[str], list[str]]:
    whole = [n for n in names if n.startswith(ints) or n.endswith("_break")]
    whole = [n for n in whole if not n.endswith(("_sin", "_cos"))]
    return [n for n in names if n not in whole], whole


@query(sql.staged(*sql.calendar(480)) + sql.show(*_split(calendar.window_columns(480))))
def calendar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(calendar.window_features(hourly(spark, sf_dir), 480), calendar.window_columns(480))


@query(sql.staged(*sql.calendar(480, causal=True)) + sql.show(*_split(calendar.window_columns(480))))
def calendar_windows_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(calendar.window_features(hourly(spark, sf_dir), 480, causal=True), calendar.window_columns(480))


@query(sql.staged(*sql.session()) + sql.show(*_split(calendar.SESSION)))
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(calendar.session_stats(hourly(spark, sf_dir)), calendar.SESSION)


@query(sql.staged(*sql.CLOCK) + sql.show(*_split(calendar.CLOCK)))
def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(calendar.time_features(event_bars(spark, sf_dir)), calendar.CLOCK)


def with_technicals(df: DataFrame) -> DataFrame:
    return rolling.technicals(rolling.basic(candles.candle_shape(rolling.true_range(rolling.returns(df)))))


@query(sql.staged(sql.RETURNS | sql.TR | sql.SHAPE, sql.BASIC, *sql.TECHNICALS) + sql.show([*rolling.BASIC, *rolling.TECHNICALS, "ret", "log_return", "tr"]))
def rolling_technicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(blocked(event_bars(spark, sf_dir), with_technicals), [*rolling.BASIC, *rolling.TECHNICALS, "ret", "log_return", "tr"])


_STUDIES = ["momentum_5", "trend_strength_10", "vi_plus", "vi_minus", "vi_diff", "cci_20", "kaufman_er_10", "kaufman_er_20", "wavelet_energy", "fft_energy", "boll_z_raw"]


def with_studies(df: DataFrame) -> DataFrame:
    df = rolling.cci(rolling.vortex(rolling.trend_strength(rolling.momentum(rolling.true_range(rolling.returns(df))))))
    return rolling.energies(rolling.efficiency(rolling.efficiency(df, 10), 20)).withColumn("boll_z_raw", rolling.bollinger_z(eps=None))


@query(sql.staged(sql.RETURNS | sql.TR, *sql.STUDIES) + sql.show(_STUDIES))
def rolling_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(blocked(event_bars(spark, sf_dir), with_studies), _STUDIES)


def with_risk(df: DataFrame) -> DataFrame:
    return rolling.risk(rolling.returns(df))


@query(sql.staged(sql.RETURNS, *sql.RISK) + sql.show(rolling.RISK))
def rolling_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(blocked(event_bars(spark, sf_dir), with_risk), rolling.RISK)


@query(sql.staged(*sql.HURST) + sql.show(["hurst_20"]))
def hurst_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(blocked(event_bars(spark, sf_dir), rolling.hurst_lagstd), ["hurst_20"])


_OU = ["close_pos", "mu", "theta", "sigma", "z"]


def ou_frame(df: DataFrame) -> DataFrame:
    return mean_reversion.ou_signal(mean_reversion.ou_fit(rolling.price_position(df)))


@query(sql.staged(*sql.OU) + sql.show(_OU, ["signal", "trade"]))
def ou_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(blocked(event_bars(spark, sf_dir), ou_frame), [*_OU, "signal", "trade"])


def ou_frame_low(df: DataFrame) -> DataFrame:
    return mean_reversion.ou_signal(mean_reversion.ou_fit(rolling.price_position(df)), threshold=0.6)


_LOW = [{k: v.replace("1.5", "0.6") for k, v in step.items()} for step in sql.OU]


@query(sql.staged(*_LOW) + sql.show(["z"], ["signal", "trade"], "abs(trade) = 2"))
def ou_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(mean_reversion.signal_flips(blocked(event_bars(spark, sf_dir), ou_frame_low)), ["z", "signal", "trade"])


def placed(df: DataFrame) -> DataFrame:
    return rolling.price_position(df.withColumn("z_close", rolling.zscore("close"))).withColumnRenamed("close_pos", "place")


@query(sql.staged(*sql.studies_of("close", 20), base=_LINE) + sql.show(["z_close", "place"]))
def lines_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling z-score and place in the range over the larger table of daily supplier prices."""
    return presented(blocked(line_bars(spark, sf_dir), placed), ["z_close", "place"])


#: Rows before a row that an operator looks at, at most.
LOOK_BACKS: dict[Operator, int] = {
    candles.candle_shape: 3, flagged: 1, with_technicals: 25, with_studies: 50, with_risk: 21, rolling.hurst_lagstd: 20, ou_frame: 45, ou_frame_low: 45, placed: 19, path_score.components: 4,
}
