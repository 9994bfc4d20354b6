"""Queries on exponential means, targets, path scores, regimes, weights and draws, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import in_blocks, number_rows
from ..functions.win import KEY, TIME, presented
from ..operators import candles, draws, path_score, regimes, rolling, scan, targets, weights
from ..sources.bars import event_bars, latest_report_json
from . import sql
from .feature_queries import blocked, hourly, ou_frame, with_technicals
from .registry import query

# --- exponential means

_D14, _D12, _D26, _D9 = 1 - 1 / 14, 1 - 2 / 13, 1 - 2 / 27, 1 - 2 / 10
_EWM = (
    sql.staged(sql.NUMBERED, sql.RETURNS | sql.TR, sql.UPDOWN)
    + f""", e1 AS (SELECT *, {sql.ewm('final', 'up', _D14, True)} AS eu, {sql.ewm('final', 'down', _D14, True)} AS ed,
  {sql.ewm('final', 'close', _D12, False)} - {sql.ewm('final', 'close', _D26, False)} AS m1, {sql.ewm('final', 'close', _D12, True)} - {sql.ewm('final', 'close', _D26, True)} AS m2,
  {sql.ewm('final', 'tr', _D14, False)} AS atr_ewm, {sql.ewm('final', 'tr', _D14, True)} AS atr_adjusted FROM final t),
e2 AS (SELECT *, m1 - {sql.ewm('e1', 'm1', _D9, False)} AS macd_hist, m2 - {sql.ewm('e1', 'm2', _D9, True)} AS macd_adjusted FROM e1 t)
SELECT symbol, ts, round(CASE WHEN idx >= 14 THEN 100 - 100 / (1 + eu / (ed + 1e-6)) ELSE 50 END, 6) + 0.0 AS rsi_ewm, round(macd_hist, 6) + 0.0 AS macd_hist,
  round(macd_adjusted, 6) + 0.0 AS macd_adjusted, round(atr_ewm, 6) + 0.0 AS atr_ewm, round(atr_adjusted, 6) + 0.0 AS atr_adjusted,
  round(pow(0.95, n - 1 - idx) / sum(pow(0.95, n - 1 - idx)) OVER (PARTITION BY symbol), 6) + 0.0 AS decay_weight FROM e2"""
)


@query(_EWM)
def ewm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan.momentum_study(number_rows(rolling.true_range(rolling.returns(hourly(spark, sf_dir)))))
    df = scan.time_decay_weights(df)
    return presented(df, ["rsi_ewm", "macd_hist", "macd_adjusted", "atr_ewm", "atr_adjusted", "decay_weight"], 6)


# --- targets

_FWD = {
    "fwd": f"{sql.lead('close', 3)} / nullif({sql.lead('close', 2)}, 0) - 1", "fwd_cumulative": f"{sql.lead('close', 3)} / nullif(close, 0) - 1", "close_next": sql.lead("close"),
    "is_train": f"CAST(row_number() {sql.O} <= floor(count(*) {sql.ALL} * 0.8) AS INTEGER)",
}
_LABELS = {
    "direction": "CASE WHEN fwd > 0 THEN 1 WHEN fwd IS NOT NULL THEN 0 END",
    "band": "CASE WHEN fwd > 0.002 THEN 1 WHEN fwd < -0.002 THEN -1 WHEN fwd IS NOT NULL THEN 0 END",
    "rsi_14": "coalesce(rsi_14, 50.0)", "z": "z_close_20", "first_z": f"arg_min(z_close_20, CASE WHEN z_close_20 IS NOT NULL THEN ts END) {sql.ALL}",
}


@query(
    sql.staged(sql.RETURNS | sql.TR | sql.SHAPE, sql.BASIC, *sql.TECHNICALS, _FWD, "SELECT * REPLACE (coalesce(rsi_14, 50.0) AS rsi_14, coalesce(roll_momentum_60, 0.0) AS roll_momentum_60) FROM {prev}")
    + f""" SELECT symbol, ts, round(fwd, 6) + 0.0 AS fwd, round(fwd_cumulative, 6) + 0.0 AS fwd_cumulative, round(close_next, 6) + 0.0 AS close_next, is_train,
    {_LABELS['direction']} AS direction, {_LABELS['band']} AS band, round(rsi_14, 6) + 0.0 AS rsi_14, round(roll_momentum_60, 6) + 0.0 AS roll_momentum_60,
    round(coalesce(last_value(atr_14 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), arg_min(atr_14, CASE WHEN atr_14 IS NOT NULL THEN ts END) OVER (PARTITION BY symbol), 0), 6) + 0.0 AS atr_14
    FROM final WHERE close_next IS NOT NULL"""
)
def fill_and_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, labels, a chronological split, and NULLs filled by name."""
    df = with_technicals(hourly(spark, sf_dir))
    df = targets.forward_return(targets.forward_return(df, 3, "cumulative").withColumnRenamed("fwd", "fwd_cumulative"), 3)
    df = targets.next_close(targets.chrono_split(df))
    df = targets.fill_policy(df, ["rsi_14", "roll_momentum_60", "atr_14"]).withColumns({"direction": targets.direction_label(), "band": targets.band_label()})
    return presented(df, ["fwd", "fwd_cumulative", "close_next", "is_train", "direction", "band", "rsi_14", "roll_momentum_60", "atr_14"])


_COUNTED = ["body_size", "rsi_14", "z_close_20", "z_vol_20", "boll_z"]


@query(sql.staged(sql.RETURNS | sql.TR | sql.SHAPE, sql.BASIC, *sql.TECHNICALS) + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM final" for c in _COUNTED))
def null_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.null_counts(with_technicals(hourly(spark, sf_dir)), _COUNTED)


@query(
    sql.staged({"place": f"row_number() {sql.O}", "total": f"sum(close + low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)", "oldest": sql.lag("close", 12), "fwd": f"{sql.lead('close')} / nullif(close, 0) - 1"})
    + " SELECT symbol, ts, 12 AS length, round(total, 6) + 0.0 AS total, round(oldest, 6) + 0.0 AS oldest, CASE WHEN fwd > 0 THEN 1 WHEN fwd IS NOT NULL THEN 0 END AS label FROM final WHERE place > 12"
)
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 12 bars, told by their length, sum and oldest close."""
    df = targets.forward_return(hourly(spark, sf_dir), 1)
    seq = targets.to_sequences(df.withColumn("direction", targets.direction_label()), ["close", "low"], "direction", 12)
    total = F.aggregate(F.flatten("seq"), F.lit(0.0), lambda a, x: a + x)
    return presented(seq.withColumns({"length": F.size("seq"), "total": total, "oldest": F.get(F.get("seq", F.lit(0)), F.lit(0))}), ["length", "total", "oldest", "label"])


@query(sql.staged({"half": sql.lag("close")}) + ", odd AS (SELECT symbol, ts, half FROM final WHERE (ts // 3600) % 2 = 1) SELECT f.symbol, f.ts, round(f.close, 6) + 0.0 AS close, round(odd.half, 6) + 0.0 AS half FROM final f LEFT JOIN odd USING (symbol, ts)")
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse series aligned to the rows of a full one."""
    df = targets.lagged(hourly(spark, sf_dir), "close").withColumnRenamed("close_lag1", "half")
    sparse = df.where(F.floor(F.unix_seconds(TIME) / 3600) % 2 == 1)
    return presented(targets.align(df.drop("half"), sparse, ["half"]), ["close", "half"])


@query(sql.staged({"n": f"count(*) {sql.ALL}"}) + " SELECT symbol, CAST(count(*) AS BIGINT) AS n FROM final WHERE n >= 680 GROUP BY symbol")
def enough_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.require_min_rows(event_bars(spark, sf_dir), 680).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))


@query()
def random_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(targets.random_split(event_bars(spark, sf_dir)), ["close", "is_train"])


@query(sql.staged(*sql.OU) + sql.show(["close_pos", "z"], ["signal"]))
def ou_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean-reversion signals on halo blocks: one long series becomes many tasks, with equal rows."""
    return presented(in_blocks(event_bars(spark, sf_dir), ou_frame, look_back=45, block=200), ["close_pos", "z", "signal"])


# --- path scores

_W = [1.0 / 4.5, 1.5 / 4.5, 2.0 / 4.5]
_PATH = [
    {"d": f"close - {sql.lag('close')}", "r": f"close / nullif({sql.lag('close')}, 0) - 1"},
    {
        "momentum": f"{_W[0]!r} * {sql.lag('d', 2)} + {_W[1]!r} * {sql.lag('d')} + {_W[2]!r} * d", "net": f"close - {sql.lag('close', 3)}", "path": sql.full("sum", "abs(d)", 3),
        "resistance": "coalesce((high - low - abs(close - open)) / nullif(high - low, 0), 0.0)", "vol0": sql.full("stddev_pop", "r", 3),
    },
    {"efficiency": "CASE WHEN path > 0 THEN abs(net) / path WHEN path IS NOT NULL THEN 1.0 END", "volatility": "CASE WHEN net IS NOT NULL THEN greatest(coalesce(vol0, 0.001), 0.001) END"},
    {"plr": "(0.4 * momentum + 0.4 * sign(net) * efficiency - 0.2 * resistance) / volatility"},
    {"zm": f"avg(plr) {sql.ALL}", "zs": f"stddev_pop(plr) {sql.ALL}"},
    {"z": "(plr - zm) / CASE WHEN zs > 1e-12 THEN zs ELSE 1.0 END"},
    {"signal": "CASE WHEN z > 1.5 THEN 'LONG' WHEN z < -1.5 THEN 'SHORT' ELSE 'NEUTRAL' END", "strength": "CASE WHEN z IS NOT NULL THEN least(abs(z) / 3 * 100, 100.0) END"},
]
_PATH_SHOWN = ["momentum", "efficiency", "resistance", "volatility", "plr", "z", "strength"]


def path_frame(bars: DataFrame) -> DataFrame:
    df = blocked(bars, path_score.components)
    return path_score.signals(df.withColumn("plr", path_score.score(F.lit(0.4), F.lit(0.4), F.lit(0.2))))


@query(sql.staged(*_PATH) + " SELECT symbol, ts, " + ", ".join(f"round({c}, 7) + 0.0 AS {c}" for c in _PATH_SHOWN) + ", signal FROM final")
def path_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(path_frame(event_bars(spark, sf_dir)), [*_PATH_SHOWN, "signal"], 7)


@query(sql.staged(*_PATH, {"bef": f"lag(signal) {sql.O}"}) + " SELECT symbol, ts, signal FROM final WHERE signal IN ('LONG', 'SHORT') AND signal IS DISTINCT FROM bef")
def path_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(path_score.signal_entries(path_frame(event_bars(spark, sf_dir))), ["signal"])


_REGIME = (
    sql.staged({"rn": "row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)"})
    + """, c AS (SELECT symbol, max(CASE WHEN rn = 1 THEN close END) c0, max(CASE WHEN rn = 2 THEN close END) c1, max(CASE WHEN rn = 3 THEN close END) c2, max(CASE WHEN rn = 4 THEN close END) c3 FROM final GROUP BY symbol),
m AS (SELECT *, c0 - c2 AS ms, c0 - c3 AS mw, abs(c0 - c1) + abs(c1 - c2) AS ps, abs(c0 - c1) + abs(c1 - c2) + abs(c2 - c3) AS pw,
  sqrt((pow(c0 - c1 - (c0 - c3) / 3, 2) + pow(c1 - c2 - (c0 - c3) / 3, 2) + pow(c2 - c3 - (c0 - c3) / 3, 2)) / 3) AS sd FROM c),
k AS (SELECT *, coalesce(ms / nullif(sd * sqrt(2), 0), 0) AS zs, coalesce(mw / nullif(sd * sqrt(3), 0), 0) AS zw, coalesce(abs(ms) / nullif(ps, 0), 1) AS es, coalesce(abs(mw) / nullif(pw, 0), 1) AS ew,
  sign(c0 - c1) = sign(c1 - c2) AND sign(c1 - c2) = sign(c2 - c3) AS steady FROM m)
SELECT symbol, CASE WHEN sign(ms) = sign(mw) AND abs(zw) > 1 AND ((es > 0.7 AND ew > 0.6) OR steady) THEN 'trending' WHEN sign(ms) <> sign(mw) AND abs(zs) > 1.2 AND es < 0.5 THEN 'reversal' ELSE 'neutral' END AS regime FROM k"""
)


@query(_REGIME)
def path_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_score.regimes(event_bars(spark, sf_dir))


@query(
    sql.staged(*_PATH[:3], {"nx": f"sign({sql.lead('close')} / nullif(close, 0) - 1)"})
    + """, g AS (SELECT i / 10.0::DOUBLE AS alpha, j / 10.0::DOUBLE AS beta, (10 - i - j) / 10.0::DOUBLE AS gamma FROM range(1, 9) a(i), range(1, 9) b(j) WHERE i + j <= 9),
t AS (SELECT symbol, alpha, beta, gamma, sum(CASE WHEN sign((alpha * momentum + beta * sign(net) * efficiency - gamma * resistance) / volatility) = nx THEN 1 ELSE 0 END) AS hits, count(*) AS n
  FROM final, g WHERE nx IS NOT NULL AND momentum IS NOT NULL GROUP BY ALL)
SELECT symbol, max(hits / n) AS best FROM t GROUP BY symbol"""
)
def path_best_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = event_bars(spark, sf_dir)
    best = path_score.optimise(path_score.components(df), path_score.regimes(df), 6)
    return best.select(KEY, F.col("accuracy").alias("best"))


def path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by the weights found on the grid, with signals and each row's confidence."""
    df = hourly(spark, sf_dir)
    regime = path_score.regimes(df)
    parts = path_score.components(df)
    best = path_score.optimise(parts, regime, 6).select(KEY, "alpha", "beta", "gamma", "accuracy")
    scored = parts.join(best, KEY).withColumn("plr", path_score.score(F.col("alpha"), F.col("beta"), F.col("gamma")))
    limits = regime.join(path_score.regime_params(spark), "regime").select(KEY, "regime", "threshold")
    return path_score.confidence(path_score.signals(scored.join(limits, KEY), threshold="threshold"), regime)


@query()
def path_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest record of each symbol with its confidence."""
    names = ["close", "plr", "z", "signal", "strength", "accuracy", "regime", "confidence"]
    return presented(regimes.latest(path_scores(spark, sf_dir), names), names)


@query()
def path_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence of every row."""
    return presented(path_scores(spark, sf_dir), ["plr", "z", "signal", "strength", "confidence"])


# --- regimes

_STATE = {"state": "CASE WHEN z_close_20 < -0.5 THEN 0 WHEN z_close_20 > 0.5 THEN 2 WHEN z_close_20 IS NOT NULL THEN 1 END", "fwd": f"{sql.lead('close')} / nullif(close, 0) - 1"}
_STATES = sql.staged({"z_close_20": f"(close - {sql.full('avg', 'close', 20)}) / ({sql.full('stddev_samp', 'close', 20)} + 1e-9)"}, _STATE)


def with_state(df: DataFrame) -> DataFrame:
    z = F.col("z_close_20")
    state = F.when(z < -0.5, 0).when(z > 0.5, 2).when(z.isNotNull(), 1)
    return targets.forward_return(df.withColumn("z_close_20", rolling.zscore("close")).withColumn("state", state), 1)


@query(_STATES + " SELECT symbol, state, min(ts) AS start, max(ts) AS stop, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY symbol ORDER BY ts) OR row_number() OVER (PARTITION BY symbol ORDER BY ts) = 1 THEN 1 ELSE 0 END AS c FROM final)) GROUP BY symbol, run, state")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regimes.islands(with_state(hourly(spark, sf_dir)), "state")
    return out.select(KEY, "state", F.unix_seconds("start").alias("start"), F.unix_seconds("stop").alias("stop"), "n")


_TRANS = " FROM (SELECT symbol, bef, aft, count(*) AS n FROM (SELECT symbol, state AS aft, lag(state) OVER (PARTITION BY symbol ORDER BY ts) AS bef FROM final) WHERE bef IS NOT NULL GROUP BY ALL)"


@query(_STATES + " SELECT symbol, bef AS before, aft AS after, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY symbol, bef), 6) + 0.0 AS share" + _TRANS)
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regimes.transition_counts(with_state(hourly(spark, sf_dir)), "state")
    return out.select(KEY, "before", "after", "n", (F.round("share", 6) + F.lit(0.0)).alias("share"))


_MEANS = ", means AS (SELECT symbol, state, avg(fwd) AS m FROM final GROUP BY ALL), sides AS (SELECT symbol, arg_max(state, (m, -state)) AS buy, arg_min(state, (m, state)) AS sell FROM means WHERE m IS NOT NULL AND state IS NOT NULL GROUP BY symbol), placed AS (SELECT f.*, CASE WHEN state = buy THEN 1 WHEN state = sell THEN -1 ELSE 0 END AS position FROM final f JOIN sides USING (symbol))"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_state(hourly(spark, sf_dir))
    sides = regimes.best_worst(regimes.state_returns(df.where("state is not null"), "state"), "state")
    return regimes.map_states(df, sides, "state").withColumn("band", targets.band_label())


_BAND = "CASE WHEN fwd > 0.002 THEN 1 WHEN fwd < -0.002 THEN -1 WHEN fwd IS NOT NULL THEN 0 END"


@query(_STATES + _MEANS + f" SELECT symbol, round(sum(position * fwd), 6) + 0.0 AS total, round(avg(CASE WHEN fwd IS NOT NULL THEN CASE WHEN {_BAND} = position THEN 1.0 ELSE 0.0 END END), 6) + 0.0 AS accuracy FROM placed GROUP BY symbol")
def state_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean returns by state, the sides they give, and what holding them earns and hits."""
    df = _placed(spark, sf_dir)
    both = regimes.strategy_return(df).join(regimes.accuracy(df, "band", "position"), KEY)
    return both.select(KEY, *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("total", "accuracy")])


@query(_STATES + _MEANS + f" SELECT symbol, {_BAND} AS label, CAST(sum(CASE WHEN position = -1 THEN 1 ELSE 0 END) AS BIGINT) AS predicted_m1, CAST(sum(CASE WHEN position = 0 THEN 1 ELSE 0 END) AS BIGINT) AS predicted_0, CAST(sum(CASE WHEN position = 1 THEN 1 ELSE 0 END) AS BIGINT) AS predicted_1 FROM placed GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.confusion(_placed(spark, sf_dir), "band", "position", [-1, 0, 1])


@query(_STATES + _MEANS + " SELECT CAST(position AS VARCHAR) AS label, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM placed GROUP BY position")
def signal_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regimes.distribution(_placed(spark, sf_dir), "position")
    return out.select(F.col("label").cast("string").alias("label"), "n", (F.round("share", 6) + F.lit(0.0)).alias("share"))


@query(sql.staged() + " SELECT symbol, '{\"ts\":\"' || strftime(make_timestamp(max(ts) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000Z\",\"close\":' || CAST(arg_max(round(close, 2), ts) AS VARCHAR) || '}' AS report FROM final GROUP BY symbol")
def latest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_report_json(event_bars(spark, sf_dir).withColumn("close", F.round("close", 2)), ["close"])


@query(sql.staged({"span": "high - low"}) + " SELECT symbol, ts, round(span, 6) + 0.0 AS span, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY span DESC, ts) AS rank FROM final) WHERE rank <= 5")
def widest_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(regimes.top_rows(event_bars(spark, sf_dir).withColumn("span", F.col("high") - F.col("low")), "span", 5), ["span", "rank"])


_HOURLY_WINDOWS = [{"bkt60": "ts // 3600", "bkt480": "ts // 28800"}, {"return_60": "close / nullif(first_value(open) OVER (PARTITION BY symbol, bkt60 ORDER BY ts), 0) - 1", "return_480": "close / nullif(first_value(open) OVER (PARTITION BY symbol, bkt480 ORDER BY ts), 0) - 1"}]


@query(
    sql.staged(sql.RETURNS | sql.TR | sql.SHAPE, sql.SHAPE2, sql.BASIC, *sql.TECHNICALS, *sql.RISK, *_HOURLY_WINDOWS, _STATE)
    + ", pop AS (SELECT quantile_cont(roll_vol_60, 0.5) AS med, quantile_cont(roll_vol_60, 0.7) AS q70 FROM final), g AS (SELECT state, count(*) AS n, "
    + ", ".join(f"avg({c}) AS mean_{c}" for c in regimes.PROFILE)
    + " FROM final GROUP BY state) SELECT state, CAST(n AS BIGINT) AS n, "
    + ", ".join(f"round(mean_{c}, 6) + 0.0 AS mean_{c}" for c in regimes.PROFILE)
    + """, CASE WHEN mean_return_60 > 0 THEN 'up' WHEN mean_return_60 < 0 THEN 'down' ELSE 'flat' END AS direction, CASE WHEN mean_roll_vol_60 > med THEN 'High' ELSE 'Low' END AS vol_level,
  CASE WHEN mean_return_60 > 0.001 AND mean_rsi_14 < 70 THEN 'BUY' WHEN mean_return_60 < -0.001 AND mean_rsi_14 > 30 THEN 'SELL' WHEN mean_roll_vol_60 > q70 THEN 'high volatility' WHEN abs(mean_return_60) < 0.0005 THEN 'sideways' ELSE 'mixed' END AS reading FROM g, pop"""
)
def regime_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.calendar import window_features

    df = window_features(window_features(rolling.risk(with_technicals(hourly(spark, sf_dir))), 60), 480)
    z = F.col("z_close_20")
    df = df.withColumn("state", F.when(z < -0.5, 0).when(z > 0.5, 2).when(z.isNotNull(), 1))
    out = regimes.profile(df, "state")
    return out.select("state", "n", *[(F.round(f"mean_{c}", 6) + F.lit(0.0)).alias(f"mean_{c}") for c in regimes.PROFILE], "direction", "vol_level", "reading")


_CLASS = "CASE WHEN hurst_20 > 0.65 THEN '{0}' WHEN hurst_20 > 0.55 THEN '{1}' WHEN hurst_20 > 0.45 THEN '{2}' WHEN hurst_20 IS NOT NULL THEN '{3}' END"


@query(
    sql.staged(*sql.HURST)
    + f" SELECT symbol, ts, {_CLASS.format('strong trend', 'mild trend', 'random', 'mean-reverting')} AS label, CAST({_CLASS.format(3, 2, 1, 0)} AS INTEGER) AS code, CASE WHEN hurst_20 < 0.45 THEN 'mean-reverting' WHEN hurst_20 <= 0.55 THEN 'random' WHEN hurst_20 > 0.55 THEN 'trending' END AS band FROM final"
)
def hurst_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rolling.hurst_lagstd(hourly(spark, sf_dir)).withColumn("c", candles.hurst_class("hurst_20"))
    return presented(df.withColumns({"label": F.col("c.label"), "code": F.col("c.code"), "band": candles.hurst_band("hurst_20")}), ["label", "code", "band"])


@query(sql.staged(sql.RETURNS | sql.TR, *sql.STUDIES) + sql.show(["cci_20", "vi_diff"], [], "cci_20 IS NOT NULL AND vi_diff IS NOT NULL"))
def finite_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rolling.vortex(rolling.cci(rolling.true_range(hourly(spark, sf_dir))))
    return presented(candles.finite_rows(df, ["cci_20", "vi_diff"]), ["cci_20", "vi_diff"])


# --- weights

_STATS = (
    sql.staged(sql.NUMBERED, sql.WRET, {"prev": sql.lag("close"), "pa": f"CASE WHEN idx > 1 THEN abs({sql.lag('w_ret')}) END"})
    + """, med AS (SELECT symbol, median(w_ret) AS m FROM final WHERE idx > 0 GROUP BY symbol), mad AS (SELECT symbol, median(abs(w_ret - m)) / 0.6745 AS robust FROM final JOIN med USING (symbol) WHERE idx > 0 GROUP BY symbol)
SELECT symbol, round(corr(close, prev), 6) + 0.0 AS autocorr, round(corr(CASE WHEN pa IS NOT NULL THEN abs(w_ret) END, pa), 6) + 0.0 AS vol_cluster, round(any_value(robust), 6) + 0.0 AS robust,
  CAST(sum(CASE WHEN idx > 0 AND robust > 0 AND abs(w_ret) > 3 * robust THEN 1 ELSE 0 END) AS BIGINT) AS outliers FROM final JOIN mad USING (symbol) GROUP BY symbol"""
)


@query(_STATS)
def series_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weights.series_stats(weights.with_returns(event_bars(spark, sf_dir)))
    return out.select(KEY, *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("autocorr", "vol_cluster", "robust")], "outliers")


_SERIES_HURST = (
    sql.staged(sql.NUMBERED, {f"d{k}": f"close - {sql.lag('close', k)}" for k in range(2, 11)})
    + ", p AS ("
    + " UNION ALL ".join(f"SELECT symbol, ln({k}) AS x, ln(stddev_pop(d{k})) / 2 AS y FROM final GROUP BY symbol" for k in range(2, 11))
    + ") SELECT symbol, round(regr_slope(y, x) / 2, 6) + 0.0 AS hurst FROM p GROUP BY symbol"
)


@query(_SERIES_HURST)
def series_hurst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.series_hurst(weights.with_returns(event_bars(spark, sf_dir))).select(KEY, (F.round("hurst", 6) + F.lit(0.0)).alias("hurst"))


@query(sql.staged(sql.NUMBERED, sql.WRET) + " SELECT symbol, ts, round(pow(abs(w_ret), 1.5) / sum(pow(abs(w_ret), 1.5)) OVER (PARTITION BY symbol), 9) + 0.0 AS return_weight FROM final")
def return_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(weights.return_weights(weights.with_returns(event_bars(spark, sf_dir))), ["return_weight"], 9)


# for series of 20 rows and more; the transform is summed up bin by bin
_WEIGHTED = (
    sql.staged(sql.NUMBERED, sql.WRET, {"pa": f"CASE WHEN idx > 1 THEN abs({sql.lag('w_ret')}) END"} | {f"d{k}": f"close - {sql.lag('close', k)}" for k in range(2, 11)})
    + """, med AS (SELECT symbol, median(w_ret) AS m FROM final WHERE idx > 0 GROUP BY symbol), mad AS (SELECT symbol, median(abs(w_ret - m)) / 0.6745 AS robust FROM final JOIN med USING (symbol) WHERE idx > 0 GROUP BY symbol),
p AS ("""
    + " UNION ALL ".join(f"SELECT symbol, ln({k}) AS x, ln(stddev_pop(d{k})) / 2 AS y FROM final GROUP BY symbol" for k in range(2, 11))
    + """), hurst AS (SELECT symbol, regr_slope(y, x) / 2 AS hurst FROM p GROUP BY symbol),
r AS (SELECT symbol, idx - 1 AS t, n - 1 AS len, w_ret AS x FROM final WHERE idx > 0),
f AS (SELECT symbol, k, sqrt(pow(sum(x * cos(2 * pi() * (k * t % len) / len)), 2) + pow(sum(x * sin(2 * pi() * (k * t % len) / len)), 2)) AS size FROM (SELECT *, unnest(range(0, len // 2 + 1)) AS k FROM r) GROUP BY symbol, k),
cyc AS (SELECT symbol, arg_max(k, size) FILTER (WHERE k > 0) AS cycle, max(size) / (sum(size) + 1e-10) AS cyclicality FROM f GROUP BY symbol),
st AS (SELECT symbol, any_value(robust) AS robust, any_value(hurst) AS hurst, any_value(cycle) AS cycle, any_value(cyclicality) AS cyclicality,
  coalesce(corr(CASE WHEN pa IS NOT NULL THEN abs(w_ret) END, pa), 0) AS vol_cluster, sum(CASE WHEN idx > 0 AND robust > 0 AND abs(w_ret) > 3 * robust THEN 1 ELSE 0 END) AS outliers
  FROM final JOIN mad USING (symbol) JOIN hurst USING (symbol) JOIN cyc USING (symbol) GROUP BY symbol),
a AS (SELECT final.symbol, ts, idx, n, w_ret, st.* EXCLUDE (symbol), least(greatest(0.95 + 0.2 * (hurst - 0.5), 0.8), 0.99) AS decay,
  coalesce(stddev_pop(CASE WHEN idx > 0 THEN w_ret END) OVER (PARTITION BY final.symbol ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) AS sd FROM final JOIN st USING (symbol)),
b AS (SELECT *, least(greatest(decay + 0.05 * sin(2 * pi() * (idx % cycle) / cycle), 0.8), 0.99) AS wave, lag(sd) OVER (PARTITION BY symbol ORDER BY idx) AS s0, lead(sd) OVER (PARTITION BY symbol ORDER BY idx) AS s1 FROM a),
c AS (SELECT *, CASE WHEN cyclicality > 0.3 AND cycle > 1 THEN exp(sum(ln(wave)) OVER (PARTITION BY symbol ORDER BY idx DESC)) ELSE pow(decay, n - 1 - idx) END AS time,
  pow(abs(w_ret), 1.5) * CASE WHEN NOT (outliers > 0 AND robust > 0) THEN 1 WHEN abs(w_ret) <= 4.685 * robust THEN pow(1 - pow(w_ret / (4.685 * robust), 2), 2) ELSE 0 END AS mag,
  abs(CASE WHEN s0 IS NULL THEN s1 - sd WHEN s1 IS NULL THEN sd - s0 ELSE (s1 - s0) / 2 END) AS g,
  least(greatest(0.5 + 0.4 * (hurst - 0.5) + CASE WHEN cyclicality > 0.3 THEN 0.1 * cyclicality ELSE 0 END + 0.1 * vol_cluster, 0.3), 0.7) AS share FROM b),
d AS (SELECT *, greatest(((1 - share) * mag + share * time) * (1 + tanh(g / (avg(g) OVER (PARTITION BY symbol) + 1e-10))), 1e-10) AS raw FROM c),
weighted AS (SELECT symbol, ts, idx, n, raw / sum(raw) OVER (PARTITION BY symbol) AS adaptive_weight, pow(abs(w_ret), 1.5) / sum(pow(abs(w_ret), 1.5)) OVER (PARTITION BY symbol) AS return_weight,
  pow(0.95, n - 1 - idx) / sum(pow(0.95, n - 1 - idx)) OVER (PARTITION BY symbol) AS decay_weight FROM d)"""
)


@query(_WEIGHTED + " SELECT symbol, ts, round(adaptive_weight, 9) + 0.0 AS adaptive_weight FROM weighted")
def adaptive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presented(weights.adaptive_weights(event_bars(spark, sf_dir)), ["adaptive_weight"], 9)


_SCHEMES = ["adaptive_weight", "return_weight", "decay_weight"]
_SUMMARY = " UNION ALL ".join(
    f"SELECT symbol, '{c}' AS scheme, round(1 / sum({c} * {c}), 6) + 0.0 AS effective_n, round(sum(CASE WHEN idx >= n - 10 THEN {c} ELSE 0 END), 9) + 0.0 AS last10, round(max({c}), 9) + 0.0 AS largest, round(avg({c}), 9) + 0.0 AS mean FROM weighted GROUP BY symbol"
    for c in _SCHEMES
)


@query(f"{_WEIGHTED} {_SUMMARY}")
def weight_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = weights.return_weights(weights.adaptive_weights(event_bars(spark, sf_dir)))
    out = weights.weight_summary(scan.time_decay_weights(df), _SCHEMES)
    return out.select(KEY, "scheme", *[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in (("effective_n", 6), ("last10", 9), ("largest", 9), ("mean", 9))])


# --- draws

_DRAWS = """WITH d AS (SELECT row_number() OVER () AS r, list_sort([(l_orderkey + l_linenumber * 7) % 59 + 1, (l_partkey * 3 + l_linenumber) % 59 + 1, (l_suppkey + 11) % 59 + 1]) AS v, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""


@query(_DRAWS + " SELECT number, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(v) AS number FROM d) GROUP BY number")
def draw_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.number_frequency(draws.line_draws(spark, sf_dir), ["n1", "n2", "n3"])


@query(_DRAWS + " SELECT before, after, CAST(count(*) AS BIGINT) AS n FROM (SELECT v[1] AS after, lag(v[1]) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS before FROM d) WHERE before IS NOT NULL GROUP BY ALL")
def draw_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.transitions(draws.line_draws(spark, sf_dir), "n1")
