"""SQL twins of the bar queries, for DuckDB, written from the formulas and not from the Spark plans."""

from __future__ import annotations

EVENT_BARS = """SELECT event_type AS symbol, (epoch_us(ts) // 3600000000) * 3600 AS ts, arg_min(value, (ts, event_id)) AS open,
  max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL"""
O = "OVER (PARTITION BY symbol ORDER BY ts)"
ALL = "OVER (PARTITION BY symbol)"


def w(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) {w(n)} = {n} THEN {agg}({x}) {w(n)} END)"


def lag(x: str, k: int = 1) -> str:
    return f"(lag({x}, {k}) {O})"


def lead(x: str, k: int = 1) -> str:
    return f"(lead({x}, {k}) {O})"


def flag(cond: str) -> str:
    return f"CAST(coalesce(({cond}), false) AS INTEGER)"


def rounded(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def staged(*steps: dict[str, str] | str, base: str = EVENT_BARS) -> str:
    """CTEs that each add columns (a dict) or replace the table (SQL with ``{prev}``); the last is called ``final``."""
    parts, prev = [f"bars AS ({base})"], "bars"
    for i, step in enumerate(steps, 1):
        body = step.format(prev=prev) if isinstance(step, str) else f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM {prev}"
        parts.append(f"s{i} AS ({body})")
        prev = f"s{i}"
    return f"WITH {', '.join(parts)}, final AS (SELECT * FROM {prev})"


def show(doubles: list[str], others: list[str] | None = None, where: str = "true", keys: str = "symbol, ts") -> str:
    cols = [f"{rounded(c)} AS {c}" for c in doubles] + list(others or [])
    return f" SELECT {', '.join([keys, *cols])} FROM final WHERE {where}"


RNG = "(CASE WHEN high <> low THEN high - low END)"
RETURNS = {"ret": f"close / nullif({lag('close')}, 0) - 1", "log_return": f"coalesce(CASE WHEN close > 0 AND {lag('close')} > 0 THEN ln(close / {lag('close')}) END, 0.0)", "delta": f"close - {lag('close')}"}
TR = {"tr": f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"}
SHAPE = {
    "body_size": f"(close - open) / ({RNG} + 1e-9)",
    "close_position": f"(close - low) / ({RNG} + 1e-9)",
    "trend_momentum": f"(close - {lag('close', 3)}) / ({RNG} + 1e-9)",
    "breakout_high": f"(high - {lag('high')}) / ({RNG} + 1e-9)",
    "breakout_low_inv": f"-(low - {lag('low')}) / ({RNG} + 1e-9)",
    "upper_wick": f"(high - greatest(open, close)) / ({RNG} + 1e-9)",
    "lower_wick": f"(least(open, close) - low) / ({RNG} + 1e-9)",
    "range_percent": f"{RNG} / (open + 1e-9)",
}
SHAPE2 = {
    "wick_polarity": "tanh(lower_wick - upper_wick)",
    "wick_ratio": "CASE WHEN lower_wick IS NOT NULL THEN greatest(least((lower_wick - upper_wick) / (lower_wick + upper_wick + 1e-9), 10.0), -10.0) END",
    "body_vs_range": "body_size * range_percent",
}
PATTERNS = {
    "doji": flag("abs(close - open) < 0.1 * (high - low)"),
    "hammer": flag("least(open, close) - low > 2 * abs(close - open) AND high - greatest(open, close) < 0.5 * abs(close - open)"),
    "shooting_star": flag("high - greatest(open, close) > 2 * abs(close - open) AND least(open, close) - low < 0.5 * abs(close - open)"),
    "bullish_engulfing": flag(f"close > open AND {lag('close')} < {lag('open')} AND abs(close - open) > abs({lag('close')} - {lag('open')}) AND open < {lag('close')} AND close > {lag('open')}"),
    "bearish_engulfing": flag(f"close < open AND {lag('close')} > {lag('open')} AND abs(close - open) > abs({lag('close')} - {lag('open')}) AND open > {lag('close')} AND close < {lag('open')}"),
}
PRICE_ACTION = {
    "pa_body": "coalesce((close - open) / nullif(high - low, 0), 0.0)",
    "pa_upper_wick": "coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0.0)",
    "pa_lower_wick": "coalesce((least(open, close) - low) / nullif(high - low, 0), 0.0)",
}


def calendar(minutes: int, causal: bool = False) -> list[dict[str, str]]:
    m, by = f"_{minutes}", "PARTITION BY symbol, bkt"
    run = f"OVER ({by} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    span = run if causal else f"OVER ({by})"
    hi, lo = f"max(high) {span}", f"min(low) {span}"
    new = {f"{x}_norm{m}": f"({x} - min({x}) {span}) / (max({x}) {span} - min({x}) {span} + 1e-12)" for x in ("open", "high", "low", "close")}
    new |= {
        f"range{m}": f"{hi} - {lo}",
        f"pos_in{m}": f"(row_number() OVER ({by} ORDER BY ts) - 1)::DOUBLE / greatest(count(*) OVER ({by}) - 1, 1)",
        f"dist_to_high{m}": f"({hi} - close) / ({hi} - {lo} + 1e-12)",
        f"dist_to_low{m}": f"(close - {lo}) / ({hi} - {lo} + 1e-12)",
        f"is_new_high{m}": flag(f"close >= {hi}"),
        f"is_new_low{m}": flag(f"close <= {lo}"),
        f"return{m}": f"close / nullif(first_value(open) {run}, 0) - 1",
    }
    return [{"bkt": f"ts // {minutes * 60}"}, new]


def session(hours: int = 24) -> list[dict[str, str]]:
    by = "PARTITION BY symbol, sess"
    return [
        {"sess": f"ts // {hours * 3600}"},
        {"session_high": f"max(high) OVER ({by})", "session_low": f"min(low) OVER ({by})", "session_open": f"first_value(open) OVER ({by} ORDER BY ts)"},
        {"session_range": "session_high - session_low"},
        {
            "session_pos": "(close - session_low) / (session_range + 1e-9)",
            "session_high_break": flag(f"close > {lag('session_high')}"),
            "session_low_break": flag(f"close < {lag('session_low')}"),
        },
    ]


CLOCK = [
    {"minute": "CAST((ts // 60) % 60 AS INTEGER)", "hour": "CAST((ts // 3600) % 24 AS INTEGER)", "iso_week": "CAST(week(to_timestamp(ts) AT TIME ZONE 'UTC') AS INTEGER)"},
    {
        "slot": "CAST(((hour % 8) * 60 + minute) // 10 AS INTEGER)",
        "hour_sin": "sin(hour * 2 * pi() / 24)", "hour_cos": "cos(hour * 2 * pi() / 24)", "minute_sin": "sin(minute * 2 * pi() / 60)", "minute_cos": "cos(minute * 2 * pi() / 60)",
    },
]
BASIC = {
    "roll_range_60": full("avg", "(high - low)", 6), "roll_vol_60": full("stddev_samp", "close", 6), "roll_body_60": full("avg", "body_size", 6), "roll_momentum_60": f"close - {lag('close', 5)}",
}
UPDOWN = {"up": "CASE WHEN delta IS NOT NULL THEN greatest(delta, 0.0) END", "down": "CASE WHEN delta IS NOT NULL THEN greatest(-delta, 0.0) END"}
TECHNICALS = [
    UPDOWN,
    {
        "z_close_20": f"(close - {full('avg', 'close', 20)}) / ({full('stddev_samp', 'close', 20)} + 1e-9)",
        "z_vol_20": f"(roll_vol_60 - {full('avg', 'roll_vol_60', 20)}) / ({full('stddev_samp', 'roll_vol_60', 20)} + 1e-9)",
        "atr_14": full("avg", "tr", 14),
        "rsi_14": f"100 - 100 / (1 + {full('avg', 'up', 14)} / ({full('avg', 'down', 14)} + 1e-9))",
        "roll_min_20": full("min", "close", 20),
        "roll_max_20": full("max", "close", 20),
        "boll_z": f"(close - {full('avg', 'close', 20)}) / ({full('stddev_samp', 'close', 20)} + 1e-6)",
    },
    {"rel_atr": "atr_14 / (open + 1e-9)", "pos_in_roll": "(close - roll_min_20) / (roll_max_20 - roll_min_20 + 1e-9)"},
]


def ratio(a: str, b: str, least: float = 1e-12) -> str:
    return f"({a}) / (CASE WHEN {b} > {least} THEN {b} END)"


STUDIES = [
    {
        "momentum_5": f"coalesce(close - {lag('close', 5)}, 0.0)",
        "trend_strength_10": ratio(full("avg", "ret", 10), full("stddev_samp", "ret", 10)),
        "vplus": f"abs(high - {lag('low')})", "vminus": f"abs(low - {lag('high')})", "tp": "(high + low + close) / 3",
        "kaufman_er_10": f"abs(close - {lag('close', 10)}) / ({full('sum', 'abs(delta)', 10)} + 1e-9)",
        "kaufman_er_20": f"abs(close - {lag('close', 20)}) / ({full('sum', 'abs(delta)', 20)} + 1e-9)",
        "wavelet_energy": full("avg", "(delta * delta)", 49),
        "fft_energy": f"50 * {full('var_pop', 'close', 50)}",
        "boll_z_raw": ratio(f"close - {full('avg', 'close', 20)}", full("stddev_samp", "close", 20)),
    },
    {
        "vi_plus": f"{full('sum', 'vplus', 14)} / nullif({full('sum', 'tr', 14)}, 0)",
        "vi_minus": f"{full('sum', 'vminus', 14)} / nullif({full('sum', 'tr', 14)}, 0)",
        "cci_20": ratio(f"tp - {full('avg', 'tp', 20)}", f"(0.015 * {full('stddev_samp', 'tp', 20)})", 0.015e-12),
    },
    {"vi_diff": "vi_plus - vi_minus"},
]
RISK = [
    {"loss": "CASE WHEN ret < 0 THEN ret ELSE 0.0 END", "bef": lag("ret")},
    {
        "rolling_sharpe": f"{full('avg', 'ret', 20)} / ({full('stddev_samp', 'ret', 20)} + 1e-9) * sqrt(252)",
        "rolling_sortino": f"{full('avg', 'ret', 20)} / ({full('stddev_samp', 'loss', 20)} + 1e-9) * sqrt(252)",
        "rolling_skew": f"CASE WHEN {full('stddev_pop', 'ret', 20)} > 1e-12 THEN {full('skewness', 'ret', 20)} END",
        "rolling_kurtosis": f"CASE WHEN {full('stddev_pop', 'ret', 20)} > 1e-12 THEN {full('kurtosis', 'ret', 20)} END",
        "regime_instability": f"CASE WHEN count(CASE WHEN bef IS NOT NULL THEN ret END) {w(10)} = 10 AND stddev_pop(ret) {w(10)} > 1e-12 AND stddev_pop(bef) {w(10)} > 1e-12 THEN 1 - abs(corr(ret, bef) {w(10)}) END",
    },
]
_LN = [f"ln({k})" for k in range(2, 10)]
_MEAN = f"(({' + '.join(_LN)}) / 8)"
_VAR = "(" + " + ".join(f"pow({x} - {_MEAN}, 2)" for x in _LN) + ")"
HURST = [
    {f"d{k}": f"close - {lag('close', k)}" for k in range(2, 10)},
    {f"sd{k}": full("stddev_pop", f"d{k}", 20 - k) for k in range(2, 10)},
    {"hurst_20": " + ".join(f"(CASE WHEN sd{k} > 1e-12 THEN ln(sd{k}) END) * (ln({k}) - {_MEAN}) / {_VAR}" for k in range(2, 10))},
]
POSITION = {"close_pos": f"round_even((close - {full('min', 'low', 20)}) / ({full('max', 'high', 20)} - {full('min', 'low', 20)} + 1e-9), 4)"}
OU = [
    POSITION,
    {"px": lag("close_pos")},
    {"a": "CASE WHEN px IS NOT NULL AND close_pos IS NOT NULL THEN px END", "b": "CASE WHEN px IS NOT NULL AND close_pos IS NOT NULL THEN close_pos END"},
    {"cnt": f"count(a) {w(19)}", "sx": f"sum(a) {w(19)}", "sy": f"sum(b) {w(19)}", "sxx": f"sum(a * a) {w(19)}", "syy": f"sum(b * b) {w(19)}", "sxy": f"sum(a * b) {w(19)}"},
    {"mu": "CASE WHEN cnt = 19 THEN (sy * sxx - sx * sxy) / nullif(19 * (sxx - sxy) - (sx * sx - sx * sy), 0) END"},
    {"q0": "(sxy - mu * sx - mu * sy + 19 * mu * mu) / nullif(sxx - 2 * mu * sx + 19 * mu * mu, 0)"},
    {"q": "CASE WHEN q0 > 0 THEN q0 END"},
    {"theta": "-ln(q)", "vv": "(syy - 2 * q * sxy + q * q * sxx - 2 * mu * (1 - q) * (sy - q * sx) + 19 * mu * mu * (1 - q) * (1 - q)) / 19"},
    {"s2": "CASE WHEN vv > 1e-10 AND abs(q - 1) > 1e-9 THEN vv * 2 * theta / nullif(1 - q * q, 0) END"},
    {"sigma": "CASE WHEN s2 > 1e-10 THEN sqrt(s2) END"},
    {"z": "(close_pos - mu) / nullif(sigma, 0)"},
    {"signal": f"{flag('z < -1.5')} - {flag('z > 1.5')}"},
    {"trade": f"signal - {lag('signal')}"},
]


def studies_of(x: str, n: int) -> list[dict[str, str]]:
    return [
        {
            "z_close": f"({x} - {full('avg', x, n)}) / ({full('stddev_samp', x, n)} + 1e-9)",
            "place": f"round_even(({x} - {full('min', 'low', n)}) / ({full('max', 'high', n)} - {full('min', 'low', n)} + 1e-9), 4)",
        }
    ]


def ewm(table: str, x: str, d: float, adjust: bool) -> str:
    """An exponentially weighted mean as a scalar subquery over all rows up to the current one (``t``)."""
    if adjust:
        value = f"sum(pow({d!r}, t.idx - u.idx) * u.{x}) / sum(CASE WHEN u.{x} IS NOT NULL THEN pow({d!r}, t.idx - u.idx) END)"
    else:
        value = f"sum(pow({d!r}, t.idx - u.idx) * u.{x} * CASE WHEN u.idx = 0 THEN 1.0 ELSE {1 - d!r} END)"
    return f"(SELECT {value} FROM {table} u WHERE u.symbol = t.symbol AND u.idx <= t.idx)"


NUMBERED = {"idx": f"row_number() {O} - 1", "n": f"count(*) {ALL}"}
WRET = {"w_ret": f"coalesce((close - {lag('close')}) / ({lag('close')} + 1e-10), 0.0)"}
