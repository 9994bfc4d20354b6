"""Exponentially weighted means by a blocked affine scan.

``n[t] = d * n[t-1] + x[t]`` over rows numbered per symbol. Inside a block of
``B`` rows the recursion is a running sum scaled by powers of ``d``. A block's
carry is the decayed sum of the last values of the blocks before it, of which
only those count whose weight ``d ** (B * j)`` a double can still see; it is
joined back on the block. No task holds a whole symbol.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import number_rows
from ..functions.win import KEY

#: Weights below this do not change a sum of doubles.
_NOTHING = 1e-18
#: Blocks back that a carry may need at most.
_MOST_BLOCKS = 4096


def block_rows(d: float) -> int:
    """Rows of a block, so that ``d ** -B`` stays a finite double."""
    return max(1, min(512, int(600 / -math.log(d))))


def affine_scan(df: DataFrame, columns: dict[str, tuple[str, float]], index: str = "idx") -> DataFrame:
    """Adds ``name`` for each ``name: (x, d)``: the decayed running sum of ``x``, which must not be NULL; ``0 < d < 1``.

    ``index`` numbers the rows of a symbol from 0 without gaps. All columns of
    one call share the blocks, the aggregation and the join.
    """
    size = min(block_rows(d) for _, d in columns.values())
    reach = {n: math.ceil(math.log(_NOTHING) / (size * math.log(d))) for n, (_, d) in columns.items()}
    if max(reach.values()) > _MOST_BLOCKS:
        raise ValueError("the span is too long for a carry over blocks")
    rows = df.withColumns({"_block": F.floor(F.col(index) / size), "_at": (F.col(index) % size).cast("double")})
    run = Window.partitionBy(KEY, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_l_{n}": F.sum(F.col(x) * F.pow(F.lit(d), -F.col("_at"))).over(run) * F.pow(F.lit(d), F.col("_at")) for n, (x, d) in columns.items()})
    lasts = rows.groupBy(KEY, "_block").agg(*[F.max_by(f"_l_{n}", index).alias(f"_x_{n}") for n in columns])

    def carry(n: str, d: float):
        back = F.collect_list(f"_x_{n}").over(Window.partitionBy(KEY).orderBy("_block").rowsBetween(-(reach[n] - 1), 0))
        return F.aggregate(back, F.lit(0.0), lambda acc, x: acc * (d**size) + x)

    carried = lasts.select(KEY, (F.col("_block") + 1).alias("_block"), *[carry(n, d).alias(f"_c_{n}") for n, (_, d) in columns.items()])
    out = {n: F.col(f"_l_{n}") + F.pow(F.lit(d), F.col("_at") + 1) * F.coalesce(f"_c_{n}", F.lit(0.0)) for n, (_, d) in columns.items()}
    joined = rows.join(carried, [KEY, "_block"], "left").withColumns(out)
    return joined.drop("_block", "_at", *[f"_l_{n}" for n in columns], *[f"_c_{n}" for n in columns])


def varying_scan(df: DataFrame, x: str, factor: str, name: str, most: float, least: float, index: str = "idx") -> DataFrame:
    """Adds ``name``: ``n[t] = factor[t] * n[t-1] + x[t]``, with a factor of its own for each row, ``0 < least <= factor <= most < 1``.

    As :func:`affine_scan`: inside a block the recursion is a running sum scaled
    by running products of factors, and a block's carry is the sum of the last
    values of the blocks before it, each times the product of the factors since.
    """
    size = block_rows(least)
    reach = math.ceil(math.log(_NOTHING) / (size * math.log(most)))
    if reach > _MOST_BLOCKS:
        raise ValueError("the factors are too near to 1 for a carry over blocks")
    run = Window.partitionBy(KEY, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_block", F.floor(F.col(index) / size)).withColumn("_log", F.sum(F.ln(factor)).over(run))
    rows = rows.withColumn("_own", F.exp("_log") * F.sum(F.col(x) * F.exp(-F.col("_log"))).over(run))
    lasts = rows.groupBy(KEY, "_block").agg(F.struct(F.max_by("_own", index).alias("own"), F.exp(F.max_by("_log", index)).alias("product")).alias("_last"))
    back = F.collect_list("_last").over(Window.partitionBy(KEY).orderBy("_block").rowsBetween(-(reach - 1), 0))
    carry = F.aggregate(back, F.lit(0.0), lambda acc, last: acc * last["product"] + last["own"])
    carried = lasts.select(KEY, (F.col("_block") + 1).alias("_block"), carry.alias("_carry"))
    out = F.col("_own") + F.exp("_log") * F.coalesce("_carry", F.lit(0.0))
    return rows.join(carried, [KEY, "_block"], "left").withColumn(name, out).drop("_block", "_log", "_own", "_carry")


def decay_of(alpha: float | None = None, span: float | None = None) -> float:
    return 1 - (alpha if alpha is not None else 2 / (span + 1))


def ewm_means(df: DataFrame, means: dict[str, dict]) -> DataFrame:
    """Adds exponentially weighted means: ``name: {x, alpha or span, adjust, min_periods}``.

    ``adjust`` (the default) divides by the decayed count; rows with NULL decay
    the weights and add nothing. Without it the first known value starts the
    recursion, and NULLs are only allowed before it. All means of one call share
    one scan.
    """
    if "idx" not in df.columns:
        df = number_rows(df)
    run = Window.partitionBy(KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    new, scans, final, extra = {}, {}, {}, []
    for n, m in means.items():
        x, adjust, least = m["x"], m.get("adjust", True), m.get("min_periods", 1)
        d = decay_of(m.get("alpha"), m.get("span"))
        new[f"_seen_{n}"] = F.count(x).over(run)
        known = F.col(x).isNotNull()
        if adjust:
            new[f"_n_{n}"] = F.coalesce(F.col(x).cast("double"), F.lit(0.0))
            new[f"_p_{n}"] = known.cast("double")
            scans |= {f"_sn_{n}": (f"_n_{n}", d), f"_sp_{n}": (f"_p_{n}", d)}
            value = F.try_divide(F.col(f"_sn_{n}"), F.col(f"_sp_{n}"))
        else:
            first = known & (F.count(x).over(run) == 1)
            new[f"_n_{n}"] = F.when(first, F.col(x) / (1 - d)).when(known, F.col(x)).otherwise(0.0).cast("double")
            scans |= {f"_sn_{n}": (f"_n_{n}", d)}
            value = (1 - d) * F.col(f"_sn_{n}")
        final[n] = F.when(F.col(f"_seen_{n}") >= max(least, 1), value)
        extra += [f"_seen_{n}", f"_n_{n}", f"_p_{n}", f"_sn_{n}", f"_sp_{n}"]
    return affine_scan(df.withColumns(new), scans).withColumns(final).drop(*extra)


def momentum_study(df: DataFrame, n: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """``rsi_ewm``, ``macd_hist``, ``macd_adjusted``, ``atr_ewm`` and ``atr_adjusted`` in two scans; needs ``delta`` and ``tr``.

    RSI takes adjusted means of up and down moves and is 50 until ``n`` moves
    are known. The histogram and the range come with and without adjustment.
    """
    up = F.when(F.col("delta").isNotNull(), F.greatest("delta", F.lit(0.0)))
    down = F.when(F.col("delta").isNotNull(), F.greatest(-F.col("delta"), F.lit(0.0)))
    first = {k: {"x": x, "alpha": 1 / n, "min_periods": n} for k, x in (("_eu", "_u"), ("_ed", "_dn"))}
    first |= {"atr_ewm": {"x": "tr", "alpha": 1 / n, "adjust": False}, "atr_adjusted": {"x": "tr", "alpha": 1 / n}}
    first |= {f"_{k}{int(a)}": {"x": "close", "span": span, "adjust": a} for k, span in (("f", fast), ("s", slow)) for a in (False, True)}
    df = ewm_means(df.withColumns({"_u": up, "_dn": down}), first)
    df = df.withColumns({f"_m{a}": F.col(f"_f{a}") - F.col(f"_s{a}") for a in (0, 1)})
    df = ewm_means(df, {f"_g{a}": {"x": f"_m{a}", "span": signal, "adjust": bool(a)} for a in (0, 1)})
    rsi = 100 - 100 / (1 + F.col("_eu") / (F.col("_ed") + 1e-6))
    df = df.withColumns({"rsi_ewm": F.coalesce(rsi, F.lit(50.0)), "macd_hist": F.col("_m0") - F.col("_g0"), "macd_adjusted": F.col("_m1") - F.col("_g1")})
    return df.drop("_u", "_dn", "_eu", "_ed", *[f"_{k}{a}" for k in "fsmg" for a in (0, 1)])


def time_decay_weights(df: DataFrame, decay: float = 0.95) -> DataFrame:
    """``decay_weight``: powers of ``decay`` by age, normalised per symbol in closed form."""
    if "idx" not in df.columns:
        df = number_rows(df)
    count = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    total = (1 - F.pow(F.lit(decay), F.col("_n"))) / (1 - decay)
    return df.join(count, KEY).withColumn("decay_weight", F.pow(F.lit(decay), F.col("_n") - 1 - F.col("idx")) / total).drop("_n")
