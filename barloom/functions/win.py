"""Window and arithmetic helpers shared by the bar operators.

Missing values are NULL, never NaN. A rolling value is NULL until its window is
full and free of NULLs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TIME = "symbol", "ts"


def ordered() -> WindowSpec:
    """All rows of a symbol in time order."""
    return Window.partitionBy(KEY).orderBy(TIME)


def last_rows(n: int) -> WindowSpec:
    """The current row and the ``n - 1`` before it."""
    return ordered().rowsBetween(-(n - 1), 0)


def whole() -> WindowSpec:
    return Window.partitionBy(KEY)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(col(x), k).over(ordered())


def lead(x: str | Column, k: int = 1) -> Column:
    return F.lead(col(x), k).over(ordered())


def full(agg: Callable[[Column], Column], x: str | Column, n: int) -> Column:
    """``agg`` over the last ``n`` rows, NULL unless all ``n`` are there and not NULL."""
    w = last_rows(n)
    return F.when(F.count(col(x)).over(w) == n, agg(col(x)).over(w))


def div(a: Column, b: Column) -> Column:
    """Division that gives NULL for a zero divisor."""
    return F.try_divide(a, b)


def correlation(a: Column, b: Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of the pairs without NULLs; NULL where a side does not vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    wide = lambda c: c.over(over) if over is not None else c
    sx, sy = wide(F.stddev_pop(x)), wide(F.stddev_pop(y))
    return F.when((sx > 1e-12) & (sy > 1e-12), F.try_divide(wide(F.covar_pop(x, y)), sx * sy))


def flag(cond: Column) -> Column:
    """1 or 0; unknown counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def spread_rows(df: DataFrame) -> DataFrame:
    """One exchange by symbol, which all later windows of the symbol reuse."""
    return df.repartition(KEY)


def presented(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """Symbol, time in epoch seconds and the named columns, doubles rounded."""
    kinds = dict(df.dtypes)
    out = [(F.round(n, digits) + F.lit(0.0)).alias(n) if kinds[n] == "double" else F.col(n) for n in names]
    return df.select(KEY, F.unix_seconds(TIME).alias(TIME), *out)
