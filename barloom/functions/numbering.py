"""Row numbers of long series without one task per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .win import KEY, TIME


def number_rows(df: DataFrame, name: str = "idx", seconds: int = 30 * 86_400, stretch: Column | None = None) -> DataFrame:
    """Adds the 0-based position of each row in its symbol.

    Rows are counted per (symbol, stretch of time); stretch counts are summed
    up, and rows are numbered inside a stretch, so a long series is spread over
    as many tasks as it has stretches. ``stretch`` cuts by another column, which
    must not fall in the order of ``ts``.
    """
    cut = df.withColumn("_stretch", F.floor(F.unix_seconds(TIME) / seconds) if stretch is None else stretch)
    counts = cut.groupBy(KEY, "_stretch").count()
    before = Window.partitionBy(KEY).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(KEY, "_stretch", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(KEY, "_stretch").orderBy(TIME)) - 1
    return cut.withColumn("_inside", inside).join(counts, [KEY, "_stretch"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_stretch", "_before", "_inside")


def halo_blocks(df: DataFrame, look_back: int, block: int) -> DataFrame:
    """Cuts every symbol into blocks of ``block`` rows, each led by the ``look_back`` rows before it.

    The result has ``_block`` and ``_halo``; operators with a fixed look-back
    run per (symbol, block), and rows with ``_halo`` are dropped afterwards.
    ``block`` must be at least ``look_back``.
    """
    if block < look_back:
        raise ValueError("block must be at least look_back")
    rows = number_rows(df)
    own = F.floor(F.col("idx") / block)
    tail = F.col("idx") % block >= block - look_back
    blocks = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("_own", own).withColumn("_block", F.explode(blocks)).withColumn("_halo", F.col("_block") > F.col("_own")).drop("_own", "idx")


def in_blocks(df: DataFrame, operator, look_back: int, block: int = 100_000) -> DataFrame:
    """``operator`` on halo blocks: the same rows as on whole series, many tasks for a long one."""
    parts = halo_blocks(df, look_back, block)
    key = F.concat_ws("\x1f", F.col(KEY), F.col("_block").cast("string"))
    keyed = parts.withColumn("_symbol", F.col(KEY)).withColumn(KEY, key)
    done = operator(keyed.drop("_block")).where(~F.col("_halo"))
    return done.withColumn(KEY, F.col("_symbol")).drop("_symbol", "_halo")
