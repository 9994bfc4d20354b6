"""The median slope over all pairs of rows of a series, by counting slopes instead of forming them.

A pair of rows has a slope of at most ``m`` when ``y - m idx`` does not rise
between them, so the slopes below ``m`` are the inversions of that series. They
are counted apart for pairs inside a block of rows, for pairs inside a range of
values, and, from the number of rows in each block and range alone, for all
others. A round counts for several ``m`` at a time and keeps the gap that holds
the median, down to the last digits of a double. Work grows with the rows, and
no task holds more than a block or a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import number_rows
from ..functions.tables import arrow_batches, written
from ..functions.win import KEY

#: Least rows of a block; a series of one block has its slopes taken directly.
BLOCK = 2048
#: Blocks of a series at most, so that blocks of very long series grow.
BLOCKS = 1024
#: Slopes that a round counts for, in each gap.
PROBES = 15
#: Rows of a series by which ranges of values are chosen, for each block.
SAMPLE = 4

_EPS = float(np.finfo(float).eps)


def inversions(unit: np.ndarray, z: np.ndarray, weight: np.ndarray, strict: bool = False) -> int:
    """Summed ``weight_a * weight_b`` of pairs with ``unit_a < unit_b`` and ``z_b <= z_a``, or ``z_b < z_a``.

    Units are halved time and again, and each half is looked up in its sorted
    other half.
    """
    rank = np.unique(z, return_inverse=True)[1] + 1
    width = np.int64(rank.max(initial=0) + 2)
    unit = unit - unit.min(initial=0)
    order = np.argsort(rank, kind="stable")
    unit, rank, weight = unit[order].astype(np.int64), rank[order].astype(np.int64), weight[order].astype(np.int64)
    total = 0
    while len(unit) and unit.max() > 0:
        parent, right = unit >> 1, unit & 1 == 1
        key = parent * width + rank
        by = np.argsort(key[~right], kind="stable")
        left, held = key[~right][by], np.append(0, np.cumsum(weight[~right][by]))
        ends = held[np.searchsorted(left, (parent[right] + 1) * width)]
        below = held[np.searchsorted(left, key[right] + (1 if strict else 0))]
        total += int(((ends - below) * weight[right]).sum())
        unit = parent
    return total


def _direct(y: np.ndarray) -> float | None:
    i, j = np.triu_indices(len(y), 1)
    return float(np.median((y[j] - y[i]) / (j - i))) if len(i) else None


def _ranges(y: np.ndarray, at: np.ndarray, m: float, many: int) -> np.ndarray:
    """Bounds of about equally full ranges of ``y - m at``."""
    z = np.sort(y - m * at)
    return np.unique(z[np.arange(1, many) * len(z) // many])


def _counted(blocks: DataFrame, probes: DataFrame) -> DataFrame:
    """``(symbol, m, count)``: slopes of at most ``m``, for each of ``probes(symbol, ms, sample, places, units)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for symbol, unit, first, y, ms, sample, places, units in zip(*(batch.column(c).to_pylist() for c in (KEY, "unit", "first", "y", "ms", "sample", "places", "units")), strict=True):
                y, sample, places = np.array(y), np.array(sample), np.array(places)
                at = first + np.arange(len(y))
                rows = []
                for m in ms:
                    z = y - m * at
                    rows.append((m, -1, None, None, inversions(np.arange(len(z)), z, np.ones(len(z), dtype=np.int64))))
                    values, count = np.unique(z, return_counts=True)  # equal values travel as one
                    part = np.searchsorted(_ranges(sample, places, m, units), values, side="right")
                    for lo, hi in zip(*_stretches(part), strict=True):
                        rows.append((m, int(part[lo]), values[lo:hi].tolist(), count[lo:hi].tolist(), int(count[lo:hi].sum())))
                m, part, values, count, n = zip(*rows, strict=True)
                columns = [pa.array([symbol] * len(m)), pa.array([unit] * len(m), pa.int64()), pa.array(m, pa.float64()), pa.array(part, pa.int64()), pa.array(values, pa.list_(pa.float64())), pa.array(count, pa.list_(pa.int64())), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[KEY, "unit", "m", "part", "z", "w", "n"])

    def in_range(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = np.repeat(pdf["unit"].to_numpy(), pdf["z"].map(len).to_numpy())
        n = inversions(unit, np.concatenate(pdf["z"].to_list()), np.concatenate(pdf["w"].to_list()))
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "m": [pdf["m"].iloc[0]], "n": [n]})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        n = inversions(pdf["unit"].to_numpy(), pdf["part"].to_numpy(), pdf["n"].to_numpy(), strict=True)
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "m": [pdf["m"].iloc[0]], "n": [n]})

    told = written(blocks.join(probes, KEY).mapInArrow(run, f"{KEY} string, unit long, m double, part long, z array<double>, w array<long>, n long"), "probes")
    here = told.where("part < 0").select(KEY, "m", "n")
    schema = f"{KEY} string, m double, n long"
    near = told.where("part >= 0").groupBy(KEY, "m", "part").applyInPandas(in_range, schema)
    far = told.where("part >= 0").select(KEY, "m", "unit", "part", "n").groupBy(KEY, "m").applyInPandas(across, schema)  # BLOCKS x BLOCKS numbers at most
    return here.unionByName(near).unionByName(far).groupBy(KEY, "m").agg(F.sum("n").alias("count"))


def _stretches(values: np.ndarray) -> tuple[list[int], list[int]]:
    cuts = (np.flatnonzero(np.diff(values)) + 1).tolist()
    return [0, *cuts], [*cuts, len(values)]


def theil_sen(df: DataFrame, x: str = "close", rounds: int = 40) -> DataFrame:
    """``(symbol, slope)``: the median slope over all pairs of each symbol's rows, one row apart counting as 1.

    Rows with a NULL value are left out; a symbol of one row has a NULL slope.
    The slope of a series of over ``BLOCK`` rows is found to the last digits of
    ``y - slope idx`` in a double.
    """
    spark = df.sparkSession
    rows = number_rows(df.where(F.col(x).isNotNull())).select(KEY, "idx", F.col(x).cast("double").alias("y"))
    rows = written(rows, "numbered")
    sizes = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("y")).alias("most"))
    sizes = sizes.withColumn("size", F.greatest(F.lit(BLOCK).cast("long"), F.ceil(F.col("n") / BLOCKS)))
    cut = rows.join(sizes.select(KEY, "size", "n"), KEY).withColumn("unit", F.floor(F.col("idx") / F.col("size")))
    kept = F.transform(F.array_sort(F.collect_list(F.struct("idx", "y"))), lambda r: r["y"]).alias("y")
    blocks = written(cut.groupBy(KEY, "unit", "n", "size").agg(kept, F.min("idx").alias("first")), "blocks")

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slopes = [_direct(np.array(y)) for y in batch.column("y").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.array(slopes, pa.float64())], names=[KEY, "slope"])

    with arrow_batches(spark, 16):
        out = written(blocks.where("n <= size").select(KEY, "y").mapInArrow(direct, f"{KEY} string, slope double"), "slopes")
        long = sizes.where("n > size")
        if long.isEmpty():
            return out
        blocks = blocks.where("n > size").select(KEY, "unit", "first", "y")
        many = F.ceil(F.col("n") / F.col("size"))
        some = rows.join(long, KEY).where(F.col("idx") % F.greatest(F.floor(F.col("n") / (SAMPLE * many)), F.lit(1)) == 0)
        some = some.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("idx", "y"))).alias("s"), F.first(many).alias("units"))
        some = written(some.select(KEY, F.col("s.y").alias("sample"), F.col("s.idx").cast("array<double>").alias("places"), "units"), "sample")
        after = rows.select(KEY, (F.col("idx") - 1).alias("idx"), F.col("y").alias("next"))
        steps = rows.join(long.select(KEY), KEY).join(after, [KEY, "idx"]).groupBy(KEY).agg(F.min(F.col("next") - F.col("y")).alias("lo"), F.max(F.col("next") - F.col("y")).alias("hi"))
        # no pair is steeper than the steepest step; the two middle places of all pairs, from 1
        ends = long.join(steps, KEY).withColumn("slack", F.lit(_EPS) * (F.col("most") + F.col("n") * F.greatest(F.abs("lo"), F.abs("hi"))))
        wanted = F.explode(F.array(F.expr("(n * (n - 1) div 2 + 1) div 2"), F.expr("n * (n - 1) div 2 div 2 + 1"))).alias("place")
        gaps = ends.select(KEY, "n", "most", (F.col("lo") - F.col("slack")).alias("lo"), (F.col("hi") + F.col("slack")).alias("hi"), wanted).distinct()
        gaps, found = written(gaps, "gaps"), []
        for _ in range(rounds):
            fine = F.greatest(F.lit(_EPS) * F.greatest(F.abs("lo"), F.abs("hi")), F.lit(_EPS) * F.col("most") / F.col("n"))
            narrow = F.col("hi") - F.col("lo") <= 2 * fine
            found.append(gaps.where(narrow).select(KEY, "place", "hi"))
            gaps = gaps.where(~narrow)
            if gaps.isEmpty():
                break
            m = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("p") / (PROBES + 1)
            asked = gaps.withColumn("p", F.explode(F.array(*[F.lit(p) for p in range(1, PROBES + 1)]))).withColumn("m", m)
            counts = written(_counted(blocks, asked.groupBy(KEY).agg(F.collect_set("m").alias("ms")).join(some, KEY)), "counts")
            told = asked.join(counts, [KEY, "m"]).groupBy(KEY, "n", "most", "lo", "hi", "place").agg(
                F.max(F.when(F.col("count") < F.col("place"), F.col("m"))).alias("under"), F.min(F.when(F.col("count") >= F.col("place"), F.col("m"))).alias("over")
            )
            gaps = written(told.select(KEY, "n", "most", F.coalesce("under", "lo").alias("lo"), F.coalesce("over", "hi").alias("hi"), "place"), "gaps")
        else:
            raise RuntimeError(f"slopes were not settled in {rounds} rounds")
    both = found[0]
    for part in found[1:]:
        both = both.unionByName(part)
    return out.unionByName(both.groupBy(KEY).agg(F.avg("hi").alias("slope")))
