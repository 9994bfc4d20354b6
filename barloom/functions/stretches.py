"""Neighbouring rows and sliding windows of long series, by stretches: no task holds a whole symbol."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import halo_blocks
from .win import KEY, TIME

#: Seconds of a stretch by default.
SECONDS = 30 * 86_400
#: Windows that are laid out as a matrix at a time.
MATRIX_ROWS = 4096


def stretch(seconds: int = SECONDS) -> Column:
    return F.floor(F.unix_seconds(TIME) / seconds)


def with_previous(df: DataFrame, columns: dict[str, str], seconds: int = SECONDS, after: bool = False) -> DataFrame:
    """Adds ``name: x``, the value of ``x`` one row before, and ``_first``, true for the first row of a symbol; ``after`` looks the other way.

    Rows look back inside their stretch of time; its first row gets the last
    values of the stretch before, of which there is one row each.
    """
    beside, nearest = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    inside = Window.partitionBy(KEY, "_stretch").orderBy(TIME)
    now = F.struct(*[F.col(x).alias(n) for n, x in columns.items()])
    cut = df.withColumn("_stretch", stretch(seconds)).withColumn("_now", now)
    cut = cut.withColumn("_before", beside("_now").over(inside))
    lasts = cut.groupBy(KEY, "_stretch").agg(nearest("_now", TIME).alias("_last"))
    carried = lasts.select(KEY, "_stretch", beside("_last").over(Window.partitionBy(KEY).orderBy("_stretch")).alias("_carried"))
    joined = cut.join(carried, [KEY, "_stretch"]).withColumn("_before", F.coalesce("_before", "_carried"))
    return joined.withColumns({n: F.col(f"_before.{n}") for n in columns} | {"_first": F.col("_before").isNull()}).drop("_stretch", "_now", "_before", "_carried")


def over_windows(df: DataFrame, x: str, n: int, f: Callable[[np.ndarray], np.ndarray], name: str, before: int = 0, block: int = 16_384) -> DataFrame:
    """``(symbol, ts, name)``: ``f`` of the ``n`` values of ``x`` that end ``before`` rows before each row, as rows of a matrix.

    NULL where a window is short or holds a NULL, or where ``f`` gives NaN. A
    symbol is cut into blocks with the rows before them, each one array, and
    windows are views of it.
    """
    look_back = n - 1 + before
    rows = halo_blocks(df.select(KEY, TIME, F.col(x).cast("double").alias("_v")), look_back, max(block, look_back))
    items = F.array_sort(F.collect_list(F.struct(TIME, "_halo", "_v")))
    arrays = rows.groupBy(KEY, "_block").agg(items.alias("r")).select(KEY, F.col(f"r.{TIME}").alias(TIME), F.size(F.filter("r", lambda r: r["_halo"])).alias("halo"), F.col("r._v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times, values = batch.column(TIME), batch.column("v")
            for i, (symbol, halo) in enumerate(zip(batch.column(KEY).to_pylist(), batch.column("halo").to_pylist(), strict=True)):
                v = values[i].values.to_numpy(zero_copy_only=False).astype(float)  # null as NaN
                if halo == len(v):  # behind the last block
                    continue
                out = np.full(len(v), np.nan)
                if len(v) > look_back:
                    windows = sliding_window_view(v, n)[: len(v) - look_back]
                    known = ~np.isnan(windows.sum(axis=1))
                    for lo in range(0, len(windows), MATRIX_ROWS):
                        at = lo + np.flatnonzero(known[lo : lo + MATRIX_ROWS])
                        if len(at):
                            out[look_back + at] = f(windows[at])
                result = pa.array(out[halo:], mask=np.isnan(out[halo:]))
                yield pa.RecordBatch.from_arrays([pa.array([symbol] * len(result)), times[i].values[halo:], result], names=[KEY, TIME, name])

    return arrays.mapInArrow(run, f"{KEY} string, {TIME} timestamp, {name} double")


def window_vectors(df: DataFrame, names: list[str], label: str, n: int, stride: int = 1, block: int = 4096) -> DataFrame:
    """``(symbol, ts, label, x)``: the named values of the ``n`` rows before each ``stride``-th row, oldest first, as one array.

    Rows without ``n`` rows before them are left out. A symbol is cut into blocks
    with the rows before them, each one array, from which a window is written
    when it is asked for: an array takes ``8 n len(names)`` bytes.
    """
    size = -(-max(block, n) // stride) * stride
    values = F.array(*[F.col(c).cast("double") for c in names])
    rows = halo_blocks(df.select(KEY, TIME, F.col(label).alias("label"), values.alias("_v")), n, size)
    items = F.array_sort(F.collect_list(F.struct(TIME, "_halo", "_v", "label")))
    arrays = rows.groupBy(KEY, "_block").agg(items.alias("r")).select(KEY, F.col(f"r.{TIME}").alias(TIME), F.size(F.filter("r", lambda r: r["_halo"])).alias("halo"), F.flatten("r._v").alias("v"), F.col("r.label").alias("label"))
    kind = arrays.schema["label"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times, values, labels = (batch.column(c) for c in (TIME, "v", "label"))
            for i, (symbol, halo) in enumerate(zip(batch.column(KEY).to_pylist(), batch.column("halo").to_pylist(), strict=True)):
                v = values[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(names))
                at = np.arange(halo, len(v), stride)
                at = at[at >= n]
                for lo in range(0, len(at), 256):
                    some = at[lo : lo + 256]
                    x = np.stack([v[t - n : t].ravel() for t in some])
                    offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * x.shape[1])
                    pick = pa.array(some)
                    yield pa.RecordBatch.from_arrays([pa.array([symbol] * len(some)), times[i].values.take(pick), labels[i].values.take(pick), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=[KEY, TIME, "label", "x"])

    return arrays.mapInArrow(run, f"{KEY} string, {TIME} timestamp, label {kind.simpleString()}, x array<double>")
