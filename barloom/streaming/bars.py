"""Bars from a stream of ticks: tumbling windows behind a watermark, or bars that late ticks correct."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues


def stream_bars(ticks: DataFrame, symbol: Column, ts: Column, price: Column, tie: list[Column], seconds: int, late: str = "10 minutes") -> DataFrame:
    """The bars of ``bars_from_ticks`` on a streaming frame; append mode emits a bar once its window is past the watermark."""
    rows = ticks.select(symbol.cast("string").alias("symbol"), ts.cast("timestamp").alias("t"), price.cast("double").alias("p"), F.struct(ts.cast("timestamp"), *tie).alias("at"))
    bars = rows.withWatermark("t", late).groupBy("symbol", F.window("t", f"{seconds} seconds").alias("w"))
    out = bars.agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close")


#: What a bar is known by between batches: the first and last tick with their prices, the extremes, the ticks, and those that came after the bar was first shown.
_STATE = "first_at long, first_tie long, open double, high double, low double, last_at long, last_tie long, close double, ticks long, late long, version long"
_SHOWN = "symbol string, ts timestamp, open double, high double, low double, close double, ticks long, late long, version long"


class _CorrectedBars(StatefulProcessor):
    """State of one bar: ticks merge into it whenever they come, and each batch that changes it shows it again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bar = handle.getValueState("bar", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        old = self.bar.get() if self.bar.exists() else None
        first, last, high, low, ticks = None, None, -math.inf, math.inf, 0
        if old is not None:
            first, last, high, low, ticks = (old[0], old[1], old[2]), (old[5], old[6], old[7]), old[3], old[4], old[8]
        late, version = (0, 0) if old is None else (old[9], old[10])
        for pdf in rows:
            ordered = pdf.sort_values(["at", "tie"])
            ends = [(int(r["at"]), int(r["tie"]), float(r["price"])) for r in (ordered.iloc[0], ordered.iloc[-1])]
            first = ends[0] if first is None else min(first, ends[0])
            last = ends[1] if last is None else max(last, ends[1])
            high, low, ticks = max(high, float(pdf["price"].max())), min(low, float(pdf["price"].min())), ticks + len(pdf)
            late += len(pdf) if old is not None else 0
        self.bar.update((first[0], first[1], first[2], high, low, last[0], last[1], last[2], ticks, late, version + 1))
        yield pd.DataFrame({"symbol": [key[0]], "ts": [key[1]], "open": [first[2]], "high": [high], "low": [low], "close": [last[2]], "ticks": [ticks], "late": [late], "version": [version + 1]})

    def close(self) -> None:
        pass


def corrected_bars(ticks: DataFrame, symbol: Column, ts: Column, price: Column, tie: Column, seconds: int) -> DataFrame:
    """Bars of a stream of ticks that may come in any order: a bar is shown again, with a higher ``version``, by each batch that changes it.

    ``ticks`` counts the ticks of a bar, and ``late`` those that came after it
    was first shown. ``tie`` is a number that orders ticks of one time. The state
    of a bar is one row in RocksDB, which the session has to name as its state
    store. Ticks without time or price are left out.
    """
    at = ts.cast("timestamp")
    start = F.timestamp_seconds(F.floor(F.unix_seconds(at) / seconds) * seconds)
    rows = ticks.select(symbol.cast("string").alias("symbol"), start.alias("ts"), F.unix_micros(at).alias("at"), tie.cast("long").alias("tie"), price.cast("double").alias("price")).where("at is not null and price is not null")
    return rows.groupBy("symbol", "ts").transformWithStateInPandas(_CorrectedBars(), _SHOWN, outputMode="Update", timeMode="None")


def latest_bars(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream of :func:`corrected_bars` over what there is, and return the last version of each bar.

    Shown bars are appended to a table below ``folder``, with the stream's
    progress beside it, so a run that is started again goes on.
    """
    spark = stream.sparkSession
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
        query.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/shown/batch={batch}")).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    shown = spark.read.parquet(f"{folder}/shown")
    names = ["open", "high", "low", "close", "ticks", "late"]
    return shown.groupBy("symbol", "ts").agg(F.max_by(F.struct(*names), "version").alias("b")).select("symbol", "ts", "b.*")
