"""Walk-forward test of hidden-state positions: a model for each fold, trained on the rows before it.

Rows are neither copied to later folds nor trained on again for each. The rows
before the first fold give one set of expected counts; every later stretch of
rows adds its own, taken under the model of the fold behind it, which knows no
later row. A running sum over the folds then fits the models of all folds at a
time, and a few passes settle them. The state before each stretch is carried by
:mod:`.chains`, so folds are independent groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import arrow_batches, written
from ..functions.win import KEY, TIME, flag
from . import hmm
from .chains import carries, smoothed, transfer

_FOLD = [KEY, "fold"]


def _scaled(df: DataFrame, names: list[str], frac: float, stride: int) -> DataFrame:
    """``df`` with its ``fold`` (-1 for rows that only train), features scaled by the statistics of those rows."""
    first = F.floor(F.col("n") * frac)
    rows = df.select(KEY, TIME, "idx", "n", "fwd", *names).dropna(subset=names)
    rows = rows.withColumn("fold", F.greatest(F.floor((F.col("idx") - first) / stride), F.lit(-1).cast("long")))
    stats = rows.where("fold < 0").groupBy(KEY).agg(*[f(c).alias(f"_{p}_{c}") for c in names for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(1e-9)) for c in names}
    return rows.join(stats, KEY).withColumns(scaled).drop(*[f"_{p}_{c}" for c in names for p in "ms"])


def _matrices(asked: DataFrame, shape: hmm.Shape) -> DataFrame:
    """The product of the steps of each row of ``asked(symbol, fold, x, params)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for flat, x in hmm._rows_of(batch, "params", "x"):
                model = shape.model(flat)
                out.append(transfer(model.move, hmm.emissions(model, x.reshape(-1, shape.d))[0], False).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column("fold"), pa.array(out, pa.list_(pa.float64()))], names=[*_FOLD, "matrix"])

    out = asked.select(*_FOLD, "x", "params").mapInArrow(run, f"{KEY} string, fold long, matrix array<double>")
    return out.select(F.lit("").alias("model"), KEY, F.col("fold").alias("unit"), "matrix")


def _before(folds: DataFrame, params: DataFrame, ends: DataFrame, shape: hmm.Shape) -> DataFrame:
    """``folds`` with the parameters of ``params(symbol, fold, params)`` and the probabilities of states ahead of each."""
    asked = written(folds.join(params, _FOLD), "asked")
    known = carries(written(_matrices(asked, shape), "matrices"), ends, shape.k)
    return asked.join(known.select(KEY, F.col("unit").alias("fold"), "before"), _FOLD)


def _last_filter(blocks: DataFrame, units: DataFrame, models: DataFrame, shape: hmm.Shape) -> DataFrame:
    """``(model, symbol, before, after)``: the probabilities of states behind the rows before the first fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for flat, unit, x, before in hmm._rows_of(batch, "params", "unit", "x", "before"):
                model = shape.model(flat)
                out.append((before @ transfer(model.move, hmm.emissions(model, x.reshape(-1, shape.d))[0], unit == 0)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.array(out, pa.list_(pa.float64()))], names=[KEY, "before"])

    last = hmm._carried(blocks, units, models, shape).where("unit = units - 1")
    out = blocks.join(last.select("model", KEY, "unit", "params", "before"), ["model", KEY, "unit"]).mapInArrow(run, f"{KEY} string, before array<double>")
    return out.select(F.lit("").alias("model"), KEY, "before", F.array(*[F.lit(1.0)] * shape.k).alias("after"))


def _fold_models(folds: DataFrame, grid: DataFrame, base: DataFrame, models: DataFrame, ends: DataFrame, shape: hmm.Shape, passes: int) -> DataFrame:
    """``(symbol, fold, params)``: the model of each fold of ``grid``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shape.counts(shape.model(f), x.reshape(-1, shape.d), False, b, np.ones(shape.k)).tolist() for f, x, b in hmm._rows_of(batch, "params", "x", "before")]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column("fold"), pa.array(out, pa.list_(pa.float64()))], names=[*_FOLD, "sums"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shape.maximised(shape.model(f), sums, 0.0)[0].flat().tolist() for f, sums in hmm._rows_of(batch, "params", "sums")]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column("fold"), pa.array(out, pa.list_(pa.float64()))], names=[*_FOLD, "params"])

    now = grid.join(models.select(F.col("model").alias(KEY), "params"), KEY).select(*_FOLD, "params")
    first = base.select(F.col("model").alias(KEY), F.lit(-1).cast("long").alias("fold"), "sums")
    empty = grid.join(base.select(F.col("model").alias(KEY), F.transform("sums", lambda v: F.lit(0.0)).alias("sums")), KEY)
    upto = Window.partitionBy(KEY, "i").orderBy("fold").rangeBetween(Window.unboundedPreceding, -1)
    for _ in range(passes):
        behind = now.where("fold > 0").withColumn("fold", F.col("fold") - 1)  # the model of the fold behind a stretch
        added = _before(folds, behind, ends, shape).select(*_FOLD, "params", "x", "before").mapInArrow(counted, f"{KEY} string, fold long, sums array<double>")
        parts = first.unionByName(added).withColumn("own", F.lit(False)).unionByName(empty.select(*_FOLD, "sums").withColumn("own", F.lit(True)))
        single = parts.select(*_FOLD, "own", F.posexplode("sums").alias("i", "v")).withColumn("v", F.sum("v").over(upto)).where("own")
        total = single.groupBy(*_FOLD).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("sums"))
        now = written(total.join(now, _FOLD).mapInArrow(fitted, f"{KEY} string, fold long, params array<double>"), "folds")
    return now


def _filtered(known: DataFrame, shape: hmm.Shape) -> DataFrame:
    """``(symbol, fold, ts, state)``: the state of each row of a fold by the rows up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = batch.column(TIME)
            for i, (symbol, fold, flat, x, before) in enumerate(hmm._rows_of(batch, KEY, "fold", "params", "x", "before")):
                model = shape.model(flat)
                b, _ = hmm.emissions(model, x.reshape(-1, shape.d))
                state = smoothed(model.move, b, False, before, np.ones(shape.k))[0].argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([symbol] * len(b)), pa.array([fold] * len(b)), times[i].values, pa.array(state.astype(np.int32))], names=[*_FOLD, TIME, "state"])

    return known.select(*_FOLD, "params", "x", "before", TIME).mapInArrow(run, f"{KEY} string, fold long, {TIME} timestamp, state int")


def fold_sides(states: DataFrame, grid: DataFrame, k: int, frac: float, stride: int, horizon: int) -> DataFrame:
    """``(symbol, fold, buy, sell)``: states of highest and lowest mean return among the rows whose return a fold knows; ties to the smaller state."""
    seen = F.ceil((F.col("idx") + 1 + horizon - F.floor(F.col("n") * frac)) / stride)
    told = states.where("fwd is not null").withColumn("fold", F.greatest(seen, F.lit(0).cast("long")))
    sums = told.groupBy(*_FOLD, "state").agg(F.sum("fwd").alias("sum"), F.count(F.lit(1)).alias("m"), F.lit(False).alias("own"))
    places = grid.withColumn("state", F.explode(F.array(*[F.lit(i) for i in range(k)]))).select(*_FOLD, "state", F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("m"), F.lit(True).alias("own"))
    upto = Window.partitionBy(KEY, "state").orderBy("fold").rangeBetween(Window.unboundedPreceding, 0)
    mean = F.try_divide(F.sum("sum").over(upto), F.sum("m").over(upto))
    known = sums.unionByName(places).withColumn("mean", mean).where("own and mean is not null")
    return known.groupBy(*_FOLD).agg(F.max_by("state", F.struct("mean", -F.col("state"))).alias("buy"), F.min_by("state", F.struct("mean", "state")).alias("sell"))


def walk_forward(df: DataFrame, names: list[str], frac: float = 0.7, stride: int = 20, k: int = 3, band: float = 0.002, horizon: int = 3, passes: int = 3, least: int = 10) -> DataFrame:
    """``(symbol, ts, prediction, label)`` of the rows after ``frac``, in folds of ``stride`` rows, each with a model of its own.

    ``df`` has ``idx`` and ``n``, the place of a row and the rows of its symbol.
    Scaling, models and the map from states to sides come from rows before a
    fold, of which the last ``horizon`` have no known return yet; a row's state
    comes from the rows up to it. The rows before the first fold are fitted to
    a tolerance, and folds start from that model; ``passes`` settle them. Work
    grows with the rows, whatever the stride. A symbol of fewer than ``least``
    rows for each state before its first fold has no positions.
    """
    shape = hmm.Shape(k, len(names), "full")
    if stride > hmm.BLOCK:
        raise ValueError(f"folds have at most {hmm.BLOCK} rows")
    with arrow_batches(df.sparkSession, hmm.BATCH):
        rows = written(_scaled(df, names, frac, stride), "walk")
        train = rows.where("fold < 0")
        starts = hmm.start_models(train, names, shape, model=F.col(KEY), least=least)
        blocks, units = hmm.series_blocks(train, names, model=F.col(KEY))
        models = hmm.em(blocks, units, starts, shape)
        base = written(hmm.expected_counts(blocks, units, models, shape), "base")
        ends = written(_last_filter(blocks, units, models, shape), "ends")
        kept = F.array_sort(F.collect_list(F.struct("idx", TIME, F.array(*names).alias("x"))))
        folds = rows.where("fold >= 0").groupBy(*_FOLD).agg(kept.alias("r")).select(*_FOLD, F.col(f"r.{TIME}").alias(TIME), F.flatten("r.x").alias("x"))
        folds = written(folds, "folds")
        grid = written(folds.groupBy(KEY).agg(F.max("fold").alias("last")).select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("fold")), "grid")
        fitted = _fold_models(folds, grid, base, models, ends, shape, passes)
        ahead = _filtered(_before(folds, fitted, ends, shape), shape).drop("fold")
        before = hmm.states_of(blocks, units, models, shape).select(KEY, TIME, F.col("filtered").alias("state"))
        states = written(rows.join(ahead.unionByName(before), [KEY, TIME]).select(KEY, TIME, "idx", "n", "fwd", "fold", "state"), "states")
    sides = fold_sides(states, grid, k, frac, stride, horizon)
    placed = states.where("fold >= 0").join(sides, _FOLD, "left")
    position = (flag(F.col("state") == F.col("buy")) - flag(F.col("state") == F.col("sell"))).alias("prediction")
    out = rows.where("fold >= 0").join(placed.select(KEY, TIME, position), [KEY, TIME], "left")
    label = F.when(F.col("fwd") > band, 1).when(F.col("fwd") < -band, -1).when(F.col("fwd").isNotNull(), 0)
    return out.select(KEY, TIME, F.coalesce("prediction", F.lit(0)).alias("prediction"), label.alias("label"))
