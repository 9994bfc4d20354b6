"""Hidden Markov models over series of any length, fitted by expectation-maximisation in Spark.

A series is cut into stretches of ``BLOCK`` rows, each one row of a table that is
bucketed once and never moves again. A pass multiplies the steps of each stretch
(:mod:`.chains`), carries the states before and behind the stretches along their
series, takes expected counts of every stretch, and sums them up by model. Models
are rows of a table too, so any number of them is fitted at a time: one for all
series, or one for each. A model whose data are one stretch is fitted where that
lies, with the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import number_rows
from ..functions.tables import arrow_batches, bucketed, written
from ..functions.win import KEY, TIME
from . import categories
from .chains import best_path, best_transfer, carries, smoothed, transfer

FLOOR = 1e-6
#: Rows of a stretch.
BLOCK = 2048
#: Stretches in a batch that a Python worker is handed.
BATCH = 64

_UNIT = ["model", KEY, "unit"]


@dataclass
class Model:
    """Start and transition probabilities with Gaussian means and covariances, or symbol probabilities in ``emit``."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray | None = None
    cov: np.ndarray | None = None
    emit: np.ndarray | None = None
    log_likelihood: float = -np.inf

    def log_emission(self, x: np.ndarray) -> np.ndarray:
        if self.emit is not None:
            return np.log(self.emit[:, x[:, 0].astype(int)].T)
        out = np.empty((len(x), len(self.start)))
        for k in range(len(self.start)):
            low = np.linalg.cholesky(self.cov[k])
            z = np.linalg.solve(low, (x - self.mean[k]).T)
            out[:, k] = -0.5 * ((z**2).sum(axis=0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(low)).sum()
        return out

    def flat(self) -> np.ndarray:
        rest = [self.emit] if self.emit is not None else [self.mean, self.cov]
        return np.concatenate([[self.log_likelihood], self.start, *(np.ravel(p) for p in (self.move, *rest))])


@dataclass
class Shape:
    """What the numbers of a model and of its expected counts mean: ``k`` states over ``d`` features, or over ``symbols``."""

    k: int
    d: int = 1
    cov: str = "diag"
    symbols: int = 0

    def model(self, flat: np.ndarray) -> Model:
        k, d = self.k, self.d
        log, start, move, rest = np.split(np.asarray(flat, float), np.cumsum([1, k, k * k]))
        if self.symbols:
            return Model(start, move.reshape(k, k), emit=rest.reshape(k, self.symbols), log_likelihood=float(log[0]))
        return Model(start, move.reshape(k, k), rest[: k * d].reshape(k, d), rest[k * d :].reshape(k, d, d), log_likelihood=float(log[0]))

    def counts(self, model: Model, x: np.ndarray, head: bool, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Log likelihood, start, moves, and counts with their sums of a stretch, expected under a Gaussian model; for symbols see :mod:`.categories`."""
        b, top = emissions(model, x)
        _, gamma, moves, log = smoothed(model.move, b, head, before, after)
        first = gamma[0] if head else np.zeros(self.k)
        return np.concatenate([[log + top], first, moves.ravel(), gamma.sum(axis=0), (gamma.T @ x).ravel(), np.einsum("tk,ti,tj->kij", gamma, x, x).ravel()])

    def maximised(self, model: Model, sums: np.ndarray, tolerance: float) -> tuple[Model, bool]:
        """The model that fits expected counts best, and whether the log likelihood gained less than ``tolerance`` of itself."""
        k, d = self.k, self.d
        log, first, moves, rest = np.split(sums, np.cumsum([1, k, k * k]))
        moves, first = moves.reshape(k, k) + 1e-6, first + 1e-12
        done = model.log_likelihood > -np.inf and log[0] - model.log_likelihood < tolerance * abs(model.log_likelihood)
        known = dict(start=first / first.sum(), move=moves / moves.sum(axis=1, keepdims=True), log_likelihood=float(log[0]))
        if self.symbols:
            seen = rest.reshape(k, self.symbols) + 1e-6
            return Model(emit=seen / seen.sum(axis=1, keepdims=True), **known), done
        count, total, second = np.split(rest, np.cumsum([k, k * d]))
        count, total = np.maximum(count, 1e-6), total.reshape(k, d)
        mean = total / count[:, None]
        spread = second.reshape(k, d, d) / count[:, None, None] - mean[:, :, None] * mean[:, None, :]
        if self.cov == "diag":
            spread = np.stack([np.diag(np.maximum(np.diag(s), 0)) for s in spread])
        return Model(mean=mean, cov=spread + FLOOR * np.eye(d), **known), done


def emissions(model: Model, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Probabilities of rows by state, the largest of a row being 1, and the logarithm of what that leaves out."""
    log = model.log_emission(x)
    top = log.max(axis=1)
    return np.exp(log - top[:, None]) + 1e-300, float(top.sum())


def series_blocks(df: DataFrame, names: list[str], model: Column | None = None, stretch: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``blocks(model, symbol, unit, units, ts, x)`` of ``df(symbol, ts, names)``, and ``units(model, symbol, unit, units, alone)``.

    Rows with a NULL value are left out. ``model`` names the model of a symbol,
    one for all by default; ``alone`` tells whether its data are this stretch.
    """
    rows = df.select((F.lit("") if model is None else model).alias("model"), KEY, TIME, *[F.col(c).cast("double").alias(c) for c in names], *([] if stretch is None else [stretch.alias("_time")]))
    rows = number_rows(rows.dropna(subset=names), stretch=None if stretch is None else F.col("_time"))
    cut = rows.withColumn("unit", F.floor(F.col("idx") / BLOCK))
    kept = F.array_sort(F.collect_list(F.struct("idx", TIME, F.array(*names).alias("x"))))
    made = cut.groupBy(*_UNIT).agg(kept.alias("r")).select(*_UNIT, F.col(f"r.{TIME}").alias(TIME), F.flatten("r.x").alias("x"))
    blocks = bucketed(made, "blocks", _UNIT)
    each = blocks.groupBy("model", KEY).agg(F.count(F.lit(1)).alias("units"))
    of_model = each.groupBy("model").agg((F.sum("units") == 1).alias("alone"))
    return blocks, written(blocks.select(*_UNIT).join(each, ["model", KEY]).join(of_model, "model"), "units")


def _arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)  # null as NaN
    return (values[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def _rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The named columns row by row; lists of numbers as arrays, null as None."""
    columns = []
    for name in names:
        column = batch.column(name)
        columns.append(list(_arrays(column)) if pa.types.is_list(column.type) and not column.null_count and name != TIME else column.to_pylist())
    return zip(*columns, strict=True)


def _ends(units: DataFrame, models: DataFrame, k: int, best: bool = False) -> DataFrame:
    """What is known ahead of each series and behind it."""
    start = F.slice("params", 2, k)
    before = F.transform(start, lambda p: F.ln(p + 1e-300)) if best else start
    after = F.array(*[F.lit(-1.0 if best else 1.0)] * (1 if best else k))
    return units.where("unit = 0").select("model", KEY).join(models, "model").select("model", KEY, before.alias("before"), after.alias("after"))


def _carried(blocks: DataFrame, units: DataFrame, models: DataFrame, shape: Shape, best: bool = False, chained: bool | None = None) -> DataFrame:
    """``units`` with the parameters of their models, and with ``before`` and ``after`` of every stretch; ``chained`` if a series is known to have several."""
    long = units.where("units > 1")
    ends = _ends(units, models, shape.k, best)
    short = units.where("units = 1").join(ends, ["model", KEY])
    if not chained and (chained is False or long.isEmpty()):
        return short.join(models, "model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for flat, unit, x in _rows_of(batch, "params", "unit", "x"):
                model = shape.model(flat)
                x = x.reshape(-1, shape.d)
                try:
                    if best:
                        matrix = best_transfer(np.log(model.move + 1e-300), model.log_emission(x), unit == 0)
                    else:
                        matrix = transfer(model.move, emissions(model, x)[0], unit == 0)
                except np.linalg.LinAlgError:
                    matrix = np.full(shape.k**2, np.nan)
                out.append(matrix.ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("model"), batch.column(KEY), batch.column("unit"), pa.array(out, pa.list_(pa.float64()))], names=[*_UNIT, "matrix"])

    asked = blocks.join(long.join(models, "model").select(*_UNIT, "params"), _UNIT)
    matrices = written(asked.mapInArrow(run, f"model string, {KEY} string, unit long, matrix array<double>"), "matrices")
    known = units.join(carries(matrices, ends, shape.k, best), _UNIT)
    return short.unionByName(known.select(short.columns)).join(models, "model")


def expected_counts(blocks: DataFrame, units: DataFrame, models: DataFrame, shape: Shape, chained: bool | None = None) -> DataFrame:
    """``(model, sums)``: counts of all rows of a model, expected under its parameters; summed by Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for flat, unit, x, before, after in _rows_of(batch, "params", "unit", "x", "before", "after"):
                try:
                    out.append(shape.counts(shape.model(flat), x.reshape(-1, shape.d), unit == 0, before, after).tolist())
                except np.linalg.LinAlgError:
                    out.append([float("nan")])  # makes every sum of the model unknown
            yield pa.RecordBatch.from_arrays([batch.column("model"), pa.array(out, pa.list_(pa.float64()))], names=["model", "sums"])

    needs = _carried(blocks, units, models, shape, chained=chained)
    sums = blocks.join(needs.select(*_UNIT, "params", "before", "after"), _UNIT).mapInArrow(counted, "model string, sums array<double>")
    total = sums.select("model", F.posexplode("sums").alias("i", "v")).groupBy("model", "i").agg(F.sum("v").alias("v"))
    return total.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("sums"))


def em(blocks: DataFrame, units: DataFrame, models: DataFrame, shape: Shape, iterations: int = 200, tolerance: float = 1e-4) -> DataFrame:
    """``(model, params)``: the models of ``models(model, params)`` after expectation-maximisation over their stretches.

    Every pass uses all rows. The log likelihood never falls; passes of a model
    end when it gains less than ``tolerance`` of itself. A model whose spread
    degenerates is left out.
    """
    made = "model string, params array<double>, done boolean"

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for flat, x in _rows_of(batch, "params", "x"):
                model, x = shape.model(flat), x.reshape(-1, shape.d)
                try:
                    for _ in range(iterations):
                        model, done = shape.maximised(model, shape.counts(model, x, True, model.start, np.ones(shape.k)), tolerance)
                        if done:
                            break
                    out.append(model.flat().tolist())
                except np.linalg.LinAlgError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("model"), pa.array(out, pa.list_(pa.float64()))], names=["model", "params"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for flat, sums in _rows_of(batch, "params", "sums"):
                model, done = (None, True) if np.isnan(sums[0]) else shape.maximised(shape.model(flat), sums, tolerance)
                out.append((None if model is None else model.flat().tolist(), bool(done)))
            yield pa.RecordBatch.from_arrays([batch.column("model"), pa.array([m for m, _ in out], pa.list_(pa.float64())), pa.array([d for _, d in out])], names=["model", "params", "done"])

    with arrow_batches(blocks.sparkSession, BATCH):
        alone, shared = units.where("alone"), units.where("not alone")
        asked = blocks.join(alone.join(models, "model").select(*_UNIT, "params"), _UNIT)
        finished = [written(asked.mapInArrow(here, "model string, params array<double>"), "models")]
        now, chained = models.join(shared.select("model").distinct(), "model"), not shared.where("units > 1").isEmpty()
        for _ in range(iterations):
            total = expected_counts(blocks, shared.join(now.select("model"), "model"), now, shape, chained)
            after = written(total.join(now, "model").mapInArrow(fitted, made), "models")
            finished.append(after.where("done").drop("done"))
            now = after.where("not done").drop("done")
            if now.isEmpty():
                break
        else:
            finished.append(now)
        out = finished[0]
        for part in finished[1:]:
            out = out.unionByName(part)
        return written(out.where("params is not null"), "models")


def start_models(df: DataFrame, features: list[str], shape: Shape, model: Column | None = None, sample: int = 20_000, least: int = 10) -> DataFrame:
    """``(model, params)``: states from slices of the first principal direction, so that a fit needs no random start.

    Taken from at most ``sample`` rows of a model by hash; a model of fewer than
    ``least`` rows for each state is left out.
    """
    from pyspark.sql import Window

    named = df.select((F.lit("") if model is None else model).alias("model"), *[F.col(f).cast("double").alias(f) for f in features], F.xxhash64(KEY, TIME).alias("_h")).dropna()
    some = named.withColumn("_n", F.row_number().over(Window.partitionBy("model").orderBy("_h", *features))).where(F.col("_n") <= sample)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_n")[features].to_numpy(float)
        flat = [] if len(x) < least * shape.k else [_start_model(x, shape.k).flat()]
        return pd.DataFrame({"model": pdf["model"].iloc[: len(flat)].to_numpy(), "params": pd.Series(flat, dtype=object)})

    return written(some.groupBy("model").applyInPandas(run, "model string, params array<double>"), "starts")


def _start_model(x: np.ndarray, k: int) -> Model:
    centre = x - x.mean(axis=0)
    order = np.argsort(centre @ np.linalg.svd(centre, full_matrices=False)[2][0], kind="stable")
    parts = np.array_split(order, k)
    spread = np.cov(x.T).reshape(x.shape[1], x.shape[1]) + FLOOR * np.eye(x.shape[1])
    return Model(np.full(k, 1 / k), _staying(k, 0.8), np.array([x[p].mean(axis=0) for p in parts]), np.array([spread] * k))


def _staying(k: int, p: float) -> np.ndarray:
    out = np.full((k, k), (1 - p) / max(k - 1, 1))
    np.fill_diagonal(out, p if k > 1 else 1.0)
    return out


def fit(df: DataFrame, features: list[str], k: int = 3, cov: str = "diag", iterations: int = 200, tolerance: float = 1e-4, sample: int = 20_000) -> Model:
    """A Gaussian model of ``df(symbol, ts, features)``, shared by all symbols, each of which is one series."""
    shape = Shape(k, len(features), cov)
    starts = start_models(df, features, shape, sample=sample)
    if starts.isEmpty():
        raise ValueError("too few rows for a model")
    return shape.model(em(*series_blocks(df, features), starts, shape, iterations, tolerance).first().params)  # one model


def fit_categorical(df: DataFrame, x: str, symbols: int, k: int = 10, iterations: int = 100, tolerance: float = 1e-4, stretch: Column | None = None) -> Model:
    """A model of ``df(symbol, ts, x)`` with values ``0 .. symbols - 1``, shared by all symbols; NULL values are left out.

    ``x`` may be an array of values that follow each other. ``stretch`` orders
    rows roughly in time where ``ts`` is no timestamp.
    """
    shape = Shape(k, symbols=symbols)
    emit = np.random.default_rng(42).dirichlet(np.full(symbols, 20.0), k)
    model = Model(np.full(k, 1 / k), _staying(k, 0.9), emit=emit)
    blocks = categories.packed_blocks(df, x, symbols, BLOCK, stretch)
    short, long = blocks.agg(F.bool_or(F.col("units") == 1), F.bool_or(F.col("units") > 1)).first()
    if short is None:
        raise ValueError("no values for a model")
    for _ in range(iterations):
        model, done = shape.maximised(model, categories.expected_sums(blocks, model.start, model.move, model.emit, short, long), tolerance)
        if done:
            break
    return model


def states_of(blocks: DataFrame, units: DataFrame, models: DataFrame, shape: Shape, kind: str = "timestamp") -> DataFrame:
    """``(model, symbol, ts, state, filtered, probs)``: the most likely path of each series, the state by the rows so far alone, and the posterior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = batch.column(TIME)
            names = ("model", KEY, "params", "unit", "x", "before", "after", "best_before", "best_after")
            for i, (name, symbol, flat, unit, x, before, after, best, end) in enumerate(_rows_of(batch, *names)):
                model, x = shape.model(flat), x.reshape(-1, shape.d)
                path = best_path(np.log(model.move + 1e-300), model.log_emission(x), unit == 0, best, int(end[0]))
                now, gamma, _, _ = smoothed(model.move, emissions(model, x)[0], unit == 0, before, after)
                columns = [pa.array([name] * len(x)), pa.array([symbol] * len(x)), times[i].values, pa.array(path.astype(np.int32)), pa.array(now.argmax(axis=1).astype(np.int32)), pa.array(gamma.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["model", KEY, TIME, "state", "filtered", "probs"])

    with arrow_batches(blocks.sparkSession, BATCH):
        soft = _carried(blocks, units, models, shape).select(*_UNIT, "params", "before", "after")
        hard = _carried(blocks, units, models, shape, best=True).select(*_UNIT, F.col("before").alias("best_before"), F.col("after").alias("best_after"))
        asked = blocks.join(soft.join(hard, _UNIT), _UNIT)
        return written(asked.mapInArrow(run, f"model string, {KEY} string, {TIME} {kind}, state int, filtered int, probs array<double>"), "states")


def decode(df: DataFrame, model: Model, features: list[str]) -> DataFrame:
    """``(symbol, ts, state, probs)``: the most likely path and each row's posterior under one model for all symbols."""
    models = df.sparkSession.createDataFrame([("", model.flat().tolist())], "model string, params array<double>")
    shape = Shape(len(model.start), len(features))
    return states_of(*series_blocks(df, features), models, shape).select(KEY, TIME, "state", "probs")


def posterior_signal(decoded: DataFrame, sides: DataFrame, last: int = 20, threshold: float = 0.2) -> DataFrame:
    """BUY or SELL per symbol where the mean posterior of its last rows leans that far to a side, else HOLD."""
    from pyspark.sql import Window

    recent = decoded.withColumn("_n", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME)))).where(F.col("_n") <= last).join(sides, KEY)
    lean = F.avg(F.get("probs", F.col("buy")) - F.get("probs", F.col("sell")))
    out = recent.groupBy(KEY).agg(lean.alias("lean"))
    return out.withColumn("signal", F.when(F.col("lean") > threshold, "BUY").when(F.col("lean") < -threshold, "SELL").otherwise("HOLD"))
