"""Hidden models over categories: series as packed bytes, and stretches taken side by side.

A stretch is one row of a table that is bucketed once, a category taking a byte
where there are at most 256. A task takes ``WIDTH`` stretches at a time: a step
of the recursions is one product of small matrices for all of them, and expected
counts leave a task as one row. Only series of several stretches need their
matrices (:mod:`.chains`), which are the same recursion from each state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.tables import arrow_batches, bucketed, written
from ..functions.win import KEY, TIME
from .chains import carries

#: Stretches that a task takes side by side.
WIDTH = 512
#: Steps between two scalings; floors of the probabilities keep that many products above the least double.
SCALED = 4
#: Steps whose states are in memory at once, so that they stay in the processor's cache; a multiple of ``SCALED``.
HELD = 32
#: Steps after which a matrix is looked at for rows that have become one; a multiple of ``SCALED``.
CHECKED = 64


def _kind(symbols: int) -> np.dtype:
    return np.dtype(np.uint8 if symbols <= 256 else "<i4")


def packed_blocks(df: DataFrame, x: str, symbols: int, block: int, stretch: Column | None = None) -> DataFrame:
    """``blocks(symbol, unit, units, x)``: the values of each series in order, ``block`` at a time, packed.

    ``x`` is a value, or an array of values that follow each other; arrays of one
    ``ts`` go by the place in them, first values first. NULL values are left
    out, as are rows without a symbol. Rows are sorted inside a ``stretch`` of a
    series, which must not fall in the order of ``ts``; packed pieces of
    stretches are then put together by where they begin.
    """
    kind = _kind(symbols)
    several = dict(df.dtypes)[x].startswith("array")
    values = F.col(x).cast("array<int>") if several else F.array(F.col(x).cast("int"))
    cut = F.floor(F.unix_seconds(TIME) / (30 * 86_400)) if stretch is None else stretch
    kinds = df.schema[TIME].dataType
    times = [F.col(TIME)[f] for f in kinds.names] if isinstance(kinds, StructType) else [F.col(TIME)]  # sorted faster than structs
    order = [f"t{i}" for i in range(len(times))]
    rows = df.select(KEY, cut.cast("long").alias("stretch"), *[c.alias(t) for c, t in zip(times, order, strict=True)], values.alias("x")).where(f"{KEY} is not null and stretch is not null")
    # one number tells most rows apart when they are sorted, and the rows of a stretch share it
    rows = rows.withColumn("group", F.xxhash64(KEY, "stretch")).repartition("group").sortWithinPartitions("group", KEY, "stretch", *order).select(KEY, "stretch", F.xxhash64(*order).alias("h"), "x")

    def changes(batch: pa.RecordBatch, *columns: str) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in columns:
            v = batch.column(c)
            v = v.dictionary_encode().indices.to_numpy() if c == KEY else v.to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return new

    def whole_times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches that do not end inside rows of one time."""
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            last = int(np.flatnonzero(changes(batch, KEY, "stretch", "h"))[-1])
            if last:
                yield batch.slice(0, last)
            rest = batch.slice(last)
        if rest is not None:
            yield rest

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for batch in whole_times(batches) if several else batches:
            if not batch.num_rows:
                continue
            lists = batch.column("x")
            values, ends = lists.flatten(), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]
            v = values.to_numpy(zero_copy_only=False)
            times = changes(batch, KEY, "stretch", "h")
            if several and not times.all():
                sizes = np.diff(ends)
                v = v[np.lexsort((np.arange(len(v)) - np.repeat(ends[:-1], sizes), np.repeat(np.cumsum(times), sizes)))]
            first = np.flatnonzero(changes(batch, KEY, "stretch"))
            begins = np.r_[ends[first], ends[-1]]
            if values.null_count:
                known = ~np.isnan(v)
                begins, v = np.r_[0, np.cumsum(known)][begins], v[known].astype(np.int64)
            v = np.where(v < 0, v + symbols, v)
            if ((v < 0) | (v >= symbols)).any():
                raise IndexError(f"values must be 0 to {symbols - 1}")
            data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((begins * kind.itemsize).astype(np.int32).tobytes()), pa.py_buffer(v.astype(kind).tobytes())])
            pick = pa.array(first)
            yield pa.RecordBatch.from_arrays([batch.column(KEY).take(pick), batch.column("stretch").take(pick), pa.array(part + np.arange(len(first))), pa.array(np.diff(begins).astype(np.int64)), data], names=[KEY, "stretch", "part", "n", "x"])
            part += len(first)

    by = [KEY, "stretch", "part"]
    pieces = written(rows.mapInArrow(packed, f"{KEY} string, stretch long, part long, n long, x binary").where("n > 0"), "pieces")
    series = Window.partitionBy(KEY)
    upto = F.sum("n").over(series.orderBy("stretch", "part").rowsBetween(Window.unboundedPreceding, 0))
    placed = pieces.select(*by, (upto - F.col("n")).alias("begin"), F.ceil(F.sum("n").over(series) / block).alias("units"))
    at = pieces.join(placed, by).withColumn("unit", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("n") - 1) / block))))
    low = F.greatest(F.col("unit") * block - F.col("begin"), F.lit(0))
    high = F.least((F.col("unit") + 1) * block - F.col("begin"), F.col("n"))
    sliced = F.substring("x", (low * kind.itemsize + 1).cast("int"), ((high - low) * kind.itemsize).cast("int"))
    held = F.array_sort(F.collect_list(F.struct("stretch", "part", sliced.alias("x"))))
    made = at.groupBy(KEY, "unit").agg(F.first("units").alias("units"), held.alias("r"))
    return bucketed(made.select(KEY, "unit", "units", F.aggregate("r", F.lit(b""), lambda a, r: F.concat(a, r["x"])).alias("x")), "blocks", [KEY, "unit"])


def _aligned(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest first: their order, ``values[step, series]``, and how many series go on at each step."""
    sizes = np.array([len(s) for s in series])
    order = np.argsort(-sizes, kind="stable")
    values = np.zeros((sizes.max(), len(series)), dtype=np.int64)
    for i, j in enumerate(order):
        values[: sizes[j], i] = series[j]
    return order, values, (sizes[:, None] > np.arange(sizes.max())).sum(axis=0)


def _scaled(emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of a value by state, the largest being 1, and the logarithm of what that leaves out."""
    top = emit.max(axis=0)
    return emit / top + 1e-300, np.log(top)


def expected(move: np.ndarray, emit: np.ndarray, series: list[np.ndarray], head: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Log likelihood, start, moves and values of ``series``, expected under a model and summed.

    ``before[series]`` holds the probabilities of states ahead of each, and
    ``after[series]`` how well each state of its last row goes on; ``head``
    tells which begin a series.
    """
    b, top = _scaled(emit)
    k, symbols = b.shape
    order, x, live = _aligned(series)
    head, ahead, behind = head[order], before[order], after[order]
    ahead = ahead / ahead.sum(axis=1, keepdims=True)
    steps, count = x.shape
    b, turned, one = np.ascontiguousarray(b.T), np.ascontiguousarray(move.T), np.ones(k)
    scale, last = np.ones((-(-steps // SCALED), count, 1)), np.empty((count, k))

    def forward(a: np.ndarray, s: int, known: bool) -> np.ndarray:
        """States after step ``s``, divided by their sum at every ``SCALED``-th step, which is kept at first."""
        n = live[s]
        a = a[:n] @ move if s else np.where(head[:, None], ahead, ahead @ move)
        a *= b.take(x[s, :n], axis=0)
        if s % SCALED == SCALED - 1:
            if not known:
                scale[s // SCALED, :n, 0] = a @ one
            a /= scale[s // SCALED, :n]
        return a

    a, held = ahead, []
    for s in range(steps):
        if s % HELD == 0:
            held.append(a)
        a = forward(a, s, False)
        if (n := live[s + 1] if s + 1 < steps else 0) < len(a):  # these have ended
            last[n : len(a)] = a[n:]
    z = behind / (last * behind).sum(axis=1, keepdims=True)
    moves, seen, first = np.zeros((k, k)), np.zeros(symbols * k), None
    alpha, states = np.empty((HELD, count, k)), np.arange(k)
    for c in range(len(held) - 1, -1, -1):  # states of a few steps at a time, from those held ahead of them
        begin, end = c * HELD, min((c + 1) * HELD, steps)
        a = held[c]
        for s in range(begin, end):
            alpha[s - begin, : live[s]] = a = forward(a, s, True)
        for s in range(end - 1, begin - 1, -1):
            n, now = live[s], alpha[s - begin]
            w = b.take(x[s, :n], axis=0)
            w *= z[:n]
            if s % SCALED == SCALED - 1:
                w /= scale[s // SCALED, :n]
            now[:n] *= z[:n]  # from here on the posterior
            now[n:] = 0.0
            if s:
                moves += (alpha[s - begin - 1] if s > begin else held[c])[:n].T @ w
                z[:n] = w @ turned
            else:
                moves += ahead[~head].T @ w[~head]
                first = now[head].sum(axis=0)
        wide = live[begin]
        seen += np.bincount((x[begin:end, :wide, None] * k + states).ravel(), alpha[: end - begin, :wide].ravel(), symbols * k)
    seen = seen.reshape(symbols, k).T
    log = np.log(scale).sum() + np.log(last.sum(axis=1)).sum() + seen.sum(axis=0) @ top
    return np.concatenate([[log], first, (moves * move).ravel(), seen.ravel()])


def transfers(move: np.ndarray, emit: np.ndarray, series: list[np.ndarray], head: np.ndarray) -> np.ndarray:
    """Scaled product of all steps of each of ``series``, as :func:`.chains.transfer`.

    A row is the recursion from one state. Where the rows of all matrices have
    become one to the last digits, it goes on as one.
    """
    b, _ = _scaled(emit)
    k = len(b)
    order, x, live = _aligned(series)
    steps, count = x.shape
    turned, each = np.ascontiguousarray(move.T), k
    a, log, out = np.tile(np.eye(k), count), np.zeros(count * k), np.empty((count, k, k))  # columns: series by state
    begins, done = np.repeat(head[order], k), count
    for s in range(steps):
        n = live[s]
        if n < done:  # these have ended
            out[n:done] = a[:, n * each : done * each].T.reshape(done - n, each, k)
            a, done = np.ascontiguousarray(a[:, : n * each]), n
        a = turned @ a if s else np.where(begins, a, turned @ a)
        a *= np.repeat(b.take(x[s, :n], axis=1), each, axis=1) if each > 1 else b.take(x[s, :n], axis=1)
        if s % SCALED == SCALED - 1:
            total = a.sum(axis=0)
            a /= total
            if each > 1:
                log[: n * k] += np.log(total)
        if each > 1 and s % CHECKED == CHECKED - 1:  # scaled just now
            rows = a.reshape(k, n, k)
            if (np.abs(rows - rows[:, :, :1]) <= 1e-14 * rows[:, :, :1]).all():
                a, each = np.ascontiguousarray(rows[:, :, 0]), 1
    out[:done] = a.T.reshape(done, each, k)
    log = log.reshape(count, k)
    out *= np.exp(log - log.max(axis=1, keepdims=True))[:, :, None]
    unsorted = np.empty_like(out)
    unsorted[order] = out
    return unsorted


def _series(batch: pa.RecordBatch, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(v, kind) for v in batch.column("x").to_pylist()]


def _summed(rows: Iterable[np.ndarray]) -> list[pa.RecordBatch]:
    total = None
    for r in rows:
        total = r if total is None else total + r
    return [] if total is None else [pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])]


def expected_sums(blocks: DataFrame, start: np.ndarray, move: np.ndarray, emit: np.ndarray, short: bool, long: bool) -> np.ndarray:
    """Counts of all rows of ``blocks``, expected under one model; ``short`` and ``long`` tell whether there are series of one and of several stretches."""
    k, symbols = emit.shape
    kind = _kind(symbols)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[np.ndarray]:
            for batch in batches:
                if n := batch.num_rows:
                    yield expected(move, emit, _series(batch, kind), np.ones(n, bool), np.tile(start, (n, 1)), np.ones((n, k)))

        yield from _summed(each())

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                made = transfers(move, emit, _series(batch, kind), batch.column("unit").to_numpy() == 0)
                yield pa.RecordBatch.from_arrays([pa.array([""] * n), batch.column(KEY), batch.column("unit"), pa.array(list(made.reshape(n, -1)), pa.list_(pa.float64()))], names=["model", KEY, "unit", "matrix"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[np.ndarray]:
            for batch in batches:
                if batch.num_rows:
                    before, after = (np.array(batch.column(c).to_pylist()) for c in ("before", "after"))
                    yield expected(move, emit, _series(batch, kind), batch.column("unit").to_numpy() == 0, before, after)

        yield from _summed(each())

    parts = []
    with arrow_batches(blocks.sparkSession, WIDTH):
        if short:
            parts += blocks.where("units = 1").select("x").mapInArrow(alone, "sums array<double>").collect()  # one row a task
        if long:
            several = blocks.where("units > 1")
            ends = several.where("unit = 0").select(F.lit("").alias("model"), KEY, F.array(*[F.lit(float(p)) for p in start]).alias("before"), F.array(*[F.lit(1.0)] * k).alias("after"))
            made = written(several.select(KEY, "unit", "x").mapInArrow(matrices, f"model string, {KEY} string, unit long, matrix array<double>"), "matrices")
            known = carries(made, ends, k).drop("model").hint("shuffle_hash")
            parts += several.join(known, [KEY, "unit"]).select("unit", "x", "before", "after").mapInArrow(chained, "sums array<double>").collect()  # one row a task
    return np.sum([p.sums for p in parts], axis=0)
