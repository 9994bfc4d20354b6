"""Runs, neighbours and sliding windows by stretches against plain loops over whole series."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from barloom.functions.stretches import over_windows, with_previous
from barloom.operators import path_score, regimes, spectral

START = datetime(2025, 1, 1)


def labelled(spark, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for s, n in (("a", 200), ("b", 57), ("c", 1)):
        at, label = 0, "x"
        for _ in range(n):
            at += int(r.integers(1, 40))
            label = [label, label, "x", "y", None][r.integers(0, 5)]
            rows.append((s, START + timedelta(seconds=at), label))
    rows += [("d", START + timedelta(seconds=7 * i), "same") for i in range(90)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, label string"), sorted(rows, key=lambda r: r[:2])


@pytest.mark.parametrize("seconds", [50, 100_000])
def test_runs_and_transitions_equal_a_loop(spark, seconds):
    df, rows = labelled(spark)
    want, moves = [], {}
    for (s, t, label), before in zip(rows, [None, *rows], strict=False):
        if before and before[0] == s and before[2] == label:
            want[-1][3:] = [t, want[-1][4] + 1]
        else:
            want.append([s, label, t, t, 1])
        if before and before[0] == s and before[2] is not None:
            moves[s, before[2], label] = moves.get((s, before[2], label), 0) + 1
    got = [[r.symbol, r.label, r.start, r.stop, r.n] for r in regimes.islands(df.repartition(3), "label", seconds).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(r.symbol, r.before, r.after): r.n for r in regimes.transition_counts(df, "label", seconds=seconds).collect()} == moves


@pytest.mark.parametrize("seconds", [60, 10_000_000])
def test_previous_rows_equal_a_loop(spark, seconds):
    df, rows = labelled(spark, 2)
    got = {(r.symbol, r.ts): (r.was, r._first) for r in with_previous(df, {"was": "label"}, seconds).collect()}
    for row, before in zip(rows, [None, *rows], strict=False):
        first = not before or before[0] != row[0]
        assert got[row[:2]] == (None if first else before[2], first)


def test_entries_begin_where_a_side_begins(spark):
    sides = ["LONG", "LONG", "NEUTRAL", "SHORT", "LONG", None, "LONG"]
    df = spark.createDataFrame([("a", START + timedelta(days=20 * i), s) for i, s in enumerate(sides)], "symbol string, ts timestamp, signal string")
    assert sorted((r.ts - START).days // 20 for r in path_score.signal_entries(df).collect()) == [0, 3, 4, 6]


def loop_hurst(x):
    """Slope of the mean rescaled range on the chunk size, both as logarithms, one chunk after another."""
    points = []
    for size in spectral.chunk_sizes(len(x)):
        ratios = []
        for lo in range(0, len(x) - size + 1, size):
            chunk = x[lo : lo + size]
            steps = [b - a for a, b in zip(chunk, chunk[1:], strict=False)]
            mean = sum(steps) / len(steps)
            spread = math.sqrt(sum((d - mean) ** 2 for d in steps) / (len(steps) - 1))
            reach = max(chunk) - min(chunk)
            if spread > 0 and reach > 0:
                ratios.append(reach / spread)
        if ratios:
            points.append((math.log10(size), math.log10(sum(ratios) / len(ratios))))
    if len(points) < 2:
        return None
    mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
    slope = sum((a - mx) * (b - my) for a, b in points) / sum((a - mx) ** 2 for a, _ in points)
    return min(max(slope, 0.0), 1.0)


def test_rescaled_range_equals_a_loop_row_by_row(spark):
    """In blocks of 130 rows with windows of 100 before each row, one close missing."""
    r = np.random.default_rng(4)
    series = {"walk": np.cumsum(r.normal(size=420)), "short": np.arange(100.0), "flat": np.ones(150)}
    rows = [(s, START + timedelta(minutes=i), None if s == "walk" and i == 210 else float(v)) for s, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    sizes = spectral.chunk_sizes(100)
    got = {(x.symbol, x.ts): x.h for x in over_windows(df, "close", 100, lambda m: spectral.rescaled_range(m, sizes), "h", before=1, block=130).collect()}
    whole = {(x.symbol, x.ts): x.hurst_rs for x in spectral.hurst_rs(df).collect()}
    assert len(got) == len(rows)
    by = {s: [row for row in rows if row[0] == s] for s in series}
    for s, mine in by.items():
        for i, (_, t, _) in enumerate(mine):
            window = [v for _, _, v in mine[max(i - 100, 0) : i]]
            want = loop_hurst(window) if len(window) == 100 and None not in window else None
            for value in (got[s, t], whole[s, t]):
                assert value is None if want is None else value == pytest.approx(want, abs=1e-9)
    assert sum(v is not None for v in got.values()) == 220 + 0


def test_dominant_frequency_in_blocks_equals_numpy(spark):
    r = np.random.default_rng(1)
    c = np.sin(np.arange(300) * 2 * np.pi * 5 / 50) + 0.5 * r.normal(size=300)
    df = spark.createDataFrame([("a", START + timedelta(minutes=i), float(v)) for i, v in enumerate(c)], "symbol string, ts timestamp, close double")
    got = [x.fft_dominant_freq for x in spectral.dominant_frequency(df).orderBy("ts").collect()]
    assert got[:49] == [None] * 49
    for i in range(49, 300):
        w = c[i - 49 : i + 1]
        assert got[i] == (np.abs(np.fft.rfft(w - w.mean()))[1:25].argmax() + 1) / 50
