"""Properties of the operators that SQL cannot express."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from barloom.functions.stretches import window_vectors
from barloom.operators import models, path_score, scan, slopes, spectral, targets, weights
from pyspark.sql import functions as F

START = datetime(2025, 1, 1)


def series(spark, **named):
    rows = [(s, START + timedelta(minutes=i), float(v)) for s, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double")


def test_adaptive_weights_properties(spark):
    r = np.random.default_rng(7)
    spike, outlier = np.full(40, 100.0), 100 + r.normal(size=50)
    spike[20], outlier[25] = 150, 200
    named = {"uniform": np.ones(30), "trend": np.linspace(100, 200, 50), "spike": spike, "cyclic": 100 + 10 * np.sin(np.linspace(0, 4 * np.pi, 100)), "outlier": outlier, "two": [1, 2], "edge": [100.0] * 19 + [100.000001]}
    df = weights.adaptive_weights(series(spark, **named)).toPandas()
    got = {s: g.sort_values("ts").adaptive_weight.to_numpy() for s, g in df.groupby("symbol")}
    for s, w in got.items():
        assert len(w) == len(named[s]) and abs(w.sum() - 1) < 1e-9 and (w > 0).all()
    assert got["uniform"].max() / got["uniform"].min() < 1.5
    assert got["trend"][25:].sum() > got["trend"][:25].sum()
    assert got["spike"].argmax() in (20, 21)
    assert got["outlier"].max() < 0.5


def test_decay_weights_and_summary(spark):
    df = scan.time_decay_weights(weights.with_returns(series(spark, a=range(1, 60))))
    w = df.toPandas().sort_values("ts").decay_weight.to_numpy()
    assert abs(w.sum() - 1) < 1e-12 and np.allclose(w[:-1] / w[1:], 0.95)
    row = weights.weight_summary(df, ["decay_weight"]).first()
    assert abs(row.effective_n - 1 / (w**2).sum()) < 1e-9 and abs(row.last10 - w[-10:].sum()) < 1e-9


def test_dominant_frequency_equals_numpy(spark):
    c = np.sin(np.arange(120) * 2 * np.pi * 5 / 50) + 0.01 * np.random.default_rng(1).normal(size=120)
    out = spectral.dominant_frequency(series(spark, a=c)).toPandas().sort_values("ts").fft_dominant_freq.to_numpy()
    assert np.isnan(out[:49]).all() and np.allclose(out[49:], 5 / 50)


def test_rescaled_range_tells_trend_from_noise(spark):
    r = np.random.default_rng(2)
    df = series(spark, walk=np.cumsum(r.normal(size=400)), trend=np.cumsum(1 + 0.1 * r.normal(size=400)))
    out = spectral.hurst_rs(df).toPandas().dropna().groupby("symbol").hurst_rs.mean()
    assert 0.4 < out["walk"] < 0.75 and out["trend"] > 0.85
    assert spectral.chunk_sizes(100) == [5, 8, 15, 28, 50, 88, 100]


def test_theil_sen_is_robust(spark):
    y = 2.0 * np.arange(60)
    y[10] = 1e6
    assert abs(slopes.theil_sen(series(spark, a=y)).first().slope - 2) < 1e-9


def test_theil_sen_is_the_median_of_all_slopes(spark, monkeypatch):
    """In small blocks, with many equal slopes, and for series of one and two rows."""
    monkeypatch.setattr(slopes, "BLOCK", 40)
    r = np.random.default_rng(3)
    named = {"noise": r.normal(size=230), "ties": r.integers(0, 3, 150), "flat": np.ones(90), "line": np.arange(101) * 3.0, "two": [1.0, 5.0], "one": [7.0], "heavy": np.where(np.arange(160) % 4, 0.0, r.normal(size=160))}
    got = {x.symbol: x.slope for x in slopes.theil_sen(series(spark, **named)).collect()}
    assert got.keys() == named.keys() and got["one"] is None
    for s, y in named.items():
        i, j = np.triu_indices(len(y), 1)
        if len(i):
            assert got[s] == pytest.approx(np.median((np.asarray(y, float)[j] - np.asarray(y, float)[i]) / (j - i)), abs=1e-12)


def test_weighted_inversions_equal_all_pairs():
    r = np.random.default_rng(8)
    for n, units, values in ((0, 1, 1), (1, 1, 1), (40, 40, 5), (300, 7, 20), (257, 300, 1000)):
        unit, z, w = np.sort(r.integers(0, units, n)), r.integers(0, values, n).astype(float), r.integers(1, 5, n)
        for strict in (False, True):
            pairs = (unit[:, None] < unit) & (z < z[:, None] if strict else z <= z[:, None])
            assert slopes.inversions(unit, z, w, strict) == int((pairs * w[:, None] * w).sum())


def test_t_tail_against_known_values():
    for t, df, p in ((2.228, 10, 0.05), (1.96, 10_000, 0.05), (0.0, 5, 1.0), (12.706, 1, 0.05)):
        assert abs(path_score.t_tail(t, df) - p) < 2e-4


def test_splits_are_stable_and_sequences_have_their_rows(spark):
    df = series(spark, a=range(200))
    one, two = (targets.random_split(d).toPandas().set_index("ts").is_train for d in (df, df.repartition(7)))
    assert one.sort_index().equals(two.sort_index()) and 120 < one.sum() < 190
    seq = targets.to_sequences(df.withColumn("label", df.close), ["close"], "label", 5).orderBy("ts").collect()
    assert len(seq) == 195 and [x[0] for x in seq[0].seq] == [0, 1, 2, 3, 4] and seq[0].label == 5


def test_confidence_of_every_row_equals_a_loop(spark):
    r = np.random.default_rng(4)
    plr = {"t": r.normal(0.3, 1, 40), "r": r.normal(0, 1, 30), "n": r.normal(0, 1, 4)}
    kind = {"t": "trending", "r": "reversal", "n": "neutral"}
    rows, want = [], {}
    for s, v in plr.items():
        n, m, sd = len(v), v.mean(), v.std(ddof=1)
        p = 0.5 if n < 5 else path_score.t_tail(m / (sd / np.sqrt(n)), n - 1)
        for i, value in enumerate(v):
            z = float(r.normal(0, 2))
            signal = "LONG" if r.random() < 0.3 else "SHORT" if r.random() < 0.4 else "NEUTRAL"
            strength = min(abs(z) / 3 * 100, 100.0)
            rows.append((s, START + timedelta(minutes=i + 1), float(value), z, signal, strength))
            good = (kind[s] == "trending" and ((signal == "LONG" and z > 0) or (signal == "SHORT" and z < 0))) or (kind[s] == "reversal" and ((signal == "LONG" and z < 0) or (signal == "SHORT" and z > 0)))
            steady = 0.5 if i == 0 else 0.7 if np.sign(v[i - 1]) == np.sign(value) else 0.3
            want[s, i] = 100 * ((1 - p) * 0.3 + strength / 100 * 0.4 + (0.8 if good else 0.5) * 0.2 + steady * 0.1)
        rows.append((s, START, None, None, "NEUTRAL", None))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, plr double, z double, signal string, strength double")
    out = path_score.confidence(df, spark.createDataFrame(list(kind.items()), "symbol string, regime string")).toPandas().sort_values(["symbol", "ts"])
    for s, g in out.groupby("symbol"):
        assert np.isnan(g.confidence.iloc[0])
        assert np.allclose(g.confidence.iloc[1:], [want[s, i] for i in range(len(plr[s]))])


def test_standardised_projected_and_mixed(spark):
    r = np.random.default_rng(6)
    x = np.vstack([r.normal(m, 1, (150, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]]) for m in ([-6, 0, 0], [0, 6, 0], [6, 0, 6])])
    rows = [("a", START + timedelta(minutes=i), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, p double, q double, s double")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    got = models.standardise(df, ["p", "q", "s"]).toPandas().sort_values("ts")
    assert np.allclose(got[["p", "q", "s"]], z)
    pc = models.pca_project(df, ["p", "q", "s"]).toPandas().sort_values("ts")[["pc1", "pc2"]].to_numpy()
    _, vectors = np.linalg.eigh(np.cov(z.T))
    assert np.allclose(np.abs(pc), np.abs(z @ vectors[:, [2, 1]]), atol=1e-6)
    mixed = models.gmm_regimes(df, ["p", "q", "s"], "p").toPandas().sort_values("ts")
    assert np.allclose(np.stack(mixed.probs).sum(axis=1), 1) and (np.stack(mixed.probs).argmax(axis=1) == mixed.regime).all()
    assert (mixed.regime.to_numpy() == np.repeat([0, 1, 2], 150)).mean() > 0.98


def test_direction_classifier_learns_what_is_there(spark):
    """Sequences of 96 rows and 11 features, whose class is the side that most of a feature's last rows lie on."""
    r = np.random.default_rng(9)
    v = r.normal(size=(2000, 11)) * np.where(np.arange(11) == 3, 3.0, 1.0)
    label = [int(v[max(i - 10, 0) : i, 3].sum() > 0) for i in range(2000)]
    rows = [("a", START + timedelta(minutes=i), label[i], *map(float, v[i])) for i in range(2000)]
    names = [f"f{i}" for i in range(11)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, y int, " + ", ".join(f"{n} double" for n in names))
    seq = targets.random_split(window_vectors(df, names, "y", 96))
    out = models.direction_classifier(seq, hidden=8).join(seq.select("ts", "is_train"), "ts").where("is_train = 0").toPandas()
    assert len(out) > 100 and (out.label == out.prediction).mean() > 0.7 and ((out.p_up > 0.5).astype(int) == out.prediction).all()
    assert models.direction_classifier(seq.where("label > 5")).count() == 0


@pytest.mark.parametrize(("stride", "block"), [(1, 10), (3, 7), (4, 4096)])
def test_window_vectors_equal_sequences(spark, stride, block):
    df = series(spark, a=range(50), b=range(100, 106), c=range(5)).withColumn("low", -F.col("close"))
    want = {(x.symbol, x.ts): [v for row in x.seq for v in row] for x in targets.to_sequences(df, ["close", "low"], "close", 5, stride).collect()}
    got = {(x.symbol, x.ts): x.x for x in window_vectors(df, ["close", "low"], "close", 5, stride, block).collect()}
    assert got == want and len(got) > 10
