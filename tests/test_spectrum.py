"""Transforms and scans of long series against numpy and plain loops."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from barloom.operators import scan, spectrum, weights

START = datetime(2025, 1, 1)


@pytest.mark.parametrize("tile", [8, 4096])
def test_spectrum_equals_numpy(spark, monkeypatch, tile):
    monkeypatch.setattr(spectrum, "TILE", tile)
    r = np.random.default_rng(1)
    series = {f"s{n}": r.normal(size=n) for n in (1, 2, 3, 7, 8, 50, 97, 256, 1001)}
    rows = [(s, len(x), i, float(v)) for s, x in series.items() for i, v in enumerate(x)]
    out = spectrum.spectrum(spark.createDataFrame(rows, "symbol string, n long, at long, x double").repartition(3)).toPandas()
    for s, x in series.items():
        got = out[out.symbol == s].sort_values("bin")
        want = np.abs(np.fft.rfft(x))
        assert got.bin.tolist() == list(range(len(want))) and np.allclose(got["size"], want, atol=1e-9)


def test_dominant_cycle_equals_numpy(spark):
    r = np.random.default_rng(2)
    named = {"wave": 100 + 10 * np.sin(np.arange(120) / 5) + r.normal(size=120), "few": [1.0, 2.0, 4.0], "eight": r.random(8) + 1}
    rows = [(s, START + timedelta(days=20 * i), float(v)) for s, x in named.items() for i, v in enumerate(x)]
    df = weights.with_returns(spark.createDataFrame(rows, "symbol string, ts timestamp, close double"))
    got = {x.symbol: x for x in weights.dominant_cycle(df).collect()}
    assert (got["few"].cycle, got["few"].cyclicality) == (1, 0.0)
    for s in ("wave", "eight"):
        c = np.asarray(named[s])
        size = np.abs(np.fft.rfft(np.diff(c) / (c[:-1] + weights.TINY)))
        assert got[s].cycle == size[1:].argmax() + 1 and got[s].cyclicality == pytest.approx(size.max() / (size.sum() + weights.TINY))


def test_scan_with_a_factor_for_each_row_equals_a_loop(spark):
    r = np.random.default_rng(3)
    rows = [(s, i, float(r.uniform(0.8, 0.99)), float(r.normal()), float(i == 0)) for s, n in (("a", 9000), ("b", 5), ("c", 600)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, idx long, f double, x double, one double").repartition(4)
    out = scan.varying_scan(scan.varying_scan(df, "x", "f", "y", 0.99, 0.8), "one", "f", "p", 0.99, 0.8).toPandas().sort_values(["symbol", "idx"])
    for s in ("a", "b", "c"):
        g = out[out.symbol == s]
        y, p, ys, ps = 0.0, 0.0, [], []
        for f, x, one in zip(g.f, g.x, g.one, strict=True):
            y, p = f * y + x, f * p + one
            ys.append(y)
            ps.append(p)
        assert np.allclose(g.y, ys, atol=1e-12) and np.allclose(g.p, ps, rtol=1e-9, atol=1e-17)
