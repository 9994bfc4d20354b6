"""Quantiles by counting against numpy, for groups with ties, wide spreads and few values."""

import numpy as np
import pytest
from barloom.functions import selection
from pyspark.sql import functions as F


def test_quantiles_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 5)
    monkeypatch.setattr(selection, "CELLS", 16)
    r = np.random.default_rng(1)
    groups = {"normal": r.normal(size=500), "ties": r.integers(0, 3, 400).astype(float), "flat": np.ones(50), "wide": 10.0 ** r.integers(-30, 30, 200), "two": np.array([1.0, 4.0]), "one": np.array([-0.0])}
    rows = [(g, float(v), "x") for g, vs in groups.items() for v in vs] + [("normal", None, "x"), ("nothing", None, "x")]
    df = spark.createDataFrame(rows, "g string, a double, v string").repartition(5)
    shares = {"low": 0.1, "median": 0.5, "q70": 0.7, "top": 1.0}
    got = {r.g: r for r in selection.quantiles(df, ["g"], "a", shares).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        for n, q in shares.items():
            assert got[g][n] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-300)
    whole = selection.quantiles(df, [], F.col("a") * 2, {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0].m == pytest.approx(2 * np.median(np.concatenate(list(groups.values()))))
    assert selection.quantiles(df.where("a is null"), ["g"], "a", shares).collect() == []


def test_each_place_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 1)
    monkeypatch.setattr(selection, "CELLS", 2)
    values = [0.0, 0.0, 1e-300, 5.0, 5.0, 5.5, 1e300]
    df = spark.createDataFrame([("a", v) for v in values[::-1]], "g string, v double")
    wanted = spark.createDataFrame([("a", i) for i in range(7)], "g string, place long")
    assert [r.value for r in selection.places(df, ["g"], wanted).orderBy("place").collect()] == values
