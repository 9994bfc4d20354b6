"""Operators with a fixed look-back give the same rows in small blocks as over whole series."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from barloom.functions.numbering import in_blocks
from barloom.jobs.feature_queries import LOOK_BACKS

START = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    r = np.random.default_rng(5)
    rows = []
    for s, n in (("a", 230), ("b", 61), ("c", 2)):
        close = 100 + np.cumsum(r.normal(size=n))
        close[n // 2] = close[n // 2 - 1]
        for i, c in enumerate(close):
            o = c + (r.normal() / 2 if i % 17 else 0.0)
            reach = r.random(2) if i % 17 else (0.0, 0.0)
            rows.append((s, START + timedelta(hours=9 * i), *map(float, (o, max(o, c) + reach[0], min(o, c) - reach[1], c))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double")


@pytest.mark.parametrize("operator", list(LOOK_BACKS), ids=lambda f: f.__name__)
def test_blocks_give_the_rows_of_whole_series(bars, operator):
    look_back = LOOK_BACKS[operator]
    whole = operator(bars).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    cut = in_blocks(bars, operator, look_back, block=look_back + 3).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert sorted(cut.columns) == sorted(whole.columns)
    for c in whole.columns:
        if whole[c].dtype.kind == "f":
            np.testing.assert_allclose(cut[c], whole[c], rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)
        else:
            assert cut[c].equals(whole[c]), c
