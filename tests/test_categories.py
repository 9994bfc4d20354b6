"""Hidden models over categories: stretches side by side against the recursion of each, and packed series against sorted rows."""

import numpy as np
import pytest
from barloom.operators import categories, chains, hmm
from pyspark.sql import functions as F

K, SYMBOLS = 4, 7
SIZES = (1, 2, 300, 901, 4, 64, 65)


def made(seed=1, stay=0.9):
    r = np.random.default_rng(seed)
    model = hmm.Model(r.dirichlet(np.ones(K)), stay * np.eye(K) + (1 - stay) * r.dirichlet(np.ones(K), K), emit=r.dirichlet(np.ones(SYMBOLS), K))
    return r, model, [r.integers(0, SYMBOLS, n) for n in SIZES]


def test_series_side_by_side_count_as_one_after_the_other():
    r, m, series = made()
    head, before, after = r.random(len(series)) < 0.5, r.dirichlet(np.ones(K), len(series)), r.random((len(series), K))
    got = categories.expected(m.move, m.emit, series, head, before, after)
    want = 0.0
    for x, h, a, z in zip(series, head, before, after, strict=True):
        b, top = hmm.emissions(m, x[:, None])
        _, gamma, moves, log = chains.smoothed(m.move, b, h, a, z)
        seen = np.array([gamma[x == v].sum(axis=0) for v in range(SYMBOLS)]).T
        want = want + np.concatenate([[log + top], gamma[0] * h, moves.ravel(), seen.ravel()])
    assert np.allclose(got, want, rtol=1e-10, atol=1e-12)


@pytest.mark.parametrize("stay", [0.0, 0.9, 1.0])
def test_matrices_side_by_side_equal_single_ones(stay):
    """Whether their rows become one soon, late or never."""
    r, m, series = made(2, stay)
    head = np.arange(len(series)) % 2 == 0
    for x, h, got in zip(series, head, categories.transfers(m.move, m.emit, series, head), strict=True):
        want = chains.transfer(m.move, hmm.emissions(m, x[:, None])[0], h)
        assert np.allclose(got / got.max(), want / want.max(), rtol=1e-9, atol=1e-14)


@pytest.mark.parametrize("symbols", [9, 300])
def test_packed_series_hold_all_values_in_order(spark, symbols):
    """Rows of several values, NULL and none; rows of one time go by place; blocks cut pieces, rows and times."""
    r = np.random.default_rng(4)
    rows = [(s, int(t), [None if r.random() < 0.1 else int(v) for v in r.integers(0, symbols, r.integers(0, 4))]) for s, n in (("a", 200), ("b", 3), ("c", 1)) for t in r.permutation(n)]
    rows += [("d", 5, [0, 1, 2]), ("d", 5, [0, 1, 2]), ("d", 4, [-1, symbols - 2]), ("d", 9, None), (None, 1, [1]), ("e", 1, [None]), ("e", None, [1])]
    df = spark.createDataFrame(rows, "symbol string, ts int, x array<int>")
    for stretch in (F.floor(F.col("ts") / 20), F.floor(F.col("ts") / 1000)):
        got = categories.packed_blocks(df, "x", symbols, 16, stretch).collect()
        kind = np.uint8 if symbols <= 256 else "<i4"
        for s in "abcd":
            mine = sorted((g for g in got if g.symbol == s), key=lambda g: g.unit)
            want = [v % symbols for name, _, xs in sorted((x for x in rows if x[0] == s), key=lambda x: x[1]) for v in xs or () if v is not None] if s != "d" else [symbols - 1, symbols - 2, 0, 0, 1, 1, 2, 2]
            assert np.concatenate([np.frombuffer(g.x, kind) for g in mine]).tolist() == want
            assert [g.unit for g in mine] == list(range(-(-len(want) // 16))) and {g.units for g in mine} == {len(mine)}
            assert all(len(np.frombuffer(g.x, kind)) == 16 for g in mine[:-1])
        assert {g.symbol for g in got} == set("abcd")
    with pytest.raises(Exception, match="values must be"):
        categories.packed_blocks(spark.createDataFrame([("a", 1, symbols)], "symbol string, ts int, x int"), "x", symbols, 16, F.lit(0)).collect()


def test_rows_of_several_values_fit_as_single_rows_do(spark, monkeypatch):
    """Series of one stretch and of many; likelihoods never fall."""
    r = np.random.default_rng(6)
    draws = [(s, t, sorted(int(v) for v in r.integers(0, 5, 3))) for s, n in (("long", 300), ("short", 30)) for t in range(n)]
    rows = spark.createDataFrame(draws, "symbol string, ts int, x array<int>")
    single = rows.select("symbol", F.posexplode("x").alias("place", "v"), "ts").select("symbol", F.struct("ts", "place").alias("ts"), F.col("v").alias("x"))
    monkeypatch.setattr(hmm, "BLOCK", 100)
    several = [hmm.fit_categorical(rows, "x", 5, k=3, iterations=i, tolerance=0, stretch=F.floor(F.col("ts") / 50)) for i in (1, 4)]
    assert several[0].log_likelihood <= several[1].log_likelihood
    monkeypatch.setattr(hmm, "BLOCK", 5000)
    whole = hmm.fit_categorical(single, "x", 5, k=3, iterations=4, tolerance=0, stretch=F.floor(F.col("ts.ts") / 50))
    assert np.allclose(several[1].flat(), whole.flat(), rtol=1e-9)
    with pytest.raises(ValueError, match="no values"):
        hmm.fit_categorical(rows.where("false"), "x", 5, stretch=F.lit(0))
