"""Hidden-state operators against the plain recursions on whole series."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from barloom.operators import chains, config_search, hmm
from barloom.operators.walk_forward import walk_forward

START = datetime(2025, 1, 1)


def plain(m, x):
    """Filtered and smoothed probabilities, moves and log likelihood, row after row."""
    log_b = m.log_emission(x)
    b = np.exp(log_b - log_b.max(axis=1, keepdims=True)) + 1e-300
    alpha, scale, a = np.empty(b.shape), np.empty(len(x)), m.start * b[0]
    for t in range(len(x)):
        a = a if t == 0 else (alpha[t - 1] @ m.move) * b[t]
        scale[t], alpha[t] = a.sum(), a / a.sum()
    beta, moves, gamma = np.ones(len(m.start)), np.zeros(m.move.shape), alpha.copy()
    for t in range(len(x) - 2, -1, -1):
        ahead = b[t + 1] * beta / scale[t + 1]
        moves += alpha[t][:, None] * m.move * ahead
        beta = m.move @ ahead
        gamma[t] = alpha[t] * beta
    return alpha, gamma / gamma.sum(axis=1, keepdims=True), moves, np.log(scale).sum() + log_b.max(axis=1).sum()


def plain_path(m, x):
    log_b, move = m.log_emission(x), np.log(m.move + 1e-300)
    score, back = np.log(m.start + 1e-300) + log_b[0], np.zeros(log_b.shape, dtype=int)
    for t in range(1, len(x)):
        back[t] = (score[:, None] + move).argmax(axis=0)
        score = (score[:, None] + move).max(axis=0) + log_b[t]
    path = [int(score.argmax())]
    for t in range(len(x) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def plain_fit(x, k, cov="full", iterations=200, tolerance=1e-4):
    m, d = hmm._start_model(x, k), x.shape[1]
    for _ in range(iterations):
        _, gamma, moves, log = plain(m, x)
        count = gamma.sum(axis=0)
        mean = gamma.T @ x / count[:, None]
        gap = x[None] - mean[:, None]
        spread = np.einsum("tk,kti,ktj->kij", gamma, gap, gap) / count[:, None, None]
        if cov == "diag":
            spread = np.stack([np.diag(np.diag(s)) for s in spread])
        done = m.log_likelihood > -np.inf and log - m.log_likelihood < tolerance * abs(m.log_likelihood)
        moves = moves + 1e-6
        m = hmm.Model(gamma[0], moves / moves.sum(axis=1, keepdims=True), mean, spread + hmm.FLOOR * np.eye(d), log_likelihood=log)
        if done:
            break
    return m


def random_model(r, k, d=2):
    return hmm.Model(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.normal(size=(k, d)), np.stack([np.eye(d) * (0.5 + i) for i in range(k)]))


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_stretches_equal_the_plain_recursions(k):
    r = np.random.default_rng(k)
    for n in (1, 2, 3, 7, 50, 501):
        m, x = random_model(r, k), r.normal(size=(n, 2)) * 2
        b, top = hmm.emissions(m, x)
        want = plain(m, x)
        got = chains.smoothed(m.move, b, True, m.start, np.ones(k))
        assert all(np.allclose(g, w) for g, w in zip(got[:3], want[:3], strict=True)) and np.isclose(got[3] + top, want[3])
        assert (chains.best_path(np.log(m.move), m.log_emission(x), True, np.log(m.start), None) == plain_path(m, x)).all()


def frame(spark, series):
    """Rows of named arrays of two features."""
    rows = [(s, START + timedelta(minutes=i), float(v[0]), float(v[1])) for s, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, x double, y double")


def test_a_long_series_in_many_stretches_equals_one_recursion(spark, monkeypatch):
    """10,000 rows in stretches of 300, and chains of 6 of these: path, posterior and counts are those of the whole."""
    monkeypatch.setattr(hmm, "BLOCK", 300)
    monkeypatch.setattr(chains, "FAN", 6)
    r = np.random.default_rng(5)
    m = random_model(r, 3)
    series = {"long": r.normal(size=(10_000, 2)) * 2, "short": r.normal(size=(40, 2)), "one": r.normal(size=(1, 2))}
    df = frame(spark, series)
    out = hmm.decode(df, m, ["x", "y"]).toPandas()
    shape = hmm.Shape(3, 2, "full")
    sums, log, moves = None, 0.0, np.zeros((3, 3))
    for s, x in series.items():
        got = out[out.symbol == s].sort_values("ts")
        _, gamma, some, one = plain(m, x)
        log, moves = log + one, moves + some
        assert np.allclose(np.stack(got.probs), gamma) and (got.state.to_numpy() == plain_path(m, x)).all()
    models = spark.createDataFrame([("", m.flat().tolist())], "model string, params array<double>")
    sums = np.array(hmm.expected_counts(*hmm.series_blocks(df, ["x", "y"]), models, shape).first().sums)
    assert np.isclose(sums[0], log) and np.allclose(sums[4:13].reshape(3, 3), moves)


def planted(spark, n=1500, symbols=3):
    r = np.random.default_rng(3)
    state, rows, truth = 0, [], []
    for i in range(n):
        if r.random() < 0.04:
            state = (state + 1) % 3
        truth.append(state)
        rows.append((f"s{i * symbols // n}", START + timedelta(minutes=i), float(r.normal([-3, 0, 3][state], 0.5)), float(r.normal([1, 0, 1][state], 0.5))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, x double, y double"), np.array(truth)


@pytest.mark.parametrize("cov", ["diag", "full"])
def test_hidden_states_are_recovered_and_likelihood_never_falls(spark, monkeypatch, cov):
    df, truth = planted(spark)
    monkeypatch.setattr(hmm, "BLOCK", 200)
    logs = [hmm.fit(df, ["x", "y"], cov=cov, iterations=i, tolerance=0).log_likelihood for i in (1, 2, 3)]
    assert logs[0] <= logs[1] + 1e-6 and logs[1] <= logs[2] + 1e-6
    out = hmm.decode(df, hmm.fit(df, ["x", "y"], cov=cov), ["x", "y"]).toPandas().sort_values("ts")
    assert np.allclose([sum(p) for p in out.probs], 1)
    assert pd.crosstab(out.state.to_numpy(), truth).to_numpy().max(axis=1).sum() >= 0.97 * len(truth)


def test_models_fitted_where_they_lie_and_by_passes_agree(spark, monkeypatch):
    """One model for each symbol: as a single stretch, in stretches, and by the plain loop; a degenerate one is left out."""
    df, _ = planted(spark, 900)
    names, shape = ["x", "y"], hmm.Shape(3, 2, "full")
    found = {}
    for block in (5000, 90):
        monkeypatch.setattr(hmm, "BLOCK", block)
        starts = hmm.start_models(df, names, shape, model=df.symbol)
        bad = hmm.Model(np.ones(3) / 3, np.ones((3, 3)) / 3, np.zeros((3, 2)), np.full((3, 2, 2), -1.0)).flat().tolist()
        starts = starts.where("model <> 's2'").unionByName(spark.createDataFrame([("s2", bad)], starts.schema))
        out = hmm.em(*hmm.series_blocks(df, names, model=df.symbol), starts, shape, tolerance=1e-6)
        found[block] = {r.model: np.array(r.params) for r in out.collect()}
        assert found[block].keys() == {"s0", "s1"}
    pdf = df.toPandas().sort_values("ts")
    for s in ("s0", "s1"):
        x = pdf[pdf.symbol == s][names].to_numpy()
        want = plain_fit(x, 3, tolerance=1e-6)
        order = np.argsort(want.mean[:, 0])
        for flat in (found[5000][s], found[90][s]):
            got = shape.model(flat)
            mine = np.argsort(got.mean[:, 0])
            assert np.allclose(got.mean[mine], want.mean[order], atol=1e-3) and np.isclose(got.log_likelihood, want.log_likelihood, rtol=1e-5)


def test_categorical_states_are_recovered(spark, monkeypatch):
    r = np.random.default_rng(2)
    emit, state, rows = np.array([[0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.05, 0.05, 0.9]]), 0, []
    for i in range(3000):
        state = (state + 1) % 3 if r.random() < 0.1 else state
        rows.append((f"s{i // 1000}", i % 1000, int(r.choice(3, p=emit[state]))))
    df = spark.createDataFrame([*rows, ("s0", -1, None)], "symbol string, ts long, x int")
    early = df.ts / 100
    logs = [hmm.fit_categorical(df, "x", 3, k=3, iterations=i, tolerance=0, stretch=early.cast("long")).log_likelihood for i in (2, 5)]
    assert logs[0] <= logs[1]
    monkeypatch.setattr(hmm, "BLOCK", 150)
    cut = hmm.fit_categorical(df, "x", 3, k=3, iterations=5, tolerance=0, stretch=early.cast("long"))
    assert cut.log_likelihood == pytest.approx(logs[1], rel=1e-9)
    got = hmm.fit_categorical(df, "x", 3, k=3, stretch=early.cast("long")).emit
    assert np.allclose(got[np.argsort(got.argmax(axis=1))], emit, atol=0.08)


@pytest.mark.parametrize(("stride", "block"), [(25, 2048), (7, 60), (1, 60)])
def test_walk_forward_equals_a_refit_on_all_rows_before(spark, monkeypatch, stride, block):
    monkeypatch.setattr(hmm, "BLOCK", block)
    df, _ = planted(spark, 300, 1)
    pdf = df.toPandas().sort_values("ts").reset_index(drop=True)
    fwd = pdf.x.shift(-3) / 100
    rows = [("a", t.to_pydatetime(), i, 300, None if np.isnan(f) else float(f), x, y) for i, (t, x, y, f) in enumerate(zip(pdf.ts, pdf.x, pdf.y, fwd, strict=True))]
    rows += [("few", START + timedelta(minutes=i), i, 20, 0.01, float(i), 0.0) for i in range(20)]
    schema = "symbol string, ts timestamp, idx long, n long, fwd double, x double, y double"
    got = walk_forward(spark.createDataFrame(rows, schema), ["x", "y"], stride=stride).toPandas().sort_values("ts")
    want, m = [], pdf[["x", "y"]].to_numpy()
    for start in range(210, 300, stride):
        mean, sd = m[:start].mean(axis=0), m[:start].std(axis=0)
        model = plain_fit((m[:start] - mean) / sd, 3)
        f = fwd.to_numpy()[:start].copy()
        f[-3:] = np.nan
        for i in range(start, min(start + stride, 300)):
            states = plain(model, (m[: i + 1] - mean) / sd)[0].argmax(axis=1)  # no row after i
            means = [f[(states[:start] == s) & ~np.isnan(f)].mean() for s in range(3)]
            want.append(int(states[i] == np.argmax(means)) - int(states[i] == np.argmin(means)))
    mine = got[got.symbol == "a"]
    assert mine.prediction.tolist() == want and len(set(want)) > 1
    assert mine.label.isna().sum() == 3
    assert got[got.symbol == "few"].prediction.tolist() == [0] * 6


def test_later_rows_do_not_change_walk_forward_positions(spark):
    df, _ = planted(spark, 260, 1)
    pdf = df.toPandas().sort_values("ts").reset_index(drop=True)
    out = []
    for shift in (0.0, 50.0):
        rows = [("a", t.to_pydatetime(), i, 260, 0.01 * x, x + (shift if i >= 230 else 0.0), y) for i, (t, x, y) in enumerate(zip(pdf.ts, pdf.x, pdf.y, strict=True))]
        got = walk_forward(spark.createDataFrame(rows, "symbol string, ts timestamp, idx long, n long, fwd double, x double, y double"), ["x", "y"], stride=8)
        out.append(got.toPandas().sort_values("ts").prediction.tolist()[: 230 - 182])
    assert out[0] == out[1] and any(out[0])


def bars(spark, n=140, symbols=("a", "b"), seed=5):
    r = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        close = 100 + np.cumsum(r.normal(size=n))
        for i, c in enumerate(close):
            o = c + r.normal() / 2
            rows.append((s, START + timedelta(hours=i), *map(float, (o, max(o, c) + r.random(), min(o, c) - r.random(), c))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double")


def test_configuration_grid_and_features(spark):
    assert len(config_search.parameter_grid(677)) == 77_760 and len(config_search.parameter_grid(96)) == 31_104 and config_search.parameter_grid(12) == []
    star = config_search.parameter_grid(140, star=True)
    assert len(star) == 27 and all(sum(c[k] != star[0][k] for k in c) == 1 for c in star[1:])
    df = bars(spark)
    wide = config_search.shared_features(df, star).toPandas()
    one = wide[wide.symbol == "a"].sort_values("ts").reset_index(drop=True)
    i, c = 100, one.close.to_numpy()
    assert one.loc[i, "momentum_3"] == pytest.approx(c[i] - c[i - 3])
    assert one.loc[i, "boll_z_10"] == pytest.approx((c[i] - c[i - 9 : i + 1].mean()) / c[i - 9 : i + 1].std(ddof=1))
    typical = (one.high + one.low + one.close).to_numpy()[i - 14 : i + 1] / 3
    assert one.loc[i, "cci_15"] == pytest.approx((typical[-1] - typical.mean()) / (0.015 * typical.std(ddof=1)))
    weighted = lambda x, d: [(x[: t + 1] * d ** np.arange(t, -1, -1)).sum() / (d ** np.arange(t + 1)).sum() for t in range(len(x))]
    line = np.array(weighted(c, 1 - 2 / 8)) - np.array(weighted(c, 1 - 2 / 27))
    assert one.loc[i, "macd_7_26_8"] == pytest.approx(line[i] - weighted(line, 1 - 2 / 9)[i])


def test_configuration_search_equals_plain_fits(spark):
    df = bars(spark)
    some = config_search.parameter_grid(140, star=True)[::6]
    short = spark.createDataFrame([("short", START + timedelta(hours=i), 1.0, 2.0, 0.5, 1.0 + i % 3) for i in range(12)], df.schema)
    got = {x.symbol: x for x in config_search.config_search(df.unionByName(short), some).collect()}
    assert got["short"].score == float("-inf") and got["short"].failed == len(some)
    rows = config_search.configured(df, some).toPandas().sort_values("ts")
    for s in ("a", "b"):
        scores = []
        for i in range(len(some)):
            g = rows[(rows.owner == s) & (rows.config == i)]
            x, later = g[[f"z{j}" for j in range(8)]].to_numpy(float), g.later.to_numpy(float)
            states = plain_path(fitted := plain_fit(x, 3, iterations=1000, tolerance=1e-3), x)
            means = [np.nanmean(later[states == j]) for j in range(3)]
            scores.append(float(np.nansum(((states == np.argmax(means)).astype(int) - (states == np.argmin(means))) * later)))
            assert fitted.log_likelihood > -np.inf
        assert got[s].score == pytest.approx(max(scores)) and got[s].tried == len(some) and got[s].failed == 0
