"""Gram-based regressions against brute-force NumPy on hand-made series."""

import numpy as np
import pytest
import pandas as pd

from swellcast.operators.adf import adf


def _long(spark, series: dict[str, np.ndarray]):
    rows = [(k, "y", int(i), float(v)) for k, arr in series.items() for i, v in enumerate(arr)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "col", "idx", "value"]))


def _adf_brute(y: np.ndarray, maxlag: int):
    dy = np.diff(y)
    def design(lag, start):
        rows = []
        for t in range(start, len(y)):
            rows.append([1.0, y[t - 1]] + [dy[t - 1 - k] for k in range(1, lag + 1)] + [dy[t - 1]])
        z = np.array(rows)
        return z[:, :-1], z[:, -1]
    best = None
    for lag in range(maxlag + 1):
        x, r = design(lag, maxlag + 1)
        beta, *_ = np.linalg.lstsq(x, r, rcond=None)
        ssr = float(((r - x @ beta) ** 2).sum())
        n = len(r)
        a = n * (np.log(2 * np.pi) + np.log(ssr / n) + 1) + 2 * x.shape[1]
        if best is None or a < best[0] - 1e-12 * abs(best[0]):
            best = (a, lag)
    lag = best[1]
    x, r = design(lag, lag + 1)
    beta, *_ = np.linalg.lstsq(x, r, rcond=None)
    ssr = float(((r - x @ beta) ** 2).sum())
    s2 = ssr / (len(r) - x.shape[1])
    se = np.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1])
    return beta[1] / se, lag


def test_adf_matches_bruteforce_chunked(spark):
    rng = np.random.default_rng(7)
    e = rng.normal(size=600)
    ar1 = np.zeros(600)
    for t in range(1, 600):
        ar1[t] = 0.7 * ar1[t - 1] + e[t]
    walk = np.cumsum(rng.normal(size=600))
    df = _long(spark, {"ar1": ar1, "walk": walk})
    got = {r["series_id"]: r for r in adf(df, maxlag=12, chunk=97).collect()}
    for name, y in (("ar1", ar1), ("walk", walk)):
        t, lag = _adf_brute(y, 12)
        assert got[name]["used_lag"] == lag
        assert abs(got[name]["adf_stat"] - t) < 1e-6 * max(1, abs(t))
    assert got["ar1"]["stationary"] and not got["walk"]["stationary"]


def _hr_brute(y: np.ndarray, m: int):
    n = len(y)
    x = np.column_stack([np.ones(n - m)] + [y[m - k:n - k] for k in range(1, m + 1)])
    a, *_ = np.linalg.lstsq(x, y[m:], rcond=None)
    e = np.full(n, np.nan)
    e[m:] = y[m:] - x @ a
    x2 = np.column_stack([np.ones(n - m - 1), y[m:n - 1], e[m:n - 1]])
    b, *_ = np.linalg.lstsq(x2, y[m + 1:], rcond=None)
    return b, e[-1]


def test_hannan_rissanen_matches_bruteforce(spark):
    from swellcast.operators.arima import forecast, hannan_rissanen
    rng = np.random.default_rng(11)
    n, phi, theta = 1500, 0.6, 0.3
    w = rng.normal(size=n)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.5 + phi * y[t - 1] + w[t] + theta * w[t - 1]
    df = _long(spark, {"arma": y})
    r = hannan_rissanen(df, m=15, chunk=211).collect()[0]
    b, e_last = _hr_brute(y, 15)
    assert np.allclose([r["c"], r["phi"], r["theta"]], b, atol=1e-8)
    assert abs(r["e_last"] - e_last) < 1e-8 and r["last_idx"] == n - 1
    assert abs(r["phi"] - phi) < 0.1 and abs(r["theta"] - theta) < 0.15
    f = {x["step"]: x["yhat"] for x in forecast(hannan_rissanen(df, m=15), 3).collect()}
    f1 = b[0] + b[1] * y[-1] + b[2] * e_last
    assert abs(f[1] - f1) < 1e-8 and abs(f[2] - (b[0] + b[1] * f1)) < 1e-8


def _mk_brute(y):
    n = len(y)
    s = sum(np.sign(y[j] - y[i]) for i in range(n) for j in range(i + 1, n))
    _, t = np.unique(y, return_counts=True)
    var = (n * (n - 1) * (2 * n + 5) - (t * (t - 1) * (2 * t + 5)).sum()) / 18
    return int(s), var


def test_mann_kendall_matches_bruteforce(spark):
    from swellcast.operators.trend import mk_score
    rng = np.random.default_rng(3)
    series = {
        "rising": np.arange(60, dtype=float),
        "noise": rng.normal(size=300).round(1),          # many ties
        "heavy": np.where(rng.random(400) < 0.4, 1.0, rng.normal(size=400).round(2)),  # one hot value
        "constant": np.ones(50),
    }
    got = {r["series_id"]: r for r in mk_score(_long(spark, series)).collect()}
    for k, y in series.items():
        s, var = _mk_brute(y)
        assert got[k]["s"] == s, (k, got[k]["s"], s)
        assert abs(got[k]["var_s"] - var) < 1e-6 * max(1, var)
    assert got["rising"]["s"] == 60 * 59 // 2


def test_hp_filter_chunked_matches_full_solve(spark):
    from swellcast.operators.filters import hp_bands, hp_filter
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.normal(size=900)) + np.sin(np.arange(900) / 9.0)
    n = len(y)
    d = np.zeros((n - 2, n))
    for r in range(n - 2):
        d[r, r:r + 3] = [1, -2, 1]
    full = np.linalg.solve(np.eye(n) + 1600 * d.T @ d, y)
    d0, d1, d2 = hp_bands(n, 1600.0)
    assert np.allclose(np.diag(np.eye(n) + 1600 * d.T @ d), d0)
    got = hp_filter(_long(spark, {"s": y}), chunk=150).toPandas().sort_values("idx")
    assert len(got) == n
    assert np.max(np.abs(got["trend"].to_numpy() - full)) < 1e-7 * max(1.0, np.abs(full).max())


def test_poly_detrend_matches_polyfit(spark):
    from swellcast.operators.seasonal import poly_detrend
    rng = np.random.default_rng(9)
    t = np.arange(500, dtype=float)
    y = 0.001 * (t - 250) ** 2 - 0.02 * t + rng.normal(size=500)
    got = poly_detrend(_long(spark, {"s": y}), degree=4).toPandas().sort_values("idx")
    want = np.polyval(np.polyfit(t, y, 4), t)
    assert np.max(np.abs(got["trend"].to_numpy() - want)) < 1e-6


def test_pacf_matches_yule_walker():
    from swellcast.operators.diagnostics import _durbin_levinson
    rng = np.random.default_rng(2)
    y = np.convolve(rng.normal(size=800), [1, 0.6, 0.3], mode="same")
    d = y - y.mean()
    r = np.array([np.dot(d[k:], d[:len(d) - k]) for k in range(11)]) / np.dot(d, d)
    got = _durbin_levinson(r)
    for k in range(1, 11):
        toe = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert abs(got[k] - np.linalg.solve(toe, r[1:k + 1])[-1]) < 1e-10


@pytest.mark.parametrize("lamb,close", [(1600.0, 1e-9), (129_600.0, 1e-9), (1e8, 1e-6)])
def test_hp_filter_does_not_depend_on_chunks(spark, lamb, close):
    from swellcast.operators.filters import hp_bands, hp_filter, solve_penta
    rng = np.random.default_rng(6)
    series = {"long": np.cumsum(rng.normal(size=1203)), "short": rng.normal(size=5), "three": np.array([1.0, 5.0, 2.0]), "one": np.array([4.0])}
    want = {}
    for k, y in series.items():
        n = len(y)
        d = np.zeros((max(n - 2, 0), n))
        for r in range(n - 2):
            d[r, r:r + 3] = [1, -2, 1]
        want[k] = np.linalg.solve(np.eye(n) + lamb * d.T @ d, y)
        assert np.allclose(solve_penta(*hp_bands(n, lamb), y), want[k], rtol=0, atol=close * np.abs(y).max())
    for chunk in (4, 7, 100, 1203, 5000):
        got = hp_filter(_long(spark, series), lamb=lamb, chunk=chunk).toPandas().sort_values(["series_id", "idx"])
        for k, y in series.items():
            own = got[got["series_id"] == k]
            assert np.max(np.abs(own["trend"].to_numpy() - want[k])) < close * np.abs(y).max(), (k, chunk)
            assert np.allclose(own["cycle"].to_numpy() + own["trend"].to_numpy(), y)


def test_adf_forms_equal_plain_regressions(spark):
    from swellcast.operators.adf import adf
    rng = np.random.default_rng(4)
    n, lag = 400, 3
    y = np.cumsum(rng.normal(size=n)) + 0.01 * np.arange(n)
    dy = np.diff(y)
    t = np.arange(lag + 1, n)
    for form, trend in {"n": 0, "c": 1, "ct": 2, "ctt": 3}.items():
        z = np.column_stack([*(t.astype(float) ** k for k in range(trend)), y[t - 1], *(dy[t - 1 - k] for k in range(1, lag + 1))])
        beta, _, _, _ = np.linalg.lstsq(z, dy[t - 1], rcond=None)
        left = dy[t - 1] - z @ beta
        cov = np.linalg.inv(z.T @ z) * (left @ left) / (len(t) - z.shape[1])
        r = adf(_long(spark, {"s": y}), maxlag=lag, regression=form, autolag=False, chunk=90).first()
        assert r.nobs == len(t) and r.adf_stat == pytest.approx(beta[trend] / np.sqrt(cov[trend, trend]), rel=1e-6), form
        assert 0 <= r.p_value <= 1
    with pytest.raises(ValueError, match="ctt"):
        adf(_long(spark, {"s": y}), regression="x")


def test_mackinnon_levels():
    """Asymptotic 5 % critical values of the four forms lie near p = 0.05."""
    from swellcast.operators.adf import mackinnon_p
    for form, critical in {"n": -1.941, "c": -2.862, "ct": -3.411, "ctt": -3.832}.items():
        assert abs(mackinnon_p(critical, form) - 0.05) < 0.002, form


def test_recursive_trees_equal_a_plain_loop(spark):
    from pyspark.ml.feature import VectorAssembler
    from swellcast.operators.recursive import fit_models, lag_features, predict_recursive
    rng = np.random.default_rng(4)
    lags, means, horizon = [1, 3], [(1, 3)], 14
    feats = lag_features(lags, means) + ["ex"]
    rows = [(s, c, float(rng.normal()), *map(float, rng.normal(size=4))) for s in "ab" for c in ("u", "v") for _ in range(80)]
    train = spark.createDataFrame(rows, "series_id string, col string, label double, " + ", ".join(f"{f} double" for f in feats))
    fitted = fit_models(train, ["u", "v"], ["ex"], lags, means, max_iter=4, max_depth=3)
    known = [(s, c, -r, float(rng.normal())) for s in "ab" for c in ("u", "v") for r in range(3)]
    ahead = [(s, r, float(rng.normal())) for s in "ab" for r in range(1, horizon + 1)]
    state = spark.createDataFrame(known, "series_id string, col string, r long, value double")
    future = spark.createDataFrame(ahead, "series_id string, r long, ex double")
    got = {(r["series_id"], r["col"], r["r"]): r["yhat"] for r in predict_recursive(fitted, state, future, horizon, lags, means, ["ex"], 5).collect()}
    want, asm = {}, VectorAssembler(inputCols=feats, outputCol="_features")
    hist = {(s, c, r): v for s, c, r, v in known}
    ex = {(s, r): v for s, r, v in ahead}
    for h in range(1, 4):
        for s in "ab":
            for c in ("u", "v"):
                x = [hist[s, c, h - k] for k in lags] + [np.mean([hist[s, c, h - k] for k in (1, 2, 3)]), ex[s, h]]
                one = asm.transform(spark.createDataFrame([tuple(map(float, x))], feats))
                hist[s, c, h] = want[s, c, h] = fitted["models"][c].transform(one).first()["yhat"]
    assert len(got) == 4 * horizon and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    with pytest.raises(Exception, match="lack some"):
        predict_recursive(fitted, state, future.where("r <> 5"), horizon, lags, means, ["ex"]).collect()


def test_model_imputation_fills_gaps(spark):
    from pyspark.sql import functions as F
    from swellcast.operators.impute import impute_arma
    from swellcast.operators.windows import ffill
    rng = np.random.default_rng(8)
    n = 1200
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 1.0 + 0.7 * y[t - 1] + rng.normal()
    raw = y.copy()
    holes = [300, 301, 302, 650, 900]
    raw[holes] = np.nan
    rows = [("s", "y", i, None if np.isnan(v) else float(v)) for i, v in enumerate(raw)]
    df = spark.createDataFrame(rows, "series_id string, col string, idx long, value double")
    filled = ffill(df.withColumnRenamed("col", "c_").withColumn("col", F.col("c_")).drop("c_"), ["value"])
    got = impute_arma(df, filled.select("series_id", "col", "idx", "value"), chunk=257) \
        .toPandas().sort_values("idx")
    assert len(got) == n and got["value"].notna().all()
    assert np.allclose(got.loc[~got["imputed"], "value"].to_numpy(), np.delete(y, holes))
    v = got.set_index("idx")["value"]
    # an isolated gap gets roughly c + phi * previous (phi ~ 0.7, c ~ 1)
    assert abs(v[650] - (1.0 + 0.7 * v[649])) < 0.5


def test_gaps_of_any_length_do_not_depend_on_chunks(spark):
    from swellcast.operators.impute import fill_gaps
    rng = np.random.default_rng(11)
    n = 1400
    y = np.cumsum(rng.normal(size=n))
    y[:130] = np.nan                     # a leading gap over a chunk border
    y[400:700] = np.nan                  # 300 hours
    y[rng.choice(np.arange(750, n), 90, replace=False)] = np.nan
    rows = [("s", c, i, None if np.isnan(v) else float(v)) for c in ("a", "b", "d") for i, v in enumerate(y)] + [("s", "none", i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "series_id string, col string, idx long, value double")
    model = spark.createDataFrame([("s", "a", 0, 2, 1, 0.1, [0.6, 0.2], [0.4]), ("s", "b", 0, 1, 0, 0.2, [0.8], []),
                                   ("s", "d", 1, 1, 2, 0.0, [0.3], [0.2, -0.1]), ("s", "none", 0, 1, 0, 0.0, [0.5], [])],
                                  "series_id string, col string, d int, p int, q int, c double, phi array<double>, theta array<double>")
    got = {k: fill_gaps(df, model, chunk=k).toPandas().sort_values(["col", "idx"], ignore_index=True) for k in (100, 1000, 10_000)}
    one = got[10_000]
    assert one[one["col"] == "none"]["value"].isna().all()
    assert one[one["col"] != "none"]["value"].notna().all() and (one[(one["col"] == "a") & (one["idx"] < 130)]["value"] == y[130]).all()
    for k in (100, 1000):
        assert np.allclose(got[k]["value"], one["value"], rtol=1e-9, atol=1e-9, equal_nan=True) and (got[k]["imputed"] == one["imputed"]).all()
    # the AR(1) column against its plain recursion
    b = one[one["col"] == "b"]["value"].to_numpy()
    for t in range(131, n):
        assert abs(b[t] - (0.2 + 0.8 * b[t - 1] if np.isnan(y[t]) else y[t])) < 1e-9


def test_random_search_picks_min_objective(spark):
    from pyspark.sql import functions as F
    from swellcast.operators.tuning import random_search, sample_trials
    rng = np.random.default_rng(21)
    n = 260
    t = np.arange(n)
    rows = []
    for s in ("a", "b"):
        y = 5 + np.sin(t / 6.0) + rng.normal(size=n) * 0.1
        for i in range(n):
            rows.append((s, int(i), float(y[i]), float(y[i - 3]) if i >= 3 else None, float(np.sin(i / 6.0))))
    df = spark.createDataFrame(rows, "series_id string, idx long, y double, f_lag double, f_sin double")
    trials = sample_trials(2, seed=1)
    assert trials == sample_trials(2, seed=1)                         # seeded
    assert all(300 <= tr["n_estimators"] <= 1200 and 3 <= tr["max_depth"] <= 12 for tr in trials)
    trials = [tr | {"n_estimators": 2 + i, "max_depth": 3} for i, tr in enumerate(trials)]  # small trials of this test's own
    obj, best = random_search(df, ["f_lag", "f_sin"], ["y"], trials, window=120, horizon=24, step=60,
                              workers=2)
    o = {(r["series_id"], r["trial_id"]): r["objective"] for r in obj.collect()}
    for r in best.collect():
        cand = {k[1]: v for k, v in o.items() if k[0] == r["series_id"]}
        assert r["best_value"] == min(cand.values())
        assert r["best_trial"] == min(k for k, v in cand.items() if v == r["best_value"])


def test_cf_cycle_equals_the_weighted_sums(spark):
    from swellcast.operators.cf import cf_cycle, weights
    rng = np.random.default_rng(3)
    series = {"long": np.cumsum(rng.normal(size=333)), "two": np.array([1.0, 4.0]), "one": np.array([2.0]), "three": np.array([1.0, 0.0, 5.0])}
    got = {c: cf_cycle(_long(spark, series), chunk=c).toPandas().sort_values(["series_id", "idx"], ignore_index=True) for c in (10, 333, 1000)}
    for c in (10, 1000):
        assert np.allclose(got[c]["cycle"], got[333]["cycle"], atol=1e-10)
    for name, y in series.items():
        n = len(y)
        if n == 1:
            want = np.zeros(1)
        else:
            x, b = y - np.arange(n) * (y[-1] - y[0]) / (n - 1), weights(n + 1, 6, 32)
            want = np.empty(n)
            for i in range(n):
                w = np.array([b[abs(t - i)] for t in range(n)])
                w[0] = w[-1] = 0.0
                w[0] += -b[0] / 2 - b[1:max(i, 1)].sum()
                w[-1] += -b[0] / 2 - b[1:max(n - 1 - i, 1)].sum()
                w[i] += b[0] if i in (0, n - 1) else 0.0
                want[i] = w @ x
                assert abs(w.sum()) < 1e-9
        own = got[10][got[10]["series_id"] == name]["cycle"].to_numpy()
        assert np.allclose(own, want, atol=1e-9), name


def test_impute_arma_keeps_series_without_a_model(spark):
    from swellcast.operators.impute import impute_arma
    short = [("short", "v", i, None if i in (0, 4, 5) else float(i)) for i in range(10)]
    empty = [("empty", "v", i, None) for i in range(30)]
    schema = "series_id string, col string, idx long, value double"
    seen = [x[3] for x in short if x[3] is not None]
    filled = [(*x[:3], x[3] if x[3] is not None else 1.0) for x in short] + empty
    got = impute_arma(spark.createDataFrame(short + empty, schema), spark.createDataFrame(filled, schema), chunk=7).collect()
    one = {r.idx: (r.value, r.imputed) for r in got if r.series_id == "short"}
    assert one == {i: (v, False) if v is not None else (1.0 if i == 0 else pytest.approx(sum(seen) / len(seen)), True) for _, _, i, v in short}
    assert sorted((r.idx, r.value, r.imputed) for r in got if r.series_id == "empty") == [(i, None, True) for i in range(30)]
