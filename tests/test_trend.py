"""Mann-Kendall counts, Sen's slope and the one-row trend check against all pairs."""

import math

import numpy as np
import pytest

from swellcast.operators import trend

RNG = np.random.default_rng(12)


def long(spark, series):
    rows = [(s, "v", int(i), float(v)) for s, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, col string, idx long, value double")


def slopes(y, t=None):
    y, t = np.asarray(y, float), np.arange(len(y), dtype=float) if t is None else np.asarray(t, float)
    i, j = np.triu_indices(len(y), 1)
    return (y[j] - y[i]) / (t[j] - t[i])


def s_and_var(y):
    y = np.asarray(y, float)
    i, j = np.triu_indices(len(y), 1)
    n, t = len(y), np.unique(y, return_counts=True)[1].astype(float)
    return int(np.sign(y[j] - y[i]).sum()), (n * (n - 1) * (2 * n + 5) - (t * (t - 1) * (2 * t + 5)).sum()) / 18


SERIES = {
    "noise": RNG.normal(size=720).round(2) + 0.01 * np.arange(720),
    "flat": np.where(RNG.random(500) < 0.6, 2.0, RNG.normal(size=500).round(1)),
    "odd": RNG.normal(size=33), "tiny": 1e-7 * np.arange(300) + 1e-9 * RNG.normal(size=300), "two": [1.0, 4.0], "one": [3.0],
    "steps": np.repeat([0.0, 1.0], 150), "constant": np.full(200, 7.0), "down": -0.1 * (np.arange(400) // 7),
    "lattice": RNG.integers(0, 7, 600) * 0.1,
}


def test_increasing_pairs():
    for n in (0, 1, 2, 3, 7, 64, 200):
        for top in (1, 2, 5, 1000):
            v = RNG.integers(0, top, n)
            assert trend.increasing_pairs(v) == sum(v[i] < v[j] for i in range(n) for j in range(i + 1, n))


@pytest.mark.parametrize("min_side", [8, 2048])
def test_scores_equal_all_pairs(spark, min_side):
    got = {r.series_id: r for r in trend.mk_score(long(spark, SERIES), min_side=min_side).collect()}
    for k, y in SERIES.items():
        s, var = s_and_var(y)
        assert (got[k].n, got[k].s) == (len(y), s), k
        assert got[k].var_s == pytest.approx(var, rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("most,min_side,names", [(1 << 20, 2048, list(SERIES)), (2_000, 50, ["flat", "odd", "tiny", "steps"]), (1, 64, ["constant", "lattice"])])
def test_slopes_equal_the_median_of_all_pairs(spark, most, min_side, names):
    got = {r.series_id: r.slope for r in trend.sen_slope(long(spark, {k: SERIES[k] for k in names}), most_pairs=most, min_side=min_side).collect()}
    assert got.pop("one", None) is None
    for k, v in got.items():
        want = float(np.median(slopes(SERIES[k])))
        assert abs(v - want) <= 2e-12 * max(abs(want), np.ptp(SERIES[k]) / len(SERIES[k])), (k, v, want)


def test_slope_of_a_long_series(spark):
    t = np.arange(5000)
    series = {"a": np.sin(t / 50) + 1e-7 * t + RNG.normal(size=5000) * 0.01, "b": RNG.integers(0, 50, 5000) / 10.0, "c": 1e-7 * t + RNG.normal(size=5000) * 1e-6}
    got = {r.series_id: r.slope for r in trend.sen_slope(long(spark, series)).collect()}
    for k, y in series.items():
        want = float(np.median(slopes(y)))
        assert abs(got[k] - want) <= 1e-12 * max(abs(want), np.ptp(y) / len(y)), (k, got[k], want)


def test_slope_with_gaps_and_two_heavy_slopes(spark):
    t = np.sort(RNG.choice(10_000, 400, replace=False))
    y = RNG.normal(size=400)
    half = [0.0, -1.0, -1.0, -2.0]  # slopes -1, -0.5, -2/3, 0, -0.5, -1
    rows = [("gaps", "v", int(a), float(b)) for a, b in zip(t, y)] + [("gaps", "v", 20_000, None)] + [("half", "v", i, v) for i, v in enumerate(half)]
    df = spark.createDataFrame(rows, "series_id string, col string, idx long, value double")
    for most in (1 << 20, 500):
        got = {r.series_id: r.slope for r in trend.sen_slope(df, most_pairs=most, min_side=32).collect()}
        assert got["gaps"] == pytest.approx(float(np.median(slopes(y, t))), rel=1e-11) and got["half"] == pytest.approx(float(np.median(slopes(half))))


def test_seasonal_slope_takes_pairs_of_equal_phase(spark):
    y = RNG.normal(size=300).cumsum()
    per = trend.seasonal_long(long(spark, {"s": y}), 12)
    want = float(np.median(np.concatenate([slopes(y[p::12]) for p in range(12)])))
    for most in (1 << 20, 100):
        assert trend.sen_slope(per, part=["phase"], most_pairs=most, min_side=8).first().slope == pytest.approx(want, rel=1e-11)


def p_of(s, var):
    z = (s - 1) / math.sqrt(var) if s > 0 else (s + 1) / math.sqrt(var) if s < 0 else 0.0
    return math.erfc(abs(z) / math.sqrt(2))


def white(y):
    d = y - y.mean()
    return np.round(y[1:] - y[:-1] * ((d[1:] * d[:-1]).sum() / (d * d).sum()), 12)


def test_check_trend_chooses_by_length(spark):
    series = {"short": RNG.normal(size=40).cumsum(), "long": 0.01 * np.arange(90) + RNG.normal(size=90), "fall": -np.arange(60.0)}
    got = {r.series_id: r for r in trend.check_trend(long(spark, series)).collect()}
    assert {k: r.test for k, r in got.items()} == {"short": "pre-whitened", "long": "original", "fall": "original"}
    for k, y in series.items():
        s, var = s_and_var(white(y) if k == "short" else y)
        r = got[k]
        assert (r.s, r.advice) == (s, None) and r.p_value == pytest.approx(p_of(s, var), abs=1e-12) and r.trend == (p_of(s, var) < 0.05)
        assert r.slope == pytest.approx(float(np.median(slopes(y))), rel=1e-11) and r.direction == ("increasing" if r.slope > 0 else "decreasing")
    forced = {r.series_id: (r.test, r.advice) for r in trend.check_trend(long(spark, series), prewhitened=False).collect()}
    assert forced["short"] == ("original", "short series: pre-whitening is recommended") and forced["long"][1] is None
    forced = {r.series_id: (r.test, r.advice) for r in trend.check_trend(long(spark, series), prewhitened=True).collect()}
    assert forced["long"] == ("pre-whitened", "long series: pre-whitening is not recommended") and forced["short"][1] is None


def test_check_trend_seasonal_and_missing(spark):
    y = 0.02 * np.arange(96) + np.tile(RNG.normal(size=12), 8) + RNG.normal(size=96) * 0.1
    r = trend.check_trend(long(spark, {"s": y}), period=12).first()
    parts = [s_and_var(y[p::12]) for p in range(12)]
    s, var = sum(a for a, _ in parts), sum(b for _, b in parts)
    assert (r.test, r.s, r.n) == ("seasonal", s, 96) and r.p_value == pytest.approx(p_of(s, var), abs=1e-12) and r.trend
    assert r.slope == pytest.approx(float(np.median(np.concatenate([slopes(y[p::12]) for p in range(12)]))), rel=1e-11)
    with pytest.raises(Exception, match="missing values"):
        trend.check_trend(long(spark, {"s": [1.0, float("nan"), 2.0]})).collect()
