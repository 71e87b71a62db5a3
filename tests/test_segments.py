"""Folds fitted from segment sums equal folds fitted one by one."""

import numpy as np
import pytest

from swellcast.operators import arima, cv, segments
from swellcast.operators.blocks import assign_blocks, train_test_split

RNG = np.random.default_rng(3)
W, H, S, M = 130, 12, 31, 6


def series(n, level):
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.6 * y[t - 1] + RNG.normal()
    return y + level


DATA = {"a": (series(420, 20.0), series(420, -3.0)), "b": (series(300, 5.0), series(300, 50.0)), "short": (series(40, 0.0), series(40, 1.0))}


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(s, i, float(u[i]), float(v[i]), float(np.sin(i / 9)), float(i % 24)) for s, (u, v) in DATA.items() for i in range(len(u))]
    return spark.createDataFrame(rows, "series_id string, idx long, u double, v double, ex1 double, ex2 double")


def folds(n):
    k = max((n - H - W) // S + 1, 0)
    return [(f, f * S, f * S + W) for f in range(k)]


def one_by_one(spark, parts):
    """hannan_rissanen on the rows of each fold alone."""
    rows = [(f"{s}/{f}", c, i, float(y)) for s, f, c, ys in parts for i, y in enumerate(ys)]
    fit = arima.hannan_rissanen(spark.createDataFrame(rows, "series_id string, col string, idx long, value double"), m=M)
    return {(r.series_id, r.col, r.step): r.yhat for r in arima.forecast(fit, H).collect()}


@pytest.mark.parametrize("chunk", [50, 10_000])
def test_arima_folds_equal_refits(spark, wide, chunk):
    parts = [(s, f, c, y[lo:hi]) for s, (u, v) in DATA.items() for f, lo, hi in folds(len(u)) for c, y in (("u", u), ("v", v))]
    want = one_by_one(spark, parts)
    got = cv.arima_cv(wide, ["u", "v"], W, H, S, M, chunk).collect()
    assert len(got) == len(want) == 2 * H * sum(len(folds(len(u))) for u, _ in DATA.values())
    for r in got:
        w = want[f"{r.series_id}/{r.fold_id}", r.col, r.step]
        y = DATA[r.series_id][r.col == "v"]
        assert abs(r.yhat - w) < 1e-7 * max(1, abs(w)) and r.y == y[r.idx] and r.idx == r.fold_id * S + W + r.step - 1


def test_expanding_arima_equals_refits(spark, wide):
    df = assign_blocks(train_test_split(wide.where("series_id <> 'short'"), 3 * H), H)
    parts = [(s, b, c, y[:len(y) - 3 * H + (b - 1) * H]) for s in ("a", "b") for b in (1, 2, 3) for c, y in zip("uv", DATA[s])]
    want = one_by_one(spark, parts)
    got = cv.expanding_arima(df, ["u", "v"], horizon=H, m=M, chunk=64).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[f"{r.series_id}/{r.block_id}", r.col, r.step]
        assert abs(r.yhat - w) < 1e-7 * max(1, abs(w))


def test_levels_with_missing_values(spark):
    y = [None if i % 5 == 0 or 60 <= i < 100 else float(i * i % 17) for i in range(140)]
    long = spark.createDataFrame([("s", "c", i, v) for i, v in enumerate(y)], "series_id string, col string, idx long, value double")
    w, h, st = 30, 5, 7
    f = segments.sliding(long.select("series_id", "idx"), w, h, st)
    got = {r.fold_id: r for r in segments.fold_levels(long, f, segments.sliding_cut(w, st)).collect()}
    assert len(got) == (140 - h - w) // st + 1
    for k, r in got.items():
        own = [v for v in y[k * st:k * st + w] if v is not None]
        assert r.last == (own[-1] if own else None) and (r.mean == pytest.approx(np.mean(own)) if own else r.mean is None)


def test_regression_folds_equal_refits(wide):
    got = cv.regression_cv(wide, ["u", "v"], ["ex1", "ex2"], W, H, S, chunk=77).collect()
    assert len(got) == 2 * H * sum(len(folds(len(u))) for u, _ in DATA.values())
    for r in got:
        y = DATA[r.series_id][r.col == "v"]
        x = np.column_stack([np.ones(len(y)), np.sin(np.arange(len(y)) / 9), np.arange(len(y)) % 24])
        lo = r.fold_id * S
        beta = np.linalg.lstsq(x[lo:lo + W], y[lo:lo + W], rcond=None)[0]
        assert abs(r.yhat - x[r.idx] @ beta) < 1e-8 * max(1, abs(r.yhat))


def test_rows_are_not_copied_to_folds(spark, wide):
    """The train rows meet no explode: only fold bounds and test rows do."""
    plan = cv.arima_cv(wide, ["u", "v"], W, H, S, M)._jdf.queryExecution().optimizedPlan().toString()
    generates = [line for line in plan.splitlines() if "Generate" in line]
    assert generates and not any("value" in g.split("Generate")[1].split("[")[0] for g in generates)
    assert cv.sliding_folds(wide, W, H, S).count() > 5 * wide.count() / 2  # what copying would cost
