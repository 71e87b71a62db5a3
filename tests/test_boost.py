"""Boosted trees against a plain recursion, and the searches built on them."""

import numpy as np

from swellcast.operators.boost import Shape, binned, cut_points, staged
from swellcast.operators.tuning import grid_trials, paths, random_search, trial_pairs, with_settings


def soft(g, alpha):
    return np.sign(g) * max(abs(g) - alpha, 0.0)


def worth(g, s):
    return soft(g.sum(), s.alpha) ** 2 / (len(g) + s.lam)


def plain_tree(x, g, s, depth):
    """Exhaustive search over every value of every feature. Cuts that part the rows
    alike tie, so the tests compare the predictions of the train rows."""
    leaf = {"value": -s.learning_rate * soft(g.sum(), s.alpha) / (len(g) + s.lam)}
    best = (1e-6, None, None)
    for j in range(x.shape[1]) if depth else []:
        u = np.unique(x[:, j])
        for c in (u[:-1] + u[1:]) / 2:
            low = x[:, j] <= c
            won = worth(g[low], s) + worth(g[~low], s) - worth(g, s)
            if won > best[0]:
                best = (won, j, c)
    won, j, c = best
    if j is None:
        return leaf
    low = x[:, j] <= c
    kids = [plain_tree(x[low], g[low], s, depth - 1), plain_tree(x[~low], g[~low], s, depth - 1)]
    if won < s.gamma and all("value" in k for k in kids):
        return leaf
    return {"j": j, "c": c, "kids": kids}


def walk(tree, row):
    while "kids" in tree:
        tree = tree["kids"][int(row[tree["j"]] > tree["c"])]
    return tree["value"]


def plain_boost(x, y, test, s, count):
    at, out = np.full(len(y), y.mean()), np.full(len(test), y.mean())
    for _ in range(count):
        tree = plain_tree(x, at - y, s, s.max_depth)
        at = at + [walk(tree, r) for r in x]
        out = out + [walk(tree, r) for r in test]
    return out


def data(n, f, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, f))
    return x, np.sin(2 * x[:, 0]) + x[:, 1] * x[:, -1] + 0.1 * rng.normal(size=n), rng.normal(size=(17, f))


def test_equals_the_exhaustive_recursion():
    x, y, _ = data(45, 3, 1)
    for s in (Shape(0.3, 3, subsample=1, colsample=1, bins=64), Shape(0.3, 4, alpha=0.7, lam=0.0, subsample=1, colsample=1, bins=64),
              Shape(0.5, 5, gamma=0.8, lam=3.0, subsample=1, colsample=1, bins=64)):
        got = staged(x, y, x, s, [0, 1, 6])
        for k in (0, 1, 6):
            assert np.allclose(got[k], plain_boost(x, y, x, s, k), atol=1e-10), (s, k)


def test_prefixes_are_the_smaller_ensembles():
    x, y, test = data(200, 5, 2)
    s = Shape(0.1, 6)
    all_ = staged(x, y, test, s, [3, 10, 25])
    for k in (3, 10, 25):
        assert np.array_equal(all_[k], staged(x, y, test, s, [k])[k])
    assert np.array_equal(all_[25], staged(x, y, test, s, [25])[25])


def test_learns_and_survives_degenerate_rows():
    x, y, test = data(800, 4, 3)
    truth = np.sin(2 * test[:, 0]) + test[:, 1] * test[:, -1]
    err = {k: np.mean((p - truth) ** 2) for k, p in staged(x, y, test, Shape(0.1, 4), [1, 200]).items()}
    assert err[200] < 0.4 * err[1]
    one = staged(np.ones((1, 2)), np.array([5.0]), np.zeros((2, 2)), Shape(), [4])[4]
    assert np.allclose(one, 5.0)
    flat = staged(np.ones((30, 2)), np.arange(30.0), np.zeros((2, 2)), Shape(0.1, 3, subsample=1), [4])[4]
    assert np.allclose(flat, 14.5)


def test_bins_hold_equal_values_together():
    x = np.repeat([1.0, 2.0, 5.0], [500, 3, 40])
    assert cut_points(x, 32).tolist() == [1.5, 3.5]
    many = np.concatenate([np.zeros(900), np.arange(1, 101)])
    b = binned(many[:, None], [cut_points(many, 8)])[:, 0]
    assert (b[:900] == 0).all() and (np.diff(b[900:]) >= 0).all() and b.max() < 8


def frame(spark, n=260):
    rng = np.random.default_rng(5)
    rows = []
    for s in ("a", "b"):
        f = rng.normal(size=(n, 2))
        for i in range(n):
            rows.append((s, i, *map(float, (10 + f[i, 0] + (s == "a") * f[i, 1], 5 - f[i, 1], *f[i]))))
    return spark.createDataFrame(rows, "series_id string, idx long, y double, z double, f0 double, f1 double")


def test_every_trial_of_every_fold_equals_its_own_fit(spark):
    df = frame(spark)
    trials = grid_trials([6, 2, 4], [0.1, 0.3], [2, 3])
    assert len(paths(trials)) == 4 and len(trials) == 12                       # one fit a path
    got = trial_pairs(df, ["f0", "f1"], ["y", "z"], trials, window=120, horizon=24, step=60).toPandas()
    own = df.toPandas()
    folds = (260 - 144) // 60 + 1
    assert len(got) == 2 * folds * len(trials) * 2 * 24
    for t in trials[::5]:
        for s, k, c in (("a", 0, "y"), ("b", 1, "z")):
            x = own[own["series_id"] == s].sort_values("idx")
            tr, te = x.iloc[k * 60:k * 60 + 120], x.iloc[k * 60 + 120:k * 60 + 144]
            (shape,) = paths([t])
            want = staged(tr[["f0", "f1"]].to_numpy(), tr[c].to_numpy(), te[["f0", "f1"]].to_numpy(), shape, [t["n_estimators"]])[t["n_estimators"]]
            g = got[(got["series_id"] == s) & (got["fold_id"] == k) & (got["col"] == c) & (got["trial_id"] == t["trial_id"])].sort_values("idx")
            assert np.allclose(g["yhat"], want) and np.allclose(g["y"], te[c]) and (g["idx"].to_numpy() == te["idx"].to_numpy()).all()


def test_missing_values(spark):
    df = frame(spark, 200).selectExpr("series_id", "idx", "CASE WHEN series_id = 'a' OR idx % 7 > 0 THEN y END AS y",
                                      "CASE WHEN series_id = 'a' AND idx < 5 OR series_id = 'b' AND idx = 130 THEN NULL ELSE f0 END AS f0")
    got = trial_pairs(df, ["f0"], ["y"], grid_trials([2], [0.1], [2]), window=120, horizon=24, step=60).toPandas()
    bad = got[got["yhat"].isna()]
    assert [(r.series_id, r.idx) for r in bad.itertuples()] == [("b", 130)]
    assert got[got["series_id"] == "b"]["y"].isna().sum() == sum(i % 7 == 0 for i in range(120, 144))
    none = df.selectExpr("series_id", "idx", "CAST(NULL AS DOUBLE) AS y", "f0")
    assert trial_pairs(none, ["f0"], ["y"], grid_trials([2], [0.1], [2]), 120, 24, 60).where("yhat IS NOT NULL").count() == 0
    assert trial_pairs(df.limit(0), ["f0"], ["y"], grid_trials([2], [0.1], [2]), 120, 24, 60).count() == 0


def test_settings_stay_with_their_trials(spark):
    trials = grid_trials([3, 1], [0.1], [2])
    obj, best = random_search(frame(spark), ["f0", "f1"], ["y"], trials, 120, 24, 60)
    rows = with_settings(obj, trials).collect()
    assert {(r["trial_id"], r["n_estimators"]) for r in rows} == {(0, 3.0), (1, 1.0)} and len(rows) == 4
    assert {r["best_trial"] for r in best.collect()} == {0}                    # more trees fit these rows better
