"""Search over boosted-tree settings by sliding-window CV (M11 grid, M12 random),
with the A9 objective and the A10 best trial.

A trial is a setting: trees, rate, depth, gamma, alpha, lambda. Trials that differ
in the number of trees only are one *path*: it is fitted once, at the largest
count, and its prefixes are the others (27 grid trials are 9 fits a fold).

Every (series, fold, target, path) is one group of a grouped map. A group holds one
fold's rows, whose number is the window's and does not grow with the series or their
number; the groups grow with the data and are dealt over the cluster. A fold's rows
are copied to its paths: some bytes a copy, against a fit that passes over them once
a level of every tree. The fits are per series, as a fold is one window of one series.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .blocks import sliding_folds
from .boost import Shape, staged
from .cv import best_trial, trial_objective
from .metrics import score

KEY, IDX = "series_id", "idx"
PAIRS = "series_id string, fold_id long, trial_id int, col string, idx long, y double, yhat double"

# --- fixed values: the grid's axes --------------------------------------------
GRID_TREES = [1000, 400, 800]
GRID_RATES = [0.03, 0.05, 0.1]
GRID_DEPTHS = [4, 6, 8]


def grid_trials(trees: list[int] = GRID_TREES, rates: list[float] = GRID_RATES, depths: list[int] = GRID_DEPTHS,
                subsample: float = 0.8, colsample: float = 0.8) -> list[dict]:
    """Every combination of trees, rate and depth, the last axis fastest."""
    return [{"trial_id": i, "n_estimators": n, "learning_rate": r, "max_depth": d, "subsample": subsample, "colsample": colsample}
            for i, (n, r, d) in enumerate(product(trees, rates, depths))]


def sample_trials(n_trials: int = 10, seed: int = 42) -> list[dict]:
    """Seeded uniform samples of the reference's search space."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n_trials):
        out.append({"trial_id": i,
                    "n_estimators": int(rng.integers(3, 13) * 100),
                    "max_depth": int(rng.integers(3, 13)),
                    "gamma": float(rng.uniform(0, 5)),
                    "alpha": float(rng.uniform(0, 5)),
                    "lambda": float(rng.uniform(0, 10))})
    return out


def paths(trials: list[dict], step_size: float = 0.1) -> dict[Shape, dict[int, list[int]]]:
    """``shape -> {trees: trial ids}``; a trial without sampling shares uses all
    rows and features, one without a rate uses ``step_size``."""
    out: dict[Shape, dict[int, list[int]]] = {}
    for t in trials:
        shape = Shape(t.get("learning_rate", step_size), t["max_depth"], t.get("gamma", 0.0), t.get("alpha", 0.0), t.get("lambda", 1.0),
                      t.get("subsample", 1.0), t.get("colsample", 1.0))
        out.setdefault(shape, {}).setdefault(t["n_estimators"], []).append(t["trial_id"])
    return out


def trial_pairs(feats: DataFrame, feature_cols: list[str], targets: list[str], trials: list[dict], window: int, horizon: int,
                step: int, workers: int | None = None, step_size: float = 0.1) -> DataFrame:
    """Truth and forecast of every trial on the test rows of every sliding fold:
    ``(series, fold_id, trial_id, col, idx, y, yhat)``. ``feats(series_id, idx,
    *targets, *feature_cols)``; features of a row must be known before its fold's test
    rows. Train rows with a missing value are left out of a fit; a test row with a
    missing feature, or of a fold without train rows, has a NULL forecast, which the
    scores refuse where there is a truth. The groups are dealt to ``workers`` tasks
    (by default four a core: their time is in the fits, not in the bytes by which
    adaptive execution would merge them)."""
    spark = feats.sparkSession
    plan = [(c, shape, counts) for shape, counts in paths(trials, step_size).items() for c in targets]
    rows = sliding_folds(feats.select(KEY, IDX, F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("_x"),
                                      *[F.col(c).cast("double") for c in targets]), window, horizon, step)
    rows = rows.select(KEY, "fold_id", IDX, (F.col("role") == "test").alias("_test"), "_x", *targets,
                       F.explode(F.sequence(F.lit(0), F.lit(len(plan) - 1))).alias("_path"))
    keys = [KEY, "fold_id", "_path"]

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c, shape, counts = plan[key[2]]
        pdf = pdf.sort_values(IDX, kind="stable")
        x, y, test = np.stack(pdf["_x"].to_numpy()).astype(float), pdf[c].to_numpy(float), pdf["_test"].to_numpy()
        whole = ~np.isnan(x).any(axis=1)
        use = whole & ~test & ~np.isnan(y)
        stages = staged(x[use], y[use], x[test & whole], shape, list(counts)) if use.any() else {}
        parts = []
        for count, ids in counts.items():
            yhat = np.full(int(test.sum()), np.nan)
            if use.any():
                yhat[whole[test]] = stages[count]
            parts += [pd.DataFrame({KEY: key[0], "fold_id": key[1], "trial_id": i, "col": c, IDX: pdf[IDX].to_numpy()[test], "y": y[test], "yhat": yhat})
                      for i in ids]
        return pd.concat(parts)

    pairs = rows.repartition(workers or 4 * spark.sparkContext.defaultParallelism, *keys).groupBy(*keys).applyInPandas(fit, PAIRS)
    return pairs.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("y", "yhat")})


def random_search(feats: DataFrame, feature_cols: list[str], targets: list[str], trials: list[dict],
                  window: int, horizon: int, step: int, workers: int | None = None, step_size: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Evaluate every trial (of :func:`sample_trials`, :func:`grid_trials` or the
    user's own). Returns ``(objectives, best)``: the A9 objective per (series,
    trial) = mean over folds of the column-averaged MSPE, and the A10 best trial."""
    pairs = trial_pairs(feats, feature_cols, targets, trials, window, horizon, step, workers, step_size)
    obj = saved(trial_objective(score(pairs, [KEY, "trial_id", "fold_id"], ["mspe"])), "trials")  # read by both outputs
    return obj, best_trial(obj)


def with_settings(table: DataFrame, trials: list[dict]) -> DataFrame:
    """A trial table with its settings as columns, by ``trial_id``."""
    names = sorted({k for t in trials for k in t} - {"trial_id"})
    settings = table.sparkSession.createDataFrame([(t["trial_id"], *(float(t[k]) if k in t else None for k in names)) for t in trials],
                                                  "trial_id int, " + ", ".join(f"`{k}` double" for k in names))
    return table.join(settings, "trial_id", "left")
