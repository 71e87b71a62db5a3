"""Back-testing: refit-per-fold CV (M10), expanding blocks (M15), forecast
through a gap (M13), key checks (J2).

Folds and blocks are rows, not loops: each fold is fitted from sums over the
segments between the folds' bounds (:mod:`.segments`), so no train row is copied
to its folds, and predictions are an equi-join of the few test rows of each fold
- all folds of all series run as one Spark job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK
from . import segments
from .arima import ahead
from .blocks import sliding_folds
from .scaling import to_long

KEY, IDX = "series_id", "idx"


def _strategy_col(strategies: dict[str, str]):
    m = None
    for c, s in strategies.items():
        m = F.when(F.col("col") == c, F.lit(s)) if m is None else m.when(F.col("col") == c, F.lit(s))
    return m


def fold_truth(long: DataFrame, folds: DataFrame, horizon: int, key: str = KEY, idx: str = IDX) -> DataFrame:
    """``(series, fold_id, col, idx, step, y)``: the ``horizon`` rows after each
    fold's train rows, by an equi-join on ``idx``."""
    at = folds.select(key, "fold_id", F.col("hi").alias("_hi"), F.explode(F.sequence(F.col("hi"), F.col("hi") + horizon - 1)).alias(idx))
    return at.join(long.select(key, "col", idx, F.col("value").alias("y")), [key, idx]).select(
        key, "fold_id", "col", idx, (F.col(idx) - F.col("_hi") + 1).alias("step"), "y")


def naive_levels(df: DataFrame, cols: list[str], window: int, horizon: int, step: int) -> tuple[DataFrame, DataFrame]:
    """Truth rows and naive levels (``mean`` and ``last``) of every sliding fold."""
    long = to_long(df.select(KEY, IDX, *cols), cols, [KEY, IDX])
    folds = segments.sliding(df.select(KEY, IDX), window, horizon, step)
    return fold_truth(long, folds, horizon), segments.fold_levels(long, folds, segments.sliding_cut(window, step))


def naive_cv(df: DataFrame, cols: list[str], strategies: dict[str, str], window: int, horizon: int, step: int) -> DataFrame:
    """M10 for naive forecasters: refit on every sliding fold.

    Returns prediction pairs ``(series, fold_id, col, idx, step, y, yhat)``.
    """
    truth, levels = naive_levels(df, cols, window, horizon, step)
    yhat = F.when(_strategy_col(strategies) == "last", F.col("last")).otherwise(F.col("mean"))
    return truth.join(levels.select(KEY, "fold_id", "col", yhat.alias("yhat")), [KEY, "fold_id", "col"])


def arima_cv(df: DataFrame, cols: list[str], window: int, horizon: int, step: int, m: int = 20, chunk: int = CHUNK) -> DataFrame:
    """M10 for ARIMA(1,0,1): refit on every sliding fold, from segment Grams.
    Returns the same pairs as :func:`naive_cv`. ``df`` is gap-free and filled."""
    long = to_long(df.select(KEY, IDX, *cols), cols, [KEY, IDX])
    folds = segments.sliding(df.select(KEY, IDX), window, horizon, step)
    model = segments.fold_arima(long, folds, segments.sliding_cut(window, step, (m, m + 1)), m, chunk)
    truth = fold_truth(long, folds, horizon)
    return truth.join(model, [KEY, "col", "fold_id"]).select(*truth.columns, ahead(F.col("step")).alias("yhat"))


def regression_cv(df: DataFrame, cols: list[str], exog: list[str], window: int, horizon: int, step: int, chunk: int = CHUNK) -> DataFrame:
    """M10 for a regression on exogenous columns, which are known ahead: refit on
    every sliding fold, predicted from the test rows' own exogenous values."""
    long = to_long(df.select(KEY, IDX, *cols, *exog), cols, [KEY, IDX, *exog])
    folds = segments.sliding(df.select(KEY, IDX), window, horizon, step)
    model = segments.fold_regression(long, exog, folds, segments.sliding_cut(window, step), chunk)
    truth = fold_truth(long, folds, horizon)
    rows = truth.join(df.select(KEY, IDX, *exog), [KEY, IDX]).join(model, [KEY, "col", "fold_id"])
    return rows.select(*truth.columns, linear("beta", exog).alias("yhat"))


def linear(beta: str, exog: list[str]) -> Column:
    """Constant plus coefficients times the exogenous columns."""
    out = F.col(beta)[0]
    for i, c in enumerate(exog):
        out = out + F.col(beta)[i + 1] * F.col(c)
    return out


def _expanding(df: DataFrame, horizon: int, test_start: str) -> DataFrame:
    blocks = df.select(KEY, test_start, "n_blocks").distinct()
    return blocks.select(KEY, test_start, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_blocks"))).alias("fold_id")) \
        .select(KEY, test_start, "fold_id", F.lit(0).cast("long").alias("lo"), (F.col(test_start) + (F.col("fold_id") - 1) * horizon).alias("hi"))


def expanding_blocks(df: DataFrame, cols: list[str], strategies: dict[str, str], test_start: str = "test_start",
                     horizon: int = 72) -> DataFrame:
    """M15 (documented intent): each block is forecast from all actuals before
    its first row. ``df`` carries ``test_start`` / ``n_blocks`` (from
    :func:`assign_blocks`). Returns ``(series, block_id, col, level)``."""
    long = to_long(df, cols, [KEY, IDX, test_start])
    levels = segments.fold_levels(long, _expanding(df, horizon, test_start), segments.expanding_cut(horizon, test_start))
    level = F.when(_strategy_col(strategies) == "last", F.col("last")).otherwise(F.col("mean"))
    return levels.select(KEY, F.col("fold_id").alias("block_id"), "col", level.alias("level"))


def expanding_arima(df: DataFrame, cols: list[str], test_start: str = "test_start", horizon: int = 72, m: int = 20,
                    chunk: int = CHUNK) -> DataFrame:
    """M15 for ARIMA(1,0,1): refitted before every block on all rows before it.
    Returns ``(series, block_id, col, idx, step, y, yhat)``."""
    long = to_long(df, cols, [KEY, IDX, test_start])
    folds = _expanding(df, horizon, test_start)
    model = segments.fold_arima(long, folds, segments.expanding_cut(horizon, test_start, (m, m + 1)), m, chunk)
    truth = fold_truth(long, folds, horizon)
    return truth.join(model, [KEY, "col", "fold_id"]).select(
        KEY, F.col("fold_id").alias("block_id"), "col", IDX, "step", "y", ahead(F.col("step")).alias("yhat"))


def key_mismatch(expected: DataFrame, got: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Per series (or ``by``), rows expected but missing and rows produced but not
    expected (``left_anti`` both ways). Both counts must be 0."""
    by = by or [KEY]
    missing = expected.select(*keys).join(got.select(*keys), keys, "left_anti").groupBy(*by).count() \
        .withColumnRenamed("count", "n_missing")
    extra = got.select(*keys).join(expected.select(*keys), keys, "left_anti").groupBy(*by).count() \
        .withColumnRenamed("count", "n_extra")
    n = expected.groupBy(*by).count().withColumnRenamed("count", "n_expected")
    return n.join(missing, by, "left").join(extra, by, "left").select(
        *by, "n_expected", F.coalesce("n_missing", F.lit(0).cast("long")).alias("n_missing"),
        F.coalesce("n_extra", F.lit(0).cast("long")).alias("n_extra"))


def naive_grid_cv(df: DataFrame, cols: list[str], trials: list[dict[str, str]], window: int, horizon: int, step: int) -> DataFrame:
    """M11 for naive forecasters: every trial (a strategy per column) refit on
    every sliding fold. Both levels of a fold are fitted once and shared by all
    trials; the small trial table is joined on ``col``.
    Returns pairs ``(series, trial_id, fold_id, col, idx, y, yhat)``."""
    spark = df.sparkSession
    tt = spark.createDataFrame([(i, c, s) for i, t in enumerate(trials) for c, s in t.items()],
                               "trial_id int, col string, _strategy string")
    truth, levels = naive_levels(df, cols, window, horizon, step)
    yhat = F.when(F.col("_strategy") == "last", F.col("last")).otherwise(F.col("mean"))
    fitted = levels.join(tt, "col").select(KEY, "trial_id", "fold_id", "col", yhat.alias("yhat"))
    return truth.join(fitted, [KEY, "fold_id", "col"]).select(KEY, "trial_id", "fold_id", "col", IDX, "y", "yhat")


def trial_objective(fold_scores_: DataFrame, key: str = KEY) -> DataFrame:
    """Trial objective = mean over folds of the (column-averaged) first
    score - not the best fold's score."""
    return fold_scores_.groupBy(key, "trial_id").agg(F.avg("value").alias("objective"),
                                                     F.count("*").alias("n_folds"))


def best_trial(objectives: DataFrame, key: str = KEY) -> DataFrame:
    """A10: the trial with the smallest objective (first trial on ties)."""
    return objectives.groupBy(key).agg(
        F.min_by(F.struct("trial_id", "objective"), F.struct("objective", "trial_id")).alias("_b")) \
        .select(key, F.col("_b.trial_id").alias("best_trial"), F.col("_b.objective").alias("best_value"))
