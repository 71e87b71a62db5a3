"""Flagship plan (M14): block-wise train/test benchmark of naive forecasters.

scan -> P19 preprocess -> T1 split (last ``horizon*n_blocks`` hours) ->
fit on train (W7 fill, P15 scale, M3 naive ensemble) -> W14 blocks ->
predict -> P16 unscale -> A6 block scores -> A7 mean / std over blocks.

Everything is keyed by ``series_id``; every step is a grouped aggregate or
an equi-join on ``(series_id, col)``; the only wide shuffles are the hourly
aggregation and the grid join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHUNK, HORIZON
from ..operators.blocks import assign_blocks, train_test_split
from ..operators.forecast import ensemble_fit, naive_predict
from ..operators.metrics import aggregate_blocks, block_scores
from ..operators.scaling import apply_scaler, fit_scaler, to_long, unscale_long
from ..operators.windows import ffill
from ..session import materialize
from .bases import QUERY_CHUNK, met_hourly

KEY = "series_id"
NAIVE = {"WVHT": "last", "APD": "mean"}


def prepared(spark: SparkSession, sf_dir: str, chunk: int = QUERY_CHUNK) -> DataFrame:
    """The shared prefix: met view -> P19 hourly grid."""
    return met_hourly(spark, sf_dir, chunk)


def fit_base(hourly: DataFrame, targets: list[str], test_size: int, horizon: int = HORIZON,
             chunk: int = CHUNK):
    """Split, fill and scale the train rows. Returns ``(split, state,
    scaled_long)``, all lazy."""
    y = hourly.select(KEY, "idx", *targets)
    split = assign_blocks(train_test_split(y, test_size), horizon)
    train = split.where(~F.col("is_test")).select(KEY, "idx", *targets)
    filled = ffill(train, targets, chunk=chunk)
    state = fit_scaler(filled, targets)
    scaled = apply_scaler(filled, state, targets)
    return split, state, to_long(scaled, targets, [KEY, "idx"])


def fit_naive(hourly: DataFrame, strategies: dict[str, str], test_size: int, horizon: int = HORIZON,
              chunk: int = CHUNK):
    """:func:`fit_base` + the naive ensemble fitted on the scaled values.
    Returns ``(split, state, model)``."""
    split, state, scaled_long = fit_base(hourly, list(strategies), test_size, horizon, chunk)
    return split, state, ensemble_fit(scaled_long, strategies)


def score_blocks(split: DataFrame, state: DataFrame, model: DataFrame, targets: list[str],
                 scorers: tuple[str, ...] = ("rmspe", "mape")) -> DataFrame:
    """A6 + A7 for one fitted model: ``(series_id, metric, value)``."""
    pred = forecast_rows(split, state, model, targets)
    bs = block_scores(pred, list(scorers))
    return bs.select(KEY, "metric", "value").unionByName(aggregate_blocks(bs))


def forecast_rows(split: DataFrame, state: DataFrame, model: DataFrame, targets: list[str],
                  only_blocks: bool = True) -> DataFrame:
    """Truth ``y`` (raw hourly, may be NULL) and unscaled prediction ``yhat``
    per ``(series, col, idx, block_id)`` of the test rows."""
    rows = split.where(F.col("block_id").isNotNull()) if only_blocks else split.where(F.col("is_test"))
    truth = to_long(rows, targets, [KEY, "idx", "block_id"]).withColumnRenamed("value", "y")
    return unscale_long(naive_predict(model, truth), state, "yhat")


def block_benchmark(hourly: DataFrame, strategies: dict[str, str] | None = None,
                    horizon: int = HORIZON, n_blocks: int = 3,
                    scorers: tuple[str, ...] = ("rmspe", "mape"),
                    chunk: int = CHUNK) -> DataFrame:
    """Block benchmark on a P19 grid; returns ``(series_id, metric, value)``
    with ``block_{i}_{Scorer}``, ``avg_{Scorer}``, ``std_{Scorer}`` rows."""
    strategies = strategies or NAIVE
    split, state, model = fit_naive(hourly, strategies, horizon * n_blocks, horizon, chunk)
    return score_blocks(split, state, model, list(strategies), scorers)


def run(spark: SparkSession, sf_dir: str, chunk: int = QUERY_CHUNK) -> DataFrame:
    return block_benchmark(prepared(spark, sf_dir, chunk), chunk=chunk)


def arima_benchmark(hourly: DataFrame, targets: list[str] | None = None, horizon: int = HORIZON,
                    n_blocks: int = 3, diff_lag: int = 24, ar_order: int = 20,
                    scorers: tuple[str, ...] = ("rmspe", "mape"), chunk: int = CHUNK) -> DataFrame:
    """The benchmark's SARIMA run: per target ARIMA(1,0,1) on the scaled,
    lag-24-differenced train rows (the seasonal order has no seasonal
    terms, so seasonality comes only from the difference). Forecasts over
    the whole test span are un-differenced from the train end ('static'
    mode), unscaled and scored per block."""

    from ..operators.arima import forecast, hannan_rissanen
    from ..operators.windows import running_sum, seasonal_diff
    targets = targets or list(NAIVE)
    test_size = horizon * n_blocks
    y = hourly.select(KEY, "idx", *targets)
    split = materialize(assign_blocks(train_test_split(y, test_size), horizon))
    train = split.where(~F.col("is_test")).select(KEY, "idx", *targets)
    filled = materialize(ffill(train, targets, chunk=chunk))
    state = fit_scaler(filled, targets)
    scaled = materialize(apply_scaler(filled, state, targets))
    d = seasonal_diff(scaled, targets, diff_lag, fill_zero=True, chunk=chunk)
    coef = materialize(hannan_rissanen(to_long(d, targets, [KEY, "idx"]), m=ar_order, chunk=chunk))
    fc = forecast(coef, test_size)                                   # differenced, scaled
    # un-difference: level = last known level of the same phase + running sum of forecasts
    fc = fc.withColumn("_ph", F.pmod(F.col("idx"), F.lit(diff_lag)))
    fc = running_sum(fc, {"yhat": "_cs"}, [KEY, "col", "_ph"], "idx", chunk)
    last = scaled.groupBy(KEY).agg(F.max("idx").alias("_T"))
    seeds = to_long(scaled.join(last, KEY).where(F.col("idx") > F.col("_T") - diff_lag), targets, [KEY, "idx"]) \
        .select(KEY, "col", F.pmod(F.col("idx"), F.lit(diff_lag)).alias("_ph"), F.col("value").alias("_seed"))
    lv = fc.join(seeds, [KEY, "col", "_ph"], "inner").select(KEY, "col", "idx", (F.col("_seed") + F.col("_cs")).alias("yhat"))
    pred = unscale_long(lv, state, "yhat")
    truth = to_long(split.where(F.col("block_id").isNotNull()), targets, [KEY, "idx", "block_id"]) \
        .withColumnRenamed("value", "y")
    pairs = truth.join(pred, [KEY, "col", "idx"], "inner")
    bs = block_scores(pairs, list(scorers))
    return bs.select(KEY, "metric", "value").unionByName(aggregate_blocks(bs))


def recursive_gbt_benchmark(hourly: DataFrame, targets: list[str] | None = None, exog: list[str] | None = None,
                            horizon: int = HORIZON, n_blocks: int = 3, diff_lag: int = 24,
                            scorers: tuple[str, ...] = ("rmspe", "mape"), chunk: int = CHUNK,
                            max_iter: int = 20, max_depth: int = 5, step_size: float = 0.1) -> DataFrame:
    """The benchmark's boosted-tree run (M8 recursive reduction with exogenous
    features, M7 transform set). Targets: fill + scale fitted on train, lag-24
    difference, target-lag summary. Exogenous: fill, scale, calendar +
    lag/mean features with leading back-fill, scaled again (all fitted on
    train rows). Forecast 216 steps recursively from the train end, then
    un-difference, unscale and score per block."""
    from ..config import EXOGENOUS, LAGGED_MEANS, TARGET_LAGS
    from ..operators.clean import add_calendar
    from ..operators.recursive import fit_models, lag_features, predict_recursive
    from ..operators.windows import running_sum, seasonal_diff, window_summary
    targets = targets or list(NAIVE)
    exog = exog or EXOGENOUS
    test_size = horizon * n_blocks
    y = hourly.select(KEY, "idx", *targets)
    split = materialize(assign_blocks(train_test_split(y, test_size), horizon))
    t0 = split.select(KEY, "test_start").distinct()
    train = split.where(~F.col("is_test")).select(KEY, "idx", *targets)
    filled = materialize(ffill(train, targets, chunk=chunk))
    st_y = fit_scaler(filled, targets)
    scaled = materialize(apply_scaler(filled, st_y, targets))
    yd = materialize(seasonal_diff(scaled, targets, diff_lag, fill_zero=True, chunk=chunk))
    tf = window_summary(yd, targets, lag=TARGET_LAGS, mean=LAGGED_MEANS, truncate_bfill=True, chunk=chunk)
    lagf = lag_features(TARGET_LAGS, LAGGED_MEANS)
    tlong = None
    for c in targets:
        part = tf.select(KEY, "idx", F.lit(c).alias("col"), F.col(c).alias("label"),
                         *[F.col(f"{c}_{n}").alias(n) for n in lagf])
        tlong = part if tlong is None else tlong.unionByName(part)
    # exogenous pipeline
    xh = hourly.select(KEY, "ts", "idx", *exog)
    xsp = train_test_split(ffill(xh, exog, chunk=chunk), test_size)
    stx = fit_scaler(xsp.where(~F.col("is_test")), exog)
    xsc = apply_scaler(xsp, stx, exog)
    feats = window_summary(xsc, exog, lag=[1], mean=LAGGED_MEANS, replace=True, chunk=chunk)
    feats = add_calendar(feats).withColumns({"month": F.col("month").cast("double"),
                                             "hour": F.col("hour").cast("double")})
    names = [c for c in feats.columns if c not in (KEY, "ts", "idx", "n_rows", "test_start", "is_test")]
    stf = fit_scaler(feats.where(~F.col("is_test")), names)
    xfin = materialize(apply_scaler(feats, stf, names).select(KEY, "idx", "test_start", *names))
    train_tab = tlong.join(xfin.where(F.col("idx") < F.col("test_start")), [KEY, "idx"], "inner")
    fitted = fit_models(train_tab, targets, names, TARGET_LAGS, LAGGED_MEANS, max_iter, max_depth, step_size)
    # state: last max_back differenced values per series and target, r = idx - (test_start - 1)
    max_back = max(TARGET_LAGS + [a + b - 1 for a, b in LAGGED_MEANS])
    r = F.col("idx") - F.col("test_start") + 1
    state = to_long(yd, targets, [KEY, "idx"]).join(t0, KEY).withColumn("r", r) \
        .where(F.col("r") > -max_back).select(KEY, "col", "r", "value")
    future = xfin.where(F.col("idx") >= F.col("test_start")).withColumn("r", r).drop("idx", "test_start")
    preds = materialize(predict_recursive(fitted, materialize(state), materialize(future), test_size,
                                          TARGET_LAGS, LAGGED_MEANS, names))
    # un-difference from the train end, then unscale
    ph = F.pmod(F.col("r"), F.lit(diff_lag))
    cs = running_sum(preds.withColumn("_ph", ph), {"yhat": "_cs"}, [KEY, "col", "_ph"], "r", chunk)
    seeds = to_long(scaled, targets, [KEY, "idx"]).join(t0, KEY).withColumn("r", r) \
        .where(F.col("r") > -diff_lag).select(KEY, "col", ph.alias("_ph"), F.col("value").alias("_seed"))
    lv = cs.join(seeds, [KEY, "col", "_ph"], "inner").join(t0, KEY) \
        .select(KEY, "col", (F.col("r") + F.col("test_start") - 1).alias("idx"),
                (F.col("_seed") + F.col("_cs")).alias("yhat"))
    pred = unscale_long(lv, st_y, "yhat")
    truth = to_long(split.where(F.col("block_id").isNotNull()), targets, [KEY, "idx", "block_id"]) \
        .withColumnRenamed("value", "y")
    bs = block_scores(truth.join(pred, [KEY, "col", "idx"], "inner"), list(scorers))
    return bs.select(KEY, "metric", "value").unionByName(aggregate_blocks(bs))
