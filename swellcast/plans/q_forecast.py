"""Registered queries: block benchmark, naive / ARIMA / boosted-tree
forecasts, block and fold scoring, CV, grid search, model store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CLEAN_COLUMNS, HORIZON, TARGETS
from ..operators import cv, segments
from ..operators.blocks import assign_blocks, series_length, train_test_split
from ..operators.metrics import best_fold, cv_summary, fold_scores, score
from ..operators.scaling import to_long
from ..operators.windows import ffill
from ..session import materialize, saved
from . import bases, benchmark
from . import oracles as O
from .oracles import rnd
from .q_windows import FOLD_H, FOLD_S, FOLD_W, _filled
from .queries import register


@register("m14_block_benchmark", O.block_benchmark_sql())
def m14_block_benchmark(spark, sf_dir):
    """Flagship: naive ensemble scored over three 72-hour test blocks."""
    return benchmark.run(spark, sf_dir)


TEST_SIZE = HORIZON * 3
ENSEMBLE = {"WVHT": "last", "APD": "mean"}


def _naive_sql(strategies: dict[str, str]) -> str:
    """CTEs: split on the raw hourly targets, fill on train, levels per col."""
    fill = O.ffill_cte("train", TARGETS, "tf", keep="series_id, idx")
    lv = ", ".join((f"arg_max({c}, idx) AS lv_{c}" if s == "last" else f"avg({c}) AS lv_{c}")
                   for c, s in strategies.items())
    return O.met_hourly_prefix() + f""",
n AS (SELECT series_id, max(idx) + 1 AS n_rows FROM hourly GROUP BY 1),
sp AS (SELECT h.series_id, h.idx, h.WVHT, h.APD, n.n_rows, n.n_rows - {TEST_SIZE} AS test_start,
       CASE WHEN h.idx >= n.n_rows - {TEST_SIZE} AND floor((h.idx - (n.n_rows - {TEST_SIZE})) / {HORIZON}) + 1
                 <= floor({TEST_SIZE} / {HORIZON})
            THEN CAST(floor((h.idx - (n.n_rows - {TEST_SIZE})) / {HORIZON}) + 1 AS BIGINT) END AS block_id
       FROM hourly h JOIN n USING (series_id)),
train AS (SELECT series_id, idx, WVHT, APD FROM sp WHERE idx < test_start),
{fill},
lv AS (SELECT series_id, {lv} FROM tf GROUP BY 1),
pred AS ({' UNION ALL '.join(f"SELECT sp.series_id, '{c}' AS col, sp.idx, sp.block_id, sp.{c} AS y, lv.lv_{c} AS yhat FROM sp JOIN lv USING (series_id) WHERE sp.idx >= sp.test_start" for c in strategies)})"""


def _naive_query(spark, sf, strategies):
    split, state, model = benchmark.fit_naive(benchmark.prepared(spark, sf), strategies, TEST_SIZE)
    return benchmark.forecast_rows(split, state, model, list(strategies), only_blocks=False) \
        .select("series_id", "col", "idx", "yhat")


@register("m1_naive_last", _naive_sql({"WVHT": "last", "APD": "last"}) +
          f"\nSELECT series_id, col, idx, {rnd('yhat', 'yhat')} FROM pred")
def m1_naive_last(spark, sf):
    """Naive 'last' forecast of both targets over the 216 test hours."""
    return _naive_query(spark, sf, {"WVHT": "last", "APD": "last"})


@register("m2_naive_mean", _naive_sql({"WVHT": "mean", "APD": "mean"}) +
          f"\nSELECT series_id, col, idx, {rnd('yhat', 'yhat')} FROM pred")
def m2_naive_mean(spark, sf):
    return _naive_query(spark, sf, {"WVHT": "mean", "APD": "mean"})


@register("m3_ensemble_pairs", _naive_sql(ENSEMBLE) +
          f"\nSELECT series_id, col, idx, block_id, {rnd('y', 'y')}, {rnd('yhat', 'yhat')} FROM pred WHERE block_id IS NOT NULL")
def m3_ensemble_pairs(spark, sf):
    """Column ensemble (WVHT last, APD mean): truth joined to prediction for
    every block row (J6)."""
    split, state, model = benchmark.fit_naive(benchmark.prepared(spark, sf), ENSEMBLE, TEST_SIZE)
    return benchmark.forecast_rows(split, state, model, TARGETS).select("series_id", "col", "idx", "block_id", "y", "yhat")


_PE = "(y - yhat) / greatest(abs(y), 2.220446049250313e-16)"


@register("a2_a4_percentage_errors", _naive_sql(ENSEMBLE) + f""",
s AS (SELECT series_id, col, avg(({_PE}) * ({_PE})) AS mspe, sqrt(avg(({_PE}) * ({_PE}))) AS rmspe,
      avg(abs({_PE})) AS mape, count(y) AS n_scored, count(*) - count(y) AS n_null_truth FROM pred GROUP BY 1, 2)
SELECT series_id, col, 'mspe' AS metric, {rnd('mspe', 'value')}, n_scored, n_null_truth FROM s UNION ALL
SELECT series_id, col, 'rmspe', {rnd('rmspe', 'value')}, n_scored, n_null_truth FROM s UNION ALL
SELECT series_id, col, 'mape', {rnd('mape', 'value')}, n_scored, n_null_truth FROM s""")
def a2_a4_percentage_errors(spark, sf):
    """MSPE, RMSPE, MAPE per series and target over all 216 test hours."""
    split, state, model = benchmark.fit_naive(benchmark.prepared(spark, sf), ENSEMBLE, TEST_SIZE)
    pairs = benchmark.forecast_rows(split, state, model, TARGETS, only_blocks=False)
    parts = [score(pairs, ["series_id"], [m], per_column=True, counts=True).withColumn("metric", F.lit(m)) for m in
             ("mspe", "rmspe", "mape")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("a6_block_scores", O.block_benchmark_sql().replace(
    "SELECT series_id, metric, CAST(ROUND", "SELECT * FROM (SELECT series_id, metric, CAST(ROUND") + ") WHERE metric LIKE 'block_%'")
def a6_block_scores(spark, sf):
    return benchmark.run(spark, sf).where(F.col("metric").startswith("block_"))


@register("a7_block_aggregate", O.block_benchmark_sql().replace(
    "SELECT series_id, metric, CAST(ROUND", "SELECT * FROM (SELECT series_id, metric, CAST(ROUND") + ") WHERE metric NOT LIKE 'block_%'")
def a7_block_aggregate(spark, sf):
    return benchmark.run(spark, sf).where(~F.col("metric").startswith("block_"))


# ------------------------------------------------------------------ CV
def _cv_sql() -> str:
    lv = " UNION ALL ".join(
        (f"SELECT series_id, fold_id, '{c}' AS col, arg_max({c}, idx) AS yhat FROM tr GROUP BY 1, 2" if s == "last"
         else f"SELECT series_id, fold_id, '{c}' AS col, avg({c}) AS yhat FROM tr GROUP BY 1, 2")
        for c, s in ENSEMBLE.items())
    te = " UNION ALL ".join(f"SELECT series_id, fold_id, '{c}' AS col, idx, step, {c} AS y FROM te" for c in TARGETS)
    return _filled() + f""",
n AS (SELECT series_id, max(idx) + 1 AS n_rows FROM filled GROUP BY 1),
seen AS (SELECT filled.* FROM filled JOIN n USING (series_id) WHERE idx < n_rows - {TEST_SIZE}),
k AS (SELECT series_id, CAST(floor((n_rows - {TEST_SIZE + FOLD_H + FOLD_W}) / {FOLD_S}) + 1 AS BIGINT) AS nk FROM n),
f AS (SELECT series_id, range AS fold_id FROM k, range(0, nk)),
tr AS (SELECT h.*, f.fold_id FROM seen h JOIN f ON h.series_id = f.series_id
       AND h.idx >= f.fold_id * {FOLD_S} AND h.idx < f.fold_id * {FOLD_S} + {FOLD_W}),
te AS (SELECT h.*, f.fold_id, h.idx - (f.fold_id * {FOLD_S} + {FOLD_W}) + 1 AS step FROM seen h JOIN f
       ON h.series_id = f.series_id AND h.idx >= f.fold_id * {FOLD_S} + {FOLD_W}
       AND h.idx < f.fold_id * {FOLD_S} + {FOLD_W + FOLD_H}),
lv AS ({lv}),
tl AS ({te}),
pairs AS (SELECT tl.*, lv.yhat FROM tl JOIN lv USING (series_id, fold_id, col)),
fs AS (SELECT series_id, fold_id, col, avg(({_PE}) * ({_PE})) AS mspe, avg(abs({_PE})) AS mape
       FROM pairs WHERE y IS NOT NULL GROUP BY 1, 2, 3),
fsl AS (SELECT series_id, fold_id, col, 'test_MeanSquaredPercentageError' AS metric, mspe AS value FROM fs
        UNION ALL SELECT series_id, fold_id, col, 'test_MeanAbsolutePercentageError', mape FROM fs)"""


def cv_scores(spark, sf, train=None):
    """Fold scores of the naive ensemble over sliding folds of the train rows:
    the hold-out is split off before (T1), so no fold sees it."""
    pairs = cv.naive_cv(bases.targets_train(spark, sf) if train is None else train, TARGETS, ENSEMBLE, FOLD_W, FOLD_H, FOLD_S)
    fs = fold_scores(pairs, ["mspe", "mape"])
    return fs.withColumn("metric", F.concat(F.lit("test_"), F.col("metric")))


@register("m10_cv_naive", _cv_sql() + f"\nSELECT series_id, fold_id, col, metric, {rnd('value', 'value')} FROM fsl")
def m10_cv_naive(spark, sf):
    """Refit-per-fold back-test (w 336, h 72, s 72): score per fold, metric, target."""
    return cv_scores(spark, sf)


@register("a5_cv_summary", _cv_sql() + f"""
SELECT series_id, metric, col, {rnd('avg(value)', 'mean_value')}, count(*) AS n_folds FROM fsl GROUP BY 1, 2, 3""")
def a5_cv_summary(spark, sf):
    return cv_summary(cv_scores(spark, sf))


_BEST_SQL = """,
pf AS (SELECT series_id, fold_id, avg(value) AS score FROM fsl WHERE metric = 'test_MeanSquaredPercentageError'
       GROUP BY 1, 2),
best AS (SELECT series_id, arg_min(fold_id, (score, fold_id)) AS best_fold, min(score) AS best_score FROM pf GROUP BY 1)"""


@register("a8_best_fold", _cv_sql() + _BEST_SQL + f"\nSELECT series_id, best_fold, {rnd('best_score', 'best_score')} FROM best")
def a8_best_fold(spark, sf):
    """Arg-min fold of the column-averaged MSPE (first fold on ties)."""
    return best_fold(cv_scores(spark, sf), "test_MeanSquaredPercentageError")


@register("j8_chosen_fold", _cv_sql() + f"""
SELECT series_id, col, idx, step, {rnd('y', 'y')}, {rnd('yhat', 'yhat')} FROM pairs WHERE fold_id = 1""")
def j8_chosen_fold(spark, sf):
    """Predictions and truth of fold 1, on the original scale."""
    pairs = cv.naive_cv(bases.targets_train(spark, sf), TARGETS, ENSEMBLE, FOLD_W, FOLD_H, FOLD_S)
    return pairs.where(F.col("fold_id") == 1).select("series_id", "col", "idx", "step", "y", "yhat")


def _holdout_sql() -> str:
    """Best-fold naive model forecast through the gap to the hold-out rows."""
    lvb = " UNION ALL ".join(
        (f"SELECT tr.series_id, '{c}' AS col, arg_max(tr.{c}, tr.idx) AS yhat FROM tr JOIN best b "
         f"ON b.series_id = tr.series_id AND b.best_fold = tr.fold_id GROUP BY 1" if s == "last" else
         f"SELECT tr.series_id, '{c}' AS col, avg(tr.{c}) AS yhat FROM tr JOIN best b "
         f"ON b.series_id = tr.series_id AND b.best_fold = tr.fold_id GROUP BY 1") for c, s in ENSEMBLE.items())
    ho = " UNION ALL ".join(
        f"SELECT h.series_id, '{c}' AS col, h.idx, h.{c} AS y FROM hourly h JOIN n USING (series_id) "
        f"WHERE h.idx >= n.n_rows - {TEST_SIZE}" for c in TARGETS)
    return _cv_sql() + _BEST_SQL + f""",
lvb AS ({lvb}),
ho AS ({ho}),
path AS (SELECT b.series_id, lvb.col, unnest(range(b.best_fold * {FOLD_S} + {FOLD_W}, n.n_rows)) AS idx, lvb.yhat
         FROM best b JOIN n USING (series_id) JOIN lvb USING (series_id)),
hp AS (SELECT ho.*, path.yhat FROM ho LEFT JOIN path USING (series_id, col, idx))"""


def hourly_targets(spark, sf):
    """The grid's targets, written once: the folds, the fits and the hold-out
    truth of one query all read it."""
    return saved(bases.met_hourly(spark, sf).select("series_id", "ts", "idx", *TARGETS), "grid")


def best_fold_path(hourly):
    """The best fold's model forecasts every hour from its cutoff + 1
    through the gap to the last hold-out hour: ``(series_id, col, idx, yhat)``.
    Folds and fits see train rows only."""
    filled = train_test_split(ffill(hourly, TARGETS, chunk=bases.QUERY_CHUNK), TEST_SIZE)
    train = filled.where(~F.col("is_test")).select("series_id", "idx", *TARGETS)
    b = best_fold(cv_scores(None, None, train), "test_MeanSquaredPercentageError").select("series_id", F.col("best_fold").alias("fold_id"))
    folds = segments.sliding(train, FOLD_W, FOLD_H, FOLD_S).join(b, ["series_id", "fold_id"], "left_semi")
    levels = segments.fold_levels(to_long(train, TARGETS, ["series_id", "idx"]), folds, segments.sliding_cut(FOLD_W, FOLD_S))
    yhat = F.when(cv._strategy_col(ENSEMBLE) == "last", F.col("last")).otherwise(F.col("mean"))
    n = series_length(hourly.select("series_id", "idx"))
    return levels.join(folds.select("series_id", "fold_id", "hi"), ["series_id", "fold_id"]).join(n, "series_id").select(
        "series_id", "col", F.explode(F.sequence(F.col("hi"), F.col("n_rows") - 1)).alias("idx"), yhat.alias("yhat"))


def holdout_pairs(spark, sf):
    """The forecast path reindexed to the hold-out hours; truth is the raw
    hourly value."""
    h = hourly_targets(spark, sf)
    ho = train_test_split(h, TEST_SIZE).where(F.col("is_test"))
    truth = to_long(ho, TARGETS, ["series_id", "idx"]).withColumnRenamed("value", "y")
    return truth.join(best_fold_path(h), ["series_id", "col", "idx"], "left")


@register("m13_forecast_gap", _holdout_sql() + f"\nSELECT series_id, col, idx, {rnd('yhat', 'yhat')} FROM hp")
def m13_forecast_gap(spark, sf):
    return holdout_pairs(spark, sf).select("series_id", "col", "idx", "yhat")


@register("m17_best_fold_holdout", _holdout_sql() + f""",
s AS (SELECT series_id, avg(m) AS mspe FROM (SELECT series_id, col, avg(({_PE}) * ({_PE})) AS m FROM hp
      WHERE y IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT series_id, avg(m) AS mape FROM (SELECT series_id, col, avg(abs({_PE})) AS m FROM hp
      WHERE y IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT series_id, 'MeanSquaredPercentageError' AS metric, {rnd('mspe', 'value')} FROM s UNION ALL
SELECT series_id, 'MeanAbsolutePercentageError', {rnd('mape', 'value')} FROM a""")
def m17_best_fold_holdout(spark, sf):
    """Best-fold model on the hold-out, scored on the original scale."""
    return score(holdout_pairs(spark, sf), ["series_id"], ["mspe", "mape"])


_CASES = {"whole": "true", "last hour missing": "idx < n_rows - 1", "from the cutoff": None}


def _key_case(name, keep):
    got = "SELECT DISTINCT path.series_id, path.idx, n.n_rows FROM path JOIN n USING (series_id) WHERE col = 'WVHT'" + (
        f" AND idx >= n_rows - {TEST_SIZE} AND {keep}" if keep else "")
    return f"""SELECT e.series_id, '{name}' AS "case", count(*) AS n_expected, count(*) FILTER (WHERE g.idx IS NULL) AS n_missing,
  (SELECT count(*) FROM ({got}) x WHERE x.series_id = e.series_id AND x.idx < x.n_rows - {TEST_SIZE}) AS n_extra
FROM exp e LEFT JOIN ({got}) g ON g.series_id = e.series_id AND g.idx = e.idx GROUP BY e.series_id"""


@register("j2_key_check", _holdout_sql() + f""",
exp AS (SELECT h.series_id, h.idx FROM hourly h JOIN n USING (series_id) WHERE h.idx >= n.n_rows - {TEST_SIZE})
""" + " UNION ALL ".join(_key_case(*c) for c in _CASES.items()))
def j2_key_check(spark, sf):
    """Forecast keys against the hold-out keys, the former built from the fold's
    cutoff: the hold-out part of the path, the same without its last hour, and
    the whole path with the hours of the gap."""
    grid = hourly_targets(spark, sf)
    h = grid.select("series_id", "idx")
    split = train_test_split(h, TEST_SIZE)
    expected = split.where(F.col("is_test")).select("series_id", "idx")
    path = best_fold_path(grid).where(F.col("col") == TARGETS[0]).join(series_length(h), "series_id")
    inside, last = F.col("idx") >= F.col("n_rows") - TEST_SIZE, F.col("idx") == F.col("n_rows") - 1
    cases = F.array_compact(F.array(F.when(inside, F.lit("whole")), F.when(inside & ~last, F.lit("last hour missing")), F.lit("from the cutoff")))
    return cv.key_mismatch(expected.withColumn("case", F.explode(F.array(*map(F.lit, _CASES)))), path.withColumn("case", F.explode(cases)),
                           ["series_id", "case", "idx"], ["series_id", "case"])


@register("m16_predict_block", _naive_sql(ENSEMBLE) +
          f"\nSELECT series_id, col, idx, {rnd('yhat', 'yhat')} FROM pred WHERE block_id = 2")
def m16_predict_block(spark, sf):
    """Predict one block (block 2) at its absolute times (semi join of the block's rows)."""
    split, state, model = benchmark.fit_naive(benchmark.prepared(spark, sf), ENSEMBLE, TEST_SIZE)
    rows = benchmark.forecast_rows(split, state, model, TARGETS)
    return rows.where(F.col("block_id") == 2).select("series_id", "col", "idx", "yhat")


def _expanding_sql() -> str:
    full = O.ffill_cte("sp", TARGETS, "ff", keep="series_id, idx, block_id, test_start")
    lv = " UNION ALL ".join(
        (f"SELECT b.series_id, b.block_id, '{c}' AS col, arg_max(ff.{c}, ff.idx) AS yhat FROM blocks_ b JOIN ff "
         f"ON ff.series_id = b.series_id AND ff.idx < b.bstart GROUP BY 1, 2" if s == "last" else
         f"SELECT b.series_id, b.block_id, '{c}' AS col, avg(ff.{c}) AS yhat FROM blocks_ b JOIN ff "
         f"ON ff.series_id = b.series_id AND ff.idx < b.bstart GROUP BY 1, 2") for c, s in ENSEMBLE.items())
    tr = " UNION ALL ".join(f"SELECT series_id, block_id, '{c}' AS col, {c} AS y FROM sp WHERE block_id IS NOT NULL"
                            for c in TARGETS)
    return _naive_sql(ENSEMBLE) + f""",
{full},
blocks_ AS (SELECT DISTINCT series_id, block_id, test_start + (block_id - 1) * {HORIZON} AS bstart FROM sp
            WHERE block_id IS NOT NULL),
lvx AS ({lv}),
tx AS ({tr}),
px AS (SELECT tx.*, lvx.yhat FROM tx JOIN lvx USING (series_id, block_id, col) WHERE tx.y IS NOT NULL),
pc AS (SELECT series_id, block_id, col, sqrt(avg(({_PE}) * ({_PE}))) AS rmspe, avg(abs({_PE})) AS mape
       FROM px GROUP BY 1, 2, 3),
bk AS (SELECT series_id, block_id, avg(rmspe) AS rmspe, avg(mape) AS mape FROM pc GROUP BY 1, 2)
SELECT series_id, 'block_' || block_id || '_MeanSquaredPercentageError' AS metric, {rnd('rmspe', 'value')} FROM bk
UNION ALL SELECT series_id, 'block_' || block_id || '_MeanAbsolutePercentageError', {rnd('mape', 'value')} FROM bk"""


@register("m15_expanding_blocks", _expanding_sql())
def m15_expanding_blocks(spark, sf):
    """Blocks one after another, each fitted on all actuals before it
    (forward-filled), scored per block."""
    h = benchmark.prepared(spark, sf).select("series_id", "idx", *TARGETS)
    split = assign_blocks(train_test_split(h, TEST_SIZE), HORIZON)
    filled = cv.expanding_blocks(
        benchmark.ffill(split.select("series_id", "idx", "test_start", "n_blocks", *TARGETS), TARGETS),
        TARGETS, ENSEMBLE, horizon=HORIZON)
    truth = to_long(split.where(F.col("block_id").isNotNull()), TARGETS, ["series_id", "idx", "block_id"]) \
        .withColumnRenamed("value", "y")
    pairs = truth.join(filled.withColumnRenamed("level", "yhat"), ["series_id", "block_id", "col"], "inner")
    from ..operators.metrics import block_scores
    return block_scores(pairs, ["rmspe", "mape"]).select("series_id", "metric", "value")


@register("a13_run_facts", _naive_sql(ENSEMBLE) + f""",
nb AS (SELECT series_id, count(DISTINCT block_id) AS n_blocks FROM sp GROUP BY 1)
SELECT nb.series_id, nb.n_blocks, CAST({HORIZON} AS BIGINT) AS block_size,
  CAST(floor((n.n_rows - {TEST_SIZE + FOLD_H + FOLD_W}) / {FOLD_S}) + 1 AS BIGINT) AS n_folds
FROM nb JOIN n USING (series_id)""")
def a13_run_facts(spark, sf):
    """Number of blocks, block size and number of folds per series."""
    h = benchmark.prepared(spark, sf).select("series_id", "idx")
    b = assign_blocks(train_test_split(h, TEST_SIZE), HORIZON)
    from ..operators.blocks import n_folds
    return b.groupBy("series_id").agg(F.count_distinct("block_id").alias("n_blocks"),
                                      F.max("n_rows").alias("_n")) \
        .select("series_id", "n_blocks", F.lit(HORIZON).cast("long").alias("block_size"),
                n_folds(F.col("_n") - TEST_SIZE, FOLD_W, FOLD_H, FOLD_S).alias("n_folds"))


@register("m9_gbt_direct")
def m9_gbt_direct(spark, sf):
    """Direct boosted trees (one pooled MLlib GBT per target, W15 lags of the
    targets and of every exogenous column + calendar) scored over the three
    72-hour test blocks."""
    from ..config import DIRECT_LAGS
    from ..operators.metrics import aggregate_blocks, block_scores
    from ..operators.models import direct_features, fit_predict_direct
    f = bases.met_filled(spark, sf)
    feats_df, feats = direct_features(f, CLEAN_COLUMNS, DIRECT_LAGS, HORIZON)
    split = materialize(assign_blocks(train_test_split(feats_df, TEST_SIZE), HORIZON))
    truth = bases.met_hourly(spark, sf).select("series_id", "idx", *TARGETS)
    parts = []
    for c in TARGETS:
        pred = fit_predict_direct(split.where(~F.col("is_test")), split.where(F.col("block_id").isNotNull()),
                                  feats, c)
        parts.append(pred.select("series_id", "idx", "block_id", F.lit(c).alias("col"), "yhat"))
    pred = parts[0].unionByName(parts[1])
    y = to_long(truth, TARGETS, ["series_id", "idx"]).withColumnRenamed("value", "y")
    pairs = pred.join(y, ["series_id", "idx", "col"], "inner")
    bs = block_scores(pairs, ["rmspe", "mape"])
    return bs.select("series_id", "metric", "value").unionByName(aggregate_blocks(bs))


@register("m4_arima_blocks")
def m4_arima_blocks(spark, sf):
    """ARIMA(1,0,1) per target after scaling and the lag-24 difference,
    scored over the three 72-hour test blocks."""
    return benchmark.arima_benchmark(benchmark.prepared(spark, sf))


@register("m4_arima_fit")
def m4_arima_fit(spark, sf):
    """Hannan-Rissanen ARIMA(1,0,1) coefficients of every z-scored column."""
    from ..operators.arima import hannan_rissanen
    from .q_diag import scaled_long
    return hannan_rissanen(scaled_long(spark, sf)).drop("last_idx")


GRID = [{"WVHT": a, "APD": b} for a in ("last", "mean") for b in ("last", "mean")]


def _grid_sql() -> str:
    vals = ", ".join(f"({i}, '{c}', '{s}')" for i, t in enumerate(GRID) for c, s in t.items())
    te = " UNION ALL ".join(f"SELECT series_id, fold_id, '{c}' AS col, idx, {c} AS y FROM te" for c in TARGETS)
    trl = " UNION ALL ".join(f"SELECT series_id, fold_id, '{c}' AS col, idx, {c} AS value FROM tr" for c in TARGETS)
    return _cv_sql() + f""",
trials AS (SELECT * FROM (VALUES {vals}) t(trial_id, col, strategy)),
trl AS ({trl}),
glv AS (SELECT t.series_id, tr.trial_id, t.fold_id, t.col,
        CASE WHEN tr.strategy = 'last' THEN arg_max(t.value, t.idx) ELSE avg(t.value) END AS yhat
        FROM trl t JOIN trials tr ON tr.col = t.col GROUP BY t.series_id, tr.trial_id, t.fold_id, t.col, tr.strategy),
gte AS ({te}),
gp AS (SELECT gte.*, glv.trial_id, glv.yhat FROM gte JOIN glv USING (series_id, fold_id, col)),
gc AS (SELECT series_id, trial_id, fold_id, col, avg(({_PE}) * ({_PE})) AS m FROM gp WHERE y IS NOT NULL GROUP BY ALL),
gf AS (SELECT series_id, trial_id, fold_id, avg(m) AS value FROM gc GROUP BY ALL),
obj AS (SELECT series_id, trial_id, avg(value) AS objective, count(*) AS n_folds FROM gf GROUP BY ALL)"""


def grid_objectives(spark, sf):
    pairs = cv.naive_grid_cv(bases.targets_train(spark, sf), TARGETS, GRID, FOLD_W, FOLD_H, FOLD_S)
    fs = score(pairs, ["series_id", "trial_id", "fold_id"], ["mspe"])   # column-averaged per fold
    return cv.trial_objective(fs)


@register("m11_grid_search", _grid_sql() + f"\nSELECT series_id, trial_id, {rnd('objective', 'objective')}, n_folds FROM obj")
def m11_grid_search(spark, sf):
    """Grid search over the naive strategy per target (2 x 2 trials) scored
    by sliding-window CV; A9 objective = mean MSPE over folds."""
    return grid_objectives(spark, sf)


@register("a10_best_trial", _grid_sql() + f"""
SELECT series_id, arg_min(trial_id, (objective, trial_id)) AS best_trial, {rnd('min(objective)', 'best_value')}
FROM obj GROUP BY 1""")
def a10_best_trial(spark, sf):
    """Best trial (smallest objective, first on ties) with its value."""
    return cv.best_trial(grid_objectives(spark, sf))


def tree_features(spark, sf):
    """Train rows with what is known of an hour a horizon ahead: direct lags of the
    targets (W15), the calendar and the exogenous column."""
    from ..config import DIRECT_LAGS
    from ..operators.models import direct_features
    f = train_test_split(bases.met_filled(spark, sf, [*TARGETS, EXOG]), TEST_SIZE).where(~F.col("is_test"))
    rows, names = direct_features(f.select("series_id", "ts", "idx", *TARGETS, EXOG), TARGETS, DIRECT_LAGS, HORIZON)
    names = [*names, EXOG]
    return saved(rows.select("series_id", "idx", *TARGETS, *names), "features"), names


def _tree_search(spark, sf, trials):
    from ..operators.tuning import random_search, with_settings
    rows, names = tree_features(spark, sf)
    objectives, best = random_search(rows, names, TARGETS, trials, FOLD_W, FOLD_H, FOLD_S)
    return with_settings(objectives.join(best.withColumnRenamed("best_trial", "trial_id").select("series_id", "trial_id", F.lit(True).alias("is_best")),
                                         ["series_id", "trial_id"], "left").fillna(False, ["is_best"]), trials)


@register("m11_grid_trees")
def m11_grid_trees(spark, sf):
    """Grid search over trees x rate x depth (27 trials at the full tree counts),
    refitted on every sliding fold: the trial table with settings, objective and
    the best trial of each series. Held against plain fits by the tests."""
    from ..operators.tuning import grid_trials
    return _tree_search(spark, sf, grid_trials())


@register("m12_random_search")
def m12_random_search(spark, sf):
    """Random search: ten seeded trials over trees, depth, gamma, alpha and lambda,
    refitted on every sliding fold; the same trial table."""
    from ..operators.tuning import sample_trials
    return _tree_search(spark, sf, sample_trials())


@register("s8_model_store", _naive_sql(ENSEMBLE) + f"""
SELECT series_id, block_id, count(*) AS n_rows, count(*) AS n_predicted, CAST(0 AS BIGINT) AS n_different
FROM sp WHERE block_id IS NOT NULL GROUP BY ALL""")
def s8_model_store(spark, sf):
    """Fit the direct boosted-tree model for WVHT, save it with MLlib's
    writer under the checkpoint folder, load it back, and count per test
    block the rows in which the loaded model's prediction differs."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
    from ..config import DIRECT_LAGS
    from ..operators.models import direct_features
    from .q_misc import scratch
    f = bases.targets_filled(spark, sf)
    feats_df, feats = direct_features(f, TARGETS, DIRECT_LAGS, HORIZON)
    split = materialize(assign_blocks(train_test_split(feats_df, TEST_SIZE), HORIZON))
    asm = VectorAssembler(inputCols=feats, outputCol="_features", handleInvalid="error")
    tr = asm.transform(split.where(~F.col("is_test")).na.drop(subset=[*feats, "WVHT"]))
    model = GBTRegressor(featuresCol="_features", labelCol="WVHT", predictionCol="yhat", maxIter=20,
                         maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=42).fit(tr)
    path = scratch(spark, "model")
    model.write().save(path)
    loaded = GBTRegressionModel.load(path)
    rows = asm.transform(split.where(F.col("block_id").isNotNull()))
    keep = ["series_id", "idx", "block_id", "yhat"]
    both = model.transform(rows).select(*keep).join(loaded.transform(rows).select(*keep[:3], F.col("yhat").alias("again")), keep[:3], "full")
    return both.groupBy("series_id", "block_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("yhat").alias("n_predicted"),
        F.sum((~F.col("yhat").eqNullSafe(F.col("again"))).cast("long")).alias("n_different"))


@register("s9_best_score", _grid_sql() + f""",
best AS (SELECT series_id, arg_min(trial_id, (objective, trial_id)) AS best_trial, min(objective) AS best_value
         FROM obj GROUP BY 1)
SELECT 'grid/' || series_id AS run_id, 'best_value' AS key, {rnd('best_value', 'value')}, CAST(0 AS BIGINT) AS step FROM best
UNION ALL SELECT 'grid/' || series_id, 'best_trial', {rnd('CAST(best_trial AS DOUBLE)', 'value')}, CAST(0 AS BIGINT) FROM best""")
def s9_best_score(spark, sf):
    """Append the best trial of the grid search as metric rows (run
    'grid/<series>') to a metric table and read it back."""
    from .q_misc import scratch
    b = cv.best_trial(grid_objectives(spark, sf))
    rows = b.select(F.concat(F.lit("grid/"), "series_id").alias("run_id"),
                    F.expr("stack(2, 'best_value', best_value, 'best_trial', CAST(best_trial AS DOUBLE)) as (key, value)"),
                    F.lit(0).cast("long").alias("step"))
    path = scratch(spark, "metric")
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)


@register("m8_gbt_recursive")
def m8_gbt_recursive(spark, sf):
    """Recursive boosted trees with target-lag and exogenous features, one
    pooled model per target, forecast 216 hours from the train end and
    scored over the three 72-hour blocks."""
    return benchmark.recursive_gbt_benchmark(benchmark.prepared(spark, sf))


# ----------------------------------------------- fitted models and exogenous columns
EXOG = "WSPD"


def train_with_exog(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Filled targets and the exogenous column: the train rows, and all rows."""
    keep = ["series_id", "idx", *TARGETS, EXOG]
    f = saved(bases.met_filled(spark, sf, [*TARGETS, EXOG]).select(*keep), "filled")  # fits and forecasts read it several times
    f = train_test_split(f, TEST_SIZE)
    return f.where(~F.col("is_test")).select(*keep), f.select(*keep, "is_test", "n_rows")


@register("m10_cv_arima")
def m10_cv_arima(spark, sf):
    """ARIMA(1,0,1) refitted on every sliding fold (segment Grams): score per
    fold, metric and target. Held against single refits by the tests."""
    pairs = cv.arima_cv(bases.targets_train(spark, sf), TARGETS, FOLD_W, FOLD_H, FOLD_S, chunk=bases.QUERY_CHUNK)
    return fold_scores(pairs, ["mspe", "mape"]).withColumn("metric", F.concat(F.lit("test_"), F.col("metric")))


@register("m15_expanding_arima")
def m15_expanding_arima(spark, sf):
    """ARIMA(1,0,1) refitted before every test block on all hours before it,
    scored per block against the raw hourly truth."""
    from ..operators.metrics import aggregate_blocks, block_scores
    split = assign_blocks(train_test_split(bases.targets_filled(spark, sf), TEST_SIZE), HORIZON)
    pred = cv.expanding_arima(split, TARGETS, horizon=HORIZON, chunk=bases.QUERY_CHUNK).drop("y")
    truth = to_long(bases.met_hourly(spark, sf).select("series_id", "idx", *TARGETS), TARGETS, ["series_id", "idx"]).withColumnRenamed("value", "y")
    bs = block_scores(pred.join(truth, ["series_id", "col", "idx"]), ["rmspe", "mape"])
    return bs.select("series_id", "metric", "value").unionByName(aggregate_blocks(bs))


def _exog_cv_sql() -> str:
    coef = " UNION ALL ".join(f"SELECT series_id, fold_id, '{c}' AS col, regr_slope({c}, {EXOG}) AS b, regr_intercept({c}, {EXOG}) AS a FROM tr GROUP BY 1, 2"
                              for c in TARGETS)
    te = " UNION ALL ".join(f"SELECT series_id, fold_id, '{c}' AS col, {c} AS y, {EXOG} AS x FROM te" for c in TARGETS)
    return _filled([*TARGETS, EXOG]) + f""",
n AS (SELECT series_id, max(idx) + 1 AS n_rows FROM filled GROUP BY 1),
seen AS (SELECT filled.* FROM filled JOIN n USING (series_id) WHERE idx < n_rows - {TEST_SIZE}),
k AS (SELECT series_id, CAST(floor((n_rows - {TEST_SIZE + FOLD_H + FOLD_W}) / {FOLD_S}) + 1 AS BIGINT) AS nk FROM n),
f AS (SELECT series_id, range AS fold_id FROM k, range(0, nk)),
tr AS (SELECT h.*, f.fold_id FROM seen h JOIN f ON h.series_id = f.series_id
       AND h.idx >= f.fold_id * {FOLD_S} AND h.idx < f.fold_id * {FOLD_S} + {FOLD_W}),
te AS (SELECT h.*, f.fold_id FROM seen h JOIN f ON h.series_id = f.series_id AND h.idx >= f.fold_id * {FOLD_S} + {FOLD_W}
       AND h.idx < f.fold_id * {FOLD_S} + {FOLD_W + FOLD_H}),
coef AS ({coef}),
tl AS ({te}),
pairs AS (SELECT tl.*, a + b * x AS yhat FROM tl JOIN coef USING (series_id, fold_id, col)),
fs AS (SELECT series_id, fold_id, col, avg(({_PE}) * ({_PE})) AS mspe, avg(abs({_PE})) AS mape
       FROM pairs WHERE y IS NOT NULL GROUP BY 1, 2, 3),
fsl AS (SELECT series_id, fold_id, col, 'test_MeanSquaredPercentageError' AS metric, mspe AS value FROM fs
        UNION ALL SELECT series_id, fold_id, col, 'test_MeanAbsolutePercentageError', mape FROM fs)"""


def exog_cv_scores(train):
    pairs = cv.regression_cv(train, TARGETS, [EXOG], FOLD_W, FOLD_H, FOLD_S, chunk=bases.QUERY_CHUNK)
    return fold_scores(pairs, ["mspe", "mape"]).withColumn("metric", F.concat(F.lit("test_"), F.col("metric")))


@register("m10_cv_exog", _exog_cv_sql() + f"\nSELECT series_id, fold_id, col, metric, {rnd('value', 'value')} FROM fsl")
def m10_cv_exog(spark, sf):
    """Regression on an exogenous column, refitted on every sliding fold and
    predicted from the test rows' own exogenous values."""
    return exog_cv_scores(train_with_exog(spark, sf)[0])


@register("m13_forecast_exog", _exog_cv_sql() + _BEST_SQL + f""",
bc AS (SELECT c.* FROM coef c JOIN best b ON b.series_id = c.series_id AND b.best_fold = c.fold_id)
SELECT f.series_id, bc.col, f.idx, {rnd(f'a + b * f.{EXOG}', 'yhat')} FROM filled f JOIN n USING (series_id) JOIN bc USING (series_id)
WHERE f.idx >= n.n_rows - {TEST_SIZE}""")
def m13_forecast_exog(spark, sf):
    """The best fold's regression forecasts from its cutoff through the gap to
    the end of the hold-out, with the exogenous rows of train and test stitched
    and reindexed; the hold-out hours are returned."""
    from ..operators.forecaster import Fitted, Regression, forecast_with_exog
    train, rows = train_with_exog(spark, sf)
    folds = segments.sliding(train.select("series_id", "idx"), FOLD_W, FOLD_H, FOLD_S)
    long = to_long(train, TARGETS, ["series_id", "idx", EXOG])
    models = segments.fold_regression(long, [EXOG], folds, segments.sliding_cut(FOLD_W, FOLD_S), chunk=bases.QUERY_CHUNK)
    best = best_fold(exog_cv_scores(train), "test_MeanSquaredPercentageError").select("series_id", F.col("best_fold").alias("fold_id"))
    table = models.join(best, ["series_id", "fold_id"]).join(folds.select("series_id", "fold_id", (F.col("hi") - 1).alias("cutoff")), ["series_id", "fold_id"])
    x = rows.select("series_id", "idx", EXOG, "is_test")
    return forecast_with_exog(Fitted(Regression([EXOG]), table.drop("fold_id")), x.where("NOT is_test").drop("is_test"), x.where("is_test").drop("is_test"))


def fit_on_train(spark, sf, forecaster):
    """The forecaster fitted on the filled train rows, and the exogenous rows."""
    train, rows = train_with_exog(spark, sf)
    x = rows.select("series_id", "idx", EXOG)
    return forecaster.fit(to_long(train, TARGETS, ["series_id", "idx"]), x.join(train.select("series_id", "idx"), ["series_id", "idx"])), x, rows


_LINE = " UNION ALL ".join(f"SELECT series_id, '{c}' AS col, regr_slope({c}, {EXOG}) AS b, regr_intercept({c}, {EXOG}) AS a FROM seen GROUP BY 1" for c in TARGETS)


@register("m16_predict_block_exog", _exog_cv_sql() + f""",
line AS ({_LINE})
SELECT f.series_id, l.col, f.idx, {rnd(f'a + b * f.{EXOG}', 'yhat')} FROM filled f JOIN n USING (series_id) JOIN line l USING (series_id)
WHERE f.idx >= n.n_rows - {TEST_SIZE - HORIZON} AND f.idx < n.n_rows - {TEST_SIZE - 2 * HORIZON}""")
def m16_predict_block_exog(spark, sf):
    """One block (block 2) forecast at its absolute times with the block's
    exogenous rows picked by key (J5)."""
    from ..operators.forecaster import Regression, predict_block
    fitted, x, rows = fit_on_train(spark, sf, Regression([EXOG], bases.QUERY_CHUNK))
    start = F.col("n_rows") - TEST_SIZE + HORIZON
    block = rows.where((F.col("idx") >= start) & (F.col("idx") < start + HORIZON)).select("series_id", "idx")
    return predict_block(fitted, block, x, use_exog=True)


@register("m16_all_forecasters")
def m16_all_forecasters(spark, sf):
    """Naive ensemble, ARIMA, regression and boosted trees fitted through one
    protocol, each forecasting the hold-out once, scored per forecaster."""
    from ..operators.forecaster import Arima, Naive, Regression, Trees, forecast_with_exog
    train, rows = train_with_exog(spark, sf)
    y, x = to_long(train, TARGETS, ["series_id", "idx"]), rows.select("series_id", "idx", EXOG, "is_test")
    x_train, x_test = x.where("NOT is_test").drop("is_test"), x.where("is_test").drop("is_test")
    truth = to_long(rows.where("is_test"), TARGETS, ["series_id", "idx"]).withColumnRenamed("value", "y")
    parts = []
    for name, forecaster in {"naive": Naive(ENSEMBLE), "arima": Arima(chunk=bases.QUERY_CHUNK), "regression": Regression([EXOG], bases.QUERY_CHUNK),
                             "trees": Trees([EXOG])}.items():
        pred = forecast_with_exog(forecaster.fit(y, x_train), x_train, x_test)
        parts.append(score(truth.join(pred, ["series_id", "col", "idx"]), ["series_id"], ["mspe", "mape"]).withColumn("forecaster", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@register("a4_custom_scorer", _naive_sql(ENSEMBLE) + f"""
SELECT series_id, col, 'MedianAbsolutePercentageError' AS metric, {rnd(f'median(abs({_PE}))', 'value')} FROM pred WHERE y IS NOT NULL GROUP BY 1, 2""")
def a4_custom_scorer(spark, sf):
    """A scorer of the user's own beside the built-in ones: the median of the
    absolute percentage errors per series and target."""
    from ..operators.metrics import Scorer
    split, state, model = benchmark.fit_naive(benchmark.prepared(spark, sf), ENSEMBLE, TEST_SIZE)
    pairs = benchmark.forecast_rows(split, state, model, TARGETS, only_blocks=False)
    median = Scorer("MedianAbsolutePercentageError", lambda y, yhat, pe: F.median(F.abs(pe)))
    return score(pairs, ["series_id"], [median], per_column=True)
