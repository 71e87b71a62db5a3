"""Registered queries: window features, differencing, splits, blocks, folds,
scaling pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import (CLEAN_COLUMNS, DIRECT_LAGS, EXOGENOUS, HORIZON, LAGGED_MEANS, TARGET_LAGS,
                      TARGETS, WINDOW)
from ..operators import blocks, clean, pipeline, windows
from ..operators.scaling import apply_scaler, fit_scaler, to_long
from ..session import saved
from . import bases
from .bases import QUERY_CHUNK
from . import oracles as O
from .oracles import rnd
from .queries import register

TEST_SIZE = HORIZON * 3
P = "PARTITION BY series_id ORDER BY idx"


def _filled(cols=TARGETS) -> str:
    return O.met_hourly_prefix() + ",\n" + O.ffill_cte("hourly", list(cols), "filled")


def _lag(c: str, k: int) -> str:
    return f"lag({c}, {k}) OVER ({P})"


def _gated(fn: str, c: str, lag: int, length: int) -> str:
    fr = f"({P} ROWS BETWEEN {lag + length - 1} PRECEDING AND {lag} PRECEDING)"
    return f"CASE WHEN count({c}) OVER {fr} = {length} THEN {fn}({c}) OVER {fr} END"


def _summary_sql(src: str, cols, lags, means, stds, bfill: bool, keep: str = "series_id, ts, idx",
                 name: str = "feat") -> str:
    """CTE ``name`` with lag/mean/std features (+ leading back-fill)."""
    feats = []
    for c in cols:
        feats += [(f"{c}_lag_{k}", _lag(c, k)) for k in lags]
        feats += [(f"{c}_mean_{a}_{b}", _gated("avg", c, a, b)) for a, b in means]
        feats += [(f"{c}_std_{a}_{b}", _gated("stddev_samp", c, a, b)) for a, b in stds]
    raw = f"{name}_raw AS (SELECT {keep}, {', '.join(f'{e} AS {n}' for n, e in feats)} FROM {src})"
    wall = f"({P} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    if bfill:
        sel = ", ".join(f"coalesce({n}, first_value({n} IGNORE NULLS) OVER {wall}) AS {n}" for n, _ in feats)
    else:
        sel = ", ".join(n for n, _ in feats)
    return raw + f",\n{name} AS (SELECT {keep}, {sel} FROM {name}_raw)", [n for n, _ in feats]


def _round_all(names) -> str:
    return ", ".join(rnd(n, n) for n in names)


# ------------------------------------------------------------------ fills
@register("w7_ffill", _filled() + f"\nSELECT series_id, ts, idx, {_round_all(TARGETS)} FROM filled")
def w7_ffill(spark, sf):
    """Forward fill (+ leading back-fill) of the cleaned targets."""
    return bases.targets_filled(spark, sf)


@register("w8_bfill", O.met_hourly_prefix() + f"""
SELECT series_id, ts, idx, {', '.join(rnd(f"first_value({c} IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", c) for c in TARGETS)}
FROM hourly""")
def w8_bfill(spark, sf):
    g = bases.met_hourly(spark, sf).select("series_id", "ts", "idx", *TARGETS)
    return windows.bfill(g, TARGETS, chunk=QUERY_CHUNK)


# ---------------------------------------------------------------- features
_W1_SQL, _W1_N = _summary_sql("filled", TARGETS, TARGET_LAGS, [], [], False)


@register("w1_lags", _filled() + ",\n" + _W1_SQL + f"\nSELECT series_id, ts, idx, {_round_all(_W1_N)} FROM feat")
def w1_lags(spark, sf):
    f = bases.targets_filled(spark, sf)
    return windows.lags(f, TARGETS, TARGET_LAGS, chunk=QUERY_CHUNK).drop(*TARGETS)


_W2_SQL, _W2_N = _summary_sql("filled", TARGETS, [], LAGGED_MEANS, [], False)


@register("w2_lagged_mean", _filled() + ",\n" + _W2_SQL + f"\nSELECT series_id, ts, idx, {_round_all(_W2_N)} FROM feat")
def w2_lagged_mean(spark, sf):
    f = bases.targets_filled(spark, sf)
    return windows.window_summary(f, TARGETS, mean=LAGGED_MEANS, truncate_bfill=False, replace=True, chunk=QUERY_CHUNK)


_W3_SQL, _W3_N = _summary_sql("filled", TARGETS, [], [], [(1, 4)], False)


@register("w3_lagged_std", _filled() + ",\n" + _W3_SQL + f"\nSELECT series_id, ts, idx, {_round_all(_W3_N)} FROM feat")
def w3_lagged_std(spark, sf):
    f = bases.targets_filled(spark, sf)
    return windows.window_summary(f, TARGETS, std=[(1, 4)], truncate_bfill=False, replace=True, chunk=QUERY_CHUNK)


_W4_SQL, _W4_N = _summary_sql("filled", TARGETS, TARGET_LAGS, LAGGED_MEANS, [], True)


@register("w4_target_summary", _filled() + ",\n" + _W4_SQL + f"\nSELECT series_id, ts, idx, {_round_all(_W4_N)} FROM feat")
def w4_target_summary(spark, sf):
    """Target lag summarizer: lags 1,2,3,4,24,48,72, means [1,24] [24,48],
    leading NULLs back-filled (truncate='bfill')."""
    f = bases.targets_filled(spark, sf)
    return windows.window_summary(f, TARGETS, lag=TARGET_LAGS, mean=LAGGED_MEANS, replace=True, chunk=QUERY_CHUNK)


_W5_SQL, _W5_N = _summary_sql("filled", EXOGENOUS, [1], LAGGED_MEANS, [], True)


@register("w5_exog_summary", _filled(CLEAN_COLUMNS) + ",\n" + _W5_SQL +
          f"\nSELECT series_id, ts, idx, {_round_all(_W5_N)} FROM feat")
def w5_exog_summary(spark, sf):
    """Exogenous lag summarizer routed to the listed (exogenous) columns,
    which are replaced by their features."""
    f = bases.met_filled(spark, sf).select("series_id", "ts", "idx", *EXOGENOUS)
    return windows.window_summary(f, EXOGENOUS, lag=[1], mean=LAGGED_MEANS, replace=True, chunk=QUERY_CHUNK)


_W5D_SQL, _W5D_N = _summary_sql("filled", ["WSPD"], [1, 24, 28], [(1, 24)], [], True)


@register("w5_default_column", _filled(CLEAN_COLUMNS) + ",\n" + _W5D_SQL +
          f"\nSELECT f.series_id, f.ts, f.idx, {rnd('f.GST', 'GST')}, {_round_all(_W5D_N)} FROM feat JOIN filled f USING (series_id, idx)")
def w5_default_column(spark, sf):
    """Lag summarizer without a column list: the first column (WSPD) is replaced
    by lags 1, 24, 28 and the mean [1, 24], the others (here GST) pass."""
    f = bases.met_filled(spark, sf).select("series_id", "ts", "idx", "WSPD", "GST")
    return windows.window_summary(f, lag=[1, 24, 28], mean=[(1, 24)], replace=True, chunk=QUERY_CHUNK)


# ------------------------------------------------------------ differencing
@register("w9_seasonal_diff", _filled() + f"""
SELECT series_id, ts, idx, {', '.join(rnd(f"CASE WHEN idx < 24 THEN 0.0 ELSE {c} - {_lag(c, 24)} END", c) for c in TARGETS)}
FROM filled""")
def w9_seasonal_diff(spark, sf):
    return windows.seasonal_diff(bases.targets_filled(spark, sf), TARGETS, 24, fill_zero=True, chunk=QUERY_CHUNK)


@register("w10_inverse_diff", _filled() + f"\nSELECT series_id, idx, {_round_all(TARGETS)} FROM filled WHERE idx >= 24")
def w10_inverse_diff(spark, sf):
    """Inverse of the lag-24 difference: levels rebuilt from the first 24
    levels (seed) and the differences of all later rows (identity check)."""
    f = bases.targets_filled(spark, sf).select("series_id", "idx", *TARGETS)
    d = windows.seasonal_diff(f, TARGETS, 24, fill_zero=True, chunk=QUERY_CHUNK)
    seeds = f.where(F.col("idx") < 24)
    return windows.inverse_seasonal_diff(d.where(F.col("idx") >= 24), seeds, TARGETS, 24, chunk=QUERY_CHUNK)


@register("w11_diff_dropna", _filled() + f"""
SELECT series_id, idx, {', '.join(rnd(f"{c} - {_lag(c, 24)}", c) for c in TARGETS)}
FROM filled QUALIFY idx >= 24""")
def w11_diff_dropna(spark, sf):
    d = windows.seasonal_diff(bases.targets_filled(spark, sf).select("series_id", "idx", *TARGETS),
                              TARGETS, 24, fill_zero=False, chunk=QUERY_CHUNK)
    return d.dropna(subset=TARGETS)


_ROLL = []
for _c in TARGETS:
    _fr = f"({P} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
    _ROLL.append(rnd(f"CASE WHEN count({_c}) OVER {_fr} = 12 THEN avg({_c}) OVER {_fr} END", f"{_c}_roll_mean"))
    _ROLL.append(rnd(f"CASE WHEN count({_c}) OVER {_fr} = 12 THEN stddev_samp({_c}) OVER {_fr} END", f"{_c}_roll_std"))


@register("w12_rolling", _filled() + f"\nSELECT series_id, ts, idx, {', '.join(_ROLL)} FROM filled")
def w12_rolling(spark, sf):
    f = bases.targets_filled(spark, sf)
    return windows.rolling(f, TARGETS, 12, chunk=QUERY_CHUNK).drop(*TARGETS)


_W13_WIN, _W13_H = WINDOW, HORIZON


@register("w13_sliding_pairs", O.obs_filled_prefix() + f""",
n AS (SELECT series_id, max(idx) + 1 AS n_rows FROM filled GROUP BY 1),
ex AS (SELECT f.series_id, f.idx - o.off AS window_id, o.off, f.value, n.n_rows
       FROM filled f JOIN n USING (series_id) JOIN (SELECT range AS off FROM range(0, {_W13_WIN + _W13_H})) o ON true)
SELECT series_id, window_id, CASE WHEN off < {_W13_WIN} THEN 'x' ELSE 'y' END AS part,
  CAST(CASE WHEN off < {_W13_WIN} THEN off ELSE off - {_W13_WIN} END AS BIGINT) AS step, {rnd('value', 'value')}
FROM ex WHERE window_id >= 0 AND window_id + {_W13_WIN + _W13_H} <= n_rows""")
def w13_sliding_pairs(spark, sf):
    """Sliding windows (win 504, horizon 72) in exploded form."""
    f = bases.obs_filled(spark, sf).select("series_id", "idx", "value")
    return windows.sliding_pairs(f, ["value"], _W13_WIN, _W13_H, chunk=QUERY_CHUNK)


def _arrays_sql() -> str:
    w = "PARTITION BY series_id ORDER BY idx"
    parts = [f"{rnd(c, f'{c}_x_first')}, {rnd(f'lead({c}, {_W13_WIN - 1}) OVER ({w})', f'{c}_x_last')}, "
             f"{rnd(f'lead({c}, {_W13_WIN}) OVER ({w})', f'{c}_y_first')}, "
             f"{rnd(f'sum({c}) OVER ({w} ROWS BETWEEN {_W13_WIN} FOLLOWING AND {_W13_WIN + _W13_H - 1} FOLLOWING)', f'{c}_y_sum')}" for c in TARGETS]
    return _filled() + f""",
n AS (SELECT series_id, max(idx) + 1 AS n_rows FROM filled GROUP BY 1),
w AS (SELECT series_id, idx AS window_id, {', '.join(parts)} FROM filled)
SELECT w.*, {_W13_WIN} AS n_x, {_W13_H} AS n_y FROM w JOIN n USING (series_id) WHERE window_id + {_W13_WIN + _W13_H} <= n_rows"""


@register("w13_sliding_arrays", _arrays_sql())
def w13_sliding_arrays(spark, sf):
    """Sliding windows of both targets as array columns, one row per window;
    shown by their sizes, ends and sums."""
    w = windows.sliding_windows(bases.targets_filled(spark, sf), TARGETS, _W13_WIN, _W13_H, chunk=QUERY_CHUNK)
    total = lambda c: F.aggregate(F.col(f"y.{c}"), F.lit(0.0), lambda a, v: a + v)
    return w.select("series_id", "window_id", F.size("x").alias("n_x"), F.size("y").alias("n_y"),
                    *[e.alias(f"{c}_{n}") for c in TARGETS for n, e in {
                        "x_first": F.col(f"x.{c}")[0], "x_last": F.col(f"x.{c}")[_W13_WIN - 1], "y_first": F.col(f"y.{c}")[0], "y_sum": total(c)}.items()])


@register("w15_direct_lags", _filled(CLEAN_COLUMNS) + f"""
SELECT series_id, ts, idx, {', '.join(rnd(_lag(c, HORIZON - 1 + k), f"{c}_dlag_{k}") for c in CLEAN_COLUMNS for k in DIRECT_LAGS)}
FROM filled""")
def w15_direct_lags(spark, sf):
    """Direct-horizon lags (1,2,3,24,48 counted back from a 72-step chunk start)
    of the targets and every exogenous column."""
    f = bases.met_filled(spark, sf)
    return windows.direct_lags(f, CLEAN_COLUMNS, DIRECT_LAGS, HORIZON, chunk=QUERY_CHUNK).drop(*CLEAN_COLUMNS)


# ------------------------------------------------------------ split, blocks
_SPLIT = f""",
n AS (SELECT series_id, max(idx) + 1 AS n_rows FROM hourly GROUP BY 1),
sp AS (SELECT h.series_id, h.idx, h.ts, n.n_rows, n.n_rows - {TEST_SIZE} AS test_start FROM hourly h JOIN n USING (series_id))"""


@register("t1_split_blocks", O.obs_hourly_prefix() + _SPLIT + f"""
SELECT series_id, ts, idx, idx >= test_start AS is_test,
  CASE WHEN idx >= test_start AND floor((idx - test_start) / {HORIZON}) + 1 <= floor((n_rows - test_start) / {HORIZON})
       THEN CAST(floor((idx - test_start) / {HORIZON}) + 1 AS BIGINT) END AS block_id
FROM sp""")
def t1_split_blocks(spark, sf):
    """T1 (last 216 hours are test) + W14 (three 72-hour blocks)."""
    h = bases.obs_hourly(spark, sf).select("series_id", "ts", "idx")
    b = blocks.assign_blocks(blocks.train_test_split(h, TEST_SIZE), HORIZON)
    return b.select("series_id", "ts", "idx", "is_test", "block_id")


@register("j9_context_rows", O.obs_hourly_prefix() + _SPLIT + f""",
bl AS (SELECT DISTINCT series_id, test_start, n_rows, b FROM sp, range(0, 3) r(b)
       WHERE b < floor((n_rows - test_start) / {HORIZON})),
ctx AS (SELECT s.series_id, s.idx, CAST(bl.b + 1 AS BIGINT) AS ctx_block_id FROM sp s JOIN bl
        ON s.series_id = bl.series_id AND s.idx BETWEEN bl.test_start + bl.b * {HORIZON} - 50
        AND bl.test_start + bl.b * {HORIZON} - 1)
SELECT series_id, idx, ctx_block_id FROM ctx""")
def j9_context_rows(spark, sf):
    """Up to 50 rows before the first row of every test block."""
    h = bases.obs_hourly(spark, sf).select("series_id", "ts", "idx")
    b = blocks.assign_blocks(blocks.train_test_split(h, TEST_SIZE), HORIZON)
    return blocks.context_rows(b, 50, HORIZON).select("series_id", "idx", "ctx_block_id")


FOLD_W, FOLD_H, FOLD_S = 336, 72, 72


@register("j7_sliding_folds", O.obs_filled_prefix() + f""",
n AS (SELECT series_id, max(idx) + 1 AS n_rows FROM filled GROUP BY 1),
k AS (SELECT series_id, CAST(floor((n_rows - {FOLD_H + FOLD_W}) / {FOLD_S}) + 1 AS BIGINT) AS nk FROM n),
f AS (SELECT series_id, range AS fold_id FROM k, range(0, nk)),
rows_ AS (
  SELECT h.series_id, h.idx, f.fold_id, 'train' AS role, CAST(NULL AS BIGINT) AS step FROM filled h JOIN f
    ON h.series_id = f.series_id AND h.idx >= f.fold_id * {FOLD_S} AND h.idx < f.fold_id * {FOLD_S} + {FOLD_W}
  UNION ALL
  SELECT h.series_id, h.idx, f.fold_id, 'test', h.idx - (f.fold_id * {FOLD_S} + {FOLD_W}) + 1 FROM filled h JOIN f
    ON h.series_id = f.series_id AND h.idx >= f.fold_id * {FOLD_S} + {FOLD_W} AND h.idx < f.fold_id * {FOLD_S} + {FOLD_W + FOLD_H})
SELECT series_id, idx, fold_id, role, step FROM rows_""")
def j7_sliding_folds(spark, sf):
    """Sliding-window CV (w 336, h 72, s 72): row -> fold membership."""
    f = bases.obs_filled(spark, sf).select("series_id", "idx")
    return blocks.sliding_folds(f, FOLD_W, FOLD_H, FOLD_S).select("series_id", "idx", "fold_id", "role", "step")


# ------------------------------------------------------------ scaling
def _scaler_sql(cols) -> str:
    """CTE ``st`` (mean, std per series and column, train rows) + ``scaled``."""
    parts = []
    for c in cols:
        parts.append(f"avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}")
    sel = ", ".join(f"(f.{c} - st.m_{c}) / st.s_{c} AS {c}" for c in cols)
    return f""",
n AS (SELECT series_id, max(idx) + 1 AS n_rows FROM filled GROUP BY 1),
st AS (SELECT f.series_id, {', '.join(parts)} FROM filled f JOIN n USING (series_id)
       WHERE f.idx < n.n_rows - {TEST_SIZE} GROUP BY 1),
scaled AS (SELECT f.series_id, f.ts, f.idx, f.idx >= n.n_rows - {TEST_SIZE} AS is_test, {sel}
           FROM filled f JOIN st USING (series_id) JOIN n USING (series_id))"""


def scaled_targets(spark, sf, cols=TARGETS, inverse=False):
    f = bases.met_filled(spark, sf, list(cols)) if cols != TARGETS else bases.targets_filled(spark, sf)
    sp = blocks.train_test_split(f, TEST_SIZE)
    state = fit_scaler(sp.where(~F.col("is_test")), list(cols))
    out = apply_scaler(sp, state, list(cols))
    if inverse:
        out = apply_scaler(out, state, list(cols), inverse=True)
    return out.select("series_id", "ts", "idx", "is_test", *cols)


@register("p15_standard_scale", _filled() + _scaler_sql(TARGETS) +
          f"\nSELECT series_id, ts, idx, is_test, {_round_all(TARGETS)} FROM scaled")
def p15_standard_scale(spark, sf):
    """Standard scaling fitted on train rows only (population std)."""
    return scaled_targets(spark, sf)


@register("p16_inverse_scale", _filled() + f""",
n AS (SELECT series_id, max(idx) + 1 AS n_rows FROM filled GROUP BY 1)
SELECT f.series_id, f.ts, f.idx, f.idx >= n.n_rows - {TEST_SIZE} AS is_test, {_round_all(TARGETS)}
FROM filled f JOIN n USING (series_id)""")
def p16_inverse_scale(spark, sf):
    """Scale then inverse-scale: returns the original filled values."""
    return scaled_targets(spark, sf, inverse=True)


@register("m6_transform_pipelines", _filled(CLEAN_COLUMNS) + _scaler_sql(CLEAN_COLUMNS) +
          f"\nSELECT series_id, ts, idx, is_test, {_round_all(CLEAN_COLUMNS)} FROM scaled")
def m6_transform_pipelines(spark, sf):
    """Y pipeline (fill -> scale) and X pipeline (fill -> scale) routed by
    column group in one pass (model-based imputation left out)."""
    return scaled_targets(spark, sf, CLEAN_COLUMNS)


@register("p20_before_after", _filled(CLEAN_COLUMNS) + _scaler_sql(CLEAN_COLUMNS) + ",\norig AS (" + " UNION ALL ".join(
    f"SELECT series_id, ts, '{c}' AS col, {c} AS before FROM filled" for c in CLEAN_COLUMNS) + "),\nafter_ AS (" + " UNION ALL ".join(
    f"SELECT series_id, ts, is_test, '{c}' AS col, {c} AS after FROM scaled" for c in CLEAN_COLUMNS) + f""")
SELECT o.series_id, o.ts, o.col, a.is_test, {rnd('o.before', 'before')}, {rnd('a.after', 'after')}
FROM orig o JOIN after_ a ON a.series_id = o.series_id AND a.ts = o.ts AND a.col = o.col""")
def p20_before_after(spark, sf):
    """Original and transformed value of every column side by side."""
    before = to_long(bases.met_filled(spark, sf), CLEAN_COLUMNS, ["series_id", "ts"]).withColumnRenamed("value", "before")
    after = to_long(scaled_targets(spark, sf, CLEAN_COLUMNS), CLEAN_COLUMNS, ["series_id", "ts", "is_test"]).withColumnRenamed("value", "after")
    return before.join(after, ["series_id", "ts", "col"], "inner")


@register("p17_routed_pipelines", _filled(CLEAN_COLUMNS) + _scaler_sql(CLEAN_COLUMNS) +
          f"\nSELECT series_id, ts, idx, is_test, {_round_all(CLEAN_COLUMNS)} FROM scaled")
def p17_routed_pipelines(spark, sf):
    """The two transform pipelines built from steps: column groups routed to
    their own chains (fill, then scale), each fitted on the train rows."""
    sp = blocks.train_test_split(bases.met_hourly(spark, sf), TEST_SIZE)
    fill = pipeline.apply_only(lambda df, cols: windows.ffill(df, cols, chunk=QUERY_CHUNK))
    scale = pipeline.Step(lambda df, cols: fit_scaler(df, cols), lambda df, state, cols: apply_scaler(df, state, cols))
    filled = pipeline.route([(fill, TARGETS), (fill, EXOGENOUS)])
    scaled = pipeline.route([(pipeline.chain([scale]), TARGETS), (pipeline.chain([scale]), EXOGENOUS)])
    out = pipeline.fit_apply(pipeline.chain([filled, scaled]), sp, CLEAN_COLUMNS, ~F.col("is_test"))
    return out.select("series_id", "ts", "idx", "is_test", *CLEAN_COLUMNS)


_CAL = ["month", "hour", "hr_sin", "hr_cos"]


MODELLED = ["MWD_sin"]  # imputed by a model, so beyond SQL
_SQL_EXOG = [c for c in EXOGENOUS if c not in MODELLED]


def _grid(spark, sf):
    """The cleaned grid, written once, with its test rows marked."""
    return blocks.train_test_split(saved(bases.met_hourly(spark, sf), "grid"), TEST_SIZE)


def _saved_and_loaded(spark, fitted):
    """The pipeline as its saved files say."""
    from pyspark.ml import PipelineModel
    from .q_misc import scratch
    path = scratch(spark, "pipeline")
    fitted.write().save(path)
    return PipelineModel.load(path)


@register("m6_model_pipelines", _filled(CLEAN_COLUMNS) + _scaler_sql(_SQL_EXOG) + f"""
SELECT s.series_id, s.ts, s.idx, s.is_test, h.MWD_sin IS NULL AS was_missing, CASE WHEN h.MWD_sin IS NOT NULL THEN {rnd('h.MWD_sin', 'x').removesuffix(' AS x')} END AS MWD_sin,
  {', '.join(rnd('s.' + c, c) for c in _SQL_EXOG)}
FROM scaled s JOIN hourly h USING (series_id, idx)""")
def m6_model_pipelines(spark, sf):
    """The X pipeline whose groups take different steps: the wave direction's
    sine is imputed by its own model, the others are forward-filled, all are
    scaled, each fitted on the train rows. The modelled column comes back on its
    own scale where it was observed; where it was not, it must have a value."""
    from ..operators.transformers import exogenous_pipeline
    sp = _grid(spark, sf)
    fitted = exogenous_pipeline(EXOGENOUS, MODELLED, QUERY_CHUNK).fit(sp.where(~F.col("is_test")).drop("n_rows", "test_start", "is_test"))
    out = fitted.transform(sp)
    back = apply_scaler(out.select("series_id", "idx", *MODELLED), fitted.stages[-1].state, MODELLED, inverse=True)
    was = sp.select("series_id", "idx", F.col("MWD_sin").isNull().alias("was_missing"))
    value = F.when(F.col("MWD_sin").isNull(), F.raise_error(F.lit("a gap was not imputed")).cast("double")).when(~F.col("was_missing"), F.col("MWD_sin"))
    both = out.drop(*MODELLED).join(back, ["series_id", "idx"]).join(was, ["series_id", "idx"])
    return both.select("series_id", "ts", "idx", "is_test", "was_missing", value.alias("MWD_sin"), *_SQL_EXOG)


def _m7_sql() -> str:
    x_sql, x_names = _summary_sql("scaled", _SQL_EXOG, [1], LAGGED_MEANS, [], True, keep="series_id, ts, idx, is_test", name="xf")
    y_sql, y_names = _summary_sql("yd", TARGETS, TARGET_LAGS, LAGGED_MEANS, [], True, keep="series_id, idx", name="yf")
    cal = ("CAST(month(ts) AS DOUBLE) AS month, CAST(hour(ts) AS DOUBLE) AS hour, "
           "sin(2 * pi() * hour(ts) / 24.0) AS hr_sin, cos(2 * pi() * hour(ts) / 24.0) AS hr_cos")
    names = [*_CAL, *x_names]
    st = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in names)
    diff = ", ".join(f"CASE WHEN idx < 24 THEN 0 ELSE {c} - {_lag(c, 24)} END AS {c}" for c in TARGETS)
    return _filled(CLEAN_COLUMNS) + _scaler_sql([*_SQL_EXOG, *TARGETS]) + f""",
{x_sql},
xc AS (SELECT *, {cal} FROM xf),
xst AS (SELECT series_id, {st} FROM xc WHERE NOT is_test GROUP BY 1),
yd AS (SELECT series_id, idx, {diff} FROM scaled),
{y_sql}
SELECT xc.series_id, xc.ts, xc.idx, xc.is_test, {', '.join(rnd(f'(xc.{c} - xst.m_{c}) / xst.s_{c}', c) for c in names)},
  {', '.join(rnd('yd.' + c, c) for c in TARGETS)}, {', '.join(rnd('yf.' + c, c) for c in y_names)}
FROM xc JOIN xst USING (series_id) JOIN yd USING (series_id, idx) JOIN yf USING (series_id, idx)"""


@register("m7_transform_set", _m7_sql())
def m7_transform_set(spark, sf):
    """All five transforms fitted in order on the train rows, saved, loaded and
    applied to train and test rows: scaled exogenous columns (one imputed by a
    model), their calendar and lag features scaled again, and the differenced
    targets with their lags. The modelled column's features are left out of the
    rows, as SQL has none to compare."""
    from ..operators.transformers import transform_set
    sp = _grid(spark, sf)
    train = sp.where(~F.col("is_test"))
    pipes = transform_set(EXOGENOUS, TARGETS, MODELLED, 24, QUERY_CHUNK)
    x_cols, y_cols = ["series_id", "ts", "idx", *EXOGENOUS], ["series_id", "idx", *TARGETS]
    x = _saved_and_loaded(spark, pipes["x"].fit(train.select(*x_cols))).transform(sp.select(*x_cols, "is_test"))
    y = _saved_and_loaded(spark, pipes["y"].fit(train.select(*y_cols))).transform(sp.select(*y_cols))
    out = x.join(y, ["series_id", "idx"])
    return out.drop(*[c for c in out.columns if c.startswith("MWD_sin")])

def _w6_sql() -> str:
    feat_sql, names = _summary_sql("xs", EXOGENOUS, [1], LAGGED_MEANS, [], True, keep="series_id, ts, idx, is_test")
    allf = _CAL + names
    cal = (f"CAST(month(ts) AS DOUBLE) AS month, CAST(hour(ts) AS DOUBLE) AS hour, "
           f"sin(2 * pi() * hour(ts) / 24.0) AS hr_sin, cos(2 * pi() * hour(ts) / 24.0) AS hr_cos")
    st = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
                   for c in allf)
    return _filled(CLEAN_COLUMNS) + _scaler_sql(EXOGENOUS).replace("scaled AS", "xs AS") + ",\n" + feat_sql + f""",
fc AS (SELECT *, {cal} FROM feat),
fst AS (SELECT series_id, {st} FROM fc WHERE NOT is_test GROUP BY 1)
SELECT fc.series_id, fc.ts, fc.idx, {', '.join(rnd(f'(fc.{c} - fst.m_{c}) / fst.s_{c}', c) for c in allf)}
FROM fc JOIN fst USING (series_id)"""


@register("w6_feature_union", _w6_sql())
def w6_feature_union(spark, sf):
    """Feature pipeline: calendar columns next to exogenous lag features,
    then a standard scaler fitted on the train rows."""
    x = scaled_targets(spark, sf, CLEAN_COLUMNS).select("series_id", "ts", "idx", "is_test", *EXOGENOUS)
    feats = windows.window_summary(x, EXOGENOUS, lag=[1], mean=LAGGED_MEANS, replace=True, chunk=QUERY_CHUNK)
    feats = clean.add_calendar(feats).withColumns({"month": F.col("month").cast("double"),
                                                   "hour": F.col("hour").cast("double")})
    names = [c for c in feats.columns if c not in ("series_id", "ts", "idx", "is_test")]
    state = fit_scaler(feats.where(~F.col("is_test")), names)
    return apply_scaler(feats, state, names).select("series_id", "ts", "idx", *names)


# ------------------------------------------------------------ row sets
@register("j3_concat_xy", O.met_hourly_prefix() + f""",
xs AS (SELECT series_id, ts, {', '.join(EXOGENOUS)} FROM hourly),
ys AS (SELECT series_id, ts, {', '.join(TARGETS)} FROM hourly)
SELECT coalesce(xs.series_id, ys.series_id) AS series_id, coalesce(xs.ts, ys.ts) AS ts,
  {', '.join(rnd(f'xs.{c}', c) for c in EXOGENOUS)}, {', '.join(rnd(f'ys.{c}', c) for c in TARGETS)}
FROM xs FULL OUTER JOIN ys ON xs.series_id = ys.series_id AND xs.ts = ys.ts""")
def j3_concat_xy(spark, sf):
    """Column-wise concat of X and y on the time key (full outer join)."""
    h = bases.met_hourly(spark, sf)
    x = h.select("series_id", "ts", *EXOGENOUS)
    y = h.select("series_id", "ts", *TARGETS)
    return x.join(y, ["series_id", "ts"], "full_outer")


@register("j4_union_sorted", O.obs_hourly_prefix() + f"""
SELECT series_id, ts, idx, {rnd('value', 'value')} FROM hourly ORDER BY series_id, ts""")
def j4_union_sorted(spark, sf):
    """Train and test rows concatenated back (no dedupe) and sorted by time
    at the sink (T2)."""
    h = blocks.train_test_split(bases.obs_hourly(spark, sf), TEST_SIZE)
    train = h.where(~F.col("is_test")).select("series_id", "ts", "idx", "value")
    test = h.where(F.col("is_test")).select("series_id", "ts", "idx", "value")
    return train.unionByName(test).orderBy("series_id", "ts")


@register("t3_head", O.obs_hourly_prefix() + f"""
SELECT series_id, ts, idx, {rnd('value', 'value')} FROM hourly
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts) <= 5""")
def t3_head(spark, sf):
    """First five rows of every series."""
    from ..operators.seasonal import head
    return head(bases.obs_hourly(spark, sf), 5)


def _m18_sql(p: int = 24) -> str:
    h = p // 2
    parts = []
    for c in TARGETS:
        fr_in = f"({P} ROWS BETWEEN {h - 1} PRECEDING AND {h - 1} FOLLOWING)"
        fr = f"({P} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
        parts.append(f"CASE WHEN count({c}) OVER {fr} = {2 * h + 1} THEN (sum({c}) OVER {fr_in} + 0.5 * "
                     f"(lag({c}, {h}) OVER ({P}) + lead({c}, {h}) OVER ({P}))) / {float(p)} END AS tr_{c}")
    ph = " UNION ALL ".join(
        f"SELECT series_id, ph, '{c}' AS col, avg({c} - tr_{c}) AS raw FROM tr GROUP BY 1, 2" for c in TARGETS)
    sel = ", ".join(rnd(f"tr.{c} - (SELECT s FROM seas WHERE seas.series_id = tr.series_id AND seas.ph = tr.ph "
                        f"AND seas.col = '{c}')", c) for c in TARGETS)
    return _filled() + f""",
tr AS (SELECT series_id, ts, idx, idx % {p} AS ph, {', '.join(TARGETS)}, {', '.join(parts)} FROM filled),
raw AS ({ph}),
seas AS (SELECT series_id, ph, col, raw - avg(raw) OVER (PARTITION BY series_id, col) AS s FROM raw)
SELECT series_id, ts, idx, {sel} FROM tr"""


@register("m18_deseasonalize", _m18_sql())
def m18_deseasonalize(spark, sf):
    """Additive seasonal adjustment, period 24 (inactive in the reference's
    pipelines, available as an operator)."""
    from ..operators.seasonal import deseasonalize
    f = bases.targets_filled(spark, sf).select("series_id", "ts", "idx", *TARGETS)
    return deseasonalize(f, TARGETS, 24, chunk=QUERY_CHUNK)
