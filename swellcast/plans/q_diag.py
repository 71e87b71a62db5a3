"""Registered queries: series diagnostics (ACF, seasonality, White test, PACF)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CF_HIGH, CF_LOW, CLEAN_COLUMNS, TARGETS, Z_975
from ..operators import diagnostics as D
from ..operators.scaling import apply_scaler, fit_scaler, normalise_by_max, to_long
from . import bases
from .oracles import rnd
from .q_windows import _filled
from .queries import register

MAX_LAG = 72
PLOT_LAG, DIFF_LAG = 80, 24
PK = "PARTITION BY series_id, col ORDER BY idx"


def scaled_long(spark, sf):
    """Every cleaned column, filled and z-scored over the whole series, in
    long form ``(series_id, col, idx, value)``."""
    f = bases.met_filled(spark, sf)
    st = fit_scaler(f, CLEAN_COLUMNS)
    return to_long(apply_scaler(f, st, CLEAN_COLUMNS), CLEAN_COLUMNS, ["series_id", "idx"])


def _long_sql() -> str:
    lng = " UNION ALL ".join(f"SELECT series_id, '{c}' AS col, idx, {c} AS value FROM filled" for c in CLEAN_COLUMNS)
    return _filled(CLEAN_COLUMNS) + f""",
lng AS ({lng}),
mz AS (SELECT series_id, col, avg(value) AS m,
       CASE WHEN coalesce(stddev_pop(value), 0) = 0 THEN 1 ELSE stddev_pop(value) END AS s FROM lng GROUP BY 1, 2),
z AS (SELECT l.series_id, l.col, l.idx, (l.value - mz.m) / mz.s AS value FROM lng l JOIN mz USING (series_id, col))"""


def _acf_sql(k: int = MAX_LAG) -> str:
    lags = ", ".join(f"lag(d, {i}) OVER ({PK}) AS l{i}" for i in range(1, k + 1))
    sums = ", ".join(f"sum(d * l{i}) AS c{i}" for i in range(1, k + 1))
    r = ", ".join(["1.0"] + [f"c{i} / c0" for i in range(1, k + 1)])
    return _long_sql() + f""",
mom AS (SELECT series_id, col, count(value) AS n, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM z GROUP BY 1, 2),
dv AS (SELECT z.series_id, z.col, z.idx, z.value - mom.m AS d FROM z JOIN mom USING (series_id, col)),
lg AS (SELECT series_id, col, d, {lags} FROM dv),
sm AS (SELECT series_id, col, sum(d * d) AS c0, {sums} FROM lg GROUP BY 1, 2),
acf AS (SELECT sm.series_id, sm.col, mom.n, mom.lo = mom.hi AS is_constant,
        CASE WHEN mom.lo <> mom.hi THEN list_value({r}) END AS r FROM sm JOIN mom USING (series_id, col))"""


@register("d6_acf", _acf_sql() + f"""
SELECT series_id, col, CAST(g.k AS BIGINT) AS lag, {rnd('r[g.k + 1]', 'r')} FROM acf, range(0, {MAX_LAG + 1}) g(k)""")
def d6_acf(spark, sf):
    """Biased ACF, lags 0..72, of every z-scored column (long form)."""
    a = D.acf(scaled_long(spark, sf), MAX_LAG, chunk=bases.QUERY_CHUNK)
    return a.select("series_id", "col", F.posexplode("r").alias("lag", "r")) \
        .withColumn("lag", F.col("lag").cast("long"))


_CANDS = f"list_filter(range(1, {MAX_LAG}), lambda k: r[k + 1] > r[k] AND r[k + 1] > r[k + 2])"


@register("d8_acf_maxima", _acf_sql() + f"""
SELECT series_id, col, CAST(unnest({_CANDS}) AS BIGINT) AS lag FROM acf WHERE r IS NOT NULL""")
def d8_acf_maxima(spark, sf):
    """Local maxima of the ACF (strict, ends excluded)."""
    a = D.acf(scaled_long(spark, sf), MAX_LAG, chunk=bases.QUERY_CHUNK)
    return a.where(F.col("r").isNotNull()).select("series_id", "col", F.explode(D.local_maxima(F.col("r"))).alias("lag")) \
        .withColumn("lag", F.col("lag").cast("long"))


def _seas_sql() -> str:
    r1 = f"list_slice(r, 2, {MAX_LAG + 1})"
    bart = (f"CASE WHEN c - 1 = 1 THEN sqrt(1.0 / n) ELSE sqrt((1 + 2 * coalesce(list_sum(list_transform("
            f"list_slice({r1}, 1, c - 2), lambda x: x * x)), 0)) / n) END")
    return _acf_sql() + f""",
sa AS (SELECT *, {_CANDS} AS cands,
       list_avg({r1}) + {Z_975} * list_var_pop({r1}) AS band FROM acf WHERE r IS NOT NULL),
sb AS (SELECT *, list_filter(cands, lambda c: r[c + 1] > ({bart}) * band) AS ok FROM sa)"""


@register("d9_bartlett_band", _seas_sql() + f""",
ex AS (SELECT series_id, col, n, r, band, unnest(cands) AS c FROM sb)
SELECT series_id, col, CAST(c AS BIGINT) AS lag, {rnd('r[c + 1]', 'r')},
  {rnd(f"CASE WHEN c - 1 = 1 THEN sqrt(1.0 / n) ELSE sqrt((1 + 2 * coalesce(list_sum(list_transform(list_slice(list_slice(r, 2, {MAX_LAG + 1}), 1, c - 2), lambda x: x * x)), 0)) / n) END", 'bartlett_se')},
  {rnd('band', 'band')} FROM ex""")
def d9_bartlett_band(spark, sf):
    """Bartlett standard error and significance band at every ACF candidate."""
    a = D.acf(scaled_long(spark, sf), MAX_LAG, chunk=bases.QUERY_CHUNK).where(F.col("r").isNotNull())
    r = F.col("r")
    r1 = F.slice(r, 2, F.size(r) - 1)
    k = F.size(r1).cast("double")
    mean1 = F.aggregate(r1, F.lit(0.0), lambda acc, x: acc + x) / k
    var1 = F.aggregate(r1, F.lit(0.0), lambda acc, x: acc + (x - mean1) * (x - mean1)) / k
    x = a.select("series_id", "col", "n", "r", (mean1 + F.lit(Z_975) * var1).alias("band"),
                 F.explode(D.local_maxima(r)).alias("c"))
    return x.select("series_id", "col", F.col("c").cast("long").alias("lag"), F.element_at("r", F.col("c") + 1).alias("r"),
                    D.bartlett_se(F.slice(F.col("r"), 2, F.size("r") - 1), F.col("c") - 1, F.col("n").cast("double"))
                    .alias("bartlett_se"), "band")


def _seasonal_ctes() -> str:
    return _acf_sql() + f""",
sa AS (SELECT *, CASE WHEN r IS NOT NULL THEN {_CANDS} END AS cands,
       list_avg(list_slice(r, 2, {MAX_LAG + 1})) + {Z_975} * list_var_pop(list_slice(r, 2, {MAX_LAG + 1})) AS band FROM acf),
sb AS (SELECT *, list_filter(cands, lambda c: r[c + 1] > (CASE WHEN c - 1 = 1 THEN sqrt(1.0 / n) ELSE sqrt((1 + 2 * coalesce(list_sum(
       list_transform(list_slice(list_slice(r, 2, {MAX_LAG + 1}), 1, c - 2), lambda x: x * x)), 0)) / n) END) * band) AS ok FROM sa)"""


@register("d10_seasonality", _seasonal_ctes() + """
SELECT series_id, col, n, is_constant,
  CASE WHEN is_constant OR len(cands) = 0 THEN false ELSE list_min(ok) IS NOT NULL END AS seasonal,
  CAST(CASE WHEN is_constant OR len(cands) = 0 THEN 0 ELSE coalesce(list_min(ok), 0) END AS BIGINT) AS seasonal_period,
  CAST(coalesce(len(cands), 0) AS BIGINT) AS n_candidates, CAST(list_min(cands) AS BIGINT) AS first_candidate
FROM sb""")
def d10_seasonality(spark, sf):
    """Seasonality check (max lag 72, 5 %) of every z-scored column; includes
    the constant test (A12), candidate membership (J10) and the first
    admissible candidate (T6)."""
    return D.seasonality(D.acf(scaled_long(spark, sf), MAX_LAG, chunk=bases.QUERY_CHUNK))


USER_PERIODS = (24, 17, 2)

_USER_SQL = " UNION ALL ".join(f"""
SELECT series_id, col, CAST({p} AS BIGINT) AS asked, n, is_constant,
  CASE WHEN is_constant OR len(cands) = 0 OR NOT list_contains(cands, {p}) THEN false ELSE list_contains(ok, {p}) END AS seasonal,
  CAST(CASE WHEN is_constant OR len(cands) = 0 THEN 0 WHEN NOT list_contains(cands, {p}) THEN {p}
       WHEN list_contains(ok, {p}) THEN {p} ELSE 0 END AS BIGINT) AS seasonal_period FROM sb""" for p in USER_PERIODS)


@register("d10_user_period", _seasonal_ctes() + _USER_SQL)
def d10_user_period(spark, sf):
    """Seasonality check of periods that the user asks for, members and
    non-members of the candidates (J10)."""
    a = D.acf(scaled_long(spark, sf), MAX_LAG, chunk=bases.QUERY_CHUNK)
    parts = [D.seasonality(a, p).select("series_id", "col", F.lit(p).cast("long").alias("asked"), "n", "is_constant",
                                        "seasonal", "seasonal_period") for p in USER_PERIODS]
    return reduce(DataFrame.unionByName, parts)


@register("d5_white_test", _long_sql() + f""",
p1 AS (SELECT series_id, col, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a, count(value) AS n,
       avg(idx) AS tm FROM z GROUP BY 1, 2),
p2 AS (SELECT z.series_id, z.col, p1.n, corr(power(z.value - (p1.a + p1.b * z.idx), 2), z.idx - p1.tm) AS r1,
       corr(power(z.value - (p1.a + p1.b * z.idx), 2), (z.idx - p1.tm) * (z.idx - p1.tm)) AS r2
       FROM z JOIN p1 USING (series_id, col) GROUP BY 1, 2, 3),
p3 AS (SELECT *, power(coalesce(r1, 0), 2) + power(coalesce(r2, 0), 2) AS rsq FROM p2)
SELECT series_id, col, n, (exp(-n * rsq / 2) < 0.05 AND power(1 - rsq, (n - 3) / 2.0) < 0.05) AS heteroscedastic,
  {rnd('n * rsq', 'lm_statistic')}, {rnd('exp(-n * rsq / 2)', 'lm_p_value')}, {rnd('power(1 - rsq, (n - 3) / 2.0)', 'f_p_value')}
FROM p3""")
def d5_white_test(spark, sf):
    """White heteroscedasticity test of every z-scored column."""
    return D.white_test(scaled_long(spark, sf))


@register("d7_pacf")
def d7_pacf(spark, sf):
    """Partial autocorrelation to lag 80 (Durbin-Levinson on the ACF)."""
    p = D.pacf(D.acf(scaled_long(spark, sf), PLOT_LAG, chunk=bases.QUERY_CHUNK).where(F.col("r").isNotNull()))
    return p.select("series_id", "col", F.posexplode("pacf").alias("lag", "pacf")).withColumn("lag", F.col("lag").cast("long"))


def diffed_long(spark, sf):
    """The z-scored targets after the lag-24 difference (W11), in long form."""
    from ..operators.windows import seasonal_diff
    f = bases.targets_filled(spark, sf)
    x = apply_scaler(f, fit_scaler(f, TARGETS), TARGETS)
    d = seasonal_diff(x, TARGETS, DIFF_LAG, chunk=bases.QUERY_CHUNK).where(F.col("idx") >= DIFF_LAG)
    return to_long(d, TARGETS, ["series_id", "idx"])


def _diffed_acf_sql() -> str:
    held = ", ".join(f"'{c}'" for c in TARGETS)
    return _acf_sql(PLOT_LAG).replace("mom AS (SELECT series_id, col, count(value)", f"""zd AS (SELECT series_id, col, idx, value - lag(value, {DIFF_LAG}) OVER ({PK}) AS value FROM z WHERE col IN ({held})),
mom AS (SELECT series_id, col, count(value)""").replace("max(value) AS hi FROM z GROUP", f"max(value) AS hi FROM zd WHERE idx >= {DIFF_LAG} GROUP") \
        .replace("z.value - mom.m AS d FROM z JOIN mom USING (series_id, col)", f"z.value - mom.m AS d FROM zd z JOIN mom USING (series_id, col) WHERE idx >= {DIFF_LAG}")


@register("d6_acf_diffed", _diffed_acf_sql() + f"""
SELECT series_id, col, CAST(g.k AS BIGINT) AS lag, {rnd('r[g.k + 1]', 'r')} FROM acf, range(0, {PLOT_LAG + 1}) g(k)""")
def d6_acf_diffed(spark, sf):
    """Biased ACF to lag 80 of the 24-differenced, z-scored targets."""
    a = D.acf(diffed_long(spark, sf), PLOT_LAG, chunk=bases.QUERY_CHUNK)
    return a.select("series_id", "col", F.posexplode("r").alias("lag", "r")).withColumn("lag", F.col("lag").cast("long"))


@register("d7_pacf_diffed")
def d7_pacf_diffed(spark, sf):
    """Partial autocorrelation to lag 80 of the 24-differenced targets. Held
    against a direct solve of the Yule-Walker equations by the tests."""
    p = D.pacf(D.acf(diffed_long(spark, sf), PLOT_LAG, chunk=bases.QUERY_CHUNK).where(F.col("r").isNotNull()))
    return p.select("series_id", "col", F.posexplode("pacf").alias("lag", "pacf")).withColumn("lag", F.col("lag").cast("long"))


@register("d1_adf")
def d1_adf(spark, sf):
    """Augmented Dickey-Fuller (constant, AIC lag choice up to 50) of every
    z-scored column; stationary when p < 0.05."""
    from ..operators.adf import adf
    return adf(scaled_long(spark, sf), maxlag=50, regression="c")


# ------------------------------------------------------------ Mann-Kendall
def filled_long(spark, sf):
    """Every cleaned column, filled, long form (trend tests are invariant to
    the positive scaling the reference applies first)."""
    return to_long(bases.met_filled(spark, sf), CLEAN_COLUMNS, ["series_id", "idx"])


def _filled_long_sql() -> str:
    lng = " UNION ALL ".join(f"SELECT series_id, '{c}' AS col, idx, {c} AS value FROM filled" for c in CLEAN_COLUMNS)
    return _filled(CLEAN_COLUMNS) + f",\nlng AS ({lng})"


def _mk_sql(src: str, part: str = "") -> str:
    """S, tie-corrected variance and z over CTE ``src(series_id, col[, phase], idx, value)``."""
    pk = "series_id, col" + (", " + part if part else "")
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in pk.split(","))
    return f""",
pr AS (SELECT {', '.join('a.' + k.strip() for k in pk.split(','))}, sum(sign(b.value - a.value)) AS s
       FROM {src} a JOIN {src} b ON {on} AND a.idx < b.idx GROUP BY ALL),
tg AS (SELECT {pk}, value, count(*) AS t FROM {src} GROUP BY ALL),
tv AS (SELECT {pk}, sum(t * (t - 1) * (2 * t + 5)) AS tv FROM tg GROUP BY ALL),
nn AS (SELECT {pk}, count(*) AS n FROM {src} GROUP BY ALL),
mk0 AS (SELECT nn.*, coalesce(pr.s, 0) AS s, (n * (n - 1) * (2 * n + 5) - tv.tv) / 18.0 AS var_s
        FROM nn LEFT JOIN pr USING ({pk}) JOIN tv USING ({pk}))"""


_MK_OUT = f"""SELECT series_id, col, n, CAST(s AS BIGINT) AS s, {rnd('var_s', 'var_s')},
  {rnd('CASE WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s) ELSE 0 END', 'z')} FROM mk"""


@register("d2_mann_kendall", _filled_long_sql() + _mk_sql("lng") + ",\nmk AS (SELECT * FROM mk0)\n" + _MK_OUT)
def d2_mann_kendall(spark, sf):
    """Mann-Kendall S, tie-corrected variance and z of every filled column."""
    from ..operators.trend import mk_score, z_score
    m = mk_score(filled_long(spark, sf), min_side=64)
    return m.select("series_id", "col", "n", "s", "var_s", z_score(F.col("s"), F.col("var_s")).alias("z"))


_PW_SQL = """,
mm AS (SELECT series_id, col, avg(value) AS m FROM lng GROUP BY 1, 2),
dv AS (SELECT l.*, l.value - mm.m AS d FROM lng l JOIN mm USING (series_id, col)),
r1t AS (SELECT series_id, col, sum(d * dl) / sum(d * d) AS r1 FROM
        (SELECT series_id, col, d, lag(d) OVER (PARTITION BY series_id, col ORDER BY idx) AS dl FROM dv) GROUP BY 1, 2),
pw AS (SELECT l.series_id, l.col, l.idx, ROUND(l.value - p.value * r.r1, 12) AS value FROM lng l
       JOIN lng p ON p.series_id = l.series_id AND p.col = l.col AND p.idx = l.idx - 1
       JOIN r1t r ON r.series_id = l.series_id AND r.col = l.col)"""


@register("d3_prewhitened_mk", _filled_long_sql() + _PW_SQL + _mk_sql("pw") + ",\nmk AS (SELECT * FROM mk0)\n" + _MK_OUT)
def d3_prewhitened_mk(spark, sf):
    """Mann-Kendall on the pre-whitened series y_t - r1 * y_{t-1}."""
    from ..operators.trend import mk_score, prewhiten, z_score
    lng = filled_long(spark, sf)
    r1 = D.acf(lng, 1, chunk=bases.QUERY_CHUNK).select("series_id", "col", F.element_at("r", 2).alias("r1"))
    m = mk_score(prewhiten(lng, r1), min_side=64)
    return m.select("series_id", "col", "n", "s", "var_s", z_score(F.col("s"), F.col("var_s")).alias("z"))


@register("d4_seasonal_mk", _filled_long_sql() + """,
sl AS (SELECT series_id, col, CAST(idx % 24 AS VARCHAR) AS phase, idx // 24 AS idx, value FROM lng)"""
          + _mk_sql("sl", "phase") + """,
mk AS (SELECT series_id, col, sum(n) AS n, sum(s) AS s, sum(var_s) AS var_s FROM mk0 GROUP BY 1, 2)
""" + _MK_OUT)
def d4_seasonal_mk(spark, sf):
    """Seasonal Mann-Kendall, period 24: S and variance summed over phases."""
    from ..operators.trend import seasonal_mann_kendall
    m = seasonal_mann_kendall(filled_long(spark, sf), 24)
    return m.select("series_id", "col", F.col("n").cast("long"), F.col("s").cast("long"), "var_s", "z")


@register("d2_trend_test")
def d2_trend_test(spark, sf):
    """S, z, two-sided normal p and the trend flag (p < 0.05) of every filled column."""
    from ..operators.trend import mann_kendall
    return mann_kendall(filled_long(spark, sf))


@register("d11_hp_filter")
def d11_hp_filter(spark, sf):
    """Hodrick-Prescott trend and cycle (lambda 1600) of every filled column
    after normalising by the series maximum (P12)."""
    from ..operators.filters import hp_filter
    lng = filled_long(spark, sf)
    mx = lng.groupBy("series_id", "col").agg(F.max("value").alias("_mx"))
    norm = lng.join(mx, ["series_id", "col"]).select(
        "series_id", "col", "idx", (F.col("value") / F.nullif(F.col("_mx"), F.lit(0.0))).alias("value"))
    return hp_filter(norm.where(F.col("value").isNotNull()), chunk=bases.QUERY_CHUNK)


@register("m19_poly_detrend")
def m19_poly_detrend(spark, sf):
    """Degree-4 polynomial detrending of every filled column (inactive in the
    reference's pipelines, available as an operator)."""
    from ..operators.seasonal import poly_detrend
    return poly_detrend(filled_long(spark, sf), degree=4)


@register("m5_model_impute")
def m5_model_impute(spark, sf):
    """Model-based imputation of the wave direction's sine and cosine: d by ADF, ARMA(p<=3, q<=3) by AIC, gaps filled with
    one-step predictions. Returns the imputed points only."""
    from ..operators.impute import impute_arma
    cols = ["MWD_sin", "MWD_cos"]
    raw = to_long(bases.met_hourly(spark, sf).select("series_id", "idx", *cols), cols, ["series_id", "idx"])
    filled = to_long(bases.met_filled(spark, sf).select("series_id", "idx", *cols), cols, ["series_id", "idx"])
    out = impute_arma(raw, filled, chunk=bases.QUERY_CHUNK)
    return out.where(F.col("imputed")).select("series_id", "col", "idx", "value")


_SLOPE_SQL = """
sl AS (SELECT a.series_id, a.col, median((b.value - a.value) / (b.idx - a.idx)) AS slope
       FROM lng a JOIN lng b ON a.series_id = b.series_id AND a.col = b.col AND a.idx < b.idx GROUP BY 1, 2)"""


@register("d2_sen_slope", _filled_long_sql() + f""",{_SLOPE_SQL}
SELECT series_id, col, {rnd('slope', 'slope')}, CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction
FROM sl""")
def d2_sen_slope(spark, sf):
    """Sen's slope (median pairwise slope) and the trend direction it sets,
    for every filled column; no pair is ever materialised as a row."""
    from ..operators.trend import sen_slope
    s = sen_slope(filled_long(spark, sf))
    return s.select("series_id", "col", "slope",
                    F.when(F.col("slope") > 0, "increasing").otherwise("decreasing").alias("direction"))


def _check_sql(test: str, slope: str) -> str:
    z = "CASE WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s) ELSE 0 END"
    return f"""
SELECT mk.series_id, mk.col, {test} AS test, CAST(mk.n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, {rnd('var_s', 'var_s')}, {rnd(z, 'z')},
  abs({z}) > {Z_975} AS trend, CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, {rnd('slope', 'slope')}
FROM mk JOIN {slope} USING (series_id, col)"""


def _check(spark, sf, **how):
    from ..operators.trend import check_trend
    return check_trend(filled_long(spark, sf), **how).select("series_id", "col", "test", F.col("n").cast("long"), F.col("s").cast("long"),
                                                             "var_s", "z", "trend", "direction", "slope")


@register("d2_check_trend", _filled_long_sql() + _PW_SQL + f""",
cnt AS (SELECT series_id, col, count(*) AS rows_all FROM lng GROUP BY 1, 2),
src AS (SELECT l.* FROM lng l JOIN cnt USING (series_id, col) WHERE rows_all >= 50
        UNION ALL SELECT p.* FROM pw p JOIN cnt USING (series_id, col) WHERE rows_all < 50),{_SLOPE_SQL}""" + _mk_sql("src")
          + ",\nmk AS (SELECT * FROM mk0 JOIN cnt USING (series_id, col))" + _check_sql("CASE WHEN rows_all < 50 THEN 'pre-whitened' ELSE 'original' END", "sl"))
def d2_check_trend(spark, sf):
    """The trend check as one row per series and column: the test that the
    length asks for, S, its variance, z, significance at 5 %, Sen's slope and
    direction."""
    return _check(spark, sf)


@register("d4_check_trend", _filled_long_sql() + """,
sl0 AS (SELECT series_id, col, CAST(idx % 24 AS VARCHAR) AS phase, idx // 24 AS idx, value FROM lng),
ss AS (SELECT a.series_id, a.col, median((b.value - a.value) / (b.idx - a.idx)) AS slope FROM sl0 a JOIN sl0 b
       ON a.series_id = b.series_id AND a.col = b.col AND a.phase = b.phase AND a.idx < b.idx GROUP BY 1, 2)""" + _mk_sql("sl0", "phase") + """,
mk AS (SELECT series_id, col, sum(n) AS n, sum(s) AS s, sum(var_s) AS var_s FROM mk0 GROUP BY 1, 2)""" + _check_sql("'seasonal'", "ss"))
def d4_check_trend(spark, sf):
    """The seasonal trend check, period 24, in one row: S and variance over the
    phases, and the median of the slopes between days at the same hour."""
    return _check(spark, sf, period=24)


def _normalised_long(spark, sf):
    """Every cleaned column, filled and divided by its maximum (P12), long."""
    norm = to_long(normalise_by_max(bases.met_filled(spark, sf), CLEAN_COLUMNS), CLEAN_COLUMNS, ["series_id", "idx"])
    return norm.where(F.col("value").isNotNull())


@register("d12_cf_cycle", _filled_long_sql() + f""",
mx AS (SELECT series_id, col, max(value) AS m FROM lng GROUP BY 1, 2),
nl AS (SELECT l.series_id, l.col, l.idx, l.value / m AS value FROM lng l JOIN mx USING (series_id, col) WHERE m <> 0),
e AS (SELECT series_id, col, count(*) AS n, arg_min(value, idx) AS x0, arg_max(value, idx) AS x1 FROM nl GROUP BY 1, 2),
f AS (SELECT nl.*, e.n, e.x0, value - idx * (e.x1 - e.x0) / (e.n - 1) AS x FROM nl JOIN e USING (series_id, col)),
b AS (SELECT range AS j, CASE WHEN range = 0 THEN 2.0 / {CF_LOW} - 2.0 / {CF_HIGH}
      ELSE (sin(2 * pi() * range / {CF_LOW}) - sin(2 * pi() * range / {CF_HIGH})) / (pi() * range) END AS w FROM range(0, 2000)),
ew AS (SELECT j, 0.5 * (2.0 / {CF_LOW} - 2.0 / {CF_HIGH}) - sum(w) OVER (ORDER BY j) AS w FROM b),
s AS (SELECT y.series_id, y.col, y.idx, sum(b.w * t.x) AS inner_sum FROM f y JOIN f t ON t.series_id = y.series_id AND t.col = y.col
      AND t.idx > 0 AND t.idx < t.n - 1 JOIN b ON b.j = abs(t.idx - y.idx) GROUP BY 1, 2, 3)
SELECT f.series_id, f.col, f.idx, {rnd('f.value', 'value')},
  {rnd(f"s.inner_sum + (l.w + r.w) * f.x0 + CASE WHEN f.idx IN (0, f.n - 1) THEN (2.0 / {CF_LOW} - 2.0 / {CF_HIGH}) * f.x ELSE 0 END", 'cycle')}
FROM f JOIN s USING (series_id, col, idx) JOIN ew l ON l.j = greatest(f.idx - 1, 0) JOIN ew r ON r.j = greatest(f.n - 2 - f.idx, 0)""")
def d12_cf_cycle(spark, sf):
    """Christiano-Fitzgerald cycle of every normalised column, with chunks of
    a week so that every series crosses chunk borders."""
    from ..operators.cf import cf_cycle
    return cf_cycle(_normalised_long(spark, sf), chunk=168)


@register("d13_feature_matrix")
def d13_feature_matrix(spark, sf):
    """Normalised value, Hodrick-Prescott trend and Christiano-Fitzgerald cycle."""
    from ..operators.cf import feature_matrix
    return feature_matrix(_normalised_long(spark, sf))
