"""Registered queries: scans, cleaning, grids, slices, profiles."""

from __future__ import annotations

import calendar

from pyspark.sql import functions as F

from ..config import CLEAN_COLUMNS, SENTINELS, TARGETS
from ..operators import clean, grid, profile
from ..operators.scaling import normalise_by_max
from . import bases, views
from . import oracles as O
from .oracles import rnd
from .queries import register
from .views import MET_SQL, OBS_SQL

RAW_MET = ["WDIR", "WSPD", "GST", "WVHT", "DPD", "APD", "MWD", "PRES", "ATMP", "WTMP", "DEWP", "VIS", "TIDE"]


def _p3_sql_cols() -> str:
    out = []
    for c in RAW_MET:
        if c in SENTINELS:
            vals = ", ".join(repr(v) for v in SENTINELS[c])
            out.append(rnd(f"CASE WHEN {c} IN ({vals}) THEN NULL ELSE {c} END", c))
        else:
            out.append(rnd(c, c))
    return ", ".join(out)


@register("p3_sentinel_null", f"WITH met AS ({MET_SQL}) SELECT series_id, ts, {_p3_sql_cols()} FROM met")
def p3_sentinel_null(spark, sf):
    return clean.mark_missing(views.met(spark, sf), SENTINELS)


def _p4_sql() -> str:
    cols = []
    for c in RAW_MET:
        if c in ("WDIR", "MWD"):
            continue
        if c in SENTINELS:
            vals = ", ".join(repr(v) for v in SENTINELS[c])
            cols.append(rnd(f"CASE WHEN {c} IN ({vals}) THEN NULL ELSE {c} END", c))
        else:
            cols.append(rnd(c, c))
    for c in ("WDIR", "MWD"):
        g = f"CASE WHEN {c} BETWEEN 0 AND 360 THEN {c} END"
        cols.append(rnd(f"sin(radians({g}))", f"{c}_sin"))
        cols.append(rnd(f"cos(radians({g}))", f"{c}_cos"))
    return f"WITH met AS ({MET_SQL}) SELECT series_id, ts, {', '.join(cols)} FROM met"


@register("p4_degree_cyclic", _p4_sql())
def p4_degree_cyclic(spark, sf):
    return clean.degrees_to_cyclic(clean.mark_missing(views.met(spark, sf), SENTINELS), ["WDIR", "MWD"])


_HOURLY_SEL = ", ".join(rnd(c, c) for c in CLEAN_COLUMNS)


@register("p19_preprocess", O.met_hourly_prefix() + f"\nSELECT series_id, ts, idx, {_HOURLY_SEL} FROM hourly")
def p19_preprocess(spark, sf):
    """P3 -> P4 -> P5 -> A1 on the buoy-like view."""
    return bases.met_hourly(spark, sf)


@register("a1_hourly_mean", O.obs_hourly_prefix() + f"\nSELECT series_id, ts, idx, {rnd('value', 'value')} FROM hourly")
def a1_hourly_mean(spark, sf):
    return bases.obs_hourly(spark, sf)


@register("j1_reindex_daily", O.daily_prefix() + f"\nSELECT series_id, d, idx, {rnd('value', 'value')} FROM dgrid")
def j1_reindex_daily(spark, sf):
    return grid.daily_grid(views.daily(spark, sf), ["value"])


_A11_SQL = f"""WITH obs AS ({OBS_SQL}),
{O.grid_ctes('obs', ['value'])},
src AS (SELECT 'obs' AS source, series_id, ts FROM obs UNION ALL SELECT 'hourly', series_id, ts FROM hourly),
d AS (SELECT DISTINCT source, series_id, epoch_us(ts) / 1000000.0 AS s FROM src),
g AS (SELECT source, series_id, s - lag(s) OVER (PARTITION BY source, series_id ORDER BY s) AS dd FROM d),
st AS (SELECT source, series_id, count(*) AS n_points, min(dd) AS lo, max(dd) AS hi FROM g GROUP BY 1, 2)
SELECT source, series_id, n_points, (lo = hi AND n_points >= 3) AS inferred,
  CAST(CASE WHEN lo = hi AND n_points >= 3 THEN lo ELSE 3600 END AS BIGINT) AS step_seconds FROM st"""


@register("a11_infer_step", _A11_SQL)
def a11_infer_step(spark, sf):
    """Step inference on the raw irregular rows and on the hourly grid."""
    raw = grid.infer_step(views.obs(spark, sf)).withColumn("source", F.lit("obs"))
    hr = grid.infer_step(bases.obs_hourly(spark, sf)).withColumn("source", F.lit("hourly"))
    return raw.unionByName(hr)


P6_START, P6_END = "2024-01-03", "2024-01-20"


@register("p6_date_slice", O.obs_hourly_prefix() + f"""
SELECT series_id, ts, idx, {rnd('value', 'value')} FROM hourly
WHERE ts >= TIMESTAMP '{P6_START} 00:00:00' AND ts < TIMESTAMP '{P6_END} 00:00:00' + INTERVAL 1 DAY""")
def p6_date_slice(spark, sf):
    """``.loc['2024-01-03':'2024-01-20']`` on the hourly grid, with the
    filter applied at the scan."""
    lo, hi = clean.slice_bounds(P6_START, P6_END)
    return grid.hourly_mean_sliced(views.obs(spark, sf), ["value"], lo, hi)


_MONTHS = [1]


@register("p7_month_slice", O.met_hourly_prefix() + f"""
SELECT series_id, CAST(month(ts) AS BIGINT) AS month,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(row_number() OVER (PARTITION BY series_id, month(ts) ORDER BY ts) - 1 AS BIGINT) AS axis_ts,
  {rnd('WVHT', 'WVHT')}, {rnd('APD', 'APD')}
FROM hourly WHERE year(ts) = 2024 AND month(ts) IN (1)""")
def p7_month_slice(spark, sf):
    """Year + month slice re-based to ``2024-01-01`` (one step per row; the
    reference puts every month on 1 January)."""
    from pyspark.sql import Window
    h = bases.met_hourly(spark, sf).select("series_id", "ts", *TARGETS)
    x = h.where((F.year("ts") == 2024) & F.month("ts").isin(*_MONTHS)).withColumn("month", F.month("ts").cast("long"))
    w = Window.partitionBy("series_id", "month").orderBy("ts")
    rn = F.row_number().over(w) - 1
    return x.select("series_id", "month",
                    F.timestamp_add("HOUR", rn, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("axis_ts"),
                    *TARGETS)


_P8_YEAR, _P8_MONTH, _P8_DAYS = 2024, 1, [5, 17, 31]


def day_slice(df, year: int, month: int, days: list[int], cols: list[str]):
    """Rows of the requested days with an hour-of-day axis. A day outside
    the month is an error; a requested day without rows yields one row with
    ``has_data = false``."""
    last = calendar.monthrange(year, month)[1]
    bad = [d for d in days if d < 1 or d > last]
    if bad:
        raise ValueError(f"days {bad} outside 1..{last} for {year}-{month:02d}")
    sel = df.where((F.year("ts") == year) & (F.month("ts") == month) & F.dayofmonth("ts").isin(*days)) \
        .withColumn("day", F.dayofmonth("ts"))
    # requested days per series: an explode of a literal array, no join
    wanted = df.select("series_id").distinct() \
        .select("series_id", F.explode(F.array(*[F.lit(d) for d in days])).alias("day"))
    out = wanted.join(sel, ["series_id", "day"], "left")
    return out.select("series_id", F.col("day").cast("long").alias("day"),
                      F.hour("ts").cast("long").alias("hour"), F.col("ts").isNotNull().alias("has_data"), *cols)


@register("p8_day_slice", O.met_hourly_prefix() + f""",
req AS (SELECT unnest([{', '.join(map(str, _P8_DAYS))}]) AS day),
keys AS (SELECT DISTINCT series_id FROM hourly),
sel AS (SELECT *, dayofmonth(ts) AS day FROM hourly WHERE year(ts) = {_P8_YEAR} AND month(ts) = {_P8_MONTH}
        AND dayofmonth(ts) IN ({', '.join(map(str, _P8_DAYS))}))
SELECT k.series_id, CAST(r.day AS BIGINT) AS day, CAST(hour(s.ts) AS BIGINT) AS hour, s.ts IS NOT NULL AS has_data,
  {rnd('s.WVHT', 'WVHT')}, {rnd('s.APD', 'APD')}
FROM keys k JOIN req r ON true LEFT JOIN sel s ON s.series_id = k.series_id AND s.day = r.day""")
def p8_day_slice(spark, sf):
    return day_slice(bases.met_hourly(spark, sf).select("series_id", "ts", *TARGETS), _P8_YEAR, _P8_MONTH,
                     _P8_DAYS, TARGETS)


@register("p9_target_split", O.met_hourly_prefix() + f"""
SELECT series_id, ts, {rnd('WVHT', 'WVHT')}, {rnd('APD', 'APD')} FROM hourly""")
def p9_target_split(spark, sf):
    """Targets of the cleaned grid (``df[TARGETS]``); exogenous = the rest."""
    return bases.met_hourly(spark, sf).select("series_id", "ts", *TARGETS)


@register("p10_calendar", O.obs_filled_prefix() + f"""
SELECT series_id, ts, {rnd('value', 'value')}, CAST(month(ts) AS BIGINT) AS month, CAST(hour(ts) AS BIGINT) AS hour,
  {rnd('sin(2 * pi() * hour(ts) / 24.0)', 'hr_sin')}, {rnd('cos(2 * pi() * hour(ts) / 24.0)', 'hr_cos')} FROM filled""")
def p10_calendar(spark, sf):
    return clean.add_calendar(bases.obs_filled(spark, sf).select("series_id", "ts", "value"))


@register("p12_normalise_max", O.obs_filled_prefix() + f"""
SELECT series_id, idx, {rnd('value / nullif(max(value) OVER (PARTITION BY series_id), 0)', 'value')} FROM filled""")
def p12_normalise_max(spark, sf):
    return normalise_by_max(bases.obs_filled(spark, sf).select("series_id", "idx", "value"), ["value"])


@register("p13_imputed_points", O.obs_filled_prefix() + f"""
SELECT f.series_id, f.ts, {rnd('f.value', 'imputed')} FROM filled f JOIN hourly h
  ON h.series_id = f.series_id AND h.idx = f.idx WHERE h.value IS NULL""")
def p13_imputed_points(spark, sf):
    """Rows whose original hourly value is NULL, with the imputed value."""
    h = bases.obs_hourly(spark, sf)
    f = bases.obs_filled(spark, sf).select("series_id", "idx", F.col("value").alias("imputed"))
    return h.where(F.col("value").isNull()).join(f, ["series_id", "idx"]).select("series_id", "ts", "imputed")


@register("p14_null_counts", O.met_hourly_prefix() + ",\nz AS (" + " UNION ALL ".join(
    f"SELECT series_id, '{c}' AS column_name, count_if({c} IS NULL) AS n_null FROM hourly GROUP BY 1" for c in CLEAN_COLUMNS)
    + ")\nSELECT series_id, column_name, n_null FROM z")
def p14_null_counts(spark, sf):
    """NULL count per series and column of the cleaned grid (the P14 check)."""
    return profile.null_counts(bases.met_hourly(spark, sf), CLEAN_COLUMNS, key="series_id")


_S4_SQL = f"WITH met AS ({MET_SQL})\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, CAST({i} AS BIGINT) AS position, count(*) AS n_rows, count({c}) AS non_null FROM met"
    for i, (c, t) in enumerate([("series_id", "string"), ("ts", "timestamp_ntz")] + [(c, "double") for c in RAW_MET]))


@register("s4_profile", _S4_SQL)
def s4_profile(spark, sf):
    return profile.profile(views.met(spark, sf))


def _s5_sql() -> str:
    parts = []
    for c in CLEAN_COLUMNS:
        parts.append(
            f"SELECT '{c}' AS column_name, count({c}) AS count, {rnd(f'avg({c})', 'mean')}, {rnd(f'stddev_samp({c})', 'std')}, "
            f"{rnd(f'min({c})', 'min')}, {rnd(f'quantile_cont({c}, 0.25)', 'p25')}, {rnd(f'quantile_cont({c}, 0.5)', 'p50')}, "
            f"{rnd(f'quantile_cont({c}, 0.75)', 'p75')}, {rnd(f'max({c})', 'max')} FROM hourly")
    return O.met_hourly_prefix() + "\n" + " UNION ALL ".join(parts)


@register("s5_describe", _s5_sql())
def s5_describe(spark, sf):
    """``describe()`` of the cleaned hourly grid."""
    return profile.describe(bases.met_hourly(spark, sf), CLEAN_COLUMNS)


_LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax"]
_LINEITEM_CAT = ["l_returnflag", "l_linestatus", "l_shipdate"]


def _p2_sql(cols_num, cols_cat) -> str:
    parts = [f"SELECT '{c}' AS column_name, 'numeric' AS kind, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
             f"CASE WHEN count(DISTINCT {c}) < 20 THEN 'discrete' ELSE 'continuous' END AS cls FROM lineitem"
             for c in cols_num]
    parts += [f"SELECT '{c}', 'categorical', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)" for c in cols_cat]
    return " UNION ALL ".join(parts)


@register("p2_column_classes", _p2_sql(_LINEITEM_NUM, _LINEITEM_CAT))
def p2_column_classes(spark, sf):
    """P1 + P2 on ``lineitem``: numeric / categorical, then discrete /
    continuous by distinct count (< 20)."""
    return profile.column_classes(views.read_table(spark, sf, "lineitem"))


@register("p11_calendar_short", O.obs_filled_prefix() + f"""
SELECT series_id, ts, {rnd('value', 'value')}, CAST(month(ts) AS BIGINT) AS month, CAST(hour(ts) AS BIGINT) AS hour
FROM filled""")
def p11_calendar_short(spark, sf):
    """Short calendar features (month, hour), as the datetime encoders use."""
    return clean.add_calendar(bases.obs_filled(spark, sf).select("series_id", "ts", "value"), cyclic=False)
