"""DuckDB oracle SQL for the registered queries.

Built from CTE fragments that mirror the Spark operators step by step. The
driver pre-registers the raw tables as views; the derived views (``obs``,
``met``, ``daily``) are inlined as CTEs. Every double is rounded to 6
decimals, as on the Spark side.
"""

from __future__ import annotations

from ..config import ANGLE_COLUMNS, CLEAN_COLUMNS, SENTINELS
from .views import DAILY_SQL, MET_SQL, OBS_SQL

R = 6  # rounding digits at the comparison boundary


def rnd(expr: str, alias: str) -> str:
    """Round as the Spark side does: through an exact decimal, so that decimal
    ties (x.xxxxxx5, common in this data) fall the same way in both engines."""
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(38, 11)), {R}) AS DOUBLE) AS {alias}"


# ------------------------------------------------------------------ grids
def clean_sql(src: str = "met") -> str:
    """P3 + P4 + P5 on ``met`` (column order of the Spark output)."""
    parts = []
    for c in ["WSPD", "GST", "WVHT", "APD", "PRES", "ATMP", "WTMP", "DEWP"]:
        vals = ", ".join(f"{v!r}" for v in SENTINELS[c])
        parts.append(f"CASE WHEN {c} IN ({vals}) THEN NULL ELSE {c} END AS {c}")
    for c in ANGLE_COLUMNS:
        good = f"CASE WHEN {c} BETWEEN 0 AND 360 THEN {c} END"
        parts.append(f"sin(radians({good})) AS {c}_sin")
        parts.append(f"cos(radians({good})) AS {c}_cos")
    return f"SELECT series_id, ts, {', '.join(parts)} FROM {src}"


def grid_ctes(src: str, cols: list[str], name: str = "hourly") -> str:
    """A1: hourly mean + spine + left join -> ``name(series_id, ts, idx, cols)``."""
    avgs = ", ".join(f"avg({c}) AS {c}" for c in cols)
    sel = ", ".join(f"h.{c}" for c in cols)
    return f"""{name}_agg AS (SELECT series_id, date_trunc('hour', ts) AS ts, {avgs} FROM {src} GROUP BY 1, 2),
{name}_b AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM {name}_agg GROUP BY 1),
{name}_sp AS (SELECT series_id, lo, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM {name}_b),
{name} AS (SELECT s.series_id, s.ts, CAST(date_diff('hour', s.lo, s.ts) AS BIGINT) AS idx, {sel}
  FROM {name}_sp s LEFT JOIN {name}_agg h ON h.series_id = s.series_id AND h.ts = s.ts)"""


def met_hourly_prefix() -> str:
    """WITH met, clean, hourly (P19 grid with the 12 clean columns)."""
    return f"""WITH met AS ({MET_SQL}),
clean AS ({clean_sql()}),
{grid_ctes('clean', CLEAN_COLUMNS)}"""


def obs_hourly_prefix() -> str:
    return f"""WITH obs AS ({OBS_SQL}),
{grid_ctes('obs', ['value'])}"""


def ffill_cte(src: str, cols: list[str], name: str, leading: bool = True,
              keep: str = "series_id, ts, idx") -> str:
    """W7 (+ leading back-fill) over ``src``."""
    w = "(PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    wall = "(PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    parts = []
    for c in cols:
        e = f"last_value({c} IGNORE NULLS) OVER {w}"
        if leading:
            e = f"coalesce({e}, first_value({c} IGNORE NULLS) OVER {wall})"
        parts.append(f"{e} AS {c}")
    return f"{name} AS (SELECT {keep}, {', '.join(parts)} FROM {src})"


def obs_filled_prefix() -> str:
    return obs_hourly_prefix() + ",\n" + ffill_cte("hourly", ["value"], "filled")


def daily_prefix() -> str:
    return f"""WITH daily AS ({DAILY_SQL}),
daily_b AS (SELECT series_id, min(d) AS lo, max(d) AS hi FROM daily GROUP BY 1),
daily_sp AS (SELECT series_id, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM daily_b),
dgrid AS (SELECT s.series_id, s.d, CAST(date_diff('day', s.lo, s.d) AS BIGINT) AS idx, g.value
  FROM daily_sp s LEFT JOIN daily g ON g.series_id = s.series_id AND g.d = s.d)"""


# --------------------------------------------------------------- flagship
def block_benchmark_sql(test_size: int = 216, horizon: int = 72, strategies: dict | None = None,
                        final: bool = True) -> str:
    """M14 with naive forecasters (default: WVHT last, APD mean) on the met grid.
    ``final=False`` leaves the CTE ``outp(series_id, metric, value)`` open."""
    strategies = strategies or {"WVHT": "last", "APD": "mean"}
    lw = "arg_max(WVHT, idx)" if strategies["WVHT"] == "last" else "avg(WVHT)"
    la = "arg_max(APD, idx)" if strategies["APD"] == "last" else "avg(APD)"
    body = met_hourly_prefix() + f""",
y AS (SELECT series_id, idx, WVHT, APD FROM hourly),
n AS (SELECT series_id, max(idx) + 1 AS n_rows FROM y GROUP BY 1),
split AS (SELECT y.*, n.n_rows, n.n_rows - {test_size} AS test_start FROM y JOIN n USING (series_id)),
train AS (SELECT series_id, idx, WVHT, APD FROM split WHERE idx < test_start),
{ffill_cte('train', ['WVHT', 'APD'], 'filled', keep='series_id, idx')},
st AS (SELECT series_id, avg(WVHT) AS m_w, CASE WHEN coalesce(stddev_pop(WVHT), 0) = 0 THEN 1 ELSE stddev_pop(WVHT) END AS s_w,
              avg(APD) AS m_a, CASE WHEN coalesce(stddev_pop(APD), 0) = 0 THEN 1 ELSE stddev_pop(APD) END AS s_a
       FROM filled GROUP BY 1),
sc AS (SELECT f.series_id, f.idx, (f.WVHT - st.m_w) / st.s_w AS WVHT, (f.APD - st.m_a) / st.s_a AS APD
       FROM filled f JOIN st USING (series_id)),
model AS (SELECT series_id, {lw} AS lw, {la} AS la FROM sc GROUP BY 1),
test AS (SELECT series_id, idx, WVHT, APD, CAST(floor((idx - test_start) / {horizon}) AS BIGINT) + 1 AS block_id,
         CAST(floor((n_rows - test_start) / {horizon}) AS BIGINT) AS nb FROM split WHERE idx >= test_start),
pairs AS (
  SELECT t.series_id, t.block_id, 'WVHT' AS col, t.WVHT AS y, m.lw * st.s_w + st.m_w AS yhat
  FROM test t JOIN model m USING (series_id) JOIN st USING (series_id) WHERE t.block_id <= t.nb
  UNION ALL
  SELECT t.series_id, t.block_id, 'APD' AS col, t.APD AS y, m.la * st.s_a + st.m_a AS yhat
  FROM test t JOIN model m USING (series_id) JOIN st USING (series_id) WHERE t.block_id <= t.nb),
pe AS (SELECT *, (y - yhat) / greatest(abs(y), 2.220446049250313e-16) AS e FROM pairs WHERE y IS NOT NULL),
percol AS (SELECT series_id, block_id, col, sqrt(avg(e * e)) AS rmspe, avg(abs(e)) AS mape FROM pe GROUP BY 1, 2, 3),
blk AS (SELECT series_id, block_id, avg(rmspe) AS rmspe, avg(mape) AS mape FROM percol GROUP BY 1, 2),
blong AS (
  SELECT series_id, block_id, 'MeanSquaredPercentageError' AS scorer, rmspe AS value FROM blk
  UNION ALL SELECT series_id, block_id, 'MeanAbsolutePercentageError', mape FROM blk),
outp AS (
  SELECT series_id, 'block_' || block_id || '_' || scorer AS metric, value FROM blong
  UNION ALL SELECT series_id, 'avg_' || scorer, avg(value) FROM blong GROUP BY series_id, scorer
  UNION ALL SELECT series_id, 'std_' || scorer, stddev_pop(value) FROM blong GROUP BY series_id, scorer)"""
    if not final:
        return body
    return body + f"\nSELECT series_id, metric, {rnd('value', 'value')} FROM outp"
