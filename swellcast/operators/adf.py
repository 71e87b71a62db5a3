"""Augmented Dickey-Fuller test (D1), distributed.

Regression of ``dy_t`` on ``[trend terms, y_{t-1}, dy_{t-1} .. dy_{t-p}]``: no
trend term (``n``), a constant (``c``), a line (``ct``) or a parabola (``ctt``).
Pass 1: Gram over the common sample (``t > maxlag``) -> every lag order
0..maxlag is a nested sub-block; pick the order with the smallest AIC
(ties -> fewer lags). Pass 2: Gram over the refit sample of the chosen
order -> t statistic of the ``y_{t-1}`` coefficient. p-value from
MacKinnon's (1994) response surface for one variable.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK
from .gram import KEYS, aic, ols_from_gram, partial_gram, to_matrix

# --- fixed values: MacKinnon (1994) response-surface coefficients, N = 1 ----
# regression -> (tau_max, tau_min, tau_star, small-p coefficients, large-p coefficients)
MACKINNON = {
    "n": (math.inf, -19.04, -1.04, [0.6344, 1.2378, 0.032496], [0.4797, 0.93557, -0.06999, 0.033066]),
    "c": (2.74, -18.83, -1.61, [2.1659, 1.4412, 0.038269], [1.7339, 0.93202, -0.12745, -0.010368]),
    "ct": (0.7, -16.18, -2.89, [3.2512, 1.6047, 0.049588], [2.5261, 0.61654, -0.37956, -0.060285]),
    "ctt": (0.54, -17.17, -3.21, [4.0003, 1.658, 0.048288], [3.0778, 0.49529, -0.41477, -0.059359]),
}


TIME_UNIT = 1000.0


def mackinnon_p(stat: float, regression: str = "c") -> float:
    tmax, tmin, tstar, small, large = MACKINNON[regression]
    if not np.isfinite(stat):
        return float("nan")
    if stat > tmax:
        return 1.0
    if stat < tmin:
        return 0.0
    coef = small if stat <= tstar else large
    x = sum(c * stat ** k for k, c in enumerate(coef))
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def _n_trend(regression: str) -> int:
    return {"n": 0, "c": 1, "ct": 2, "ctt": 3}[regression]


def _design(pdf: pd.DataFrame, n_lags: int, first: int, regression: str, idx: str = "idx") -> np.ndarray | None:
    """Design rows of the chunk's own rows with ``idx >= first``."""
    y = pdf["value"].to_numpy(dtype=float)
    ix = pdf[idx].to_numpy()
    if len(y) > 1 and np.any(np.diff(ix) != 1):
        raise ValueError("ADF needs a gap-free grid (fill gaps first)")
    dy = np.concatenate([[np.nan], np.diff(y)])
    cols = [np.ones(len(y))]  # counts the rows, also where the regression has no constant
    u = ix / TIME_UNIT  # the test does not depend on the unit; the squares keep their digits
    cols += [u ** k for k in range(1, _n_trend(regression))]
    cols.append(np.concatenate([[np.nan], y[:-1]]))                      # y_{t-1}
    for k in range(1, n_lags + 1):
        cols.append(np.concatenate([np.full(k, np.nan), dy[:-k]]) if k < len(dy) else np.full(len(dy), np.nan))
    cols.append(dy)                                                     # response
    z = np.column_stack(cols)
    keep = (pdf["_chunk"].to_numpy() == pdf["_own"].to_numpy()) & (ix >= first)
    z = z[keep]
    z = z[~np.isnan(z).any(axis=1)]
    return z


def adf(long: DataFrame, maxlag: int = 50, regression: str = "c", autolag: bool = True,
        p_threshold: float = 0.05, chunk: int = CHUNK) -> DataFrame:
    """D1 on long series ``(series_id, col, idx, value)`` (gap-free, no NULLs).
    Output ``(series_id, col, adf_stat, p_value, used_lag, nobs, ic_best, stationary)``."""
    if regression not in MACKINNON:
        raise ValueError(f"regression must be one of {sorted(MACKINNON)}")
    nt = _n_trend(regression)
    skip = int(nt == 0)  # the column that only counts
    first = maxlag + 1

    def _fit(g, k):
        """OLS on the first k regressors of the Gram ``g`` (response last)."""
        use = [*range(skip, skip + k), g.shape[0] - 1]
        return ols_from_gram(g[np.ix_(use, use)], k, 0)

    g1 = partial_gram(long, lambda p: _design(p, maxlag, first, regression), back=maxlag + 1, chunk=chunk)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        g = to_matrix(pdf)
        nobs = float(g[0, 0])                    # the constant column counts the rows
        best = None
        if autolag:
            for lag in range(0, maxlag + 1):
                k = nt + 1 + lag
                _, ssr, _ = _fit(g, k)
                crit = aic(ssr, nobs, k)
                if best is None or crit < best[0] - 1e-12 * abs(best[0]):
                    best = (crit, lag)
        else:
            best = (float("nan"), maxlag)
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "col": [pdf["col"].iloc[0]],
                             "used_lag": [int(best[1])], "ic_best": [float(best[0])]})

    lags = g1.groupBy(*KEYS).applyInPandas(pick, "series_id string, col string, used_lag int, ic_best double")

    # pass 2: refit at the chosen order on its own (longer) sample
    x = long.join(lags.select(*KEYS, "used_lag"), KEYS, "inner")

    def design2(pdf: pd.DataFrame):
        lag = int(pdf["used_lag"].iloc[0])
        return _design(pdf, lag, lag + 1, regression)

    g2 = partial_gram(x, design2, back=maxlag + 1, extra=["used_lag"], chunk=chunk)

    def stat(pdf: pd.DataFrame) -> pd.DataFrame:
        g = to_matrix(pdf)
        k = g.shape[0] - 1 - skip
        nobs = g[0, 0]
        beta, ssr, inv = _fit(g, k)
        sigma2 = ssr / (nobs - k)
        j = nt                                   # position of y_{t-1}
        t = beta[j] / math.sqrt(sigma2 * inv[j, j]) if sigma2 > 0 and inv[j, j] > 0 else float("nan")
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "col": [pdf["col"].iloc[0]],
                             "adf_stat": [t], "p_value": [mackinnon_p(t, regression)], "nobs": [int(nobs)]})

    st = g2.groupBy(*KEYS).applyInPandas(stat, "series_id string, col string, adf_stat double, p_value double, nobs long")
    out = st.join(lags, KEYS, "inner")
    return out.select(*KEYS, "adf_stat", "p_value", "used_lag", "nobs", "ic_best",
                      (F.col("p_value") < p_threshold).alias("stationary"))
