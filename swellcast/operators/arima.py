"""ARIMA(1,0,1) with constant by Hannan-Rissanen (M4), distributed.

Pass 1: long AR(m) by a distributed Gram solve. Pass 2: each chunk (with
an m+1 halo) computes the long-AR residuals e_t in place and adds its rows
``[1, y_{t-1}, e_{t-1} | y_t]`` to a second Gram; solving it gives
``(c, phi, theta)``. The last state ``(y_T, e_T)`` comes from the final
m+1 rows only. h-step forecasts are closed form:
``f_1 = c + phi*y_T + theta*e_T``, ``f_h = mu + phi^(h-1) (f_1 - mu)``,
``mu = c / (1 - phi)``. Estimates are close to, not equal to, maximum
likelihood.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK
from .gram import KEYS, ols_from_gram, partial_gram, to_matrix


def _check_grid(ix: np.ndarray) -> None:
    if len(ix) > 1 and np.any(np.diff(ix) != 1):
        raise ValueError("ARIMA needs a gap-free grid (fill gaps first)")


def _ar_design(pdf: pd.DataFrame, m: int) -> np.ndarray:
    y = pdf["value"].to_numpy(dtype=float)
    ix = pdf["idx"].to_numpy()
    _check_grid(ix)
    cols = [np.ones(len(y))] + [np.concatenate([np.full(k, np.nan), y[:-k]]) for k in range(1, m + 1)] + [y]
    z = np.column_stack(cols)
    keep = (pdf["_chunk"].to_numpy() == pdf["_own"].to_numpy()) & (ix >= m)
    z = z[keep]
    return z[~np.isnan(z).any(axis=1)]


def _residuals(y: np.ndarray, a: np.ndarray, m: int) -> np.ndarray:
    e = np.full(len(y), np.nan)
    if len(y) > m:
        past = np.lib.stride_tricks.sliding_window_view(y[:-1], m)  # row t - m: y_{t-m} .. y_{t-1}
        e[m:] = y[m:] - (a[0] + past @ a[:0:-1])
    return e


def hannan_rissanen(long: DataFrame, m: int = 20, chunk: int = CHUNK) -> DataFrame:
    """Fit per ``(series_id, col)``; returns ``c, phi, theta, sigma2, nobs,
    last_idx, y_last, e_last``."""
    g1 = partial_gram(long, lambda p: _ar_design(p, m), back=m, chunk=chunk)

    def solve_ar(pdf: pd.DataFrame) -> pd.DataFrame:
        g = to_matrix(pdf)
        beta, _, _ = ols_from_gram(g, g.shape[0] - 1, 0)
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "col": [pdf["col"].iloc[0]],
                             "ar": [beta.tolist()]})

    ar = g1.groupBy(*KEYS).applyInPandas(solve_ar, "series_id string, col string, ar array<double>")
    x = long.join(ar, KEYS, "inner")

    def design2(pdf: pd.DataFrame):
        a = np.asarray(pdf["ar"].iloc[0], dtype=float)
        y = pdf["value"].to_numpy(dtype=float)
        ix = pdf["idx"].to_numpy()
        _check_grid(ix)
        e = _residuals(y, a, m)
        z = np.column_stack([np.ones(len(y)), np.concatenate([[np.nan], y[:-1]]),
                             np.concatenate([[np.nan], e[:-1]]), y])
        keep = (pdf["_chunk"].to_numpy() == pdf["_own"].to_numpy()) & (ix >= m + 1)
        z = z[keep]
        return z[~np.isnan(z).any(axis=1)]

    g2 = partial_gram(x, design2, back=m + 1, extra=["ar"], chunk=chunk)

    def solve_arma(pdf: pd.DataFrame) -> pd.DataFrame:
        g = to_matrix(pdf)
        beta, ssr, _ = ols_from_gram(g, 3, 0)
        n = g[0, 0]
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "col": [pdf["col"].iloc[0]],
                             "c": [beta[0]], "phi": [beta[1]], "theta": [beta[2]],
                             "sigma2": [ssr / n], "nobs": [int(n)]})

    coef = g2.groupBy(*KEYS).applyInPandas(
        solve_arma, "series_id string, col string, c double, phi double, theta double, sigma2 double, nobs long")

    # last state from the final m+1 rows of each series only
    last = long.groupBy(*KEYS).agg(F.max("idx").alias("_last"))
    tail = x.join(last, KEYS, "inner").where(F.col("idx") >= F.col("_last") - m)

    def state(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        a = np.asarray(pdf["ar"].iloc[0], dtype=float)
        y = pdf["value"].to_numpy(dtype=float)
        e = _residuals(y, a, m)
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "col": [pdf["col"].iloc[0]],
                             "last_idx": [int(pdf["idx"].iloc[-1])], "y_last": [y[-1]], "e_last": [e[-1]]})

    st = tail.select(*KEYS, "idx", "value", "ar").groupBy(*KEYS).applyInPandas(
        state, "series_id string, col string, last_idx long, y_last double, e_last double")
    return coef.join(st, KEYS, "inner")


def ahead(step: Column) -> Column:
    """``step`` hours after the last fitted row, closed form, from the columns
    ``c, phi, theta, y_last, e_last``."""
    h = step.cast("double")
    f1 = F.col("c") + F.col("phi") * F.col("y_last") + F.col("theta") * F.col("e_last")
    mu = F.col("c") / (F.lit(1.0) - F.nullif(F.col("phi"), F.lit(1.0)))
    return F.when(F.col("phi") == 1.0, f1 + (h - 1) * F.col("c")).otherwise(mu + F.pow(F.col("phi"), h - 1) * (f1 - mu))


def forecast(coef: DataFrame, horizon: int) -> DataFrame:
    """Rows ``(series_id, col, step, idx, yhat)`` for steps 1..horizon after
    each series' last fitted row (closed form, no recursion over rows)."""
    x = coef.select(*KEYS, "c", "phi", "theta", "y_last", "e_last", "last_idx",
                    F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return x.select(*KEYS, F.col("step").cast("long"), (F.col("last_idx") + F.col("step")).alias("idx"),
                    ahead(F.col("step")).alias("yhat"))
