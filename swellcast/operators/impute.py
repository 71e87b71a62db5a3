"""Model-based gap filling (M5): ARMA(p, q) chosen by AIC, gaps filled with
in-sample one-step predictions.

Order search: every candidate ``p in [p_min, p_max], q in [0, q_max]`` is a
column subset of ONE Hannan-Rissanen design ``[1, y_{t-1..t-p_max},
e_{t-1..t-q_max} | y_t]`` over a common sample, so a single distributed Gram
(fitted on the forward-filled series) scores all candidates; the smallest
AIC wins (ties: fewer parameters). Differencing order d comes from the ADF
test (``d = 1`` when the unit root is not rejected); d = 1 series are filled
on their differences and re-integrated from the last observed level.

Filling: the rows are walked in time order; a missing value gets
``c + sum phi_i y_{t-i} + sum theta_j e_{t-j}`` (its own residual is 0), an
observed value keeps its value and its residual. A step is an affine map of
the state (the last p values, q residuals and the last level), so every chunk
first yields its whole map, the maps of a series are composed in order (one
small row per chunk), and every chunk is then walked from its exact state:
gaps of any length are filled, whatever the chunks. Before the first
observation the series is taken as that first value, which also fills a
leading gap. A series too short for a model is filled with its mean (order 0).
A series without any value stays empty; its rows are kept, NULL and flagged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK
from .arima import _ar_design, _check_grid, _residuals
from .gram import KEYS, aic, ols_from_gram, partial_gram, to_matrix


def select_arma(filled_long: DataFrame, p_min: int = 1, p_max: int = 3, q_max: int = 3, m: int = 20,
                chunk: int = CHUNK) -> DataFrame:
    """Best ARMA(p, q) per ``(series_id, col)`` by AIC on a gap-free series:
    ``(series_id, col, p, q, c, phi ARRAY, theta ARRAY, ar ARRAY, aic)``."""
    g1 = partial_gram(filled_long, lambda pdf: _ar_design(pdf, m), back=m, chunk=chunk)

    def solve_ar(pdf: pd.DataFrame) -> pd.DataFrame:
        g = to_matrix(pdf)
        beta, _, _ = ols_from_gram(g, g.shape[0] - 1, 0)
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "col": [pdf["col"].iloc[0]],
                             "ar": [beta.tolist()]})

    ar = g1.groupBy(*KEYS).applyInPandas(solve_ar, "series_id string, col string, ar array<double>")
    x = filled_long.join(ar, KEYS, "inner")
    start = m + max(p_max, q_max)

    def design(pdf: pd.DataFrame):
        a = np.asarray(pdf["ar"].iloc[0], dtype=float)
        y = pdf["value"].to_numpy(dtype=float)
        ix = pdf["idx"].to_numpy()
        _check_grid(ix)
        e = _residuals(y, a, m)
        cols = [np.ones(len(y))]
        cols += [np.concatenate([np.full(k, np.nan), y[:-k]]) for k in range(1, p_max + 1)]
        cols += [np.concatenate([np.full(k, np.nan), e[:-k]]) for k in range(1, q_max + 1)]
        z = np.column_stack(cols + [y])
        keep = (pdf["_chunk"].to_numpy() == pdf["_own"].to_numpy()) & (ix >= start)
        z = z[keep]
        return z[~np.isnan(z).any(axis=1)]

    g2 = partial_gram(x, design, back=start, extra=["ar"], chunk=chunk)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        g = to_matrix(pdf)
        n = float(g[0, 0])
        best = None
        for p in range(p_min, p_max + 1):
            for q in range(0, q_max + 1):
                idx = [0] + list(range(1, p + 1)) + list(range(p_max + 1, p_max + q + 1))
                sub = g[np.ix_(idx + [g.shape[0] - 1], idx + [g.shape[0] - 1])]
                beta, ssr, _ = ols_from_gram(sub, len(idx), n)
                crit = aic(ssr, n, len(idx))
                if best is None or crit < best[0] - 1e-12 * abs(best[0]):
                    best = (crit, p, q, beta)
        crit, p, q, beta = best
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "col": [pdf["col"].iloc[0]],
                             "p": [p], "q": [q], "c": [float(beta[0])], "phi": [beta[1:p + 1].tolist()],
                             "theta": [beta[p + 1:].tolist()], "aic": [float(crit)]})

    best = g2.groupBy(*KEYS).applyInPandas(
        choose, "series_id string, col string, p int, q int, c double, phi array<double>, "
                "theta array<double>, aic double")
    return best.join(ar, KEYS, "inner")


def _walk(y: np.ndarray, state: np.ndarray, d: int, p: int, q: int, c0: float, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the rows ``y`` (NaN: missing) from ``state`` = [last p values,
    newest first; last q residuals; last level; 1], given as a matrix whose
    columns are combined linearly: the identity yields the affine map."""
    n, wide = len(y), state.shape[1]
    # values and residuals in one growing table, newest last: no row is copied
    w, e = np.empty((p + n, wide)), np.empty((q + n, wide))
    w[:p], e[:q] = state[:p][::-1], state[p:p + q][::-1]
    level, one, out = state[p + q].copy(), state[p + q + 1], np.empty((n, wide))
    back_phi, back_theta, const = phi[::-1], theta[::-1], c0 * one
    gap = np.isnan(y)
    for t in range(n):
        pred = const + back_phi @ w[t:t + p] + back_theta @ e[t:t + q]
        value = (pred + level if d else pred) if gap[t] else y[t] * one
        now = value - level if d else value
        w[p + t], e[q + t] = now, 0.0 if gap[t] else now - pred
        out[t] = level = value
    return out, np.vstack([w[n:][::-1], e[n:][::-1], level[None], one[None]])


FITTED = ["d", "p", "q", "c", "phi", "theta", "t0", "y0"]


def with_start(model: DataFrame, raw_long: DataFrame) -> DataFrame:
    """The model table with each series' first observation: ``t0, y0``. Series
    without a model get order 0 around their mean, series without values NULLs."""
    first = raw_long.groupBy(*KEYS).agg(F.min(F.when(F.col("value").isNotNull(), F.col("idx"))).alias("t0"),
                                        F.min_by("value", F.when(F.col("value").isNotNull(), F.col("idx"))).alias("y0"), F.avg("value").alias("mean"))
    none = F.array().cast("array<double>")
    return first.join(model.select(*KEYS, "d", "p", "q", "c", "phi", "theta"), KEYS, "left") \
        .withColumns({"c": F.coalesce("c", "mean"), "phi": F.coalesce("phi", none), "theta": F.coalesce("theta", none),
                      **{k: F.coalesce(k, F.lit(0)) for k in ("d", "p", "q")}}).select(*KEYS, *FITTED)


def _order(r) -> tuple:
    return int(r["d"]), int(r["p"]), int(r["q"]), float(r["c"]), np.asarray(r["phi"], float), np.asarray(r["theta"], float)


def _start(r) -> np.ndarray:
    d, p, q = (int(r[k]) for k in "dpq")
    return np.concatenate([np.full(p, 0.0 if d else r["y0"]), np.zeros(q), [r["y0"], 1.0]])


def _chunk_states(raw_long: DataFrame, fitted: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their model and chunk, and the state before every chunk and
    after the last one. ``fitted`` may carry ``cut`` and ``state``: rows that begin
    right behind ``cut`` go on from that state."""
    resumes = [c for c in ("cut", "state") if c in fitted.columns]
    x = raw_long.join(fitted.select(*KEYS, *FITTED, *resumes), KEYS, "left").withColumn("_chunk", F.floor(F.col("idx") / F.lit(chunk)))

    def chunk_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        r = pdf.iloc[0]
        start, begins = _start(r), int(r["idx"])
        early = begins <= r["t0"]  # the state here is known, whatever came before
        state = start[:, None] if early else np.eye(len(start))
        _, end = _walk(pdf["value"].to_numpy(float)[pdf["idx"].to_numpy() > r["t0"]], state, *_order(r))
        if early:
            end = np.hstack([np.zeros((len(start), len(start) - 1)), end])
        saved = r["state"] if resumes else None
        return pd.DataFrame({**{k: [pdf[k].iat[0]] for k in KEYS}, "_chunk": [int(r["_chunk"])], "begins": [begins], "t0": [int(r["t0"])],
                             "cut": [int(r["cut"]) if resumes and pd.notna(r["cut"]) else -1], "map": [end.ravel().tolist()],
                             "start": [start.tolist()], "saved": [None if saved is None else list(saved)]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        r, chunks, states = pdf.iloc[0], [*pdf["_chunk"], int(pdf["_chunk"].iat[-1]) + 1], []
        if r["begins"] <= r["t0"]:
            state = np.asarray(r["start"], float)
        elif r["saved"] is not None and r["begins"] == r["cut"] + 1:
            state = np.asarray(r["saved"], float)
        else:
            raise ValueError(f"rows of {r['series_id']}/{r['col']} begin at {r['begins']}: neither at the series' start nor right behind the fitted rows")
        for flat in pdf["map"]:
            states.append(state.tolist())
            state = np.asarray(flat, float).reshape(len(state), len(state)) @ state
        states.append(state.tolist())
        return pd.DataFrame({**{k: [pdf[k].iat[0]] * len(chunks) for k in KEYS}, "_chunk": chunks, "_state": states})

    maps = x.where(F.col("t0").isNotNull()).groupBy(*KEYS, "_chunk").applyInPandas(
        chunk_map, "series_id string, col string, _chunk long, begins long, t0 long, cut long, map array<double>, start array<double>, saved array<double>")
    return x, maps.groupBy(*KEYS).applyInPandas(compose, "series_id string, col string, _chunk long, _state array<double>")


def apply_imputer(raw_long: DataFrame, fitted: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Fill NULL values of ``raw_long(series_id, col, idx, value)`` with the
    fitted model's one-step predictions; output ``(series_id, col, idx, value,
    imputed)``. The rows are whole series, or those right behind the fitted rows.
    The result does not depend on ``chunk``."""
    x, states = _chunk_states(raw_long, fitted, chunk)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        r, y = pdf.iloc[0], pdf["value"].to_numpy(float)
        out = pdf[[*KEYS, "idx"]].assign(value=np.where(np.isnan(y), pdf["y0"].to_numpy(float), y), imputed=np.isnan(y))
        known = r["_state"]
        if known is not None:
            after = pdf["idx"].to_numpy() > r["t0"]
            state = _start(r) if r["idx"] <= r["t0"] else np.asarray(known, float)
            out.loc[after, "value"] = _walk(y[after], state[:, None], *_order(r))[0][:, 0]
        return out

    return x.join(states, [*KEYS, "_chunk"], "left").groupBy(*KEYS, "_chunk").applyInPandas(
        fill, "series_id string, col string, idx long, value double, imputed boolean")


def fill_gaps(raw_long: DataFrame, model: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """:func:`apply_imputer` with each series' first observation taken from the
    rows themselves."""
    return apply_imputer(raw_long, with_start(model, raw_long), chunk)


def fit_imputer(train_long: DataFrame, filled_long: DataFrame, p_min: int = 1, p_max: int = 3, q_max: int = 3,
                m: int = 20, chunk: int = CHUNK) -> DataFrame:
    """M6: the imputer's state after the train rows, one row per ``(series_id,
    col)``: model, first observation, last row ``cut`` and the recursion's
    ``state`` there. ``filled_long`` is the train series without gaps."""
    model = with_start(select_model(filled_long, p_min, p_max, q_max, m, chunk), train_long)
    _, states = _chunk_states(train_long, model, chunk)
    last = states.groupBy(*KEYS).agg(F.max_by("_state", "_chunk").alias("state"))
    cut = train_long.groupBy(*KEYS).agg(F.max("idx").alias("cut"))
    return model.join(cut, KEYS).join(last, KEYS, "left")


def select_model(filled_long: DataFrame, p_min: int = 1, p_max: int = 3, q_max: int = 3, m: int = 20, chunk: int = CHUNK) -> DataFrame:
    """d by ADF, then order and coefficients by AIC on the (differenced) series."""
    from .adf import adf
    from .windows import seasonal_diff
    d = adf(filled_long, maxlag=min(50, m), regression="c", chunk=chunk) \
        .select(*KEYS, F.when(F.col("stationary"), 0).otherwise(1).alias("d"))
    diffed = seasonal_diff(filled_long.select(*KEYS, "idx", "value"), ["value"], 1, fill_zero=False,
                           key=KEYS, chunk=chunk).where(F.col("value").isNotNull())
    x = filled_long.join(d, KEYS).where(F.col("d") == 0).select(*KEYS, "idx", "value") \
        .unionByName(diffed.join(d, KEYS).where(F.col("d") == 1).select(*KEYS, "idx", "value"))
    return select_arma(x, p_min, p_max, q_max, m, chunk).join(d, KEYS, "inner")


def impute_arma(raw_long: DataFrame, filled_long: DataFrame, p_min: int = 1, p_max: int = 3, q_max: int = 3,
                m: int = 20, chunk: int = CHUNK) -> DataFrame:
    """M5 end to end on one table: model choice on the filled series, then
    :func:`fill_gaps` on the raw one."""
    return fill_gaps(raw_long, select_model(filled_long, p_min, p_max, q_max, m, chunk), chunk)
