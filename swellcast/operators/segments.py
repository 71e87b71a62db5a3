"""Fits of many folds from sums over segments.

All bounds of a fold set lie on an arithmetic grid, so they cut a series into
segments, and a fold's rows are a run of whole segments. Each row is summed once,
into its segment; a running sum over the segments of a series gives the sum of
all rows before any bound, and every sliding or expanding fold's sum is the
difference of two of them. No row is copied to its folds: the work is that of
one pass plus one small row per fold, segment and entry.

A fold table is ``(series_id, fold_id, lo, hi)``: the fold is fitted on rows
``lo <= idx < hi``. Its ``cut`` maps a position to the number of its segment, so
that every bound starts a new one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNK
from .blocks import fold_table
from .gram import KEYS, ols_from_gram, with_chunk_halo

Cut = Callable[[Column], Column]


def sliding(df: DataFrame, window: int, horizon: int, step: int) -> DataFrame:
    """Fold table of the sliding folds."""
    t = fold_table(df, window, horizon, step)
    return t.select("series_id", "fold_id", F.col("train_start_idx").alias("lo"), (F.col("train_end_idx") + 1).alias("hi"))


def sliding_cut(window: int, step: int, offsets: tuple[int, ...] = (0,)) -> Cut:
    """Segments between the bounds ``k * step + o`` and ``k * step + window``."""
    return lambda u: sum((F.floor((u - o) / F.lit(step)) for o in (*offsets, window)), F.lit(0)).cast("long")


def expanding_cut(horizon: int, start: str = "test_start", first: tuple[int, ...] = ()) -> Cut:
    """Segments between the bounds ``start + k * horizon`` and the given first rows."""
    def cut(u: Column) -> Column:
        seg = F.floor((u - F.col(start)) / F.lit(horizon))
        for o in first:
            seg = seg + (u >= o).cast("long")
        return seg.cast("long")
    return cut


def _at_bounds(folds: DataFrame, cut: Cut, ends: dict[str, Column]) -> DataFrame:
    """One row per fold and bound: the segment just before it (none before row 0)."""
    marks = F.array(*[F.struct(F.lit(n).alias("end"), cut(p - 1).alias("seg")) for n, p in ends.items()])
    return folds.select("series_id", "fold_id", F.explode(marks).alias("_m")).select("series_id", "fold_id", "_m.end", F.col("_m.seg").alias("_at"))


# ------------------------------------------------------------------- levels

def fold_levels(long: DataFrame, folds: DataFrame, cut: Cut) -> DataFrame:
    """``(series_id, fold_id, col, mean, last)`` of each fold's train rows:
    the levels of both naive forecasters. ``long`` has the columns that ``cut``
    needs beside ``(series_id, col, idx, value)``."""
    v = F.col("value")
    seen = F.when(v.isNotNull(), F.col("idx"))
    segs = long.groupBy(*KEYS, cut(F.col("idx")).alias("seg")).agg(
        F.count("value").alias("_n"), F.sum("value").alias("_s"), F.max(F.when(v.isNotNull(), F.struct("idx", "value"))).alias("_l"))
    run = Window.partitionBy(*KEYS).orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    segs = segs.select(*KEYS, "seg", F.sum("_n").over(run).alias("_n"), F.sum(F.coalesce("_s", F.lit(0.0))).over(run).alias("_s"),
                       F.last("_l", ignorenulls=True).over(run).alias("_l"))
    at = _at_bounds(folds, cut, {"lo": F.col("lo"), "hi": F.col("hi")})
    got = at.join(segs, (at["series_id"] == segs["series_id"]) & (at["_at"] == segs["seg"])) \
        .select(at["series_id"], "fold_id", "end", "col", "_n", "_s", "_l")
    hi, lo = F.col("end") == "hi", F.col("end") == "lo"
    one = got.groupBy("series_id", "fold_id", "col").agg(
        (F.sum(F.when(hi, F.col("_n")).when(lo, -F.col("_n")))).alias("_n"), F.sum(F.when(hi, F.col("_s")).when(lo, -F.col("_s"))).alias("_s"),
        F.max(F.when(hi, F.col("_l"))).alias("_l"))
    one = one.join(folds.select("series_id", "fold_id", "lo"), ["series_id", "fold_id"])
    return one.select("series_id", "fold_id", "col", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias("mean"),
                      F.when(F.col("_l.idx") >= F.col("lo"), F.col("_l.value")).alias("last"))


# -------------------------------------------------------------------- Grams

def segment_grams(df: DataFrame, build: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], back: int, cut: Cut,
                  extra: list[str] | None = None, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """``(series_id, col, seg, i, j, v)``: ``Z'Z`` of every segment. ``build``
    gets a chunk with ``back`` rows of halo, sorted, and returns ``Z`` for each of
    its rows and which rows count; segments without any give zeros."""
    x = with_chunk_halo(df.withColumn("_seg", cut(F.col(idx))).select(*KEYS, idx, "value", "_seg", *(extra or [])), back, idx, chunk)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx, kind="stable").reset_index(drop=True)
        own = (pdf["_chunk"] == pdf["_own"]).to_numpy()
        if not own.any():
            return pd.DataFrame({"series_id": [], "col": [], "seg": [], "i": [], "j": [], "v": []}).astype({"series_id": object, "col": object})
        z, use = build(pdf)
        seg = pdf["_seg"].to_numpy()
        z = np.where((use & own)[:, None], np.nan_to_num(z), 0.0)[own]
        seg = seg[own]
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        ii, jj = np.triu_indices(z.shape[1])
        v = np.concatenate([(p.T @ p)[ii, jj] for p in np.split(z, first[1:])])
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "col": pdf["col"].iloc[0], "seg": np.repeat(seg[first], len(ii)),
                             "i": np.tile(ii, len(first)), "j": np.tile(jj, len(first)), "v": v})

    parts = x.groupBy(*KEYS, "_chunk").applyInPandas(fn, "series_id string, col string, seg long, i int, j int, v double")
    return parts.groupBy(*KEYS, "seg", "i", "j").agg(F.sum("v").alias("v"))


def fold_grams(segs: DataFrame, folds: DataFrame, cut: Cut, starts: dict[str, int]) -> DataFrame:
    """``(series_id, col, fold_id, start, i, j, v)``: for every name in
    ``starts``, the Gram of the fold's rows from ``lo + starts[name]`` on."""
    run = Window.partitionBy(*KEYS, "i", "j").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    prefix = segs.select(*KEYS, "seg", "i", "j", F.sum("v").over(run).alias("v"))
    at = _at_bounds(folds, cut, {"": F.col("hi"), **{n: F.col("lo") + a for n, a in starts.items()}})
    got = at.join(prefix, (at["series_id"] == prefix["series_id"]) & (at["_at"] == prefix["seg"])) \
        .select(at["series_id"], "col", "fold_id", "end", "i", "j", "v")
    names = F.when(F.col("end") == "", F.array(*map(F.lit, starts))).otherwise(F.array("end"))
    signed = F.when(F.col("end") == "", F.col("v")).otherwise(-F.col("v"))
    return got.select(*KEYS, "fold_id", F.explode(names).alias("start"), "i", "j", signed.alias("v")) \
        .groupBy(*KEYS, "fold_id", "start", "i", "j").agg(F.sum("v").alias("v"))


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    k = int(pdf["j"].max()) + 1
    g = np.zeros((k, k))
    i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
    g[i, j] = g[j, i] = pdf["v"].to_numpy()
    return g


# ------------------------------------------------- ARIMA(1,0,1) of every fold

def fold_arima(long: DataFrame, folds: DataFrame, cut: Cut, m: int = 20, chunk: int = CHUNK) -> DataFrame:
    """Hannan-Rissanen ARIMA(1,0,1) with constant of every fold, equal to a
    refit on the fold's rows alone: ``(series_id, col, fold_id, c, phi, theta,
    sigma2, nobs, last_idx, y_last, e_last)``.

    Both regressions come from one Gram of ``[1, y_{t-1} .. y_{t-m-1}, y_t]``:
    the long autoregression is a block of it, and the residual ``e_{t-1}`` is a
    linear form in its columns, so the second design's Gram is ``L G L'``. Values
    are centred by the series' mean, so that differences of running sums keep
    their digits. ``cut`` needs the offsets ``m`` and ``m + 1``."""
    mean = long.groupBy(*KEYS).agg(F.avg("value").alias("_mean"))
    x = long.join(mean, KEYS).withColumn("value", F.col("value") - F.col("_mean"))

    def build(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        y, ix = pdf["value"].to_numpy(float), pdf["idx"].to_numpy()
        if len(ix) > 1 and np.any(np.diff(ix) != 1):
            raise ValueError("ARIMA needs a gap-free grid (fill gaps first)")
        lags = [np.concatenate([np.full(min(k, len(y)), np.nan), y[:max(0, len(y) - k)]]) for k in range(1, m + 2)]
        if len(ix) and ix[0] == 0 and len(y) > m:
            lags[m][m] = 0.0  # the first row of the long autoregression, which does not use this lag
        z = np.column_stack([np.ones(len(y)), *lags, y])
        return z, (ix >= m) & ~np.isnan(z).any(axis=1)

    grams = fold_grams(segment_grams(x, build, m + 1, cut, chunk=chunk), folds, cut, {"ar": m, "arma": m + 1})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g1, g2 = (_matrix(pdf[pdf["start"] == s]) for s in ("ar", "arma"))
        block = [*range(m + 1), m + 2]
        a, _, _ = ols_from_gram(g1[np.ix_(block, block)], m + 1, 0)
        form = np.zeros((4, m + 3))
        form[0, 0] = form[1, 1] = form[3, m + 2] = 1.0
        form[2, 0], form[2, 1], form[2, 2:m + 2] = -a[0], 1.0, -a[1:]
        g = form @ g2 @ form.T
        beta, ssr, _ = ols_from_gram(g, 3, 0)
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "col": [pdf["col"].iloc[0]], "fold_id": [pdf["fold_id"].iloc[0]], "ar": [a.tolist()],
                             "c0": [beta[0]], "phi": [beta[1]], "theta": [beta[2]], "sigma2": [ssr / g[0, 0]], "nobs": [int(round(g[0, 0]))]})

    coef = grams.groupBy(*KEYS, "fold_id").applyInPandas(
        solve, "series_id string, col string, fold_id long, ar array<double>, c0 double, phi double, theta double, sigma2 double, nobs long")
    tail = folds.select("series_id", "fold_id", (F.col("hi") - 1).alias("last_idx"), F.explode(F.sequence(F.col("hi") - 1 - m, F.col("hi") - 1)).alias("idx"))
    last = tail.join(x.select(*KEYS, "idx", "value", "_mean"), ["series_id", "idx"]).groupBy(*KEYS, "fold_id", "last_idx").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("idx", "value")))).alias("_r"), F.first("_mean").alias("_mean"))
    recent = F.transform("_r", lambda r: r["value"])  # newest first, m + 1 of them
    e_last = F.aggregate(F.zip_with(F.slice("ar", 2, m), F.slice(recent, 2, m), lambda a, v: a * v), recent[0] - F.col("ar")[0], lambda s, t: s - t)
    return coef.join(last, [*KEYS, "fold_id"]).select(
        *KEYS, "fold_id", (F.col("c0") + F.col("_mean") * (1 - F.col("phi"))).alias("c"), "phi", "theta", "sigma2", "nobs", "last_idx",
        (recent[0] + F.col("_mean")).alias("y_last"), e_last.alias("e_last"))


# --------------------------------------------- regression on exogenous columns

def fold_regression(long: DataFrame, exog: list[str], folds: DataFrame, cut: Cut, chunk: int = CHUNK) -> DataFrame:
    """Least squares of every fold on a constant and the exogenous columns that
    ``long`` carries: ``(series_id, col, fold_id, beta, nobs)``. Rows with a
    missing value or regressor do not count. Regressors and response are centred
    by their means over the series before they are multiplied."""
    names = ["value", *exog]
    mean = long.groupBy(*KEYS).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)])
    x = long.join(mean, KEYS).withColumns({c: F.col(c) - F.col(f"_m{i}") for i, c in enumerate(names)})

    def build(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        z = np.column_stack([np.ones(len(pdf)), *(pdf[c].to_numpy(float) for c in exog), pdf["value"].to_numpy(float)])
        return z, ~np.isnan(z).any(axis=1)

    grams = fold_grams(segment_grams(x, build, 0, cut, exog, chunk=chunk), folds, cut, {"all": 0})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _matrix(pdf)
        beta, _, _ = ols_from_gram(g, len(exog) + 1, 0)
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "col": [pdf["col"].iloc[0]], "fold_id": [pdf["fold_id"].iloc[0]],
                             "b": [beta.tolist()], "nobs": [int(round(g[0, 0]))]})

    coef = grams.groupBy(*KEYS, "fold_id").applyInPandas(solve, "series_id string, col string, fold_id long, b array<double>, nobs long")
    slopes = F.slice("b", 2, len(exog))
    centre = F.zip_with(slopes, F.array(*[F.col(f"_m{i + 1}") for i in range(len(exog))]), lambda b, c: b * c)
    const = F.aggregate(centre, F.col("b")[0] + F.col("_m0"), lambda s, t: s - t)
    return coef.join(mean, KEYS).select(*KEYS, "fold_id", F.concat(F.array(const), slopes).alias("beta"), "nobs")
