"""Whole-series diagnostics on long series ``(series_id, col, idx, value)``,
one output row per ``(series_id, col)``.

All heavy work is grouped aggregation (map-side combined) or bounded
chunk + halo windows; the per-series results are short arrays (the ACF) on
which the remaining logic runs as Spark higher-order functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CHUNK, Z_975

KEYS = ["series_id", "col"]


def _moments(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("_m"),
                                   F.min("value").alias("_lo"), F.max("value").alias("_hi"))


def acf(long: DataFrame, max_lag: int, keys: list[str] = KEYS, idx: str = "idx",
        chunk: int = CHUNK) -> DataFrame:
    """Biased autocorrelation ``r_k = c_k / c_0`` for k = 0..max_lag
    (divide by n, full-sample mean). Lagged deviations come from a chunked
    bounded window; one grouped sum yields all ``c_k``.
    Output ``(*keys, n, is_constant, r ARRAY<DOUBLE>)``."""
    mom = _moments(long, keys)
    x = long.join(mom.select(*keys, "_m"), keys, "inner").withColumn("_d", F.col("value") - F.col("_m"))
    parts = _lag_products(x.select(*keys, idx, "_d"), max_lag, list(keys), idx, chunk)
    sums = parts.groupBy(*keys).agg(*[F.sum(F.col(f"_c{k}")).alias(f"_c{k}") for k in range(0, max_lag + 1)])
    r = F.array(F.lit(1.0), *[F.col(f"_c{k}") / F.col("_c0") for k in range(1, max_lag + 1)])
    out = sums.join(mom.select(*keys, "n", "_lo", "_hi"), keys, "inner")
    return out.select(*keys, "n", (F.col("_lo") == F.col("_hi")).alias("is_constant"),
                      F.when(F.col("_lo") != F.col("_hi"), r).alias("r"))


def _lag_products(df: DataFrame, max_lag: int, keys: list[str], idx: str, chunk: int) -> DataFrame:
    """Per ``(keys, chunk)``: partial ``sum_t d_t * d_{t-k}`` over the chunk's
    own rows for k = 0..max_lag, in one Arrow grouped map (the halo holds
    the lagged rows). One row per chunk; Spark sums the chunks."""
    i = F.col(idx)
    own = F.floor(i / F.lit(chunk))
    hi = F.floor((i + F.lit(max_lag)) / F.lit(chunk))
    x = df.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, hi)))
    out_cols = [f"_c{k}" for k in range(max_lag + 1)]

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx, kind="stable")
        ix = pdf[idx].to_numpy()
        d = pdf["_d"].to_numpy(dtype=float)
        own_pos = np.nonzero(pdf["_own"].to_numpy() == pdf["_chunk"].to_numpy())[0]
        row = {k: [pdf[k].iloc[0]] for k in keys}
        for k in range(max_lag + 1):
            p = own_pos[own_pos - k >= 0]
            p = p[ix[p - k] == ix[p] - k]            # the lagged row exists (gap-free grid)
            row[f"_c{k}"] = [float(np.dot(d[p], d[p - k]))]
        return pd.DataFrame(row)

    schema = ", ".join([f"{k} string" for k in keys] + [f"{c} double" for c in out_cols])
    return x.groupBy(*keys, "_chunk").applyInPandas(fn, schema)


def local_maxima(r: Column) -> Column:
    """Lags k (1..K-1) with ``r[k] > r[k-1]`` and ``r[k] > r[k+1]``
    (strict on both sides, ends excluded). ``r`` is 0-based by lag."""
    k_max = F.size(r) - 2
    return F.filter(F.sequence(F.lit(1), F.greatest(k_max, F.lit(1))),
                    lambda k: (k <= k_max) & (F.element_at(r, k + 1) > F.element_at(r, k)) &
                    (F.element_at(r, k + 1) > F.element_at(r, k + 2)))


def bartlett_se(r: Column, m: Column, n: Column) -> Column:
    """D9 on the lag-1.. array ``r1`` (element 0 = lag 1): ``sqrt(1/n)`` when
    ``m == 1``, else ``sqrt((1 + 2 * sum(r1[:m-1]^2)) / n)``."""
    head = F.slice(r, 1, F.greatest(m - 1, F.lit(0)))
    ss = F.aggregate(head, F.lit(0.0), lambda acc, x: acc + x * x)
    return F.when(m == 1, F.sqrt(F.lit(1.0) / n)).otherwise(F.sqrt((F.lit(1.0) + 2 * ss) / n))


def seasonality(acf_df: DataFrame, seasonal_period: int | None = None, confidence: float = 0.05,
                z: float = Z_975) -> DataFrame:
    """D10 (+ A12, D8, D9, J10, T6) on the output of :func:`acf`.

    Constant series -> ``(False, 0)``; candidates = ACF local maxima (or the
    user period when it is among them, else ``(False, period)``); band =
    ``mean(r1..) + z * var(r1..)`` (population variance, as the reference);
    the first candidate ``c`` with ``r[c] > bartlett(c-1) * band`` wins.
    """
    if seasonal_period is not None:
        if not isinstance(seasonal_period, int) or seasonal_period < 2:
            raise ValueError(f"a season needs a whole number of at least 2 steps, got {seasonal_period!r}")
        # the lag count is a property of the ACF rows; a period beyond it fails when they are read
        too_far = F.size("r") - 1 <= seasonal_period
        acf_df = acf_df.withColumn("r", F.when(too_far, F.raise_error(F.concat(
            F.lit(f"period {seasonal_period} needs autocorrelations beyond it, the last lag is "), F.size("r") - 1))).otherwise(F.col("r")))
    if abs(confidence - 0.05) > 1e-12 and z == Z_975:
        raise ValueError("pass the matching normal quantile z for a non-default confidence")
    r = F.col("r")
    r1 = F.slice(r, 2, F.size(r) - 1)                      # lags 1..K
    k = F.size(r1).cast("double")
    mean1 = F.aggregate(r1, F.lit(0.0), lambda a, x: a + x) / k
    var1 = F.aggregate(r1, F.lit(0.0), lambda a, x: a + (x - mean1) * (x - mean1)) / k
    band = mean1 + F.lit(z) * var1
    cands = local_maxima(r)
    if seasonal_period is not None:
        member = F.array_contains(cands, F.lit(seasonal_period))
        cands = F.when(member, F.array(F.lit(seasonal_period))).otherwise(F.array().cast("array<int>"))
    n = F.col("n").cast("double")
    ok = F.filter(cands, lambda c: F.element_at(r, c + 1) >
                  bartlett_se(r1, c - 1, n) * band)
    first_ok = F.array_min(ok)
    no_cand = F.size(local_maxima(r)) == 0
    seasonal = F.when(F.col("is_constant") | no_cand, F.lit(False)).otherwise(first_ok.isNotNull())
    if seasonal_period is None:
        period = F.when(F.col("is_constant") | no_cand, F.lit(0)).otherwise(F.coalesce(first_ok, F.lit(0)))
    else:
        period = F.when(F.col("is_constant") | no_cand, F.lit(0)) \
            .when(~F.array_contains(local_maxima(r), F.lit(seasonal_period)), F.lit(seasonal_period)) \
            .otherwise(F.coalesce(first_ok, F.lit(0)))
    return acf_df.select("series_id", "col", "n", F.col("is_constant"), seasonal.alias("seasonal"),
                         period.cast("long").alias("seasonal_period"),
                         F.size(local_maxima(r)).cast("long").alias("n_candidates"),
                         F.array_min(local_maxima(r)).cast("long").alias("first_candidate"))


def white_test(long: DataFrame, keys: list[str] = KEYS, idx: str = "idx", confidence: float = 0.05) -> DataFrame:
    """OLS of y on the time index, then White's test of the squared
    residuals on ``[1, t, t^2]``.

    Pass 1 is ``regr_slope/regr_intercept``; pass 2 uses the centred index u
    (equal spacing makes u orthogonal to u^2), so
    ``R^2 = corr(e^2, u)^2 + corr(e^2, u^2)^2``; ``LM = n R^2``;
    with 2 degrees of freedom ``p_LM = exp(-LM/2)`` and
    ``p_F = (1 - R^2)^((n-3)/2)`` in closed form. A series with gaps or NULL
    values is an error: the closed form needs equal steps.
    """
    t = F.col(idx).cast("double")
    p1 = long.groupBy(*keys).agg(F.regr_slope("value", t).alias("_b"), F.regr_intercept("value", t).alias("_a"),
                                 F.count("value").alias("n"), F.avg(t).alias("_tm"),
                                 (F.max(idx) - F.min(idx) + 1).alias("_span"), F.count(F.lit(1)).alias("_rows"), F.count_distinct(idx).alias("_steps"))
    even = (F.col("n") == F.col("_rows")) & (F.col("_rows") == F.col("_span")) & (F.col("_steps") == F.col("_rows"))
    p1 = p1.withColumn("n", F.when(even, F.col("n")).otherwise(F.raise_error(F.lit("the White test needs equally spaced values without NULLs"))))
    x = long.join(p1, keys, "inner")
    e2 = F.pow(F.col("value") - (F.col("_a") + F.col("_b") * t), 2)
    u = t - F.col("_tm")
    p2 = x.groupBy(*keys, "n").agg(F.corr(e2, u).alias("_r1"), F.corr(e2, u * u).alias("_r2"))
    r2 = F.coalesce(F.col("_r1"), F.lit(0.0)) ** 2 + F.coalesce(F.col("_r2"), F.lit(0.0)) ** 2
    lm = F.col("n") * r2
    p_lm = F.exp(-lm / 2)
    p_f = F.pow(F.lit(1.0) - r2, (F.col("n") - 3) / 2.0)
    return p2.select(*keys, "n", ((p_lm < confidence) & (p_f < confidence)).alias("heteroscedastic"),
                     lm.alias("lm_statistic"), p_lm.alias("lm_p_value"), p_f.alias("f_p_value"))


# ------------------------------------------------------------- PACF
def _durbin_levinson(r: np.ndarray) -> np.ndarray:
    """PACF from autocorrelations r[0..K] (Durbin-Levinson recursion)."""
    k_max = len(r) - 1
    out = np.zeros(k_max + 1)
    out[0] = 1.0
    phi = np.zeros(k_max + 1)
    prev = np.zeros(k_max + 1)
    v = 1.0
    for k in range(1, k_max + 1):
        acc = r[k] - np.dot(prev[1:k], r[k - 1:0:-1])
        phi_kk = acc / v if v != 0 else np.nan
        phi[1:k] = prev[1:k] - phi_kk * prev[k - 1:0:-1]
        phi[k] = phi_kk
        v = v * (1 - phi_kk * phi_kk)
        out[k] = phi_kk
        prev = phi.copy()
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def pacf_from_acf(r: pd.Series) -> pd.Series:
    """D7 helper: one short array (<= 81 numbers) per series in, one out."""
    return r.apply(lambda a: None if a is None else _durbin_levinson(np.asarray(a, dtype=float)).tolist())


def pacf(acf_df: DataFrame) -> DataFrame:
    """Partial autocorrelation (Yule-Walker / Durbin-Levinson on the
    biased ACF), lags 0..K."""
    return acf_df.select("series_id", "col", "n", pacf_from_acf(F.col("r")).alias("pacf"))

