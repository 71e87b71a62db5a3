"""Seasonal adjustment (M18) and helpers for row-set joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNK
from .windows import bounded

KEY, IDX = "series_id", "idx"


def centred_trend(df: DataFrame, cols: list[str], period: int, prefix: str = "_trend_", **kw) -> DataFrame:
    """Centred moving average of one period (2 x p for even p, weights
    1/2p at both ends), NULL where the full window is not available."""
    h = period // 2

    def trend(c: str, w: Window) -> Column:
        if period % 2 == 0:
            inner = w.rowsBetween(-(h - 1), h - 1)
            lo, hi = F.lag(c, h).over(w), F.lead(c, h).over(w)
            full = F.count(F.col(c)).over(w.rowsBetween(-h, h)) == 2 * h + 1
            val = (F.sum(c).over(inner) + 0.5 * (lo + hi)) / F.lit(float(period))
        else:
            frame = w.rowsBetween(-h, h)
            full = F.count(F.col(c)).over(frame) == period
            val = F.avg(c).over(frame)
        return F.when(full, val)

    return bounded(df, lambda w: {prefix + c: trend(c, w) for c in cols}, back=h, ahead=h, **kw)


def deseasonalize(df: DataFrame, cols: list[str], period: int, key: str = KEY, idx: str = IDX,
                  chunk: int = CHUNK) -> DataFrame:
    """M18, additive: classical decomposition. Trend = centred moving
    average; seasonal index per phase ``idx mod p`` = mean of
    (y - trend), centred to sum zero; output y - seasonal[phase]. Returns
    the input columns adjusted; the phase table is one row per series and phase."""
    out = df.withColumn("_ph", F.pmod(F.col(idx), F.lit(period)))
    t = centred_trend(out.select(key, idx, "_ph", *cols), cols, period, key=key, idx=idx, chunk=chunk)
    ph = t.groupBy(key, "_ph").agg(*[F.avg(F.col(c) - F.col(f"_trend_{c}")).alias(f"_raw_{c}") for c in cols])
    every = Window.partitionBy(key)
    ph = ph.select(key, "_ph", *[(F.col(f"_raw_{c}") - F.avg(f"_raw_{c}").over(every)).alias(f"_s_{c}") for c in cols])
    out = out.join(ph, [key, "_ph"], "left").withColumns({c: F.col(c) - F.col(f"_s_{c}") for c in cols})
    return out.drop("_ph", *[f"_s_{c}" for c in cols])


def head(df: DataFrame, n: int, key: str = KEY, order: str = "ts") -> DataFrame:
    """First ``n`` rows of every series (top-k per group; the limit is
    the feature)."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def poly_detrend(long: DataFrame, degree: int = 4, keys: list[str] | None = None, idx: str = IDX) -> DataFrame:
    """Subtract a least-squares polynomial trend in time.

    The normal equations need only sums of ``u^k`` and ``u^k y`` with
    ``u`` the time index scaled to [-1, 1] per series (fitted values do not
    depend on that scaling; it keeps the system well conditioned): one
    grouped aggregate of ``3*degree + 2`` sums, a ``(degree+1)``-square
    solve per series in a tiny grouped map, and a join back.
    Returns ``(keys, idx, value, trend, detrended)``."""
    import numpy as np
    import pandas as pd
    keys = keys or ["series_id", "col"]
    rng = long.groupBy(*keys).agg(F.min(idx).alias("_lo"), F.max(idx).alias("_hi"))
    x = long.join(rng, keys).withColumn(
        "_u", F.when(F.col("_hi") > F.col("_lo"),
                     2.0 * (F.col(idx) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) - 1.0).otherwise(F.lit(0.0)))
    sums = [F.sum(F.pow("_u", k)).alias(f"_p{k}") for k in range(2 * degree + 1)] + \
           [F.sum(F.pow("_u", k) * F.col("value")).alias(f"_q{k}") for k in range(degree + 1)]
    mom = x.where(F.col("value").isNotNull()).groupBy(*keys).agg(*sums)
    d = degree

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        a = np.array([[r[f"_p{i + j}"] for j in range(d + 1)] for i in range(d + 1)], dtype=float)
        b = np.array([r[f"_q{i}"] for i in range(d + 1)], dtype=float)
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        return pd.DataFrame({**{k: [r[k]] for k in keys}, "_beta": [beta.tolist()]})

    schema = ", ".join([f"{k} string" for k in keys] + ["_beta array<double>"])
    coef = mom.groupBy(*keys).applyInPandas(solve, schema)
    trend = F.aggregate(F.sequence(F.lit(0), F.lit(d)), F.lit(0.0),
                        lambda acc, k: acc + F.element_at("_beta", k + 1) * F.pow("_u", k))
    out = x.join(coef, keys).withColumn("trend", trend)
    return out.select(*keys, idx, "value", "trend", (F.col("value") - F.col("trend")).alias("detrended"))
