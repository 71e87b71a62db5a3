"""Distributed Gram matrices for least squares on lagged designs.

Per ``(series, col, chunk)`` an Arrow grouped map builds the design rows of
the chunk's own rows (the halo supplies the lags) and emits the partial
``Z'Z`` of ``Z = [X | y]`` as ``(i, j, v)`` rows; Spark sums them over
chunks (map-side combined); each series then solves a small system
(``<= 54 x 54``) in a grouped map whose group is the Gram table of one
series. No series is ever collected whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK

KEYS = ["series_id", "col"]
GRAM_SCHEMA = "series_id string, col string, i int, j int, v double"


def with_chunk_halo(df: DataFrame, back: int, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    i = F.col(idx)
    own = F.floor(i / F.lit(chunk))
    hi = F.floor((i + F.lit(back)) / F.lit(chunk))
    return df.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, hi)))


def partial_gram(df: DataFrame, build: Callable[[pd.DataFrame], np.ndarray | None], back: int,
                 extra: list[str] | None = None, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """Sum over chunks of ``Z'Z`` where ``build(pdf)`` returns the design
    rows ``Z`` (last column = response) of the own rows of one chunk.
    ``pdf`` holds ``idx, value, _own, _chunk`` (+ ``extra``), sorted by idx,
    halo rows first."""
    cols = KEYS + [idx, "value"] + (extra or [])
    x = with_chunk_halo(df.select(*cols), back, idx, chunk)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx, kind="stable").reset_index(drop=True)
        z = build(pdf)
        if z is None or len(z) == 0:
            return pd.DataFrame({"series_id": np.zeros(0, object), "col": np.zeros(0, object), "i": np.zeros(0, "int32"), "j": np.zeros(0, "int32"), "v": np.zeros(0)})
        g = z.T @ z
        ii, jj = np.triu_indices(g.shape[0])
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "col": pdf["col"].iloc[0],
                             "i": ii.astype("int32"), "j": jj.astype("int32"), "v": g[ii, jj]})

    parts = x.groupBy(*KEYS, "_chunk").applyInPandas(fn, GRAM_SCHEMA)
    return parts.groupBy(*KEYS, "i", "j").agg(F.sum("v").alias("v"))


def to_matrix(pdf: pd.DataFrame) -> np.ndarray:
    """Full symmetric matrix from the upper-triangle ``(i, j, v)`` rows."""
    k = int(max(pdf["i"].max(), pdf["j"].max())) + 1
    g = np.zeros((k, k))
    g[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["v"].to_numpy()
    return g + np.triu(g, 1).T


def ols_from_gram(g: np.ndarray, k: int, n: float):
    """Fit y on the first ``k`` columns: ``(beta, ssr, cov_unscaled)``; the
    response is the last row/column of ``g``."""
    xtx = g[:k, :k]
    xty = g[:k, -1]
    yty = g[-1, -1]
    inv = np.linalg.pinv(xtx)
    beta = inv @ xty
    ssr = float(yty - beta @ xty)
    return beta, max(ssr, 0.0), inv


def aic(ssr: float, n: float, k: int) -> float:
    """Gaussian OLS AIC with the log-likelihood of the fitted model."""
    if ssr <= 0:
        return -np.inf
    return n * (np.log(2 * np.pi) + np.log(ssr / n) + 1) + 2 * k


def lagged(values: np.ndarray, k: int) -> np.ndarray:
    """``values`` shifted by ``k`` (NaN-padded at the start)."""
    out = np.full(len(values), np.nan)
    if k < len(values):
        out[k:] = values[: len(values) - k]
    return out
